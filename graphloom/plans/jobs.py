"""Jobs as a log of events: current states, active jobs, and progress events thinned out."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F

from ..storage import latest

TERMINAL = ("done", "error")


def current(events: DataFrame) -> DataFrame:
    """The last event of each job."""
    return latest(events, "job", ["ts", "event_id"])


def active(events: DataFrame) -> DataFrame:
    """The latest queued or running job of each repository."""
    return latest(current(events).where(F.col("state").isin("queued", "running")), "repo_id", ["ts", "event_id"])


def mark_orphans(jobs: DataFrame) -> DataFrame:
    """Jobs that were queued or running when the process ended have failed."""
    return jobs.withColumn("state", F.when(F.col("state").isin("queued", "running"), "error").otherwise(F.col("state")))


def throttled_by_gap(events: DataFrame, seconds: float = 0.15) -> DataFrame:
    """Events that change the state, end the job, or come `seconds` after the one before."""
    w = Window.partitionBy("job").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) >= int(seconds * 1e6)
    keep = F.lag("state").over(w).isNull() | (F.col("state") != F.lag("state").over(w)) | F.col("state").isin(*TERMINAL) | gap
    return events.withColumn("keep", keep).where("keep").drop("keep")


def throttled(events: DataFrame, seconds: float = 0.15) -> DataFrame:
    """As `throttled_by_gap`, but the gap counts from the last event that was let through.

    Sorted partitions are streamed job by job; only the last event let through is held.
    """
    step = int(seconds * 1e6)

    def passed(batches: Iterator) -> Iterator:
        job = state = None
        at = 0
        for pdf in batches:
            keep = []
            for j, s, t in zip(pdf["job"], pdf["state"], pdf["_at"], strict=True):
                ok = j != job or s != state or s in TERMINAL or t - at >= step
                keep.append(ok)
                if ok:
                    at = t
                job, state = j, s
            yield pdf[keep].drop(columns="_at")

    spread = events.withColumn("_at", F.unix_micros("ts")).repartition("job").sortWithinPartitions("job", "ts", "event_id")
    return spread.mapInPandas(passed, events.schema)


def changed_lines(lines: DataFrame, order: list[str]) -> DataFrame:
    """Console lines without immediate repeats, job by job."""
    w = Window.partitionBy("job").orderBy(*order)
    return lines.withColumn("before", F.lag("line").over(w)).where("before is null or line != before").drop("before")


def by_ids(events: DataFrame, ids: list[str]) -> DataFrame:
    """The last event of a few jobs."""
    return current(events.where(F.col("job").isin(*ids)))


def created(events: DataFrame, job: str, repo_id: str, at, event_id: int) -> DataFrame:
    """The log with a job that is queued; one that is there begins anew."""
    spark = events.sparkSession
    row = spark.createDataFrame([(event_id, job, repo_id, at, "queued", 0, 0)], "event_id bigint, job string, repo_id string, ts timestamp, state string, current int, total int")
    return events.unionByName(row.select(*[F.col(c).cast(events.schema[c].dataType) for c in events.columns]))


def run(log, job: str, work) -> bool:
    """Runs `work(report)`; `log(job, state, message)` is told when it starts, what it reports, and whether it is done or has failed, with the error without secrets."""
    log(job, "running", "")
    try:
        work(lambda message: log(job, "running", message))
    except Exception as e:  # what goes wrong in a job is its result
        log(job, "error", scrubbed(f"{type(e).__name__}: {e}"))
        return False
    log(job, "done", "")
    return True


def scrubbed(message: str) -> str:
    """A message without passwords in addresses and values of keys."""
    message = re.sub(r"(://[^/\s:@]+:)[^@\s/]+@", r"\1***@", message)
    return re.sub(r"(?i)((?:key|secret|token|password|passwd)\s*[:=]\s*)\S+", r"\1***", message)
