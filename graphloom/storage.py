"""Tables in the folder that the cluster shares: lineage cuts that outlive lost executors, and snapshots."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: The shuffle files of a plan that runs once are not needed after it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: `spark.checkpoint.dir`; where it is unset, one of our own in a single process, and on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """Where this application's tables stand."""
    return f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path for a new table, which is removed when the driver's JVM ends."""
    _at(spark, session_dir(spark), lambda fs, path: fs.deleteOnExit(path))
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Removes all tables that this application has cut; results that still read them are lost."""
    remove(spark, session_dir(spark))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` once to the shared folder and reads it back; `drop` removes the table."""
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def _at(spark: SparkSession, path: str, do: Callable) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    do(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)


def changed_at(spark: SparkSession, path: str) -> int:
    """When a file or folder was last changed, in milliseconds."""
    out: list[int] = []
    _at(spark, path, lambda fs, at: out.append(fs.getFileStatus(at).getModificationTime()))
    return out[0]


def exists(spark: SparkSession, path: str) -> bool:
    out: list[bool] = []
    _at(spark, path, lambda fs, at: out.append(fs.exists(at)))
    return out[0]


def remove(spark: SparkSession, path: str) -> None:
    _at(spark, path, lambda fs, at: fs.delete(at, True))


def drop(df: DataFrame) -> None:
    """Removes the table that `cut` wrote for `df`; a frame that has none is left alone."""
    if path := getattr(df, "_graphloom_path", None):
        remove(df.sparkSession, path)


@dataclass(frozen=True)
class Buckets:
    """A table in `n` folders by a hash of its key (a string), sorted by it: rows of some keys are read from the folders of those keys alone.

    A folder has as many files as its rows need, so a key of many rows is written by several tasks. `n` is for the
    writer to choose: about one folder for each 64 MB.
    """

    spark: SparkSession
    path: str
    schema: object
    key: str
    n: int
    #: Folders that have rows.
    held: frozenset[int]

    @classmethod
    def write(cls, df: DataFrame, key: str, name: str, n: int = 32, then: tuple[str, ...] = ()) -> Buckets:
        """Writes `df`, sorted by `key` and `then` in each file."""
        spark = df.sparkSession
        path = fresh_path(spark, name)
        own = df.withColumn("_bucket", cls.bucket(F.col(key), n)).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", key, *then)
        own.write.partitionBy("_bucket").parquet(path)
        held: list[int] = []
        _at(spark, path, lambda fs, at: held.extend(int(f.getPath().getName()[8:]) for f in fs.listStatus(at) if f.getPath().getName().startswith("_bucket=") and f.getPath().getName()[8:].isdigit()))
        return cls(spark, path, df.schema, key, n, frozenset(held))

    @staticmethod
    def bucket(key: Column, n: int) -> Column:
        return F.pmod(F.crc32(F.coalesce(key, F.lit("")).cast("binary")), F.lit(n)).cast("int")

    def folders(self, buckets: set[int]) -> DataFrame:
        """The rows of some folders; no other is listed or opened."""
        own = sorted(buckets & self.held)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/_bucket={b}" for b in own]) if own else self.spark.createDataFrame([], self.schema)

    @property
    def rows(self) -> DataFrame:
        """The whole table."""
        return self.folders(set(self.held))

    def of(self, keys: list[str]) -> DataFrame:
        """The rows of a few keys: folders are chosen here, and the keys are pushed down to the files' statistics."""
        return self.folders({zlib.crc32(k.encode()) % self.n for k in keys}).where(F.col(self.key).isin(*keys))

    def matching(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is among `keys` (one column), of any number; the driver sees bucket numbers only, at most `n`."""
        own = keys.select(F.col(keys.columns[0]).alias(self.key)).distinct()
        found = {r[0] for r in own.select(self.bucket(F.col(self.key), self.n)).distinct().collect()}
        return self.folders(found).join(own, self.key, "left_semi").select(*self.schema.names)

    def drop(self) -> None:
        remove(self.spark, self.path)


@dataclass(frozen=True)
class Layer:
    """A table over buckets or another layer: the rows of some files replaced. Reads merge; nothing is rewritten."""

    below: Buckets | Layer
    files: DataFrame
    fresh: DataFrame

    def _over(self, rows: DataFrame, fresh: DataFrame) -> DataFrame:
        return replaced(rows, self.files, fresh)

    @property
    def rows(self) -> DataFrame:
        return self._over(self.below.rows, self.fresh)

    def matching(self, keys: DataFrame) -> DataFrame:
        own = keys.select(F.col(keys.columns[0]).alias(self.key)).distinct()
        return self._over(self.below.matching(keys), self.fresh.join(own, self.key, "left_semi"))

    def of(self, keys: list[str]) -> DataFrame:
        return self._over(self.below.of(keys), self.fresh.where(F.col(self.key).isin(*keys)))

    @property
    def key(self) -> str:
        return self.below.key


def replaced(rows: DataFrame, files: DataFrame, fresh: DataFrame, path: str = "path") -> DataFrame:
    """`rows` without those of `files` (repo, path), and with the fresh ones."""
    gone = files.select("repo", F.col("path").alias(path))
    return rows.join(gone, ["repo", path], "left_anti").select(*rows.columns).unionByName(fresh.select(*rows.columns))


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a frame whose size Spark knows."""
    fields = [part.split() for part in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)}))


def dealt(*key: str) -> Column:
    """A join key that is dealt out anew although one side is already summed by `key`.

    Spark splits a skewed key of a join only where both sides come straight from a shuffle; a side that was summed by
    the same key is joined in the task that summed it, unsplit. The key as a struct asks for a shuffle of its own,
    which carries one row a key.
    """
    return F.struct(*key)


def overwrite(df: DataFrame, path: str, *by: str) -> None:
    """Replaces a table, or with `by` only the partitions that `df` has."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of both; where the key is the same, the new one."""
    return new.unionByName(old.join(new.select(*key), list(key), "left_anti"))


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, by a total order of columns."""
    last = events.groupBy(key).agg(F.max_by(F.struct(*events.columns), F.struct(*order)).alias("last"))
    return last.select("last.*")


def point_update(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`old` with `columns` taken from `new` where it has the key."""
    own = new.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = old.join(own, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def numbered(df: DataFrame, order: list, column: str, start: int = 0) -> DataFrame:
    """Numbers the rows of a small table in a total order."""
    return df.withColumn(column, F.row_number().over(Window.orderBy(*order)) - 1 + start)


def placed(df: DataFrame, order: list, column: str) -> DataFrame:
    """Numbers the rows of a large table from 0 in a total order; the sort is by ranges, and the driver sees one count for each of them."""
    low = 33  # bits of a row's place in its partition
    own = cut(df.orderBy(*order).withColumn(column, F.monotonically_increasing_id()), "placed")
    counts = sorted(tuple(r) for r in own.groupBy(F.shiftright(column, low).cast("bigint").alias("p")).agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for p, n in counts:
        rows.append((p, before))
        before += n
    offsets = small(df.sparkSession, rows, "_p bigint, _before bigint")
    place = F.col("_before") + F.col(column).bitwiseAND(F.lit((1 << low) - 1))
    return own.join(offsets, F.shiftright(column, low).cast("bigint") == F.col("_p")).select(*df.columns, place.alias(column))
