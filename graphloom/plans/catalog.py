"""Indexes kept in a folder that Spark reads and writes: saved, listed, opened, removed; and their metadata."""

from __future__ import annotations

import datetime as dt
import json
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import overwrite, remove, upsert
from .engine import Index

TABLES = ("nodes", "edges", "files", "skipped", "extractions", "references", "members", "stats")
META = "repo_id string, name string, indexed_at string, files bigint, nodes bigint, edges bigint, info string"


class Catalog:
    """One folder: a table of metadata and a folder of tables for each repository."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, repo_id: str, table: str = "") -> str:
        if not re.fullmatch(r"[A-Za-z0-9._@-]{1,200}", repo_id) or repo_id in (".", ".."):
            raise ValueError(f"not a repository id: {repo_id}")
        return f"{self.root}/repos/{repo_id}/{table}".rstrip("/")

    def _meta(self) -> DataFrame:
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/meta")
        if not fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
            return self.spark.createDataFrame([], META)
        return self.spark.read.schema(META).option("recursiveFileLookup", True).parquet(f"{self.root}/meta")

    def save(self, index: Index, repo_id: str, info: dict | None = None, at: dt.datetime | None = None) -> None:
        for table in TABLES:
            overwrite(getattr(index, table), self._path(repo_id, table))
        stamp = (at or dt.datetime.now(dt.timezone.utc)).isoformat()
        row = self.spark.createDataFrame([(repo_id, index.repo, stamp, index.files.count(), index.nodes.count(), index.edges.count(), json.dumps(info or {}))], META)
        # One small file a repository, so that saving one does not touch the others.
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/meta/{repo_id}")

    def repositories(self) -> DataFrame:
        """What is kept, last indexed first."""
        return self._meta().orderBy(F.desc("indexed_at"), "repo_id")

    def default(self, repo_id: str | None = None) -> str:
        """The repository asked for, or the last indexed; KeyError if there is none."""
        own = self.repositories()
        found = (own.where(F.col("repo_id") == repo_id) if repo_id else own).first()
        if found is None:
            raise KeyError(repo_id or "nothing is indexed")
        return found["repo_id"]

    def table(self, repo_id: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(repo_id, name))

    def info(self, repo_id: str) -> dict:
        """The metadata of one repository; what is no JSON comes back as it is."""
        row = self._meta().where(F.col("repo_id") == repo_id).first()
        if row is None:
            raise KeyError(repo_id)
        out = row.asDict()
        try:
            out["info"] = json.loads(out["info"])
        except ValueError:
            pass
        return out

    def delete(self, repo_id: str) -> None:
        """Removes the tables of a repository; source trees are never touched."""
        remove(self.spark, self._path(repo_id))
        remove(self.spark, f"{self.root}/meta/{repo_id}")


def merged_names(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache of community names with new ones taken in."""
    return upsert(cache, fresh, "content_hash")


def analysis_payload(index: Index, k: int = 5) -> DataFrame:
    """`community_payload` of an index."""
    return community_payload(index.nodes, index.edges, index.members, index.degrees, k)


def community_payload(nodes: DataFrame, edges: DataFrame, members: DataFrame, degree: DataFrame, k: int = 5) -> DataFrame:
    """One row a community: size, cohesion, name, hash and its `k` symbols of highest degree; one window, no query for each."""
    from ..operators import analyze

    tops = analyze.top_symbols(members, degree, k).join(nodes.select("id", "name", "kind", "file"), "id")
    tops = tops.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("place", "id", "name", "kind", "file"))).alias("top_symbols"))
    out = analyze.cohesion(members, analyze.symbol_subgraph(nodes, edges))
    for more in (analyze.heuristic_names(members, nodes, degree), analyze.content_hash(members), tops):
        out = out.join(more, "community", "left")
    return out
