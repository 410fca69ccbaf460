"""Incremental runs: which files to extract anew, which extractions to keep, and which to drop; and what else a change reaches.

A changed file reaches others by names and by paths. `changed_names` are the names whose symbols in some changed file
are not what they were: any reference to such a name, in whatever file, may now mean something else. `moved` paths
came or went: any import whose words include theirs may now mean another file. Files that have such references or
imports, with the changed files themselves, are resolved anew (`reached`); edges and nodes of all others stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import imports
from ..operators.build import symbols
from ..storage import Buckets, Layer


def version(files: DataFrame) -> list[str]:
    """What tells a version of a file."""
    return [*place(files), "sha256"]


def place(files: DataFrame) -> list[str]:
    return [c for c in ("repo", "path") if c in files.columns]


def reused(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose cached extraction is of the same content."""
    return files.join(cached.select(*version(files)), version(files), "left_semi")


def changed(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files that are new or have changed."""
    return files.join(cached.select(*version(files)), version(files), "left_anti")


def stale(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Cached extractions of files that are gone."""
    return cached.join(files.select(*place(files)), place(files), "left_anti")


def refreshed(files: DataFrame, cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache after a run: fresh extractions, and those reused, whose counts are kept."""
    kept = cached.join(files.select(*version(files)), version(files), "left_semi")
    return fresh.unionByName(kept.select(*fresh.columns))


def summary(files: DataFrame, skipped: DataFrame) -> DataFrame:
    """Counts of files and of the five commonest reasons for skipping: what, n."""
    kept = files.agg(F.count("*").alias("n")).select(F.lit("files").alias("what"), "n")
    return kept.unionByName(skipped.groupBy(F.col("reason").alias("what")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "what").limit(5))


def changed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """repo and name: what the changed files' extractions define in another way than before."""
    counted = symbols(before).select("repo", "path", "name", "id", F.lit(-1).alias("n")).unionByName(symbols(after).select("repo", "path", "name", "id", F.lit(1).alias("n")))
    return counted.groupBy("repo", "path", "name", "id").agg(F.sum("n").alias("n")).where("n != 0").select("repo", "name").distinct()


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """repo and path of files that can be imported now and could not before, or the other way round."""
    key = ["repo", "path"]
    old, new = before.select(*key), after.select(*key)
    return old.join(new, key, "left_anti").unionByName(new.join(old, key, "left_anti"))


def reached(names: DataFrame, referring: Buckets | Layer, paths: DataFrame, import_rows: DataFrame | None) -> DataFrame:
    """repo and path of files that refer to one of `names`, or (if imports are given) have one that `paths` may change."""
    by_name = referring.matching(names.select("name")).select("repo", "path", "name").join(names, ["repo", "name"], "left_semi").select("repo", "path")
    if import_rows is None:
        return by_name.distinct()
    by_path = imports.hints(import_rows).join(imports.path_hints(paths), ["repo", "word"], "left_semi").select("repo", "path")
    return by_name.unionByName(by_path).distinct()
