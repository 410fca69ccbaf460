"""Syntax trees as flat rows keyed by node path; slices and text forms of them.

`Trees` keeps the trees of many files numbered by intervals: `pre` is a node's place in its tree's order, `last` that of
its last descendant, `depth` its level. Rows lie in folders by file, sorted by (path, pre), so a subtree is one range
of one folder, found by the files' statistics; no other file's tree is opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..extract.base import cst_rows
from ..storage import Buckets, Layer, cut

CST = "path string, node_path string, parent_path string, ord int, type string, start int, stop int, children int, text string"


def syntax_trees(files: DataFrame) -> DataFrame:
    """One row a node of every file's tree (path, content)."""

    def built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(path, *row) for row in cst_rows(bytes(content or b""))], columns=[c.split()[0] for c in CST.split(", ")])

    return files.select("path", "content").mapInPandas(built, CST)


def check_node_path(node_path: str) -> None:
    if len(node_path) > 200 or any(not p.isdigit() for p in node_path.split(".") if node_path):
        raise ValueError("not a node path")


def subtree(trees: DataFrame, path: str, node_path: str = "", depth: int = 4, most_children: int = 200, text: int = 200) -> DataFrame:
    """A slice of one file's tree: `depth` levels below a node, so many children each, with flags for what was cut."""
    depth, most_children, text = max(1, min(depth, 12)), max(1, min(most_children, 2000)), max(8, min(text, 500))
    check_node_path(node_path)
    level = F.when(F.col("node_path") == "", 0).otherwise(F.size(F.split("node_path", r"\.")))
    base = len(node_path.split(".")) if node_path else 0
    own = trees.where(F.col("path") == path).where((F.col("node_path") == node_path) | F.col("node_path").startswith(f"{node_path}." if node_path else ""))
    below = F.slice(F.split("node_path", r"\."), base + 1, 20)
    wide = F.exists(F.transform(below, lambda p: p.try_cast("int")), lambda i: i >= most_children)
    own = own.withColumn("level", level - base).where((F.col("level") <= depth) & (~wide | (F.col("level") == 0)))
    clean = F.substring(F.regexp_replace("text", r"[\x00-\x1f\x7f]", " "), 1, text)
    return own.select("node_path", "parent_path", "ord", "type", "start", "stop", "children", clean.alias("text"), ((F.col("level") == depth) & (F.col("children") > 0)).alias("truncated"), (F.col("children") > most_children).alias("children_capped"))


#: Rows of trees that a worker gathers, of many small files, before it hands them on.
ROWS_AT_ONCE = 4096
TREES = f"repo string, {CST}, pre int, last int, depth int, sha256 string"


def numbered(rows: list[tuple]) -> list[tuple]:
    """Rows of one tree in order, each with pre, last and depth."""
    last, depth, open_ = list(range(len(rows))), [0] * len(rows), []
    for i, row in enumerate(rows):
        level = row[0].count(".") + 1 if row[0] else 0
        del open_[level:]
        open_.append(i)
        depth[i] = level
        for j in open_:
            last[j] = i
    return [(*row, i, last[i], depth[i]) for i, row in enumerate(rows)]


def interval_trees(files: DataFrame) -> DataFrame:
    """TREES of files (repo, path, content, sha256)."""
    names = [c.split()[0] for c in TREES.split(", ")]

    def built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for pdf in batches:
            for repo, path, content, sha in zip(pdf["repo"], pdf["path"], pdf["content"], pdf["sha256"], strict=True):
                rows += [(repo, path, *row, sha) for row in numbered(cst_rows(bytes(content or b"")))]
                if len(rows) >= ROWS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return files.select("repo", "path", "content", "sha256").mapInPandas(built, TREES)


@dataclass(frozen=True)
class Trees:
    """Stored trees; those of files that have not changed are kept by `refreshed`."""

    table: Buckets | Layer

    @classmethod
    def write(cls, files: DataFrame, n: int = 32) -> Trees:
        return cls(Buckets.write(interval_trees(files), "path", "trees", n, ("pre",)))

    def refreshed(self, files: DataFrame) -> Trees:
        """The trees of `files` now: only those of new content are parsed, those of files that are gone are left out."""
        key = ["repo", "path"]
        held = self.table.rows.where("pre = 0").select(*key, "sha256")
        changed = files.join(held, [*key, "sha256"], "left_anti")
        touched = cut(changed.select(*key).unionByName(held.join(files.select(*key), key, "left_anti").select(*key)), "touched")
        return Trees(Layer(self.table, touched, cut(interval_trees(changed), "trees")))

    def slice(self, path: str, node_path: str = "", depth: int = 4, most_children: int = 200, text: int = 200, repo: str | None = None) -> DataFrame:
        """What `subtree` gives, as one range of the file's rows."""
        check_node_path(node_path)
        own = self.table.of([path])
        own = own.where(F.col("repo") == repo) if repo is not None else own
        root = own.where(F.col("node_path") == node_path).select("pre", "last").first() if node_path else (0, None)
        if root is None:
            return subtree(own.limit(0), path, node_path, depth, most_children, text)
        level = node_path.count(".") + 1 if node_path else 0
        ranged = own.where((F.col("pre") >= root[0]) & (F.col("depth") <= level + max(1, min(depth, 12))))
        return subtree(ranged.where(F.col("pre") <= root[1]) if node_path else ranged, path, node_path, depth, most_children, text)


def problems(trees: DataFrame) -> DataFrame:
    """repo, path, errors and missing of the trees that have any."""
    counted = trees.groupBy("repo", "path").agg(F.count_if(F.col("type") == "ERROR").alias("errors"), F.count_if(F.col("type").startswith("MISSING")).alias("missing"))
    return counted.where("errors + missing > 0")


def sexp(rows: list[tuple], limit: int = 4000) -> str:
    """The tree of `cst_rows` as nested lists of types."""
    out: list[str] = []
    depth = -1
    for row in rows:
        level = len(row[0].split(".")) if row[0] else 0
        out.append(")" * (depth - level + 1) if level <= depth else "")
        out.append((" (" if level else "(") + row[3].replace(" ", ""))
        depth = level
    return ("".join(out) + ")" * (depth + 1))[:limit]
