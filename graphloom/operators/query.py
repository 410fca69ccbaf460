"""Queries over a graph's tables: filters, search, symbol cards, roll-ups, counts and scans of text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import markers
from ..storage import cut
from .traverse import Stored, induced


def like_pattern(needle: str) -> str:
    """An ILIKE pattern in which % and _ stay wildcards and a backslash is itself."""
    return "%" + needle.replace("\\", "\\\\") + "%"


def search_hit(pattern: str):
    """Whether a node's name, qualified name or file is like a pattern, in any case."""
    return F.col("name").ilike(pattern) | F.col("qualified").ilike(pattern) | F.coalesce(F.col("file").ilike(pattern), F.lit(False))


def search(nodes: DataFrame, degree: DataFrame, needle: str, kinds=None, limit: int = 50) -> DataFrame:
    """Nodes whose name, qualified name or file holds the needle; nothing for a blank one."""
    own = nodes.where(search_hit(like_pattern(needle.strip())) & ~F.col("kind").isin("repo", "dir", "community") & F.lit(bool(needle.strip())))
    if kinds:
        own = own.where(F.col("kind").isin(*kinds))
    return own.join(degree.select("id", "degree"), "id").orderBy(F.desc("degree"), "qualified", "id").limit(limit)


def iter_nodes(nodes: DataFrame, degree: DataFrame, kinds=None, by_degree: bool = True, limit: int | None = None, offset: int = 0) -> DataFrame:
    own = nodes.join(degree.select("id", "degree"), "id")
    if kinds:
        own = own.where(F.col("kind").isin(*kinds))
    own = own.orderBy(F.desc("degree"), "id") if by_degree else own.orderBy("id")
    own = own.offset(offset) if offset else own
    return own.limit(limit) if limit is not None else own


def iter_edges(edges: DataFrame, relations=None, confidences=None, ids: DataFrame | None = None) -> DataFrame:
    """Edges of these relations and confidences (any case; empty means all), both ends among `ids` if given."""
    own = edges
    if relations:
        own = own.where(F.lower("relation").isin(*[r.lower() for r in relations]))
    if confidences:
        own = own.where(F.upper("confidence").isin(*[c.upper() for c in confidences]))
    return induced(own, ids) if ids is not None else own


def full_graph(nodes: DataFrame, edges: DataFrame, degree: DataFrame, kinds=None, relations=None, confidences=None, community=None, limit: int = 1500, most_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The `limit` nodes of highest degree and the edges among them."""
    if community is not None:
        nodes = nodes.where(F.col("community") == community)
    # Written once: it stands on both sides of the edges, and its size is then known to the joins.
    top = cut(iter_nodes(nodes, degree, kinds, True, limit), "top")
    shown = iter_edges(edges, relations, confidences, top)
    return top, shown.orderBy("src", "dst", "relation", "seq").limit(most_edges) if most_edges else shown


def symbol_card(nodes: DataFrame, edges: DataFrame | Stored, node: str, most: int = 500) -> DataFrame:
    """side (incoming or outgoing), other, other_name, relation and confidence of a node's edges; a loop is on both sides."""
    names = nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    into, out = edges.touching(node) if isinstance(edges, Stored) else (edges.where(F.col("dst") == node), edges.where(F.col("src") == node))
    sides = []
    for side, own, other in (("incoming", into, "src"), ("outgoing", out, "dst")):
        part = own.select(F.lit(side).alias("side"), F.col(other).alias("other"), "relation", "confidence", "seq")
        sides.append(part.orderBy("other", "relation", "seq", "confidence").limit(most))
    both = sides[0].unionByName(sides[1]).join(names, "other", "left")
    return both.select("side", "other", F.coalesce("other_name", "other").alias("other_name"), "relation", "confidence")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and files."""
    return nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "file").alias("files")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


def tree_rollup(files: DataFrame, measures: list[str], path: str = "path", root: str = "") -> DataFrame:
    """dir, depth, files and the sums of measures over everything below each directory (the root is ''), in one pass."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    spread = files.select(F.explode(above).alias("dir"), *measures)
    out = spread.groupBy("dir").agg(F.count("*").alias("files"), *[F.sum(m).alias(m) for m in measures])
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    out = out.withColumn("depth", depth)
    return out.where((F.col("dir") == root) | F.col("dir").startswith(root + "/")) if root else out


def language_stats(files: DataFrame) -> DataFrame:
    """language, files and loc, most lines first."""
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc")).orderBy(F.desc("loc"), F.desc("files"), "language")


def file_aggregates(files: DataFrame) -> DataFrame:
    """One row: files, lines, nodes of syntax trees, and files with errors or that failed."""
    return files.agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum("node_count").alias("nodes"), F.count_if((F.col("error_count") + F.col("missing_count")) > 0).alias("with_errors"), F.count_if(~F.col("parse_ok")).alias("failed"))


def symbols_per_file(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("kind").isin("repo", "dir", "file", "external", "community") & F.col("file").isNotNull()).groupBy("file").agg(F.count("*").alias("symbols"))


def files_page(files: DataFrame, needle: str = "", limit: int = 100, offset: int = 0, path: str = "path") -> DataFrame:
    """A page of the files whose path holds the needle, in path order."""
    own = files.where(F.col(path).ilike(like_pattern(needle))) if needle else files
    return own.orderBy(path).offset(max(offset, 0)).limit(max(limit, 1))


def dead_code(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Functions and methods with a file that nothing calls or instantiates."""
    used = edges.where(F.col("relation").isin("calls", "instantiates")).select(F.col("dst").alias("id")).distinct()
    own = nodes.where(F.col("kind").isin("function", "method") & F.col("file").isNotNull()).join(used, "id", "left_anti")
    return own.orderBy("id").limit(limit) if limit else own


def marker_scan(texts: DataFrame, key: str, words=("TODO", "FIXME", "XXX", "HACK", "NOTE"), largest: int | None = None, k: int = 10) -> DataFrame:
    """The `k` texts with most markers: key, n and up to two samples. With `largest`, texts of more bytes are left out."""
    found = markers(F.col("text"), words)
    own = texts if largest is None else texts.where(F.octet_length("text") <= largest)
    own = own.select(key, found.alias("found")).where(F.size("found") > 0)
    return own.select(key, F.size("found").alias("n"), F.slice("found", 1, 2).alias("samples")).orderBy(F.desc("n"), key).limit(k)


def stale_files(indexed: DataFrame, now: DataFrame) -> DataFrame:
    """Paths whose content differs from what was indexed, or that are gone; same-size edits too."""
    own = indexed.select("path", F.col("sha256").alias("then")).join(now.select("path", "sha256"), "path", "left")
    return own.where(F.col("sha256").isNull() | (F.col("sha256") != F.col("then"))).select("path")


def name_index(nodes: DataFrame) -> DataFrame:
    """A word index over names: word and id."""
    words = F.split(F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+")
    return nodes.where(~F.col("kind").isin("repo", "dir", "file", "external", "community")).select(F.explode(F.array_distinct(F.transform(words, F.lower))).alias("word"), "id").where("word != ''")


def word_search(index: DataFrame, needle: str, limit: int = 50) -> DataFrame:
    """Ids whose names hold all words of the needle, in id order; `index` is what `name_index` gives."""
    words = sorted({w for w in re.split(r"[^a-z0-9]+", needle.lower()) if w})
    hit = index.where(F.col("word").isin(*words)).groupBy("id").agg(F.count_distinct("word").alias("n"))
    return hit.where(F.col("n") == len(words)).select("id").orderBy("id").limit(limit)


def nodes_by_ids(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """The nodes of a few ids; those that are not there are left out."""
    return nodes.where(F.col("id").isin(*ids))


def get_file(nodes: DataFrame, path: str) -> DataFrame:
    """The node of a file, if there is one."""
    return nodes.where((F.col("kind") == "file") & (F.col("qualified") == path))


#: What a reader of nodes and edges is shown.
NODE_BRIEF = ("id", "kind", "name", "qualified", "file", "sl", "el", "language", "doc", "community", "degree")
EDGE_BRIEF = ("src", "dst", "relation", "confidence", "file", "sl")


def node_briefs(nodes: DataFrame, degree: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Nodes with degree and community, as far as they have these columns."""
    own = nodes.join(degree.select("id", "degree"), "id", "left")
    own = own.join(members.select("id", "community"), "id", "left") if members is not None else own
    return own.select(*[c for c in NODE_BRIEF if c in own.columns])


def edge_briefs(edges: DataFrame) -> DataFrame:
    return edges.select(*[c for c in EDGE_BRIEF if c in edges.columns])


def community_list(members: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """community, size and, where they are given, names; largest first."""
    sizes = members.groupBy("community").agg(F.count("*").alias("size"))
    sizes = sizes.join(names, "community", "left") if names is not None else sizes
    return sizes.orderBy(F.desc("size"), "community")


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, value and n: nodes by kind, edges by relation and confidence, and how many there are of all; one pass over each table."""
    by = lambda what, column: F.struct(F.lit(what).alias("what"), column.alias("value"))
    none, files = F.lit(None).cast("string"), F.when(F.col("kind") == "file", F.lit("files"))
    own = nodes.select(F.explode(F.array(by("kind", F.col("kind")), by("nodes", none), F.struct(F.coalesce(files, F.lit("")).alias("what"), none.alias("value")))).alias("x"))
    own = own.unionByName(edges.select(F.explode(F.array(by("relation", F.col("relation")), by("confidence", F.col("confidence")), by("edges", none))).alias("x")))
    return own.where("x.what != ''").groupBy("x.what", "x.value").agg(F.count("*").alias("n"))


def layered_rank(groups: DataFrame, layer: str, weight: str) -> DataFrame:
    """Groups with `place`, the dense rank of their weight in their layer; equal weights share a place."""
    return groups.withColumn("place", F.dense_rank().over(Window.partitionBy(layer).orderBy(F.desc(weight))))


def treemap_weights(files: DataFrame) -> DataFrame:
    """The roll-up of files (path, loc) by directory with `area`: a file weighs its lines, one at least."""
    return tree_rollup(files.withColumn("area", F.greatest(F.col("loc"), F.lit(1))), ["area"])


def focus_options(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """id, name and source of what may be focused on: of several sources (name, frame of id and name) the first that has an id gives it."""
    out = None
    for rank, (name, df) in enumerate(sources):
        own = df.select("id", "name", F.lit(name).alias("source"), F.lit(rank).alias("rank"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("id").agg(F.min_by(F.struct("name", "source"), "rank").alias("first")).select("id", "first.*")
