"""Graph construction: directories, file and symbol nodes, edges, deduplication, degrees and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import file_of_node, is_test_path, node_id, symbol_id
from ..schema import EDGES

EDGE_COLUMNS = tuple(c.split()[0] for c in EDGES.split(", "))
#: A stage's edges have their `seq` below this power of two.
STAGE_BITS = 59
NODE_COLUMNS = ("repo", "id", "kind", "name", "qualified", "file", "sl", "sc", "el", "ec", "language", "doc")


def directories(paths: DataFrame, column: str = "path", *keep: str) -> DataFrame:
    """All directories above the files: dir, beside the columns to keep."""
    parts = F.split(column, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    return paths.select(*keep, F.explode(above).alias("dir")).distinct()


def parent_dir(path):
    """The directory that holds a path; empty at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def nowhere() -> list:
    """The place of an edge that stands nowhere in a file."""
    return [F.lit(None).cast("bigint").alias(c) for c in ("sl", "sc", "el", "ec")]


def _nodes(df: DataFrame, **columns) -> DataFrame:
    ints = {"sl", "sc", "el", "ec"}
    return df.select(*[columns[c].cast("int" if c in ints else "string").alias(c) if c in columns else F.lit(None).cast("int" if c in ints else "string").alias(c) for c in NODE_COLUMNS])


def structure(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and contains edges of the repositories, their directories and files (repo, path, language)."""
    dirs, repo = directories(files, "path", "repo"), F.col("repo")
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    nodes = _nodes(files.select("repo").distinct(), repo=repo, id=node_id("repo", repo), kind=F.lit("repo"), name=repo, qualified=repo)
    nodes = nodes.unionByName(_nodes(dirs, repo=repo, id=node_id("dir", F.col("dir")), kind=F.lit("dir"), name=last("dir"), qualified=F.col("dir")))
    nodes = nodes.unionByName(_nodes(files, repo=repo, id=node_id("file", F.col("path")), kind=F.lit("file"), name=last("path"), qualified=F.col("path"), file=F.col("path"), language=F.col("language")))
    over = lambda c: F.when(parent_dir(F.col(c)) == "", node_id("repo", repo)).otherwise(node_id("dir", parent_dir(F.col(c))))
    edges = files.select("repo", over("path").alias("src"), node_id("file", F.col("path")).alias("dst")).unionByName(dirs.select("repo", over("dir").alias("src"), node_id("dir", F.col("dir")).alias("dst")))
    return nodes, edges.select("repo", "src", "dst", F.lit("contains").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(None).cast("string").alias("file"), *nowhere())


def symbols(extractions: DataFrame) -> DataFrame:
    """One row a symbol: repo, path, language, seq (its place in the file) and the symbol's fields, with its node id."""
    one = extractions.select("repo", "path", "language", F.posexplode("symbols").alias("seq", "s")).select("repo", "path", "language", "seq", "s.*")
    return one.withColumn("id", symbol_id(F.col("language"), F.col("path"), F.col("qualified"), F.col("kind"), F.col("ordinal")))


def symbol_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbol nodes, and the edges by which files define them or symbols contain them."""
    nodes = _nodes(found, repo=F.col("repo"), id=F.col("id"), kind=F.col("kind"), name=F.col("name"), qualified=F.col("qualified"), file=F.col("path"), sl=F.col("start.row"), sc=F.col("start.col"), el=F.col("end.row"), ec=F.col("end.col"), language=F.col("language"), doc=F.col("doc"))
    holders = found.groupBy("repo", "path", F.col("qualified").alias("parent")).agg(F.max_by("id", "seq").alias("holder"))
    tied = found.join(holders, ["repo", "path", "parent"], "left")
    edges = tied.select(
        "repo", F.coalesce("holder", node_id("file", F.col("path"))).alias("src"), F.col("id").alias("dst"), F.when(F.col("holder").isNull(), "defines").otherwise("contains").alias("relation"),
        F.lit("EXTRACTED").alias("confidence"), F.col("path").alias("file"), *[F.col(f"{end}.{part}").cast("bigint").alias(f"{end[0]}{part[0].replace('r', 'l')}") for end in ("start", "end") for part in ("row", "col")],
    )
    return nodes, edges


def external_nodes(ids: DataFrame) -> DataFrame:
    """Nodes of names outside the repository, from edges' ends (repo, id)."""
    ext = ids.where(F.col("id").startswith("ext:")).select("repo", "id").distinct()
    name = F.substring("id", 5, 1 << 20)
    return _nodes(ext, repo=F.col("repo"), id=F.col("id"), kind=F.lit("external"), name=name, qualified=name)


def test_edges(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """tests edges: from test files to the indexed files that their references (not imports) reach."""
    from_tests = resolved.where((F.col("relation") != "imports") & is_test_path(F.col("file")) & ~F.col("dst").startswith("ext:"))
    pairs = from_tests.select("repo", F.col("file"), file_of_node(F.col("dst")).alias("path")).where("file != path").distinct()
    known = pairs.join(files.select("repo", "path"), ["repo", "path"], "left_semi")
    return known.select("repo", node_id("file", F.col("file")).alias("src"), node_id("file", F.col("path")).alias("dst"), F.lit("tests").alias("relation"), F.lit("INFERRED").alias("confidence"), F.col("file"), *nowhere())


def dedup_edges(edges: DataFrame, *order: str) -> DataFrame:
    """The first edge, by `order`, of each (src, dst, relation, file, place); partial sums, so repeated edges do not skew."""
    keys = [F.col(k) for k in ("repo", "src", "dst", "relation") if k in edges.columns] + [F.coalesce(F.col(k), F.lit(d)).alias(f"_{k}") for k, d in (("file", ""), ("sl", -1), ("sc", -1)) if k in edges.columns]
    rows = F.struct(*edges.columns)
    return edges.groupBy(*keys).agg(F.min_by(rows, F.struct(*order)).alias("first")).select("first.*")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree and degree of every node; parallel edges count, a loop counts twice."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = F.lit(0).cast("bigint")
    counted = nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))
    return counted.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def group_counts(df: DataFrame, column: str) -> DataFrame:
    """value and n, by kind, relation or confidence."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def build_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, value and n of all counts, directories and top directories."""
    out = None
    for what, df, column in (("kind", nodes, "kind"), ("relation", edges, "relation"), ("confidence", edges, "confidence")):
        part = group_counts(df, column).select(F.lit(what).alias("what"), "value", "n")
        out = part if out is None else out.unionByName(part)
    dirs = nodes.where("kind = 'dir'")
    top = dirs.where(~F.col("qualified").contains("/"))
    for what, df in (("directories", dirs), ("top_directories", top)):
        out = out.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.lit(None).cast("string").alias("value"), "n"))
    return out


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("id")
    return edges.join(ids, edges["src"] == ids["id"], "left_anti").unionByName(edges.join(ids, edges["dst"] == ids["id"], "left_anti")).distinct()


def sequenced(edges: DataFrame) -> DataFrame:
    """Edges in EDGES form; seq is their order by stage, file, place and place in the extraction (`stage` and `at`), whatever the partitioning.

    Ids grow with the sort order but have gaps; the sort is by ranges, so no task sees all edges.
    """
    order = ["repo", "stage", F.coalesce("file", F.lit("")), F.coalesce("sl", F.lit(-1)), F.coalesce("sc", F.lit(-1)), F.coalesce("at", F.lit(-1)), "relation", "src", "dst"]
    return edges.orderBy(*order).withColumn("seq", F.monotonically_increasing_id()).select(*EDGE_COLUMNS)


def in_stage(edges: DataFrame, stage: int) -> DataFrame:
    """Edges of one stage of a run (with `seq`, their order in it) in EDGES form; `seq` is moved behind the stages before."""
    return edges.withColumn("seq", F.col("seq") + F.lit(stage << STAGE_BITS)).select(*EDGE_COLUMNS)


def staged(*parts: DataFrame) -> DataFrame:
    """The edges of all stages of a run, in the order of `parts`, with `stage` and `at`."""
    out = None
    for i, part in enumerate(parts):
        own = part if "at" in part.columns else part.withColumn("at", F.lit(None).cast("int"))
        own = own.withColumn("stage", F.lit(i))
        out = own if out is None else out.unionByName(own)
    return out
