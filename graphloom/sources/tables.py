"""A property graph made of relational tables: regions, nations, customers, suppliers and parts, tied by order lines."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.build import degrees
from ..operators.grams import Grams
from ..operators.traverse import Stored
from ..storage import changed_at, cut, exists


@dataclass
class Graph:
    """Nodes and edges of one graph."""

    nodes: DataFrame
    edges: DataFrame


class StoredGraph(Graph):
    """A graph and what is asked of it again and again: each part is written once, when it is first needed.

    A query that scans nodes or edges reads the tables, of which Spark leaves out what it does not ask for; only walks
    need the edges in folders, and then those of their direction.
    """

    def __init__(self, graph: Graph, n: int = 32):
        self.nodes, self.walks = graph.nodes, Stored(graph.edges, n)

    @property
    def edges(self) -> DataFrame:
        return self.walks.edges

    @property
    def stands(self) -> bool:
        """Whether all that was written is still there."""
        paths = [side.path for side in self.walks.written]
        if (degrees := vars(self).get("degrees")) is not None:
            paths.append(degrees._graphloom_path)
        if (grams := vars(self).get("grams")) is not None:
            paths += [part.path for part in grams.parts]
        return all(exists(self.nodes.sparkSession, path) for path in paths)

    @cached_property
    def degrees(self) -> DataFrame:
        return cut(degrees(self.nodes, self.edges), "degrees")

    @cached_property
    def grams(self) -> Grams:
        return Grams.write(self.nodes, self.degrees)


#: Graphs of this process's applications, by the tables they were made of.
_STORED: dict[tuple, StoredGraph] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def stored_graph(spark: SparkSession, sf_dir: str) -> StoredGraph:
    """`table_graph`, whose parts are written to the shared folder once an application as long as the tables do not change."""
    key = (spark.sparkContext.applicationId, sf_dir, *(changed_at(spark, f"{sf_dir}/{t}.parquet") for t in TABLES))
    if key not in _STORED or not _STORED[key].stands:
        _STORED[key] = StoredGraph(table_graph(spark, sf_dir))
    return _STORED[key]


def _node(df: DataFrame, id_, kind: str, name, qualified, file=None, language=None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), qualified.alias("qualified"), (none if file is None else file).alias("file"), (none if language is None else language).alias("language"))


def _edge(df: DataFrame, src, dst, relation: str, confidence, seq, sl, sc) -> DataFrame:
    return df.select(seq.cast("bigint").alias("seq"), src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), confidence.alias("confidence"), sl.cast("bigint").alias("sl"), sc.cast("bigint").alias("sc"))


def table_graph(spark: SparkSession, sf_dir: str, top_imports: int = 2) -> Graph:
    """The graph of the tables in `sf_dir`.

    Customers call the suppliers of their order lines, suppliers instantiate the parts, and a nation of suppliers
    imports the `top_imports` nations of customers that it has most lines with. Region and nation are small fixed
    dimensions and are broadcast by Spark's own size check.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    region, nation = read("region"), read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat_ws("/", "r_name", "n_name")
    customer = read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    cid, sid, pid = (F.concat(F.lit(f"{k}:"), F.col(c).cast("string")) for k, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey")))
    root, dir_, file_ = F.lit("repo:tpch"), F.concat(F.lit("dir:"), "r_name"), F.concat(F.lit("file:"), path)
    one = spark.range(1)
    nodes = _node(one, root, "repo", F.lit("tpch"), F.lit("tpch"))
    for more in (
        _node(region, dir_, "dir", F.col("r_name"), F.col("r_name")),
        _node(nation, file_, "file", F.col("n_name"), path, path),
        _node(customer, cid, "class", F.col("c_name"), F.col("c_name"), path, F.col("c_mktsegment")),
        _node(supplier, sid, "function", F.col("s_name"), F.col("s_name"), path),
        _node(read("part"), pid, "method", F.col("p_name"), F.col("p_name"), None, F.col("p_brand")),
    ):
        nodes = nodes.unionByName(more)
    extracted, zero = F.lit("EXTRACTED"), F.lit(0)
    lines = read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    sold = lines.join(read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    flag = F.when(F.col("l_returnflag") == "R", "EXTRACTED").when(F.col("l_returnflag") == "N", "INFERRED").otherwise("AMBIGUOUS")
    line_cid, line_sid, line_pid = (F.concat(F.lit(f"{k}:"), F.col(c).cast("string")) for k, c in (("customer", "o_custkey"), ("supplier", "l_suppkey"), ("part", "l_partkey")))
    # Nations are looked up before lines are summed: there are few pairs of them, while nearly every line has a customer and supplier of its own.
    buyers = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    sellers = lines.join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    by_nation = sellers.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).where("s_nationkey != c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
    ranked = by_nation.withColumn("place", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("n"), "c_nationkey"))).where(F.col("place") <= top_imports)
    names = nation.select(F.col("n_nationkey"), file_.alias("file_id"))
    imports = ranked.join(names.withColumnsRenamed({"n_nationkey": "a", "file_id": "src"}), F.col("s_nationkey") == F.col("a")).join(names.withColumnsRenamed({"n_nationkey": "b", "file_id": "dst"}), F.col("c_nationkey") == F.col("b"))
    edges = _edge(region, root, dir_, "contains", extracted, F.col("r_regionkey"), zero, zero)
    for more in (
        _edge(nation, dir_, file_, "contains", extracted, F.col("n_nationkey"), zero, zero),
        _edge(customer, file_, cid, "defines", extracted, F.col("c_custkey"), zero, zero),
        _edge(supplier, file_, sid, "defines", extracted, F.col("s_suppkey"), zero, zero),
        _edge(sold, line_cid, line_sid, "calls", flag, F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")),
        _edge(lines, line_sid, line_pid, "instantiates", extracted, F.col("l_orderkey"), F.col("l_orderkey"), F.col("l_linenumber")),
        _edge(imports, F.col("src"), F.col("dst"), "imports", extracted, F.col("place"), zero, zero),
    ):
        edges = edges.unionByName(more)
    return Graph(nodes, edges)


#: The same graph for oracles: CTEs `nodes` and `edges`.
GRAPH_SQL = """
nat AS (SELECT n_nationkey, n_name, r_regionkey, r_name, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT 'repo:tpch' AS id, 'repo' AS kind, 'tpch' AS name, 'tpch' AS qualified, NULL::VARCHAR AS file, NULL::VARCHAR AS language
  UNION ALL SELECT 'dir:' || r_name, 'dir', r_name, r_name, NULL, NULL FROM region
  UNION ALL SELECT 'file:' || path, 'file', n_name, path, path, NULL FROM nat
  UNION ALL SELECT 'customer:' || c_custkey, 'class', c_name, c_name, path, c_mktsegment FROM customer JOIN nat ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'function', s_name, s_name, path, NULL FROM supplier JOIN nat ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, 'method', p_name, p_name, NULL, p_brand FROM part),
sold AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
imp AS (
  SELECT s_nationkey, c_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY count(*) DESC, c_nationkey) AS place
  FROM sold JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey),
edges AS (
  SELECT r_regionkey::BIGINT AS seq, 'repo:tpch' AS src, 'dir:' || r_name AS dst, 'contains' AS relation, 'EXTRACTED' AS confidence, 0::BIGINT AS sl, 0::BIGINT AS sc FROM region
  UNION ALL SELECT n_nationkey, 'dir:' || r_name, 'file:' || path, 'contains', 'EXTRACTED', 0, 0 FROM nat
  UNION ALL SELECT c_custkey, 'file:' || path, 'customer:' || c_custkey, 'defines', 'EXTRACTED', 0, 0 FROM customer JOIN nat ON c_nationkey = n_nationkey
  UNION ALL SELECT s_suppkey, 'file:' || path, 'supplier:' || s_suppkey, 'defines', 'EXTRACTED', 0, 0 FROM supplier JOIN nat ON s_nationkey = n_nationkey
  UNION ALL SELECT l_partkey, 'customer:' || o_custkey, 'supplier:' || l_suppkey, 'calls', CASE l_returnflag WHEN 'R' THEN 'EXTRACTED' WHEN 'N' THEN 'INFERRED' ELSE 'AMBIGUOUS' END, l_orderkey, l_linenumber FROM sold
  UNION ALL SELECT l_orderkey, 'supplier:' || l_suppkey, 'part:' || l_partkey, 'instantiates', 'EXTRACTED', l_orderkey, l_linenumber FROM lineitem
  UNION ALL SELECT place, 'file:' || a.path, 'file:' || b.path, 'imports', 'EXTRACTED', 0, 0 FROM imp JOIN nat a ON s_nationkey = a.n_nationkey JOIN nat b ON c_nationkey = b.n_nationkey WHERE place <= 2)
"""
