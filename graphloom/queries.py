"""The registered queries of the graph engine over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import storage
from .functions import language as lang, text as tx
from .operators import analyze, build, query, traverse
from .plans import incremental, jobs
from .registry import ORACLES, QUERIES, registered
from .sources.tables import Graph, StoredGraph, stored_graph

def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _degrees(g: StoredGraph) -> DataFrame:
    return g.degrees


DEGREE_SQL = """, ends AS (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges),
degree AS (SELECT n.id, coalesce(sum(i), 0)::BIGINT AS in_degree, coalesce(sum(o), 0)::BIGINT AS out_degree, (coalesce(sum(i), 0) + coalesce(sum(o), 0))::BIGINT AS degree FROM nodes n LEFT JOIN ends e ON n.id = e.id GROUP BY n.id)
"""
#: Regions as given communities: every symbol of a file belongs to its file's region.
MEMBERS_SQL = """, members AS (SELECT id, split_part(file, '/', 1) AS community FROM nodes WHERE kind IN ('class', 'function'))
"""
TIES_SQL = """, ties AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_max(w, (seq, w)) AS w FROM (
  SELECT src, dst, seq, CASE relation WHEN 'calls' THEN 2.0 WHEN 'instantiates' THEN 1.5 END AS w FROM edges WHERE relation IN ('calls', 'instantiates')) GROUP BY 1, 2)
"""


def _members(g: Graph) -> DataFrame:
    return g.nodes.where(F.col("kind").isin("class", "function")).select("id", F.substring_index("file", "/", 1).alias("community"))


@registered("SELECT kind AS value, count(*) AS n FROM nodes GROUP BY 1")
def counts_by_kind(spark, sf_dir):
    return build.group_counts(stored_graph(spark, sf_dir).nodes, "kind")


@registered("SELECT relation AS value, count(*) AS n FROM edges GROUP BY 1")
def counts_by_relation(spark, sf_dir):
    return build.group_counts(stored_graph(spark, sf_dir).edges, "relation")


@registered("SELECT confidence AS value, count(*) AS n FROM edges GROUP BY 1")
def counts_by_confidence(spark, sf_dir):
    return build.group_counts(stored_graph(spark, sf_dir).edges, "confidence")


@registered("SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE kind = 'file') AS files, (SELECT count(*) FROM edges) AS edges")
def graph_counts(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return query.counts(g.nodes, g.edges)


@registered("""SELECT 'kind' AS what, kind AS value, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY 2
UNION ALL SELECT 'confidence', confidence, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'directories', NULL, count(*) FROM region UNION ALL SELECT 'top_directories', NULL, count(*) FROM region""")
def build_stats(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return build.build_stats(g.nodes, g.edges)


@registered(DEGREE_SQL + "SELECT * FROM degree")
def degree_all(spark, sf_dir):
    return _degrees(stored_graph(spark, sf_dir))


@registered(DEGREE_SQL + "SELECT id, kind, name, file, in_degree, out_degree, degree FROM degree JOIN nodes USING (id) WHERE kind NOT IN ('repo', 'dir', 'file', 'external', 'community') AND degree > 0 ORDER BY degree DESC, id LIMIT 20")
def god_nodes(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return analyze.god_nodes(g.nodes, _degrees(g))


@registered("SELECT src, dst, relation, sl, sc, arg_min(seq, (seq, confidence)) AS seq, arg_min(confidence, (seq, confidence)) AS confidence FROM edges GROUP BY 1, 2, 3, 4, 5")
def edge_dedup_first(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return build.dedup_edges(g.edges, "seq", "confidence").select("src", "dst", "relation", "sl", "sc", "seq", "confidence")


@registered("SELECT DISTINCT r_name AS dir FROM region")
def directories(spark, sf_dir):
    return build.directories(stored_graph(spark, sf_dir).nodes.where("kind = 'file'").select(F.col("qualified").alias("path")))


@registered(DEGREE_SQL + "SELECT id, name, degree FROM nodes JOIN degree USING (id) WHERE kind IN ('class', 'function') ORDER BY degree DESC, id LIMIT 100 OFFSET 50")
def nodes_filtered_page(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return query.iter_nodes(g.nodes, _degrees(g), ("class", "function"), True, 100, 50).select("id", "name", "degree")


@registered("SELECT src, dst, seq, sl, sc FROM edges WHERE relation = 'calls' AND confidence = 'AMBIGUOUS'")
def edges_filtered(spark, sf_dir):
    return query.iter_edges(stored_graph(spark, sf_dir).edges, ("CALLS",), ("ambiguous",)).select("src", "dst", "seq", "sl", "sc")


@registered(DEGREE_SQL + """, top AS (SELECT id FROM nodes JOIN degree USING (id) ORDER BY degree DESC, id LIMIT 150)
SELECT src, dst, relation, count(*) AS n FROM edges WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top) GROUP BY 1, 2, 3""")
def full_graph_topk(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return query.full_graph(g.nodes, g.edges, _degrees(g), limit=150)[1].groupBy("src", "dst", "relation").agg(F.count("*").alias("n"))


BFS_SQL = """, step AS (SELECT DISTINCT src AS frm, dst AS dest FROM edges WHERE {where} {both}),
walk AS (SELECT '{start}' AS id, 0 AS hop UNION SELECT dest, hop + 1 FROM walk JOIN step ON id = frm WHERE hop < {depth}),
hops AS (SELECT id, min(hop)::INT AS hop FROM walk GROUP BY id)
"""


def _bfs_sql(start: str, depth: int, where: str, direction: str = "out") -> str:
    sql = BFS_SQL if direction != "in" else BFS_SQL.replace("src AS frm, dst AS dest", "dst AS frm, src AS dest")
    both = f"UNION SELECT DISTINCT dst, src FROM edges WHERE {where}" if direction == "both" else ""
    return sql.format(start=start, depth=depth, where=where, both=both)


@registered(_bfs_sql("customer:1", 3, "true") + "SELECT * FROM hops")
def bfs_out_d3(spark, sf_dir):
    return traverse.bfs(stored_graph(spark, sf_dir).walks, ["customer:1"], 3, "out")


@registered(_bfs_sql("supplier:1", 2, "true", "both") + "SELECT * FROM hops")
def bfs_both_d2(spark, sf_dir):
    return traverse.bfs(stored_graph(spark, sf_dir).walks, ["supplier:1"], 2)


@registered(_bfs_sql("repo:tpch", 4, "relation IN ('contains', 'defines', 'calls') AND confidence <> 'AMBIGUOUS'") + "SELECT * FROM hops")
def bfs_filtered(spark, sf_dir):
    return traverse.bfs(stored_graph(spark, sf_dir).walks, ["repo:tpch"], 4, "out", ("CONTAINS", "defines", "calls"), None, ("extracted", "inferred"))


@registered(_bfs_sql("supplier:1", 2, "relation IN ('calls', 'defines', 'contains')", "in") + "SELECT id, kind, name, hop FROM hops JOIN nodes USING (id)")
def neighbors_in(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return traverse.neighbors(g.nodes, g.walks, "supplier:1", 2, "in", ("calls", "defines", "contains"), None).select("id", "kind", "name", "hop")


@registered(_bfs_sql("part:7", 3, "relation IN ('calls', 'instantiates', 'extends', 'implements', 'imports', 'type_uses')", "in") + "SELECT * FROM hops")
def impact_d3(spark, sf_dir):
    return traverse.impact(stored_graph(spark, sf_dir).walks, "part:7", 3, None)


@registered(_bfs_sql("part:7", 2, "relation IN ('calls', 'instantiates', 'extends', 'implements', 'imports', 'type_uses')", "in") + "SELECT file, count(*) AS n FROM hops JOIN nodes USING (id) WHERE file IS NOT NULL AND id <> 'part:7' GROUP BY file ORDER BY n DESC, file LIMIT 200")
def impact_files(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return traverse.impact_files(traverse.impact(g.walks, "part:7", 2, None), g.nodes, "part:7")


@registered(_bfs_sql("supplier:1", 1, "relation = 'calls'", "in") + "SELECT id, name, hop FROM hops JOIN nodes USING (id)")
def callers(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return traverse.neighbors(g.nodes, g.walks, "supplier:1", 1, "in", ("calls",), None).select("id", "name", "hop")


@registered(_bfs_sql("customer:1", 1, "relation = 'calls'") + "SELECT id, name, hop FROM hops JOIN nodes USING (id) ORDER BY hop, id LIMIT 400")
def callees(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return traverse.callees(g.nodes, g.walks, "customer:1").select("id", "name", "hop")


@registered("""SELECT id, name, CASE WHEN id = f THEN 0 ELSE 1 END AS hop FROM (SELECT 'file:' || path AS f FROM nat WHERE n_nationkey = 3), nodes
WHERE id = f OR id IN (SELECT src FROM edges WHERE relation = 'imports' AND dst = f) OR id IN (SELECT dst FROM edges WHERE relation = 'imports' AND src = f)""")
def module_deps(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    nation = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = nation.where("n_nationkey = 3").select(F.concat_ws("/", "r_name", "n_name")).first()[0]
    return traverse.module_dependencies(g.nodes, g.walks, path).select("id", "name", "hop")


@registered(_bfs_sql("customer:2", 1, "relation = 'calls'") + "SELECT relation, count(*) AS n FROM edges WHERE src IN (SELECT id FROM hops) AND dst IN (SELECT id FROM hops) GROUP BY 1")
def induced_subgraph(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return traverse.induced(g.walks, traverse.bfs(g.walks, ["customer:2"], 1, "out", ("calls",))).groupBy("relation").agg(F.count("*").alias("n"))


#: All undirected walks from one node, hop by hop; and back from the goal, of the nodes one hop nearer always the one of smallest id.
PATH_SQL = """, step AS (SELECT src AS frm, dst AS dest FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
walk AS (SELECT '{start}' AS id, 0 AS hop UNION SELECT dest, hop + 1 FROM walk JOIN step ON id = frm WHERE hop < {most}),
hops AS (SELECT id, min(hop)::INT AS hop FROM walk GROUP BY id),
back AS (SELECT hop, id FROM hops WHERE id = '{goal}' UNION ALL SELECT hop, id FROM (SELECT hops.hop, hops.id, row_number() OVER (ORDER BY hops.id) AS r FROM back JOIN step ON back.id = frm JOIN hops ON hops.id = dest AND hops.hop = back.hop - 1) WHERE r = 1)
"""


@registered(PATH_SQL.format(start="customer:1", goal="supplier:1", most=6) + "SELECT max(hop) AS length FROM back HAVING count(*) > 0")
def shortest_path_length(spark, sf_dir):
    path = traverse.shortest_path(stored_graph(spark, sf_dir).walks, "customer:1", "supplier:1")
    return path.agg(F.max("hop").alias("length")).where("length is not null")


@registered(PATH_SQL.format(start="part:7", goal="dir:ASIA", most=6) + "SELECT hop, id FROM back")
def shortest_path_nodes(spark, sf_dir):
    return traverse.shortest_path(stored_graph(spark, sf_dir).walks, "part:7", "dir:ASIA")


@registered(PATH_SQL.format(start="customer:2", goal="part:11", most=6) + "SELECT hop, id FROM back")
def shortest_path_of_calls(spark, sf_dir):
    return traverse.shortest_path(stored_graph(spark, sf_dir).walks, "customer:2", "part:11")


@registered(""", fin AS (SELECT DISTINCT replace(src, 'file:', '') AS src, replace(dst, 'file:', '') AS dst FROM edges WHERE relation = 'imports' AND src <> dst),
reach AS (SELECT src, dst FROM fin UNION SELECT r.src, f.dst FROM reach r JOIN fin f ON r.dst = f.src),
comp AS (SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)
SELECT node, component FROM comp WHERE component IN (SELECT component FROM comp GROUP BY 1 HAVING count(*) > 1)""")
def import_cycles_scc(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return analyze.strongly_connected(analyze.import_graph(g.nodes, g.edges))


@registered("SELECT DISTINCT replace(src, 'file:', '') AS src, replace(dst, 'file:', '') AS dst FROM edges WHERE relation = 'imports' AND src <> dst")
def import_graph(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return analyze.import_graph(g.nodes, g.edges)


@registered("SELECT path FROM nat WHERE 'file:' || path NOT IN (SELECT src FROM edges WHERE relation = 'imports') AND 'file:' || path NOT IN (SELECT dst FROM edges WHERE relation = 'imports')")
def orphan_files(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return analyze.orphan_files(g.nodes, g.edges)


@registered(MEMBERS_SQL + "SELECT a.community AS src_community, b.community AS dst_community, count(*) AS n FROM edges JOIN members a ON src = a.id JOIN members b ON dst = b.id WHERE relation NOT IN ('contains', 'defines') AND a.community <> b.community GROUP BY 1, 2")
def cross_community(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return analyze.cross_community(g.edges, _members(g)).groupBy("src_community", "dst_community").agg(F.count("*").alias("n"))


@registered(TIES_SQL + "SELECT a, b, w::DOUBLE AS w FROM ties")
def symbol_subgraph(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return analyze.symbol_subgraph(g.nodes, g.edges)


@registered(TIES_SQL + MEMBERS_SQL + """, inside AS (SELECT x.community, count(*) AS t FROM ties JOIN members x ON a = x.id JOIN members y ON b = y.id WHERE x.community = y.community GROUP BY 1),
sizes AS (SELECT community, count(*) AS size FROM members GROUP BY 1)
SELECT community, size, CASE WHEN size < 2 THEN 0.0 ELSE round(coalesce(t, 0) / (size * (size - 1) / 2), 4) END::DOUBLE AS cohesion FROM sizes LEFT JOIN inside USING (community)""")
def community_cohesion(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return analyze.cohesion(_members(g), analyze.symbol_subgraph(g.nodes, g.edges))


@registered(DEGREE_SQL + MEMBERS_SQL + """SELECT community, place::INT AS place, id, degree FROM (SELECT community, id, degree, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS place FROM members JOIN degree USING (id)) WHERE place <= 5""")
def community_top5(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return analyze.top_symbols(_members(g), _degrees(g))


@registered(MEMBERS_SQL + "SELECT community, left(sha1(string_agg(id, '|' ORDER BY id)), 16) AS content_hash FROM members GROUP BY 1")
def community_content_hash(spark, sf_dir):
    return analyze.content_hash(_members(stored_graph(spark, sf_dir)))


@registered(MEMBERS_SQL + "SELECT community, file, count(*) AS n FROM members JOIN nodes USING (id) GROUP BY 1, 2")
def community_files(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return analyze.community_files(_members(g), g.nodes)


@registered(DEGREE_SQL + MEMBERS_SQL + "SELECT community, community || ' · ' || arg_min(name, (-degree, id)) AS name FROM members JOIN nodes USING (id) JOIN degree USING (id) GROUP BY 1")
def community_names(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return analyze.heuristic_names(_members(g), g.nodes, _degrees(g))


@registered()
def communities(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return analyze.communities(g.nodes, g.edges)


def _planted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers of a market segment as symbols, each tied to those 1, 2, 4, ... places further round its segment; the first of each segment to that of the next."""
    own = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("g"))
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1).withColumn("size", F.count("*").over(Window.partitionBy("g")))
    name = lambda k: F.concat(F.lit("c:"), F.col(k).cast("string"))
    step = own.withColumn("step", F.explode(F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.pow(F.lit(2), i).cast("int")))).where("step < size")
    round_ = step.select(name("k").alias("src"), "g", ((F.col("place") + F.col("step")) % F.col("size")).alias("to"))
    inside = round_.join(own.select("g", F.col("place").alias("to"), name("k").alias("dst")), ["g", "to"]).select("src", "dst")
    first = own.where("place = 0").select("g", name("k").alias("src"))
    between = first.withColumn("dst", F.lead("src").over(Window.orderBy("g"))).where("dst is not null").select("src", "dst")  # one row a segment
    edges = inside.unionByName(between).select(F.monotonically_increasing_id().alias("seq"), "src", "dst", F.lit("calls").alias("relation"))
    return own.select(name("k").alias("id"), F.lit("function").alias("kind")), edges


@registered("SELECT 'c:' || c_custkey AS id, (dense_rank() OVER (ORDER BY size DESC, first) - 1)::INT AS community FROM customer JOIN (SELECT c_mktsegment, count(*) AS size, min('c:' || c_custkey) AS first FROM customer GROUP BY 1) USING (c_mktsegment)", graph=False)
def communities_planted(spark, sf_dir):
    return analyze.communities(*_planted(spark, sf_dir)).select("id", F.col("community").cast("int").alias("community"))


@registered("SELECT 0::BIGINT AS parts_too_many", graph=False)
def communities_connected(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    numbers, ties = analyze.numbered_subgraph(g.nodes, g.edges)
    named = analyze.named_communities(analyze.communities_of(ties), numbers)
    labels = storage.cut(named.join(numbers, "id").select(F.col("n").alias("id"), F.col("community").alias("label")), "members")
    parts = analyze.connected_parts(labels, ties).select("label").distinct()
    return parts.agg(F.count("*").alias("n")).crossJoin(labels.agg(F.count_distinct("label").alias("m"))).select((F.col("n") - F.col("m")).alias("parts_too_many"))  # one row each


#: Parts imported by their halves and thirds, some of them by their doubles too, which closes cycles.
LAYER_SQL = """WITH RECURSIVE p AS (SELECT p_partkey AS k FROM part), e AS (SELECT k AS s, k // 2 AS d FROM p WHERE k > 1 UNION SELECT k, k // 3 FROM p WHERE k > 2 UNION SELECT a.k, b.k FROM p a JOIN p b ON b.k = 2 * a.k WHERE a.k % 50 = 0),
reach AS (SELECT s, d FROM e UNION SELECT r.s, e.d FROM reach r JOIN e ON r.d = e.s),
comp AS (SELECT k AS node, coalesce(min(lpad(b.d::VARCHAR, 9, '0')), lpad(k::VARCHAR, 9, '0')) AS component FROM p LEFT JOIN (SELECT a.s, a.d FROM reach a JOIN reach b ON a.s = b.d AND a.d = b.s) b ON b.s = k GROUP BY k),
ce AS (SELECT DISTINCT x.component AS s, y.component AS d FROM e JOIN comp x ON e.s = x.node JOIN comp y ON e.d = y.node WHERE x.component <> y.component),
walk AS (SELECT DISTINCT component AS c, 0 AS layer FROM comp UNION SELECT d, layer + 1 FROM walk JOIN ce ON c = s)
SELECT lpad(node::VARCHAR, 9, '0') AS node, component, max(layer)::INT AS layer FROM comp JOIN walk ON c = component GROUP BY ALL"""


@registered(LAYER_SQL, graph=False)
def graph_layers(spark, sf_dir):
    k, key = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), lambda c: F.lpad(c.cast("bigint").cast("string"), 9, "0")
    doubles = k.where("k % 50 = 0").join(k.select((F.col("k") / 2).alias("half")), F.col("half") == F.col("k"))
    pairs = k.where("k > 1").select(key(F.col("k")).alias("src"), key(F.floor(F.col("k") / 2)).alias("dst"))
    pairs = pairs.union(k.where("k > 2").select(key(F.col("k")), key(F.floor(F.col("k") / 3)))).union(doubles.select(key(F.col("k")), key(2 * F.col("k"))))
    return analyze.layers(pairs)


@registered("SELECT '' AS dir, count(*) AS files, sum(size)::BIGINT AS size, 0 AS depth FROM (SELECT path, count(*) AS size FROM nat JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) UNION ALL SELECT split_part(path, '/', 1), count(*), sum(size)::BIGINT, 1 FROM (SELECT path, count(*) AS size FROM nat JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) GROUP BY 1")
def tree_rollup(spark, sf_dir):
    sizes = stored_graph(spark, sf_dir).nodes.where("kind = 'class'").groupBy(F.col("file").alias("path")).agg(F.count("*").alias("size"))
    return query.tree_rollup(sizes, ["size"]).select("dir", "files", "size", "depth")


@registered("SELECT 'incoming' AS side, src AS other, coalesce(name, src) AS other_name, relation, confidence FROM (SELECT * FROM edges WHERE dst = 'supplier:3' ORDER BY src, relation, seq, confidence LIMIT 500) LEFT JOIN nodes ON src = id UNION ALL SELECT 'outgoing', dst, coalesce(name, dst), relation, confidence FROM (SELECT * FROM edges WHERE src = 'supplier:3' ORDER BY dst, relation, seq, confidence LIMIT 500) LEFT JOIN nodes ON dst = id")
def symbol_card(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return query.symbol_card(g.nodes, g.walks, "supplier:3")


def _search_sql(needle: str, limit: int = 50) -> str:
    hit = " OR ".join(f"{c} ILIKE '%{needle}%'" for c in ("name", "qualified", "file"))
    return DEGREE_SQL + f"SELECT id, name, degree FROM nodes JOIN degree USING (id) WHERE kind NOT IN ('repo', 'dir', 'community') AND ({hit}) ORDER BY degree DESC, qualified, id LIMIT {limit}"


@registered(_search_sql("er#0000_1"))
def search_nodes(spark, sf_dir):
    return stored_graph(spark, sf_dir).grams.search("er#0000_1").select("id", "name", "degree")


@registered(_search_sql("c%st_mer#%77", 100_000))
def search_wildcards(spark, sf_dir):
    return stored_graph(spark, sf_dir).grams.search(" C%sT_mer#%77 ", limit=100_000).select("id", "name", "degree")


@registered(_search_sql("ia", 100_000))
def search_short(spark, sf_dir):
    return stored_graph(spark, sf_dir).grams.search("IA", limit=100_000).select("id", "name", "degree")


@registered("""SELECT gram, count(*) AS n FROM (SELECT DISTINCT id, substr(t, i, k) AS gram FROM (SELECT id, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM (SELECT id, unnest([lower(name), lower(qualified), lower(file)]) AS t FROM nodes WHERE kind NOT IN ('repo', 'dir', 'community')), (VALUES (1), (2), (3)) s(k) WHERE t IS NOT NULL)) GROUP BY 1""")
def gram_postings(spark, sf_dir):
    return stored_graph(spark, sf_dir).grams.counts.rows


@registered("SELECT id, name FROM nodes WHERE kind IN ('function', 'method') AND file IS NOT NULL AND id NOT IN (SELECT dst FROM edges WHERE relation IN ('calls', 'instantiates'))")
def dead_code(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return query.dead_code(g.nodes, g.edges).select("id", "name")


@registered("SELECT file, count(*) AS symbols FROM nodes WHERE kind NOT IN ('repo', 'dir', 'file', 'external', 'community') AND file IS NOT NULL GROUP BY 1")
def symbols_per_file(spark, sf_dir):
    return query.symbols_per_file(stored_graph(spark, sf_dir).nodes)


@registered("SELECT src, dst, relation FROM edges WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)")
def dangling_edges(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return build.dangling(g.nodes, g.edges).select("src", "dst", "relation")


@registered("SELECT count_if(flag = 'R')::BIGINT AS extracted, count_if(flag = 'N')::BIGINT AS inferred, count_if(flag = 'A')::BIGINT AS ambiguous, round((count_if(flag = 'R') + count_if(flag = 'N')) / count(*), 4) AS rate FROM (SELECT l_returnflag AS flag FROM lineitem)", graph=False)
def resolution_rate(spark, sf_dir):
    from .operators.resolve import call_stats

    outcome = F.when(F.col("confidence") == "EXTRACTED", "extracted").when(F.col("confidence") == "INFERRED", "inferred").otherwise("ambiguous")
    refs = stored_graph(spark, sf_dir).edges.where("relation = 'calls'").select(F.lit("call").alias("ref_kind"), outcome.alias("outcome"))
    return call_stats(refs).select("extracted", "inferred", "ambiguous", "rate")


# Text.


@registered(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(\b[a-zA-Z][a-zA-Z0-9+.-]*://[^/\s:@]+:)([^@\s/]+)(@)', '\1***\3', 'g'),
'(?i)((?:api[_-]?key|apikey|secret|token|password|passwd|access[_-]?key|private[_-]?key|client[_-]?secret)\s*[:=]\s*)"([^\s''"]{6,})"', '\1"***"', 'g'),
'(?i)((?:api[_-]?key|apikey|secret|token|password|passwd|access[_-]?key|private[_-]?key|client[_-]?secret)\s*[:=]\s*)''([^\s''"]{6,})''', '\1''***''', 'g'),
'(?i)((?:api[_-]?key|apikey|secret|token|password|passwd|access[_-]?key|private[_-]?key|client[_-]?secret)\s*[:=]\s*)([^\s''"*]{6,})', '\1***', 'g'),
'(?i)\b(bearer\s+)([A-Za-z0-9._\-+/=]{8,})', '\1***', 'g') AS text FROM documents""", graph=False)
def redact_secrets(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", tx.redact_secrets(F.col("text")).alias("text"))


@registered(r"SELECT page_id, regexp_replace(replace(url, '://', '://u:pw@'), '(\b[a-zA-Z][a-zA-Z0-9+.-]*://[^/\s:@]+:)([^@\s/]+)(@)', '\1***\3', 'g') AS url FROM pages", graph=False)
def redact_url(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", tx.redact_url(F.replace("url", F.lit("://"), F.lit("://u:pw@"))).alias("url"))


@registered(r"SELECT conv_id, turn, left(trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')), 256) AS label FROM conversations", graph=False)
def sanitize_label(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", tx.sanitize_label(F.col("text")).alias("label"))


@registered(r"SELECT p_partkey, left(CASE WHEN s = '' THEN 'unnamed' ELSE s END, 80) AS slug FROM (SELECT p_partkey, lower(trim(regexp_replace(trim(p_name), '[^A-Za-z0-9._-]+', '-', 'g'), '-')) AS s FROM part)", graph=False)
def slug(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", tx.slug(F.col("p_name")).alias("slug"))


@registered("SELECT doc_id, (len(text) - len(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END)::INT AS loc FROM documents", graph=False)
def count_loc(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", tx.line_count(F.col("text")).alias("loc"))


@registered("SELECT page_id, sha256(html) AS sha256, strlen(html)::BIGINT AS size FROM pages", graph=False)
def content_hashes(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("bigint").alias("size"))


@registered("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS text FROM documents", graph=False)
def read_lines(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", tx.lines_of(F.col("text"), 2, 4).alias("text"))


@registered(r"SELECT doc_id, len(f) AS n, f[1:2] AS samples FROM (SELECT doc_id, regexp_extract_all(text, '\b((?:License|Licensed|token|the)\b[:\s]?.{0,80})', 1) AS f FROM documents) WHERE len(f) > 0 ORDER BY n DESC, doc_id LIMIT 10", graph=False)
def marker_scan(spark, sf_dir):
    found = query.marker_scan(_read(spark, sf_dir, "documents"), "doc_id", ("License", "Licensed", "token", "the"))
    return found.select("doc_id", F.col("n").cast("bigint").alias("n"), "samples")


@registered(r"SELECT page_id, regexp_matches(trim(url), '^(?i)(https?|git|ssh)://[^/]+/.+') AND NOT contains(url, '::') AND NOT regexp_matches(trim(url), '\s') AS ok FROM pages", graph=False)
def url_validate(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", tx.git_url(F.col("url")).alias("ok"))


@registered(r"SELECT page_id, CASE WHEN contains(p, '..') THEN NULL ELSE array_to_string(list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.'), '/') END AS path FROM (SELECT page_id, 'a/./' || replace(regexp_replace(url, '^[a-z]+://', ''), 'www.', 'x//') AS p FROM pages)", graph=False)
def path_normalise(spark, sf_dir):
    bare = F.concat(F.lit("a/./"), F.replace(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("www."), F.lit("x//")))
    return _read(spark, sf_dir, "pages").select("page_id", tx.repo_relative(bare).alias("path"))


LANGUAGE_SQL = "CASE doc_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'tsx' WHEN 2 THEN 'make' WHEN 3 THEN 'python' WHEN 4 THEN 'unknown' ELSE 'markdown' END"


def _files(spark, sf_dir) -> DataFrame:
    """Documents as files of made-up names."""
    docs = _read(spark, sf_dir, "documents")
    name = F.element_at(F.array(*[F.lit(x) for x in ("a.py", "b.tsx", "Makefile", "run", "x.zzz", "R.MD")]), (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), name)
    first = F.when(F.col("doc_id") % 6 == 3, "#!/usr/bin/env python3")
    return docs.select("doc_id", path.alias("path"), lang.detect(path, first).alias("language"), F.octet_length("text").cast("bigint").alias("size"), tx.line_count(F.col("text")).cast("bigint").alias("loc"), F.sha2("text", 256).alias("sha256"))


@registered(f"SELECT doc_id, {LANGUAGE_SQL} AS language FROM documents", graph=False)
def language_detect(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", "language")


@registered(f"SELECT {LANGUAGE_SQL} AS language, count(*) AS files, sum(len(text) - len(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END)::BIGINT AS loc FROM documents GROUP BY 1", graph=False)
def language_stats(spark, sf_dir):
    return query.language_stats(_files(spark, sf_dir))


@registered("SELECT doc_id FROM (SELECT doc_id, source || '/' || lang || '/' || doc_id || '/' || ['a.py', 'b.tsx', 'Makefile', 'run', 'x.zzz', 'R.MD'][doc_id % 6 + 1] AS path FROM documents) WHERE path ILIKE '%de/%.py%' ORDER BY path LIMIT 20 OFFSET 5", graph=False)
def files_page(spark, sf_dir):
    return query.files_page(_files(spark, sf_dir), "de/%.py", 20, 5).select("doc_id")


@registered("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6", graph=False)
def history_last6(spark, sf_dir):
    from .plans.tools import last_turns

    return last_turns(_read(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


# Jobs and incremental runs.


def _jobs(spark, sf_dir) -> DataFrame:
    """Events as a log of jobs: users are jobs, and the kinds of events their states."""
    e = _read(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "queued").otherwise("error")
    return e.select("event_id", F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job"), F.concat(F.lit("repo-"), (F.col("user_id") % 7).cast("string")).alias("repo_id"), F.col("ts").cast("timestamp").alias("ts"), state.alias("state"), F.floor("value").cast("int").alias("current"), F.lit(100).alias("total"))


JOBS_SQL = "SELECT event_id, 'job-' || user_id AS job, 'repo-' || user_id % 7 AS repo_id, ts, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' ELSE 'error' END AS state, floor(value)::INT AS current, 100 AS total FROM events"


@registered(f"SELECT job, arg_max(state, (ts, event_id)) AS state, max(ts) AS ts FROM ({JOBS_SQL}) GROUP BY 1", graph=False)
def job_latest_state(spark, sf_dir):
    return jobs.current(_jobs(spark, sf_dir)).select("job", "state", "ts")


@registered(f"SELECT repo_id, arg_max(job, (ts, event_id)) AS job FROM (SELECT * FROM ({JOBS_SQL}) QUALIFY row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) = 1) WHERE state IN ('queued', 'running') GROUP BY 1", graph=False)
def active_job(spark, sf_dir):
    return jobs.active(_jobs(spark, sf_dir)).select("repo_id", "job")


@registered(f"SELECT event_id, CASE WHEN state = 'done' THEN 1.0 ELSE least(1.0, current / total) END::DOUBLE AS progress FROM ({JOBS_SQL})", graph=False)
def progress_ratio(spark, sf_dir):
    return _jobs(spark, sf_dir).select("event_id", tx.progress(F.col("state"), F.col("current"), F.col("total")).alias("progress"))


@registered(f"SELECT job, state FROM (SELECT job, CASE WHEN state IN ('queued', 'running') THEN 'error' ELSE state END AS state, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS r FROM ({JOBS_SQL})) WHERE r = 1", graph=False)
def mark_orphans(spark, sf_dir):
    return jobs.mark_orphans(jobs.current(_jobs(spark, sf_dir))).select("job", "state")


@registered(f"SELECT event_id FROM (SELECT *, lag(ts) OVER w AS before, lag(state) OVER w AS was FROM ({JOBS_SQL}) WINDOW w AS (PARTITION BY job ORDER BY ts, event_id)) WHERE was IS NULL OR state <> was OR state IN ('done', 'error') OR epoch_us(ts) - epoch_us(before) >= 3600000000", graph=False)
def throttle_by_gap(spark, sf_dir):
    return jobs.throttled_by_gap(_jobs(spark, sf_dir), 3600.0).select("event_id")


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Cached extractions of an earlier version of the files, and the files now."""
    now = _files(spark, sf_dir).select("path", "sha256", "doc_id")
    then = now.where("doc_id % 10 != 3").select(F.when(F.col("doc_id") % 10 == 7, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 10 == 5, F.lit("x")).otherwise(F.col("sha256")).alias("sha256"))
    return then, now


@registered("SELECT doc_id FROM documents WHERE doc_id % 10 IN (3, 5, 7)", graph=False)
def incremental_changed(spark, sf_dir):
    then, now = _versions(spark, sf_dir)
    return incremental.changed(now, then).select("doc_id")


@registered("SELECT doc_id FROM documents WHERE doc_id % 10 NOT IN (3, 5, 7)", graph=False)
def incremental_reused(spark, sf_dir):
    then, now = _versions(spark, sf_dir)
    return incremental.reused(now, then).select("doc_id")


@registered("SELECT 'old/' || source || '/' || lang || '/' || doc_id || '/' || ['a.py', 'b.tsx', 'Makefile', 'run', 'x.zzz', 'R.MD'][doc_id % 6 + 1] AS path FROM documents WHERE doc_id % 10 = 7", graph=False)
def incremental_stale(spark, sf_dir):
    then, now = _versions(spark, sf_dir)
    return incremental.stale(now, then).select("path")


@registered(MEMBERS_SQL + ", h AS (SELECT community, left(sha1(string_agg(id, '|' ORDER BY id)), 16) AS content_hash FROM members GROUP BY 1) SELECT community, content_hash, CASE WHEN community < 'B' THEN 'kept name' ELSE community END AS name, CASE WHEN community < 'B' THEN 'llm' ELSE 'heuristic' END AS named_by FROM h")
def naming_cache_restore(spark, sf_dir):
    from .plans.naming import restore_names

    hashes = analyze.content_hash(_members(stored_graph(spark, sf_dir)))
    cache = hashes.where("community < 'B'").select("content_hash", F.lit("kept name").alias("name"), F.lit("llm").alias("named_by"))
    return restore_names(hashes.withColumn("name", F.col("community")), cache).select("community", "content_hash", "name", "named_by")


from . import code_queries, service_queries  # noqa: E402, F401  (they register their own)
