"""Registered queries of what stands around the graph: focus and export views, tools, ids, names, jobs and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import storage
from .functions import text as tx
from .operators import analyze, build, imports, query, traverse
from .plans import catalog, jobs, tools
from .queries import DEGREE_SQL, JOBS_SQL, MEMBERS_SQL, TIES_SQL, _bfs_sql, _degrees, _jobs, _members, _read
from .registry import registered
from .sources.tables import stored_graph

# Views of the graph.

BOTH_SQL = """, walk AS (SELECT src AS here, dst AS nxt FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
one AS (SELECT nxt AS id FROM walk WHERE here = 'customer:7'), two AS (SELECT nxt AS id FROM walk JOIN one ON here = one.id),
hops AS (SELECT id, min(hop) AS hop FROM (SELECT 'customer:7' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two) GROUP BY 1 ORDER BY hop, id LIMIT 300)
"""


def _focus(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return traverse.focus_graph(g.nodes, g.walks, "customer:7", 2, 300, kinds=("function", "class"))


@registered(BOTH_SQL + "SELECT id, kind, hop FROM hops JOIN nodes USING (id) WHERE kind IN ('function', 'class') OR id = 'customer:7'")
def focus_nodes(spark, sf_dir):
    return _focus(spark, sf_dir)[0].select("id", "kind", "hop")


@registered(BOTH_SQL + ", own AS (SELECT id FROM hops JOIN nodes USING (id) WHERE kind IN ('function', 'class') OR id = 'customer:7') SELECT src, dst, relation, count(*) AS n FROM edges WHERE src IN (SELECT id FROM own) AND dst IN (SELECT id FROM own) GROUP BY ALL")
def focus_edges(spark, sf_dir):
    return _focus(spark, sf_dir)[1].groupBy("src", "dst", "relation").agg(F.count("*").alias("n"))


@registered(DEGREE_SQL + ", top AS (SELECT id FROM degree ORDER BY degree DESC, id LIMIT 800) SELECT src, dst, relation FROM edges WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top) ORDER BY src, dst, relation, seq LIMIT 3000")
def html_trim_edges(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return query.full_graph(g.nodes, g.edges, _degrees(g), limit=800, most_edges=3000)[1].select("src", "dst", "relation")


@registered("SELECT id, kind, name, qualified, file, language FROM nodes WHERE id IN ('customer:1', 'supplier:2', 'part:3', 'nowhere:4')")
def nodes_by_ids(spark, sf_dir):
    return query.nodes_by_ids(stored_graph(spark, sf_dir).nodes, ["customer:1", "supplier:2", "part:3", "nowhere:4"])


@registered("SELECT id, kind, name, qualified, file, language FROM nodes WHERE kind = 'file' AND qualified = (SELECT min(path) FROM nat)")
def file_by_path(spark, sf_dir):
    nodes = stored_graph(spark, sf_dir).nodes
    return query.get_file(nodes, nodes.where("kind = 'file'").agg(F.min("qualified")).first()[0])


@registered("SELECT src, dst, relation, confidence, sl FROM edges WHERE relation = 'imports'")
def edge_briefs(spark, sf_dir):
    return query.edge_briefs(stored_graph(spark, sf_dir).edges.where("relation = 'imports'"))


@registered(DEGREE_SQL + "SELECT id, kind, name, qualified, file, language, degree FROM nodes JOIN degree USING (id) WHERE kind = 'function'")
def node_briefs(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return query.node_briefs(g.nodes.where("kind = 'function'"), _degrees(g))


@registered(MEMBERS_SQL + "SELECT community, count(*) AS size FROM members GROUP BY 1")
def community_list(spark, sf_dir):
    return query.community_list(_members(stored_graph(spark, sf_dir)))


@registered("""SELECT 'kind' AS what, kind AS value, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'relation', relation, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'confidence', confidence, count(*) FROM edges GROUP BY 2
UNION ALL SELECT 'nodes', NULL, count(*) FROM nodes UNION ALL SELECT 'edges', NULL, count(*) FROM edges UNION ALL SELECT 'files', NULL, count(*) FROM nodes WHERE kind = 'file'""")
def overview(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return query.overview(g.nodes, g.edges)


@registered(MEMBERS_SQL + "SELECT id, (dense_rank() OVER (ORDER BY size DESC, first) - 1)::INT AS community FROM members JOIN (SELECT community, count(*) AS size, min(id) AS first FROM members GROUP BY 1) USING (community)")
def community_numbers(spark, sf_dir):
    return analyze.number_communities(_members(stored_graph(spark, sf_dir)).withColumnRenamed("community", "label")).withColumn("community", F.col("community").cast("int"))


@registered(DEGREE_SQL + MEMBERS_SQL + """SELECT (SELECT count(DISTINCT community) FROM members) AS communities, (SELECT max(n) FROM (SELECT count(*) AS n FROM members GROUP BY community)) AS largest, (SELECT count(*) FROM nodes) AS nodes,
(SELECT count(*) FROM nat WHERE 'file:' || path NOT IN (SELECT src FROM edges WHERE relation = 'imports') AND 'file:' || path NOT IN (SELECT dst FROM edges WHERE relation = 'imports')) AS orphans,
(SELECT count(*) FROM edges JOIN members a ON src = a.id JOIN members b ON dst = b.id WHERE relation NOT IN ('contains', 'defines') AND a.community <> b.community) AS cross,
(SELECT least(count(*), 20) FROM nodes JOIN degree USING (id) WHERE kind NOT IN ('repo', 'dir', 'file', 'external', 'community') AND degree > 0) AS gods""")
def analysis_stats(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return analyze.analysis_stats(g.nodes, g.edges, _members(g), _degrees(g))


@registered(DEGREE_SQL + MEMBERS_SQL + TIES_SQL + """, inside AS (SELECT x.community, count(*) AS t FROM ties JOIN members x ON a = x.id JOIN members y ON b = y.id WHERE x.community = y.community GROUP BY 1),
tops AS (SELECT community, string_agg(id, ',' ORDER BY place) AS top FROM (SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS place FROM members JOIN degree USING (id)) WHERE place <= 5 GROUP BY 1)
SELECT community, count(*) AS size, round(coalesce(max(t), 0) / (count(*) * (count(*) - 1) / 2), 4)::DOUBLE AS cohesion, left(sha1(string_agg(id, '|' ORDER BY id)), 16) AS content_hash, max(top) AS top FROM members LEFT JOIN inside USING (community) JOIN tops USING (community) GROUP BY 1 HAVING count(*) > 1""")
def analysis_payload(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    own = catalog.community_payload(g.nodes, g.edges, _members(g), _degrees(g)).where("size > 1")
    return own.select("community", "size", "cohesion", "content_hash", F.array_join(F.transform("top_symbols", lambda s: s["id"]), ",").alias("top"))


@registered("SELECT word, id FROM (SELECT DISTINCT id, unnest(string_split_regex(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+')) AS word FROM nodes WHERE kind IN ('class', 'function', 'method')) WHERE word <> ''")
def name_words(spark, sf_dir):
    return query.name_index(stored_graph(spark, sf_dir).nodes)


@registered(", words AS (SELECT DISTINCT id, unnest(string_split_regex(lower(name), '[^a-z0-9]+')) AS word FROM nodes WHERE kind IN ('class', 'function', 'method')) SELECT id FROM words WHERE word IN ('supplier', '000000003') GROUP BY id HAVING count(*) = 2")
def word_search(spark, sf_dir):
    return query.word_search(query.name_index(stored_graph(spark, sf_dir).nodes), "Supplier 000000003")


@registered("SELECT 'r' AS repo, dst, count(*) AS n FROM edges WHERE relation = 'instantiates' GROUP BY 2 ORDER BY n DESC, dst LIMIT 400")
def externals_top400(spark, sf_dir):
    return imports.top_externals(stored_graph(spark, sf_dir).edges.where("relation = 'instantiates'").withColumn("repo", F.lit("r")))


@registered("SELECT p_brand AS layer, p_size AS item, count(*) AS weight, dense_rank() OVER (PARTITION BY p_brand ORDER BY count(*) DESC) AS place FROM part GROUP BY 1, 2", graph=False)
def layered_rank(spark, sf_dir):
    groups = _read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("layer"), F.col("p_size").alias("item")).agg(F.count("*").alias("weight"))
    return query.layered_rank(groups, "layer", "weight").withColumn("place", F.col("place").cast("bigint"))


@registered("SELECT dir, sum(area)::BIGINT AS area, count(*) AS n FROM (SELECT lang AS dir, greatest(len(text) - len(replace(text, chr(10), '')), 1) AS area FROM documents) GROUP BY 1", graph=False)
def treemap_weights(spark, sf_dir):
    files = _read(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("loc"))
    return query.treemap_weights(files).where("depth = 1").select("dir", "area", F.col("files").alias("n"))


@registered("SELECT id, name, source FROM (SELECT id, name, source, row_number() OVER (PARTITION BY id ORDER BY rank, place) AS r FROM (SELECT id, name, 'hub' AS source, 0 AS rank, row_number() OVER (ORDER BY id) AS place FROM nodes WHERE id LIKE 'supplier:1%' UNION ALL SELECT id, name, 'found', 1, row_number() OVER (ORDER BY id) FROM nodes WHERE id LIKE 'supplier:%')) WHERE r = 1")
def focus_options(spark, sf_dir):
    nodes = stored_graph(spark, sf_dir).nodes.where("kind = 'function'").select("id", "name")
    return query.focus_options([("hub", nodes.where("id like 'supplier:1%'")), ("found", nodes)])


@registered("SELECT * FROM (VALUES ('repo_overview'), ('search_symbols'), ('get_symbol'), ('neighbors'), ('callers'), ('callees'), ('impact'), ('path_between'), ('list_communities'), ('read_file'), ('file_tree'), ('module_dependencies'), ('cycles'), ('god_nodes')) t(name)", graph=False)
def tool_specs(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return spark.createDataFrame([(s["name"],) for s in tools.Tools(g.nodes, g.edges).specs()], "name string")


@registered("SELECT id, kind, name FROM nodes JOIN (SELECT src AS id FROM edges WHERE dst = 'supplier:3' AND relation = 'calls' UNION SELECT 'supplier:3') USING (id) ORDER BY id = 'supplier:3' DESC, id LIMIT 20")
def tool_citations(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    cited = tools.citations(tools.Tools(g.nodes, g.edges).run("callers", node="supplier:3"))
    return spark.createDataFrame([(c["id"], c["kind"], c["name"]) for c in cited], "id string, kind string, name string")


# Text and ids.

_SLUG = r"coalesce(nullif(left(trim(regexp_replace(lower(trim({0})), '[^a-z0-9._-]+', '-', 'g'), '-'), 80), ''), 'unnamed')"


@registered(f"SELECT page_id, {_SLUG.format('host')} || '__' || {_SLUG.format('lang')} || '__' || {_SLUG.format('num')} || '@head-' || left(sha1(url || '@'), 6) AS repo_id FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)/([^/]+)/([0-9]+)', 1) AS host, regexp_extract(url, '^[a-z]+://([^/]+)/([^/]+)/([0-9]+)', 2) AS lang, regexp_extract(url, '^[a-z]+://([^/]+)/([^/]+)/([0-9]+)', 3) AS num FROM pages)", graph=False)
def repo_ids(spark, sf_dir):
    part = lambda i: F.regexp_extract("url", "^[a-z]+://([^/]+)/([^/]+)/([0-9]+)", i)
    return _read(spark, sf_dir, "pages").select("page_id", tx.repo_id_git(part(1), part(2), part(3), F.lit(None).cast("string"), F.col("url")).alias("repo_id"))


@registered(f"SELECT s_suppkey, 'local-' || {_SLUG.format('s_name')} || '-' || left(sha1('/work/' || s_name), 6) AS repo_id FROM supplier", graph=False)
def local_repo_ids(spark, sf_dir):
    return _read(spark, sf_dir, "supplier").select("s_suppkey", tx.repo_id_local(F.concat(F.lit("/work/"), "s_name")).alias("repo_id"))


@registered(r"SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z0-9._@-]{1,200}') AS repo_ok, regexp_full_match(replace(p_name, ' ', '-'), '[A-Za-z0-9-]{4,64}') AS job_ok, regexp_full_match(p_type, '[A-Z][A-Za-z0-9_]*') AS type_ok, string_split(p_brand, '.')[-1] AS last FROM part", graph=False)
def id_checks(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    return p.select("p_partkey", tx.valid_repo_id(F.col("p_name")).alias("repo_ok"), tx.valid_job_id(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("job_ok"), tx.looks_like_type(F.col("p_type")).alias("type_ok"), tx.last_segment(F.concat(F.lit("*[]a."), "p_brand")).alias("last"))


@registered("SELECT p_partkey, list_filter([trim(x) FOR x IN string_split(p_name || ', ,' || p_brand, ',')], lambda x: x <> '') AS parts FROM part", graph=False)
def list_splits(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", tx.split_list(F.concat("p_name", F.lit(", ,"), "p_brand")).alias("parts"))


@registered(r"SELECT p_partkey, left(regexp_replace(p_name || '  of ' || p_brand, '\s+', ' ', 'g'), 400) AS doc FROM part", graph=False)
def clean_docs(spark, sf_dir):
    quoted = F.concat(F.lit('"""'), F.col("p_name"), F.lit(" \n of "), F.col("p_brand"), F.lit('"""'))
    return _read(spark, sf_dir, "part").select("p_partkey", tx.clean_doc(quoted).alias("doc"))


@registered("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '{}' ELSE props END AS answer FROM events", graph=False)
def json_answers(spark, sf_dir):
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" as asked"))).otherwise("no object")
    return _read(spark, sf_dir, "events").select("event_id", tx.first_json_object(said).alias("answer"))


@registered("SELECT doc_id, left(trim(array_to_string(string_split(text, chr(10))[2:4], chr(10)), ' ' || chr(10) || chr(9) || chr(13)), 240) AS text FROM documents", graph=False)
def snippets(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text"), F.lit(2)).alias("text"))


# Jobs and stored tables.


@registered(f"""WITH RECURSIVE j AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS i, epoch_us(ts) AS t FROM ({JOBS_SQL})),
walk(job, i, state, t, kept, keep, event_id) AS (SELECT job, i, state, t, t, true, event_id FROM j WHERE i = 1
  UNION ALL SELECT j.job, j.i, j.state, j.t, CASE WHEN ok THEN j.t ELSE w.kept END, ok, j.event_id FROM walk w JOIN j ON j.job = w.job AND j.i = w.i + 1, LATERAL (SELECT j.state <> w.state OR j.state IN ('done', 'error') OR j.t - w.kept >= 3600000000 AS ok))
SELECT event_id FROM walk WHERE keep""", graph=False)
def throttle_exact(spark, sf_dir):
    return jobs.throttled(_jobs(spark, sf_dir), 3600.0).select("event_id")


@registered(f"SELECT event_id FROM (SELECT event_id, state, lag(state) OVER (PARTITION BY job ORDER BY ts, event_id) AS before FROM ({JOBS_SQL})) WHERE before IS NULL OR before <> state", graph=False)
def console_dedup(spark, sf_dir):
    return jobs.changed_lines(_jobs(spark, sf_dir).withColumn("line", F.col("state")), ["ts", "event_id"]).select("event_id")


def _accounts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Old and new versions of accounts, and their rows in common."""
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return c.where("id % 4 != 0"), c.where("id % 4 < 2").withColumn("name", F.concat(F.lit("new "), "name"))


@registered("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 < 2 THEN 'new ' || c_name ELSE c_name END AS name, c_mktsegment AS segment FROM customer", graph=False)
def table_upsert(spark, sf_dir):
    old, new = _accounts(spark, sf_dir)
    return storage.upsert(old, new, "id")


@registered("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 1 THEN 'new ' || c_name ELSE c_name END AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 4 <> 0", graph=False)
def table_point_update(spark, sf_dir):
    old, new = _accounts(spark, sf_dir)
    return storage.point_update(old, new, "id", ["name"])


@registered("SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'new ' || c_name ELSE c_name END AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_custkey % 4 < 2", graph=False)
def table_overwrite(spark, sf_dir):
    """A table by segment, of which one partition is replaced; it is read back."""
    whole = _accounts(spark, sf_dir)[0].limit(0).unionByName(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    path = storage.fresh_path(spark, "accounts")
    storage.overwrite(whole, path, "segment")
    storage.overwrite(_accounts(spark, sf_dir)[1].where("segment = 'BUILDING'"), path, "segment")
    return spark.read.schema(whole.schema).parquet(path)


@registered("SELECT path FROM (SELECT doc_id::VARCHAR AS path, doc_id FROM documents) WHERE doc_id % 5 IN (1, 2)", graph=False)
def stale_files(spark, sf_dir):
    then = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.col("text"), 256).alias("sha256"), "doc_id")
    now = then.where("doc_id % 5 != 2").withColumn("sha256", F.when(F.col("doc_id") % 5 == 1, F.sha2("path", 256)).otherwise(F.col("sha256")))
    return query.stale_files(then, now)


@registered("SELECT 'files' AS what, count(*) AS n FROM documents UNION ALL SELECT * FROM (SELECT p_type, count(*) FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)", graph=False)
def run_summary(spark, sf_dir):
    from .plans.incremental import summary

    return summary(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "part").select(F.col("p_type").alias("reason")))


@registered("SELECT count(*) AS files, sum(loc)::BIGINT AS loc, sum(n_chars)::BIGINT AS nodes, count_if(doc_id % 7 = 0) AS with_errors, count_if(doc_id % 11 = 0) AS failed FROM (SELECT doc_id, n_chars, CASE WHEN text = '' THEN 0 ELSE len(text) - len(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS loc FROM documents)", graph=False)
def file_aggregates(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return query.file_aggregates(d.select(tx.line_count(F.col("text")).alias("loc"), F.col("n_chars").alias("node_count"), (F.col("doc_id") % 7 == 0).cast("int").alias("error_count"), F.lit(0).alias("missing_count"), (F.col("doc_id") % 11 != 0).alias("parse_ok")))


@registered(f"SELECT job, repo_id, state, ts FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS r FROM ({JOBS_SQL})) WHERE r = 1 AND job IN ('job-1', 'job-2', 'job-3')", graph=False)
def jobs_by_id(spark, sf_dir):
    return jobs.by_ids(_jobs(spark, sf_dir), ["job-1", "job-2", "job-3"]).select("job", "repo_id", "state", "ts")
