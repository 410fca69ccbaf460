"""Stored trees, gram search, connected communities and layers."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from graphloom.extract.base import cst_rows, lex
from graphloom.operators import analyze, build, cst, query
from graphloom.operators.grams import Grams, asked


def sources(spark, texts):
    return spark.createDataFrame([("r", p, bytearray(t.encode())) for p, t in texts.items()], "repo string, path string, content binary").withColumn("sha256", F.sha2("content", 256))


def test_trees_with_problems():
    kinds = lambda text: [(r[0], r[3], r[4], r[5], r[6]) for r in cst_rows(text)]
    assert kinds(b"f(a]") == [("", "source", 0, 4, 2), ("0", "word", 0, 1, 0), ("1", "group (", 1, 4, 3), ("1.0", "word", 2, 3, 0), ("1.1", "ERROR", 3, 4, 0), ("1.2", "MISSING )", 4, 4, 0)]
    assert kinds(b"(a [b) c") == [("", "source", 0, 8, 2), ("0", "group (", 0, 6, 2), ("0.0", "word", 1, 2, 0), ("0.1", "group [", 3, 5, 2), ("0.1.0", "word", 4, 5, 0), ("0.1.1", "MISSING ]", 5, 5, 0), ("1", "word", 7, 8, 0)]
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("()[]{}a ") for _ in range(rng.randint(0, 30))).encode()
        rows, (tokens, unclosed) = cst_rows(text), lex(text)
        assert sum(r[3] == "ERROR" for r in rows) == sum(t.text in ")]}" and t.match < 0 for t in tokens) and sum(r[3].startswith("MISSING") for r in rows) == unclosed
        numbered = cst.numbered(rows)
        at = {r[0]: r for r in numbered}
        for r in numbered:
            below = [x for x in numbered if x[0] == r[0] or not r[0] or x[0].startswith(r[0] + ".")]
            assert (r[8], r[9], r[10]) == (below[0][8], below[-1][8], r[0].count(".") + 1 if r[0] else 0) and len(below) == r[9] - r[8] + 1
            assert r[1] is None or at[r[1]][4] <= r[4] <= r[5] <= at[r[1]][5]


def test_stored_trees(spark):
    texts = {f"f{i}.ts": f"f{i}(a, [b, c]); g({i})" for i in range(40)}
    trees = cst.Trees.write(sources(spark, texts), 8)
    plain = cst.syntax_trees(sources(spark, texts))
    for path, node, depth in (("f3.ts", "", 2), ("f5.ts", "1.2", 1), ("f5.ts", "9", 1), ("none.ts", "", 3)):
        got, want = (sorted(map(tuple, x.collect())) for x in (trees.slice(path, node, depth), cst.subtree(plain, path, node, depth)))
        assert got == want
    rows = trees.table.of(["f3.ts"])
    assert rows.select(F.input_file_name()).distinct().count() == 1 and "EqualTo(path,f3.ts)" in rows._jdf.queryExecution().executedPlan().toString()
    now = {**texts, "f3.ts": "x(", "new.ts": "y)"}
    del now["f4.ts"]
    after = trees.refreshed(sources(spark, now))
    assert after.table.fresh.select("path").distinct().count() == 2
    assert sorted(map(tuple, after.table.rows.select("path", "node_path", "type").collect())) == sorted(map(tuple, cst.interval_trees(sources(spark, now)).select("path", "node_path", "type").collect()))
    assert sorted(map(tuple, cst.problems(after.table.rows).collect())) == [("r", "f3.ts", 0, 1), ("r", "new.ts", 1, 0)]
    assert after.slice("f4.ts").isEmpty() and after.slice("f3.ts", "1").count() == 2


def test_gram_search_is_search(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("abAB_%.É\\") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    nodes = spark.createDataFrame([(f"n{i}", rng.choice(["class", "function", "repo"]), x, x[::-1], rng.choice([None, x * 2])) for i, x in enumerate(names)], "id string, kind string, name string, qualified string, file string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i * i % 150}") for i in range(150)], "src string, dst string")
    degree = build.degrees(nodes, edges)
    grams = Grams.write(nodes, degree, 4)
    for needle in ("ab", "A_b", "b%a", " aB ", "É", "\\\\", "a", "%", "", "abab", "."):
        got, want = ([(r.id, r.degree) for r in x.collect()] for x in (grams.search(needle, ("class", "function"), 30), query.search(nodes, degree, needle, ("class", "function"), 30)))
        assert got == want, needle
    assert asked("a_bcd%ef") == ["a", "bcd", "ef"] and asked("%_") == []
    plan = grams.search("ab")._jdf.queryExecution().optimizedPlan().toString()
    assert "gram" in plan


def test_nodes_of_equal_texts_are_listed_once(spark):
    nodes = spark.createDataFrame([(f"n{i:03}", "method", "hot bolt", "hot bolt", None if i % 2 else "a/b") for i in range(400)] + [("x", "method", "bolt", "bolt", None)], "id string, kind string, name string, qualified string, file string")
    grams = Grams.write(nodes, nodes.select("id", F.lit(1).alias("degree")), 4)
    assert grams.postings.rows.where("gram = 'bol'").count() == 3 and grams.counts.of(["bol"]).first()["n"] == 401
    assert grams.search("OT B", limit=1000).count() == 400 and [r.id for r in grams.search("/", limit=2).collect()] == ["n000", "n002"]


def test_communities_are_cut_where_nothing_ties_them(spark):
    ties = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("c", "d"), ("f", "g")], "a string, b string")
    labels = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "1"), ("e", "1"), ("f", "3"), ("g", "3"), ("h", "3")], "id string, label string")
    assert {r.id: r.label for r in analyze.connected_parts(labels, ties).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d", "f": "f", "g": "f", "h": "h"}


def test_layers(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "d"), ("e", "d"), ("x", "x")]
    found = {r.node: (r.component, r.layer) for r in analyze.layers(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert found == {"a": ("a", 0), "b": ("b", 1), "c": ("b", 1), "d": ("d", 2), "e": ("e", 0), "x": ("x", 0)}
