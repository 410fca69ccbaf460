"""Groups that grow by the ties that gain most, and their numbers."""

from pyspark.sql import functions as F

from graphloom.operators import analyze
from graphloom.storage import placed


def test_groups_grow_while_joining_gains(spark):
    """Rings of 64 come together in few rounds; two that no tie joins never do, and no pair of groups is left that would gain."""
    ties = spark.range(192).select(F.col("id").alias("a"), (F.floor(F.col("id") / 64) * 64 + (F.col("id") + 1) % 64).alias("b"), F.lit(2.0).alias("w"))
    ties = ties.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    found = analyze.agglomerated(ties, 0.8)
    of = {r.id: r.label for r in found.collect()}
    assert of.keys() == set(range(192)) and all(of[i] // 64 == i // 64 for i in of)
    above = analyze.contracted(ties, found)
    assert analyze.agglomerated(above, 0.8).where("id != label").isEmpty()
    assert analyze.modularity(ties, found, 0.8) > 0.7


def test_hubs_take_their_leaves_in_one_round(spark, monkeypatch):
    cuts = []
    real = analyze.cut
    monkeypatch.setattr(analyze, "cut", lambda df, name: cuts.append(name) or real(df, name))
    ties = spark.range(1, 1001).select(F.lit(0).cast("bigint").alias("a"), F.col("id").alias("b"), F.lit(2.0).alias("w"))
    assert analyze.agglomerated(ties, 0.8).select("label").distinct().count() == 1 and cuts.count("gains") == 2


def test_numbers_follow_the_order_of_ids(spark):
    ids = spark.range(5000).select(F.format_string("x%05d", "id").alias("id")).repartition(7)
    assert placed(ids, ["id"], "n").where(F.col("n") != F.substring("id", 2, 5).cast("bigint")).isEmpty()


def test_ties_are_made_once_and_between_numbers(spark, monkeypatch):
    """The check of communities goes over the numbered ties that they were found by."""
    from graphloom import queries
    from graphloom.sources.tables import Graph

    nodes = spark.createDataFrame([(f"x{i}", "function") for i in range(12)] + [("f", "file"), ("lone", "class")], "id string, kind string")
    pairs = [(a, b) for g in (0, 6) for a in range(g, g + 6) for b in range(a + 1, g + 6)] + [(0, 6)]
    rows = [(i, f"x{a}", f"x{b}", "calls") for i, (a, b) in enumerate(pairs)] + [(99, "x1", "x0", "type_uses"), (100, "f", "x1", "calls"), (101, "x2", "x2", "calls")]
    graph = Graph(nodes, spark.createDataFrame(rows, "seq bigint, src string, dst string, relation string"))
    numbers, ties = analyze.numbered_subgraph(graph.nodes, graph.edges)
    name = {r.n: r.id for r in numbers.collect()}
    assert [name[n] for n in sorted(name)] == sorted(name.values()) and dict(ties.dtypes)["a"] == "bigint"
    want = sorted(map(tuple, analyze.symbol_subgraph(graph.nodes, graph.edges).collect()))
    assert sorted((name[r.a], name[r.b], r.w) for r in ties.collect()) == want and ("x0", "x1", 1.0) in want
    monkeypatch.setattr(queries, "stored_graph", lambda spark, sf_dir: graph)
    made, real = [], analyze.last_ties
    monkeypatch.setattr(analyze, "last_ties", lambda rows: made.append(rows) or real(rows))
    assert queries.communities_connected(spark, "").collect()[0].parts_too_many == 0 and len(made) == 1
    found = {r.id: r.community for r in queries.communities(spark, "").collect()}
    assert len(found) == 12 and all(found[f"x{i}"] == found[f"x{i // 6 * 6}"] for i in range(12)) and found["x0"] != found["x6"]
