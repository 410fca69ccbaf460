"""The graph of the tables: what a query makes of it, and what it leaves alone."""

import os

import pytest

from pyspark.sql import functions as F

from graphloom import storage
from graphloom.operators import analyze, traverse
from graphloom.sources import tables
from graphloom.sources.tables import StoredGraph, table_graph

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture
def written(monkeypatch):
    """The names of the tables that are written to the shared folder."""
    names = []
    real = storage.fresh_path
    monkeypatch.setattr(storage, "fresh_path", lambda spark, name: names.append(name) or real(spark, name))
    return names


def test_scans_write_nothing_and_walks_their_own_direction(spark, written):
    g = StoredGraph(table_graph(spark, DIR))
    assert analyze.import_graph(g.nodes, g.edges).count() > 0 and g.edges.where("relation = 'calls'").count() > 0 and written == [] and g.stands
    found = traverse.induced(g.walks, traverse.bfs(g.walks, ["customer:2"], 1, "out", ("calls",)))
    assert found.count() > 0 and written == ["edges-out"] and g.stands
    assert sorted(map(tuple, g.edges.collect())) == sorted(map(tuple, table_graph(spark, DIR).edges.collect()))
    traverse.bfs(g.walks, ["supplier:1"], 1, "in").count()
    assert written == ["edges-out", "edges-in"]
    g.walks.drop()
    assert not g.stands


def test_a_query_leaves_out_the_edges_it_does_not_ask_for(spark):
    plan = StoredGraph(table_graph(spark, DIR)).edges.where("relation = 'contains'")._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan


def test_imports_are_summed_by_nation_alone(spark):
    """Lines summed by customer and supplier are nearly as many as lines, in the memory of one task."""
    plan = table_graph(spark, DIR).edges.where("relation = 'imports'")._jdf.queryExecution().optimizedPlan().toString()
    sums = [line for line in plan.splitlines() if "Aggregate" in line]
    assert sums and all("custkey" not in line and "suppkey" not in line for line in sums)


def test_induced_by_more_ids_than_are_held(spark, monkeypatch):
    g = StoredGraph(table_graph(spark, DIR), 4)
    ids = traverse.bfs(g.walks, ["customer:2"], 1, "out", ("calls",))
    few = sorted(map(tuple, traverse.induced(g.walks, ids).collect()))
    monkeypatch.setattr(traverse, "HELD", 1)
    assert few and sorted(map(tuple, traverse.induced(g.walks, ids).select(*g.walks.out.schema.names).collect())) == few
    assert traverse.induced(g.walks, ids.where("id is null")).isEmpty()


def test_ties_are_dealt_out_before_they_are_summed(spark):
    """What is summed before a shuffle is held by the task that reads a file's block, however much that is."""
    nodes = spark.createDataFrame([(x, "function") for x in "abc"] + [("f", "file")], "id string, kind string")
    edges = [(k, "a", "b", "calls" if k % 2 else "instantiates") for k in range(1000)] + [(1, "b", "a", "calls"), (5, "c", "b", "type_uses"), (6, "c", "f", "calls"), (7, "c", "c", "calls")]
    found = analyze.symbol_subgraph(nodes, spark.createDataFrame(edges, "seq bigint, src string, dst string, relation string"))
    assert sorted(map(tuple, found.collect())) == [("a", "b", 2.0), ("b", "c", 1.0)]
    lines = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    last = max(i for i, line in enumerate(lines) if "Aggregate" in line)
    assert any("REBALANCE" in line for line in lines[last:])
