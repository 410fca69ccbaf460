"""The pipeline against brute force, stage by stage, and on awkward rows."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import mixing, quality

from . import brute

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    good = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{DIR}/labels.parquet")).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in good]
    comp = brute.components({i: brute.fingerprint(t) for i, t, _ in rows})
    rows = [r for r in rows if comp[r[0]] == r[0]]
    cut = brute.removed_bytes([(i, t) for i, t, _ in rows])
    kept = {i: bytes(x for x, g in zip(*cut[i], strict=True) if not g).decode("utf-8", "ignore") for i in cut}
    rows = [(i, kept[i], s) for i, _, s in rows]
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, _ in brute.leaks([(i, t) for i, t, _ in rows], items)}
    rows = [r for r in rows if r[0] not in bad]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    want = sorted(con.execute(mixing.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, DIR).collect()) == want


def test_stages_on_awkward_rows(spark, tmp_path):
    rows = [(1, "a fine text of some words " * 20, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (3, "", "en", "s", 0), (4, "a fine text of some words " * 20, "en", "t", 1), (None, "no id but a text", "en", "s", 3), (5, "an item of the benchmark as it stands", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("stats", F.lit("clash")).withColumn("marks", F.array(F.lit(1)))
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "an item of the benchmark as it stands")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            if k + 1 < len(corpus_pipeline.STAGES):
                assert now.columns == docs.columns, name
                now.write.parquet(out := str(tmp_path / f"{name}-{empty}"))
                now = spark.read.schema(now.schema).parquet(out)
        assert (now.count() == 0) is empty
        assert empty or 5 not in {r.doc_id for r in now.collect()}


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "test_items", "mixing"]
