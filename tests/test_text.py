from pyspark.sql import functions as F

from graphloom.functions import language, text as tx
from graphloom.plans import jobs
from graphloom.streaming import jobs as job_stream

import pytest


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "want"), [
    ("https://u:pw123@h/x", "https://u:***@h/x"), ("api_key = 'abcdef1'", "api_key = '***'"), ("TOKEN: abcdefg", "TOKEN: ***"), ("token=abc", "token=abc"), ("Authorization: Bearer abcdefgh123", "Authorization: Bearer ***"), ("plain", "plain"),
])
def test_redact(spark, value, want):
    assert one(spark, value, tx.redact_secrets) == want


@pytest.mark.parametrize(("value", "want"), [("a/./b//c", "a/b/c"), ("a\\b", "a/b"), ("/a", None), ("C:/a", None), ("a/../b", None), ("a..b", "a..b")])
def test_paths(spark, value, want):
    assert one(spark, value, tx.repo_relative) == want


@pytest.mark.parametrize(("value", "want"), [("https://h/x", True), ("ftp://h/x", False), ("git@h:a/b", True), ("ext::x", False), ("-x", False), ("https://h/a b", False), ("", False)])
def test_git_urls(spark, value, want):
    assert one(spark, value, tx.git_url) is want


def test_small_functions(spark):
    assert one(spark, " Hello  World! ", tx.slug) == "hello-world" and one(spark, "!!", tx.slug) == "unnamed"
    assert one(spark, "a\x00\n b", tx.sanitize_label) == "a b"
    assert [one(spark, t, tx.line_count) for t in ("", "a", "a\n", "a\nb")] == [0, 1, 1, 2]
    assert one(spark, "pkg/tests/x.py", tx.is_test_path) and not one(spark, "pkg/contest.py", tx.is_test_path)
    assert one(spark, "python:a/b.py#C.f.method#1", tx.file_of_node) == "a/b.py"
    assert one(spark, " a, ,b", tx.split_list) == ["a", "b"] and one(spark, " , ", tx.split_list) is None
    assert one(spark, 'x ```json\n{"a": 1}\n``` y', tx.first_json_object) == '{"a": 1}' and one(spark, "none", tx.first_json_object) == "{}"
    assert one(spark, "*pkg.Name", tx.last_segment) == "Name"
    assert one(spark, '"""Doc\n  x."""', tx.clean_doc) == "Doc x."
    assert one(spark, "a TODO: fix\nb", tx.markers) == ["TODO: fix"]
    assert one(spark, "a\nb\nc\nd", lambda c: tx.snippet(c, F.lit(2))) == "b\nc\nd"
    assert tx.scrub_environment({"A": "1", "MY_TOKEN": "2"}) == {"A": "1"}


@pytest.mark.parametrize(("path", "want"), [("a/B.PY", "python"), ("Dockerfile", "dockerfile"), ("x.tsx", "tsx"), ("x.h", "c"), (".bashrc", "bash"), ("none", "unknown"), (".py", "unknown")])
def test_languages(spark, path, want):
    assert one(spark, path, language.detect) == want


def log(spark):
    rows = [(1, "j", 0.0, "running"), (2, "j", 0.05, "running"), (3, "j", 0.1, "running"), (4, "j", 0.16, "running"), (5, "j", 0.17, "done"), (6, "k", 0.0, "queued")]
    return spark.createDataFrame(rows, "event_id bigint, job string, s double, state string").select("event_id", "job", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint")).alias("ts"), "state", F.lit("r").alias("repo_id"))


def test_throttle(spark):
    assert [r.event_id for r in jobs.throttled(log(spark)).orderBy("event_id").collect()] == [1, 4, 5, 6]
    assert [r.event_id for r in jobs.throttled_by_gap(log(spark)).orderBy("event_id").collect()] == [1, 5, 6]
    assert {(r.job, r.state) for r in jobs.current(log(spark)).collect()} == {("j", "done"), ("k", "queued")}
    assert [r.job for r in jobs.active(log(spark)).collect()] == ["k"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "events")
    log(spark).write.parquet(src)
    stream = spark.readStream.schema(log(spark).schema).parquet(src)
    for name, df, mode in (("thin", job_stream.throttled(stream), "append"), ("states", job_stream.current_states(stream), "complete"), ("windows", job_stream.progress_windows(stream), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(90)
        assert q.exception() is None
    assert sorted(r.event_id for r in spark.sql("select * from thin").collect()) == [1, 4, 5, 6]
    assert {(r.job, r.state) for r in spark.sql("select * from states").collect()} == {("j", "done"), ("k", "queued")}
    assert sum(r.n for r in spark.sql("select * from windows").collect()) == 6
