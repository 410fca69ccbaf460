import os

from graphloom.sources.targets import checkout, fetch, index_root, locate, repo_id, slug
from graphloom.sources.tree import IgnoreFile, Limits, limited, scan_table

import pytest


def test_scan_keeps_and_skips(index):
    kept = {r.path: r.language for r in index.files.collect()}
    assert kept["script"] == "python" and kept[".env.example"] == "unknown" and kept["pyapp/__init__.py"] == "python" and kept[".gitignore"] == "unknown"
    why = {r.path: r.reason for r in index.skipped.collect()}
    assert why == {"app.log": "gitignore", "secret.txt": "gitignore", ".env": "secrets", "package-lock.json": "generated", "node_modules": "skip_dir", "logo.png": "binary", "big.py": "too_large", "link.py": "symlink"}


def test_file_metrics(index):
    row = index.files.where("path = 'pyapp/helpers.py'").first()
    assert (row.loc, row.size, row.parse_ok, row.error_count) == (5, 58, True, 0)


@pytest.mark.parametrize(("lines", "path", "is_dir", "want"), [
    (["*.log"], "a/b.log", False, True), (["/top.txt"], "a/top.txt", False, False), (["build/"], "build", True, True), (["build/"], "build", False, False), (["build/"], "build/x.c", False, True),
    (["*.log", "!keep.log"], "keep.log", False, False), (["a/**/b"], "a/x/y/b", False, True), (["a/**"], "a/x", False, True), (["[ab].c"], "b.c", False, True), (["# no"], "# no", False, False), (["doc?.md"], "docs.md", False, True),
])
def test_ignore_patterns(lines, path, is_dir, want):
    assert IgnoreFile(lines).ignores(path, is_dir) is want


def test_limits_keep_the_file_that_passes(spark):
    df = spark.createDataFrame([(f"f{i}", 10) for i in range(6)], "path string, size bigint")
    assert limited(df, Limits(files=3)).count() == 4
    assert limited(df, Limits(total_bytes=25)).count() == 3


def test_tables_are_read_whole(spark):
    """More files than a tree may have, with and without repositories."""
    from pyspark.sql import functions as F

    df = spark.range(20_011).select(F.format_string("f%06d.txt", "id").alias("path"), F.encode(F.lit("x"), "UTF-8").alias("content"), F.lit(None).cast("timestamp").alias("mtime"))
    assert scan_table(df).files.count() == scan_table(df.withColumn("repo", F.lit("r"))).files.count() == 20_011
    sized = df.select("path", F.lit(10).alias("size"))
    assert limited(sized, Limits(files=None, total_bytes=25)).count() == 3 and limited(sized, Limits(files=7, total_bytes=None)).count() == 8


def test_scan_of_a_table(spark):
    df = spark.createDataFrame([("a.py", bytearray(b"x = 1\n"), None), ("b.bin", bytearray(b"\0"), None), ("dist/c.js", bytearray(b""), None), ("d.min.js", bytearray(b"1"), None)], "path string, content binary, mtime timestamp")
    scan = scan_table(df)
    assert [r.path for r in scan.files.collect()] == ["a.py"]
    assert {r.path: r.reason for r in scan.skipped.collect()} == {"b.bin": "binary", "dist/c.js": "skip_dir", "d.min.js": "generated"}


def test_targets(tmp_path):
    place = locate("owner/name")
    assert (place.address, place.owner, place.name) == ("https://github.com/owner/name.git", "owner", "name")
    assert locate("git@host.org:a/b.git").host == "host.org" and locate("ssh://u@h.org:22/x/y/z.git").names == ("x", "y", "z")
    assert locate(str(tmp_path)).folder == str(tmp_path.resolve()) and repo_id(locate(str(tmp_path))).startswith("local-")
    assert repo_id(place).startswith("github.com__owner__name@head-") and repo_id(place) != repo_id(locate("owner/name", "v1"))
    assert slug("  A b/ c! ") == "a-b-c"
    for bad in ("", "ext::sh -c x", "file:///etc", "-x/y", "/no/such/dir", "a b/c", "https:///x", "@h:p", "a/b/c"):
        with pytest.raises(ValueError):
            locate(bad)


def test_refs_and_subdirectories(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").symlink_to("/")
    assert index_root(locate(str(tmp_path), subdir="./in/"), "") == str((tmp_path / "in").resolve())
    for ref, subdir in (("-x", None), ("a b", None), (None, "../x"), (None, "/x"), (None, "c:\\x"), (None, "a/../b")):
        with pytest.raises(ValueError):
            locate(str(tmp_path), ref, subdir)
    with pytest.raises(ValueError):
        index_root(locate(str(tmp_path), subdir="out/etc"), "")


def test_fetch_makes_a_shallow_copy_once(tmp_path):
    calls = []

    def run(command, **more):
        calls.append((command, more))
        os.makedirs(os.path.join(command[-1], ".git"))

    place = locate("owner/name", "v1")
    at = fetch(place, str(tmp_path), run)
    assert at == fetch(place, str(tmp_path), run) == checkout(place, str(tmp_path)) and len(calls) == 1
    command, more = calls[0]
    assert command[-3:] == ["--", place.address, at] and ["--branch", "v1"] == command[-5:-3] and more["env"]["GIT_TERMINAL_PROMPT"] == "0"


def test_ignore_files_of_a_table(spark):
    texts = [(".gitignore", "*.log\n/tmp/\n"), ("a.log", "x"), ("a/.gitignore", "!b.log\nc.py\n"), ("a/b.log", "x"), ("a/c.py", "x"), ("c.py", "x"), ("tmp/x/y.py", "x"), ("a/tmp/y.py", "x")]
    for repos in (None, ("one", "two")):
        rows = [(r, p, bytearray(t.encode()), None) for r in repos or ("one",) for p, t in texts if r == "one" or p != ".gitignore"]
        df = spark.createDataFrame(rows, "repo string, path string, content binary, mtime timestamp")
        scan = scan_table(df if repos else df.drop("repo"))
        why = {(r.repo if repos else "one", r.path): r.reason for r in scan.skipped.collect()}
        # A rule of the root holds below, a file of rules deeper down leaves out more.
        assert {p: x for (r, p), x in why.items() if r == "one"} == {"a.log": "gitignore", "a/b.log": "gitignore", "a/c.py": "gitignore", "tmp/x/y.py": "gitignore_dir"}
        assert {p for r, p in why if r == "two"} == ({"a/c.py"} if repos else set())


def test_a_scan_without_limits_reads_large_files(spark):
    df = spark.createDataFrame([("a.txt", bytearray(b"x" * (2 << 20)), None)], "path string, content binary, mtime timestamp")
    assert scan_table(df, Limits(None, None, None)).files.first().size == 2 << 20 and scan_table(df).skipped.first().reason == "too_large"
