"""Imports of whole packages stay a row each until their pairs are asked for; workers hand on what they made in pieces."""

from pyspark.sql import functions as F

from graphloom.extract import FILES_AT_ONCE, extract_files
from graphloom.operators import imports
from graphloom.plans.engine import Engine


def test_a_package_is_not_listed_before_it_is_read(spark):
    files = spark.range(12).select(F.format_string("app/n1/f%02d.go", "id").alias("path"), F.encode(F.format_string('package n1\n\nimport "x/app/n1"\n\nfunc work_%d() int {\n\treturn work_%d()\n}\n', "id", (F.col("id") + 1) % 12), "UTF-8").alias("content"), F.lit(None).cast("timestamp").alias("mtime"))
    index = Engine(spark).index_table(files)
    found = imports.resolved_imports(index.extractions)
    assert found.grouped.count() == 12 and found.single.isEmpty() and found.rows.count() == 144
    pairs = index.edges.where("relation = 'imports'")
    assert pairs.count() == pairs.select("src", "dst").distinct().count() == pairs.select("seq").distinct().count() == 144
    assert index.edges.where("relation = 'calls' and confidence = 'INFERRED'").count() == 12
    plan = index.edges.where("relation = 'calls'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 2


def test_many_files_in_one_batch(spark):
    n = 2 * FILES_AT_ONCE + 3
    files = spark.range(n).coalesce(1).select(F.format_string("f%d.py", "id").alias("path"), F.lit("python").alias("language"), F.encode(F.lit("def a():\n    pass\n"), "UTF-8").alias("content"))
    assert extract_files(files).where("size(symbols) = 1").count() == n


def mixed(spark, n=4):
    """Packages of Go and Java, scripts and Python, some of which import themselves or others at several places."""
    rows = [(f"go/a/f{i}.go", f'package a\n\nimport "x/go/a"\nimport "x/go/b"\n\nfunc W{i}() int {{\n\treturn W{(i + 1) % n}()\n}}\n') for i in range(n)]
    rows += [(f"go/b/g{i}.go", f'package b\n\nimport "fmt"\nimport "x/go/a"\n\nfunc G{i}() int {{\n\treturn 1\n}}\n') for i in range(2)]
    rows += [(f"app/j/B{i}.java", f"package app.j;\n\nimport app.j.B{(i + 1) % n};\nimport app.j.B{i};\nimport app.k.C;\n\npublic class B{i} {{\n}}\n") for i in range(n)]
    rows += [("app/k/C.java", "package app.k;\n\nimport app.k.C;\nimport java.util.List;\n\npublic class C {\n}\n")]
    rows += [("p/a.py", "import os\nfrom . import b\nfrom .b import x\nfrom p.b import y\nimport os\n"), ("p/b.py", "from .a import z\n"), ("p/__init__.py", ""), ("w/a.ts", "import { b } from './b';\nimport c from 'far';\n"), ("w/b.ts", "export function b() {}\n")]
    return spark.createDataFrame([(p, bytearray(t.encode()), None) for p, t in rows], "path string, content binary, mtime timestamp")


def test_imports_are_counted_without_listing_their_places(spark):
    index = Engine(spark).index_table(mixed(spark))
    count = lambda df: sorted(map(tuple, df.groupBy("repo", "src", "dst").agg(F.count("*").alias("n")).collect()))
    want, got = count(index.edges.where("relation = 'imports'")), index.import_counts
    assert sorted(map(tuple, got.collect())) == want and max(r[3] for r in want) > 1 and any(r[1] == r[2] for r in want)
    # Above the join that lists the pairs of packages nothing is shuffled or summed.
    plan = imports.inside_counts(imports.import_rows(index.extractions), imports.resolved_imports(index.extractions)).where("n > 0")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "Join" in line and "lot#" in line)
    assert not any(word in line for line in lines[:at] for word in ("Aggregate", "Join", "Repartition"))


def test_an_index_makes_what_it_is_asked_for(spark, monkeypatch):
    from graphloom.plans import engine

    made, real = [], engine.cut
    monkeypatch.setattr(engine, "cut", lambda df, name: made.append(name) or real(df, name))
    index = Engine(spark).index_table(mixed(spark))
    assert made == ["scan", "extracted"]
    assert index.import_counts.count() > 0 and not {"edges", "nodes", "files"} & set(made)


def test_what_an_update_reaches_does_not_depend_on_its_size(spark, monkeypatch):
    from graphloom.plans import engine

    then = {"a.py": "def one():\n    return 1\n", "b.py": "from .a import one\n\n\ndef two():\n    return one()\n", "c.py": "def three():\n    return 3\n"}
    table = lambda files: spark.createDataFrame([(p, bytearray(t.encode()), None) for p, t in files.items()], "path string, content binary, mtime timestamp")
    before, now = Engine(spark).index_table(table(then)), table({**then, "a.py": "def other():\n    return 1\n"})
    found = []
    for most in (5_000, 0):
        monkeypatch.setattr(engine, "MOST_TOUCHED", most)
        after = Engine(spark).update_table(before, now)
        found.append((after.parsed, after.touched))
    assert found == [(1, 2), (1, 2)]
