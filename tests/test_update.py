"""Updates of an index against whole runs; stored walks against walks over frames."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.extract import extract_files
from graphloom.functions.language import detect
from graphloom.operators import imports, traverse
from graphloom.plans import engine
from graphloom.plans.engine import Engine
from graphloom.storage import cut

FILES = {
    "app/core.py": "from .tools import render\nfrom app.extra import spare\nimport os\n\n\nclass Core:\n    def go(self):\n        return render(1)\n\n\ndef start():\n    return Core(), lonely()\n",
    "app/tools.py": "def render(x):\n    return x\n\n\ndef twice(x):\n    return render(render(x))\n",
    "app/other.py": "from . import tools\n\n\ndef far():\n    return tools.render(2), tools.twice(3)\n",
    "app/alone.py": "def lonely():\n    return 1\n",
    "app/tests/test_core.py": "from app.core import start\n\n\ndef test_start():\n    assert start()\n",
    "web/a.ts": "import { b } from './b';\nimport { far } from 'far-away';\nexport function a() { return b(); }\n",
    "web/b.ts": "export function b() { return 1; }\n",
    "go/x/x.go": "package x\n\nimport \"example.com/y\"\n\nfunc One() int {\n\treturn Two()\n}\n",
    "go/x/z.go": "package x\n\nfunc Two() int {\n\treturn 1\n}\n",
    "notes.md": "# nothing\n",
}


def table(spark, files, repo=None):
    rows = [(p, bytearray(t.encode()), None) for p, t in files.items()]
    df = spark.createDataFrame(rows, "path string, content binary, mtime timestamp")
    return df.withColumn("repo", F.lit(repo)) if repo else df


def parts(index):
    """All that an index says, but for seq and times."""
    rows = lambda df: sorted(tuple("" if v is None else str(v) for v in r) for r in df.collect())
    return {
        "edges": rows(index.edges.drop("seq")), "nodes": rows(index.nodes.select("repo", "id", "kind", "name", "qualified", "file", "sl", "el", "language")), "files": rows(index.files.select("repo", "path", "language", "sha256", "loc", "parse_ok", "node_count")),
        "references": rows(index.references.select("repo", "path", "at", "name", "target", "outcome")), "extractions": rows(index.extractions.select("repo", "path", "sha256")), "stats": rows(index.stats), "targets": rows(index.kept.targets), "outside": rows(index.kept.outside.select("repo", "src", "dst")),
        "symbols": rows(index.kept.symbols.rows.select("repo", "path", "id")),
    }


CHANGES = {
    "a body": ({"app/alone.py": "def lonely():\n    return 2\n"}, [], 1),
    "a new name elsewhere": ({"app/alone.py": "def lonely():\n    return 1\n\n\ndef spare():\n    return 1\n"}, [], None),
    "a second one of a lone name": ({"app/more.py": "def lonely():\n    return 3\n"}, [], None),
    "a name that goes": ({"app/tools.py": "def twice(x):\n    return x\n"}, [], None),
    "a file that is imported and was not there": ({"app/extra.py": "def spare():\n    return 1\n"}, [], None),
    "a file that goes": ({}, ["app/tools.py"], None),
    "scripts and packages": ({"web/b/index.ts": "export function b() { return 2; }\n", "go/y/y.go": "package y\n\nfunc Three() int {\n\treturn 3\n}\n"}, ["web/b.ts"], None),
    "nothing parsed": ({"notes.md": "# more\n", "new/notes.md": "x\n"}, [], None),
    "another language": ({"web/b.ts": "export const b = 1;\n", "app/alone.py": ""}, [], None),
}


EXTERNALS = {f"m{i}.py": f"import {m}\n" for i, m in enumerate(["aa", "aa", "aa", "bb", "bb", "cc"])}


def test_update_is_a_whole_run(spark, monkeypatch):
    """Each change in a repository of its own, beside one that stays as it is; names that change in one reach nothing in the others. Of modules outside two show, and others rise when they are imported more."""
    monkeypatch.setattr(engine, "MOST_EXTERNAL", 2)
    then, now = table(spark, FILES, "same"), table(spark, FILES, "same")
    for name, (more, gone, _) in CHANGES.items():
        then = then.unionByName(table(spark, FILES, name))
        now = now.unionByName(table(spark, {p: t for p, t in {**FILES, **more}.items() if p not in gone}, name))
    then, now = then.unionByName(table(spark, EXTERNALS, "out")), now.unionByName(table(spark, {**EXTERNALS, "m0.py": "import cc\n", "m6.py": "import cc\n"}, "out"))
    before = Engine(spark).index_table(then)
    after = Engine(spark).update_table(before, now)
    got, want = parts(after), parts(Engine(spark).index_table(now))
    assert {k: [x for x in got[k] if x not in want[k]][:3] for k in got} == {k: [] for k in got} and got == want
    assert {r.dst for r in after.edges.where("repo = 'out' and relation = 'imports'").collect()} == {"ext:aa", "ext:cc"}
    assert after.edges.count() == after.edges.select("seq").distinct().count() and Engine(spark).update_table(after, now) is after
    # What the update resolved anew, by repository.
    reached = Counter(r.repo for r in after.kept.referring.files.collect())
    assert "same" not in reached and all(n < len(FILES) for n in reached.values()) and all(reached[name] == n for name, (_, _, n) in CHANGES.items() if n)
    assert after.parsed == sum(p.endswith((".py", ".ts", ".go")) for more, _, _ in CHANGES.values() for p in more) + 2


def test_updates_on_updates(spark, monkeypatch):
    """Changes one after another, each made on what the last one gave, with tables written anew in between; and one that touches too much."""
    monkeypatch.setattr(engine, "MOST_LAYERS", 1)
    files = {**FILES, "app/alone.py": FILES["app/alone.py"] + "\n\ndef b():\n    return twice(1)\n"}
    index = Engine(spark).update_table(Engine(spark).index_table(table(spark, FILES)), table(spark, files))
    assert index.layers == 1
    files = {**files, "app/tools.py": "def lonely():\n    return 1\n"}
    del files["web/b.ts"]
    index = Engine(spark).update_table(index, table(spark, files))
    want = parts(Engine(spark).index_table(table(spark, files)))
    assert index.layers == 0 and parts(index) == want
    monkeypatch.setattr(engine, "MOST_TOUCHED", 0)
    again = Engine(spark).update_table(index, table(spark, {**files, "notes.md": "# new\n"}))
    assert again.layers == 0 and again.parsed == 0 and parts(again)["edges"] == want["edges"]


def test_hints_hold_every_target(spark):
    """Every resolved import has a word of its target."""
    found = cut(extract_files(table(spark, {**FILES, "web/my-dir/index.ts": "export function q() {}\n", "web/c.ts": "import { q } from './my-dir';\nimport x from './a';\n", "app/sub/__init__.py": "from .. import tools\nfrom . import low\n", "app/sub/low.py": "from ..core import start\nfrom . import *\n"}, "repo").withColumn("language", detect(F.col("path"), F.lit(None).cast("string")))), "found")
    words = {}
    for r in imports.hints(imports.import_rows(found)).collect():
        words.setdefault(r.path, set()).add(r.word)
    own = imports.resolve_imports(found).select("path", "target").distinct()
    pairs = [(r.path, r.target) for r in own.collect()]
    hints = {}
    for r in imports.path_hints(spark.createDataFrame([(t, t) for t in {t for _, t in pairs}], "repo string, path string")).collect():
        hints.setdefault(r.repo, set()).add(r.word)
    assert len(pairs) > 8 and all(hints[t] & words[p] for p, t in pairs)


# Stored walks.


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(4)
    ids = [f"n{i}" for i in range(120)] + ["alone"]
    rows = [(i, rng.choice(ids[:120]), rng.choice(ids[:120]), rng.choice(["calls", "imports"]), rng.choice(["EXTRACTED", "INFERRED"])) for i in range(260)]
    return rows, traverse.Stored.write(spark.createDataFrame(rows, "seq bigint, src string, dst string, relation string, confidence string"), 8), ids


def hops(rows, start, depth, direction="both", allowed=lambda relation, confidence: True):
    near = {}
    for _, a, b, relation, confidence in rows:
        if a != b and allowed(relation, confidence):
            near.setdefault(a, set()).update([b] if direction != "in" else [])
            near.setdefault(b, set()).update([a] if direction != "out" else [])
    found = dict.fromkeys(start, 0)
    for hop in range(1, depth + 1):
        for x in [x for x, h in found.items() if h == hop - 1]:
            for y in near.get(x, ()):
                found.setdefault(y, hop)
    return found, near


@pytest.mark.parametrize("held", [5000, 3])
def test_stored_walks(graph, monkeypatch, held):
    monkeypatch.setattr(traverse, "HELD", held)
    rows, stored, ids = graph
    ways = [({}, lambda r, c: True), ({"relations": ("CALLS",)}, lambda r, c: r == "calls"), ({"confidences": ("inferred",), "limit": 9}, lambda r, c: c == "INFERRED")]
    for k, (direction, (how, allowed)) in enumerate(zip(("both", "in", "out"), ways, strict=True)):
        want = sorted((h, i) for i, h in hops(rows, [ids[k], "alone"], 3, direction, allowed)[0].items())[: how.get("limit")]
        assert sorted((r.hop, r.id) for r in traverse.bfs(stored, [ids[k], "alone"], 3, direction, **how).collect()) == want
    assert traverse.bfs(stored, ["alone"], 4).collect()[0].id == "alone" and traverse.bfs(stored, [], 2).isEmpty()


def smallest_path(rows, start, goal, most):
    level, near = hops(rows, [start], most)
    if goal not in level:
        return []
    path = [goal]
    while path[-1] != start:
        path.append(min(x for x in near[path[-1]] if level.get(x) == level[path[-1]] - 1))
    return path[::-1]


@pytest.mark.parametrize(("held", "pairs"), [(5000, 12), (4, 2)])
def test_paths_from_both_ends(graph, monkeypatch, held, pairs):
    monkeypatch.setattr(traverse, "HELD", held)
    rows, stored, ids = graph
    rng = random.Random(held)
    for _ in range(pairs):
        a, b = rng.choice(ids), rng.choice(ids)
        assert [r.id for r in traverse.shortest_path(stored, a, b, 5).orderBy("hop").collect()] == smallest_path(rows, a, b, 5)
    assert [r.id for r in traverse.shortest_path(stored, "n1", "n1").collect()] == ["n1"] and traverse.shortest_path(stored, "n1", "alone").isEmpty()
    assert traverse.shortest_path(stored, "n1", "n2", 0).isEmpty()


def test_a_walk_reads_the_folders_of_its_frontier(graph):
    _, stored, _ = graph
    rows = stored.steps(["n1", "n2"], "out")
    assert rows.select(F.input_file_name().alias("f")).distinct().count() <= 2
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "In(src" in plan and plan.count("_bucket=") <= 2


def test_a_path_from_both_ends_reads_fewer_edges(spark):
    """On a wide tree of two ends, both searches together see a small part of what one sees."""
    rows = [(f"a{i}", f"a{(i - 1) // 6}") for i in range(1, 1000)] + [(f"b{i}", f"b{(i - 1) // 6}") for i in range(1, 1000)] + [("a0", "b0")]
    stored = traverse.Stored.write(spark.createDataFrame([(k, a, b, "calls", "EXTRACTED") for k, (a, b) in enumerate(rows)], "seq bigint, src string, dst string, relation string, confidence string"), 8)
    seen = []
    steps = traverse.Stored.steps

    def counted(self, frontier, *how):
        seen.append(len(frontier))
        return steps(self, frontier, *how)

    traverse.Stored.steps = counted
    try:
        path = [r.id for r in traverse.shortest_path(stored, "a900", "b900", 12).orderBy("hop").collect()]
    finally:
        traverse.Stored.steps = steps
    assert path[0] == "a900" and path[-1] == "b900" and "a0" in path and sum(seen) < 200
