from graphloom.extract import extract_source

import pytest


def facts(language: str, source: str, path: str = "f"):
    e = extract_source(path, language, source.encode())
    return {(s["kind"], s["qualified"]) for s in e.symbols}, {(r["kind"], r["receiver"], r["name"], r["scope"]) for r in e.references}, {(i["module"], tuple(i["names"]), i["alias"], i["level"]) for i in e.imports}, e


def test_python():
    s, r, i, e = facts("python", 'import os\nimport json as js\nfrom . import sibling\nfrom ..pkg import helper as hp\nclass Engine(Base, metaclass=M):\n    """Doc  text."""\n    LIMIT = 1\n    def run(self):\n        x = os.getcwd()\n        return self.step(os.path.join("a"))\n    def step(self):\n        def inner():\n            return 1\n        if helper():\n            pass\nx = y = 2\n')
    assert s == {("class", "Engine"), ("constant", "Engine.LIMIT"), ("method", "Engine.run"), ("method", "Engine.step"), ("method", "Engine.step.inner"), ("variable", "x")}
    assert r == {("extends", None, "Base", "Engine"), ("call", "self", "step", "Engine.run"), ("call", "os.path", "join", "Engine.run"), ("call", None, "helper", "Engine.step")}
    assert i == {("os", (), None, 0), ("json", (), "js", 0), ("", ("sibling",), None, 1), ("pkg", ("helper",), "hp", 2)}
    assert next(x for x in e.symbols if x["name"] == "Engine")["doc"] == "Doc text."


def test_python_ordinals_and_broken_source():
    _, _, _, e = facts("python", "def f(): pass\ndef f(): pass\n")
    assert [x["ordinal"] for x in e.symbols] == [0, 1]
    s, _, i, e = facts("python", "import os\nclass A:\n  def f(self):\n    return (\n")
    assert s == {("class", "A"), ("method", "A.f")} and i == {("os", (), None, 0)} and e.error_count == 1 and not e.errors


def test_typescript():
    s, r, i, _ = facts("typescript", "import d, { a as b } from './x';\nexport interface O { k: string }\nenum C { R }\ntype T = string;\nexport const MAX = 3;\nconst f = (x: number) => g(x);\nclass W extends ns.Base implements O {\n  name = 'n';\n  constructor() { super(); this.go(); }\n  go(): void { const z = new Other(); z.run(); }\n}\n")
    assert {("interface", "O"), ("enum", "C"), ("type", "T"), ("constant", "MAX"), ("function", "f"), ("class", "W"), ("variable", "W.name"), ("method", "W.constructor"), ("method", "W.go"), ("variable", "W.go.z")} == s
    assert {("call", None, "g", "f"), ("extends", "ns", "Base", "W"), ("implements", None, "O", "W"), ("call", "this", "go", "W.constructor"), ("instantiates", None, "Other", "W.go"), ("call", "z", "run", "W.go")} == r
    assert i == {("./x", ("d", "a"), "b", 0)}


def test_go():
    s, r, i, _ = facts("go", 'package m\nimport "fmt"\nconst N = 1\ntype S struct { n T }\nfunc (s *S) Run(w W) { s.help(); fmt.Println() }\nfunc main() { x := S{}; x.Run(nil) }\n')
    assert s == {("constant", "N"), ("struct", "S"), ("method", "S.Run"), ("function", "main")}
    assert {("call", "s", "help", "S.Run"), ("call", "fmt", "Println", "S.Run"), ("instantiates", None, "S", "main"), ("type_uses", None, "W", "S.Run"), ("type_uses", None, "T", "S")} <= r
    assert i == {("fmt", (), None, 0)}


def test_java():
    s, r, i, _ = facts("java", "import a.b.C;\nimport a.u.*;\npublic class A extends B implements D {\n  private static final int MAX = 1;\n  public A() { this.f(); }\n  String f(G g) { return new H().k(); }\n}\n")
    assert s == {("class", "A"), ("constant", "A.MAX"), ("method", "A.A"), ("method", "A.f")}
    assert {("extends", None, "B", "A"), ("implements", None, "D", "A"), ("call", "this", "f", "A.A"), ("instantiates", None, "H", "A.f"), ("type_uses", None, "G", "A.f")} <= r
    assert i == {("a.b.C", (), None, 0), ("a.u", ("*",), None, 0)}


def test_generic():
    s, _, i, e = facts("rust", "use std::collections::HashMap;\nstruct Config { a: i32 }\nimpl Config { fn new() -> Config { make() } }\nfn main() {}\n")
    assert s == {("struct", "Config"), ("function", "Config.new"), ("function", "main")} and ("std::collections::HashMap", (), None, 0) in i and e.language == "generic"
    s, _, i, _ = facts("c", "#include <stdio.h>\nint add(int a) { return sum(a); }\n")
    assert s == {("function", "add")} and i == {("stdio.h", (), None, 0)}


@pytest.mark.parametrize("language", ["python", "typescript", "go", "java", "rust", "c", "ruby", "php"])
@pytest.mark.parametrize("source", ["", "(((", "class {", "func (", "\ufeffx", "'", '"""', "import", "}" * 50, "a.b.", "new", "\x00\xff"])
def test_never_raises(language, source):
    assert extract_source("f", language, source.encode("utf-8")).errors == []


def test_limits(monkeypatch):
    import time

    import graphloom.extract as extract

    monkeypatch.setitem(extract.EXTRACTORS, "slow", lambda p, s, x: time.sleep(5))
    assert extract.extract_source("f", "slow", b"", 0.05).error == "parse_timeout"
    monkeypatch.setitem(extract.EXTRACTORS, "broken", lambda p, s, x: 1 / 0)
    assert extract.extract_source("f", "broken", b"").errors == ["ZeroDivisionError: division by zero"]
    assert extract.extract_source("f", "python", b"#" * (1 << 21)).error == "too_large"
    assert extract.extract_source("f", "markdown", b"").error == "no_grammar"
