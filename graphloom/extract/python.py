"""Python, by the standard parser; files that it rejects are read line by line.

Expression statements and assignments are not searched for calls, nor are decorators, defaults and annotations; a
function inside a method is a method. Published resolution rates count references this way.
"""

from __future__ import annotations

import ast
import re

from .base import MOST_VARIABLES, Extraction

LOOSE = re.compile(r"^(\s*)(?:async\s+)?(class|def)\s+(\w+)|^\s*(?:from\s+(\.*)([\w.]*)\s+import\s+(.+)|import\s+(.+))")


def clean_doc(text: str | None) -> str | None:
    return " ".join(text.split())[:400] if text else None


class _Visitor:
    def __init__(self, out: Extraction, source: bytes):
        self.out, self.lines, self.variables = out, source.split(b"\n"), 0

    def text(self, node: ast.AST) -> str:
        a, b, c, d = node.lineno - 1, node.col_offset, node.end_lineno - 1, node.end_col_offset
        if a == c:
            return self.lines[a][b:d].decode("utf-8", "replace")
        return b"\n".join([self.lines[a][b:], *self.lines[a + 1 : c], self.lines[c][:d]]).decode("utf-8", "replace")

    @staticmethod
    def span(node: ast.AST) -> tuple[tuple[int, int], tuple[int, int]]:
        return (node.lineno - 1, node.col_offset), (node.end_lineno - 1, node.end_col_offset)

    def body(self, nodes, scope: str, holder: str, where: str) -> None:
        for n in nodes:
            self.visit(n, scope, holder, where)

    def visit(self, n: ast.AST, scope: str, holder: str, where: str) -> None:
        out = self.out
        if isinstance(n, ast.ClassDef):
            own = out.symbol("class", n.name, scope or None, *self.span(n), clean_doc(ast.get_docstring(n, clean=False)))
            for b in n.bases:
                full = self.text(b).split("[")[0].strip()
                *before, name = full.split(".")
                if full:
                    out.reference(name, "extends", *self.span(b), own, ".".join(before), full)
            self.body(n.body, own, own, "class")
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            own = out.symbol("method" if holder else "function", n.name, scope or None, *self.span(n), clean_doc(ast.get_docstring(n, clean=False)))
            self.body(n.body, own, holder, "function")
        elif isinstance(n, ast.Import):
            for a in n.names:
                out.imported(a.name, self.span(n)[0], alias=a.asname, end=self.span(n)[1])
        elif isinstance(n, ast.ImportFrom):
            alias = n.names[0].asname
            out.imported(n.module or "", self.span(n)[0], [a.name.split(".")[-1] for a in n.names], alias, n.level, self.span(n)[1])
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            left = n.targets[0] if isinstance(n, ast.Assign) else n.target
            if where != "function" and isinstance(left, ast.Name) and self.variables < MOST_VARIABLES:
                self.variables += 1
                out.symbol("constant" if left.id.isupper() else "variable", left.id, scope or None, *self.span(left))
        elif isinstance(n, (ast.Expr, ast.AugAssign)):
            return
        else:
            if isinstance(n, ast.Call):
                self.call(n, scope)
            for child in ast.iter_child_nodes(n):
                self.visit(child, scope, holder, where)

    def call(self, n: ast.Call, scope: str) -> None:
        f = n.func
        if isinstance(f, ast.Name):
            self.out.reference(f.id, "call", *self.span(f), scope)
        elif isinstance(f, ast.Attribute):
            receiver = self.text(f.value)
            self.out.reference(f.attr, "call", *self.span(f), scope, receiver, self.text(f), receiver in ("self", "cls"))


def loose(out: Extraction, text: str) -> None:
    """Definitions and imports of a file that does not parse, by indentation."""
    open_: list[tuple[int, str, str]] = []
    for row, line in enumerate(text.split("\n")):
        m = LOOSE.match(line)
        if not m:
            continue
        if m[3]:
            while open_ and open_[-1][0] >= len(m[1]):
                open_.pop()
            parent = open_[-1][1] if open_ else None
            kind = "class" if m[2] == "class" else "method" if any(k == "class" for _, _, k in open_) else "function"
            open_.append((len(m[1]), out.symbol(kind, m[3], parent, (row, len(m[1])), (row, len(line.encode()))), kind))
        elif m[7]:
            for part in m[7].split(","):
                name, _, alias = part.partition(" as ")
                out.imported(name.strip(), (row, 0), alias=alias.strip() or None)
        else:
            names = [x.partition(" as ") for x in m[6].strip("() \\").split(",") if x.strip()]
            out.imported(m[5], (row, 0), [a.strip() for a, _, _ in names], (names[0][2].strip() or None) if names else None, len(m[4]))


def extract_python(path: str, source: bytes, language: str = "python") -> Extraction:
    out = Extraction(path, "python")
    source = source.removeprefix(b"\xef\xbb\xbf").replace(b"\r\n", b"\n")
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        out.error_count = 1
        loose(out, source.decode("utf-8", "replace"))
        return out
    out.node_count = sum(1 for _ in ast.walk(tree))
    _Visitor(out, source).body(tree.body, "", "", "module")
    return out
