"""TypeScript and JavaScript, by tokens and matched brackets."""

from __future__ import annotations

from .base import Extraction, Reader

MODIFIERS = frozenset("public private protected static readonly abstract override async declare export default get set accessor".split())
NO_CALL = frozenset("if for while switch catch function return typeof await new super import constructor of in do else yield delete void throw".split())


class _Script:
    def __init__(self, r: Reader):
        self.r, self.out, self.done = r, r.out, set()

    def run(self) -> None:
        self.block(0, len(self.r.tokens), "", False)

    def block(self, i: int, stop: int, scope: str, in_class: bool) -> None:
        while i < stop:
            i = self.member(i, stop, scope) if in_class else self.statement(i, stop, scope)

    def heritage(self, i: int, own: str) -> int:
        """extends and implements up to the body's brace; its place."""
        r, kind = self.r, None
        while i < len(r.tokens) and r.text(i) not in ("{", ";"):
            t = r.text(i)
            if t in ("extends", "implements"):
                kind = t
            elif kind and r.word(i):
                j = i
                while r.text(j + 1) == "." and r.word(j + 2):
                    j += 2
                full = r.span(i, j)
                self.out.reference(r.text(j), kind, r.start(i), r.end(j), own, full.rpartition(".")[0], full)
                i = j
            elif t == "<":
                depth = 0
                while i < len(r.tokens):
                    depth += (r.text(i) == "<") - (r.text(i) == ">")
                    if depth <= 0:
                        break
                    i += 1
            elif t == "(":
                i = r.close(i)
            i += 1
        return i

    def statement(self, i: int, stop: int, scope: str) -> int:
        r, out, t = self.r, self.out, self.r.text(i)
        before = r.text(i - 1)
        if not r.word(i):
            return i + 1
        if before in (".", "?."):
            self.maybe_call(i, scope)
            return i + 1
        if t == "import" and r.text(i + 1) not in ("(", "."):
            return self.imports(i, stop)
        if t in ("class", "interface", "enum") and r.word(i + 1):
            name = r.text(i + 1)
            kind = t
            body = self.heritage(i + 2, f"{scope}.{name}" if scope else name)
            end = r.close(body) if r.text(body) == "{" else body
            own = out.symbol(kind, name, scope or None, r.start(i), r.end(end))
            if kind == "class":
                self.block(body + 1, end, own, True)
            return end + 1
        if t == "type" and r.word(i + 1) and r.text(i + 2) in ("=", "<"):
            j = i + 2
            while j < stop and r.text(j) != ";" and not (r.row(j) > r.row(j - 1) and r.text(j - 1) not in ("=", "|", "&", "{", ",") and r.text(j) not in ("|", "&", "=")):
                j = r.close(j) + 1 if r.text(j) in ("{", "(", "[") else j + 1
            out.symbol("type", r.text(i + 1), scope or None, r.start(i), r.end(j - 1))
            return j
        if t == "function" and (r.word(i + 1) or r.text(i + 1) == "*"):
            at = i + 1 + (r.text(i + 1) == "*")
            return self.function(i, at, "function", scope) if r.word(at) else i + 1
        if t in ("const", "let", "var") and r.word(i + 1):
            return self.variable(i, stop, scope)
        if t == "new" and r.word(i + 1):
            j = i + 1
            while r.text(j + 1) == "." and r.word(j + 2):
                j += 2
            full = r.span(i + 1, j)
            out.reference(r.text(j), "instantiates", r.start(i + 1), r.end(j), scope, full.rpartition(".")[0], full)
            return j + 1
        self.maybe_call(i, scope)
        return i + 1

    def maybe_call(self, i: int, scope: str) -> None:
        r = self.r
        if r.text(i + 1) == "(" and i not in self.done:
            r.call(i, scope, ("this",), NO_CALL)

    def expression(self, i: int, stop: int, scope: str) -> None:
        while i < stop:
            i = self.statement(i, stop, scope)

    def function(self, first: int, at: int, kind: str, scope: str) -> int:
        """A function whose name is at `at`; parameters and body follow."""
        r = self.r
        j = at + 1
        while j < len(r.tokens) and r.text(j) != "(":
            j += 1
        j = r.close(j) + 1 if j < len(r.tokens) else j
        while j < len(r.tokens) and r.text(j) not in ("{", ";") and not (r.text(j) == "}"):
            j += 1
        end = r.close(j) if r.text(j) == "{" else j
        own = self.out.symbol(kind, r.text(at), scope or None, r.start(first), r.end(min(end, len(r.tokens) - 1)))
        if r.text(j) == "{":
            self.block(j + 1, end, own, False)
        return end + 1

    def variable(self, i: int, stop: int, scope: str) -> int:
        r, name, at = self.r, self.r.text(i + 1), i + 1
        j = i + 2
        depth = 0
        while j < stop and not (r.text(j) == "=" and depth == 0) and r.text(j) != ";" and not (r.row(j) > r.row(at) and r.text(j) not in ("=", ":")):
            depth += (r.text(j) == "<") - (r.text(j) == ">")
            j = r.close(j) + 1 if r.text(j) in ("(", "[", "{") else j + 1
        if r.text(j) != "=":
            self.out.symbol("variable", name, scope or None, r.start(at), r.end(at))
            return j
        k = j + 1 + (r.text(j + 1) == "async")
        arrow = -1
        if r.text(k) == "function":
            arrow = k
        elif r.text(k) == "(":
            m = r.close(k) + 1
            while m < stop and r.text(m) not in ("=>", ";", "{", "=") and r.row(m) == r.row(k - 1) if m < stop else False:
                m += 1
            arrow = m if r.text(m) == "=>" else -1
        elif r.word(k) and r.text(k + 1) == "=>":
            arrow = k + 1
        if arrow < 0:
            self.out.symbol("constant" if r.text(i) == "const" and name.isupper() else "variable", name, scope or None, r.start(at), r.end(at))
            return j + 1
        body = arrow + 1
        while r.text(arrow) == "function" and body < stop and r.text(body) != "{":
            body = r.close(body) + 1 if r.text(body) == "(" else body + 1
        if r.text(body) == "{":
            end = r.close(body)
            own = self.out.symbol("function", name, scope or None, r.start(i), r.end(end))
            self.block(body + 1, end, own, False)
            return end + 1
        end = body
        while end < stop and r.text(end) not in (";", ",") and not (end > body and r.row(end) > r.row(end - 1)):
            end = r.close(end) + 1 if r.text(end) in ("(", "[", "{") else end + 1
        own = self.out.symbol("function", name, scope or None, r.start(i), r.end(end - 1))
        self.expression(body, end, own)
        return end

    def member(self, i: int, stop: int, scope: str) -> int:
        """A member of a class."""
        r = self.r
        first = i
        if r.text(i) == "@":
            i += 2
            while r.text(i) == ".":
                i += 2
            return r.close(i) + 1 if r.text(i) == "(" else i
        while r.text(i) in MODIFIERS and r.text(i + 1) not in ("(", "=", ":", ";", "?"):
            i += 1
        i += r.text(i) in ("*", "#")
        if not r.word(i):
            return r.close(i) + 1 if r.text(i) in ("{", "(", "[") else i + 1
        j = i + 1 + (r.text(i + 1) in ("?", "!"))
        if r.text(j) in ("(", "<"):
            return self.function(first, i, "method", scope)
        self.out.symbol("variable", r.text(i), scope, r.start(i), r.end(i))
        while j < stop and r.text(j) != ";" and not (r.row(j) > r.row(j - 1) and r.text(j - 1) not in ("=", ",", ":", "|", "&", "=>") and r.text(j) not in (".", "?", "|", "&")):
            if r.text(j) == "new" or r.word(j):
                self.statement(j, stop, scope) if r.text(j) == "new" else self.maybe_call(j, scope)
            j = r.close(j) + 1 if r.text(j) in ("(", "[", "{") else j + 1
        return j + (r.text(j) == ";")

    def imports(self, i: int, stop: int) -> int:
        r, names, alias, j = self.r, [], None, i + 1
        while j < stop and r.tokens[j].kind != "string":
            t = r.text(j)
            if t == "*" and r.text(j + 1) == "as":
                alias = r.text(j + 2)
                j += 2
            elif t == "{":
                k, end = j + 1, r.close(j)
                while k < end:
                    if r.word(k) and r.text(k) != "type":
                        names.append(r.text(k))
                        if r.text(k + 1) == "as":
                            if alias is None:
                                alias = r.text(k + 2)
                            k += 2
                    k += 1
                j = end
            elif r.word(j) and t not in ("from", "type"):
                names.append(t)
            elif t in (";", "="):
                return j + 1
            j += 1
        if j < stop:
            self.out.imported(r.text(j).strip("\"'`"), r.start(i), names, alias)
        return j + 1


def extract_typescript(path: str, source: bytes, language: str = "typescript") -> Extraction:
    r = Reader(path, language, source)
    _Script(r).run()
    return r.out
