"""Java, by tokens and matched brackets."""

from __future__ import annotations

from .base import MOST_TYPE_USES, Extraction, Reader

NO_CALL = frozenset("if for while switch catch synchronized return try new super this assert throw do else".split())
MODIFIERS = frozenset("public private protected static final abstract synchronized native transient volatile strictfp default sealed non".split())
KINDS = {"class": "class", "interface": "interface", "enum": "enum", "record": "struct"}


class _Java:
    def __init__(self, r: Reader):
        self.r, self.out, self.uses = r, r.out, 0

    def type_use(self, i: int, scope: str | None) -> None:
        r = self.r
        if r.word(i) and r.text(i)[:1].isupper() and self.uses < MOST_TYPE_USES:
            self.uses += 1
            self.out.reference(r.text(i), "type_uses", r.start(i), r.end(i), scope)

    def body(self, i: int, stop: int, scope: str) -> None:
        r = self.r
        while i < stop:
            if r.text(i) == "new" and r.word(i + 1):
                j = i + 1
                while r.text(j + 1) == "." and r.word(j + 2):
                    j += 2
                full = r.span(i + 1, j)
                self.out.reference(r.text(j), "instantiates", r.start(i + 1), r.end(j), scope, full.rpartition(".")[0], full)
                i = j + 1
                continue
            if r.word(i) and r.text(i + 1) == "(":
                r.call(i, scope, ("this",), NO_CALL)
            elif r.word(i) and r.word(i + 1) and r.text(i) not in NO_CALL and r.text(i - 1) != ".":
                self.type_use(i, scope)
            i += 1

    def declaration(self, first: int, i: int, parent: str | None) -> int:
        """A class, interface, enum or record whose keyword is at i."""
        r = self.r
        name = r.text(i + 1)
        own = f"{parent}.{name}" if parent else name
        j, kind = i + 2, None
        held = []
        while j < len(r.tokens) and r.text(j) not in ("{", ";"):
            t = r.text(j)
            if t in ("extends", "implements", "permits"):
                kind = t
            elif t == "<":
                depth = 0
                while j < len(r.tokens):
                    depth += (r.text(j) == "<") - (r.text(j) == ">")
                    if depth == 0:
                        break
                    j += 1
            elif t == "(":
                j = r.close(j)
            elif kind in ("extends", "implements") and r.word(j) and r.text(j + 1) != ".":
                held.append((kind, j))
            j += 1
        end = r.close(j) if r.text(j) == "{" else j
        self.out.symbol(KINDS[r.text(i)], name, parent, r.start(first), r.end(min(end, len(r.tokens) - 1)))
        for kind, k in held:
            self.out.reference(r.text(k), kind, r.start(k), r.end(k), own)
        if r.text(j) == "{":
            k = j + 1
            if r.text(i) == "enum":
                while k < end and r.text(k) != ";":
                    k = r.close(k) + 1 if r.text(k) in ("(", "{") else k + 1
                k += 1
            self.members(k, end, own, name)
        return end + 1

    def members(self, i: int, stop: int, own: str, name: str) -> None:
        r = self.r
        while i < stop:
            first, final, static = i, False, False
            while i < stop and (r.text(i) in MODIFIERS or r.text(i) == "@"):
                final, static = final or r.text(i) == "final", static or r.text(i) == "static"
                if r.text(i) == "@" and r.text(i + 1) != "interface":
                    i += 2
                    while r.text(i) == ".":
                        i += 2
                    i = r.close(i) + 1 if r.text(i) == "(" else i
                else:
                    i += 1
            if i >= stop:
                break
            if r.text(i) in KINDS and r.word(i + 1) and r.text(i + 2) != "=":
                i = self.declaration(first, i, own)
                continue
            if r.text(i) in ("{", ";"):
                if r.text(i) == "{":
                    self.body(i + 1, r.close(i), own)
                i = r.close(i) + 1 if r.text(i) == "{" else i + 1
                continue
            j = i
            while j < stop and r.text(j) not in ("(", "=", ";", "{"):
                j = r.close(j) + 1 if r.text(j) == "[" and r.tokens[j].match > j else j + 1
            at = j - 1
            while at > i and not r.word(at):
                at -= 1
            if r.text(j) == "(":
                close = r.close(j)
                k = close + 1
                while k < stop and r.text(k) not in ("{", ";"):
                    k += 1
                end = r.close(k) if r.text(k) == "{" else k
                method = self.out.symbol("method", r.text(at), own, r.start(first), r.end(min(end, len(r.tokens) - 1)))
                for x in (*range(i, at), *range(j + 1, close)):
                    self.type_use(x, method)
                if r.text(k) == "{":
                    self.body(k + 1, end, method)
                i = end + 1
            else:
                end = j
                while end < stop and r.text(end) != ";":
                    end = r.close(end) + 1 if r.text(end) in ("(", "{", "[") and r.tokens[end].match > end else end + 1
                if r.word(at):
                    for x in range(i, at):
                        self.type_use(x, own)
                    self.out.symbol("constant" if final and static and r.text(at).isupper() else "variable", r.text(at), own, r.start(at), r.end(at))
                    self.body(j, end, own)
                i = end + 1


def extract_java(path: str, source: bytes, language: str = "java") -> Extraction:
    r = Reader(path, "java", source)
    own, i = _Java(r), 0
    while i < len(r.tokens):
        t = r.text(i)
        if t == "import":
            j = i + 1 + (r.text(i + 1) == "static")
            k = j
            while k < len(r.tokens) and r.text(k) != ";":
                k += 1
            module = r.span(j, k - 1) if k > j else ""
            r.out.imported(module.removesuffix(".*"), r.start(i), ["*"] if module.endswith(".*") else [])
            i = k + 1
        elif t in KINDS and r.word(i + 1) and r.text(i - 1) != ".":
            first = i
            while first > 0 and (r.text(first - 1) in MODIFIERS):
                first -= 1
            i = own.declaration(first, i, None)
        else:
            i += 1
    return r.out
