"""Go, by tokens and matched brackets."""

from __future__ import annotations

from .base import MOST_TYPE_USES, Extraction, Reader

NO_CALL = frozenset("if for switch select func return go defer case range map chan struct interface".split())
SELF = ("s", "self")


def extract_go(path: str, source: bytes, language: str = "go") -> Extraction:
    r = Reader(path, "go", source)
    out, n, i = r.out, len(r.tokens), 0
    uses = 0

    def type_use(k: int, scope: str | None) -> None:
        nonlocal uses
        if r.word(k) and r.text(k)[:1].isupper() and uses < MOST_TYPE_USES:
            uses += 1
            out.reference(r.text(k), "type_uses", r.start(k), r.end(k), scope)

    def body(k: int, stop: int, scope: str) -> None:
        while k < stop:
            if r.word(k) and r.text(k + 1) == "(":
                r.call(k, scope, SELF, NO_CALL)
            elif r.word(k) and r.text(k + 1) == "{" and r.text(k)[:1].isupper():
                first = k - 2 if r.text(k - 1) == "." and r.word(k - 2) else k
                out.reference(r.text(k), "instantiates", r.start(first), r.end(k), scope, r.text(first) if first < k else None, r.span(first, k))
            k += 1

    def group(k: int, each) -> int:
        """`each(place)` for every spec of a declaration, bracketed or not; the place after it."""
        if r.text(k) == "(":
            end, k, row = r.close(k), k + 1, -1
            while k < end:
                if r.row(k) != row and (r.text(k - 1) not in (",",)):
                    each(k)
                row = r.row(k)
                k = r.close(k) + 1 if r.text(k) in ("(", "{", "[") and r.tokens[k].match > k else k + 1
            return end + 1
        each(k)
        return k + 1

    def imported(k: int) -> None:
        j = k
        while j < n and r.tokens[j].kind != "string" and r.row(j) == r.row(k):
            j += 1
        if j < n and r.tokens[j].kind == "string":
            out.imported(r.text(j).strip('"`'), r.start(k), alias=r.text(k) if j > k and r.word(k) else None)

    def declared(kind: str):
        def put(k: int) -> None:
            while r.word(k):
                if r.text(k) != "_":
                    out.symbol(kind, r.text(k), None, r.start(k), r.end(k))
                if r.text(k + 1) != ",":
                    break
                k += 2

        return put

    def typed(k: int) -> None:
        if not r.word(k):
            return
        j = k + 1
        if r.text(j) == "[" and r.word(j + 1) and r.word(j + 2):
            j = r.close(j) + 1
        j += r.text(j) == "="
        what = r.text(j)
        end = r.close(j + 1) if what in ("struct", "interface") and r.text(j + 1) == "{" else j
        own = out.symbol(what if what in ("struct", "interface") else "type", r.text(k), None, r.start(k), r.end(end))
        for x in range(j + 2, end):
            first = r.text(x - 1) in ("{", ";") or r.row(x) > r.row(x - 1)
            if r.text(x + 1) != "(" and (not first or what == "interface" or not r.word(x + 1)):
                type_use(x, own)

    while i < n:
        t = r.text(i)
        if t == "import":
            i = group(i + 1, imported)
        elif t in ("const", "var"):
            j = group(i + 1, declared("constant" if t == "const" else "variable"))
            body(i + 1, min(j, n), "")
            i = j
        elif t == "type":
            start = i
            i = group(i + 1, typed)
            if r.text(start + 1) != "(":
                k = start + 1
                while k < n and r.row(k) == r.row(start):
                    k = r.close(k) + 1 if r.text(k) in ("{", "(", "[") and r.tokens[k].match > k else k + 1
                i = max(i, k)
        elif t == "func":
            k, holder = i + 1, None
            if r.text(k) == "(":
                end = r.close(k)
                names = [r.text(x) for x in range(k + 1, end) if r.word(x)]
                bracket = next((x for x in range(k + 1, end) if r.text(x) == "["), None)
                names = [r.text(x) for x in range(k + 1, bracket or end) if r.word(x)]
                holder, k = (names[-1] if names else None), end + 1
            name_at = k
            while k < n and r.text(k) != "(":
                k += 1
            params_end = r.close(k) if k < n else n - 1
            j = params_end + 1
            while j < n and r.text(j) != "{" and r.row(j) == r.row(params_end):
                j = r.close(j) + 1 if r.text(j) in ("(", "[") and r.tokens[j].match > j else j + 1
            end = r.close(j) if r.text(j) == "{" else min(j, n) - 1
            own = out.symbol("method" if holder else "function", r.text(name_at), holder, r.start(i), r.end(end))
            for x in range(k + 1, min(j, n)):
                type_use(x, own)
            body(j + 1, end, own)
            i = end + 1
        else:
            i += 1
    return out
