"""Other languages, by the words that introduce definitions and imports; node ids of such files begin with `generic:`."""

from __future__ import annotations

import re

from .base import Extraction, Reader

DEFINES = {"fn": "function", "func": "function", "function": "function", "fun": "function", "def": "function", "sub": "function", "class": "class", "trait": "class", "impl": "class", "protocol": "class", "object": "class", "module": "class", "namespace": "class", "struct": "struct", "record": "struct", "enum": "enum", "interface": "interface", "const": "constant", "let": "variable", "var": "variable", "val": "variable"}
MEMBERS = ("class", "struct", "interface")
NO_CALL = frozenset("if for while switch catch return sizeof match fn func function def class struct new elif unless until foreach when".split())
IMPORT_LINE = re.compile(rb"^[ \t]*(?:pub[ \t]+)?(?:#[ \t]*include|use|using|import|require(?:_relative|_once)?|include(?:_once)?|source|mod)\b[ \t(]*([^;\n]+)", re.M)
C_FUNCTION = re.compile(r"^[A-Za-z_]\w*$")


def import_name(raw: str) -> str:
    """A module's name without quotes, brackets, aliases and lists."""
    text = raw.strip().rstrip(");").strip()
    text = re.sub(r"\s+as\s+\w+$", "", text)
    text = re.sub(r"^(?:static|type|func)\s+", "", text)
    text = re.split(r"[{=]", text)[0].rstrip(":.\\ ")
    return text.strip("\"'<> ")


def extract_generic(path: str, source: bytes, language: str = "generic") -> Extraction:
    r = Reader(path, "generic", source, hash_comments=language in ("ruby", "bash", "yaml", "php"))
    if language in ("json", "yaml", "html", "css"):
        return r.out
    for m in IMPORT_LINE.finditer(source):
        name = import_name(m[1].decode("utf-8", "replace"))
        if name:
            r.out.imported(name, r.lines.at(m.start()), end=r.lines.at(m.end()))
    ends = language in ("ruby",)

    def block(i: int, stop: int, scope: str | None, holder: str | None) -> None:
        while i < stop:
            t = r.text(i)
            if t in DEFINES and r.word(i + 1) and r.text(i - 1) not in (".", "::", "->", ":") and (holder not in ("enum", "function", "method") or DEFINES[t] == "function"):
                kind = DEFINES[t]
                at = i + 1 + (t in ("let", "const", "enum") and r.text(i + 1) in ("mut", "fn", "class"))
                if t == "const" and r.text(i + 1) == "fn":
                    kind = "function"
                while r.text(at + 1) in ("::", ".") and r.word(at + 2) and t in ("module", "namespace", "class"):
                    at += 2
                if t == "impl":
                    k = at
                    while k < stop and r.text(k) != "{":
                        if r.text(k) == "for" and r.word(k + 1):
                            at = k + 1
                        k += 1
                j = at + 1
                while j < stop and r.text(j) not in ("{", ";", "=") and not (ends and r.row(j) > r.row(at)) and not (r.text(j) == "}"):
                    j = r.close(j) + 1 if r.text(j) in ("(", "[") and r.tokens[j].match > j else j + 1
                has_body = r.text(j) == "{" and kind not in ("constant", "variable")
                end = r.close(j) if has_body else at
                if kind == "function" and holder in MEMBERS and language not in ("rust",):
                    kind = "method"
                name = r.text(at)
                if holder in ("function", "method") and kind in ("variable", "constant"):
                    i = at + 1
                    continue
                if t == "impl" and any(s["qualified"] == name for s in r.out.symbols):
                    block(j + 1, end, name, "class")
                    i = end + 1
                    continue
                own = r.out.symbol(kind, name, scope, r.start(i), r.end(end))
                if has_body and kind != "enum":
                    block(j + 1, end, own, kind)
                i = end + 1
            elif language in ("c", "cpp", "c_sharp", "java", "kotlin") and holder in (None, *MEMBERS) and r.word(i) and r.text(i + 1) == "(" and r.tokens[i + 1].match > 0 and r.text(r.close(i + 1) + 1) == "{" and (r.word(i - 1) or r.text(i - 1) in ("*", "&", ">", "]")):
                body = r.close(i + 1) + 1
                own = r.out.symbol("method" if holder in MEMBERS else "function", t, scope, r.start(max(i - 1, 0)), r.end(r.close(body)))
                block(body + 1, r.close(body), own, "function")
                i = r.close(body) + 1
            else:
                if r.word(i) and r.text(i + 1) == "(" and (scope or holder is None):
                    r.call(i, scope or "", ("self", "this"), NO_CALL)
                i += 1

    block(0, len(r.tokens), None, None)
    return r.out
