"""What all extractors share: results, positions and a lexer for languages with braces."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from dataclasses import dataclass, field

MOST_VARIABLES = 200
MOST_TYPE_USES = 300


@dataclass
class Extraction:
    """Symbols, references and imports of one file."""

    path: str
    language: str
    symbols: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    parse_ok: bool = True
    error: str | None = None
    node_count: int = 0
    error_count: int = 0
    missing_count: int = 0
    ordinals: Counter = field(default_factory=Counter)

    def symbol(self, kind: str, name: str, parent: str | None, start, end, doc: str | None = None) -> str:
        """Adds a symbol; its qualified name. Equal names of one kind are numbered."""
        qualified = f"{parent}.{name}" if parent else name
        self.symbols.append({"kind": kind, "name": name, "qualified": qualified, "start": point(start), "end": point(end), "parent": parent, "doc": doc, "ordinal": self.ordinals[qualified, kind]})
        self.ordinals[qualified, kind] += 1
        return qualified

    def reference(self, name: str, kind: str, start, end, scope: str | None, receiver: str | None = None, full: str | None = None, own: bool = False) -> None:
        self.references.append({"name": name, "kind": kind, "start": point(start), "end": point(end), "scope": scope or None, "receiver": receiver or None, "full": full or name, "self_receiver": own})

    def imported(self, module: str, start, names=(), alias: str | None = None, level: int = 0, end=None) -> None:
        self.imports.append({"module": module, "start": point(start), "end": point(end) if end else None, "names": list(names), "alias": alias, "level": level})


def point(at) -> dict:
    return {"row": at[0], "col": at[1]}


class Lines:
    """Places in UTF-8 text as (row, column in bytes), both from 0."""

    def __init__(self, source: bytes):
        self.starts = [0, *(m.end() for m in re.finditer(b"\n", source))]
        self.size = len(source)

    def at(self, offset: int) -> tuple[int, int]:
        offset = max(0, min(offset, self.size))
        row = bisect.bisect_right(self.starts, offset) - 1
        return row, offset - self.starts[row]


@dataclass(slots=True)
class Token:
    """A word, number, string or sign, by byte offsets; `match` is the other end of a bracket."""

    kind: str
    text: str
    start: int
    end: int
    match: int = -1


TOKEN = re.compile(
    rb"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z))|(?P<number>\d[\w.]*)|(?P<word>[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)|(?P<sign>=>|::|->|\.\.\.|\?\.|:=|[^\s\w])",
    re.S,
)
HASH_COMMENT = re.compile(rb"#[^\n]*")


def lex(source: bytes, hash_comments: bool = False) -> tuple[list[Token], int]:
    """Tokens without space and comments, brackets matched; and how many brackets were opened and not closed."""
    out: list[Token] = []
    at, open_, unclosed = 0, [], 0
    pairs = {")": "(", "]": "[", "}": "{"}
    while at < len(source):
        m = HASH_COMMENT.match(source, at) if hash_comments else None
        m = m or TOKEN.match(source, at)
        if not m:
            at += 1
            continue
        at = m.end()
        kind = m.lastgroup
        if kind in (None, "space", "comment"):
            continue
        text = m[0].decode("utf-8", "replace")
        token = Token(kind, text, m.start(), m.end())
        if kind == "sign" and text in "([{":
            open_.append(len(out))
        elif kind == "sign" and text in pairs:
            while open_ and out[open_[-1]].text != pairs[text]:
                open_.pop()
                unclosed += 1
            if open_:
                token.match = open_.pop()
                out[token.match].match = len(out)
        out.append(token)
    return out, unclosed + len(open_)


class Reader:
    """A file's tokens with helpers for extractors."""

    def __init__(self, path: str, language: str, source: bytes, hash_comments: bool = False):
        self.source, self.lines = source, Lines(source)
        self.tokens, unclosed = lex(source, hash_comments)
        lone = sum(t.kind == "sign" and t.text in ")]}" and t.match < 0 for t in self.tokens)
        self.out = Extraction(path, language, node_count=len(self.tokens) + 1, error_count=lone, missing_count=unclosed)

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def start(self, i: int) -> tuple[int, int]:
        return self.lines.at(self.tokens[i].start)

    def end(self, i: int) -> tuple[int, int]:
        return self.lines.at(self.tokens[min(i, len(self.tokens) - 1)].end)

    def close(self, i: int) -> int:
        """The token that closes the bracket at i; the last one where it is missing."""
        return self.tokens[i].match if self.tokens[i].match >= 0 else len(self.tokens) - 1

    def span(self, i: int, j: int) -> str:
        return self.source[self.tokens[i].start : self.tokens[j].end].decode("utf-8", "replace")

    def row(self, i: int) -> int:
        return self.start(i)[0]

    def call(self, i: int, scope: str, own: tuple[str, ...], skip: frozenset[str]) -> None:
        """A call where the word at i is followed by `(`; the receiver is the dotted name before it."""
        name = self.text(i)
        first, receiver = i, None
        k = i - 1
        while k >= 1 and self.text(k) in (".", "?.", "::", "->"):
            if self.word(k - 1):
                k -= 1
            elif self.text(k - 1) in (")", "]") and self.tokens[k - 1].match >= 0:
                k = self.tokens[k - 1].match
                if not self.word(k - 1):
                    break
                k -= 1
            else:
                break
            first = k
            k -= 1
        if first < i:
            receiver = self.source[self.tokens[first].start : self.tokens[i - 2].end].decode("utf-8", "replace")
        elif name in skip:
            return
        self.out.reference(name, "call", self.start(first), self.end(i), scope, receiver, self.span(first, i), receiver in own)


CLOSERS = {"(": ")", "[": "]", "{": "}"}


def cst_rows(source: bytes) -> list[tuple[str, str, int, str, int, int, int, str | None]]:
    """A flattened syntax tree: node_path, parent_path, ord, type, start, end, children, text (of leaves).

    A closing bracket without an opening one is a leaf ERROR. Where a group is closed by what stands around it, or by the
    end, its last child is an empty MISSING node of the bracket that was due, and the group ends there.
    """
    tokens, _ = lex(source)
    rows: list[list] = [["", None, 0, "source", 0, len(source), 0, None]]
    stack = [(0, -1)]  # rows of open groups, and the tokens that opened them

    def add(kind: str, start: int, end: int, text: str | None) -> None:
        top = rows[stack[-1][0]]
        rows.append([f"{top[0]}.{top[6]}" if top[0] else str(top[6]), top[0], top[6], kind, start, end, 0, text])
        top[6] += 1

    def close_above(opener: int, end: int) -> None:
        while stack[-1][1] > opener:
            row, i = stack[-1]
            add(f"MISSING {CLOSERS[tokens[i].text]}", end, end, "")
            stack.pop()
            rows[row][5] = end

    for i, t in enumerate(tokens):
        sign = t.text if t.kind == "sign" else ""
        if sign in CLOSERS.values() and t.match >= 0:
            close_above(t.match, tokens[i - 1].end)
            rows[stack.pop()[0]][5] = t.end
        elif sign in CLOSERS.values() and sign:
            add("ERROR", t.start, t.end, t.text)
        elif sign in CLOSERS and sign:
            add(f"group {sign}", t.start, t.end, None)
            stack.append((len(rows) - 1, i))
        else:
            add(t.kind, t.start, t.end, t.text)
    close_above(-1, tokens[-1].end if tokens else 0)
    return [tuple(r) for r in rows]
