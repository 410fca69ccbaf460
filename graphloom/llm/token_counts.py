"""Token counts by a compiled finite-state transducer for byte-pair encodings with word ends.

The encoding of a word prefix ends in one token, and two neighbouring tokens are either compatible or not,
whatever stands around them. So what follows a prefix depends on a bounded past: the longest suffix that may
still begin a token, the last token at each place inside that suffix, and the counts there. Those pasts are the
states of a deterministic transducer; each transition carries the number of tokens it emits (negative where a
merge takes tokens back). States are compiled when first reached and shared by all words of a Python worker.

A piece of more than CHUNK bytes is cut into chunks. Each chunk is run from the start state by itself, and becomes a
map from the state in which it is entered to the state in which it is left and the tokens emitted: another entry
is followed until it meets the chunk's own run, from where both go on alike, which is soon. Maps are joined in a tree,
as a prefix scan does; joining is associative.

Case, composed letters, white space and letter classes are the library's: Python's tables are used for the characters
on which both were found to agree, and the library's normalizer and pre-tokenizer decide on the others. White space stays
white space and joins nothing, so texts are cut at it before, and only runs that were not met before are made normal.

Texts are read in parts of about PART characters that begin with white space, which no token crosses, and the pieces of
a part are counted one by one; so a long text takes a few times its own memory at most, also where it is one word. Nulls
and empty texts have no tokens. Rows are independent: repeated rows give equal counts, other columns are neither read
nor returned, and an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import slices

#: Unicode white space, as the tokenizer's normalizer folds it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + WHITE + r"\p{L}\p{N}]+")
WHITES = regex.compile(f"[{WHITE}]+")
ODD_WHITE = re.compile("[\x1c-\x1f]")
BREAK = regex.compile("[ \\n\\t\\r]")
PART, CHUNK = 1 << 20, 1 << 12
#: Bytes of a piece whose chunk maps are held at once.
GROUP = 1 << 18
#: Where the caches of a worker are emptied, and the longest run that is kept in one.
MOST_STATES, MOST_FITS, MOST_WORDS, LONGEST_RUN = 200_000, 300_000, 600_000, 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Transducer:
    """Counts the tokens of a word; `step` and `end` are the transitions, compiled on demand."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str = "</w>"):
        self.rank = {m: i for i, m in enumerate(merges)}
        self.suffix = suffix
        self.alphabet = byte_alphabet()
        bodies = {a + b for a, b in merges} | set(self.alphabet) | {x + suffix for x in self.alphabet}
        self.inner = {t for t in bodies if not t.endswith(suffix)}
        self.final = {t.removesuffix(suffix) for t in bodies if t.endswith(suffix)}
        self.prefixes = {t[:i] for t in self.inner | self.final for i in range(1, len(t) + 1)}
        self.reset()

    def reset(self) -> None:
        self.fits: dict[tuple[str, str, bool], bool] = {}
        # A state: the suffix that may begin a token, then for each place in it, nearest first, the last token and the count relative to here.
        self.keys: list[tuple[str, tuple, tuple]] = [("", (None,), (0,))]
        self.number = {self.keys[0]: 0}
        self.next: list[dict[str, tuple[int, int]]] = [{}]
        self.ends: list[int | None] = [0]

    def merged(self, symbols: list[str]) -> list[str]:
        """The encoding by definition: the pair of lowest rank merges first."""
        rank = self.rank
        while len(symbols) > 1:
            pairs = [rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:], strict=False)]
            if (best := min(pairs)) == 1 << 60:
                break
            a, b = symbols[i := pairs.index(best)], symbols[i + 1]
            out, j = [], 0
            while j < len(symbols):
                if j + 1 < len(symbols) and symbols[j] == a and symbols[j + 1] == b:
                    out.append(a + b)
                    j += 2
                else:
                    out.append(symbols[j])
                    j += 1
            symbols = out
        return symbols

    def compatible(self, before: str | None, token: str, final: bool) -> bool:
        """Whether the two tokens, side by side, are their own encoding."""
        key = (before or "", token, final)
        if (known := self.fits.get(key)) is None:
            symbols = [*(before or ""), *token]
            if final:
                symbols[-1] += self.suffix
            if len(self.fits) >= MOST_FITS:
                self.fits.clear()
            known = self.fits[key] = self.merged(symbols) == ([before] if before else []) + [token + self.suffix * final]
        return known

    def compile_step(self, state: int, char: str) -> tuple[int, int]:
        suffix, last, count = self.keys[state]
        for d in range(len(suffix), -1, -1):
            token = suffix[len(suffix) - d :] + char
            if token in self.inner and self.compatible(last[d], token, False):
                break
        else:
            raise ValueError(f"no token ends in {suffix + char!r}")
        emitted = count[d] + 1
        whole = suffix + char
        while whole and whole not in self.prefixes:
            whole = whole[1:]
        n = len(whole)
        to = self.intern((whole, (token, *last[:n]), (0, *(c - emitted for c in count[:n]))))
        self.next[state][char] = (to, emitted)
        return to, emitted

    def intern(self, key: tuple) -> int:
        """The number of a state."""
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
            self.ends.append(None)
        return to

    def step(self, state: int, byte: int) -> tuple[int, int]:
        char = self.alphabet[byte]
        return self.next[state].get(char) or self.compile_step(state, char)

    def compile_end(self, state: int) -> int:
        suffix, last, count = self.keys[state]
        for d in range(len(suffix), 0, -1):
            token = suffix[len(suffix) - d :]
            if token in self.final and self.compatible(last[d], token, True):
                self.ends[state] = count[d] + 1
                return count[d] + 1
        raise ValueError(f"no token ends a word at {suffix!r}")

    def end(self, state: int) -> int:
        end = self.ends[state]
        return self.compile_end(state) if end is None else end

    def count(self, word: bytes) -> int:
        """Tokens of one piece."""
        if not word:
            return 0
        if len(self.keys) > MOST_STATES:
            self.reset()
        if len(word) > CHUNK:
            return self.count_long(word)
        state, total, following, alphabet = 0, 0, self.next, self.alphabet
        for b in word:
            char = alphabet[b]
            to = following[state].get(char)
            if to is None:
                to = self.compile_step(state, char)
            state = to[0]
            total += to[1]
        return total + self.end(state)

    def count_long(self, word: bytes) -> int:
        """Tokens of a long piece, by the maps of its chunks; between groups of chunks only the state is carried."""
        state = total = 0
        for i in range(0, len(word), GROUP):
            if len(self.keys) > MOST_STATES:
                key = self.keys[state]
                self.reset()
                state = self.intern(key)
            group = word[i : i + GROUP]
            state, emitted = joined([ChunkMap(self, group[j : j + CHUNK]) for j in range(0, len(group), CHUNK)])(state)
            total += emitted
        return total + self.end(state)


#: From the state in which a chunk is entered to the state in which it is left and the tokens emitted.
StateMap = Callable[[int], tuple[int, int]]


class ChunkMap:
    """The map of one chunk: its run from the start state, and how others fall in with it."""

    def __init__(self, machine: Transducer, chunk: bytes):
        self.machine, self.chunk = machine, chunk
        self.states, self.counts = array("q", [0]), array("q", [0])
        state = total = 0
        for b in chunk:
            state, emitted = machine.step(state, b)
            total += emitted
            self.states.append(state)
            self.counts.append(total)

    def __call__(self, state: int) -> tuple[int, int]:
        total, own = 0, self.states
        for i, b in enumerate(self.chunk):
            if state == own[i]:
                return own[-1], total + self.counts[-1] - self.counts[i]
            state, emitted = self.machine.step(state, b)
            total += emitted
        return state, total


def then(first: StateMap, second: StateMap) -> StateMap:
    """One map after the other; what it gives is kept."""

    @lru_cache(8)
    def both(state: int) -> tuple[int, int]:
        between, a = first(state)
        after, b = second(between)
        return after, a + b

    return both


def joined(maps: list[StateMap]) -> StateMap:
    """Neighbouring maps joined in a tree."""
    while len(maps) > 1:
        maps = [then(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


class Letters:
    """What the library makes of characters, and for which of them Python's tables say the same."""

    #: What a character may meet: letters, marks that change place with it, and itself.
    AROUND = ("{}", "a{}", "{}\u0301", "a\u0345{}", "a{}\u0334", "{}{}")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.alike: set[str] = {chr(c) for c in range(128)}
        self.classed: set[str] = set(self.alike)
        self.foreign: dict[str, str] = {}

    @staticmethod
    def own(text: str) -> str:
        return WHITES.sub(" ", unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")).lower()

    def normal(self, text: str) -> str:
        """Composed, with one space for white space, and in small letters."""
        if text.isascii():
            return WHITES.sub(" ", text).lower()
        new = set(text) - self.alike
        for c in sorted(new):
            if unicodedata.category(c) != "Cn" and all(self.own(x.format(c, c)) == self.normalizer.normalize_str(x.format(c, c)) for x in self.AROUND):
                self.alike.add(c)
                new.remove(c)
        out = self.normalizer.normalize_str(text) if new else self.own(text)
        for c in set(out) - self.classed:
            self.classed.add(c)
            if (kind := self.kind(c)) != self.own_kind(c):
                self.foreign[c] = kind
        return out

    def pieces(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def kind(self, c: str) -> str:
        """A character of the same class: a letter, a number, white space or another."""
        if self.pieces(f"x{c}x") == [f"x{c}x"]:
            return "x"
        if self.pieces(f"!{c}!") == [f"!{c}!"]:
            return "!"
        return "0" if c in self.pieces(f"x{c}x") else " "

    @staticmethod
    def own_kind(c: str) -> str:
        return " " if WHITES.match(c) else "x" if regex.match(r"\p{L}", c) else "0" if regex.match(r"\p{N}", c) else "!"

    def split(self, run: str) -> Iterator[str]:
        """The pieces of normal text."""
        if self.foreign and not self.foreign.keys().isdisjoint(run):
            alike = run.translate({ord(c): kind for c, kind in self.foreign.items()})
            return (run[m.start() : m.end()] for m in PIECES.finditer(alike))
        return (m[0] for m in PIECES.finditer(run))


class WordCounts(dict):
    """Token counts by run of text without white space, as it stands; misses are made normal and go through the transducer."""

    def __init__(self, transducer: Transducer, letters: Letters):
        self.transducer, self.letters = transducer, letters

    def __missing__(self, run: str) -> int:
        found = sum(self.transducer.count(p.encode("utf-8", "surrogatepass")) for p in self.letters.split(self.letters.normal(run)))
        if len(run) <= LONGEST_RUN:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[run] = found
        return found


def parts(text: str, size: int = PART) -> Iterator[str]:
    """A text in parts of about `size` characters, each but the first begun by white space; what has none is one part."""
    at = 0
    while at + size < len(text) and (m := BREAK.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class Counter:
    """Counts the tokens of whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.letters = Letters(path)
        self.words = WordCounts(Transducer(merges, spec["model"]["end_of_word_suffix"]), self.letters)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.marks = [t["content"] for t in spec["added_tokens"]]

    @staticmethod
    def runs(text: str) -> list[str]:
        """The runs between white space; Python's own splitting takes four control characters more for white space."""
        return WHITES.split(text) if ODD_WHITE.search(text) else text.split()

    def plain(self, text: str) -> int:
        return sum(sum(map(self.words.__getitem__, self.runs(part))) for part in parts(text))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if not any(m in text for m in self.marks):
            return self.plain(text)
        return len(self.special.findall(text)) + sum(self.plain(x) for x in self.special.split(text))


@lru_cache(2)
def counter(path: str) -> Counter:
    """One for each Python worker, which keeps it from task to task."""
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of `docs` (doc_id, text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                tokens = [count(t) for t in part.column("text").to_pylist()]
                sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
