"""Benchmark decontamination: short test items found inside long documents by MinHash sketches, verified exactly.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. An item is the set of its five-word shingles, and one of fewer words
is one shingle of them all; a document is searched with the shingles of the same number of words. An item leaks into a
document that holds at least `threshold` of its shingles.

The sketch of an item of n shingles is its bottom-k MinHash: the k shingles of smallest hash, with k one more than
the number of shingles a leaking document may lack. Such a document then holds a shingle of the sketch for certain.
Items are partitioned by size, and each partition knows its largest sketch hash: of a document only the shingles
below it are looked up there. Every document so found is verified by counting the item's shingles that it holds.

Items come in blocks of bounded size, each broadcast and matched against all documents, which are not shuffled; a table
of items takes one scan of the documents for each BLOCK_ITEMS items or BLOCK_BYTES bytes of them.
Documents are read in parts of 2 MB at most, a longer word whole; parts overlap by four words, and of a long document only
the shingles of the items in question are held. Null or empty items match nothing, nor do null or empty documents. Items
and documents that repeat are matched for each row. Documents with no item to match give no rows; empty tables give empty
results. Other columns are kept by `clean` and not read by `leaks`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE_BYTES, given_back, is_long, mix64, slices, utf8_bytes, word_bounds, word_hashes, word_parts

SHINGLE = 5
#: Items and bytes of item text in one broadcast block.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = np.uint64(0xD6E8FEB86659FD93)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], shingle: int) -> set[bytes]:
    """The shingles of a list of words, each joined by one space."""
    return {b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)}


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, lengths: Iterable[int] = (SHINGLE,)) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of words, the hash of every shingle of the texts, repeats included, and the number of its text."""
    raw = LOWER[raw]
    starts, ends, owner = word_bounds(raw, offsets)
    with np.errstate(over="ignore"):
        words = word_hashes(raw, starts, ends)
        for shingle in lengths:
            n = max(len(words) - shingle + 1, 0)
            whole = owner[:n] == owner[shingle - 1 :][:n]
            acc = np.zeros(n, np.uint64)
            for j in range(shingle):
                acc = acc * _STEP + words[j : n + j]
            yield shingle, mix64(acc[whole] + np.uint64(shingle)), owner[:n][whole]


def overlapping(raw: np.ndarray, most: int = SLICE_BYTES, words: int = SHINGLE - 1) -> Iterator[np.ndarray]:
    """Parts of one text, each with the last `words` words of those before it."""
    held = np.zeros(0, np.uint8)
    for a, b in word_parts(raw, most):
        part = np.concatenate((held, raw[a:b]))
        yield part
        starts, _, _ = word_bounds(part, np.array([0, len(part)]))
        held = part[starts[-words] if len(starts) >= words else 0 :]


def missing_allowed(n: int, threshold: float) -> int:
    """How many of n shingles a document may lack and still reach the threshold."""
    least = next(k for k in range(max(0, int(n * threshold) - 1), n + 1) if k >= threshold * n - 1e-9)
    return n - max(least, 1)


class Sketches:
    """The sketches of a block of items, partitioned by words of a shingle and by size: for each, sorted hashes, their items, and the largest."""

    def __init__(self, items: list[tuple[object, str]], threshold: float):
        self.threshold = threshold
        self.ids = [i for i, _ in items]
        words = [split(t) for _, t in items]
        self.words = np.array([min(len(w), SHINGLE) for w in words], np.int64)
        self.sets = [shingle_set(w, n) if n else set() for w, n in zip(words, self.words.tolist(), strict=True)]
        self.lengths = sorted({*self.words.tolist()} - {0})
        raw, offsets = utf8_bytes(pa.array([t for _, t in items], pa.string()))
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.uint64]]] = {}
        for shingle, hashes, owner in shingle_hashes(raw, offsets, self.lengths):
            members: dict[int, list[tuple[np.ndarray, int]]] = {}
            bounds = np.searchsorted(owner, np.arange(len(items) + 1))
            for i in np.flatnonzero(self.words == shingle).tolist():
                mine = np.unique(hashes[bounds[i] : bounds[i + 1]])
                members.setdefault(len(mine).bit_length(), []).append((mine[: missing_allowed(len(mine), threshold) + 1], i))
            for _, own in sorted(members.items()):
                keys = np.concatenate([h for h, _ in own])
                who = np.concatenate([np.full(len(h), i) for h, i in own])
                order = np.argsort(keys, kind="stable")
                self.parts.setdefault(shingle, []).append((keys[order], who[order], keys.max()))

    def candidates(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Distinct (text, item) pairs of which the text holds a sketched shingle, as rows."""
        found = [np.zeros((0, 2), np.int64)]
        for shingle, hashes, owner in shingle_hashes(raw, offsets, self.lengths):
            for keys, who, top in self.parts[shingle]:
                low = hashes <= top
                h, o = hashes[low], owner[low]
                a, b = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
                hit = b > a
                a, b, o = a[hit], b[hit], o[hit]
                n = b - a
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
                found.append(np.unique(np.stack((np.repeat(o, n), who[at]), axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def verified(self, items: list[int], held: dict[int, set[bytes]]) -> Iterator[tuple[int, int]]:
        """Items of which a document holds enough, with how many shingles it holds; `held` is its shingles by their number of words."""
        for i in items:
            own = self.sets[i]
            got = len(own & held[int(self.words[i])])
            if got >= max(1, len(own) - missing_allowed(len(own), self.threshold)):
                yield i, got

    def links(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(text, item, shingles found) of every leak in a slice."""
        raw, offsets = utf8_bytes(texts)
        if is_long(texts):
            return self.long_links(raw)
        out, by = [], {}
        for d, i in self.candidates(raw, offsets).tolist():
            by.setdefault(d, []).append(i)
        for d, items in by.items():
            words = split(texts[d].as_py())
            held = {n: shingle_set(words, n) for n in {int(self.words[i]) for i in items}}
            out += [(d, i, got) for i, got in self.verified(items, held)]
        return out

    def long_links(self, raw: np.ndarray, most: int = SLICE_BYTES) -> list[tuple[int, int, int]]:
        """The leaks into one text, read twice, part by part."""
        items = sorted({i for part in overlapping(raw, most) for _, i in self.candidates(part, np.array([0, len(part)])).tolist()})
        wanted = {n: set().union(*(self.sets[i] for i in items if self.words[i] == n)) for n in {int(self.words[i]) for i in items}}
        held: dict[int, set[bytes]] = {n: set() for n in wanted}
        for part in overlapping(raw, most) if items else ():
            words = part.tobytes().lower().split()
            for n, some in wanted.items():
                held[n] |= {x for x in (b" ".join(words[j : j + n]) for j in range(len(words) - n + 1)) if x in some}
        return [(0, i, got) for i, got in self.verified(items, held)]


def blocks(items: DataFrame, threshold: float) -> Iterator[Sketches]:
    """Reads the items one by one and gives sketches of blocks of bounded size."""
    block, size = [], 0
    for item, text in items.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((item, text))
        size += len(text)
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield Sketches(block, threshold)
            block, size = [], 0
    if block:
        yield Sketches(block, threshold)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found and containment for every item that leaks into a document."""
    kinds = {k: df.schema[k].dataType.simpleString() for df, k in ((docs, "doc_id"), (items, "item_id"))}
    out = docs.sparkSession.createDataFrame([], f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, n_shingles int, n_found int, containment double")
    for n, sketches in enumerate(blocks(items, threshold)):
        shared = docs.sparkSession.sparkContext.broadcast(sketches)  # at most BLOCK_ITEMS items and BLOCK_BYTES of text

        def found(batches: Iterator[pa.RecordBatch], shared=shared, schema=out.schema) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow, own = to_arrow_schema(schema), shared.value
            for batch in batches:
                for part in slices(batch, "text"):
                    rows = own.links(part.column("text"))
                    n = [len(own.sets[i]) for _, i, _ in rows]
                    columns = [part.column("doc_id").take(pa.array([d for d, _, _ in rows], pa.int64())), [own.ids[i] for _, i, _ in rows], n, [g for _, _, g in rows], [g / m for (_, _, g), m in zip(rows, n, strict=True)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        rows = docs.select("doc_id", "text").mapInArrow(found, out.schema)
        out = rows if not n else out.unionAll(rows)
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of `docs`, all columns, into which no item leaks."""
    for sketches in blocks(items, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(sketches)

        def kept(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    stay = np.ones(part.num_rows, dtype=bool)
                    stay[[d for d, _, _ in shared.value.links(part.column("text"))]] = False
                    yield part.filter(pa.array(stay))

        docs = docs.mapInArrow(lambda batches, kept=kept: given_back(kept(batches)), docs.schema)
    return docs


ORACLE_SQL = r"""
WITH item AS (
  SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark) WHERE len(w) > 0),
item_shingle AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM item)),
item_size AS (SELECT item_id, count(*) AS n FROM item_shingle GROUP BY item_id),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
doc_shingle AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM item) WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, count(*) AS g FROM doc_shingle JOIN item_shingle USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n::INT AS n_shingles, g::INT AS n_found, g / n AS containment
FROM hit JOIN item_size USING (item_id) WHERE g >= 0.8 * n - 1e-9
"""
