"""Removal of word windows that also start in an earlier document, found by difference-cover anchors.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A window is WINDOW consecutive words of one document; it is late where
the same words also start in a document of smaller doc_id. Every word under a late window goes. Windows are judged on
the input.

A difference cover modulo PERIOD is a set of residues of which some two lie at every distance. Only windows of
WINDOW - PERIOD + 1 words at positions whose residue is in the cover are hashed (and the last one of each document).
Wherever two documents share WINDOW words, at one of the first PERIOD offsets both positions are in the cover: the two
share an aligned anchor.

1. Anchors of equal hash meet. The first document of an anchor hash (the smallest doc_id) is its origin.
2. An anchor is extended along its diagonal: anchors of a document whose origin, and distance to it, are the same, and
   which overlap or touch, are a chain. All windows inside a chain are in the origin too, so they are late.
3. What reaches beyond its chain is open: the windows around an open anchor, those around the other open anchors of
   its hash and those of its origin are extended to their WINDOW words, and compared by a 128-bit hash. The first
   document of any such window has it open (none before it has it), so nothing is lost.

No step lists pairs of a group: anchors and windows meet one row a hash, joined under a key that has a shuffle of its
own, so that a hash held by a third of all documents is split. A chain is one anchor (never enough for a whole
window) or several at one distance; single anchors that agree by chance do not mark anything.

Nulls: a text is no words; a row without doc_id is neither removed from nor an origin. doc_id may be of any type with
an order. Rows equal in doc_id and text get the same result; rows of one doc_id with different texts do not remove
each other's words. Empty texts, those of fewer words than a window, and empty tables have nothing to remove. Other columns
are not read. Long texts are read part by part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SLICE_BYTES, cut, dealt, drop, given_back, is_long, mix64, slices, utf8_bytes, word_bounds, word_hashes, word_parts

WINDOW, PERIOD = 50, 21
#: Odd multipliers of the two polynomial hashes of windows.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SALT = np.uint64(0xD6E8FEB86659FD93)
OWN = ("doc", "text_id")


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set of residues with 0 of which some two are at every distance modulo `period`."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise ValueError("a period is at least 1")


class Rolling:
    """Hashes of windows of a run of word hashes, each from the difference of two sums."""

    def __init__(self, words: np.ndarray, base: int = BASES[0]):
        n, inverse = len(words), pow(base, -1, 1 << 64)
        one = np.ones(1, np.uint64)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate((one, np.full(max(n - 1, 0), base, np.uint64))))[:n]
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power)))
            self.back = np.cumprod(np.concatenate((one, np.full(n, inverse, np.uint64))))

    def at(self, start: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[start + size] - self.sums[start]) * self.back[start])


def long_words(raw: np.ndarray, most: int = SLICE_BYTES) -> Iterator[np.ndarray]:
    """The word hashes of one text, part by part."""
    for a, b in word_parts(raw, most):
        piece = raw[a:b]
        starts, ends, _ = word_bounds(piece, np.array([0, len(piece)]))
        yield word_hashes(piece, starts, ends)


def overlapped(parts: Iterator[np.ndarray], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of word hashes that overlap by size - 1 words, each with the place of its first word."""
    at, tail = 0, np.zeros(0, np.uint64)
    for part in parts:
        run = np.concatenate((tail, part))
        if len(run) >= size:
            yield at, run
            keep = size - 1
            at += len(run) - keep
            tail = run[len(run) - keep :].copy()
        else:
            tail = run


def anchors(n: np.ndarray, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and word positions of the anchors of texts of `n` words each."""
    size = window - period + 1
    member = np.zeros(period, dtype=bool)
    member[list(difference_cover(period))] = True
    places = np.where(n >= window, n - size + 1, 0)
    text = np.repeat(np.arange(len(n)), places)
    place = np.arange(len(text)) - np.repeat(np.cumsum(places) - places, places)
    own = member[place % period] | (place == places[text] - 1)
    return text[own], place[own]


def long_anchors(raw: np.ndarray, window: int, period: int, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hashes and positions of one text's anchors, part by part, with the text's number of words."""
    size = window - period + 1
    n = sum(len(x) for x in long_words(raw, most))
    member = np.zeros(period, dtype=bool)
    member[list(difference_cover(period))] = True
    for at, run in overlapped(long_words(raw, most), size) if n >= window else ():
        place = np.arange(len(run) - size + 1)
        place = place[member[(place + at) % period] | (place + at == n - size)]
        yield Rolling(run).at(place, size), place + at, n


def identified(docs: DataFrame) -> DataFrame:
    """doc_id as doc, a hash of the text as text_id, and the text."""
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_id"), "text")


def all_anchors(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """h (the hash), doc, text_id, pos (in words) and n (words of the text) of every anchor."""
    size = window - period + 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = utf8_bytes(part.column("text"))
                if is_long(part.column("text")):
                    for h, pos, n in long_anchors(raw, window, period):
                        yield record(part, np.zeros(len(pos), np.int64), h, pos, np.full(len(pos), n))
                    continue
                starts, ends, text = word_bounds(raw, offsets)
                n = np.bincount(text, minlength=part.num_rows)
                owner, pos = anchors(n, window, period)
                first = np.cumsum(n) - n
                yield record(part, owner, Rolling(word_hashes(raw, starts, ends)).at(first[owner] + pos, size), pos, n[owner])

    def record(part: pa.RecordBatch, owner: np.ndarray, h: np.ndarray, pos: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        at = pa.array(owner)
        columns = [pa.array(h.view(np.int64)), part.column("doc").take(at), part.column("text_id").take(at), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["h", "doc", "text_id", "pos", "n"])

    rows = identified(docs.where("doc_id is not null and text is not null"))
    return rows.mapInArrow(lambda batches: given_back(found(batches)), f"h bigint, doc {kind_of(docs)}, text_id bigint, pos int, n int")


def kind_of(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def met(found: DataFrame) -> DataFrame:
    """The anchors whose hash is in several documents, with their origin: first (doc, text_id, pos)."""
    place = F.struct("doc", "text_id", "pos")
    first = found.groupBy(F.col("h").alias("_h")).agg(F.min(place).alias("first"), F.max("doc").alias("last")).where("last > first.doc").select("_h", "first")
    return found.join(first, dealt("h") == dealt("_h")).drop("_h")


def chained(rows: DataFrame, window: int, period: int) -> DataFrame:
    """The anchors that have an earlier origin, with the first and last anchor of their chain (a, b), and whether a window around them reaches beyond it."""
    size = window - period + 1
    line = [*OWN, "first.doc", "first.text_id", "far"]
    later = rows.where(F.col("doc") > F.col("first.doc")).withColumn("far", F.col("pos") - F.col("first.pos"))
    along = Window.partitionBy(*line).orderBy("pos")
    broken = F.coalesce((F.col("pos") - F.lag("pos").over(along) > size).cast("int"), F.lit(0))
    linked = later.withColumn("new", broken).withColumn("chain", F.sum("new").over(along))
    whole = Window.partitionBy(*line, "chain")
    ends = linked.withColumn("a", F.min("pos").over(whole)).withColumn("b", F.max("pos").over(whole))
    beyond = (F.greatest(F.lit(0), F.col("pos") - (period - 1)) < F.col("a")) | (F.least(F.col("pos"), F.col("n") - window) > F.col("b") - (period - 1))
    return ends.select("h", *OWN, "pos", "a", "b", beyond.alias("open"))


def settled_windows(chains: DataFrame, period: int) -> DataFrame:
    """doc, text_id, start, n: runs of windows that lie inside a chain."""
    return chains.select(*OWN, "a", "b").distinct().where(F.col("b") - (period - 1) >= F.col("a")).select(*OWN, F.col("a").alias("start"), (F.col("b") - F.col("a") - (period - 2)).alias("n"))


def covered(starts: np.ndarray, ns: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in the runs."""
    if not len(starts):
        return np.zeros(n, dtype=bool)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.clip(starts, 0, n), 1)
    np.add.at(edge, np.clip(starts.astype(np.int64) + ns, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def lists(column: pa.Array, *names: str) -> Iterator[list[np.ndarray]]:
    """For each row of a column of lists, its values; of lists of structs, those of each field; nothing for null."""
    at, flat = np.asarray(column.offsets), column.values
    fields = [np.asarray(flat.field(x) if names else flat) for x in names or [""]]
    for a, b, ok in zip(at[:-1], at[1:], np.asarray(column.is_valid()), strict=True):
        yield [f[a : b if ok else a] for f in fields]


def open_windows(docs: DataFrame, wanted: DataFrame, settled: DataFrame, window: int, period: int) -> DataFrame:
    """The hashes (w, v) and places of all windows around the anchors of `wanted` (doc, text_id, pos) that are not settled. A document has no more rows than words."""
    asked = wanted.groupBy(*OWN).agg(F.collect_set("pos").alias("asked"))
    done = settled.groupBy(*OWN).agg(F.collect_list(F.struct("start", "n")).alias("done"))
    requests = asked.join(done, list(OWN), "left").withColumnsRenamed({"doc": "_doc", "text_id": "_text"})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for i, ((pos,), (start, n)) in enumerate(zip(lists(part.column("asked")), lists(part.column("done"), "start", "n"), strict=True)):
                    raw, _ = utf8_bytes(part.column("text").slice(i, 1))
                    words = sum(len(x) for x in long_words(raw))
                    pos = pos.astype(np.int64)
                    near = covered(pos - (period - 1), period, max(words - window + 1, 0))
                    near[covered(start.astype(np.int64), n, len(near))] = False
                    for at, run in overlapped(long_words(raw), window):
                        own = np.flatnonzero(near[at : at + len(run) - window + 1])
                        if len(own):
                            same = pa.array(np.full(len(own), i))
                            hashes = [Rolling(x, base).at(own, window).view(np.int64) for x, base in zip((run, mix64(run ^ SALT)), BASES, strict=True)]
                            yield pa.RecordBatch.from_arrays([*map(pa.array, hashes), part.column("doc").take(same), part.column("text_id").take(same), pa.array((own + at).astype(np.int32))], ["w", "v", *OWN, "start"])

    rows = identified(docs.where("doc_id is not null and text is not null"))
    joined = rows.join(requests, (F.col("doc") == F.col("_doc")) & (F.col("text_id") == F.col("_text"))).select(*OWN, "text", "asked", "done")
    return joined.mapInArrow(lambda batches: given_back(hashed(batches)), f"w bigint, v bigint, doc {kind_of(docs)}, text_id bigint, start int")


def late_windows(windows: DataFrame) -> DataFrame:
    """Of windows, those that also start in a document of smaller doc_id: doc, text_id, start, n (1)."""
    first = windows.groupBy(F.col("w").alias("_w"), F.col("v").alias("_v")).agg(F.min("doc").alias("first"))
    met_ = windows.join(first, dealt("w", "v") == dealt("_w", "_v"))
    return met_.where("doc > first").select(*OWN, "start", F.lit(1).alias("n")).distinct()


def marks(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """doc, text_id and marks (start, n): in words, the windows from start on, n of them, that are late."""
    if not 1 <= period <= window:
        raise ValueError("a period is at least 1 and at most a window")
    found = cut(all_anchors(docs, window, period), "anchors")
    rows = cut(met(found), "met")
    drop(found)
    chains = cut(chained(rows, window, period), "chains")
    settled = cut(settled_windows(chains, period), "settled")
    open_ = chains.where("open")
    hashes = open_.select(F.col("h").alias("_h")).distinct()
    origins = rows.where(F.col("doc") == F.col("first.doc")).join(hashes, dealt("h") == dealt("_h"), "left_semi")
    wanted = open_.select(*OWN, "pos").union(origins.select(*OWN, "pos"))
    windows = cut(open_windows(docs, wanted, settled, window, period), "windows")
    drop(rows)
    drop(chains)
    late = cut(settled.union(late_windows(windows)).groupBy(*OWN).agg(F.collect_list(F.struct("start", "n")).alias("marks")), "late")
    drop(windows)
    drop(settled)
    return late


def marked(docs: DataFrame, late: DataFrame) -> DataFrame:
    """All columns of `docs`, with _gl_marks from `late` (null where there are none)."""
    found = late.select(F.col("doc").alias("_gl_doc"), F.col("text_id").alias("_gl_text"), F.col("marks").alias("_gl_marks"))
    return docs.join(found, (docs["doc_id"] == F.col("_gl_doc")) & (F.xxhash64(docs["text"]) == F.col("_gl_text")), "left").drop("_gl_doc", "_gl_text")


def kept_words(raw: bytes, start: np.ndarray, n: np.ndarray, window: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Part by part, how many words there are and those of them that stay."""
    at, whole = 0, np.frombuffer(raw, np.uint8)
    order = np.argsort(start, kind="stable")
    start, stop = start[order].astype(np.int64), (start + n + window - 1)[order].astype(np.int64)
    for a, b in word_parts(whole, most):
        words = raw[a:b].split()
        own = (start < at + len(words)) & (stop > at)
        if own.any():
            low = np.maximum(start[own] - at, 0)
            yield len(words), list(compress(words, (~covered(low, stop[own] - at - low, len(words))).tolist()))
        else:
            yield len(words), words
        at += len(words)


def digests(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by one space) for every row of `docs` (doc_id, text)."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                out = []
                raw, offsets = utf8_bytes(part.column("text"))
                for a, b, (start, n) in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lists(part.column("_gl_marks"), "start", "n"), strict=True):
                    sha, words, kept = hashlib.sha256(), 0, 0
                    for count, own in kept_words(raw[a:b].tobytes(), start, n, window):
                        sha.update((b" " if kept and own else b"") + b" ".join(own))
                        words, kept = words + count, kept + len(own)
                    out.append((words, words - kept, sha.hexdigest()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    own = docs.select("doc_id", "text")
    rows = marked(own, marks(own, window, period))
    return rows.mapInArrow(lambda batches: given_back(digested(batches)), f"doc_id {kind_of(docs)}, n_words bigint, n_removed bigint, kept_sha256 string")


def kept_text(text: Column, found: Column, window: int = WINDOW) -> Column:
    """Texts without the words under marks, joined by one space; texts without marks are unchanged."""

    @F.arrow_udf("string")
    def rest(texts: pa.Array, marks_: pa.Array) -> pa.Array:
        raw, offsets = utf8_bytes(texts)
        out = []
        for a, b, (start, n) in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lists(marks_, "start", "n"), strict=True):
            out.append(b" ".join(w for _, own in kept_words(raw[a:b].tobytes(), start, n, window) for w in own).decode())
        return pa.array(out, pa.string())

    return F.when(found.isNull(), text).otherwise(rest(text, found))


def deduplicated(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """The rows of `docs`, all columns, without the words of late windows in `text`."""
    rows = marked(docs, marks(docs.select("doc_id", "text"), window, period))
    return rows.withColumn("text", kept_text(F.col("text"), F.col("_gl_marks"), window)).select(*docs.columns)


#: Every window by the hash of its words, and the smallest doc_id that has it; words under later ones go.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
late AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE doc_id > m),
gone AS (SELECT DISTINCT r, i + k AS i FROM late, range(50) t(k)),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
