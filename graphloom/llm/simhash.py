"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at few differing bits, found by pigeonring filtering.

A fingerprint is cut into m segments that form a ring. Two fingerprints that differ in at most `budget` bits have a
segment from which every chain of l consecutive segments differs in at most l * budget / m bits. So the first segment of
the chain is equal, and of those that follow, the first few cannot all differ: some set of them is equal too. First
segment and such a set are the keys by which candidates meet, and longer chains prune the candidates before the full
count of differing bits. With more fingerprints the ring has more segments and keys have more of them, about as many
bits as the number of fingerprints has, so that a fingerprint is compared with a bounded number of others by chance.

Only distinct fingerprints take part, each by the smallest doc_id that has it. Within a key, linked fingerprints are
gathered by a search that takes each one out when it is first reached, and a tree of links is returned, never all
pairs. A key with more than BLOCK fingerprints is dealt out by pairs of blocks, so no task holds more than two.

Texts are read in parts of 2 MB at most, a longer word whole; the bit counts and the last three words are all that is
carried from part to part. Texts without words (null and empty ones too) have fingerprint zero and are linked like any
other. Repeated rows share a component. Rows without doc_id get the component of their fingerprint. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import SLICE_BYTES, cut, dealt, given_back, is_long, slices, utf8_bytes, word_parts
from .components import components

SHINGLE, SEED, BUDGET = 4, 42, 4
BLOCK = 4096
_ALL = (1 << 64) - 1


@dataclass(frozen=True)
class Ring:
    """Segments (first bit, bits), and the keys: the segments or parts of segments that must be equal, and the segment where the chain starts, or -1 for any."""

    segments: tuple[tuple[int, int], ...]
    keys: tuple[tuple[int, tuple[tuple[int, int], ...]], ...]

    def chains(self, start: int) -> list[tuple[int, int]]:
        """For the chains from `start`: their bits, and how many of these may differ."""
        out, mask, m = [], 0, len(self.segments)
        for length in range(1, m + 1):
            at, n = self.segments[(start + length - 1) % m]
            mask |= ((1 << n) - 1) << at
            out.append((mask, length * BUDGET // m))
        return out

    def tests(self, start: int) -> list[list[tuple[int, int]]]:
        """Chains of which all of one list must hold."""
        return [self.chains(s) for s in (range(len(self.segments)) if start < 0 else (start,))]


def segments(m: int) -> tuple[tuple[int, int], ...]:
    bounds = [64 * i // m for i in range(m + 1)]
    return tuple((a, b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def equal_sets(m: int, length: int) -> set[tuple[int, ...]]:
    """Sets of places in a chain of `length` segments, of which one is equal whenever all chains keep their budget."""
    most = [n * BUDGET // m for n in range(length + 1)]
    ahead = range(1, length)
    kept = [a for n in range(length) for a in combinations(ahead, n) if all(sum(x < k for x in a) <= most[k] for k in range(1, length + 1))]
    largest = [set(a) for a in kept if not any(set(a) < set(b) for b in kept)]
    least = min(length - 1 - len(a) for a in largest)
    return {(0, *[x for x in ahead if x not in a][:least]) for a in largest}


@lru_cache(8)
def ring(n: int) -> Ring:
    """The ring for `n` distinct fingerprints."""
    if n <= 1 << 21:  # one segment of five and half of the next, about 19 bits
        own = segments(5)
        halves = [((at, size // 2), (at + size // 2, size - size // 2)) for at, size in own]
        return Ring(own, tuple((s, (own[s], half)) for s in range(5) for half in halves[(s + 1) % 5]))
    if n <= 1 << 30:  # two segments of six, or three of seven: 21 and 27 bits
        m, length = (6, 4) if n <= 1 << 24 else (7, 5)
        own = segments(m)
        return Ring(own, tuple((s, tuple(own[(s + x) % m] for x in places)) for s in range(m) for places in sorted(equal_sets(m, length))))
    own = segments(8)  # any four of eight, 32 bits
    return Ring(own, tuple((-1, x) for x in combinations(own, 8 - BUDGET)))


def shingle_hashes(words: list[bytes]) -> list[int]:
    """The hash of every shingle of a list of at least SHINGLE words."""
    from xxhash import xxh64_intdigest

    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - SHINGLE + 1].tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]


def bits_of(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def majority(ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of which a bit is set that is set in over half of the hashes."""
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def long_fingerprint(raw: np.ndarray, most: int = SLICE_BYTES) -> int:
    """The fingerprint of one text, part by part; the last words of a part go on with the next."""
    from xxhash import xxh64_intdigest

    ones, n, held = np.zeros((1, 64), np.int64), 0, []
    for a, b in word_parts(raw, most):
        held += raw[a:b].tobytes().lower().split()
        if len(held) >= SHINGLE:
            hashes = shingle_hashes(held)
            ones += bits_of(hashes).sum(axis=0, dtype=np.int64)
            n += len(hashes)
            held = held[1 - SHINGLE :]
    if not n:
        return xxh64_intdigest(b" ".join(held), SEED) if held else 0
    return int(majority(ones, np.array([n]))[0])


def shingle_fingerprints(texts: pa.Array) -> np.ndarray:
    """The fingerprints of a slice of texts as uint64."""
    from xxhash import xxh64_intdigest

    if is_long(texts):
        return np.array([long_fingerprint(utf8_bytes(texts)[0])], np.uint64)
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts.to_pylist()):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            continue
        own = shingle_hashes(words) if len(words) > SHINGLE else [xxh64_intdigest(b" ".join(words), SEED)]
        hashes += own
        counts[i] = len(own)
    out = np.zeros(len(texts), np.uint64)
    on = np.flatnonzero(counts)
    if len(on):
        out[on] = majority(np.add.reduceat(bits_of(hashes), np.cumsum(counts[on]) - counts[on], axis=0, dtype=np.int64), counts[on])
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit number) of every row of `docs` (doc_id, text)."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shingle_fingerprints(part.column("text")).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: given_back(computed(batches)), f"doc_id {kind}, fp bigint")


def candidate_keys(fp: Column, own: Ring) -> Column:
    """The keys of a fingerprint: the number of each, and above it the bits that must be equal."""
    keys = []
    for number, (_, parts) in enumerate(own.keys):
        key = F.lit(0).cast("bigint")
        for at, n in parts:
            key = F.shiftleft(key, n).bitwiseOR(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1)))
        keys.append(F.shiftleft(key, 7).bitwiseOR(F.lit(number)))
    return F.array(*keys)


def passing(x: np.ndarray, tests: list[list[tuple[int, int]]]) -> np.ndarray:
    """Places of the differences `x` that keep the budgets of all chains of one list, and the whole budget."""
    hit = np.zeros(len(x), dtype=bool)
    for chains in tests:
        y, at = x, np.arange(len(x))
        for mask, most in (*chains, (_ALL, BUDGET)):
            keep = np.bitwise_count(y & np.uint64(mask)) <= most
            y, at = y[keep], at[keep]
        hit[at] = True
    return np.flatnonzero(hit)


def group_links(fp: np.ndarray, node: np.ndarray, tests: list[list[tuple[int, int]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """A tree of links over each set of linked fingerprints of one key."""
    left, out = np.arange(len(fp)), []
    while len(left):
        root, frontier, left = left[0], [left[0]], left[1:]
        reached = []
        while frontier and len(left):
            hit = passing(fp[frontier.pop()] ^ fp[left], tests)
            if len(hit):
                frontier += left[hit].tolist()
                reached.append(left[hit])
                left = np.delete(left, hit)
        if reached:
            all_ = np.concatenate(reached)
            out.append((np.full(len(all_), node[root]), node[all_]))
    return out


def sorted_links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, own: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole groups, given in the order of their keys (key, block pair)."""
    none = np.zeros(0, np.int64)
    out = [(none, none)]
    if not len(key):
        return out[0]
    change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
    first = np.concatenate(([0], change))
    size = np.diff(np.concatenate((first, [len(key)])))
    start = np.array([s for s, _ in own.keys])[key[:, 0] & 127]
    for i in np.flatnonzero(size > 48):
        rows = slice(first[i], first[i] + size[i])
        out += group_links(fp[rows], node[rows], own.tests(int(start[first[i]])))
    # Small groups together: each member with the one `lag` places on.
    small = np.where(size > 48, 0, size)
    last = np.repeat(first + small, size)
    place = np.arange(len(key))
    for lag in range(1, int(small.max(initial=1))):
        i = place[place + lag < last]
        if not len(i):
            break
        for s in np.unique(start[i]):
            j = i[start[i] == s]
            j = j[passing(fp[j] ^ fp[j + lag], own.tests(int(s)))]
            if len(j):
                out.append((node[j], node[j + lag]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def links(reps: DataFrame, block: int = BLOCK, n: int | None = None) -> DataFrame:
    """Trees of links (a, b) that connect the nodes of `reps` (fp, node; fingerprints distinct) whose fingerprints are near; the ring is that for `n` fingerprints, or for as many as there are."""
    own = ring(1 << (reps.count() if n is None else n).bit_length())
    keyed = reps.select("fp", "node", F.explode(candidate_keys(F.col("fp"), own)).alias("key"))
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("key").alias("hot"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    spread = keyed.join(hot, dealt("key") == dealt("hot"), "left").withColumn("mine", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("mine")))
    spread = spread.select("key", "fp", "node", "mine", F.explode(others).alias("other"))
    spread = spread.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp", "node")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros((0, 3), np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def answer(key, fp, node):
            a, b = sorted_links(key, fp, node, own)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "lo", "hi")], axis=1)
            new = (key, np.asarray(batch.column("fp")).view(np.uint64), np.asarray(batch.column("node")))
            held = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            # The last group may go on in the next batch.
            whole = int(np.flatnonzero((held[0] != held[0][-1]).any(axis=1)).max(initial=-1)) + 1
            if whole:
                yield answer(*(x[:whole] for x in held))
                held = tuple(x[whole:] for x in held)
        yield answer(*held)

    return spread.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp").mapInArrow(lambda batches: given_back(joined(batches)), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of `docs`."""
    fps = cut(fingerprints(docs), "fingerprints")
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "classes")
    found = components(links(reps)).withColumnRenamed("node", "id")
    labelled = reps.join(found, reps["node"] == found["id"], "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(labelled, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that head their group of near duplicates: the smallest doc_id, and of several texts of it the one of smallest hash.

    Rows are told apart by doc_id and a 64-bit hash of the text, and groups are made of fingerprints, so texts that
    share a doc_id but not a group have a head each. A row that repeats both stays once; rows without doc_id stay.
    """
    mark, row = "_graphloom_text", "_graphloom_row"
    own = docs.select("doc_id", "text", F.xxhash64("text").alias(mark))
    fps = cut(fingerprints(own.select(F.struct("doc_id", mark).alias("doc_id"), "text")).where("doc_id.doc_id is not null"), "fingerprints")
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = components(links(reps.select("fp", F.col("fp").alias("node"))))
    labelled = reps.join(found, reps["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("group"))
    heads = labelled.groupBy("group").agg(F.min("first").alias("head"))
    others = fps.join(labelled.join(heads, "group").select("fp", "head"), "fp").where("doc_id != head").select("doc_id.doc_id", f"doc_id.{mark}").distinct()
    kept = docs.withColumn(mark, F.xxhash64("text")).join(others, ["doc_id", mark], "left_anti")
    kept = kept.withColumn(row, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    return kept.dropDuplicates(["doc_id", mark, row]).select(*docs.columns)
