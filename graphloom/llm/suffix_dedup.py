"""Exact substring deduplication: every byte under a `length`-byte string that also starts earlier in the corpus goes.

A window is `length` bytes of one text. Each window has an anchor: the place of smallest hash among its ANCHOR-byte
strings, leftmost where equal. Equal windows have equal anchors at the same place, so only windows of the same
anchor need comparing. Neighbouring windows with one anchor place form a span, which is all that is dealt out: its
anchor's hash, the hash of its bytes, and where it is.

1. Each chunk of texts drops spans equal to an earlier one of the chunk (their windows all repeat), and says which
   anchors stand in several surroundings. So an anchor has at most one row from each chunk.
2. By anchor, sorted rows are streamed: spans equal to an earlier one are marked; where an anchor has several
   surroundings, the first of each is fetched with its bytes, cut in two by which side of the anchor a window mostly
   lies on, and keyed by the anchor with 34 bytes of that side.
3. By that key, blocks of fetched bytes go into a run-length index, whose matching statistics give the windows
   that occur earlier. The spans of a key with more than KEY_ROWS rows are cut into stretches of up to STRETCH windows,
   keyed by the bytes that all of these share (93 of 100); stretches equal to an earlier one are marked by a sum over
   their bytes, and the others go into run-length indexes in their turn. Only where more than KEY_ROWS different
   stretches share a key (they differ in 14 bytes) are windows hashed one by one, and the first of each found by a sum.
   No key is gathered beyond KEY_ROWS rows.
4. Marks meet the texts again, and the bytes under them are removed.

A text of more than 2 MB is read in parts that overlap by a window; its marks are joined to runs before its bytes are
touched, and bytes are kept by runs. Nulls count as empty texts, which have no window. Rows that repeat doc_id and text
are one document, each returned; rows with one doc_id and different texts are ordered by a hash of the text; rows
without doc_id come last. An empty table gives an empty result; `deduplicated` keeps other columns, and its texts lose
the parts of letters that a removed run leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import SLICE_BYTES, cut, dealt, drop, given_back, is_long, mix64, slices, utf8_bytes
from .run_index import RunIndex

LENGTH, ANCHOR = 100, 32
#: Bytes of text whose spans are compared at once in the first step.
CHUNK_BYTES = 24 << 20
#: Bytes of one indexed block, and rows of a key that still go into one.
BLOCK_BYTES, KEY_ROWS = 1 << 20, 8_000
#: Windows of one stretch of a hot key.
STRETCH = 8
PART_TYPE = "key bigint, doc bigint, text_id bigint, start bigint, n int, lead int, raw binary"
PART_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
PLACE = ("doc", "text_id", "start")
LAST = (1 << 63) - 1
_RNG = np.random.default_rng(7_919)
LETTER = _RNG.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
SPAN_TYPE = "kind int, route bigint, anchor bigint, bytes bigint, doc bigint, text_id bigint, start bigint, n int, lead int, many boolean"


def anchors(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each window start, its anchor's place; and the hash of the ANCHOR-byte string at each place."""
    with np.errstate(over="ignore"):
        h, n, power = LETTER[raw], 1, _BASE
        while n < ANCHOR:
            h = h[:-n] * power + h[n:]
            power, n = power * power, 2 * n
        h = mix64(h)
    # The upper half of the hash orders places, and where it is equal the leftmost wins, alike in slices of any size.
    low = np.uint64(0xFFFFFFFF)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, size, at, best, level = length - ANCHOR + 1, 1, 0, None, key
    total = len(key) - width + 1
    while width:
        if width & 1:
            part = level[at : at + total]
            best = part if best is None else np.minimum(best, part)
            at += size
        width >>= 1
        if width:
            level = np.minimum(level[:-size], level[size:])
            size *= 2
    return (best & low).astype(np.int64), h


def prefix_hash(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a rolling hash, and the inverse powers that move a difference of two to place 0."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(len(raw) - 1, 0), _BASE))))[: len(raw)]
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(raw), inverse))))
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(LETTER[raw] * powers))), back


def spans(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """anchor, bytes, text (its number), start, n and lead (from the first window to the anchor) of all spans of a slice."""
    if len(raw) < length:
        return {k: np.zeros(0, np.int64) for k in ("anchor", "bytes", "text", "start", "n", "lead")}
    place, h = anchors(raw, length)
    ok = np.zeros(len(raw) + 1, np.int8)
    sizes = np.diff(offsets)
    long_ = np.flatnonzero(sizes >= length)
    np.add.at(ok, offsets[long_], 1)
    np.add.at(ok, offsets[long_ + 1] - length + 1, -1)
    valid = np.cumsum(ok[: len(place)], dtype=np.int8) > 0
    edge = np.ones(len(place), dtype=bool)
    edge[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
    edge[offsets[:-1][offsets[:-1] < len(place)]] = True
    first = np.flatnonzero(edge)
    stop = np.concatenate((first[1:], [len(place)]))
    keep = valid[first]
    first, stop = first[keep], stop[keep]
    sums, back = prefix_hash(raw)
    with np.errstate(over="ignore"):
        content = mix64((sums[stop + length - 1] - sums[first]) * back[first] + (stop - first).astype(np.uint64))
    text = np.searchsorted(offsets, first, side="right") - 1
    return {"anchor": h[place[first]].view(np.int64), "bytes": content.view(np.int64), "text": text, "start": first - offsets[text], "n": stop - first, "lead": place[first] - first}


def sorted_spans(x: dict[str, np.ndarray], *last: str) -> dict[str, np.ndarray]:
    """In the order of anchor, bytes and place; a span of a repeated row stays once."""
    order = np.lexsort((*(x[k] for k in last), x["start"], x["text_id"], x["doc"], x["bytes"], x["anchor"]))
    x = {k: v[order] for k, v in x.items()}
    keep = np.ones(len(order), dtype=bool)
    if len(order):
        keep[1:] = np.logical_or.reduce([x[k][1:] != x[k][:-1] for k in ("start", "text_id", "doc", "bytes", "anchor", *last)])
    return {k: v[keep] for k, v in x.items()}


def local_rows(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Step 1 for one chunk of spans (with doc and text_id): kind 0 for step 2, kind 1 marks, kind 2 to fetch."""
    x = sorted_spans(x)
    n = len(x["anchor"])
    kind, many = np.zeros(n, np.int32), np.zeros(n, dtype=bool)
    if n:
        new_anchor = np.ones(n, dtype=bool)
        new_anchor[1:] = x["anchor"][1:] != x["anchor"][:-1]
        new_bytes = new_anchor.copy()
        new_bytes[1:] |= x["bytes"][1:] != x["bytes"][:-1]
        group = np.cumsum(new_anchor) - 1
        several = np.bincount(group, new_bytes)[group] > 1
        kind = np.where(~new_bytes, 1, np.where(several, 2, 0)).astype(np.int32)
        # One row says for the whole chunk that the anchor has several surroundings; itself it is only a notice.
        note = np.flatnonzero(new_anchor & several)
        x = {k: np.concatenate((v, v[note])) for k, v in x.items()}
        kind = np.concatenate((kind, np.zeros(len(note), np.int32)))
        many = np.concatenate((many, np.ones(len(note), dtype=bool)))
    x |= {"kind": kind, "many": many}
    with np.errstate(over="ignore"):
        elsewhere = mix64(x["doc"].view(np.uint64) * _BASE + x["start"].astype(np.uint64)).view(np.int64)
    x["route"] = np.where(kind == 0, x["anchor"], elsewhere)
    return x


def record(x: dict[str, np.ndarray]) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "n": pa.int32(), "lead": pa.int32(), "many": pa.bool_()}
    names = [c.split()[0] for c in SPAN_TYPE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x[c], kinds.get(c, pa.int64()), safe=False) for c in names], names)


def identified(docs: DataFrame) -> DataFrame:
    """All columns, with _gl_doc (doc_id, the largest number where null) and _gl_text (a hash of the text)."""
    return docs.withColumn("_gl_doc", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))).withColumn("_gl_text", F.xxhash64("text"))


def all_spans(docs: DataFrame, length: int) -> DataFrame:
    """Step 1."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = utf8_bytes(part.column("text"))
                doc, text_id = np.asarray(part.column("_gl_doc")), np.asarray(part.column("_gl_text"))
                # Of a long text, the windows that start in one stretch of SLICE_BYTES after another.
                steps = range(0, max(len(raw) - length + 1, 1), SLICE_BYTES) if is_long(part.column("text")) else (0,)
                for begin in steps:
                    own = raw[begin : begin + SLICE_BYTES + length - 1] if len(steps) > 1 else raw
                    x = spans(own, np.array([0, len(own)]) if len(steps) > 1 else offsets, length)
                    text = x.pop("text")
                    x |= {"doc": doc[text], "text_id": text_id[text], "start": x["start"] + begin}
                    held.append(x)
                    size += len(own)
                    if size >= CHUNK_BYTES:
                        yield record(local_rows({k: np.concatenate([y[k] for y in held]) for k in x}))
                        held, size = [], 0
        if held:
            yield record(local_rows({k: np.concatenate([y[k] for y in held]) for k in held[0]}))

    return identified(docs.select("doc_id", "text")).select("_gl_doc", "_gl_text", "text").mapInArrow(lambda batches: given_back(computed(batches)), SPAN_TYPE)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroups sorted batches so that no key is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.asarray(batch.column(key))
        if held and np.asarray(held[-1].column(key))[-1] != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        change = np.flatnonzero(values[1:] != values[:-1])
        if len(change):
            whole = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, whole)])
            held, batch = [], batch.slice(whole)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def judged(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Kinds (1 marks, 2 to fetch, 0 neither) of sorted rows of whole anchors, notices first; and which rows repeat the row before them."""
    n = len(x["route"])
    again = np.zeros(n, dtype=bool)
    again[1:] = np.logical_and.reduce([x[k][1:] == x[k][:-1] for k in ("route", "many", "bytes", *PLACE)])
    real = ~x["many"]
    new_anchor = np.ones(n, dtype=bool)
    new_anchor[1:] = x["route"][1:] != x["route"][:-1]
    # Notices come before all spans of their anchor, and are no class of their own.
    new_bytes = real.copy()
    new_bytes[1:] &= new_anchor[1:] | x["many"][:-1] | (x["bytes"][1:] != x["bytes"][:-1])
    group = np.cumsum(new_anchor) - 1
    several = (np.bincount(group, new_bytes) + 2 * np.bincount(group, x["many"]))[group] > 1
    return np.where(~real, 0, np.where(~new_bytes, 1, np.where(several, 2, 0))), again


def compared(rows: DataFrame) -> DataFrame:
    """Step 2: marks (kind 1) and what to fetch (kind 2). Of an anchor that goes on in the next batch, three rows are held: a notice, the first span, and the first of the last surroundings."""

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SPAN_TYPE.split(", ")]
        held = {c: np.zeros(0, bool if c in ("many", "done") else np.int64) for c in (*names, "done")}

        def answer(x: dict[str, np.ndarray], open_: bool) -> tuple[pa.RecordBatch, dict[str, np.ndarray]]:
            kind, again = judged(x)
            n = len(kind)
            wait = np.zeros(n, dtype=bool)
            keep = np.zeros(0, np.int64)
            if open_ and n:
                at = int(np.searchsorted(x["route"] == x["route"][-1], True)) if n < 2 else int(np.flatnonzero(np.concatenate(([True], x["route"][1:] != x["route"][:-1])))[-1])
                own = np.arange(at, n)
                spans_ = own[~x["many"][own]]
                first = spans_[:1]
                last = spans_[kind[spans_] != 1][-1:]
                # The first span waits until another surrounding or the end of the anchor.
                wait[first[kind[first] == 0]] = True
                keep = np.unique(np.concatenate((own[x["many"][own]][:1], first, last)))
            give = (kind > 0) & ~again & ~x["done"] & ~wait
            out = record({c: (kind if c == "kind" else x[c])[give] for c in names})
            return out, {c: (np.where(wait, x["done"], True) if c == "done" else x[c])[keep] for c in x}

        for batch in batches:
            if not batch.num_rows:
                continue
            x = {c: np.asarray(batch.column(c)) for c in names}
            own = x["kind"] == 0
            if not own.all():
                yield record({k: v[~own] for k, v in x.items()})
            x = {k: v[own] for k, v in x.items()} | {"done": np.zeros(int(own.sum()), dtype=bool)}
            out, held = answer({k: np.concatenate((held[k], x[k].astype(held[k].dtype))) for k in held}, True)
            yield out
        yield answer(held, False)[0]

    order = ["route", "kind", F.desc("many"), "bytes", *PLACE]
    return rows.repartition("route").sortWithinPartitions(*order).mapInArrow(answered, SPAN_TYPE)


def lists(column: pa.Array, *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    """For each row of a column of lists of structs, the fields as arrays; nothing for null."""
    offsets = np.asarray(column.offsets)
    valid = np.asarray(column.is_valid())
    fields = [np.asarray(column.values.field(n)) for n in names]
    for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True):
        yield tuple(f[a : b if ok else a] for f in fields)


def rows_of(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PART_KINDS, strict=True)], [c.split()[0] for c in PART_TYPE.split(", ")])


def fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the spans to fetch, in two parts each, with their keys."""
    by = wanted.groupBy("doc", "text_id").agg(F.collect_list(F.struct("start", "n", "lead")).alias("spans"))  # no more than a text's length in spans
    side = (length - ANCHOR) // 2

    def cutup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                out: list[tuple] = []
                raw_all, offsets = utf8_bytes(part.column("text"))
                whole = memoryview(raw_all)
                for i, (doc, text_id, found) in enumerate(zip(part.column("_gl_doc").to_pylist(), part.column("_gl_text").to_pylist(), lists(part.column("spans"), "start", "n", "lead"), strict=True)):
                    raw = whole[offsets[i] : offsets[i + 1]]
                    order = np.argsort(found[0], kind="stable")
                    for start, n, lead in zip(*(f[order].tolist() for f in found), strict=True):
                        stop = start + n
                        at = start + lead
                        turn = min(max(start, at - side + 1), stop)
                        for a, b, key in ((start, turn, raw[at - side : at + ANCHOR] if turn > start else b""), (turn, stop, raw[at : at + ANCHOR + side + 1])):
                            if b > a:
                                out.append((hash_bytes(key, a == start and turn > start), doc, text_id, a, b - a, at - a, bytes(raw[a : b + length - 1])))
                        if len(out) >= 50_000:
                            yield rows_of(out)
                            out = []
                if out:
                    yield rows_of(out)

    rows = identified(docs.select("doc_id", "text").where("text is not null")).select("_gl_doc", "_gl_text", "text")
    joined = rows.join(by, (F.col("_gl_doc") == F.col("doc")) & (F.col("_gl_text") == F.col("text_id"))).select("_gl_doc", "_gl_text", "text", "spans")
    return joined.mapInArrow(lambda batches: given_back(cutup(batches)), PART_TYPE)


def hash_bytes(raw: bytes | memoryview, seed: int) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(raw, 1 + seed) - (1 << 63)


def indexed_marks(rows: DataFrame, length: int) -> DataFrame:
    """Step 3 for keys of bounded size: windows that occur earlier, as marks (doc, text_id, start, n)."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for table in whole_groups(batches, "key"):
            again = np.ones(table.num_rows, dtype=bool)
            again[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in (np.asarray(table.column(c)) for c in ("key", "doc", "text_id", "start"))])
            table = table.filter(pa.array(again))  # rows that repeat a document
            key = np.asarray(table.column("key"))
            alone = np.ones(len(key), dtype=bool)
            alone[1:] &= key[1:] != key[:-1]
            alone[:-1] &= key[1:] != key[:-1]
            table = table.filter(pa.array(~alone))
            if not table.num_rows:
                continue
            # A table of many keys is cut between keys.
            key = np.asarray(table.column("key"))
            total = np.cumsum(np.asarray(pc.binary_length(table.column("raw"))))
            begin = 0
            for stop in [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]:
                if size + total[stop - 1] - (total[begin - 1] if begin else 0) >= BLOCK_BYTES or stop == len(key):
                    held.append(table.slice(begin, stop - begin))
                    size += int(total[stop - 1] - (total[begin - 1] if begin else 0))
                    begin = stop
                    if size >= BLOCK_BYTES:
                        yield block_marks(pa.concat_tables(held), length)
                        held, size = [], 0
        if held:
            yield block_marks(pa.concat_tables(held), length)

    return rows.repartition("key").sortWithinPartitions("key", "doc", "text_id", "start").mapInArrow(lambda batches: given_back(indexed(batches)), "doc bigint, text_id bigint, start bigint, n int")


def block_marks(table: pa.Table, length: int) -> pa.RecordBatch:
    """Marks of one block; its rows are in the order of key, document and start."""
    sizes = np.asarray(pc.binary_length(table.column("raw"))).astype(np.int64)
    raw = np.frombuffer(b"".join(table.column("raw").to_pylist()), np.uint8)
    first = np.cumsum(sizes + 1) - sizes - 1
    text = np.empty(len(raw) + len(sizes), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    text[np.arange(len(raw)) + row] = raw
    text[first + sizes] = 512 + np.arange(len(sizes))
    # Separators all sort above letters; they end the common prefixes because each is unique.
    found = RunIndex.build(text, int(sizes.max())).repeats(len(text), length)
    own = np.searchsorted(first, found, side="right") - 1
    start = np.asarray(table.column("start"))[own] + found - first[own]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (found[1:] != found[:-1] + 1)
    at = np.flatnonzero(new)
    n = np.diff(np.concatenate((at, [len(found)])))
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(table.column("doc"))[own[at]]), pa.array(np.asarray(table.column("text_id"))[own[at]]), pa.array(start[at]), pa.array(n, pa.int32())], ["doc", "text_id", "start", "n"])


def later(rows: DataFrame, *same: str) -> DataFrame:
    """Every row with `late`, whether a row of the same columns has an earlier place; sums and a join in which each key is one row with a shuffle of its own."""
    place = F.struct(*PLACE)
    least = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in same]).agg(F.min(place).alias("_least"))
    return rows.join(least, dealt(*same) == dealt(*[f"_{c}" for c in same])).withColumn("late", place != F.col("_least")).select(*rows.columns, "late")


def later_windows(windows: DataFrame) -> DataFrame:
    """Marks of the windows (w, doc, text_id, start) that also start earlier."""
    return later(windows, "w").where("late").select(*PLACE, F.lit(1).alias("n"))


def stretches(rows: DataFrame, length: int) -> DataFrame:
    """The spans of hot keys cut by how far their windows start before the anchor, each stretch keyed by the bytes that all of its windows share."""

    def cutup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "raw", 1 << 20):
                out = []
                for doc, text_id, start, n, lead, raw in zip(*(part.column(c).to_pylist() for c in (*PLACE, "n", "lead", "raw")), strict=True):
                    i = 0
                    while i < n:
                        # Windows that start lead - i bytes before the anchor, down to the next multiple of STRETCH.
                        low = (lead - i) // STRETCH * STRETCH
                        stop = min(n, lead - low + 1)
                        shared = raw[max(lead - low, 0) : lead - low - STRETCH + 1 + length]
                        out.append((hash_bytes(shared, 2 + low // STRETCH), doc, text_id, start + i, stop - i, lead - i, raw[i : stop + length - 1]))
                        i = stop
                if out:
                    yield rows_of(out)

    return rows.mapInArrow(cutup, PART_TYPE)


def each_window(rows: DataFrame, length: int) -> DataFrame:
    """The 128-bit hash and place of every window of some spans."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "raw", 1 << 20):
                out = []
                for doc, text_id, start, n, raw in zip(*(part.column(c).to_pylist() for c in (*PLACE, "n", "raw")), strict=True):
                    out += [(hashlib.blake2b(raw[i : i + length], digest_size=16).digest(), doc, text_id, start + i) for i in range(n)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["w", *PLACE])

    return rows.mapInArrow(windows, "w binary, doc bigint, text_id bigint, start bigint")


def by_heat(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of keys that go into an index, those of keys with too many rows, and the table of such keys."""
    hot = cut(rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > KEY_ROWS).select("key"), "hot")
    return rows.join(hot, "key", "left_anti"), rows.join(hot, "key", "left_semi"), hot


def hot_marks(rows: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """Step 3 for keys with too many rows, and the tables that it needs."""
    split = cut(later(stretches(rows, length).distinct(), "key", "raw"), "stretches")
    cool, hot, keys = by_heat(split.where("not late").drop("late"))
    found = split.where("late").select(*PLACE, "n").unionByName(indexed_marks(cool, length))
    if not keys.isEmpty():
        found = found.unionByName(later_windows(each_window(hot, length)))
    return found, [split, keys]


def marks(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """_gl_doc, _text and marks (start, n): the windows, n from start on, that also start earlier."""
    rows = cut(compared(all_spans(docs, length)), "spans")
    parts = cut(fetched(docs, rows.where("kind = 2"), length), "parts")
    cool, hot, keys = by_heat(parts)
    found, used = rows.where("kind = 1").select(*PLACE, "n").unionByName(indexed_marks(cool, length)), [rows, parts, keys]
    if not keys.isEmpty():
        more, own = hot_marks(hot, length)
        found, used = found.unionByName(more), used + own
    found = cut(found, "marks")
    for table in used:
        drop(table)
    return found.groupBy(F.col("doc").alias("_gl_doc"), F.col("text_id").alias("_gl_text")).agg(F.collect_list(F.struct("start", "n")).alias("marks"))


def removed_runs(start: np.ndarray, n: np.ndarray, length: int = LENGTH) -> tuple[list[int], list[int]]:
    """Begins and ends of the runs of bytes under marks; runs that touch are one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order].astype(np.int64), (start + n + length - 1)[order].astype(np.int64)
    if not len(start):
        return [], []
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new].tolist(), reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))].tolist()


def kept_pieces(raw: memoryview, begins: list[int], ends: list[int]) -> Iterator[memoryview]:
    """The bytes outside the runs, in order."""
    for a, b in zip([0, *ends], [*begins, len(raw)], strict=True):
        if b > a:
            yield raw[a:b]


def marked(docs: DataFrame, length: int) -> DataFrame:
    found = marks(docs, length).withColumnsRenamed({"_gl_doc": "_gl_m_doc", "_gl_text": "_gl_m_text", "marks": "_gl_marks"})
    own = identified(docs)
    return own.join(found, (own["_gl_doc"] == found["_gl_m_doc"]) & (own["_gl_text"] == found["_gl_m_text"]), "left").drop("_gl_m_doc", "_gl_m_text", "_gl_doc", "_gl_text")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of `docs` (doc_id, text)."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                out = []
                raw, offsets = utf8_bytes(part.column("text"))
                whole = memoryview(raw)
                for a, b, (start, n) in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lists(part.column("_gl_marks"), "start", "n"), strict=True):
                    begins, ends = removed_runs(start, n, length)
                    kept = hashlib.sha256()
                    for piece in kept_pieces(whole[a:b], begins, ends):
                        kept.update(piece)
                    out.append((b - a, sum(ends) - sum(begins), len(begins), kept.hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked(docs.select("doc_id", "text"), length).mapInArrow(lambda batches: given_back(digested(batches)), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def kept_text(text: Column, found: Column, length: int = LENGTH) -> Column:
    """The text without the marked bytes, and without the parts of letters that are left at their edges."""

    @F.arrow_udf("string")
    def rest(texts: pa.Array, marks_: pa.Array) -> pa.Array:
        raw, offsets = utf8_bytes(texts)
        whole, out = memoryview(raw), []
        for a, b, ok, (start, n) in zip(offsets[:-1].tolist(), offsets[1:].tolist(), texts.is_valid().to_pylist(), lists(marks_, "start", "n"), strict=True):
            out.append(b"".join(kept_pieces(whole[a:b], *removed_runs(start, n, length))).decode("utf-8", "ignore") if ok else None)
        return pa.array(out, pa.string())

    return F.when(found.isNull(), text).otherwise(rest(text, found))


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of `docs`, all columns, with the marked bytes removed from `text` and, where it is a column, n_chars counted anew."""
    out = marked(docs, length).withColumn("text", kept_text(F.col("text"), F.col("_gl_marks"), length)).drop("_gl_marks")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


#: Every window by its hash, the first of each stays; removed runs and what lies between them.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
mark AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM late),
run AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mark) GROUP BY doc_id, g),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM run UNION ALL SELECT d.doc_id, coalesce(max(b), 0), max(n) FROM d LEFT JOIN run USING (doc_id) GROUP BY 1),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gap JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(x.gone, 0)::BIGINT AS n_removed, coalesce(x.runs, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS gone, count(*) AS runs FROM run GROUP BY 1) x USING (doc_id)
"""
