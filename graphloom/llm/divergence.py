"""How far the sources of each language differ in what terms they use, by dense blocks of counts.

Null text, lang and source are ''. Terms are `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z in lower case. A language keeps
the V terms in at least LEAST of its documents. A group (a language's source, or the language itself) with N kept
occurrences gives a term with `count` of them the weight p = 1 + floor(10**9 (count + 1) / (N + V)). Between a group's
p and another q, a term adds f = floor((p - q)**2 / q).

1. Terms are counted in maps over batches (occurrences by group, documents by language), summed by (lang, source,
   term) and again by (lang, term): one row a key meets one row a key, whatever the texts hold.
2. Kept terms are dealt by hash into blocks of about BLOCK_TERMS terms of a language, and sources into stripes of about
   STRIPE. A tile is one block of terms and two stripes: a dense int64 matrix, group by term, of at most 2 * STRIPE *
   BLOCK_TERMS numbers or so. Kept terms that none of its groups has are not rows of it; how many there are is
   counted, since all of them have the same weights.
3. In a tile all pairs of groups are broadcast against each other (a few at a time) and summed over terms to one
   partial pair matrix; a heap of the MOST largest f of each group is cut from the tile too. Spark sums the
   matrices, and merges the heaps, of each task first and then of all.

All is whole numbers: p by three steps of long division, so that nothing exceeds 64 bits up to N + V = 9 * 10**15.

Nulls as above; empty texts, and languages that keep no term, still give pairs (of value 0). Repeated rows are documents
of their own. Ties in value are ranked by the item's UTF-8 bytes. An empty table gives an empty result, other columns
are not read. A long text is read part by part; its document counts are summed by Spark if its terms are too
many to hold.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SLICE_BYTES, cut, dealt, drop, given_back, is_long, slices, utf8_bytes, word_parts

#: Documents that must hold a kept term, and ranks of the part `term`.
LEAST, MOST = 3, 200
BLOCK_TERMS, STRIPE = 2048, 128
#: Counts that a task holds before it hands them on.
HELD = 400_000
BILLION = 1_000_000_000
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Bytes between terms.
STOPS = np.ones(256, dtype=bool)
STOPS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
COUNT_TYPE = "lang string, source string, term string, doc string, n bigint, docs bigint"


class Counts:
    """Counts of a task: occurrences by (lang, source) and term, documents by lang and term."""

    def __init__(self):
        self.n: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.docs: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.held = 0

    def add(self, group: tuple[str, str], terms: list[bytes]) -> None:
        n, before = self.n[group], len(self.n[group])
        n.update(terms)
        self.docs[group].update(set(terms))
        self.held += len(n) - before

    def rows(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), n in self.n.items():
            yield from rows_of(lang, source, n, self.docs[lang, source])
        self.__init__()


def rows_of(lang: str, source: str, n: Counter, docs: Counter | None, doc: str | None = None, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Rows of COUNT_TYPE; with `doc`, the documents of its terms are still to be counted by it."""
    terms = list(n)
    for at in range(0, len(terms), most):
        own = terms[at : at + most]
        same = lambda x: pa.array([x] * len(own), pa.string())  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(own, pa.binary()).cast(pa.string()), same(doc), pa.array([n[t] for t in own], pa.int64()), pa.array([docs[t] if docs else 0 for t in own], pa.int64())], COUNT_TYPE.replace(",", "").split()[::2])


def long_counts(lang: str, source: str, raw: np.ndarray, most: int = SLICE_BYTES, held: int = HELD) -> Iterator[pa.RecordBatch]:
    """The counts of one long text; its terms are handed on in several lots if they are too many."""
    n, doc = Counter(), None
    for a, b in word_parts(raw, most, STOPS):
        n.update(TERM.findall(raw[a:b].tobytes().lower()))
        if len(n) > held:
            doc = doc or uuid.uuid4().hex
            yield from rows_of(lang, source, n, None, doc)
            n = Counter()
    yield from rows_of(lang, source, n, None if doc else Counter(dict.fromkeys(n, 1)), doc)


def counted(docs: DataFrame, held: int = HELD) -> DataFrame:
    """Partial counts of COUNT_TYPE; each group also has rows whose term is null."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, groups = Counts(), set()
        for batch in batches:
            for part in slices(batch, "text"):
                langs, sources = part.column("lang").to_pylist(), part.column("source").to_pylist()
                groups |= set(zip(langs, sources, strict=True))
                raw, offsets = utf8_bytes(part.column("text"))
                if is_long(part.column("text")):
                    yield from long_counts(langs[0], sources[0], raw, held=held)
                    continue
                low = raw.tobytes().lower()
                for a, b, group in zip(offsets[:-1].tolist(), offsets[1:].tolist(), zip(langs, sources, strict=True), strict=True):
                    counts.add(group, TERM.findall(low[a:b]))
                if counts.held > held:
                    yield from counts.rows()
                if len(groups) > held:
                    yield headers(groups)
                    groups = set()
        yield from counts.rows()
        if groups:
            yield headers(groups)

    def headers(groups: set) -> pa.RecordBatch:
        lang, source = zip(*groups, strict=True)
        none = [None] * len(lang)
        zero = pa.array([0] * len(lang), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(none, pa.string()), pa.array(none, pa.string()), zero, zero], COUNT_TYPE.replace(",", "").split()[::2])

    plain = docs.select("text", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    return plain.mapInArrow(lambda batches: given_back(found(batches)), COUNT_TYPE)


def totals(partial: DataFrame) -> DataFrame:
    """lang, source, term, n and docs: sums of the partial counts; documents handed on by several lots count once a term."""
    whole = partial.where("doc is null").select("lang", "source", "term", "n", "docs")
    lots = partial.where("doc is not null").groupBy("lang", "source", "term", "doc").agg(F.sum("n").alias("n")).select("lang", "source", "term", "n", F.lit(1).cast("bigint").alias("docs"))
    return whole.union(lots).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def stripe(source: Column, stripes: Column) -> Column:
    return F.pmod(F.xxhash64(source, F.lit(1)), stripes).cast("int")


def block(term: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(term, F.lit(2)), blocks).cast("int")


def weight(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 (count + 1) / total), by long division in steps of a thousand; total is at least 1."""
    rest, out = count.astype(np.int64) + 1, np.int64(0)
    whole, rest = np.divmod(rest, total)
    out = whole
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


TILE = ["lang", "block", "a", "b"]
#: `own` is the stripe of a group; see `tile_rows` for the rest.
TILE_TYPE = "lang string, block int, a int, b int, own int, source string, term string, n bigint, total bigint, terms bigint"
PART_TYPE = "lang string, source string, part string, item string, value bigint"
#: Numbers that a step of a tile's broadcasts holds.
STEP = 1 << 20


def tile_rows(table: pa.Table, most: int = MOST) -> pa.Table:
    """The partial sums of all pairs between the two stripes of a tile, and the top terms of its groups.

    A row with source and term is a cell: n the group's count, total the language's. With a source alone it is a group: n
    and total are what the group and the language have of kept terms, terms is V. The row without a source has in
    `terms` how many kept terms the block has.
    """
    lang, a, b = (table[c][0].as_py() for c in ("lang", "a", "b"))
    is_cell = table["term"].is_valid()
    is_group = np.asarray(table["source"].is_valid()) & ~np.asarray(is_cell)
    groups, cells = table.filter(pa.array(is_group)), table.filter(is_cell)
    held = sum(x or 0 for x in table.filter(table["source"].is_null())["terms"].to_pylist())
    numbers = lambda t, c: np.asarray(t[c].combine_chunks(), dtype=np.int64)
    sources, own, kept = groups["source"].to_pylist(), numbers(groups, "own"), numbers(groups, "terms")
    size = np.maximum(numbers(groups, "n") + kept, 1)
    coded, names = cells["term"].combine_chunks().dictionary_encode(), cells["source"].combine_chunks().dictionary_encode()
    words, column = coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64)
    place = {s: i for i, s in enumerate(sources)}
    row = np.array([place[s] for s in names.dictionary.to_pylist()], np.int64)[np.asarray(names.indices, dtype=np.int64)]
    counts, all_ = np.zeros((len(sources), len(words)), np.int64), np.zeros(len(words), np.int64)
    counts[row, column], all_[column] = numbers(cells, "n"), numbers(cells, "total")
    p, none = weight(counts, size[:, None]), weight(np.zeros(len(sources), np.int64), size)
    out: list[tuple[str, str, str, int]] = []
    # All pairs: terms that some group of the tile has, and those that none has, whose weights are all alike.
    sums = (held - len(words)) * gap(none[:, None], none[None, :])
    rows = max(1, STEP // max(1, len(sources) * len(words)))
    for at in range(0, len(sources), rows):
        sums[at : at + rows] += gap(p[at : at + rows, None, :], p[None, :, :]).sum(axis=2)
    wanted = (own[:, None] != own[None, :]) | (a == b)
    for i, j in zip(*np.nonzero(wanted), strict=True):
        if i != j:
            out.append((sources[i], "pair", sources[j], int(sums[i, j])))
    if a == b and len(sources):
        q = weight(all_, max(int(numbers(groups, "total")[0] + kept[0]), 1))
        for i, source in enumerate(sources):
            above = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            values = gap(p[i, above], q[above])
            best = heapq.nsmallest(most, zip((-values).tolist(), [words[k] for k in above], strict=True))
            out += [(source, "term", term, -value) for value, term in best]
    columns = [pa.array([lang] * len(out), pa.string()), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64())))]
    return pa.Table.from_arrays(columns, ["lang", "source", "part", "item", "value"])


def tiles(cells: DataFrame, kept: DataFrame, groups: DataFrame, block_terms: int, per_stripe: int) -> DataFrame:
    """The rows of all tiles, TILE_TYPE. `groups` has (lang, source, n), `kept` (lang, term, total), `cells` both with n."""
    own = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("total"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(own, "lang", "left").fillna(0, ["terms", "total"])
    pieces = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
    langs = cut(langs.select("lang", F.col("terms").alias("v"), F.col("total").alias("all"), pieces("terms", block_terms).alias("blocks"), pieces("groups", per_stripe).alias("stripes")), "langs")
    to_all = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    side = lambda: [F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")]
    striped = lambda df: df.join(langs, "lang").withColumn("own", stripe(F.col("source"), F.col("stripes"))).withColumn("other", to_all("stripes"))
    cell = striped(cells).select("lang", block(F.col("term"), F.col("blocks")).alias("block"), *side(), "own", "source", "term", "n", "total", F.lit(None).cast("bigint").alias("terms"))
    head = striped(groups).withColumn("block", to_all("blocks")).select("lang", "block", *side(), "own", "source", F.lit(None).cast("string").alias("term"), "n", F.col("all").alias("total"), F.col("v").alias("terms"))
    sizes = kept.join(langs, "lang").groupBy("lang", block(F.col("term"), F.col("blocks")).alias("block"), "stripes").agg(F.count("*").alias("terms"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    size = sizes.withColumn("a", to_all("stripes")).withColumn("b", F.explode(F.sequence("a", F.col("stripes") - 1)))
    size = size.select("lang", "block", "a", "b", none("int", "own"), none("string", "source"), none("string", "term"), none("bigint", "n"), none("bigint", "total"), "terms")
    return cell.union(head).union(size)


def ranked(parts: DataFrame, most: int = MOST) -> DataFrame:
    """lang, source, part, item, value and rank: pair matrices summed, heaps merged."""
    best = [F.desc("value"), "item"]
    pair = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pair = pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best)))
    # A group's heaps are merged by lots of them first, then those of the lots.
    lot = F.pmod(F.xxhash64("item"), F.lit(64))
    term = parts.where("part = 'term'").withColumn("lot", lot).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "lot").orderBy(*best))).where(F.col("rank") <= most)
    term = term.drop("lot").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best))).where(F.col("rank") <= most)
    return pair.select("lang", "source", "part", "item", "value", "rank").union(term.select("lang", "source", "part", "item", "value", "rank"))


def audit(docs: DataFrame, least: int = LEAST, most: int = MOST, block_terms: int = BLOCK_TERMS, per_stripe: int = STRIPE) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank for every group of `docs` (text, lang, source)."""
    partial = cut(counted(docs), "counted")
    counts = cut(totals(partial), "counts")
    drop(partial)
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = cut(kept.where(F.col("docs") >= least).select("lang", "term", "total"), "kept")
    names = kept.select(F.col("lang").alias("_lang"), F.col("term").alias("_term"), "total")
    cells = cut(counts.join(names, dealt("lang", "term") == dealt("_lang", "_term")).select("lang", "source", "term", "n", "total"), "cells")
    inside = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = cut(counts.where("term is null").select("lang", "source").join(inside, ["lang", "source"], "left").fillna(0, ["n"]), "groups")
    parts = cut(tiles(cells, kept, groups, block_terms, per_stripe).groupBy(*TILE).applyInArrow(lambda t: tile_rows(t, most), PART_TYPE), "tiles")
    return ranked(parts, most)


#: Every group's counts of every kept term, all pairs of groups by a join on the term.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
occ AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS total FROM occ GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS all_n FROM kept GROUP BY lang),
cell AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, k.total FROM grp g JOIN kept k ON g.lang = k.lang LEFT JOIN occ o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
gn AS (SELECT lang, source, sum(n)::BIGINT AS gn FROM cell GROUP BY ALL),
p AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 1)) // (gn + v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (total + 1)) // (all_n + v))::BIGINT AS q FROM cell JOIN gn USING (lang, source) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
both_ AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_) WHERE part = 'pair' OR rank <= 200
"""
