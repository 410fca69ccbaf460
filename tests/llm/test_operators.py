"""The corpus operators against brute force, SQL, libraries and round trips, on awkward rows and on the small tables."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, components, decontaminate, html_extract, language_id, mixing, progressive_jpeg, quality, queries, simhash, suffix_dedup, token_counts, warc
from graphloom.llm.run_index import RunIndex

from . import brute

DATA = "/root/testdata"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
needs_tokenizers = pytest.mark.skipif(not os.path.isfile(queries.WORDS), reason="no vocabularies")

_rng = random.Random(5)
_word = lambda: "".join(_rng.choice("abcdefghij") for _ in range(_rng.randint(1, 8)))
PASSAGE = " ".join(_word() for _ in range(60))
LONG = " ".join(_word() for _ in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog " * 4, "en", "a"),
    (2, None, "en", "b"),
    (3, "", None, None),
    (4, " \t\n ", "de", "b"),
    (5, LONG, "fr", "a"),
    (6, "start " + PASSAGE + " end of six", "en", "c"),
    (7, "other start " + PASSAGE + " another end", "en", None),
    (8, "start " + PASSAGE + " end of six", "en", "c"),
    (9, "a" * 450, None, "c"),
    (10, "É" * 120 + " " + "é ü ß 中文 \U0001f642 " * 20, "de", "d"),
    (10, "É" * 120 + " " + "é ü ß 中文 \U0001f642 " * 20, "de", "d"),
    (11, "One", "en", "a"),
    (12, "x" + PASSAGE[1:], "es", "d"),
    (13, "lone \x00 control", "en", "e"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
#: Columns that the operators use themselves.
CLASHES = ("score", "fp", "size", "key", "start", "spans", "component_id", "target", "item_id", "stats", "label", "marks", "anchor", "sid", "held_out", "doc", "n")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumn("n_chars", F.char_length("text").cast("bigint")).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts():
    return sorted({(i, t) for i, t, _, _ in ROWS}, key=lambda x: x[0])


# 6: suffix-array dedup


def check_removal(df, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}
    want = {i: brute.digest(*x) for i, x in brute.removed_bytes(rows).items()}
    assert got == want


def test_suffix_dedup_awkward(docs, empty):
    out = suffix_dedup.digests(docs)
    assert out.count() == len(ROWS)
    check_removal(out, texts())
    assert suffix_dedup.digests(empty).count() == 0


def test_suffix_dedup_null_ids_come_last(spark):
    df = spark.createDataFrame([(None, PASSAGE), (3, PASSAGE)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.digests(df).collect()}
    assert got == {3: 0, None: len(PASSAGE)}


@pytest.mark.parametrize("key_rows", [8000, 1])
def test_suffix_dedup_many_surroundings(spark, monkeypatch, key_rows):
    """One passage in many surroundings, by the index and by single windows."""
    monkeypatch.setattr(suffix_dedup, "KEY_ROWS", key_rows)
    rng = random.Random(key_rows)
    noise = lambda n: "".join(rng.choice("ab cd") for _ in range(n))
    base = noise(160)
    rows = [(i, noise(rng.randint(0, 90)) + base[rng.randint(0, 30) : rng.randint(100, 160)] + noise(rng.randint(0, 90))) for i in range(60)]
    rows += [(100 + i, noise(3) * 70) for i in range(4)]
    check_removal(suffix_dedup.digests(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)), rows)


@needs_data
def test_suffix_dedup_stretches_of_hot_keys(spark, monkeypatch):
    """One passage in many surroundings, some of them equal over a window: keys, stretches and windows beyond a bound of two rows, or of some."""
    rng = random.Random(8)
    core = "".join(rng.choice("abcdefgh") for _ in range(95))
    ends = ["".join(rng.choice("xyz") for _ in range(rng.randint(3, 90))) for _ in range(7)]
    rows = [(i, rng.choice(ends) + core + rng.choice(ends)) for i in range(60)]
    want = {i: brute.digest(*x) for i, x in brute.removed_bytes(rows).items()}
    for bound in (2, 12, 8_000):
        monkeypatch.setattr(suffix_dedup, "KEY_ROWS", bound)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
        assert got == want


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    """Texts read in stretches, chunks of a few spans, and small batches of sorted spans give what whole ones give."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(90))
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 900))) + passage[rng.randint(0, 40) :] * rng.randint(0, 3)) for i in range(25)] + [(30, passage * 9)]
    want = {i: brute.digest(*x) for i, x in brute.removed_bytes(rows).items()}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "is_long", lambda column, most=700: common.is_long(column, most))
    monkeypatch.setattr(suffix_dedup, "slices", lambda batch, column, most=700: common.slices(batch, column, most))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_suffix_dedup_table(spark):
    df = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    check_removal(suffix_dedup.digests(df), [tuple(r) for r in df.select("doc_id", "text").collect()])


def test_deduplicated_keeps_columns_and_letters(docs):
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    kept = {r.doc_id: r for r in out.collect()}
    assert kept[8].text == "" and kept[2].text is None and kept[8].n_chars == 0 and kept[6].text == ROWS[5][1]


def test_run_index_statistics():
    rng = np.random.default_rng(1)
    strings = [rng.integers(97, 99, rng.integers(1, 30)).astype(np.int64) for _ in range(40)]
    text = np.concatenate([np.append(s, 512 + i) for i, s in enumerate(strings)])
    index = RunIndex.build(text, 30)
    before, after = index.statistics(len(text))
    order = sorted(range(len(text)), key=lambda i: (text[i:].tolist()))
    share = lambda a, b: next((k for k in range(min(len(text) - a, len(text) - b)) if text[a + k] != text[b + k]), min(len(text) - a, len(text) - b))
    for at in range(1, len(order)):
        assert before[order[at]] == share(order[at - 1], order[at]) == after[order[at - 1]]
    windows = [tuple(text[i : i + 4]) for i in range(len(text))]
    want = [i for i, w in enumerate(windows) if max(w) < 512 and len(w) == 4 and w in windows[:i]]
    assert index.repeats(len(text), 4).tolist() == want
    assert index.lengths.sum() == len(text) and len(index.letters) <= len(text)


# 7: SimHash


def check_simhash(df, rows):
    fps = {i: brute.fingerprint(t) for i, t in rows}
    comp = brute.components(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()} == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def test_simhash_awkward(docs, empty, spark):
    out = simhash.near_duplicates(docs)
    assert out.count() == len(ROWS)
    check_simhash(out, texts())
    assert simhash.near_duplicates(empty).count() == 0
    alone = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, "zz")], "doc_id bigint, text string"))
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in alone.collect()) == [(0, 0), (0, 4), (4, 4)]


@needs_data
def test_simhash_table(spark):
    df = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    check_simhash(simhash.near_duplicates(df), [tuple(r) for r in df.select("doc_id", "text").collect()])


@pytest.mark.parametrize("block", [4096, 40])
@pytest.mark.parametrize("n", [None, 1 << 23, 1 << 28, 1 << 31])
def test_simhash_links_of_a_dense_cluster(spark, block, n):
    """Fingerprints around a few centres, with keys dealt out by pairs of blocks and not, by the ring of each size of table."""
    rng = np.random.default_rng(block)
    fps = set()
    for c in rng.integers(0, 1 << 63, 4):
        for _ in range(150):
            fps.add(int(c) ^ sum({1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 6))}))
    rows = list(enumerate(sorted(fps)))
    reps = spark.createDataFrame([(f, i) for i, f in rows], "fp bigint, node bigint")
    found = {r.node: r.component for r in components.components(simhash.links(reps, block, n)).collect()}
    want = brute.components({i: f for i, f in rows})
    assert {i: found.get(i, i) for i, _ in rows} == want


@pytest.mark.parametrize("n", [1, 1 << 23, 1 << 28, 1 << 31])
def test_simhash_rings_lose_no_pair(n):
    own, rng = simhash.ring(n), np.random.default_rng(n)
    x = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(5000)], np.uint64)
    met = np.zeros(len(x), dtype=bool)
    for start, parts in own.keys:
        mask = np.uint64(sum(((1 << size) - 1) << at for at, size in parts))
        same = np.flatnonzero((x & mask) == 0)
        met[same[simhash.passing(x[same], own.tests(start))]] = True
    assert met.all() and len(own.keys) < 128


def test_simhash_comparisons_do_not_grow_with_the_table():
    """Pairs that share a key, for each fingerprint of a random table, at the ring of its size."""
    for n in (10_000, 100_000, 1_000_000):
        fps = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        pairs = 0
        for _, parts in simhash.ring(n).keys:
            mask = np.uint64(sum(((1 << size) - 1) << at for at, size in parts))
            _, count = np.unique(fps & mask, return_counts=True)
            pairs += int((count * (count - 1) // 2).sum())
        assert pairs / n < 30
    # Beyond, a key has at least as many bits as keep that bound: keys x rows of a key.
    for bits in range(20, 34):
        assert len(simhash.ring(1 << bits).keys) * 2 ** (bits - min(sum(size for _, size in parts) for _, parts in simhash.ring(1 << bits).keys)) <= 512


def test_simhash_of_long_texts():
    for t in (LONG, "x" * 5000 + " y", " " * 50 + "a b", "", "A b C"):
        raw = np.frombuffer(t.encode(), np.uint8)
        assert {simhash.long_fingerprint(raw, most) for most in (3, 1000, 1 << 30)} == {brute.fingerprint(t)}


def test_one_of_each(docs):
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    comp = brute.components({i: brute.fingerprint(t) for i, t in texts()})
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i in comp if comp[i] == i)


def test_one_of_each_of_repeated_ids(spark):
    """One id with three texts: one near a smaller id, one that heads a group of its own, one alone."""
    a, b, c = PASSAGE, " ".join(f"other{i}" for i in range(40)), " ".join(f"third{i}" for i in range(40))
    rows = [(1, a), (5, a), (5, b), (5, b), (5, c), (7, b)]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(tuple(r) for r in out.collect()) == sorted([(1, a), (5, b), (5, c)])


def skewed(spark, plan) -> bool:
    """Whether a plan splits a skewed join when thresholds are low and nothing is broadcast."""
    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        df = plan()
        df.write.format("noop").mode("overwrite").save()
        df = df.groupBy().agg(*[F.count(c) for c in df.columns])
        df.collect()
        return "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_keys_are_split(spark):
    """Nine tenths of the rows on one key: a star's centre, a page that repeats, a window that repeats."""
    hot = spark.range(100_000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).cast("bigint").alias("b"), (F.col("id") + 1).alias("a")).where("a != b")
    assert skewed(spark, lambda: components._starred(common.cut(hot, "t"), True))
    pages = hot.select(F.col("a").alias("page_id"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("<p>"), "b").alias("html"))
    assert skewed(spark, lambda: warc.with_references(common.cut(pages, "t")))
    windows = hot.select(F.col("b").cast("string").cast("binary").alias("w"), F.col("a").alias("doc"), F.lit(1).cast("bigint").alias("text_id"), F.lit(1).cast("bigint").alias("start"))
    assert skewed(spark, lambda: suffix_dedup.later_windows(common.cut(windows, "t")))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (202, 201), (300, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got[50] == 0 and got[100] == 0 and got[202] == 200
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 10: decontamination


def test_decontamination_awkward(docs, empty, spark):
    words = PASSAGE.split()
    items = [(1, PASSAGE), (2, " ".join(words[5:50] + ["other", "words", "here"])), (3, None), (4, ""), (5, "one"), (6, "quick brown FOX\tjumps over"), (7, " ".join(words[:20] + ["no"] * 30)), (8, " ".join(LONG.split()[20_000:20_012])), (1, PASSAGE)]
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in decontaminate.leaks(docs, table).collect()}
    assert got == brute.leaks(texts(), items) and {(5, 8), (11, 5), (1, 6), (6, 1)} <= set(got)
    clean = decontaminate.clean(docs, table)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in texts()} - {d for d, _ in got}
    assert decontaminate.leaks(empty, table).count() == 0 and decontaminate.leaks(docs, table.limit(0)).count() == 0 and decontaminate.clean(docs, table.limit(0)).count() == len(ROWS)


def test_decontamination_blocks_and_thresholds(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(10)]
    docs = []
    for d in range(80):
        words = items[rng.randrange(10)][1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "zz"
        docs.append((d, " ".join(["pre"] * rng.randint(0, 3) + words + ["post"] * rng.randint(0, 3))))
    for threshold in (0.5, 0.8, 1.0):
        got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), threshold)
        assert {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in got.collect()} == brute.leaks(docs, items, threshold)


def test_decontamination_of_long_documents():
    """Part by part the same leaks are found as in one piece."""
    words = LONG.split()
    items = [(1, " ".join(words[100:112])), (2, " ".join(words[5000:5040])), (3, "zz yy"), (4, words[77]), (5, " ".join(words[9:13])), (6, " ".join(words[2000:2010] + ["q"] * 20)), (7, "none of these words here")]
    sketches = decontaminate.Sketches(items, 0.8)
    raw = np.frombuffer(LONG.encode(), np.uint8)
    whole = {(i, g) for _, i, g in sketches.links(pa.array([LONG]))}
    assert {sketches.ids[i] for i, _ in whole} >= {1, 2, 4, 5} and not {sketches.ids[i] for i, _ in whole} & {3, 6, 7}
    for most in (7, 1000, 1 << 30):
        assert {(i, g) for _, i, g in sketches.long_links(raw, most)} == whole


# 4: mixing


def duck(tmp_path, **tables):
    import duckdb

    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path / name}/*.parquet')")
    return con


def test_mixing_awkward(docs, empty, tmp_path):
    out = mixing.mix(docs)
    got = sorted(tuple(r) for r in out.collect())
    own = docs.select("doc_id", "text", "source")
    assert got == sorted(duck(tmp_path, documents=own).execute(mixing.ORACLE_SQL).fetchall())
    assert all(taken <= 2 * size for _, size, _, _, taken, *_ in got)
    assert sorted(tuple(r) for r in mixing.mix(docs.repartition(7)).collect()) == got
    assert mixing.mix(empty).count() == 0


def test_mixing_schedule(docs, spark):
    sources = spark.createDataFrame([("a", 0, 9000, 5120.0, 5120), ("b", 1, 9000, 2048.0, 2048), ("c", 2, 500, 300.0, 300), ("d", 3, 0, 0.0, 0)], "source string, sid int, source_size bigint, target double, words bigint")
    slots = mixing.schedule(sources, 8).orderBy("slot").collect()
    assert [sum(r.sid == s for r in slots) for s in range(4)] == [640, 256, 38, 0]
    for s in range(3):
        mine = [r for r in slots if r.sid == s]
        assert sorted(r.k for r in mine) == list(range(len(mine)))
        # Low discrepancy: every prefix of the schedule holds nearly its share of each source.
        share = len(mine) / len(slots)
        assert all(abs(sum(r.sid == s for r in slots[:n]) - share * n) < 5 for n in range(0, len(slots), 37))


def test_mixed_sequence(docs, spark):
    out = mixing.mixed(docs, 64).collect()
    assert [r.slot for r in out] == sorted(r.slot for r in out)
    own = {}
    for r in out:
        own[r.doc_id] = own.get(r.doc_id, 0) + r.stop - r.first
    want = {}
    for r in mixing.mix(docs, 64).where("taken > 0").collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert own == want and all(0 <= r.first < r.stop for r in out)
    blocks = {}
    for r in out:
        blocks.setdefault((r.slot, r.source, r.k), 0)
        blocks[r.slot, r.source, r.k] += r.stop - r.first
    assert len(blocks) == len({r.slot for r in out}) and max(blocks.values()) <= 64
    # Sources alternate as the schedule has it, and the blocks of each come in their order.
    assert len({r.source for r in out[:40]}) > 1
    for source in {r.source for r in out}:
        mine = [r.k for r in out if r.source == source]
        assert mine == sorted(mine)


def test_mixing_of_nothing(spark):
    out = mixing.mix(spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id bigint, text string, source string"))
    assert [(r.size, r.target, r.taken) for r in out.collect()] == [(0, 0.0, 0)] * 2


# 8: token counts


@needs_tokenizers
def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = queries.WORDS
    library = Tokenizer.from_file(path)
    want = sorted((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, _, _ in ROWS)
    assert sorted(tuple(r) for r in token_counts.count_tokens(docs, path).collect()) == want
    assert token_counts.count_tokens(empty, path).count() == 0


@needs_tokenizers
def test_token_counts_of_random_text(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.WORDS)
    rng = random.Random(2)
    letters = "abcdeghiorstu's ß é İ Σ 中 ३ ½ ´  \x1c ​!?.…-—\U0001f642" + "ABC" + "\u209d\u209e\ua7cb\ua7dc\u0301\u0345\u1100\u1161"
    special = ["<|endoftext|>", "they're", "'LL", "ΑΣ", "é"]
    for part, chunk in ((1 << 16, 1 << 16), (7, 3)):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        monkeypatch.setattr(token_counts, "GROUP", 4 * chunk)
        monkeypatch.setattr(token_counts.parts, "__defaults__", (part,))
        count = token_counts.Counter(queries.WORDS)
        for _ in range(1500):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + rng.choice(special) * rng.randint(0, 2)
            assert count(t) == len(library.encode(t, add_special_tokens=False).ids), t


@needs_tokenizers
def test_token_counts_of_every_kind_of_character():
    """One of every 41 code points, and all of which Python's tables and the library's are known to differ, in five surroundings."""
    from tokenizers import Tokenizer

    library, count = Tokenizer.from_file(queries.WORDS), token_counts.Counter(queries.WORDS)
    codes = [c for c in (*range(0x80, 0x110000, 41), *range(0x10D0, 0x1100), *range(0x2080, 0x20A0), *range(0xA7B0, 0xA800), *range(0x1C80, 0x1CC0)) if not 0xD800 <= c < 0xE000]
    texts = [x.format(chr(c)) for c in codes for x in ("a{}b", "1{}!", "'{}s", "A{}\u0301", "{0}{0} {0}")]
    wrong = [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if count(t) != len(e.ids)]
    assert not wrong


@needs_tokenizers
def test_token_counts_of_long_words():
    from tokenizers import Tokenizer

    library, count = Tokenizer.from_file(queries.WORDS), token_counts.Counter(queries.WORDS)
    rng = random.Random(3)
    for t in ("".join(rng.choice("abcdehiorst") for _ in range(300_000)), "=" * 300_000, "'" * 9001 + "s", "中文" * 60_000, "a1" * 100_000, ("x" * 70_000 + " ") * 3):
        assert count(t) == len(library.encode(t, add_special_tokens=False).ids), t[:20]
        assert max(map(len, count.words), default=0) <= token_counts.LONGEST_RUN and len(count.words.transducer.fits) <= token_counts.MOST_FITS


@needs_tokenizers
def test_token_chunk_maps_compose():
    """A map gives what running its chunk gives, from any state, and joining is associative."""
    machine = token_counts.Counter(queries.WORDS).words.transducer
    rng = random.Random(4)
    chunks = ["".join(rng.choice("abcdehiorst=") for _ in range(rng.randint(1, 60))).encode() for _ in range(9)]
    maps = [token_counts.ChunkMap(machine, c) for c in chunks]
    left = maps[0]
    for m in maps[1:]:
        left = token_counts.then(left, m)
    right = maps[-1]
    for m in maps[-2::-1]:
        right = token_counts.then(m, right)
    for entry in rng.sample(range(len(machine.keys)), 40):
        state, total = entry, 0
        for b in b"".join(chunks):
            state, n = machine.step(state, b)
            total += n
        assert left(entry) == right(entry) == token_counts.joined(maps)(entry) == (state, total)


@needs_tokenizers
def test_token_counts_survive_full_caches(monkeypatch):
    whole = token_counts.Counter(queries.WORDS)(LONG), token_counts.Counter(queries.WORDS)("abcdefgh" * 9000)
    for name in ("MOST_STATES", "MOST_WORDS", "MOST_FITS"):
        monkeypatch.setattr(token_counts, name, 50)
    monkeypatch.setattr(token_counts, "GROUP", 5000)
    assert (token_counts.Counter(queries.WORDS)(LONG), token_counts.Counter(queries.WORDS)("abcdefgh" * 9000)) == whole


# 1: language identification


@needs_tokenizers
def test_language_forward_sums_all_segmentations():
    vocab = language_id.vocabulary(queries.PIECES)
    number = {p: i for i, p in enumerate(vocab.pieces)}
    rng = np.random.default_rng(0)
    weights = rng.random((vocab.size + 2, 2))
    weights /= weights[: vocab.size].sum(0)
    weights[vocab.size], weights[vocab.size + 1] = 0, language_id.UNKNOWN
    for word in ("the", "a", "zusammen", "中x", "a" * 40, "erthananonthereingtionable"):
        marked = language_id.MARK + word
        alpha = [np.full(2, -np.inf) for _ in range(len(marked) + 1)]
        alpha[0] = np.zeros(2)
        for t in range(1, len(marked) + 1):
            for n in range(1, min(t, vocab.longest) + 1):
                i = number.get(marked[t - n : t], vocab.size + 1 if n == 1 else None)
                if i is not None:
                    alpha[t] = np.logaddexp(alpha[t], alpha[t - n] + np.log(weights[i]))
        assert np.allclose(language_id.Scorer(vocab, weights)([word])[0], alpha[-1])


@needs_tokenizers
def test_language_awkward(docs, empty):
    path = queries.PIECES
    out = {r.doc_id: r for r in language_id.identify(docs, path).collect()}
    assert {i for i, r in out.items() if r.lang_pred == "und"} == {2, 3, 4}
    assert all(0 <= r.score <= 1 for r in out.values()) and out[2].score == 0
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    assert language_id.identify(empty, path).count() == 0
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")), path)
    assert {(r.lang_pred, r.score) for r in unlabelled.collect()} == {("und", 0.0)}


@needs_data
@needs_tokenizers
@pytest.mark.parametrize("rounds", [1, 2])
def test_language_held_out_accuracy(spark, rounds):
    df = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    out = language_id.identify(df, queries.PIECES, rounds).where("held_out").join(df.select("doc_id", "lang"), "doc_id")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.98


def brute_language(rows, path, smoothing=0.05, unknown=1e-10):
    """Language and posterior of each text, by sums over all cuts of every word, letter by letter in plain Python."""
    import math
    from collections import defaultdict

    vocab = language_id.vocabulary(path)
    known = set(vocab.pieces)

    def forward(word, weight):
        a = [1.0] + [0.0] * len(word)
        for t in range(1, len(word) + 1):
            a[t] = sum(a[t - n] * weight(word[t - n : t]) for n in range(1, min(t, vocab.longest) + 1))
        return a

    def words(text):
        return ["▁" + w for w in (text or "").lower().split()]

    flat = lambda piece: 1 / vocab.size if piece in known else unknown if len(piece) == 1 else 0.0
    counts = defaultdict(lambda: defaultdict(float))
    for i, text, lang, _ in rows:
        if lang is None or zlib.crc32(str(i).encode()) % 4 == 2:
            continue
        for w in words(text):
            a = forward(w, flat)
            b = forward(w[::-1], lambda piece: flat(piece[::-1]))[::-1]
            for t in range(1, len(w) + 1):
                for n in range(1, min(t, vocab.longest) + 1):
                    if (piece := w[t - n : t]) in known:
                        counts[lang][piece] += a[t - n] * flat(piece) * b[t] / a[-1]
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + smoothing * vocab.size for x in langs}
    out = {}
    for i, text, _, _ in rows:
        logs = [sum(math.log(forward(w, lambda p: (counts[x][p] + smoothing) / total[x] if p in known else unknown if len(p) == 1 else 0.0)[-1]) for w in words(text)) for x in langs]  # noqa: B023
        if not any(c.isalpha() for c in text or ""):
            out[i] = ("und", 0.0)
        else:
            top = max(range(len(langs)), key=lambda k: (logs[k], -k))
            out[i] = (langs[top], 1 / sum(math.exp(v - logs[top]) for v in logs))
    return out


@needs_tokenizers
def test_language_against_brute_force(spark):
    texts_ = {"en": "the old house on the hill was sold to a young farmer", "de": "das alte haus auf dem berg wurde einem jungen bauern verkauft", "fr": "la vieille maison sur la colline fut vendue à un jeune fermier"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(texts_[lang].split())[: 3 + i % 6]) + (" Ünïx9 中" if i % 5 == 0 else ""), lang if i % 7 else None, None) for i, lang in enumerate(list(texts_) * 8)]
    rows += [(100, None, "en", None), (101, "123 ...", "de", None), (102, "haus the maison", None, None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, SCHEMA).repartition(3), queries.PIECES).collect()}
    want = brute_language(rows, queries.PIECES)
    assert {i: r.lang_pred for i, r in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(abs(got[i].score - v) < 2e-4 for i, (_, v) in want.items())


@needs_tokenizers
def test_language_of_long_words_and_texts(monkeypatch):
    """Blocks of letters and parts of texts give what whole ones give."""
    vocab = language_id.vocabulary(queries.PIECES)
    rng = np.random.default_rng(0)
    weights = rng.random((vocab.size + 2, 3)) + 1e-4
    weights /= weights[: vocab.size].sum(0)
    weights[vocab.size], weights[vocab.size + 1] = 0, language_id.UNKNOWN
    words = ["".join(rng.choice(list("etaoinshrdlu中é"), n)) for n in (1, 23, 24, 25, 90, 333)]
    times = rng.integers(1, 4, (len(words), 3)).astype(float)
    flat = weights[:, :1]
    whole = language_id.Scorer(vocab, weights)(words), language_id.expected(vocab, weights, words, times), language_id.expected(vocab, flat, words, times)
    monkeypatch.setattr(language_id, "LONG_WORD", 1)
    for cells in (1, language_id.CELLS):
        monkeypatch.setattr(language_id, "CELLS", cells)
        assert np.allclose(whole[0], language_id.Scorer(vocab, weights)(words)) and np.allclose(whole[1], language_id.expected(vocab, weights, words, times)) and np.allclose(whole[2], language_id.expected(vocab, flat, words, times))
    parts = list(language_id.text_parts(pa.array(["ab cd\u00e9f " * 50]), 7))
    assert len(parts) > 20 and "".join(p[0].as_py() for p in parts) == "ab cd\u00e9f " * 50


# 3: quality


def brute_statistics(text):
    """The statistics of a text by the words of their definitions."""
    import math
    import statistics

    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n")]
    lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    size, n = max(len(raw), 1), max(len(words), 1)
    lengths = [len(w) for w in words] or [0]
    in_class = lambda b, name: b in quality.CLASSES[name]
    out = [sum(raw.count(bytes([b])) for b in chars) / size for chars in quality.CLASSES.values()]
    out += [math.log1p(len(raw)), math.log1p(len(words)), min(statistics.mean(lengths), 40), min(statistics.pstdev(lengths), 40), len(set(words)) / n if words else 1.0]
    out += [math.log1p(len(words) / max(len(lines), 1)), len(set(lines)) / len(lines) if lines else 1.0]
    out += [sum(in_class(w[-1 - (len(w) > 2)], "upper") for w in words) / n, sum(any(in_class(w[-1], c) for c in ("bang", "bar", "mark")) for w in words) / n, math.log1p(max(lengths))]
    return np.array(out)


def brute_quality(docs, labels):
    """Scores by one system of equations for each fold over all rows at once, and isotonic means by the max-min formula."""
    import pandas as pd

    found = {i: brute_statistics(t) for i, t in docs}
    train = sorted(i for i, _ in labels if i in found and zlib.crc32(str(i).encode()) % 3 != 1)
    y = np.array([dict(labels)[i] for i in train], float)
    x = np.array([found[i] for i in train])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = quality.fourier((x - mean) / scale)
    fold = (pd.util.hash_array(np.array(train)) >> 7) % quality.FOLDS

    def ridge(rows):
        penalty = np.full(z.shape[1], max(quality.RIDGE * rows.sum(), 1e-2))
        penalty[-1] = 1e-9
        return np.linalg.solve(z[rows].T @ z[rows] + np.diag(penalty), z[rows].T @ y[rows])

    grid = lambda raw: np.clip((raw + 0.5) / 2, 0, 1) * (quality.GRID - 1)
    raw = np.array([row @ ridge(fold != f) for row, f in zip(z, fold, strict=True)])
    place = np.rint(grid(raw)).astype(int)
    at = np.unique(place)
    good, n = (np.array([w[place == p].sum() for p in at], float) for w in (y, np.ones(len(y))))
    pooled = [max(min(good[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    final = ridge(np.ones(len(y), bool))
    return {i: float(np.interp(grid(quality.fourier(((s - mean) / scale)[None])[0] @ final), at, pooled)) for i, s in found.items()}


@needs_data
def test_quality_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").where("quality is not null")
    got = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    want = brute_quality([tuple(r) for r in docs.collect()], [(r.doc_id, r.quality) for r in labels.collect()])
    # Places between two of the calibration grid may round to either.
    assert got.keys() == want.keys() and np.mean([abs(got[i] - want[i]) < 1e-6 for i in got]) > 0.97 and max(abs(got[i] - want[i]) for i in got) < 0.2


def test_quality_statistics():
    for t in (LONG, "", " \n\n", "One\nTWO two!\n\nOne\n", "a" * 300 + "\n" + "b c*" * 40, PASSAGE, "\n".join([PASSAGE] * 30), "é\r\n€ x"):
        whole, raw = quality.statistics(pa.array([t]))[0], np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(whole, brute_statistics(t)), t[:20]
        for most in (5, 300, 1 << 30):
            assert np.allclose(whole, quality.long_statistics(raw, most)[0]), (t[:20], most)


def test_quality_sums_in_a_tree():
    for parts in (1, 2, 32, 33, 1024, 20_000, 10**6):
        widths = quality.tree_widths(parts)
        assert widths[-1] == 1 and all(-(-a // b) <= quality.FAN_IN for a, b in zip([parts, *widths[:-1]], widths, strict=True))


def test_quality_awkward(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (6, None), (7, 0), (99, 1), (None, 1)], "doc_id bigint, quality int").withColumn("stats", F.lit("clash"))
    out = quality.score(docs, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert quality.score(empty, labels).count() == 0 and quality.accepted(empty, labels).count() == 0
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.predicted)


@needs_data
def test_quality_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    out = quality.score(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"), labels).where("held_out").join(labels, "doc_id")
    right, n = out.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double")), F.count("*")).first()
    assert n > 80 and right > 0.95


def test_isotonic():
    rng = np.random.default_rng(4)
    value, weight = rng.random(30), rng.integers(1, 5, 30).astype(float)
    got = quality.isotonic(value, weight)
    assert (np.diff(got) >= -1e-12).all()
    # The nearest non-decreasing sequence is the min-max of weighted means.
    mean = lambda a, b: (value[a : b + 1] * weight[a : b + 1]).sum() / weight[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert np.allclose(got, want)
    assert (quality.isotonic(value, np.zeros(30)) == 0.5).all()


def test_fourier_features_approximate_the_kernel():
    x = np.random.default_rng(6).standard_normal((40, len(quality.NAMES)))
    z = quality.fourier(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * x.shape[1]))
    assert np.abs(z @ z.T - want).max() < 0.3


# 2: WARC


def test_warc_awkward(spark, tmp_path):
    rows = [(1, "http://a/ b", "x"), (2, None, "x"), (3, "u\r\nEvil: 1", None), (4, "http://d", ""), (5, "é", "long " * 5000), (None, "n", "x"), (5, "é", "long " * 5000), (6, "http://f", "é中\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("_size", F.lit("clash"))
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    kind = {1: ("revisit", 2), 3: ("revisit", 4)}
    assert got == sorted(((i or 0, len((t or "").encode()), sha(t), *kind.get(i, ("response", None))) for i, _, t in rows), key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    import zstandard

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>page {i} of many, with words in common</p>" * 5) for i in range(200)], "page_id bigint, url string, html string")
    warc.write(pages, str(tmp_path / "table"))
    archives = spark.read.parquet(str(tmp_path / "table"))
    n = warc.export(archives, str(tmp_path / "out"))
    seen = 0
    for name in os.listdir(tmp_path / "out"):
        data = (tmp_path / "out" / name).read_bytes()
        assert data[:4] == b"\x5d\x2a\x4d\x18"
        for headers, block in warc.read_archive(data):
            assert block.partition(b"\r\n\r\n")[2].startswith(b"<p>page") and headers["WARC-Type"] == "response"
            seen += 1
        # Each record is a frame of its own: the first can be read alone.
        size = int.from_bytes(data[4:8], "little")
        shared = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        assert zstandard.ZstdDecompressor(dict_data=shared).decompressobj().decompress(data[8 + size :]).startswith(b"WARC/1.1\r\n")
    assert (n, seen) == (len(os.listdir(tmp_path / "out")), 200)


# 5: progressive JPEG


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))


def test_jpeg_awkward(docs, empty):
    out = progressive_jpeg.digests(docs).collect()
    assert len(out) == len(ROWS)
    text = dict(texts())
    for r in out:
        p = payload(text[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text[r.doc_id] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert len({r.feature for r in out if r.doc_id in (2, 3)}) == 1
    assert progressive_jpeg.digests(empty).count() == 0


def test_jpeg_round_trips_alone_and_together():
    rng = np.random.default_rng(0)
    own = [b"\xff" * 576, bytes(range(256)) * 9, bytes([128]) * 576, bytes([127, 128, 129]) * 192 * 4, rng.integers(0, 256, 576 * 7).astype(np.uint8).tobytes(), rng.integers(0, 256, 576 * 2800).astype(np.uint8).tobytes()]
    own += [rng.choice([128, 128, 128, 127, 129, 60], 576 * 5).astype(np.uint8).tobytes() for _ in range(5)]
    files = progressive_jpeg.encode(own)
    found = progressive_jpeg.decode(files)
    for p, f, (back, w, h, picture) in zip(own, files, found, strict=True):
        assert back == p and progressive_jpeg.encode([p]) == [f] and picture.shape == (h, w, 3)
        assert (progressive_jpeg.decode([f])[0][3] == picture).all()


def test_jpeg_pixels_are_the_inverse_transform():
    rng = np.random.default_rng(1)
    zig = rng.integers(-20, 20, (3, 64))
    natural = np.zeros((3, 64))
    natural[:, progressive_jpeg.ZIGZAG] = zig
    k = np.arange(8)
    basis = np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16)
    want = np.stack([basis.T @ b.reshape(8, 8) @ basis for b in natural]) + 128
    assert np.abs(progressive_jpeg.pixels(zig, b"\x01" * 64) - np.clip(want, 0, 255)).max() <= 0.51


def test_jpeg_tensors(spark):
    df = spark.createDataFrame([(1, "x" * 1000)], "doc_id bigint, text string")
    row = progressive_jpeg.load(progressive_jpeg.store(df)).first()
    assert len(row.rgb) == row.width * row.height * 3 and bytes(row.payload) == payload("x" * 1000)
    assert bytes(row.media[:2]) == b"\xff\xd8" and b"\xff\xc2" in bytes(row.media) and bytes(row.media[-2:]) == b"\xff\xd9"


def test_jpeg_bands_give_the_same_files_and_pictures():
    rng = np.random.default_rng(2)
    for n in (576, 576 * 2800, 576 * 8001):
        raw = rng.choice(np.frombuffer(b"the quick brown fox \xc3\xa9\x80\x7f\xff", np.uint8), n)
        whole = progressive_jpeg.encode([raw.tobytes()])[0]
        assert progressive_jpeg.encode_long(raw) == whole
        one, other = progressive_jpeg.decode_long(whole), progressive_jpeg.decode([whole], False)[0]
        assert one[0] == other[0] == raw.tobytes() and one[1:3] == other[1:3] and (one[3] == other[3]).all()


def test_jpeg_digests_are_of_stored_media_and_tensors(spark, monkeypatch):
    """What the digests say is what stands in the tables, which are binary columns, and which go when the digests are written."""
    from pyspark.sql.types import BinaryType

    df = spark.createDataFrame([(1, "x" * 1000), (2, None)], "doc_id bigint, text string")
    seen, gone = {}, []
    monkeypatch.setattr(progressive_jpeg, "cut", lambda df, name: seen.setdefault(name, common.cut(df, name)))
    monkeypatch.setattr(progressive_jpeg, "drop", gone.append)
    got = {r.doc_id: r for r in progressive_jpeg.digests(df).collect()}
    assert set(seen) == {"media", "tensors", "digests"} and gone == [seen["media"], seen["tensors"]]
    assert all(isinstance(seen[t].schema[c].dataType, BinaryType) for t, c in (("media", "media"), ("tensors", "rgb")))
    for r in seen["media"].collect():
        assert got[r.doc_id].media_sha256 == hashlib.sha256(r.media).hexdigest()
    for r in seen["tensors"].collect():
        assert got[r.doc_id].feature == progressive_jpeg.feature(np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3))


def test_jpeg_waves_are_all_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i} " * i) for i in range(40)], "doc_id bigint, text string").repartition(9)
    df.write.parquet(at := str(tmp_path / "documents.parquet"))
    parts = progressive_jpeg.waves(spark, at)
    assert len(parts) == progressive_jpeg.WAVES and len(progressive_jpeg.waves(spark, at, 4)) == 4
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    assert rows(progressive_jpeg.digests(parts)) == rows(progressive_jpeg.digests(df))


# 9: HTML


def test_html_awkward(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<html><body><nav><a href=x>menu</a></nav><article><h1>A &amp; B</h1><p>one \n two<p>three<br>four<ul><li>x<li>y</ul><script>var a='</p>'</script><!-- no --></article><footer>end</footer>"), (4, "u", "<<<>&&"), (5, "u", "<p" * 500), (5, "u", "<p" * 500), (6, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert got[1].text == got[2].text == "" and got[2].url is None
    assert got[3].text == "A & B\none two\nthree four\nx\ny" and got[3].n_chars == len(got[3].text)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_marginals_are_exact():
    """Sum-product against the sum over all states of a small tree."""
    import itertools
    import math

    model = html_extract.default_model()
    nodes, _ = html_extract.parse("<body><div><p>some text here</p><a>x</a></div><nav><a>y</a></nav></body>")
    unary = [sum(model.unary.get(f, 0) for f in seen) for seen in html_extract.features(nodes)]
    total = np.zeros((len(nodes), 2))
    for states in itertools.product((0, 1), repeat=len(nodes)):
        w = math.exp(sum(u for u, s in zip(unary, states, strict=True) if s))
        for i, n in enumerate(nodes):
            if i:
                w *= model.pair[html_extract.kind(n.tag)][2 * states[n.parent] + states[i]]
        for i, s in enumerate(states):
            total[i, s] += w
    assert np.allclose(model.marginals(nodes), np.log(total[:, 1] / total[:, 0]))


HAND = [
    # (page, lines of its main text), written by hand in shapes that the labelled pages do not have.
    ("""<html><body bgcolor=white><table width=100%><tr><td class=navcol><a href=/>Home</a><br><a href=/news>News</a><br><a href=/about>About us</a></td>
    <td><h1>Council approves new bridge</h1><p>The city council voted on Monday to build a bridge over the river, after years of debate.<p>Work should begin in spring and take three years, the mayor said.</td></tr></table>
    <div id=foot>Copyright 2009 The Daily. <a href=/terms>Terms</a></div></body></html>""",
     ["Council approves new bridge", "The city council voted on Monday to build a bridge over the river, after years of debate.", "Work should begin in spring and take three years, the mayor said."]),
    ("""<body><div id="topbar"><form><input name=s></form></div><div id="blog"><div class="post hentry"><h2 class="post-title">Making bread at home</h2><div class="post-body">I have baked my own bread for ten years now, and it is easier than it looks.<br><br>
    You need flour, water, salt and some patience.</div></div></div><div id="comments" class="comments"><h4>2 comments:</h4><div class="comment-body"><p>Great recipe, thanks for sharing it with us!</p></div></div></body>""",
     ["Making bread at home", "I have baked my own bread for ten years now, and it is easier than it looks. You need flour, water, salt and some patience."]),
    ("""<!DOCTYPE html><title>Docs</title><div class="docs-wrapper"><aside class="docs-sidebar"><ul><li><a href="#a">Install</a><li><a href="#b">Usage</a></ul></aside><main class="docs-main"><h1>Install</h1><p>Run the command below in a terminal to install the package on your machine.</p><pre><code>get package</code></pre><h2>Usage</h2><p>Call the function with the name of a file, and it returns the number of lines.</p></main></div><footer class="page-footer"><p>Built with care. <a href="/licence">Licence</a></p></footer>""",
     ["Install", "Run the command below in a terminal to install the package on your machine.", "get package", "Usage", "Call the function with the name of a file, and it returns the number of lines."]),
    ("""<html><body><header role=banner><nav><a href=/a>World</a> <a href=/b>Sport</a></nav></header><article itemscope><header><h1>Storm hits the coast</h1></header><section><p>A heavy storm reached the coast in the night and left thousands without power.</p>
    <figure><img src=x.jpg><figcaption>Waves at the harbour on Sunday.</figcaption></figure><aside class="related-links"><h3>More on this</h3><ul><li><a href=/c>Last year's storm</a></ul></aside><p>Repairs will take a week, the company said in a statement.</p></section></article><div class="cookie-notice"><p>We use cookies to improve our site. <button>Accept</button></p></div></body></html>""",
     ["Storm hits the coast", "A heavy storm reached the coast in the night and left thousands without power.", "Waves at the harbour on Sunday.", "Repairs will take a week, the company said in a statement."]),
    ("""<body><div class=wrap><div class=menu><a href=1>One</a><a href=2>Two</a></div><div class=text><p>There was once a miller who had three sons, and when he died they shared what he left.</p><p>The eldest took the mill, the second the donkey, and the youngest the cat.</p><blockquote>What shall I do with a cat?</blockquote></div><div class=ad-box>Buy new boots today, half the price!</div></div>""",
     ["There was once a miller who had three sons, and when he died they shared what he left.", "The eldest took the mill, the second the donkey, and the youngest the cat.", "What shall I do with a cat?"]),
]


def test_html_on_pages_of_other_shapes():
    """Of the lines of hand-written pages, by page: which were found, and how many others came with them."""
    model = html_extract.default_model()
    wrong = total = 0
    for page, want in HAND:
        got = model.extract(page).split("\n")
        wrong += len(set(want) ^ set(got))
        total += len(html_extract.parse(page)[1])
    assert wrong <= 0.1 * total


@pytest.mark.parametrize("page", ["<" + "a" * 10**6, '<a "' * 250_000, '<a "' * 250_000 + ">", "<a '>' " * 100_000 + '"', "<div>" * 50_000 + "</x>" * 50_000, "<b>" * 50_000 + "<p>x" * 50_000, "</script " * 100_000 + "<script></script ", "<" * 10**6 + ">", "<div class='" + "w x " * 100_000 + "'>" + "<p>q" * 50_000])
def test_html_time_grows_with_the_page(page):
    import time

    model, began = html_extract.default_model(), time.process_time()
    model.extract(page)
    assert time.process_time() - began < 10


def test_html_odd_markup():
    text = lambda page: [t for _, t in html_extract.parse(page)[1]]
    assert text("a <b>c</b> d <br>e") == ["a c d e"] and text('<p title="a>b">x</p>y') == ["x", "y"] and text("1 < 2 > 1") == ["1 < 2 > 1"]
    assert text("<!-- <p>x</p> -->y<!-- z") == ["y"] and text("<p title='unclosed>x</p>y") == ["x", "y"] and text("<script>if (a<b) '</p>'</script>z") == ["z"]
    assert text("x <p") == ["x <p"] and text("a</nothing>b") == ["ab"] and text("<li>a<li>b") == ["a", "b"] and text("<td><p>a<td>b") == ["a", "b"]


def test_html_on_pages_it_has_not_seen():
    from graphloom.llm.html_labelled import labelled_pages

    model, right, n = html_extract.default_model(), 0, 0
    for page in labelled_pages(150, seed=77):
        nodes, blocks = html_extract.parse(page)
        label = []
        for x in nodes:
            mark = html_extract.MARKED.search(x.attributes)
            label.append(int(mark[1]) if mark else label[x.parent] if x.parent >= 0 else 0)
            x.attributes = html_extract.MARKED.sub("", x.attributes)
        belief = model.marginals(nodes)
        right += sum((belief[i] >= 0) == bool(label[i]) for i, _ in blocks)
        n += len(blocks)
    assert right / n > 0.98


@needs_data
def test_html_table(spark):
    import html
    import re

    for r in html_extract.extract(spark.read.parquet(f"{DATA}/sf0.001/pages.parquet")).join(spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"<(?:p|h1|/p|/h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b)


# Shared parts and registered queries


def test_slices_and_words():
    import pyarrow as pa

    texts_ = ["ab  c", None, "", " d\n", "é" * 10, "e"]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts_, pa.string())})
    assert sum(p.num_rows for p in common.slices(batch, "text", 4)) == 6
    for array in (batch.column("text"), batch.slice(2).column("text")):
        raw, offsets = common.utf8_bytes(array)
        starts, ends, owner = common.word_bounds(raw, offsets)
        got = [(int(o), bytes(raw[a:b]).decode()) for a, b, o in zip(starts, ends, owner, strict=True)]
        assert got == [(i, w) for i, t in enumerate(array.to_pylist()) for w in (t or "").split()]


def test_word_hashes_of_long_words():
    raw = np.frombuffer(b"a" * 9000 + b"b" + b"a" * 9000 + b"c" + b"a" * 8999, np.uint8)
    h = common.word_hashes(raw, np.array([0, 9001, 18002]), np.array([9000, 18001, 27001]))
    assert h[0] == h[1] != h[2]


@needs_data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/sf0.001/{t}.parquet')")
    got = queries.queries()[name](spark, f"{DATA}/sf0.001")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
