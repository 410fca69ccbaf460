"""The source divergence audit, embedding whitening and difference-cover dedup against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import cover_dedup, divergence, eigen, html_extract, queries, whitening

from .pages import PAGES
from .test_operators import DATA, PASSAGE, ROWS, SCHEMA, docs, empty, needs_data, needs_tokenizers  # noqa: F401

# Difference-cover anchors.


def removed_words(rows, window=50):
    """(doc_id, text) -> n_words, n_removed, hash, by comparing all windows."""
    first: dict[tuple, object] = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1) if d is not None else ():
            key = tuple(w[i : i + window])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(d), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got_words(df, **how):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in cover_dedup.digests(df, **how).collect())


def test_difference_covers_have_every_distance():
    for period in range(1, 24):
        cover = cover_dedup.difference_cover(period)
        assert cover[0] == 0 and {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert len(cover_dedup.difference_cover(21)) == 5


def test_any_two_equal_windows_share_an_aligned_anchor():
    n = np.array([300, 49, 50, 0, 120])
    text, place = cover_dedup.anchors(n, 50, 21)
    by = {t: set(place[text == t].tolist()) for t in range(5)}
    assert not by[1] and not by[3] and 20 in by[2]
    for i in range(0, 251):
        for j in range(0, 71):
            assert any(i + k in by[0] and j + k in by[4] for k in range(21))


def test_cover_dedup_awkward(docs, empty):  # noqa: F811
    assert got_words(docs) == removed_words([(i, t) for i, t, _, _ in ROWS])
    assert cover_dedup.digests(empty).count() == 0
    out = cover_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[6].split()[1:3] == PASSAGE.split()[:2] and kept[7] == "other another end" and kept[8] == "" and kept[2] is None


@pytest.mark.parametrize(("window", "period"), [(50, 21), (10, 5), (8, 7), (6, 1)])
def test_cover_dedup_of_chained_and_broken_copies(spark, window, period):
    """Copies with edits, passages in many surroundings, repeats inside a document, copies of parts of several documents."""
    rng = random.Random(window * period)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 6 * window))] for _ in range(6)]
    shared = [rng.choice(words) for _ in range(window + 3)]
    rows = []
    for d in range(60):
        w = list(base[rng.randrange(6)])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"e{d}"
        if d % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = shared
        if d % 7 == 0:
            w = w + base[rng.randrange(6)][rng.randrange(5) :]
        rows.append((rng.choice([d, d, d, None, 1000 - d]), rng.choice([" ", "\t ", "\n"]).join(w)))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got_words(df, window=window, period=period) == removed_words(rows, window)


def test_cover_dedup_ids_of_other_types(spark):
    rows = [("b", PASSAGE), ("a", "x " + PASSAGE), ("c", PASSAGE + " y"), ("c", PASSAGE), (None, PASSAGE)]
    assert got_words(spark.createDataFrame(rows, "doc_id string, text string")) == removed_words(rows)


def test_cover_dedup_of_long_texts(spark, monkeypatch):
    rng = random.Random(3)
    long_ = " ".join(f"t{rng.randrange(900)}" for _ in range(5000))
    rows = [(1, long_), (2, "one two " + long_[2000:20_000]), (3, long_ + " more"), (4, "z" * 9000)]
    raw = np.frombuffer(long_.encode(), np.uint8)
    text, place = cover_dedup.anchors(np.array([5000]), 50, 21)
    for most in (64, 1000, 1 << 20):
        parts = list(cover_dedup.long_anchors(raw, 50, 21, most))
        assert np.concatenate([p for _, p, _ in parts]).tolist() == place.tolist()
        assert len(set(np.concatenate([h for h, _, _ in parts]).tolist())) == len(place)
    assert got_words(spark.createDataFrame(rows, "doc_id bigint, text string")) == removed_words(rows)
    kept = [list(cover_dedup.kept_words(long_.encode(), np.array([7, 300]), np.array([60, 1]), 50, most)) for most in (50, 1 << 20)]
    assert [w for _, own in kept[0] for w in own] == [w for _, own in kept[1] for w in own]


def test_cover_dedup_rows_of_a_group_of_copies(spark):
    """Exact and near copies are settled by chains: windows are compared around edits only, not for each copy."""
    rng = random.Random(1)
    base = [f"u{i}" for i in range(400)]
    rows = []
    for d in range(120):
        w = list(base)
        if d % 2:
            w[rng.randrange(400)] = f"e{d}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = cover_dedup.met(cover_dedup.all_anchors(df))
    chains = cover_dedup.chained(found, 50, 21)
    settled = cover_dedup.settled_windows(chains, 21)
    wanted = chains.where("open").select("doc", "text_id", "pos")
    assert settled.agg(F.sum("n")).first()[0] > 0.7 * 119 * 351
    assert cover_dedup.open_windows(df, wanted, settled, 50, 21).count() < 0.3 * 120 * 351
    assert got_words(df) == removed_words(rows)


# Whitening.


def brute_whitening(vectors, most=8):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=object)
    n, total = len(x), x.sum(axis=0)
    own = n * x - total
    cov = np.array([[float(Fraction(int((own[:, i] * own[:, j]).sum()), n**3)) for j in range(x.shape[1])] for i in range(x.shape[1])])
    values, vecs = np.linalg.eigh(cov)
    order = np.argsort(-values)[:most]
    centred = np.array([[float(Fraction(int(c), n)) for c in row] for row in own])
    return n, [int((r * r).sum()) for r in own], centred @ vecs[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(300, 12)) @ np.diag(np.linspace(3, 0.2, 12))).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    bad = [(900, None, 1), (901, [], 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] + [0.0] * 11, 1), (904, [None] + [0.0] * 11, 1), (905, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, component int").repartition(5)
    got = whitening.whitened(df).collect()
    n, deviation, want, explained = brute_whitening(vectors)
    assert len(got) == 300 * 8 and {r.n for r in got} == {300} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    own = np.zeros((300, 8))
    for r in got:
        own[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id] and abs(r.explained / explained[r.component - 1] - 1) < 1e-12
    sign = np.sign((own * want).sum(axis=0))
    assert np.abs(own * sign - want).max() < 1e-10


def test_whitening_of_nothing_and_of_one_direction(spark):
    schema = "vec_id string, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([("a", None), ("b", [])], schema)).count() == 0
    same = whitening.whitened(spark.createDataFrame([("a", [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error == 0 for r in same)
    line = whitening.whitened(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 4.0]), ("c", [3.0, 6.0])], schema)).collect()
    assert [r.whitened is None for r in sorted(line, key=lambda r: (r.vec_id, r.component))] == [False, True] * 3 and line[0].identity_error < 1e-9
    whitening.whitened(spark.createDataFrame([("a", [1e300, 2.0]), ("b", [2.0, 4.0])], schema)).collect()


def test_covariance_is_exact_to_more_than_double():
    """Large means and small spreads: high and low parts together are near the exact sums."""
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(2500, 5)) * [1, 10, 1e3, 1e6, 0]) + [1e5, 1e9, 1e12, 1e3, 7]
    total = [int(s) for s in x.astype(np.int64).sum(axis=0)]
    mean = whitening.Mean.of(len(x), total)
    high = low = np.zeros((5, 5))
    for at in range(0, len(x), whitening.ROWS):
        for m in whitening.products(*mean.centred(x[at : at + whitening.ROWS])):
            high, low = whitening.added(high, low, m)
    own = len(x) * x.astype(np.int64).astype(object) - np.array(total, object)
    for i in range(5):
        for j in range(5):
            exact = Fraction(int((own[:, i] * own[:, j]).sum()), len(x) ** 2)
            error = abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact)
            scale = Fraction(max(abs(float(own[:, i].max())), 1) * max(abs(float(own[:, j].max())), 1) / len(x) ** 2) * len(x)
            assert error <= scale * Fraction(1, 2**60)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 130])
def test_eigenpairs(n):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    plain = rng.normal(size=(n, n))
    wilkinson = np.diag(np.abs(np.arange(n) - n // 2).astype(float)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    for a in (plain + plain.T, q @ np.diag(np.repeat([1.0, 2.0, 3.0], n)[:n]) @ q.T, q @ np.diag(10.0 ** -np.arange(n)) @ q.T, np.zeros((n, n)), np.ones((n, n)), wilkinson):
        a = (a + a.T) / 2
        values, vectors = eigen.eigenpairs(a)
        scale = max(np.abs(a).max(), 1e-300)
        assert np.all(np.diff(values) <= 1e-12 * scale) and np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * n * scale
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-11 and np.abs(a @ vectors - vectors * values).max() <= 1e-13 * n * scale


# Source divergence.


def brute_audit(rows, least=3, most=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = term.findall((text or "").translate(low))
        groups.add((lang, source))
        count[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        own = sorted(s for g, s in groups if g == lang)

        def weights(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: weights(count[lang, s]) for s in own}
        q = weights(sum((count[lang, s] for s in own), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[: most if part == "term" else None]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def got_audit(df, **how):
    return sorted((r.lang, r.source, r.part, r.item, r["value"], r["rank"]) for r in divergence.audit(df, **how).collect())


@pytest.mark.parametrize(("block_terms", "per_stripe"), [(2048, 128), (7, 3)])
def test_divergence_against_brute_force(spark, block_terms, per_stripe):
    rng = random.Random(block_terms)
    words = ["Alpha", "beta", "É", "ü1x", "ǅ", "gamma-delta", "zeta_eta", "中文", "x"] + [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", "ü", None, ""])) for _ in range(90)]
    rows += [(None, "en", "only null"), ("", "fr", "empty"), ("once", "fr", "alone"), (" ", "it", "x"), (rows[0][0], *rows[0][1:])]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    assert got_audit(df, block_terms=block_terms, per_stripe=per_stripe, most=9) == brute_audit(rows, most=9)


def test_divergence_awkward(docs, empty):  # noqa: F811
    assert got_audit(docs) == brute_audit([(t, lang, s) for _, t, lang, s in ROWS])
    assert divergence.audit(empty).count() == 0


def test_divergence_of_long_texts(spark):
    """A text is read in parts, and its terms handed on in lots; it still is one document of each term."""
    text = " ".join(f"T{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)) + " é1 É"
    raw = np.frombuffer(text.encode(), np.uint8)
    for held in (100, 1 << 30):
        n, docs_ = Counter(), Counter()
        for batch in divergence.long_counts("en", "a", raw, 500, held):
            for r in batch.to_pylist():
                n[r["term"]] += r["n"]
                docs_[r["term"], r["doc"]] += r["docs"]
        assert n == Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)})))
        assert len({d for _, d in docs_}) == 1
    rows = [(text, "en", "a"), (text[:900], "en", "b"), (text[100:1500], "en", "c"), (text[:2000], "en", None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    low = divergence.counted(df, 50)
    assert {(r.lang, r.term): (r.n, r.docs) for r in divergence.totals(low).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()} == {(r.lang, r.term): (r.n, r.docs) for r in divergence.totals(divergence.counted(df)).groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()}


def test_divergence_weights_of_large_counts():
    """Long division stays exact where 10**9 times a count does not fit 64 bits."""
    counts, total = np.array([0, 5, 10**12, 8 * 10**15]), 9 * 10**15
    assert divergence.weight(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


@needs_data
@needs_tokenizers
@pytest.mark.parametrize("name", ["op11_divergence", "op13_cover_dedup"])
def test_query_oracles_of_the_round(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/sf0.001/documents.parquet')")
    found = queries.queries()[name](spark, f"{DATA}/sf0.001")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(want.fetchall())


@needs_data
def test_whitening_query_against_brute_force(spark):
    df = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    n, deviation, want, explained = brute_whitening([v for _, v in rows])
    got = {(r.vec_id, r.component): r for r in queries.op12_whitening(spark, f"{DATA}/sf0.001").collect()}
    own = np.array([[got[i, k].whitened for k in range(1, 9)] for i, _ in rows])
    assert len(got) == 8 * len(rows) and [got[i, 1].deviation for i, _ in rows] == deviation
    assert np.abs(own * np.sign((own * want).sum(axis=0)) - want).max() < 1e-9 and {r.identity_error < 1e-9 for r in got.values()} == {True}


def test_arrow_lists_of_nothing():
    column = pa.array([[1, 2], None, [3]], pa.list_(pa.int32()))
    assert [x[0].tolist() for x in cover_dedup.lists(column)] == [[1, 2], [], [3]] and SCHEMA


# HTML extraction without names.


def block_score(model):
    found = extra = lost = 0
    for page, want in PAGES.values():
        got = set(model.extract(page).split("\n")) - {""}
        assert got, page
        found, extra, lost = found + len(got & set(want)), extra + len(got - set(want)), lost + len(set(want) - got)
    return 2 * found / (2 * found + extra + lost)


def test_html_shapes_that_are_not_labelled():
    assert block_score(html_extract.default_model()) >= 0.95


def test_html_prose_is_never_lost():
    """A model that believes in nothing still gives a page's sentences, and not its menus."""
    model = html_extract.Model({"size 1": -30.0}, {k: (0.999, 0.001, 0.999, 0.001) for k in ("inline", "section", "block")})
    page = "<nav><p>Go here or go there. Now.</p></nav><div><p>One two three four five six.</p><p>Seven words are in this line here.</p><p><a href=/x>Some link that has many words in it.</a></p></div><form>Send us what you think of it all.</form>"
    assert model.extract(page) == "One two three four five six.\nSeven words are in this line here."
    assert model.extract("<nav>a b</nav><p>short</p>") == ""


def test_html_query_against_brute_force(spark):
    """The query's texts against the sum over all states of small pages."""
    import itertools

    model = html_extract.default_model()
    small = ["<body><nav><a href=/>Home</a></nav><article><h1>A title</h1><p>Some words of text. And more.</p></article><footer>end</footer></body>", "<div><a href=1>x</a></div><div><p>One line of text is here. It goes on.</p></div>", "<p>a<p>b. c d e f g.<ul><li>x<li>y</ul>", "text only. Nothing else is here.", "<table><tr><td><a href=/>x</a><td>Long enough text, or so it seems. Yes.</table>", ""]
    want = []
    for page in small:
        nodes, blocks = html_extract.parse(page)
        assert len(nodes) <= 12
        unary = [sum(model.unary.get(f, 0.0) for f in seen) for seen in html_extract.features(nodes)]
        total = np.zeros((len(nodes), 2))
        for states in itertools.product((0, 1), repeat=len(nodes)):
            w = math.exp(sum(max(-40, min(40, u)) for u, s in zip(unary, states, strict=True) if s) / 1)
            for i, n in enumerate(nodes):
                if i:
                    w *= model.pair[html_extract.kind(n.tag)][2 * states[n.parent] + states[i]]
            for i, s in enumerate(states):
                total[i, s] += w
        kept = [t for i, t in blocks if total[i, 1] >= total[i, 0]]
        if not kept:
            prose = [(total[i, 1] / total[i, 0], t) for i, t in blocks if html_extract.is_prose(i, t, nodes)]
            best = max((odds for odds, _ in prose), default=1.0)
            kept = [t for odds, t in prose if math.log(odds / best) >= -html_extract.NEAR]
        want.append("\n".join(kept))
    pages = spark.createDataFrame([(i, "u", p) for i, p in enumerate(small)], "page_id bigint, url string, html string")
    assert [r.text for r in html_extract.extract(pages).orderBy("page_id").collect()] == want and any(want)
