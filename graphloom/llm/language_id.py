"""Language identification by unigrams over a fixed public vocabulary, marginalised over segmentations.

A word (lower-cased, marked at its start) is a sequence of vocabulary pieces in as many ways as it can be cut.
Each language has its own piece probabilities, and the probability of a word is the sum over all its cuts of the
product of the pieces, which a forward pass computes. Words are independent, so a text's log probability is the
sum over its words, and only the distinct words of a slice go through the pass. Learning takes expected piece
counts by forward and backward passes over all labelled training texts (first with equal piece weights, then,
with more rounds, with the language's own), summed by partition. A letter outside the vocabulary is a piece of
its own with a small probability, so every word has a cut.

A word of more than LONG_WORD letters goes block by block. A block turns the sums at the last places before it, as many
as the longest piece has letters, into those at its own last places; that is a matrix for each language, taken for many
blocks at once, and the matrices are applied one after another. A text of more than a few MB is read in parts that are
cut at white space. So neither takes more memory than itself and, for a long word that is learned from, 128 bytes a
block and model.

Texts that are null or have no letter are `und` with score 0. Ties between languages go to the smaller name.
With nothing to learn from, every text is `und`. Rows are independent, repeated rows get equal results, and other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import is_long, slices, utf8_bytes, word_parts

MARK = "▁"
#: Probability of a letter that is no piece, before it is shared out.
UNKNOWN = 1e-10
#: Pseudo-count of every piece in every language.
SMOOTHING = 0.05
MOST_WORDS = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces by length in code points, as sorted hashes, so that whole arrays of substrings are looked up at once."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.pieces = sorted(p.lower() if p.lower() in names else p for p in names)
        self.pieces = sorted(set(self.pieces))
        self.size = len(self.pieces)
        by: dict[int, list[tuple[int, int]]] = {}
        for i, p in enumerate(self.pieces):
            by.setdefault(len(p), []).append((int(hashes(np.array([[ord(c) for c in p]], np.uint64))[0]), i))
        self.longest = max(by)
        self.by = {n: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([i for _, i in sorted(x)], np.int32)) for n, x in by.items()}

    def find(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each piece length, the piece that starts at each place of each row of `codes`; `size` is none, and for one letter `size + 1`."""
        out, h = [], np.zeros(codes.shape, np.uint64)
        n = codes.shape[1]
        for length in range(1, min(self.longest, n) + 1):
            with np.errstate(over="ignore"):
                h = h[:, : n - length + 1] * _BASE + codes[:, length - 1 :] + np.uint64(1)
            known, ids = self.by.get(length, (np.zeros(0, np.uint64), np.zeros(0, np.int32)))
            none = self.size + (length == 1)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                out.append(np.where(known[at] == h, ids[at], none))
            else:
                out.append(np.full(h.shape, none, np.int32))
        return out


def hashes(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(codes.shape[0], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[1]):
            h = h * _BASE + codes[:, k] + np.uint64(1)
    return h


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: Words of more letters are summed by blocks of STEP letters; places times models that are held at once.
LONG_WORD, STEP, CELLS = 1024, 24, 640_000


def padded(length: int) -> int:
    """Words are handled together with those of the same padded length."""
    return length if length <= 24 else -(-length // 8) * 8 if length <= 64 else 1 << (length - 1).bit_length()


def grouped(words: list[str], models: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, code points (zero after the end) and lengths, in groups of about equal length and bounded size."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    width = np.array([padded(int(n)) for n in range(65)])[np.minimum(lengths, 64)]
    for i in np.flatnonzero(lengths > 64):
        width[i] = padded(int(lengths[i]))
    for n in np.unique(width):
        rows = np.flatnonzero(width == n)
        step = max(1, CELLS // (int(n) * models))
        for i in range(0, len(rows), step):
            own = rows[i : i + step]
            at = np.arange(n)[None, :] + starts[own, None]
            inside = np.arange(n)[None, :] < lengths[own, None]
            yield own, np.where(inside, codes[np.minimum(at, len(codes) - 1)], 0).astype(np.uint64), lengths[own]


#: Words up to this padded length are summed in plain numbers, each letter lifted by exp(LIFT) so that none vanish; longer ones in logarithms.
PLAIN, LIFT = 32, 4.0


def piece_terms(ids: list[np.ndarray], weights: np.ndarray, plain: bool) -> list[np.ndarray]:
    """The weight of each piece at each place (rows x places x models), lifted or as logarithms."""
    if plain:
        return [weights[i] * np.exp(LIFT * (k + 1)) for k, i in enumerate(ids)]
    with np.errstate(divide="ignore"):
        logs = np.log(weights)
    return [logs[i] for i in ids]


def forward(terms: list[np.ndarray], n: int, plain: bool) -> np.ndarray:
    """alpha[t], the sum over all cuts of the first t letters: t x rows x models."""
    rows, _, k = terms[0].shape
    alpha = np.full((n + 1, rows, k), 0.0 if plain else -np.inf)
    alpha[0] = 1.0 if plain else 0.0
    for t in range(1, n + 1):
        for length in range(1, min(len(terms), t) + 1):
            if plain:
                alpha[t] += alpha[t - length] * terms[length - 1][:, t - length]
            else:
                alpha[t] = np.logaddexp(alpha[t], alpha[t - length] + terms[length - 1][:, t - length])
    return alpha


def backward(terms: list[np.ndarray], n: int, plain: bool, lengths: np.ndarray) -> np.ndarray:
    """beta[t], the sum over all cuts of what follows the first t letters."""
    rows, _, k = terms[0].shape
    beta = np.full((n + 1, rows, k), 0.0 if plain else -np.inf)
    beta[lengths, np.arange(rows)] = 1.0 if plain else 0.0
    for t in range(n - 1, -1, -1):
        for length in range(1, min(len(terms), n - t) + 1):
            if plain:
                beta[t] += beta[t + length] * terms[length - 1][:, t]
            else:
                beta[t] = np.logaddexp(beta[t], beta[t + length] + terms[length - 1][:, t])
    return beta


def windows(codes: np.ndarray, begin: int, blocks: int, step: int, context: int) -> np.ndarray:
    """The letters of neighbouring blocks, one row each, with `context` letters before; zero before the word."""
    at = begin - context + step * np.arange(blocks)[:, None] + np.arange(context + step)
    return np.where(at >= 0, codes[np.maximum(at, 0)], 0).astype(np.uint64)


def block_groups(length: int, models: int, longest: int) -> list[tuple[int, int, int]]:
    """First letter, number and size of the blocks that are taken together; the last letters are a block of their own."""
    most = max(1, CELLS // (STEP * longest * models))
    whole = length // STEP
    out = [(i * STEP, min(most, whole - i), STEP) for i in range(0, whole, most)]
    return out + [(whole * STEP, 1, length % STEP)] if length % STEP else out


def transfers(terms: list[np.ndarray], context: int, step: int) -> np.ndarray:
    """Blocks x to x from x models: how the sum `to` places before a block's end comes from those `from` places before its begin."""
    rows, _, k = terms[0].shape
    alpha = np.zeros((context + step + 1, rows, context + 1, k))
    for j in range(context + 1):
        alpha[context - j, :, j] = 1
    for t in range(context + 1, context + step + 1):
        for length in range(1, min(len(terms), t) + 1):
            alpha[t] += alpha[t - length] * terms[length - 1][:, t - length, None]
    return alpha[::-1][: context + 1].swapaxes(0, 1)


def boundary_sums(vocab: Vocabulary, weights: np.ndarray, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """The log probability of a long word by model, and with `keep` the scaled sums before each block (places back x models)."""
    context, k = vocab.longest - 1, weights.shape[1]
    v, log, kept = np.zeros((context + 1, k)), np.zeros(k), []
    v[0] = 1
    for begin, blocks, step in block_groups(len(codes), k, vocab.longest):
        terms = piece_terms(vocab.find(windows(codes, begin, blocks, step, context)), weights, True)
        for m in transfers(terms, context, step):
            if keep:
                kept.append(v)
            v = np.einsum("ijk,jk->ik", m, v)
            top = v.max(axis=0)
            v, log = v / top, log + np.log(top)
    return log + np.log(v[0]) - LIFT * len(codes), kept


def long_expected(vocab: Vocabulary, weights: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces of a long word (models x pieces): sums before and after each block, the latter from the end backward, meet inside it."""
    context, k = vocab.longest - 1, weights.shape[1]
    _, before = boundary_sums(vocab, weights, codes, True)
    out = np.zeros((k, vocab.size + 2))
    u = np.zeros((context + 1, k))
    u[0] = 1
    done = len(before)
    for begin, blocks, step in reversed(block_groups(len(codes), k, vocab.longest)):
        ids = vocab.find(windows(codes, begin, blocks, step, context))
        terms = piece_terms(ids, weights, True)
        after = np.zeros((blocks, context + 1, k))
        for i, m in reversed(list(enumerate(transfers(terms, context, step)))):
            after[i] = u
            u = np.einsum("ijk,ik->jk", m, u)
            u = u / u.max(axis=0)
        size = context + step
        alpha, beta = np.zeros((size + 1, blocks, k)), np.zeros((size + 1, blocks, k))
        alpha[: context + 1] = np.stack(before[done - blocks : done])[:, ::-1].swapaxes(0, 1)
        done -= blocks
        for t in range(context + 1, size + 1):
            for length in range(1, min(len(terms), t) + 1):
                alpha[t] += alpha[t - length] * terms[length - 1][:, t - length]
        for t in range(size, context, -1):
            if size - t <= context:
                beta[t] = after[:, size - t]
            for length in range(1, min(len(terms), size - t) + 1):
                beta[t] += beta[t + length] * terms[length - 1][:, t]
        whole = np.einsum("bik,ibk->bk", after, alpha[::-1][: context + 1])
        for length, (i, term) in enumerate(zip(ids, terms, strict=True), 1):
            first = max(context + 1 - length, 0)
            stop = size + 1 - length
            gamma = alpha[first:stop].swapaxes(0, 1) * term[:, first:stop] * beta[first + length :].swapaxes(0, 1) / whole[:, None]
            for m in range(k):
                out[m] += np.bincount(i[:, first:stop].ravel(), gamma[:, :, m].ravel(), vocab.size + 2)
    return out


def code_points(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)


class Scorer:
    """Log probabilities of words in each language; known words are kept."""

    def __init__(self, vocab: Vocabulary, weights: np.ndarray):
        self.vocab, self.weights = vocab, weights
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, weights.shape[1]))

    def fresh(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.weights.shape[1]))
        short = np.array([i for i, w in enumerate(words) if len(w) < LONG_WORD], np.int64)
        for i in np.setdiff1d(np.arange(len(words)), short):
            out[i] = boundary_sums(self.vocab, self.weights, code_points(MARK + words[i]))[0]
        for rows, codes, lengths in grouped([MARK + words[i] for i in short], self.weights.shape[1]):
            rows = short[rows]
            n = codes.shape[1]
            plain = n <= PLAIN
            alpha = forward(piece_terms(self.vocab.find(codes), self.weights, plain), n, plain)[lengths, np.arange(len(rows))]
            out[rows] = np.log(alpha) - LIFT * lengths[:, None] if plain else alpha
        return out

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.place) > MOST_WORDS:
            self.place.clear()
        new = [w for w in words if w not in self.place]
        if any(len(w) >= LONG_WORD for w in new):  # not kept
            out = np.zeros((len(words), self.weights.shape[1]))
            long_ = np.array([len(w) >= LONG_WORD for w in words])
            out[long_] = self.fresh([w for w in words if len(w) >= LONG_WORD])
            out[~long_] = self([w for w in words if len(w) < LONG_WORD]) if not long_.all() else 0
            return out
        if new:
            first = len(self.place)
            self.place.update(zip(new, range(first, first + len(new)), strict=True))
            while len(self.table) < len(self.place):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[first : first + len(new)] = self.fresh(new)
        return self.table[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]


def text_parts(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """A slice of texts as it is, or the parts of a long one."""
    if not is_long(texts, most):
        yield texts
        return
    raw, _ = utf8_bytes(texts)
    for a, b in word_parts(raw, most):
        yield pa.array([raw[a:b].tobytes()], pa.binary()).cast(pa.string())


def word_list(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Text number and word number of every word, and the distinct words."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    words = pc.dictionary_encode(split.flatten())
    owner = np.asarray(pc.list_parent_indices(split))
    index = np.asarray(words.indices)
    distinct = words.dictionary.to_pylist()
    if "" in distinct:
        keep = index != distinct.index("")
        owner, index = owner[keep], index[keep]
        distinct[distinct.index("")] = "\x00"
    return owner, index, distinct


def expected(vocab: Vocabulary, weights: np.ndarray, words: list[str], times: np.ndarray) -> np.ndarray:
    """Expected piece counts (models x pieces); `times` is words x models. One column of weights serves all models."""
    out = np.zeros((times.shape[1], vocab.size + 2))
    short = np.array([i for i, w in enumerate(words) if len(w) < LONG_WORD], np.int64)
    for i in np.setdiff1d(np.arange(len(words)), short):
        found = long_expected(vocab, weights, code_points(MARK + words[i]))
        for m in range(times.shape[1]):
            out[m] += found[min(m, len(found) - 1)] * times[i, m]
    for rows, codes, lengths in grouped([MARK + words[i] for i in short], weights.shape[1]):
        rows = short[rows]
        ids, n, at = vocab.find(codes), codes.shape[1], np.arange(len(rows))
        plain = n <= PLAIN
        terms = piece_terms(ids, weights, plain)
        alpha, beta = forward(terms, n, plain), backward(terms, n, plain, lengths)
        whole = alpha[lengths, at]
        for length, (i, term) in enumerate(zip(ids, terms, strict=True), 1):
            before, after, place = alpha[: n - length + 1].swapaxes(0, 1), beta[length:].swapaxes(0, 1), term[:, : n - length + 1]
            gamma = before * place * after / whole[:, None] if plain else np.exp(before + place + after - whole[:, None])
            gamma[np.arange(n - length + 1)[None, :] + length > lengths[:, None]] = 0
            for m in range(times.shape[1]):
                mine = gamma[:, :, min(m, gamma.shape[2] - 1)] * times[rows, m][:, None]
                out[m] += np.bincount(i.ravel(), mine.ravel(), vocab.size + 2)
    return out


def learn(docs: DataFrame, vocab_path: str, rounds: int = 1) -> tuple[list[str], np.ndarray]:
    """Languages, and piece probabilities (pieces + 2 x languages), from all rows of `docs` (text, lang) whose lang is not null."""
    langs: list[str] = []
    weights: np.ndarray | None = None
    for _ in range(rounds):
        given, own = langs, weights

        def counted(batches: Iterator[pa.RecordBatch], given: list[str] = given, own: np.ndarray | None = own) -> Iterator[pa.RecordBatch]:
            vocab = vocabulary(vocab_path)
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                for part, text in ((p, t) for p in slices(batch, "text", 12 << 20) for t in text_parts(p.column("text"), 12 << 20)):
                    owner, index, words = word_list(text)
                    if not len(index):
                        continue
                    names = part.column("lang").to_pylist()
                    here = given or sorted(set(names))
                    number = {x: i for i, x in enumerate(here)}
                    lang = np.array([number[x] for x in names])[owner]
                    times = np.bincount(lang * len(words) + index, minlength=len(here) * len(words)).reshape(len(here), len(words)).T.astype(float)
                    flat = np.full((vocab.size + 2, 1), 1 / vocab.size) if own is None else own
                    if own is None:
                        flat[vocab.size], flat[vocab.size + 1] = 0, UNKNOWN
                    got = expected(vocab, flat, words, times)
                    for x, i in number.items():
                        if times[:, i].any():
                            sums[x] = sums.get(x, 0) + got[i]
            for x, v in sums.items():
                ids = np.flatnonzero(v > 0)
                # Fixed-point sums do not depend on the order in which partitions arrive.
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(ids)), pa.array(ids, pa.int32()), pa.array(np.rint(v[ids] * 2**16), pa.int64(), safe=False)], ["lang", "piece", "n"])

        rows = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(counted, "lang string, piece int, n bigint").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()  # at most languages x pieces
        langs = sorted(rows.lang.unique())
        size = vocabulary(vocab_path).size
        weights = np.zeros((size + 2, len(langs)))
        for i, x in enumerate(langs):
            mine = rows[rows.lang == x]
            counts = np.bincount(mine.piece, mine.n / 2**16, size + 2)[:size] + SMOOTHING
            weights[:size, i] = counts / counts.sum()
            weights[size + 1, i] = UNKNOWN
    return langs, weights


def predict(docs: DataFrame, vocab_path: str, langs: list[str], weights: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score (the posterior under equal priors) for every row of `docs` (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(weights)  # pieces x languages

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(vocabulary(vocab_path), model.value)
        for batch in batches:
            for part in slices(batch, "text", 6 << 20):
                text = part.column("text")
                names, values = ["und"] * len(text), np.zeros(len(text))
                if langs:
                    logs = np.zeros((len(text), len(langs)))
                    for some in text_parts(text, 6 << 20):
                        owner, index, words = word_list(some)
                        if len(index):
                            by = score(words)
                            for k in range(len(langs)):
                                logs[:, k] += np.bincount(owner, by[index, k], len(text))
                    top = logs.argmax(axis=1)
                    post = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    letters = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\pL"), False))
                    names = [langs[i] if ok else "und" for i, ok in zip(top, letters, strict=True)]
                    values = np.where(letters, post, 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names), pa.array(values)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, vocab_path: str, rounds: int = 1) -> DataFrame:
    """Learns from the rows that are not held out, and predicts all."""
    langs, weights = learn(docs.where(~held_out()), vocab_path, rounds)
    return predict(docs, vocab_path, langs, weights).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
