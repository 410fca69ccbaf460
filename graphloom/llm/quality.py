"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Statistics of a whole text come from its bytes: lengths, shares of byte classes, word lengths, and how often words
and lines repeat. Standardised, they pass through random Fourier features, whose inner products approximate a
Gaussian kernel. Each partition adds up its part of the normal equations, separately for each of FOLDS folds; the
parts are summed in a tree, and the driver solves a system whose size does not depend on the data. Scores of
each fold by the equations of the other folds are counted on a fixed grid by label, and isotonic regression on the
grid turns scores into probabilities.

Some numbers are bounded, for all texts alike. Mean and spread of word lengths count 40 bytes at most (MOST_WORD), so
that one unbroken line does not stretch the scale of all; beyond, texts differ in the longest word only. Standardised
statistics stop at 8 deviations (MOST_DEVIATION), so that the kernel sees an outlier as such and not as a random phase.
Raw scores of the ridge regression, whose targets are 0 and 1, are placed on a grid from -0.5 to 1.5 (SPAN); those outside
take the probability of its ends.

A text of more than 2 MB is read in parts of that size, cut at white space and again at ends of lines; sums, the longest
word, and the hashes of its distinct words and lines are carried from part to part (8 bytes each).

Nulls count as empty texts and are scored like them. Repeated rows get equal scores; where a document has several
labels their mean counts, and labels that are null are left out. Without any label every score is 0.5. Other
columns are kept by `accepted` and not read by `score`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import SLICE_BYTES, cut, drop, given_back, is_long, slices, utf8_bytes, word_bounds, word_hashes, word_parts

FEATURES = 256
FOLDS = 4
GRID = 2048
SEED = 20_240_501
RIDGE = 1e-3
SPAN = (-0.5, 1.5)
MOST_WORD, MOST_DEVIATION = 40, 8
#: Sums of the normal equations that one task adds up.
FAN_IN = 32

#: Byte classes, each a share of the text's bytes.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:'\"-()", "bang": b"!?", "bar": b"|/\\_<>[]{}=", "mark": b"*$%&#@^~+", "newline": b"\n", "blank": b" \t\r\x0b\x0c", "high": bytes(range(128, 256))}
NAMES = [*CLASSES, "bytes", "words", "word_length", "word_spread", "distinct", "line_words", "lines_distinct", "upper_words", "marked_words", "longest"]
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _i, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes)] = _i
NEWLINE = np.arange(256) == 10


def class_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each class every text has."""
    n, width = len(offsets) - 1, 16
    key = np.repeat(np.arange(n, dtype=np.int32) * width, np.diff(offsets)) + _CLASS[raw]
    return np.bincount(key, minlength=n * width).reshape(n, width)[:, : len(CLASSES)].astype(float)


def distinct_count(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many there are of each text, and how many distinct ones."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    first = np.ones(len(o), dtype=bool)
    first[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return np.bincount(owner, minlength=n).astype(float), np.bincount(o[first], minlength=n).astype(float)


BANG, MARKS, UPPER = list(CLASSES).index("bang"), list(CLASSES).index("mark"), list(CLASSES).index("upper")


def tail_classes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words have a capital before or at their end, and which end in a mark."""
    upper = _CLASS[raw[ends - 1 - ((ends - starts) > 2)]] == UPPER
    tail = _CLASS[raw[ends - 1]]
    return upper, (tail >= BANG) & (tail <= MARKS)


def row(classes, size, words, length, squares, distinct, lines, distinct_lines, upper, marked, longest) -> np.ndarray:
    """The statistics of texts from their sums, as a row of NAMES each."""
    some = np.maximum(words, 1)
    mean = length / some
    spread = np.sqrt(np.maximum(squares / some - mean**2, 0))
    return np.column_stack((
        classes / np.maximum(size, 1)[:, None], np.log1p(size), np.log1p(words), np.minimum(mean, MOST_WORD), np.minimum(spread, MOST_WORD), np.where(words > 0, distinct / some, 1.0),
        np.log1p(words / np.maximum(lines, 1)), np.where(lines > 0, distinct_lines / np.maximum(lines, 1), 1.0), upper / some, marked / some, np.log1p(longest),
    ))


def line_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of lines, each with its newline."""
    new = np.zeros(len(raw) + 1, dtype=bool)
    new[1:] = raw == 10
    new[offsets] = True
    edge = np.flatnonzero(new[:-1])
    return edge, np.concatenate((edge[1:], [len(raw)])) if len(edge) else edge


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of NAMES for each text."""
    raw, offsets = utf8_bytes(texts)
    if is_long(texts):
        return long_statistics(raw)
    n = len(offsets) - 1
    starts, ends, owner = word_bounds(raw, offsets)
    length = (ends - starts).astype(float)
    with np.errstate(over="ignore"):
        words, distinct = distinct_count(owner, word_hashes(raw, starts, ends), n)
        begin, stop = line_bounds(raw, offsets)
        lines, distinct_lines = distinct_count(np.searchsorted(offsets, begin, side="right") - 1, word_hashes(raw, begin, stop), n)
    upper, marked = tail_classes(raw, starts, ends)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    count = lambda weight: np.bincount(owner, weight, n)
    return row(class_counts(raw, offsets), np.diff(offsets).astype(float), words, count(length), count(length**2), distinct, lines, distinct_lines, count(upper), count(marked), longest)


def long_statistics(raw: np.ndarray, most: int = SLICE_BYTES) -> np.ndarray:
    """The same of one text, part by part."""
    classes, (length, squares, upper, marked, longest) = np.zeros((1, len(CLASSES))), np.zeros(5)
    words = lines = 0
    known: dict[str, np.ndarray] = {"words": np.zeros(0, np.uint64), "lines": np.zeros(0, np.uint64)}
    with np.errstate(over="ignore"):
        for a, b in word_parts(raw, most):
            part = raw[a:b]
            for i in range(0, b - a, SLICE_BYTES):  # a part may be one long word
                classes += np.bincount(_CLASS[part[i : i + SLICE_BYTES]], minlength=256)[: len(CLASSES)]
            starts, ends, _ = word_bounds(part, np.array([0, b - a]))
            n = (ends - starts).astype(float)
            own = tail_classes(part, starts, ends)
            words, length, squares, upper, marked, longest = words + len(n), length + n.sum(), squares + (n**2).sum(), upper + own[0].sum(), marked + own[1].sum(), max(longest, n.max(initial=0))
            known["words"] = np.union1d(known["words"], word_hashes(part, starts, ends))
        for a, b in word_parts(raw, most, NEWLINE):
            # A part begins with the newline of the line before it; that line's end is in its own part.
            begin, stop = line_bounds(part := raw[a + (a > 0) : b + (b < len(raw))], np.array([0, len(part)]))
            lines += len(begin)
            known["lines"] = np.union1d(known["lines"], word_hashes(part, begin, stop))
    one = lambda x: np.array([float(x)])
    return row(classes, one(len(raw)), one(words), one(length), one(squares), one(len(known["words"])), one(lines), one(len(known["lines"])), one(upper), one(marked), one(longest))


@dataclass
class Model:
    """Everything that scoring needs; a few hundred numbers and the projection, whatever the data."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    grid: np.ndarray

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        at = on_grid(fourier((stats - self.mean) / self.scale) @ self.weights)
        return np.clip(np.interp(at, np.arange(len(self.grid)), self.grid), 0, 1)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel, with a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.standard_normal((x.shape[1], FEATURES)) / np.sqrt(x.shape[1])
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.concatenate((np.sqrt(2 / FEATURES) * np.cos(np.clip(x, -MOST_DEVIATION, MOST_DEVIATION) @ w + b), np.ones((len(x), 1))), axis=1)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to `value` (pool adjacent violators); places without weight are filled in."""
    pools: list[list[float]] = []
    for v, w, n in zip(value, weight, range(len(value)), strict=True):
        if w <= 0:
            continue
        pools.append([v * w, w, n, n])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, w2, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + w2, pools[-1][2], last]
    if not pools:
        return np.full(len(value), 0.5)
    xs = [x for p in pools for x in (p[2], p[3])]
    ys = [p[0] / p[1] for p in pools for _ in range(2)]
    return np.interp(np.arange(len(value)), xs, ys)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                stats = statistics(part.column("text"))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), flat], ["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: given_back(computed(batches)), f"doc_id {kind}, stats array<double>")


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, len(NAMES)))


def folds_of(doc_ids: pd.Series) -> np.ndarray:
    return (pd.util.hash_array(doc_ids.to_numpy()) >> 7) % FOLDS


def tree_widths(parts: int) -> list[int]:
    """Groups of each level of a tree in which no group has more than FAN_IN members, down to one group."""
    widths = []
    while parts > 1 or not widths:
        parts = -(-parts // FAN_IN)
        widths.append(parts)
    return widths


def normal_equations(train: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """For each fold, the sums of products of features and label over the rows of `train`, a table (doc_id, stats, label); one such sum of 2 MB reaches the driver."""
    width = FEATURES + 2
    shape = (FOLDS, width, width)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        acc = np.zeros(shape)
        seen = False
        for pdf in batches:
            fold = folds_of(pdf["doc_id"])
            z = np.concatenate((fourier((matrix(pdf["stats"]) - mean) / scale), pdf[["label"]].to_numpy()), axis=1)
            for k in range(FOLDS):
                acc[k] += z[fold == k].T @ z[fold == k]
            seen |= len(pdf) > 0
        if seen:
            yield pd.DataFrame({"at": [TaskContext.get().partitionId()], "sums": [acc.tobytes()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(FOLDS * width**2)
        for x in pdf.sort_values("at")["sums"]:
            total += np.frombuffer(x)
        return pd.DataFrame({"at": [pdf["at"].min()], "sums": [total.tobytes()]})

    tree = train.mapInPandas(partial, "at int, sums binary")
    for groups in tree_widths(train.rdd.getNumPartitions()):
        tree = tree.groupBy((F.col("at") % groups).alias("k")).applyInPandas(added, "at int, sums binary")
    total = np.zeros(shape)
    for sums_ in tree.collect():  # one row
        total += np.frombuffer(sums_["sums"]).reshape(shape)
    return total


def solve(s: np.ndarray) -> np.ndarray:
    """The ridge weights of summed normal equations; the constant is not held back."""
    width = FEATURES + 1
    penalty = np.full(width, max(RIDGE * max(s[width - 1, width - 1], 1), 1e-2))
    penalty[-1] = 1e-9
    return np.linalg.solve(s[:width, :width] + np.diag(penalty), s[:width, width])


def on_grid(raw: np.ndarray) -> np.ndarray:
    """Places of raw scores on the calibration grid."""
    return np.clip((raw - SPAN[0]) / (SPAN[1] - SPAN[0]), 0, 1) * (GRID - 1)


def fit(stats: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on the rows of `stats` (doc_id, stats) that have a label in `labels` (doc_id, label)."""
    marked = labels.where("label is not null").groupBy("doc_id").agg(F.avg(F.col("label").cast("double")).alias("label"))
    train = cut(stats.join(marked, "doc_id").select("doc_id", "stats", "label"), "train")
    moments = train.select(F.count("*").alias("n"), *[f(F.col("stats")[i]).alias(f"{f.__name__}{i}") for i in range(len(NAMES)) for f in (F.avg, F.stddev_pop)]).first()
    if not moments["n"]:
        return None
    mean = np.array([moments[f"avg{i}"] for i in range(len(NAMES))])
    scale = np.array([max(moments[f"stddev_pop{i}"], 1e-6) for i in range(len(NAMES))])
    total = normal_equations(train, mean, scale)
    whole = total.sum(axis=0)
    folds = np.stack([solve(whole - t) if (whole - t)[FEATURES, FEATURES] > 0 else solve(whole) for t in total])

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = (fourier((matrix(pdf["stats"]) - mean) / scale) * folds[folds_of(pdf["doc_id"])]).sum(axis=1)
            yield pd.DataFrame({"at": np.rint(on_grid(raw)).astype(np.int32), "label": pdf["label"]}).groupby("at", as_index=False).agg(n=("label", "size"), good=("label", "sum"))

    grid = train.mapInPandas(placed, "at int, n bigint, good double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).toPandas()  # at most GRID rows
    drop(train)
    weight = np.bincount(grid["at"], grid["n"], GRID)
    value = np.bincount(grid["at"], grid["good"], GRID) / np.maximum(weight, 1)
    return Model(mean, scale, solve(whole), isotonic(value, weight))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from."""
    return labels.where(~held_out()).select("doc_id", F.col("quality").alias("label"))


def probability(stats: Column, model: Model | None) -> Column:
    """The score of a row's statistics."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(model(np.asarray(column.flatten()).reshape(-1, len(NAMES))))

    return scored(stats)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs` (doc_id, text)."""
    stats = cut(with_statistics(docs), "statistics")
    out = stats.withColumn("score", probability(F.col("stats"), fit(stats, training_labels(labels))))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that score at least 0.5; they are written once with their statistics, so that these are taken once."""
    mark = "_graphloom_stats"

    @F.arrow_udf("array<double>")
    def taken(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        found = [statistics(part.column("text")) for part in slices(batch, "text")]
        flat = np.concatenate(found).ravel() if found else np.zeros(0)
        return pa.FixedSizeListArray.from_arrays(pa.array(flat), len(NAMES)).cast(pa.list_(pa.float64()))

    rows = cut(docs.withColumn(mark, taken("text")), "statistics")
    model = fit(rows.select("doc_id", F.col(mark).alias("stats")), training_labels(labels))
    return rows.where(probability(F.col(mark), model) >= 0.5).select(*docs.columns)
