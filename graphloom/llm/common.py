"""What the corpus operators share: batches of bounded size, bytes of texts, words and their hashes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..storage import cut, dealt, drop, fresh_path, remove, shared_dir

__all__ = ["cut", "dealt", "drop", "fresh_path", "given_back", "is_long", "mix64", "remove", "shared_dir", "slices", "utf8_bytes", "word_bounds", "word_hashes", "word_parts"]

#: Bytes of text that one numpy step holds at once; an Arrow batch is cut into slices of about this size.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that `column` has about `most` bytes in each part; a longer text is a part of its own, which `is_long` tells."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // most
    long_ = sizes > most
    cuts = (np.diff(part) > 0) | long_[1:] | long_[:-1]
    starts = np.concatenate(([0], np.flatnonzero(cuts) + 1, [batch.num_rows]))
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield batch.slice(a, b - a)


def is_long(column: pa.Array, most: int = SLICE_BYTES) -> bool:
    """Whether a part is one text of more than `most` bytes, which is then read piece by piece."""
    return len(column) == 1 and column[0].is_valid and (pc.binary_length(column)[0].as_py() or 0) > most


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, one text after another, and the n + 1 offsets of the texts; nulls are empty."""
    column = pc.fill_null(column, "")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) and offsets[-1] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at their end, what a Python worker has freed goes back to the system, since the worker waits for its next task."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words `[^\\x20\\x09-\\x0D]+`; no word runs over the end of its text."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    space = SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge[offsets] = True
    edges = np.flatnonzero(edge)
    starts, ends = edges[:-1], edges[1:]
    word = ~space[starts]
    starts, ends = starts[word], ends[word]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_parts(raw: np.ndarray, most: int = SLICE_BYTES, stops: np.ndarray = SPACE) -> Iterator[tuple[int, int]]:
    """Bounds of the parts of one text of at least `most` bytes each (the last may have fewer), cut where a byte of `stops` begins a part."""
    at, size = 0, len(raw)
    while at < size:
        stop = min(at + most, size)
        while stop < size:
            block = stops[raw[stop : stop + (1 << 16)]]
            if len(hit := np.flatnonzero(block)):
                stop += int(hit[0])
                break
            stop += len(block)
        yield at, stop
        at = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers of the odd multiplier that word hashes use, by position in the word; longer words repeat the table with a mixed base.
_POWER_N = 1 << 12
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(_POWER_N - 1, 0x9E3779B97F4A7C15, np.uint64))))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word's bytes, or of any other stretches that do not overlap; about `block` bytes are held at once."""
    sums = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return sums
    lengths = ends - starts
    upto = np.cumsum(lengths)
    for begin in range(0, int(upto[-1]), block):
        stop = min(begin + block, int(upto[-1]))
        one, last = np.searchsorted(upto, [begin, stop - 1], side="right")
        own = slice(int(one), int(last) + 1)
        before = upto[own] - lengths[own]
        low, high = np.maximum(before, begin), np.minimum(upto[own], stop)
        at = np.arange(begin, stop)
        n = high - low
        inside = at - np.repeat(before, n)
        value = (raw[inside + np.repeat(starts[own], n)].astype(np.uint64) + np.uint64(1)) * POWERS[inside % _POWER_N]
        if int(lengths[own].max()) > _POWER_N:
            value = value * (np.uint64(2) * (inside // _POWER_N).astype(np.uint64) + np.uint64(1))
        # Words of no length have nothing to add.
        some = n > 0
        sums[own][some] += np.add.reduceat(value, (low - begin)[some])
    return mix64(sums + lengths.astype(np.uint64))
