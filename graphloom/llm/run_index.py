"""A run-length index of a block of strings: the Burrows-Wheeler transform by runs, with sampled run ends.

The transform of a repetitive text has few runs. Where two neighbouring suffixes are preceded by the same letter
(inside a run), the common prefix of the one that follows in the text is shorter by one; so the lengths at the run
ends alone give the length at every place of the text, by streaming through it from sample to sample. That is the
matching statistic of each place against the rest of the block: its longest match elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of `text` (letters below 2**8, unique separators from 2**9 on) in the order of their first `depth` letters, ties by place."""
    n = len(text)
    place = np.flatnonzero(text >= 512)
    end = np.full(n, n)
    end[place] = place
    end = np.minimum.accumulate(end[::-1])[::-1]
    ahead = end - np.arange(n)  # letters before the suffix's own separator
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key <<= np.uint64(9)
        key[: n - k] |= np.where(ahead[: n - k] >= k, np.minimum(text[k:], 511), 0).astype(np.uint64)
    # Suffixes whose separator is among the first letters differ by it; where the letters agree, a stable sort has them in its order.
    own = np.where(ahead < 7, end, 0)
    order = np.argsort(key, kind="stable")
    differ = (key[order][1:] != key[order][:-1]) | (own[order][1:] != own[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], differ.astype(np.int64))))
    done = 7
    while done < depth and rank[order[-1]] < n - 1:
        pair = rank << 32
        pair[: n - done] |= rank[done:] + 1
        order = np.argsort(pair)
        sorted_ = pair[order]
        rank[order] = np.cumsum(np.concatenate(([0], (sorted_[1:] != sorted_[:-1]).astype(np.int64))))
        done *= 2
    return order


@dataclass
class RunIndex:
    """Letters and lengths of the runs, and for each run the text places and common-prefix lengths at its ends."""

    letters: np.ndarray
    lengths: np.ndarray
    head_place: np.ndarray
    head_common: np.ndarray
    tail_place: np.ndarray
    tail_common: np.ndarray
    order: np.ndarray

    @classmethod
    def build(cls, text: np.ndarray, longest: int) -> RunIndex:
        """`text` holds strings of at most `longest` letters, each ended by a separator of its own (512 and up)."""
        order = suffix_array(text, longest + 1)
        bwt = text[order - 1]  # what precedes the first place is the last separator
        change = np.concatenate(([True], bwt[1:] != bwt[:-1]))
        heads = np.flatnonzero(change)
        tails = np.concatenate((heads[1:], [len(order)])) - 1
        return cls(bwt[heads], np.diff(np.concatenate((heads, [len(order)]))), order[heads], common(text, order, heads, longest), order[tails], common(text, order, tails + 1, longest), order)

    def statistics(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place, the length of its common prefix with the suffix before it in suffix order, and with the one after."""
        return streamed(n, self.head_place, self.head_common), streamed(n, self.tail_place, self.tail_common)

    def repeats(self, n: int, least: int) -> np.ndarray:
        """Places whose first `least` letters also start at an earlier place."""
        before, after = self.statistics(n)
        long_ = np.maximum(before, after) >= least
        group = np.cumsum(before[self.order] < least) - 1
        first = np.full(group[-1] + 1, n)
        np.minimum.at(first, group, self.order)
        earlier = np.zeros(n, dtype=bool)
        earlier[self.order] = first[group] < self.order
        return np.flatnonzero(long_ & earlier)


def common(text: np.ndarray, order: np.ndarray, at: np.ndarray, longest: int) -> np.ndarray:
    """Letters that the suffixes at `at - 1` and `at` of the order share; 0 past either end."""
    out = np.zeros(len(at), np.int64)
    inside = np.flatnonzero((at > 0) & (at < len(order)))
    for i in range(0, len(inside), 20_000):
        own = inside[i : i + 20_000]
        a, b = order[at[own] - 1], order[at[own]]
        live, k = np.arange(len(own)), 0
        same = np.zeros(len(own), np.int64)
        while len(live) and k <= longest:
            span = np.arange(k, k + 16)
            x, y = (text[np.minimum(p[live, None] + span, len(text) - 1)] for p in (a, b))
            run = np.argmin(np.concatenate((x == y, np.zeros((len(live), 1), bool)), axis=1), axis=1)
            same[live] += run
            live = live[run == 16]
            k += 16
        out[own] = same
    return out


def streamed(n: int, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The lengths at all places from those at samples: from one sample on, each place's is one less than that before it."""
    last = np.zeros(n, np.int64)
    value = np.zeros(n, np.int64)
    value[place] = length
    last[place] = place
    last = np.maximum.accumulate(last)
    return np.maximum(value[last] - (np.arange(n) - last), 0)
