"""Brute-force versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash


def removed_bytes(docs: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple[bytes, bytearray]]:
    """Of each document (id, text), its bytes and which of them go."""
    seen: set[bytes] = set()
    out = {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(w)
        out[i] = (raw, gone)
    return out


def digest(raw: bytes, gone: bytearray) -> tuple[int, int, int, str]:
    runs = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
    return len(raw), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(raw, gone, strict=True) if not g)).hexdigest()


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def components(fps: dict[int, int], most: int = 4) -> dict[int, int]:
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[k] ^ values[k + 1 :]) <= most) + k + 1:
            a, b = find(k), find(int(j))
            parent[max(a, b)] = min(a, b)
    return {ids[k]: ids[find(k)] for k in range(len(ids))}


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None, n: int) -> set[tuple[bytes, ...]]:
    words = split(text)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def leaks(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], threshold: float = 0.8) -> dict[tuple[int, int], tuple[int, int]]:
    """(doc, item) -> shingles of the item, and how many of them the document holds."""
    out = {}
    for d, t in docs:
        for i, x in items:
            n = min(5, len(split(x)))
            s, own = (shingles(x, n), shingles(t, n)) if n else (set(), set())
            if s and len(s & own) >= threshold * len(s) - 1e-9:
                out[d, i] = (len(s), len(s & own))
    return out
