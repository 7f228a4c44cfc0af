"""Five-word shingles of whole texts, hashed in numpy for a batch at a time.

A word is a run of letters, digits, underscores and characters beyond ASCII, in
lower case.  A text of one to four words has one shingle, all of it; a text
without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5

_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), ord("_"), *range(128, 256)]] = True


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS = _powers(1 << 12)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word and the number of words of every text."""
    data = [t.lower().encode() for t in texts]
    raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    inside = _WORD_BYTE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    sizes = ends - starts
    at = np.flatnonzero(inside)
    within = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if sizes.max() > len(POWERS):
        power = POWERS[within % len(POWERS)] + (within // len(POWERS)).astype(np.uint64)
    else:
        power = POWERS[within]
    parts = (raw[at].astype(np.uint64) + np.uint64(1)) * power
    words = mix(np.add.reduceat(parts, np.cumsum(sizes) - sizes))
    limits = np.cumsum([len(x) + 1 for x in data])
    counts = np.searchsorted(starts, limits)
    return words, np.diff(np.concatenate([[0], counts]))


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all shingles, text after text, and their number in each text."""
    words, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    long = counts >= SHINGLE
    if len(words) >= SHINGLE:
        total = np.zeros(len(words) - SHINGLE + 1, np.uint64)
        for i in range(SHINGLE):
            total += words[i : len(words) - SHINGLE + 1 + i] * POWERS[i + 1]
        full = owner[: len(total)] == owner[SHINGLE - 1 :]
        hashes, of = mix(total[full]), owner[: len(total)][full]
    else:
        hashes, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero(~long & (counts > 0))
    if len(short):
        starts = (np.cumsum(counts) - counts)[short]
        extra = np.array([mix(np.array([sum(int(words[s + i]) * int(POWERS[i + 1]) for i in range(counts[d])) & (2**64 - 1)], np.uint64))[0] for d, s in zip(short, starts, strict=True)], np.uint64)
        of = np.concatenate([of, short])
        hashes = np.concatenate([hashes, extra])
        order = np.argsort(of, kind="stable")
        hashes, of = hashes[order], of[order]
    return (hashes >> np.uint64(32)).astype(np.uint32), np.bincount(of, minlength=len(texts))


def multisets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes in ascending order, text after text; occurrences; number of distinct ones in each text)."""
    hashes, counts = shingle_hashes(texts)
    key = np.repeat(np.arange(len(texts), dtype=np.uint64), counts) << np.uint64(32) | hashes
    key.sort()
    if not len(key):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(np.append(first, len(key)))
    key = key[first]
    return key.astype(np.uint32), tf, np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(texts))


def portions(texts: list[str], size: int = 1 << 18) -> Iterator[slice]:
    """Runs of texts of about ``size`` characters, so that arrays stay small."""
    start = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield slice(start, i + 1)
            start, n = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
