"""Words and word n-grams of Arrow string columns as 64-bit hashes, whole batches at a time in numpy.

A word's hash is the polynomial sum of random 64-bit values of its bytes; with an odd base the prefix sums of a
batch give every word's hash in one pass. An n-gram's hash mixes its words' hashes in order. Texts are cut at
separators into slices, so the scratch memory is bounded by a slice or the longest single word.
"""

from __future__ import annotations

import numpy as np

_R = np.random.default_rng(20240611).integers(0, 2**64, 256, dtype=np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 500_000

#: Bytes of a word by kind: ``plain`` is all but the six blanks of ASCII, ``alnum`` is 0-9, a-z and all non-ASCII bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KINDS = {"plain": np.ones(256, bool), "alnum": np.zeros(256, bool)}
KINDS["plain"][[9, 10, 11, 12, 13, 32]] = False
KINDS["alnum"][[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that sums and orders of them behave as random."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept and grown as needed."""
    if len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for k, b in enumerate((_BASE, inverse)):
            p = np.full(max(n, _SLICE), b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def words(data: np.ndarray, at: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (in ``data``), row and hash of every word; upper-case ASCII counts as lower."""
    inside = KINDS[kind]
    starts, ends, hashes = [], [], []
    lo, stop = int(at[0]), int(at[-1])
    cuts = at[1:-1]
    while lo < stop:
        hi = min(stop, lo + _SLICE)
        while hi < stop:  # back to a cut between words, or on to the next one
            edge = np.flatnonzero(~inside[data[lo:hi]])
            k = np.searchsorted(cuts, hi, "right") - 1
            cut = max(lo + int(edge[-1]) if len(edge) else lo, int(cuts[k]) if k >= 0 and cuts[k] > lo else lo)
            if cut > lo:
                hi = cut
                break
            hi = min(stop, hi + _SLICE)
        b = data[lo:hi]
        w = inside[b]
        first = np.zeros(hi - lo + 1, bool)
        first[cuts[np.searchsorted(cuts, lo) : np.searchsorted(cuts, hi, "right")] - lo] = True
        begin = w.copy()
        begin[1:] &= ~w[:-1] | first[1:-1]
        over = w.copy()
        over[:-1] &= ~w[1:] | first[1:-1]
        s, e = np.flatnonzero(begin), np.flatnonzero(over) + 1
        up, down = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_R[LOWER[b]] * up[: hi - lo], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    s = np.concatenate(starts)
    return s, np.concatenate(ends), np.searchsorted(at, s, "right") - 1, np.concatenate(hashes)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on, for the ``len(h) - k + 1`` places."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _BASE
        out += h[j : j + n]
    return mix(out)


def shingle_sets(data: np.ndarray, at: np.ndarray, kind: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row, end to end, and n + 1 offsets.

    A row with fewer than k words but not none has its whole sequence as its one shingle.
    """
    n = len(at) - 1
    _, _, row, h = words(data, at, kind)
    count = np.bincount(row, minlength=n)
    g = grams(h, k)
    own = row[: len(g)] == row[k - 1 :] if len(g) else np.zeros(0, bool)
    rows, values = row[: len(g)][own], g[own]
    begin = np.concatenate([[0], np.cumsum(count)])
    few = np.flatnonzero((count > 0) & (count < k))
    short = np.zeros(len(few), np.uint64)
    for c in range(1, k):
        of = count[few] == c
        if of.any():
            place = begin[few[of]]
            out = h[place].copy()
            for j in range(1, c):
                out = out * _BASE + h[place + j]
            short[of] = mix(out + np.uint64(c))
    rows, values = np.concatenate([rows, few]), np.concatenate([values, short])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[keep], values[keep]
    return values, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
