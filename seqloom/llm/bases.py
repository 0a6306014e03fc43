"""Vectorised windows of base sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def codes(seq: str) -> np.ndarray:
    """0-3 for A, C, G, T in either case, 4 for any other character."""
    return _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def valid_starts(c: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of ``length`` bases without another letter."""
    if len(c) < length:
        return np.empty(0, np.int64)
    bad = np.zeros(len(c) + 1, np.int64)
    np.cumsum(c == 4, out=bad[1:])
    return np.flatnonzero(bad[length:] == bad[:-length])


def window_codes(c: np.ndarray, k: int, turned: bool = False) -> np.ndarray:
    """Two bits a base, for every window of k <= 32 bases (meaningless where another letter stands); ``turned``: of its reverse complement.

    Codes of 1, 2, 4, ... bases come from two of half the length; those of k bases are put together from them.
    """
    m = len(c) - k + 1
    if m < 1:
        return np.empty(0, np.uint64)
    part = (c & 3).astype(np.uint64)
    if turned:
        part = np.uint64(3) - part
    out, done, width = np.zeros(m, np.uint64), 0, 1
    while True:
        if k & width:
            if turned:
                out |= part[done : done + m] << np.uint64(2 * done)
            else:
                out = (out << np.uint64(2 * width) if done else out) | part[done : done + m]
            done += width
        if 2 * width > k:
            return out
        shift = np.uint64(2 * width)
        part = part[:-width] | part[width:] << shift if turned else part[:-width] << shift | part[width:]
        width *= 2


def canonical_codes(c: np.ndarray, k: int) -> np.ndarray:
    """The lesser code of every window of k bases and its reverse complement."""
    return np.minimum(window_codes(c, k), window_codes(c, k, True))


def groups_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``most`` characters together, at least one text each."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def joined_codes(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts in one array, a foreign letter behind each, and the place of each."""
    starts = np.zeros(len(seqs) + 1, np.int64)
    np.cumsum([len(s) + 1 for s in seqs], out=starts[1:])
    return codes("N".join(seqs) + "N"), starts


def canonical_sets(seqs: list[str], k: int, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For consecutive ranges of texts: first, behind the last, the sorted distinct canonical codes of each, one after another, and where each begins (one more at the end)."""
    for lo, hi in groups_of([len(s) for s in seqs], most):
        c, starts = joined_codes(seqs[lo:hi])
        at = valid_starts(c, k)
        x = canonical_codes(c, k)[at]
        own = np.searchsorted(starts, at, "right") - 1
        if 2 * k + int(hi - lo).bit_length() <= 64:
            both = np.sort(own.astype(np.uint64) << np.uint64(2 * k) | x)
            both = both[np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))] if len(both) else both
            own, x = both >> np.uint64(2 * k), both & np.uint64((1 << 2 * k) - 1)
        else:
            order = np.lexsort((x, own))
            own, x = own[order], x[order]
            new = np.concatenate([[True], (x[1:] != x[:-1]) | (own[1:] != own[:-1])]) if len(x) else np.empty(0, bool)
            own, x = own[new], x[new]
        yield lo, hi, x, np.searchsorted(own, np.arange(hi - lo + 1).astype(own.dtype))


def canonical_set(seq: str | None, k: int) -> np.ndarray:
    """Sorted distinct codes of the windows of k bases, a window and its reverse complement being the same."""
    for _, _, values, _ in canonical_sets([seq or ""], k):
        return values
