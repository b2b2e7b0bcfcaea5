"""Vectorised word and shingle hashes over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_INVERSE = np.uint64(pow(int(_PRIME), -1, 2**64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base of rolling hashes, and of its inverse."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _PRIME), ("down", _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of terms: digits, ASCII letters and whatever lies beyond ASCII.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[48:58] = TERM_BYTES[65:91] = TERM_BYTES[97:123] = TERM_BYTES[128:] = True


def words(raw: np.ndarray, ends: np.ndarray, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of every word and, per text, where its words begin (one more at the end).

    Words are runs without SPACE_CHARS, or runs of the bytes that `within` marks; A-Z count as a-z. Words don't reach
    over the end of a text.
    """
    n = len(raw)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(ends), np.int64)
    inside = ~_SPACE[raw] if within is None else within[raw]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    end = inside
    end[:-1] &= ~inside[1:] | edge[1:n]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first]), first, last, np.searchsorted(first, ends)


def heads(raw: np.ndarray, first: np.ndarray, last: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the first so many bytes of each word, or of the whole word if it is shorter."""
    n = len(raw)
    if not len(first):
        return [np.empty(0, np.uint64) for _ in sizes]
    up, down = power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=sums[1:])
    return [mix((sums[np.minimum(first + k, last)] - sums[first]) * down[first] + np.uint64(k)) for k in sizes]


def shingle_sets(raw: np.ndarray, ends: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of so many words; with fewer words, of the whole sequence; without words, none."""
    w, _, _, at = words(raw, ends)
    k = len(w) - width + 1
    rolled = np.zeros(max(k, 0), np.uint64)
    for j in range(width):
        rolled += w[j : j + len(rolled)] * _PLACE[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            parts = w[a:b] * _PLACE[: b - a]
            out.append(mix(parts.sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
