"""Vectorised hashing of token sequences, shared by the Arrow-batched operators."""

from __future__ import annotations

import numpy as np
import xxhash

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_digest = xxhash.xxh3_64_intdigest


def inverse(base: np.uint64) -> np.uint64:
    """Of an odd number modulo 2**64."""
    return np.uint64(pow(int(base), -1, 1 << 64))


INVERSES = tuple(inverse(b) for b in BASES)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 4096) * 2, base)]), dtype=np.uint64)
        _powers[int(base)] = have
    return have[:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_digest, words), np.uint64, len(words))


def rolling(tokens: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Rabin-Karp hashes of every run of ``k`` tokens, modulo 2**64.

    The base is odd, so it has an inverse: with P the prefix sums of token * base**-i, the
    run at s hashes to (P[s + k] - P[s]) * base**s, whatever its place.
    """
    n = len(tokens)
    if n < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(tokens * powers(INVERSES[which], n), out=sums[1:])
        return (sums[k:] - sums[:-k]) * powers(BASES[which], n - k + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that makes their order random."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def anchors(grams: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(at, lo, hi)``: places of the smallest of each ``span`` consecutive hashes (the last of
    equal ones), and the first and last start of the spans that chose each.

    Which place is chosen depends on the span's content alone, so two equal spans choose
    the same one. The place, counted down, takes the low bits of each hash, so there are no
    ties; running minima by blocks are O(n) whatever the span.
    """
    n = len(grams)
    if n < span:
        none = np.empty(0, np.int64)
        return none, none, none
    mask = np.uint64((1 << n.bit_length()) - 1)
    keys = (grams & ~mask) | (mask - np.arange(n, dtype=np.uint64))
    pad = np.full(-n % span, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks = np.concatenate([keys, pad]).reshape(-1, span)
    left = np.minimum.accumulate(blocks, axis=1).ravel()[:n]
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    low = np.minimum(right[: n - span + 1], left[span - 1 :])
    lo = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    hi = np.concatenate([lo[1:], [len(low)]]) - 1
    return (mask - (low[lo] & mask)).astype(np.int64), lo, hi
