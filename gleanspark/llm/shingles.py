"""Word shingles of many texts at once, as sorted sets of hashes in numpy."""

from __future__ import annotations

import functools

import numpy as np

#: Tokens are hashes of 46 bits: beside the number of a text within its batch they fit in one sortable integer.
TOKEN_BITS = 46
_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64 bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


@functools.cache
def _alnum() -> np.ndarray:
    """Letters and digits among all code points."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@functools.cache
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _A | _U(1), dtype=_U))


def shingle_sets(texts: list[str | None], words: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, bounds, tokens): texts with min_words words or more, and their distinct shingles, sorted within each.

    Text which[k] has tokens[bounds[k]:bounds[k + 1]]. Words are runs of letters or digits, lower-cased. At most 2^17
    texts a call.
    """
    empty = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=_U)
    if not texts:
        return empty
    cp = np.frombuffer("\0".join([(t or "").lower() for t in texts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    isw = _alnum()[cp]
    at = np.flatnonzero(isw)
    if not len(at):
        return empty
    fresh = np.empty(len(at), dtype=bool)
    fresh[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=fresh[1:])
    begin = np.flatnonzero(fresh)
    lengths = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, lengths)
    with np.errstate(over="ignore"):
        word = mix(np.add.reduceat((cp[at].astype(_U) + _U(0x51ED)) * _powers(int(lengths.max()))[place], begin))
    ends = np.flatnonzero(cp == 0)  # a NUL within a text parts words as well, but not texts
    if len(ends) != len(texts) - 1:
        ends = np.cumsum([len((t or "").lower()) + 1 for t in texts])[:-1] - 1
    text_of = np.searchsorted(ends, at[begin])
    counts = np.bincount(text_of, minlength=len(texts))
    if len(word) < words:
        return empty
    with np.errstate(over="ignore"):
        s = word[: len(word) - words + 1].copy()
        for k in range(1, words):
            s = s * _B + word[k : len(word) - words + 1 + k] * _C
    ok = (text_of[: len(s)] == text_of[words - 1 :]) & (counts[text_of[: len(s)]] >= max(min_words, words))
    key = (text_of[: len(s)][ok].astype(_U) << _U(TOKEN_BITS)) | (mix(s[ok]) >> _U(64 - TOKEN_BITS))
    key.sort()
    if not len(key):
        return empty
    key = key[np.append(True, key[1:] != key[:-1])]
    owner = (key >> _U(TOKEN_BITS)).astype(np.int64)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    return owner[first], np.append(first, len(key)), key & _U((1 << TOKEN_BITS) - 1)


def set_keys(bounds: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A 63 bit key of each set: equal for equal sets."""
    if len(bounds) < 2:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        a = np.add.reduceat(mix(tokens * _B + _C), bounds[:-1])
        return (mix(a + np.diff(bounds).astype(_U) * _A) >> _U(1)).astype(np.int64)
