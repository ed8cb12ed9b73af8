"""Vectorised word splitting and hashing for Arrow batches.

Texts are joined into one array of code points; word starts and ends come from
array comparisons, and a word's 64-bit hash from prefix sums of a polynomial in
an odd base modulo 2**64 (two prefix values and one multiplication per word).
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

BLOCK_BITS = 18
BLOCK_CHARS = 1 << BLOCK_BITS  # code points held as arrays at once: some 40 bytes each
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain), a bijection."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


@cache
def _space_table() -> np.ndarray:
    t = np.ones(0x110000, bool)
    t[[9, 10, 11, 12, 13, 32]] = False
    return t


@cache
def _alnum_table() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def _blocks(texts: list[str]):
    """(first document, texts) groups of about BLOCK_CHARS; a longer text comes in pieces, cut
    before white space, with ``joined`` set for the pieces after its first."""
    group, first, size = [], 0, 0
    for i, t in enumerate(texts):
        if group and size + len(t) > BLOCK_CHARS:
            yield first, group
            group, size = [], 0
        if len(t) > BLOCK_CHARS:
            at = 0
            while at < len(t):
                m = _SPACE.search(t, at + BLOCK_CHARS)
                end = m.start() if m else len(t)
                yield i, [t[at:end]]
                at = end
            continue
        if not group:
            first = i
        group.append(t)
        size += len(t)
    if group:
        yield first, group


def word_hashes(texts: list[str], words: str = "space", fold: str = "ascii") -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the 64-bit hashes of all words in order; text i has bounds[i]:bounds[i+1].

    words: "space" for runs without white space ``[^\\x20\\x09-\\x0D]+``, "alnum" for runs of
    letters and digits.  fold: "ascii" lower-cases A-Z, "unicode" all letters.
    """
    table = _space_table() if words == "space" else _alnum_table()
    counts = np.zeros(len(texts), np.int64)
    found = []
    for first, group in _blocks([t.lower() for t in texts] if fold == "unicode" else texts):
        codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(codes):
            continue
        if fold == "ascii":
            codes = np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes)
        ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)))
        inside = table[codes]
        starts_here = inside.copy()
        starts_here[1:] &= ~inside[:-1]
        ends_here = inside.copy()
        ends_here[:-1] &= ~inside[1:]
        cut = ends[(ends > 0) & (ends < len(codes))]  # a word does not run on into the next text
        starts_here[cut] |= inside[cut]
        ends_here[cut - 1] |= inside[cut - 1]
        s, e = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
        power, inverse = _powers(max(BLOCK_BITS, int(len(codes)).bit_length()))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=sums[1:])
        found.append(mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)))
        counts[first: first + len(group)] += np.diff(np.searchsorted(s, np.concatenate([[0], ends])))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), bounds


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; with fewer words, of the whole sequence."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    x = np.zeros(n, np.uint64)
    for j in range(k):
        x = mix(x + words[j: j + n] + np.uint64(j + 1))
    return np.unique(x)
