"""Terms of texts as byte ranges: runs of ASCII letters, digits and all characters beyond ASCII,
with A-Z lower-cased.

In UTF-8 every byte of a character beyond ASCII is 0x80 or above, so terms can be found byte by
byte.  Texts are joined into blocks of about ``BLOCK_BYTES``; a longer text comes in several
blocks, cut between terms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

from traderisk.llm.textkernels import mix

BLOCK_BYTES = 1 << 20
BLANK = 32
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c >= 128 else BLANK for c in range(256))
_OUTSIDE = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_BASE = 0x9E3779B97F4A7C15


@dataclass
class Block:
    """Folded bytes, each term's start, end (exclusive) and text number, in order."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray


def _pieces(texts: list[bytes | None]) -> Iterator[tuple[int, bytes]]:
    for i, t in enumerate(texts):
        at = 0
        while t and at < len(t):
            cut = _OUTSIDE.search(t, at + BLOCK_BYTES) if len(t) - at > BLOCK_BYTES else None
            end = cut.start() if cut else len(t)
            yield i, t[at:end]
            at = end


def _block(group: list[tuple[int, bytes]]) -> Block:
    data = (b" " + b" ".join(t for _, t in group) + b" ").translate(_FOLD)
    inside = np.frombuffer(data, np.uint8) != BLANK
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    ends = np.cumsum([len(t) + 1 for _, t in group])  # the blank after each text
    numbers = np.fromiter((i for i, _ in group), np.int64, len(group))
    return Block(data, start, end, numbers[np.searchsorted(ends, start, "left")])


def blocks(texts: pa.Array) -> Iterator[Block]:
    """The terms of all texts; a null has none."""
    group, size = [], 0
    for i, t in _pieces(texts.cast(pa.binary()).to_pylist()):
        if group and size + len(t) > BLOCK_BYTES:
            yield _block(group)
            group, size = [], 0
        group.append((i, t))
        size += len(t)
    if group:
        yield _block(group)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(1 << bits, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def hashes(block: Block) -> np.ndarray:
    """A 64-bit hash of each term's folded bytes, from prefix sums of a polynomial modulo 2**64."""
    codes = np.frombuffer(block.data, np.uint8)
    power, inverse = _powers(max(21, len(codes).bit_length()))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=sums[1:])
    s, e = block.start, block.end
    return mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
