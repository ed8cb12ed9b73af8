"""Encoding by remembered pre-tokens.

A byte-pair tokenizer merges inside pre-tokens only, so a text's ids are its pre-tokens' ids
in order.  Natural texts repeat their pre-tokens: each distinct one is encoded by the library
once per worker and remembered.  Texts with anything outside the plain Latin range, where
Unicode tables could differ between libraries, or with a special-token opening go to the
library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import cache

import numpy as np

# One thread per task: Spark owns the cores.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

REMEMBERED = 1_000_000  # pre-tokens kept per worker; beyond it the memory starts afresh with the next text

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
_DIGIT = "0-9²³¹¼-¾"
_PLAIN = re.compile("[\\t\\n\\r -~¡-įı-ſ]*")
# The two public pre-tokenizer patterns, as the tokenizer files state them, over the plain range.
_BYTE_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\s{_LETTER}{_DIGIT}]+|\s+(?!\S)|\s+")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's rule: printable bytes stand for themselves, the others for 256 onwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Memory(dict):
    """Ids by pre-token, each made when it is first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, pretoken: str) -> bytes:
        ids = self[pretoken] = self.make(pretoken)
        return ids


class PretokenEncoder:
    """``encode(text)`` gives the library's ids (add_special_tokens=False) as an array."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = (spec.get("normalizer") or {}).get("type"), (spec.get("pre_tokenizer") or {}).get("type")
        self.words = kind == ("Sequence", "Sequence")
        self.known = kind == (None, "ByteLevel") or self.words
        self.pattern = _WORDS if self.words else _BYTE_LEVEL
        self.openings = sorted({t["content"][:2] for t in spec["added_tokens"]})
        self.dtype = np.dtype("<u2") if self.whole.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.memory = _Memory(self._encode)

    def _encode(self, pretoken: str) -> bytes:
        word = pretoken.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(word)], self.dtype).tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids per text."""
        out, ids_of = [], self.memory.__getitem__
        for t in texts:
            if len(self.memory) > REMEMBERED:
                self.memory.clear()
            if self.known and _PLAIN.fullmatch(t) and not any(s in t for s in self.openings):
                found = self.pattern.findall(t.lower() if self.words else t)
                out.append(np.frombuffer(b"".join(map(ids_of, found)), self.dtype))
            else:
                out.append(np.array(self.whole.encode(t, add_special_tokens=False).ids, self.dtype))
        return out


@cache
def encoder(path: str) -> PretokenEncoder:
    """One encoder per worker process and tokenizer."""
    return PretokenEncoder(path)
