"""Operator 8: token counts with the whole-token shortcut.

A piece model merges inside runs "white space, then other characters" only when no piece has
white space after another character and none holds a line feed; ``PieceCounter`` proves both
from the vocabulary, and which vocabulary strings the library encodes alone as one token.
Pre-tokens among these count as one directly; the others are merged by the library once per
worker and remembered.  If the proof fails for a model, every text goes to the library whole.

Rows: null and empty texts have no tokens; repeated rows and ids are counted each; texts of any
length are counted whole; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traderisk.llm.common import map_batches, texts_of
from traderisk.llm.pretokens import REMEMBERED, tokenizer_path

MARK = "▁"  # the library's visible white space
_PRETOKEN = re.compile(r"\n| *[^ \n]+| +")


class PieceCounter:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.library = SentencePieceProcessor(model_file=path)
        ids = range(self.library.get_piece_size())
        plain = [self.library.id_to_piece(i) for i in ids
                 if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        probes = ["a  b", " a", "Aﬁé 　x", "a\tb "]
        unchanged = all(self.library.decode(self.library.encode(p)) == p for p in probes)
        self.splits = unchanged and not any(MARK in p.lstrip(MARK) or "\n" in p for p in plain)
        self.memory: dict[str, int] = {}
        if self.splits:
            words = [p.replace(MARK, " ") for p in plain]
            self.whole = {w: 1 for w, n in zip(words, self._merge(words)) if n == 1}
            self.memory = dict(self.whole)

    def _merge(self, pretokens: list[str]) -> list[int]:
        # After a line feed no white space is put in front: its two tokens are taken off again.
        return [len(e) - 2 for e in self.library.encode(["\n" + p for p in pretokens], num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(e) for e in self.library.encode(texts, num_threads=1)]
        parts = [_PRETOKEN.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        every = set().union(*parts)
        new = every.difference(self.memory)
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory = dict(self.whole)
            new = every.difference(self.memory)
        new = list(new)
        self.memory.update(zip(new, self._merge(new)))
        return [sum(map(self.memory.__getitem__, p)) for p in parts]


@cache
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, limit: int = 4096, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per document, in one pass without a shuffle."""
    path = tokenizer_path(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = counter(path).count(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])
    sized = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return map_batches(sized, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
