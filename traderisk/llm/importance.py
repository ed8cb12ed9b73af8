"""Operator 13: resampling documents towards a target distribution by importance weights.

Features are the words and word pairs of a text, counted in ``BUCKETS`` hash buckets (CRC-32 of
the UTF-8 bytes).  A bucket's gain is the logarithm of its share among the target's features over
its share among all documents', smoothed; a document's weight is the mean gain of its features.
Seeded Gumbel noise on the weights and a cut at the highest scores draw without replacement in
proportion to the weights' exponentials.

Features are found with an Aho-Corasick automaton over words bounded by a delimiter on both sides;
a word's payload is its CRC and its length.  A scan emits the payloads in order, and the CRC of a
pair is put together from two neighbouring payloads (the first, moved on by the delimiter and by
the length of the second, exclusive-or the second), so no pair is ever spelled out.  Each task
grows its own dictionary with the distinct words it meets, up to ``WORDS_HELD``; a word that the
automaton does not have has its payload computed on the spot.

Two scans: one sums buckets (at most ``BUCKETS`` rows per task and in the driver), one scores.
Ranks come from a range-partitioned sort and a table of one row per partition.

Rows: null and empty texts have no features, weight 0 and are not drawn (fewer than ``LEAST_WORDS``
words); ids may repeat or be null (an empty text in the hash, last among equal scores), every row
has a score of its own; long texts are read whole, in blocks; an empty target or table gives
defined gains (all counts 0); other columns are not looked at.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traderisk.llm.common import map_batches, written
from traderisk.llm.order import numbered
from traderisk.llm.terms import Block, blocks

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 25  # per cent of the documents with so many words
SEED = 7
WORDS_HELD = 1 << 17  # words in a task's automaton
GROWTH = 4  # it is built anew when a quarter as many new words wait


@cache
def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


@cache
def _shift_tables(bit: int) -> np.ndarray:
    """Four tables of 256: a CRC register moved on by 2**bit zero bytes, by its four bytes."""
    if bit == 0:
        byte = np.arange(256, dtype=np.uint32)
        return np.stack([_byte_table()[byte], *((byte << np.uint32(8 * k - 8)) for k in (1, 2, 3))])
    half = _shift_tables(bit - 1)
    return np.stack([_moved(half, row) for row in half])


def _moved(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[0][crc & 255]
    for k in (1, 2, 3):
        out = out ^ tables[k][(crc >> np.uint32(8 * k)) & 255]
    return out


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of first text + a blank + second text, from their CRCs and the second's length in bytes."""
    inner = first ^ np.uint32(0xFFFFFFFF)
    blank = (_byte_table()[(inner ^ np.uint32(32)) & 255] ^ (inner >> np.uint32(8))) ^ np.uint32(0xFFFFFFFF)
    out, length, bit = blank, length.copy(), 0
    while length.any():
        odd = np.flatnonzero(length & 1)
        out[odd] = _moved(_shift_tables(bit), out[odd])
        length >>= 1
        bit += 1
    return out ^ second


class Dictionary:
    """Delimiter-bounded words with (CRC, length) payloads, grown as words are met."""

    def __init__(self, most: int = WORDS_HELD):
        self.most, self.crc, self.automaton, self.waiting = most, np.zeros(0, np.uint32), None, {}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)

    def payloads(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(CRC, length) of the block's words, in order."""
        text = block.data.decode("latin-1")  # a character a byte
        length = block.end - block.start
        crc, known = np.zeros(len(length), np.uint32), np.zeros(len(length), bool)
        if self.automaton is not None:
            emitted = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
            at = np.searchsorted(block.end, emitted[:, 0])  # a match ends at the delimiter after its word
            crc[at], known[at] = self.crc[emitted[:, 1]], True
        for i in np.flatnonzero(~known):
            s, e = block.start[i], block.end[i]
            word = block.data[s:e]
            if (c := self.waiting.get(word)) is None:
                c = zlib.crc32(word)
                if len(self.crc) + len(self.waiting) < self.most:
                    self.waiting[word] = c
            crc[i] = c
        if len(self.waiting) * GROWTH > len(self.crc) or len(self.crc) + len(self.waiting) >= self.most and self.waiting:
            self._grow()
        return crc, length

    def _grow(self) -> None:
        for i, word in enumerate(self.waiting, len(self.crc)):
            self.trie.add_word(f" {word.decode('latin-1')} ", i)
        self.crc = np.concatenate([self.crc, np.fromiter(self.waiting.values(), np.uint32, len(self.waiting))])
        self.waiting = {}
        self.trie.make_automaton()
        self.automaton = self.trie


def features(texts: pa.Array, words: Dictionary, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) of the words and word pairs, block by block."""
    before = (-1, np.uint32(0))  # text number and CRC of the last word, for texts in several blocks
    for block in blocks(texts):
        if not len(block.text):
            continue
        crc, length = words.payloads(block)
        first = np.concatenate([[before[1]], crc[:-1]]).astype(np.uint32)
        paired = np.concatenate([[before[0]], block.text[:-1]]) == block.text
        pairs = joined_crc(first[paired], crc[paired], length[paired])
        before = (block.text[-1], crc[-1])
        yield (np.concatenate([crc, pairs]) % np.uint32(buckets)).astype(np.int64), np.concatenate([block.text, block.text[paired]])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = Dictionary(), np.zeros(buckets, np.int64)
        for batch in batches:
            for bucket, _ in features(batch.column("text"), words, buckets):
                n += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["bucket", "n"])
    summed = map_batches(texts.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    out[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of target share over source share of each bucket, floored."""
    s, t, size = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Dictionary()
        for batch in batches:
            n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            for bucket, text in features(batch.column("text"), words, len(sent.value)):
                n += np.bincount(text, minlength=len(n))
                # Block by block the sums stay far below 2**53: exact in doubles.
                total += np.bincount(text, sent.value[bucket], minlength=len(n)).astype(np.int64)
            pairs = n // 2  # n words have n - 1 pairs
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n - pairs), pa.array(n), pa.array(total // np.maximum(n, 1))],
                                             names=["doc_id", "n_words", "n_features", "weight"])
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of every document."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))
    scored = written(weights(docs, gain).select(
        "doc_id", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"),
        (F.col("n_words") >= least_words).alias("eligible"), F.monotonically_increasing_id().alias("row")), "importance-scores")
    drawn = scored.where("eligible").count() * share // 100
    placed = numbered(scored, F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc())
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))


SQL = r"""
WITH RECURSIVE x AS (SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) AS t(i)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM x WHERE k < 8),
z AS (SELECT list(c ORDER BY b) AS tab FROM x WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, 0 AS target, doc_id, text FROM documents
      UNION ALL SELECT row_number() OVER () AS r, 1 AS target, NULL, text FROM benchmark),
w AS (SELECT r, target, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
f AS (SELECT r, target, unnest(list_concat(ws, [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))])) AS f FROM w),
u AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
h AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || x[2 * i - 1 : 2 * i])::BIGINT FOR i IN range(1, len(x) // 2 + 1)]),
        lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM u, z),
n AS (SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM f JOIN h USING (f) GROUP BY bucket),
a AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
g AS (SELECT n.bucket, floor(1000 * ln((n.t + 1)::DOUBLE * (a.s + 10000)::DOUBLE / ((n.s + 1)::DOUBLE * (a.t + 10000)::DOUBLE)))::BIGINT AS gain FROM n, a),
m AS (SELECT f.r, count(*) AS n_features, floor(sum(g.gain)::DOUBLE / count(*))::BIGINT AS weight
      FROM f JOIN h USING (f) JOIN g USING (bucket) WHERE f.target = 0 GROUP BY f.r),
o AS (SELECT w.r, w.doc_id, len(w.ws) >= 20 AS eligible, coalesce(m.n_features, 0)::BIGINT AS n_features, coalesce(m.weight, 0)::BIGINT AS weight,
        ('0x' || sha256('7:' || coalesce(w.doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM w LEFT JOIN m USING (r) WHERE w.target = 0),
p AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM o),
q AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY eligible) AS of FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 25 * of // 100 THEN place END AS rank FROM q
"""
