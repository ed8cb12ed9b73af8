"""Operator 2: benchmark decontamination by BM25 retrieval and overlap checks.

Test items (cut into parts of at most ``PART_WORDS`` words) form a BM25 inverted index; weights
are divided by the part's own total, so a part's score is the share of its BM25 mass that a
passage covers.  Every document is cut into passages of 2 * ``PART_WORDS`` words that overlap by
half, so a copied part lies whole in one of them, and every passage is a query.  Block-max
WAND, for a batch of passages at once: a passage is dropped if the sum of its terms' maxima
stays below the threshold, then each block of parts whose block maxima stay below it; only
what is left is scored in full.  All (passage, part) pairs at or above the threshold come out;
none is cut off.  A retrieved item counts if the document has at least ``OVERLAP`` of the
three-word shingles of its question *and* of its answer.

An item's answer is its last sentence (and those before it until it has a shingle's words; with
one sentence, its second half), the question the rest.

Items are indexed in blocks of the words of about ``INDEX_PARTS`` parts, so a broadcast index has a bounded size
whatever the benchmark's; each block is one more scan of the documents.  An item of up to
``LONG_ITEM`` words stays in one block, with its shingles beside it once.  Of a longer item only the
parts are indexed, spread over the blocks; its shingles stay in a table, and the documents that
retrieve one of its parts are checked by a join on the shingles.

Rows: null or empty texts and items match nothing; repeated documents are each found; repeated
items are found under each id.  Documents and items of any length are taken whole.  Columns beside
id and text are not looked at and may have any name; ``keep_clean`` gives them back as they were.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traderisk.llm.common import filter_rows, map_batches, texts_of, written
from traderisk.llm.textkernels import shingles, word_hashes

PART_WORDS = 64
INDEX_PARTS = 20_000  # whole parts in a block; shorter ones count by their words
PART_COST = 16  # words that a part counts for by itself
LONG_ITEM = 16_384  # words; a longer item's shingles are not broadcast
BLOCK = 16  # parts per block of the index
THRESHOLD = 0.5
OVERLAP = 0.5
SHINGLE = 3
K1, B = 1.2, 0.75
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
PARTS = "uid long, item_id long, part int, item_words long, words array<long>"
HALVES = "uid long, item_words long, half int, k int, shingles array<long>"
FOUND = "row_key long, doc_id long, uid long, item_id long, score double, question_overlap double, answer_overlap double, block int"


def question_answer(text: str) -> tuple[str, str]:
    """The answer is the last sentence, with those before it until it has a whole shingle."""
    parts = [p for p in _SENTENCE.split(text) if p.strip()]
    for at in range(len(parts) - 1, 0, -1):
        answer = " ".join(parts[at:])
        if len(answer.split()) >= SHINGLE:
            return " ".join(parts[:at]), answer
    words = text.split()
    return " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2:])


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(texts, words="alnum", fold="unicode")


def _parts(numbered: DataFrame) -> DataFrame:
    """The parts of every item with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = _words(texts_of(batch))
            words, size = words.view(np.int64), np.diff(at)
            parts = -(-size // PART_WORDS)
            of = np.repeat(np.arange(batch.num_rows), parts)
            part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
            starts = np.append(at[of] + part * PART_WORDS, len(words)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid").take(pa.array(of)), batch.column("item_id").take(pa.array(of)), pa.array(part.astype(np.int32)),
                 pa.array(size[of].astype(np.int64)), pa.ListArray.from_arrays(pa.array(starts), pa.array(words))], names=["uid", "item_id", "part", "item_words", "words"])
    return map_batches(numbered, run, PARTS)


def _halves(numbered: DataFrame) -> DataFrame:
    """The distinct shingles (of k words) of every item's question (half 0) and answer (half 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uid, text in zip(batch.column("uid").to_pylist(), texts_of(batch)):
                words, at = _words(list(question_answer(text)))
                for half in (0, 1):
                    mine = words[at[half]: at[half + 1]]
                    rows.append((uid, len(words), half, min(SHINGLE, len(mine)), shingles(mine, SHINGLE).view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["uid", "item_words", "half", "k", "shingles"])
    return map_batches(numbered.select("uid", "text"), run, HALVES)


class Index:
    """The inverted index of one block of parts, as arrays; ``hits`` queries it with whole documents.

    ``checks`` has (k, shingles) of question and answer by uid, for all but long items.
    """

    def __init__(self, rows: list[dict], checks: dict[int, list[tuple[int, np.ndarray]]], idf: dict[int, float], mean_words: float):
        self.uids = [r["uid"] for r in rows]
        self.items = {r["uid"]: r["item_id"] for r in rows}
        self.checks = checks
        postings = []
        for p, r in enumerate(rows):
            terms, tf = np.unique(np.array(r["words"], np.int64), return_counts=True)
            weight = np.array([idf[int(t)] for t in terms]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(r["words"]) / mean_words))
            postings.append((terms, np.full(len(terms), p), weight / weight.sum()))
        terms, part, weight = (np.concatenate(x) for x in zip(*postings))
        self.vocabulary, term = np.unique(terms, return_inverse=True)
        self.blocks = -(-len(rows) // BLOCK)
        order = np.lexsort((part, term))
        term, self.part, self.weight = term[order], part[order], weight[order]
        # Postings by (term, block), and the maximum of each such run: the block maxima.
        key = term * self.blocks + self.part // BLOCK
        self.run_key, self.run_at = np.unique(key, return_index=True)
        self.run_end = np.append(self.run_at[1:], len(key))
        self.run_max = np.maximum.reduceat(self.weight, self.run_at)
        run_term = self.run_key // self.blocks
        self.term_run = np.searchsorted(run_term, np.arange(len(self.vocabulary) + 1))
        self.term_max = np.maximum.reduceat(self.weight, np.searchsorted(term, np.arange(len(self.vocabulary))))

    def _candidates(self, words: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float]]:
        """(document, part, best score) of all pairs with a passage at or above the threshold."""
        signed = words.view(np.int64)
        spot = np.minimum(np.searchsorted(self.vocabulary, signed), len(self.vocabulary) - 1)
        known = self.vocabulary[spot] == signed
        size = np.diff(at)
        halves = np.maximum(-(-size // PART_WORDS), 1)  # half passages per document; the last also starts one
        first = np.cumsum(halves) - halves
        doc = np.repeat(np.arange(len(size)), size)
        half = first[doc] + (np.arange(len(words)) - at[doc]) // PART_WORDS
        n = len(self.vocabulary)
        here = np.unique(half[known] * n + spot[known])
        more = here[here // n > first[np.repeat(np.arange(len(size)), halves)][here // n]]  # also in the passage begun one half earlier
        pairs = np.unique(np.concatenate([here, more - n]))
        passage, term = pairs // n, pairs % n
        total = int(halves.sum())
        alive = np.bincount(passage, self.term_max[term], minlength=total) >= THRESHOLD - 1e-9
        passage, term = passage[alive[passage]], term[alive[passage]]
        # Block maxima of what is left.
        runs, owner = _expand(self.term_run[term], self.term_run[term + 1])
        spot_of = passage[owner] * self.blocks + self.run_key[runs] % self.blocks
        keys, where = np.unique(spot_of, return_inverse=True)
        open_ = np.bincount(where, self.run_max[runs], minlength=len(keys)) >= THRESHOLD - 1e-9
        runs, spot_of = runs[open_[where]], spot_of[open_[where]]
        # Full scores within the open blocks.
        posts, owner = _expand(self.run_at[runs], self.run_end[runs])
        full = (spot_of[owner] // self.blocks) * len(self.uids) + self.part[posts]
        keys, where = np.unique(full, return_inverse=True)
        score = np.bincount(where, self.weight[posts], minlength=len(keys))
        keep = score >= THRESHOLD - 1e-9
        best: dict[tuple[int, int], float] = {}
        doc_of = np.repeat(np.arange(len(size)), halves)
        for k, s in zip(keys[keep].tolist(), score[keep].tolist()):
            pair = int(doc_of[k // len(self.uids)]), k % len(self.uids)
            best[pair] = max(best.get(pair, 0.0), s)
        return [(d, p, s) for (d, p), s in best.items()]

    def hits(self, texts: list[str]) -> list[tuple[int, int | None, float, float, float]]:
        """(text, item_id, score, question overlap, answer overlap) of verified leaks, an item id once per text."""
        found = {}
        for d, uid, *x in self.found(texts):
            if x[1] is not None:
                key = d, self.items[uid]
                found[key] = max(found.get(key, tuple(x)), tuple(x))
        return [(d, item, *x) for (d, item), x in found.items()]

    def found(self, texts: list[str]) -> list[tuple[int, int, float, float | None, float | None]]:
        """(text, uid, score, question overlap, answer overlap) of verified leaks, an item once per text.

        A long item comes with its best score and without overlaps: they are still to be looked up.
        """
        words, at = _words(texts)
        if not len(words):
            return []
        best, sets, out = {}, {}, []
        for d, p, score in self._candidates(words, at):
            key = d, self.uids[p]
            best[key] = max(best.get(key, 0.0), score)
        for (d, uid), score in sorted(best.items()):
            if uid not in self.checks:
                out.append((d, uid, score, None, None))
                continue
            overlaps = []
            for k, s in self.checks[uid]:  # a half of fewer words than a shingle is looked up as a run of its own length
                if (d, k) not in sets:
                    sets = {**{x: y for x, y in sets.items() if x[0] == d}, (d, k): shingles(words[at[d]: at[d + 1]], k).view(np.int64)}
                overlaps.append(float(np.isin(s, sets[d, k]).mean()) if len(s) else 1.0)
            if min(overlaps) >= OVERLAP:
                out.append((d, uid, score, *overlaps))
        return out


def _expand(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and each position's range."""
    size = end - start
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + start[owner], owner


def indexes(items: DataFrame, index_parts: int = INDEX_PARTS, long_item: int = LONG_ITEM) -> Iterator[Index]:
    """The indexes of the benchmark's blocks, one after the other; inverse frequencies count all parts."""
    return _indexes(*_prepared(items), index_parts, long_item)


def _prepared(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items, numbered, and their halves: written tables."""
    numbered = written(items.select(F.monotonically_increasing_id().alias("uid"), "item_id", "text"), "benchmark-items")
    return numbered, written(_halves(numbered), "benchmark-halves")


def _indexes(numbered: DataFrame, halves: DataFrame, index_parts: int, long_item: int) -> Iterator[Index]:
    parts = written(_parts(numbered), "benchmark-parts")
    whole = parts.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.sum(F.size("words") + PART_COST).alias("cost")).first()
    if not whole["n"]:
        return
    blocks = -(-whole["cost"] // (index_parts * (PART_WORDS + PART_COST)))
    terms = parts.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # A short item's parts and shingles are in one block, a long one's parts in all.
    of_item = F.pmod(F.xxhash64("uid"), F.lit(blocks))
    block = F.when(F.col("item_words") > long_item, F.pmod(F.xxhash64("uid", "part"), F.lit(blocks))).otherwise(of_item)
    for b in range(blocks):
        mine = parts.where(block == b)
        rows = sorted((r.asDict() for r in mine.collect()), key=lambda r: (r["uid"], r["part"]))  # the words of about index_parts parts
        if rows:
            own = mine.select(F.explode(F.array_distinct("words")).alias("term")).distinct()
            n = whole["n"]
            idf = {r["term"]: float(np.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))) for r in terms.join(own, "term", "left_semi").collect()}
            checks: dict[int, list] = {}
            for r in sorted(halves.where((F.col("item_words") <= long_item) & (of_item == b)).collect(), key=lambda r: (r["uid"], r["half"])):  # no more words
                checks.setdefault(r["uid"], []).append((r["k"], np.array(r["shingles"], np.int64)))
            yield Index(rows, checks, idf, whole["mean"])


def _looked_up(keyed: DataFrame, open_: DataFrame, halves: DataFrame) -> DataFrame:
    """``open_`` (FOUND without overlaps) with the overlaps that reach ``OVERLAP``.

    The shingles of each document that retrieved a part meet those of the item on (item, half,
    shingle): in proportion to the documents, however long the item is.
    """
    pairs = open_.select("row_key", "uid").distinct()
    sizes = halves.select("uid", "half", "k", F.size("shingles").alias("n"))
    # A half without words asks for nothing and overlaps wholly.
    asked = pairs.join(sizes, "uid").where("n > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = _words(texts_of(batch))
            for i, (key, k) in enumerate(zip(batch.column("row_key").to_pylist(), batch.column("k").to_pylist())):
                s = shingles(words[at[i]: at[i + 1]], k) if at[i + 1] - at[i] >= k else words[:0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), key, np.int64)), pa.array(np.full(len(s), k, np.int32)), pa.array(s.view(np.int64))],
                                                 names=["row_key", "k", "shingle"])
    wanted = asked.select("row_key", "k").distinct()
    texts = keyed.select("row_key", "text").join(wanted, "row_key").dropDuplicates(["row_key", "k"])
    have = map_batches(texts, run, "row_key long, k int, shingle long")
    of_items = halves.select("uid", "half", "k", F.explode("shingles").alias("shingle"))
    common = (asked.join(have, ["row_key", "k"]).join(of_items, ["uid", "half", "k", "shingle"])
              .groupBy("row_key", "uid", "half").agg(F.count("*").alias("common")))
    shares = (pairs.join(sizes, "uid").join(common, ["row_key", "uid", "half"], "left")
              .withColumn("share", F.when(F.col("n") > 0, F.coalesce("common", F.lit(0)) / F.col("n")).otherwise(1.0))
              .groupBy("row_key", "uid").agg(F.max(F.when(F.col("half") == 0, F.col("share"))).alias("question_overlap"),
                                             F.max(F.when(F.col("half") == 1, F.col("share"))).alias("answer_overlap"))
              .where(F.least("question_overlap", "answer_overlap") >= OVERLAP))
    # A long item's parts lie in several blocks: its best score of all counts.
    return open_.drop("question_overlap", "answer_overlap").join(shares, ["row_key", "uid"])


def _found(keyed: DataFrame, index: Index, block: int) -> DataFrame:
    """What one block's index finds in the documents (row_key, doc_id, text), written."""
    sent = keyed.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("row_key").to_pylist(), batch.column("doc_id").to_pylist()
            rows = [(keys[d], ids[d], uid, sent.value.items[uid], *rest, block) for d, uid, *rest in sent.value.found(texts_of(batch))]
            columns = list(zip(*rows)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["row_key", "doc_id", "uid", "item_id", "score", "question_overlap", "answer_overlap", "block"])
    rows = written(map_batches(keyed, run, FOUND), "leaks")
    sent.destroy()
    return rows


def row_key():
    """Finds a document again in a second scan; equal rows share it, and every result."""
    return F.xxhash64("doc_id", "text")


def _hits(docs: DataFrame, numbered: DataFrame, halves: DataFrame, index_parts: int, long_item: int) -> DataFrame:
    """FOUND rows of all verified leaks, by document, item and block."""
    keyed = docs.select("doc_id", "text", row_key().alias("row_key"))
    found = [_found(keyed, index, b) for b, index in enumerate(_indexes(numbered, halves, index_parts, long_item))]
    if not found:
        return docs.sparkSession.createDataFrame([], FOUND)
    rows = reduce(DataFrame.unionByName, found)
    long_ = _long(halves, long_item)
    if long_.isEmpty():
        return rows
    looked_up = written(_looked_up(keyed, rows.where("question_overlap is null"), long_), "long-leaks")
    return rows.where("question_overlap is not null").unionByName(looked_up)


def _long(halves: DataFrame, long_item: int) -> DataFrame:
    return halves.where(F.col("item_words") > long_item)


def leaks(docs: DataFrame, items: DataFrame, index_parts: int = INDEX_PARTS, long_item: int = LONG_ITEM) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row per document and leaked item."""
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("x")
    # Equal documents come as often within each block; items of one id, and parts of a long item, may lie in several.
    each = (_hits(docs, *_prepared(items), index_parts, long_item)
            .groupBy("row_key", "doc_id", "item_id", "uid", "block").agg(best, F.count("*").alias("copies"))
            .groupBy("row_key", "doc_id", "item_id").agg(F.max("x").alias("x"), F.max("copies").alias("copies")))
    return each.select("doc_id", "item_id", "x.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def keep_clean(docs: DataFrame, items: DataFrame, index_parts: int = INDEX_PARTS, long_item: int = LONG_ITEM) -> DataFrame:
    """The documents without a leaked item, all columns as they were.

    Without long items no document is shuffled; else those found are taken out by a join.
    """
    numbered, halves = _prepared(items)
    if not _long(halves, long_item).isEmpty():
        leaked = _hits(docs, numbered, halves, index_parts, long_item).select("row_key").distinct()
        cols = docs.columns
        keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], row_key().alias("row_key"))
        return keyed.join(leaked, "row_key", "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
    for index in _indexes(numbered, halves, index_parts, long_item):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def clean(texts: list[str], sent=sent) -> np.ndarray:
            out = np.ones(len(texts), bool)
            out[[h[0] for h in sent.value.hits(texts)]] = False
            return out
        docs = filter_rows(docs, clean)
    return docs
