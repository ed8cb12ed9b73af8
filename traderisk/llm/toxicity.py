"""Operator 10: toxicity by class-conditional Kneser-Ney models.

Two word-pair models, one of toxic and one of ordinary text, share their last backoff: how many
different words a word follows anywhere in the corpus, counted exactly over *all* documents
(distinct word pairs by 64-bit hash, then their number by word).  Counts are
numbers of texts, so one text that repeats a word teaches it once.  A word or pair whose class
counts do not differ beyond ``SIGNIFICANT`` standard deviations of chance takes the counts of both
classes together: a rare expression is evidence for neither.  A text's evidence is the mean
over its distinct word pairs of log P(word | previous, toxic) - log P(word | previous, ordinary);
a logistic curve over that mean and the text's length turns it into a score.

Class counts come from a bounded sample of labelled rows (``TRAIN_ROWS``, each text once), three
quarters of it (a text under several labels is toxic if one of them says so); the last quarter, unseen by the counts, fits the curve.  The model holds the words
of that sample that differ, alone or in a pair, and what the corpus says of them; all other words have
the same probability in both classes, so of them only the number of pairs is needed.  Pair counts are hashed to 2**PAIR_BITS cells.

Rows: empty or null texts score the sample's toxic share; without labelled rows of both classes
all score that share (0 without any).  Null doc_ids and null labels are never learned from.  A
repeated row or doc_id is scored each time and teaches each of its texts once.  Texts of any length
are read whole; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traderisk.llm.common import filter_rows, map_batches, texts_of, written
from traderisk.llm.language_id import fold
from traderisk.llm.textkernels import mix, word_hashes

TRAIN_ROWS = 20_000
PAIR_BITS = 21
HELD_PAIRS = 1 << 21  # word pairs a task holds before it gives out the distinct ones
BUCKETS, BUCKET_SHIFT = 1 << 12, np.uint64(52)  # ranges of pair hashes
DISCOUNT = 0.75
SIGNIFICANT = 3.5
START = np.uint64(0x5BD1E995)
SCHEMA = "kind int, key long, n long"
TOXIC, ORDINARY = 1, 0


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, previous word's hash, text number, words per text)."""
    words, at = word_hashes(texts, words="alnum", fold="unicode")
    size = np.diff(at)
    before = np.concatenate([[START], words[:-1]]) if len(words) else words
    before[at[:-1][size > 0]] = START
    return words, before, np.repeat(np.arange(len(texts)), size), size


def _distinct(words: np.ndarray, before: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, pair cell, text) of the distinct pairs of each text."""
    pairs = _cell(_pair(before, words))
    _, first = np.unique((text << PAIR_BITS) + pairs, return_index=True)
    return words[first], before[first], pairs[first], text[first]


def _pair(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(3) + words)


def _cell(pairs: np.ndarray) -> np.ndarray:
    return (pairs & np.uint64((1 << PAIR_BITS) - 1)).astype(np.int64)


def _at(vocabulary: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of each word in the sorted vocabulary; its length for a word that is not there."""
    if not len(vocabulary):
        return np.zeros(len(words), np.int64)
    at = np.searchsorted(vocabulary, words)
    return np.where(vocabulary[np.minimum(at, len(vocabulary) - 1)] == words, at, len(vocabulary))


def _rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))],
                                      names=["kind", "key", "n"])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by word and class (kinds 0 and 1; START counts the texts with words), by pair and class (2 and 3)."""
    for batch in batches:
        words, before, text, _ = _words(texts_of(batch))
        label = batch.column("toxic").to_numpy(zero_copy_only=False).astype(int)
        vocabulary, at = np.unique(np.concatenate([words, before[before == START]]), return_inverse=True)
        once = np.unique(np.concatenate([text, text[before == START]]) * len(vocabulary) + at)
        of, once = np.divmod(once, max(1, len(vocabulary)))
        _, _, p, t = _distinct(words, before, text)
        for c in (ORDINARY, TOXIC):
            yield _rows(c, *np.unique(vocabulary[once[label[of] == c]], return_counts=True))
            yield _rows(2 + c, *np.unique(p[label[t] == c], return_counts=True))


def _telling(batches: Iterator[pa.RecordBatch], cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Context and word of the pairs in telling cells (sorted)."""
    for batch in batches:
        words, before, _, _ = _words(texts_of(batch))
        pair = _pair(before, words)
        _, first = np.unique(pair, return_index=True)
        first = first[_at(cells, _cell(pair[first])) < len(cells)]
        yield pa.RecordBatch.from_arrays([pa.array(before[first].view(np.int64)), pa.array(words[first].view(np.int64))], names=["before", "word"])


def _followers(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Class, context (its index) and pair of every pair whose context is in the vocabulary."""
    for batch in batches:
        words, before, text, _ = _words(texts_of(batch))
        label = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int32)[text]
        at, pair = _at(vocabulary, before), _pair(before, words)
        for c in (ORDINARY, TOXIC):
            mine = np.flatnonzero((label == c) & (at < len(vocabulary)))
            found, first = np.unique(pair[mine], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), c, np.int32)), pa.array(at[mine][first]), pa.array(found.view(np.int64))],
                                             names=["toxic", "at", "pair"])


def _packed(pair: np.ndarray, word: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, n, packed) of sorted distinct pairs and their words: differences of the pairs
    by byte position, what is above the five low bytes (which are as good as random) deflated."""
    cut = np.searchsorted(pair, np.arange(BUCKETS + 1, dtype=np.uint64) << BUCKET_SHIFT) if len(pair) else np.zeros(BUCKETS + 1, np.int64)
    cut[-1] = len(pair)
    rows = []
    for bucket in np.flatnonzero(np.diff(cut)):
        one = slice(cut[bucket], cut[bucket + 1])
        step = np.diff(pair[one], prepend=np.uint64(bucket) << BUCKET_SHIFT)
        planes = step.view(np.uint8).reshape(-1, 8).T
        rows.append((int(bucket), len(step), planes[:5].tobytes() + zlib.compress(planes[5:].tobytes() + word[one].view(np.uint8).reshape(-1, 4).T.tobytes(), 1)))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "n", "packed"])


def _unpacked(bucket: int, n: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(packed[: 5 * n] + zlib.decompress(packed[5 * n:]), np.uint8)
    step = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(step, dtype=np.uint64) + (np.uint64(bucket) << BUCKET_SHIFT), np.ascontiguousarray(planes[8 * n:].reshape(4, n).T).view(np.int32).ravel()


def continuations(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """(different contexts of each word of the vocabulary, distinct pairs of all words) over all texts.

    Tasks give out distinct pairs by ranges of their hash (``BUCKETS``), so equal pairs meet in one
    bucket, whatever their word, and a frequent word is spread over all."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def distinct_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, word = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        new, size = [], 0
        for batch in batches:
            words, before, _, _ = _words(texts_of(batch))
            found, first = np.unique(_pair(before, words), return_index=True)
            new.append((found, _at(sent.value, words[first]).astype(np.int32)))
            size += len(found)
            if len(pair) + size > HELD_PAIRS:
                pair, word, new, size = *_merged([(pair, word), *new]), [], 0
                if len(pair) > HELD_PAIRS // 2:
                    yield from _packed(pair, word)
                    pair, word = pair[:0], word[:0]
        yield from _packed(*_merged([(pair, word), *new]))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(sent.value) + 1, np.int64)
        held, at = [], -1
        for batch in batches:
            for bucket, size, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "packed"))):
                if bucket != at and held:
                    n += np.bincount(_merged(held)[1], minlength=len(n))
                    held = []
                at = bucket
                held.append(_unpacked(bucket, size, packed))
                # Copies from other tasks are merged away as they come.
                if len(held) > 1 and sum(len(p) for p, _ in held[1:]) > max(HELD_PAIRS, len(held[0][0])):
                    held = [_merged(held)]
        if held:
            n += np.bincount(_merged(held)[1], minlength=len(n))
        word = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n[word])], names=["word", "n"])
    packed = map_batches(docs.select("text"), distinct_pairs, "bucket int, n int, packed binary")
    table = _collected(map_batches(packed.repartition("bucket").sortWithinPartitions("bucket"), counted, "word long, n long")
                       .groupBy("word").agg(F.sum("n").alias("n")), sent)  # a row per word of the vocabulary, one for all others
    out = np.zeros(len(vocabulary) + 1, np.int64)
    out[table.column("word").to_numpy()] = table.column("n").to_numpy()
    return out[:-1], int(out.sum())


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, sorted, and their words."""
    found, first = np.unique(np.concatenate([p for p, _ in parts]), return_index=True)
    return found, np.concatenate([w for _, w in parts])[first]


def _collected(df: DataFrame, sent=None) -> pa.Table:
    """A small result at the driver; the broadcast that its tasks read is given back."""
    table = df.toArrow()
    if sent is not None:
        sent.destroy()
    return table


def _differs(n: Column, toxic: Column, share: dict) -> Column:
    """Whether a class count differs by more than chance would let it: ``n`` in both classes, ``toxic`` of them in one."""
    expected = n * F.lit(share[TOXIC])
    return F.abs(toxic - expected) > SIGNIFICANT * F.sqrt(F.greatest(expected, F.lit(1.0)) * F.lit(share[ORDINARY]))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """The model: the telling pair cells and the words they need, as sorted arrays, and the curve.

    Counts stay in Spark; the driver sees totals, and of cells and words only those that differ.
    """
    spark = docs.sparkSession
    known = labels.where((fold() != 0) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    taken = known.orderBy(F.xxhash64("doc_id"), "toxic").limit(train_rows)  # the sample: at most train_rows rows of two numbers
    curve = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(4)) == 0
    sample = written(docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").select("text", "toxic", curve.alias("curve"))
                     .groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("curve").alias("curve")), "toxicity-sample")
    shares = {(r["curve"], r["toxic"]): r["n"] for r in sample.groupBy("curve", "toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    model = {"prior": sum(n for (_, t), n in shares.items() if t == 1) / total if total else 0.0, "curve": None}
    if not (shares.get((False, 1)) and shares.get((False, 0))):
        return model
    learned = sample.where("not curve").select("text", "toxic")
    of = [F.sum(F.when(F.col("kind") % 2 == c, F.col("n")).otherwise(0)).alias(name) for c, name in ((ORDINARY, "ordinary"), (TOXIC, "toxic"))]
    counts = written(map_batches(learned, _classes, SCHEMA).groupBy((F.col("kind") >= 2).alias("pair"), "key").agg(*of), "toxicity-counts")
    start = F.col("key") == int(START)
    sums = {r["pair"]: r for r in counts.where(~(start & ~F.col("pair"))).groupBy("pair").agg(
        F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"),
        F.count_if(F.col("ordinary") > 0).alias("words0"), F.count_if(F.col("toxic") > 0).alias("words1")).collect()}
    if False not in sums:  # no text with a word
        return model
    both = F.col("ordinary") + F.col("toxic")
    share = {pair: {ORDINARY: r["ordinary"] / max(1, r["ordinary"] + r["toxic"]), TOXIC: r["toxic"] / max(1, r["ordinary"] + r["toxic"])}
             for pair, r in sums.items()}
    size = np.array([sums[False]["ordinary"], sums[False]["toxic"]], float)
    if not size.all():  # a class without any word
        return model
    discounted = DISCOUNT * (sums[False]["words0"] + sums[False]["words1"]) / size.sum()
    # Every word ends a pair, so there are pair counts where there are word counts.
    cells = _collected(counts.where(F.col("pair") & _differs(both, F.col("toxic"), share[True])).select("key", "ordinary", "toxic").orderBy("key"))
    # Only these words tell the classes apart: those that differ themselves, or in a pair, and the contexts of such pairs.
    masks = spark.sparkContext.broadcast(cells.column("key").to_numpy())
    words = counts.where(~F.col("pair")).select("key", "ordinary", "toxic", _differs(both, F.col("toxic"), share[False]).alias("own"))
    pairs = map_batches(learned.select("text"), lambda batches: _telling(batches, masks.value), "before long, word long").distinct()
    used = (words.where("own").select("key").union(pairs.select("before")).union(pairs.select("word"))
            .union(spark.createDataFrame([(int(START),)], "key long")).distinct())
    found = _collected(used.join(words, "key", "left").select("key", "ordinary", "toxic", "own"), masks)
    vocabulary = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary = vocabulary[order]
    own = found.column("own").fill_null(False).to_numpy()[order]
    words = np.stack([found.column(c).fill_null(0).to_numpy()[order] for c in ("ordinary", "toxic")]).astype(float)
    keys = spark.sparkContext.broadcast(vocabulary)
    table = _collected(map_batches(learned, lambda batches: _followers(batches, keys.value), "toxic int, at long, pair long").distinct()
                       .groupBy("toxic", "at").agg(F.count("*").alias("n")), keys)  # words of the vocabulary
    label, at, different = (table.column(c).to_numpy() for c in ("toxic", "at", "n"))
    contexts, total = continuations(docs, vocabulary)
    model |= {"vocabulary": vocabulary, "shared": contexts / max(1, total), "cells": cells.column("key").to_numpy().copy()}
    back = discounted * model["shared"]
    for c, name in ((ORDINARY, "ordinary"), (TOXIC, "toxic")):
        followers = np.zeros(len(vocabulary))
        followers[at[label == c]] = different[label == c]
        alone = np.where(own, np.maximum(words[c] - DISCOUNT, 0) / size[c], np.maximum(words.sum(axis=0) - DISCOUNT, 0) / size.sum()) + back
        left = np.clip(DISCOUNT * followers / np.maximum(words[c], 1), 0.05, 1.0)  # a context's mass for the backoff
        model[c] = {"alone": alone.astype(np.float32), "context": np.maximum(words[c], 1).astype(np.float32),
                    "left": left.astype(np.float32), "pairs": np.append(cells.column(name).to_numpy(), 0).astype(np.float32)}
    sent = spark.sparkContext.broadcast(model)

    def evidence_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean, size = evidence(texts_of(batch), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(mean), pa.array(size)], names=["toxic", "mean", "size"])
    held = sample.where("curve") if shares.get((True, 1)) and shares.get((True, 0)) else sample
    rows = _collected(map_batches(held.select("text", "toxic"), evidence_of, "toxic int, mean double, size long"), sent)  # at most train_rows rows
    y, mean, size = (rows.column(c).to_numpy() for c in ("toxic", "mean", "size"))
    model["curve"] = _logistic(_features(mean, size)[size > 0], y[size > 0])
    return model


def evidence(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(length-normalised log-likelihood ratio, number of distinct word pairs) per text."""
    words, before, text, _ = _words(texts)
    w, v, p, t = _distinct(words, before, text)
    size = np.bincount(t, minlength=len(texts))
    w, v = _at(model["vocabulary"], w), _at(model["vocabulary"], v)
    known = (w < len(model["vocabulary"])) & (v < len(model["vocabulary"]))
    single = w < len(model["vocabulary"])  # a word beyond the vocabulary is as likely in both classes
    w, v, p, t = w[single], np.where(known, v, 0)[single], p[single], t[single]
    cell = _at(model["cells"], p)
    telling = (cell < len(model["cells"])) & known[single]
    ratio = np.zeros(len(w))
    for c, sign in ((TOXIC, 1.0), (ORDINARY, -1.0)):
        m = model[c]
        alone = m["alone"][w]
        pair = np.maximum(m["pairs"][cell] - DISCOUNT, 0) / m["context"][v] + m["left"][v] * alone
        ratio += sign * np.log(np.where(telling, pair, alone))
    return np.bincount(t, ratio, minlength=len(texts)) / np.maximum(size, 1), size.astype(np.int64)


def _features(mean: np.ndarray, size: np.ndarray) -> np.ndarray:
    root = np.sqrt(np.maximum(size, 1))
    return np.stack([np.ones(len(mean)), mean * 10, mean * root], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Logistic regression by damped Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - y) + ridge * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), grad)
        beta -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def scores(texts: list[str], model: dict) -> np.ndarray:
    if model["curve"] is None:
        return np.full(len(texts), model["prior"])
    mean, size = evidence(texts, model)
    p = 1 / (1 + np.exp(-np.clip(_features(mean, size) @ model["curve"], -30, 30)))
    return np.where(size > 0, p, model["prior"])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(texts_of(batch), sent.value))], names=["doc_id", "score"])
    scored = written(map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double"), "toxicity-scores")
    sent.destroy()
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, all columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return filter_rows(docs, lambda texts: scores(texts, sent.value) < 0.5)
