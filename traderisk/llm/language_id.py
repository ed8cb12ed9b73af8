"""Operator 9: language by nearest centroid.

Texts become normalised TF-IDF vectors of hashed letter pairs and triples (lower case; whatever
is no letter is white space).  Every language gets a few centroids by spherical k-means (seeded
k-means++, no cluster below ``LEAST_SHARE`` of its rows) over a bounded sample of its rows
(``sample`` per language); document frequencies count all training rows.  Rows of the sample that
lie nearest to another language's mean are taken for mislabelled and left out.

A text takes the language of the centroid nearest by cosine, and is rejected if even that is too
far away.  How far that is, is measured per language and length class on the half of the sample
that the centroids have not seen: the limit lies between the low cosines of the language's own
rows and the high cosines of the other languages' rows, and never above the former.

Rows: null text, or text without letters: ``und``, score 0, rejected.  A null lang or doc_id row is
never learned from.  Without training rows every text is ``und``; with a single language its own
rows alone set the limits.  Repeated rows score alike.  Texts above a million characters are counted
whole, in parts (the letter pairs and triples across the cuts, a few in a million, are not seen).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traderisk.llm.common import filter_rows, map_batches, texts_of, written

DIM = 4096
SAMPLE_PER_LANGUAGE = 2000  # expected rows of a language: half for its centroids, half for its limits
CLUSTERS = 4
LEAST_SHARE = 0.05  # of a language's rows, in every cluster
OWN_LOW, OTHERS_HIGH = 0.01, 0.99  # quantiles between which a limit lies
LEAST_MEASURED = 20  # rows that a limit needs
SPREADS = (0, 1, 2, 4)  # a class with too few takes those of the classes around it in, up to so many each side
LENGTH_CLASSES = 24
FEW_LANGUAGES = 10_000  # a table of so many sizes is broadcast
SEED = 9
UNDETERMINED = "und"


def fold(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts_of(texts: list[str], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram counts by bucket, number of letters) per text."""
    out, letters = np.zeros((len(texts), dim), np.float32), np.zeros(len(texts), np.int64)
    for first, group in _groups(texts):
        codes = np.frombuffer("".join(f" {t} " for t in group).encode("utf-32-le", "surrogatepass"), "<u4")
        doc = np.repeat(np.arange(first, first + len(group)), [len(t) + 2 for t in group])
        letter = _letters()[codes]
        c = np.where(letter, codes, 32).astype(np.uint32)
        pair = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
        triple = pair[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
        for gram, some in ((pair, letter[:-1] | letter[1:]), (triple, letter[1:-1])):
            gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            bucket = (gram >> np.uint32(20)).astype(np.int64) % dim
            mine = doc[: len(bucket)]
            key = ((mine - first) * dim + bucket)[some]
            out[first: first + len(group)] += np.bincount(key, minlength=len(group) * dim).reshape(len(group), dim)
        letters[first: first + len(group)] += np.bincount((doc - first)[letter], minlength=len(group))
    return out, letters


def _groups(texts: list[str], chars: int = 1 << 20):
    """(index of the first, texts) of about a million characters; a longer text comes in parts."""
    group, first, size = [], 0, 0
    for i, t in enumerate(texts):
        if group and size + len(t) > chars:
            yield first, group
            group, size = [], 0
        if not group:
            first = i
        if len(t) > chars:
            for at in range(0, len(t), chars):
                yield i, [t[at: at + chars].lower()]
            continue
        group.append(t.lower())
        size += len(t)
    if group:
        yield first, group


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def length_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), LENGTH_CLASSES - 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = SEED) -> np.ndarray:
    """At most k unit centroids by k-means++; clusters below LEAST_SHARE of the rows are given up."""
    draw = np.random.default_rng(seed)
    centre = x[[int(draw.integers(len(x)))]]
    while len(centre) < min(k, len(x)):
        far = np.clip(1 - (x @ centre.T).max(axis=1), 0, None) ** 2
        if far.sum() <= 0:
            break
        centre = np.concatenate([centre, x[[int(draw.choice(len(x), p=far / far.sum()))]]])
    for i in range(rounds):
        nearest = (x @ centre.T).argmax(axis=1)
        size = np.bincount(nearest, minlength=len(centre))
        # Rows of a cluster too small to mean anything join the others.
        centre = np.stack([x[nearest == j].sum(axis=0) for j in range(len(centre)) if size[j] >= max(1, LEAST_SHARE * len(x))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre


def _unpack(rows: pd.DataFrame, idf: np.ndarray) -> np.ndarray:
    return vectors(np.stack([np.frombuffer(c, np.float32) for c in rows["counts"]]), idf)


def fit(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, clusters: int = CLUSTERS) -> dict | None:
    """langs, centroids (with their languages), idf and the limits by language and length class; None without training rows."""
    spark = docs.sparkSession
    train = docs.where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(DIM, np.int64), 0
        for batch in batches:
            counts, _ = counts_of(texts_of(batch))
            seen += (counts > 0).sum(axis=0)
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.append(rows, seen))], names=["bucket", "n"])
    df = {r["bucket"]: r["n"] for r in map_batches(train.select("text"), frequencies, "bucket long, n long")
          .groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # DIM + 1 rows
    if not df.get(-1):
        return None
    idf = np.log((1 + df[-1]) / (1 + np.array([df[i] for i in range(DIM)], float))).astype(np.float32) + np.float32(1e-3)

    # The sample is chosen in the scan: no text is shuffled by its language.
    sizes = written(train.groupBy("lang").agg(F.count("*").alias("n")), "language-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= FEW_LANGUAGES else sizes
    million = 1_000_000
    chosen = (train.join(sizes, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < F.lit(sample) * million / F.col("n"))
              .select("lang", "text", (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0).alias("held")))

    def tf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, letters = counts_of(texts_of(batch))
            out = pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("held"), pa.array([c.tobytes() for c in counts], pa.binary()),
                                              pa.array(letters)], names=["lang", "held", "counts", "letters"])
            yield out.filter(pa.array(letters > 0))
    rows = written(map_batches(chosen, tf, "lang string, held boolean, counts binary, letters long"), "language-vectors")

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        total = _unpack(rows, idf).sum(axis=0)
        return pd.DataFrame([(rows["lang"].iloc[0], (total / max(1e-12, np.linalg.norm(total))).astype(np.float32).tobytes())], columns=["lang", "centroid"])
    fitting = rows.where("not held")
    found = sorted(fitting.groupBy("lang").applyInPandas(mean, "lang string, centroid binary").collect(), key=lambda r: r["lang"])  # a row per language
    if not found:
        return None
    langs = [r["lang"] for r in found]
    means = np.stack([np.frombuffer(r["centroid"], np.float32) for r in found])

    def centroids(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["letters", "counts"])
        x, lang = _unpack(rows, idf), rows["lang"].iloc[0]
        own = (x @ means.T).argmax(axis=1) == langs.index(lang)
        centre = spherical_kmeans(x[own] if own.any() else x, clusters)
        return pd.DataFrame([(lang, c.astype(np.float32).tobytes()) for c in centre], columns=["lang", "centroid"])
    found = sorted(fitting.groupBy("lang").applyInPandas(centroids, "lang string, centroid binary").collect(),
                   key=lambda r: (r["lang"], r["centroid"]))  # a few rows per language
    centre = np.stack([np.frombuffer(r["centroid"], np.float32) for r in found])
    of = np.array([langs.index(r["lang"]) for r in found])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per row and language: own or not, length class, cosine to the language's nearest centroid."""
        for batch in batches:
            x = vectors(np.stack([np.frombuffer(c, np.float32) for c in batch.column("counts").to_pylist()] or [np.zeros(DIM, np.float32)]), idf)[: batch.num_rows]
            cosine = x @ centre.T
            best = np.stack([cosine[:, of == j].max(axis=1, initial=0.0) for j in range(len(langs))], axis=1)
            mine = np.array([langs.index(v) if v in langs else -1 for v in batch.column("lang").to_pylist()], int)
            straight = (x @ means.T).argmax(axis=1) == mine  # else mislabelled
            own = np.arange(len(langs)) == mine[:, None]
            size = np.repeat(length_class(batch.column("letters").to_numpy())[:, None], len(langs), axis=1)
            which = np.broadcast_to(np.arange(len(langs)), own.shape)
            yield pa.RecordBatch.from_arrays([pa.array(a[straight].ravel()) for a in (which, own, size, best.astype(float))],
                                             names=["lang", "own", "class", "cosine"])
    scale = map_batches(rows.where("held").select("lang", "counts", "letters"), measured, "lang long, own boolean, class long, cosine double")
    around = F.explode(F.array(*[F.struct(F.lit(k).alias("spread"), (F.col("class") + d).alias("class"))
                                 for k in SPREADS for d in range(-k, k + 1)]))
    spread = scale.select("lang", "own", "cosine", around.alias("x")).select("lang", "own", "cosine", "x.*")
    ranges = {(r["lang"], r["spread"], r["class"]): r for r in spread.groupBy("lang", "spread", "class").agg(
        F.count_if("own").alias("n"), F.count_if(~F.col("own")).alias("others"),
        F.percentile(F.when(F.col("own"), F.col("cosine")), F.lit(OWN_LOW)).alias("low"),
        F.percentile(F.when(~F.col("own"), F.col("cosine")), F.lit(OTHERS_HIGH)).alias("high")).collect()}  # rows by language and class
    limits = np.zeros((len(langs), LENGTH_CLASSES))  # 0, nothing rejected, where no spread finds enough rows
    for j in range(len(langs)):
        for c in range(LENGTH_CLASSES):
            enough = [r for k in SPREADS if (r := ranges.get((j, k, c))) is not None and r["n"] >= LEAST_MEASURED]
            if enough:
                r = enough[0]
                limits[j, c] = r["low"] if not r["others"] or r["high"] >= r["low"] else (r["low"] + r["high"]) / 2
    return {"langs": [langs[j] for j in of], "of": of, "centroids": centre, "idf": idf, "limits": limits}


def judge(texts: list[str], model: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, cosine, rejected) per text."""
    lang, score, rejected = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.ones(len(texts), bool)
    if model and texts:
        counts, letters = counts_of(texts)
        cosine = vectors(counts, model["idf"]) @ model["centroids"].T
        best, has = cosine.argmax(axis=1), letters > 0
        lang[has] = np.array(model["langs"], object)[best[has]]
        score[has] = np.clip(cosine[has, best[has]], 0.0, 1.0)
        rejected[has] = score[has] < model["limits"][model["of"][best[has]], length_class(letters[has])]
    return lang, score, rejected


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = judge(texts_of(batch), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                                             names=["doc_id", "lang_pred", "score", "rejected"])
    scored = map_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, all columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))
    return filter_rows(docs, lambda texts: ~judge(texts, sent.value)[2])
