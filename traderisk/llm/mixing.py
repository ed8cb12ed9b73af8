"""Operator 12: mixing sources to target weights, DataFrame functions only.

Capped water-filling: the words of the mix are shared out by source weight; a source whose share is
above ``epochs`` times its size is clamped there, and what is over is shared again by weight among
the others, until no share is above.  Each round is one aggregate over the sources, of which the
driver sees two sums; weights and sizes are whole numbers, so every round is exact.

A source's target, rounded to whole words, is made of whole repetitions of all its documents and
of one fractional repetition: its documents in the order of a seeded hash until the words that
are left are reached, the last one in part.  The order is cut without sorting the source: words
are summed per source and hash range (``RANGES``), and only the range in which the words run out is
put in order.

Rows: a null text has no words; null sources are one source, the last; ids may be null or repeat:
the hash is of id and text, and rows equal in both are interchangeable.  Without words, or
without rows, nothing is taken.  Very long texts are counted whole.  Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traderisk.llm.common import written
from traderisk.llm.order import numbered

WEIGHTS = (5, 2, 1)
SHARE = 150  # per cent of all words
EPOCHS = 2
SEED = 12
RANGE_DIGITS = 3  # hex digits: 4096 hash ranges a source
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size in words and the seeded hash of every document."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    return written(docs.select("doc_id", "source", words.alias("size"), drawn.alias("drawn")), "mix-sizes")


def water_level(sources: DataFrame, budget: float) -> float:
    """The words per unit of weight at which the shares of ``sources`` (weight, cap) reach ``budget``."""
    level, clamped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        row = sources.agg(F.sum(F.when(above, F.col("cap"))).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("open"),
                          F.count_if(above).alias("clamped")).first()
        if row["clamped"] == clamped or not row["open"]:
            return level
        level = (budget - (row["full"] or 0)) / row["open"]
        clamped = row["clamped"]


def targets(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target, and whole (repetitions) and rest (words of one more) that make it up."""
    totals = documents.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = numbered(totals, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = written(ordered.select("source", "source_size", weight.cast("long").alias("weight"),
                                     (F.col("source_size") * epochs).alias("cap")), "mix-sources")
    all_words = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, all_words * share / 100)
    given = F.col("weight") * F.lit(level)
    target = F.when(given > F.col("cap"), F.col("cap").cast("double")).otherwise(given)
    owed = F.least(F.floor(target + 0.5).cast("long"), F.col("cap"))
    size = F.greatest("source_size", F.lit(1).cast("long"))
    return sources.select("source", "source_size", target.alias("target"),
                          F.floor(owed / size).cast("long").alias("whole"), (owed % size).alias("rest"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repetitions counted) of every document."""
    documents = sizes(docs, seed)
    plan = targets(documents, weights, share, epochs)
    # Where in the hash order a source's fractional repetition ends.
    hash_range = F.substring("drawn", 1, RANGE_DIGITS)
    ranges = documents.groupBy("source", hash_range.alias("range")).agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ended = (ranges.withColumn("before", F.coalesce(before, F.lit(0).cast("long")))
             .join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
             .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
             .select("of", "range", (F.col("rest") - F.col("before")).alias("left")))
    cuts = written(plan.join(ended, plan["source"].eqNullSafe(ended["of"]), "left").drop("of"), "mix-plan")  # a row per source

    rows = documents.join(cuts.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    inside = F.coalesce(hash_range == F.col("range"), F.lit(False))
    drawn = F.when(hash_range < F.col("range"), F.col("size")).otherwise(F.lit(0).cast("long"))
    last = Window.partitionBy("source").orderBy("drawn", "size").rowsBetween(Window.unboundedPreceding, -1)
    taken_before = F.coalesce(F.sum("size").over(last), F.lit(0).cast("long"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("left") - taken_before))

    def result(of: DataFrame, once: Column) -> DataFrame:
        return of.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + once).alias("taken"))
    return result(rows.where(~inside), drawn).unionByName(result(rows.where(inside), part))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5('12:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS drawn FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s AS (SELECT source, source_size, 2 * source_size AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM g),
b AS (SELECT sum(source_size)::DOUBLE * 150 / 100 AS budget FROM s),
w AS (
  SELECT 0::DOUBLE AS level, -1::BIGINT AS clamped, 0 AS round
  UNION ALL
  SELECT (b.budget - coalesce(sum(s.cap) FILTER (s.weight * w.level > s.cap), 0)::DOUBLE) / (sum(s.weight) FILTER (s.weight * w.level <= s.cap))::DOUBLE,
         count(*) FILTER (s.weight * w.level > s.cap), w.round + 1
  FROM w, s, b GROUP BY w.level, w.clamped, w.round, b.budget
  HAVING count(*) FILTER (s.weight * w.level > s.cap) <> w.clamped AND sum(s.weight) FILTER (s.weight * w.level <= s.cap) > 0),
v AS (SELECT level FROM w ORDER BY round DESC LIMIT 1),
t AS (SELECT source, source_size, cap, CASE WHEN weight * level > cap THEN cap::DOUBLE ELSE weight * level END AS target FROM s, v),
o AS (SELECT *, least(floor(target + 0.5)::BIGINT, cap) // greatest(source_size, 1) AS whole,
             least(floor(target + 0.5)::BIGINT, cap) % greatest(source_size, 1) AS rest FROM t),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY drawn, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT c.doc_id, c.size, o.source_size, o.target,
       (o.whole * c.size + greatest(0, least(c.size, o.rest - c.before)))::BIGINT AS taken
FROM c JOIN o ON c.source IS NOT DISTINCT FROM o.source
"""
