"""Operator 6: quality rules, DataFrame functions only.

Base rules look at one text.  The method looks across documents: normalised lines (lower case,
letters and digits, single spaces) are hashed, and a line is boilerplate of its host (the
``source``) when more than ``line_limit`` distinct documents of that host have it (a document
that repeats it counts once, copies of a document count each).  Such lines are taken out; a
document that loses more than ``max_removed`` per cent of its line characters is depleted and not
kept.

Documents per line are counted map-side first, so a line that all documents have is one small row a
task.  The lines of the documents meet the boilerplate lines in a broadcast join while those are
few (``FEW_LINES``, checked), else in a join salted by document: either way no task gets all
documents of one line.

Rows: a null text is the empty text (no words: the base rules fail it); a null source is a host
like any other; repeated rows and ids get a result each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traderisk.llm.common import written

LINE_LIMIT = 20
MAX_REMOVED = 50
FEW_LINES = 500_000  # boilerplate lines (a number each) that are broadcast
SALTS = 64
SPACE = r"[\x20\x09-\x0D]+"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with value worked out once."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: str) -> Column:
    """Words of the array that lie in a three-word window found at least twice.

    Windows are sorted by hash, equal neighbours marked, and their places merged: n log n, no
    pairwise comparison.
    """
    w = F.col(words)
    windows = F.when(F.size(w) >= 3, F.sort_array(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))))

    def repeated(s: Column) -> Column:
        marked = F.transform(s, lambda x, j: F.when(
            (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    return F.coalesce(_bound(windows, lambda s: _bound(repeated(s), covered)), F.lit(0)).cast("long")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, host, lines (hash and length of each normalised line), and the counts."""
    texts = docs.select("doc_id", F.col("source").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    split = texts.select(
        "doc_id", "host", "text",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    plain = F.transform("lines", lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " ")))
    return split.select(
        "doc_id", "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(without(F.col("text"), " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), "#*$%&|<>"))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words("words").alias("n_repeat_words"),
        F.transform(F.filter(plain, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("line"), F.length(x).alias("chars"))).alias("lines"))


def quality(docs: DataFrame, line_limit: int = LINE_LIMIT, max_removed: int = MAX_REMOVED) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept, line_chars, removed_chars."""
    base = written(base_counts(docs).withColumn("row", F.monotonically_increasing_id()), "quality-base")
    host = F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))  # a null host is one, and no key is null
    # Hosts are numbered by hash only to make narrow keys; the line's own hash spreads a hot host.
    keyed = base.select("row", F.transform("lines", lambda x: F.struct(F.xxhash64(host, x["line"]).alias("key"), x["chars"].alias("chars"))).alias("lines"))
    once = keyed.select(F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key"))
    often = written(once.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > line_limit).select("key"), "quality-lines")
    lines = keyed.select("row", F.explode("lines").alias("x")).select("row", "x.*")
    if often.count() <= FEW_LINES:
        found = lines.join(F.broadcast(often), "key")
    else:
        salted = often.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        found = lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    removed = found.groupBy("row").agg(F.sum("chars").cast("long").alias("removed_chars"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    return (base.withColumn("line_chars", total).drop("lines").join(removed, "row", "left")
            .withColumn("removed_chars", F.coalesce("removed_chars", F.lit(0).cast("long")))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
                    (~base_failed & (100 * F.col("removed_chars") <= max_removed * F.col("line_chars"))).alias("kept"),
                    "line_chars", "removed_chars"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, [x FOR x IN string_split_regex(text, '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
p AS (SELECT r, count(DISTINCT i + o) AS n FROM c, (VALUES (0), (1), (2)) AS t(o) WHERE n >= 2 GROUP BY r),
l AS (SELECT r, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
x AS (SELECT r, trim(regexp_replace(lower(unnest(ls)), '[^\p{L}\p{N}]+', ' ', 'g')) AS line FROM l),
y AS (SELECT d.r, d.source, x.line FROM x JOIN d USING (r) WHERE x.line <> ''),
h AS (SELECT source, line FROM y GROUP BY source, line HAVING count(DISTINCT r) > 20),
z AS (SELECT y.r, sum(length(y.line)) AS line_chars, sum(CASE WHEN h.line IS NOT NULL THEN length(y.line) ELSE 0 END) AS removed_chars
      FROM y LEFT JOIN h ON y.line = h.line AND y.source IS NOT DISTINCT FROM h.source GROUP BY y.r),
b AS (SELECT d.doc_id, len(w.ws)::BIGINT AS n_words,
        length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(l.ls) - len(list_distinct(l.ls)))::BIGINT AS n_dup_lines,
        coalesce(p.n, 0)::BIGINT AS n_repeat_words,
        coalesce(z.line_chars, 0)::BIGINT AS line_chars, coalesce(z.removed_chars, 0)::BIGINT AS removed_chars
      FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN p USING (r) LEFT JOIN z USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * removed_chars <= 50 * line_chars) AS kept,
  line_chars, removed_chars
FROM b
"""
