"""Operator 3: URL filter: host and path rules, then a logistic regression on hashed n-grams.

A rule ``host/path`` fits its host and all subdomains if the url's path starts with the rule's
path; the longest fitting rule decides.  Other urls go to a logistic regression on hashed
character n-grams (three to five) of host and path, trained from a small labelled table of urls.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there
up to ``?``, ``#`` or the end.  A null url, or one without ``://``, has both empty and is judged
by the model on empty features, its intercept.  Repeated urls are judged alike.  Urls of any length
are read whole; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
RIDGE = 0.001
SEPARATOR = "\x00"  # between host and path; in no url

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

# The labelled table is an input of ``judge``; this one is made by rule from plain lists: the words that
# unwanted sites of the public web trade in, words that go with any shop, wanted or not, and words of
# ordinary sites.  No name of any table to be judged is taken into it.
TOPICS = ["casino", "poker", "slots", "roulette", "blackjack", "betting", "bets", "bookie", "jackpot", "lottery", "sweepstakes", "pills",
          "viagra", "steroids", "diet", "adult", "xxx", "porn", "cams", "escorts", "hookup", "singles", "payday", "loans", "forex",
          "replica", "rolex", "spam", "ads", "adserver", "popup", "banner", "clickbait", "tracker", "malware", "warez", "keygen", "cracked",
          "torrents", "doubler", "giveaway", "backlinks"]
COMMON = ["best", "free", "cheap", "online", "live", "win", "big", "top", "easy", "fast", "lucky", "royal", "vip", "club", "zone", "world",
          "hub", "shop", "store", "deals", "now", "today", "farm", "x", "24", "365", "track", "pro", "max", "king", "star", "city", "plus"]
ORDINARY = ["library", "university", "news", "weather", "museum", "science", "garden", "recipes", "history", "travel", "health", "council",
            "theatre", "language", "music", "school", "archive", "journal", "software", "maps", "river", "forest", "village", "church",
            "football", "cycling", "bakery", "hotel", "hospital", "physics", "biology", "poetry", "radio", "gazette", "railway", "harbour",
            "insurance", "lawyers", "architects", "carpenter", "dentist", "vets", "coffee", "wine", "books", "films", "gallery", "orchestra",
            "students", "research", "energy", "water", "forum", "wiki", "docs", "blog", "photos", "kitchen", "furniture", "bikes", "cars",
            "boats", "farming", "teachers", "parents", "camping", "mountain", "island", "beach", "castle"]
ONSETS = ["b", "br", "c", "d", "dr", "f", "g", "gr", "h", "j", "k", "l", "m", "n", "p", "pr", "r", "s", "st", "t", "tr", "v", "w", "z", ""]
VOWELS = ["a", "e", "i", "o", "u", "ai", "ea", "ou"]
CODAS = ["", "", "n", "r", "s", "l", "t", "nd", "rt", "ng", "m", "ck"]
PREFIXES = ("", "", "www.", "blog.", "m.", "shop.", "en.", "news.")
ENDINGS = ("com", "org", "net", "info", "io", "eu", "edu", "co.uk", "de", "fr", "es", "biz", "xyz", "example.com", "example.org", "example.net")
PATHS = ("", "/", "/{n}", "/en/{n}", "/de/{n}", "/fr/{n}", "/es/{n}", "/about", "/article/{n}", "/index.html", "/p/{n}?id={n}", "/a/b")
UNWANTED_SITES, WANTED_SITES, URLS_PER_SITE = 1500, 4000, 1


def site_names(unwanted: int = UNWANTED_SITES, wanted: int = WANTED_SITES, seed: int = 3) -> list[tuple[str, float]]:
    """(site name, label: 1 unwanted), drawn with a fixed seed; names of either kind are one to three words."""
    draw = random.Random(seed)

    def invented() -> str:
        return "".join(draw.choice(ONSETS) + draw.choice(VOWELS) + draw.choice(CODAS) for _ in range(draw.randint(2, 4)))

    def joined(words: list[str]) -> str:
        draw.shuffle(words)
        return draw.choice(["-", "-", ""]).join(words)
    out = [(joined([topic, *draw.choice([[], [draw.choice(COMMON)], [draw.choice(COMMON)], [draw.choice(TOPICS)]])]), 1.0)
           for topic in (TOPICS[i % len(TOPICS)] for i in range(unwanted))]
    kinds = [lambda: invented(), lambda: invented(), lambda: joined([draw.choice(ORDINARY), draw.choice(COMMON)]),
             lambda: joined([invented(), draw.choice(ORDINARY)]), lambda: joined([invented(), draw.choice(COMMON)]),
             lambda: joined([draw.choice(ORDINARY), draw.choice(ORDINARY)]), lambda: draw.choice(ORDINARY)]
    return out + [(kinds[i % len(kinds)](), 0.0) for i in range(wanted)]


def labelled_rows(names: list[tuple[str, float]], seed: int = 4) -> list[tuple[str, float]]:
    """(url, label): each site under a few hosts and paths."""
    draw = random.Random(seed)
    rows = []
    for name, label in names:
        for _ in range(URLS_PER_SITE):
            path = draw.choice(PATHS)
            path = path.replace("{n}", str(draw.randint(1, 999)))
            rows.append((f"{draw.choice(['http', 'https'])}://{draw.choice(PREFIXES)}{name}.{draw.choice(ENDINGS)}{path}", label))
    return rows


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table (url, label) of this module."""
    return spark.createDataFrame(labelled_rows(site_names()), "url string, label double").coalesce(1)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null if none fits."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def grams(host: Column, path: Column) -> Column:
    """The character n-grams of host and path, in marks that show their ends.

    Taken from an array of characters: a substring would be searched from the text's start each time.
    """
    text = F.concat(F.lit("^"), host, F.lit(SEPARATOR), path, F.lit("$"))

    def of(chars: Column, n: int) -> Column:
        # One parameter: a second one would be taken for the place in the array.
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0))),
                           lambda i: F.concat(*[F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(n)]))
    return F.flatten(F.transform(F.array(F.split(text, "")), lambda chars: F.concat(*[of(chars, n) for n in GRAMS])))


def train(labelled: DataFrame, ridge: float = RIDGE) -> PipelineModel:
    """Fit on (url, label); the table is small by contract.  Both labels weigh the same in sum."""
    rows = labelled.select(grams(host_of(F.col("url")), path_of(F.col("url"))).alias("grams"), "label")
    share = rows.agg(F.avg("label")).first()[0] or 0.0
    weight = F.when(F.col("label") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9))
    return Pipeline(stages=[HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features"),
                            LogisticRegression(regParam=ridge, standardization=False, maxIter=100, weightCol="weight")]).fit(rows.withColumn("weight", weight))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (probability of unwanted) of every page."""
    from pyspark.ml.functions import vector_to_array
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = split.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("r"), grams(F.col("host"), F.col("path")).alias("grams"))
    scored = train(labelled).transform(ruled).withColumn("score", vector_to_array("probability")[1])
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"),
                         F.coalesce("r.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
