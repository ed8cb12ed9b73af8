"""Operator 3: host, path and rule against DuckDB, the n-grams and the model against plain Python, sites left out of training."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from traderisk.llm import url_filter as U

SF = "/root/testdata/sf0.01"
URLS = ["http://A.example.ORG/es/1", "https://example.org/en/12?x", "http://x.fr.com/fr/a", "http://b.com/de/", "http://b.com/de", "http://org/",
        "notorg.xorg/", None, "", "nothing", "http://", "://", "a://b://c.com/de/x", "http://c.org", "http://c.org?q=/es/", "http://c.org#/x?y",
        "HTTP://EXAMPLE.org/en/1", "http://example.org/en/2", "http://sub.example.org/en/1x", "http://notexample.org/es/", "http://É.com/fr/ü",
        "http://x.com/fr\n/de/", "http://host\n.com/de/a", "http://long.com/" + "de/" * 50_000, "http://" + "sub." * 20_000 + "com/de/"]

SQL = """
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS place FROM pages),
r AS (SELECT page_id, CASE WHEN place > 0 THEN substr(url, place + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, rest, translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM r),
p AS (SELECT page_id, host, regexp_extract(substr(rest, length(host) + 1), '(?s)^[^?#]*') AS path FROM h),
rules(rule, site, start) AS (VALUES ('org/', 'org', '/'), ('example.org/es/', 'example.org', '/es/'), ('example.org/en/1', 'example.org', '/en/1'),
                                    ('com/fr/', 'com', '/fr/'), ('com/de/', 'com', '/de/')),
f AS (SELECT p.page_id, rules.rule, row_number() OVER (PARTITION BY p.page_id ORDER BY length(rules.rule) DESC) AS nth
      FROM p JOIN rules ON (p.host = site OR ends_with(p.host, '.' || site)) AND starts_with(p.path, start))
SELECT p.page_id, p.host, p.path, f.rule FROM p LEFT JOIN f ON p.page_id = f.page_id AND f.nth = 1 ORDER BY p.page_id
"""


@pytest.fixture(scope="module")
def labelled(spark):
    return U.labelled_urls(spark).cache()


def check(pages, got):
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toPandas())
    want = con.sql(SQL).fetchall()
    rows = sorted((r["page_id"], r["host"], r["path"], r["rule"]) for r in got.select("page_id", "host", "path", "rule").collect())
    assert rows == [tuple(r) for r in want]


def test_host_path_and_rule_of_all_pages(spark, labelled):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    check(pages, U.judge(pages, labelled))


def test_host_path_and_rule_of_odd_urls(spark, labelled):
    pages = spark.createDataFrame([(i, u, "h", "x", 1.0) for i, u in enumerate(URLS)], "page_id long, url string, html string, host string, score double")
    got = U.judge(pages, labelled)
    check(pages, got)
    assert got.where("verdict NOT IN ('allow', 'block') OR verdict IS NULL").count() == 0
    verdict = dict(U.RULES)
    assert all(r["verdict"] == verdict[r["rule"]] for r in got.where("rule IS NOT NULL").collect())
    assert U.judge(pages.where("false"), labelled).count() == 0


def test_grams_are_the_character_grams(spark):
    rows = spark.createDataFrame([("a.com", "/x"), ("", ""), ("é" * 9, "/" + "y" * 300)], "host string, path string")
    for r in rows.select("host", "path", U.grams(F.col("host"), F.col("path")).alias("g")).collect():
        text = f"^{r['host']}{U.SEPARATOR}{r['path']}$"
        want = [text[i: i + n] for n in U.GRAMS for i in range(max(1, len(text) - n + 1))]
        assert r["g"] == want


def test_scores_equal_the_logistic_curve(spark, labelled):
    """The model's probability from its coefficients, n-gram by n-gram."""
    from pyspark.ml.feature import HashingTF
    model = U.train(labelled)
    weights, intercept = model.stages[1].coefficients.toArray(), model.stages[1].intercept
    urls = ["http://casino-win.example.com/en/3", "http://library.example.org/x", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    hashing = HashingTF(numFeatures=U.BUCKETS, binary=True)
    for r in U.judge(pages, labelled, []).collect():
        text = f"^{r['host']}{U.SEPARATOR}{r['path']}$"
        used = {hashing.indexOf(text[i: i + n]) for n in U.GRAMS for i in range(max(1, len(text) - n + 1))}
        assert abs(1 / (1 + np.exp(-(weights[sorted(used)].sum() + intercept))) - r["score"]) < 1e-6


def test_sites_left_out_of_training(spark):
    def held(name):
        return zlib.crc32(name.encode()) % 5 == 0
    names = U.site_names()
    rows = [(i, u, y) for i, (u, y) in enumerate(U.labelled_rows([n for n in names if held(n[0])], seed=11))]
    fitted = spark.createDataFrame(U.labelled_rows([n for n in names if not held(n[0])]), "url string, label double").coalesce(1)
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string, label double"), fitted, []).toPandas().set_index("page_id")
    for wanted, verdict in ((0.0, "allow"), (1.0, "block")):
        ids = [i for i, _, y in rows if y == wanted]
        assert len(ids) > 50 and (got.loc[ids, "verdict"] == verdict).mean() > 0.95


def test_no_training_site_is_a_site_of_the_pages(spark):
    """The labelled names are made by rule; a name that also occurs among the pages is chance, and rare."""
    hosts = {r["host"] for r in U.judge(spark.read.parquet(f"{SF}/pages.parquet"), U.labelled_urls(spark)).select("host").distinct().collect()}
    sites = {part for h in hosts for part in h.split(".")}
    names = {n for n, _ in U.site_names()}
    assert len(names & sites) <= 2
