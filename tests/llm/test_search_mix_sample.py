"""Operators 11 to 13 against their SQL and against plain Python, on the small tables and on unusual rows."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from traderisk.llm import importance, lexical_search, mixing, terms

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
HUGE = ("Alpha beta,GAMMA " * 80_000) + "x" * 50_000 + " the End"  # more than one block of bytes, with a very long word
ODD = [(1, None), (2, ""), (3, " \n\t ... "), (None, "The cat sat on the mat."), (None, "the CAT"), (5, "one"), (6, "one"), (6, "one"), (6, "two one"),
       (7, LONG), (8, LONG + " x"), (9, "naïve Ünïcode 漢字 it's 3.14 A-B"), (10, HUGE), (11, "cat " * 300),
       *[(100 + i, "the same copy of a cat text with more than twenty words " * 3) for i in range(90)]]
ITEMS = [(0, "The cat, one mat"), (0, "the cat, ONE mat"), (1, None), (2, "nothingofthiskind"), (None, "word5 word976 alpha the end"), (4, LONG),
         (5, "ÜNÏCODE naïve 漢字")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if k % 3 == 0 else f"s{k % 2}", 1, "clash") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, term long, block string").repartition(3).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*r, "clash") for r in ITEMS], "item_id long, text string, term string")


def by_sql(sql, odd, items):
    con = duckdb.connect()
    con.register("documents", odd.toPandas().astype({"doc_id": "Int64"}))
    con.register("benchmark", items.toPandas().astype({"item_id": "Int64"}))
    return rows_of(con.sql(sql).df())


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if pd.isna(x) else float(x) for x in r) for r in frame.itertuples(index=False)), key=str)


# ---------------------------------------------------------------------------
# Terms
# ---------------------------------------------------------------------------
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return [w.translate(FOLD) for w in PATTERN.findall(text or "")]


def test_terms_equal_the_pattern_and_hash_alike():
    texts = [t for _, t in ODD]
    found, h = [[] for _ in texts], [[] for _ in texts]
    for block in terms.blocks(pa.array(texts)):
        hashed = terms.hashes(block)
        for s, e, t, x in zip(block.start, block.end, block.text, hashed):
            found[t].append(block.data[s:e].decode())
            h[t].append(int(x))
    assert found == [words(t) for t in texts]
    of = {}
    for ws, hs in zip(found, h):
        for w, x in zip(ws, hs):
            assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)


# ---------------------------------------------------------------------------
# Operator 11
# ---------------------------------------------------------------------------
def test_search_of_odd_rows_equals_sql(odd, items):
    got = lexical_search.search(odd, items).toPandas()
    want = by_sql(lexical_search.SQL, odd, items)
    assert rows_of(got) == want and len(want) > 100


def brute_search(docs, items, top):
    tf = [Counter(words(t)) for t in docs["text"]]
    n = [sum(c.values()) for c in tf]
    N, L = sum(x > 0 for x in n), sum(n)
    df = Counter(w for c in tf for w in c)
    out = []
    for item_id, text in items[["item_id", "text"]].itertuples(index=False):
        scores = []
        for doc_id, c, size in zip(docs["doc_id"], tf, n):
            m = 50 + (50 * size * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m))
                    for w in set(words(text)) if w in c)
            if s > 0:
                scores.append((-s, doc_id))
        out += [(item_id, k, d, -s) for k, (s, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("top", [1, 3])
def test_many_blocks_bundles_and_waves_equal_brute_force(spark, monkeypatch, top):
    """Blocks of a few documents, bundles of four items, two bundles a wave: pruning between owners is at work."""
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 16)
    monkeypatch.setattr(lexical_search, "BUNDLE_ITEMS", 4)
    monkeypatch.setattr(lexical_search, "WAVE", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(9)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").repartition(5)
    got = lexical_search.search(docs, items, top)
    assert sorted(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == brute_search(docs.toPandas(), items.toPandas(), top)


def test_search_without_rows(odd, items):
    assert lexical_search.search(odd.where("false"), items).count() == 0
    assert lexical_search.search(odd, items.where("false")).count() == 0
    none = lexical_search.search(odd.where("doc_id IN (1, 2, 3)"), items)
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0


# ---------------------------------------------------------------------------
# Operator 12
# ---------------------------------------------------------------------------
def test_mixture_of_odd_rows_equals_sql(odd, items):
    got = mixing.mixture(odd).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    assert rows_of(got) == by_sql(mixing.SQL, odd, items)


def brute_level(weights, caps, budget):
    """Shares by weight, clamped and shared again, source by source."""
    open_ = set(range(len(weights)))
    target = [0.0] * len(weights)
    while open_:
        left = budget - sum(target[i] for i in range(len(weights)) if i not in open_)
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > caps[i]]
        for i in open_:
            target[i] = caps[i] if i in over else share[i]
        if not over:
            break
        open_ -= set(over)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_water_filled_and_reached(spark, seed):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for s in range(12):
        for _ in range(int(rng.integers(1, 60))):
            rows.append((k, f"s{s:02d}" if s else None, "w " * int(rng.integers(0, 40 if s % 3 else 900))))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    out = mixing.mixture(docs).toPandas()
    assert len(out) == len(rows) and (out["taken"] <= 2 * out["size"]).all() and (out["taken"] >= 0).all()
    by = out.groupby(out["source"].fillna("~null")).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    weights = [(5, 2, 1)[i % 3] for i in range(len(by))]
    want = brute_level(weights, [2.0 * x for x in by["size"]], 1.5 * by["size"].sum())
    assert np.allclose(by["target"], want, rtol=1e-12)
    assert (np.abs(by["taken"] - by["target"]) <= 0.5 + 1e-9).all()
    again = mixing.mixture(docs.repartition(3)).toPandas()
    assert rows_of(again.drop(columns="source")) == rows_of(out.drop(columns="source"))


def test_mixture_of_nothing(odd):
    assert mixing.mixture(odd.where("false")).count() == 0
    blank = mixing.mixture(odd.where("doc_id IN (1, 2)")).toPandas()
    assert len(blank) == 2 and (blank[["size", "target", "taken"]] == 0).all().all()


def test_another_seed_draws_other_documents(spark):
    docs = spark.createDataFrame([(i, "a", "w " * 10) for i in range(200)] + [(i, "b", "w") for i in range(200, 300)], "doc_id long, source string, text string")
    a, b = (mixing.mixture(docs, seed=s).toPandas().set_index("doc_id")["taken"].sort_index() for s in (1, 2))
    assert a.sum() == b.sum() and (a != b).any()


# ---------------------------------------------------------------------------
# Operator 13
# ---------------------------------------------------------------------------
def test_joined_crc_equals_the_crc_of_the_joined_words():
    rng = np.random.default_rng(0)
    parts = [bytes(rng.integers(97, 123, int(n), dtype=np.uint8)) for n in [1, 2, 3, 7, 8, 255, 256, 70_000, *rng.integers(1, 40, 200)]]
    first, second = parts, parts[::-1]
    crc = np.array([zlib.crc32(p) for p in first], np.uint32)
    got = importance.joined_crc(crc, crc[::-1].copy(), np.array([len(p) for p in second]))
    assert got.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(first, second)]


@pytest.mark.parametrize("most", [0, 1, 5, 400, 1 << 17])
def test_dictionaries_of_any_size_give_the_same_features(most):
    """Also when the automaton holds no word, or only some: the rest is computed on the spot."""
    texts = pa.array([t for _, t in ODD])
    for _ in range(2):
        held, got = importance.Dictionary(most), [Counter() for _ in ODD]
        for _ in range(2):  # the second scan meets a grown dictionary
            got = [Counter() for _ in ODD]
            for bucket, text in importance.features(texts, held):
                for b, t in zip(bucket.tolist(), text.tolist()):
                    got[t][b] += 1
        assert len(held.crc) <= max(most, 0)
        for (_, t), mine in zip(ODD, got):
            w = words(t)
            want = Counter(zlib.crc32(f.encode()) % importance.BUCKETS for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])
            assert mine == want


def test_resampling_of_odd_rows_equals_sql(odd, items):
    small = odd.where("length(text) < 100000 OR text IS NULL")  # the SQL takes bytes one by one
    got = importance.resample(small, items).toPandas()
    want = by_sql(importance.SQL, small, items)
    assert rows_of(got) == want
    assert got["rank"].notna().sum() == 25 * sum(len(words(t)) >= 20 for t in small.toPandas()["text"]) // 100 > 5


def test_resampling_without_rows_or_target(odd, items):
    assert importance.resample(odd.where("false"), items).count() == 0
    out = importance.resample(odd, items.where("false")).toPandas()
    assert len(out) == len(ODD) and out.loc[out["n_features"] == 0, "rank"].isna().all()
    ranks = out["rank"].dropna().sort_values().tolist()
    assert ranks == list(range(1, len(ranks) + 1))


def test_drawn_documents_are_nearer_to_the_target(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    out = importance.resample(docs, items).toPandas()
    long_enough = out[out["n_features"] >= 39]
    assert long_enough.loc[long_enough["rank"].notna(), "weight"].mean() > long_enough["weight"].mean()
