"""Benchmark leaks against exhaustive BM25 over every passage and part, whatever the blocks and the length of items."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from traderisk.llm import decontamination as D

WORD = re.compile(r"[^\W_]+")


def words(text):
    return WORD.findall((text or "").lower())


def made(seed=3):
    """Items of 12 to 900 words, and documents that hold whole, cut or changed items, or none."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    # Frequent words make up much of every text.
    share = 1 / np.arange(1, 3001) ** 0.9
    draw = lambda n: rng.choice(vocabulary, n, p=share / share.sum()).tolist()
    items, docs, near = [], [], set()
    for i, n in enumerate([12, 20, 30, 45, 60, 64, 65, 100, 150, 300, 500, 900] * 2):
        w = draw(n)
        cut = max(3, 2 * n // 3)
        items.append((i, " ".join(w[:cut]) + "? " + " ".join(w[cut:]) + "."))
    for i in range(160):
        text = draw(int(rng.integers(5, 400)))
        if i % 4:
            item, text_of = items[int(rng.integers(len(items)))]
            copy = words(text_of)
            if i % 4 == 2:  # a near copy: a word in twenty is another
                copy = [draw(1)[0] if rng.random() < 0.05 else w for w in copy]
                near.add((i, item))
            if i % 4 == 3:  # only its first half: no answer
                copy = copy[: len(copy) // 2]
            at = int(rng.integers(len(text) + 1))
            text = text[:at] + copy + text[at:]
        docs.append((i, " ".join(text)))
    return items, docs, near


def exhaustive(items, docs):
    """(doc_id, item_id) to the best score, question and answer overlap."""
    parts = [(i, w[s: s + 64]) for i, t in items for w in [words(t)] for s in range(0, len(w), 64)]
    df = Counter(x for _, p in parts for x in set(p))
    mean = sum(len(p) for _, p in parts) / len(parts)
    weights = []
    for item, p in parts:
        w = {x: math.log(1 + (len(parts) - df[x] + 0.5) / (df[x] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(p) / mean)) for x, n in Counter(p).items()}
        weights.append((item, {x: y / sum(w.values()) for x, y in w.items()}))

    def overlap(half, text):
        half, text = words(half), words(text)
        k = min(3, len(half))
        a, b = ({tuple(x[i: i + k]) for i in range(len(x) - k + 1)} for x in (half, text))
        return len(a & b) / len(a) if k else 1.0
    out = {}
    for doc, text in docs:
        w = words(text)
        for s in range(0, len(w), 64):
            here = set(w[s: s + 128])
            for item, weight in weights:
                score = sum(y for x, y in weight.items() if x in here)
                if score >= 0.5 - 1e-9:
                    q, a = D.question_answer(dict(items)[item])
                    x = (score, overlap(q, text), overlap(a, text))
                    if min(x[1:]) >= 0.5:
                        out[doc, item] = max(out.get((doc, item), x), x)
    return out


@pytest.fixture(scope="module")
def tables(spark):
    items, docs, near = made()
    return (items, docs, near, spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
            spark.createDataFrame(items, "item_id long, text string").repartition(2))


@pytest.mark.parametrize("index_parts, long_item", [(20_000, 16_384), (6, 16_384), (6, 80)])
def test_leaks_are_those_of_the_exhaustive_search(tables, index_parts, long_item):
    items, docs, near, d, i = tables
    want = exhaustive(items, docs)
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["question_overlap"], r["answer_overlap"])
           for r in D.leaks(d, i, index_parts, long_item).collect()}
    assert got.keys() == want.keys() and len(want) > 60
    assert all(np.allclose(got[k], want[k]) for k in want)
    assert len(near & got.keys()) >= 0.9 * len(near)
    clean = {r["doc_id"] for r in D.keep_clean(d, i, index_parts, long_item).collect()}
    assert clean == {x for x, _ in docs} - {x for x, _ in want}


@pytest.mark.parametrize("index_parts, long_item", [(20_000, 16_384), (1, 2)])
def test_repeats_nulls_and_clashing_names(spark, index_parts, long_item):
    item = "alpha beta gamma delta epsilon zeta? eta theta iota kappa lambda."
    rows = [(1, f"x y {item} z"), (1, f"x y {item} z"), (None, item), (2, None), (3, ""), (4, "nothing of it here at all"), (5, item.split("?")[0])]
    docs = spark.createDataFrame([(i, t, "a", "b", 1, 2) for i, t in rows], "doc_id long, text string, row_key string, uid string, block int, c0 int")
    items = spark.createDataFrame([(7, item, "a"), (7, item, "a"), (None, item, "b"), (8, None, "c"), (9, "", "d")], "item_id long, text string, row_key string")
    got = sorted(((r["doc_id"] or 0, r["item_id"] or 0) for r in D.leaks(docs, items, index_parts, long_item).collect()))
    assert got == sorted([(1, 7), (1, 7), (1, 0), (1, 0), (0, 7), (0, 0)])
    kept = D.keep_clean(docs, items, index_parts, long_item)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5]
    for few in (docs.where("false"), docs):
        none = items.where("false")
        assert D.leaks(few, none, index_parts, long_item).count() == 0
        assert D.keep_clean(few, none, index_parts, long_item).count() == few.count()


def test_an_index_holds_no_shingles_of_long_items(spark):
    rng = np.random.default_rng(1)
    huge = " ".join(f"h{i}" for i in rng.integers(0, 10**6, 60_000))
    items = spark.createDataFrame([(1, huge), (2, "what is the capital of the land? it is the old town.")], "item_id long, text string")
    blocks = list(D.indexes(items, index_parts=300))
    assert sum(len(b.uids) for b in blocks) == -(-60_000 // 64) + 1 and len(blocks) >= 3
    assert max(len(b.part) for b in blocks) < 1.5 * 300 * 64 and sum(len(b.checks) for b in blocks) == 1
    docs = spark.createDataFrame([(1, "so " + huge + " end"), (2, huge[: len(huge) // 3]), (3, "x")], "doc_id long, text string")
    got = D.leaks(docs, items, index_parts=300).collect()
    assert [(r["doc_id"], r["item_id"], r["question_overlap"], r["answer_overlap"]) for r in got] == [(1, 1, 1.0, 1.0)]
