"""Operator 9: what a left-out language, mislabelled rows and small clusters do."""

import numpy as np
import pandas as pd
import pytest

from traderisk.llm import language_id as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("lang", ["de", "en", "es", "fr"])
def test_a_left_out_language_is_mostly_rejected(docs, lang):
    table = pd.read_parquet(f"{SF}/documents.parquet")
    model = L.fit(docs.where(f"lang <> '{lang}'"))
    unknown = table[(table.lang == lang) & (table.n_chars >= 500)].text.tolist()
    known = table[(table.lang != lang) & table.lang.notna()].text.tolist()
    assert L.judge(unknown, model)[2].mean() >= 0.8
    assert L.judge(known, model)[2].mean() <= 0.02


def test_nearest_centroid_by_brute_force(docs):
    texts = pd.read_parquet(f"{SF}/documents.parquet").text.tolist()[:200]
    model = L.fit(docs)
    lang, score, _ = L.judge(texts, model)
    for t, got, s in zip(texts, lang, score):
        counts = np.zeros(L.DIM)
        c, _ = L.counts_of([t])
        counts[:] = c[0]
        x = np.log1p(counts) * model["idf"]
        cosines = [float(x @ y) / max(1e-12, float(np.linalg.norm(x))) for y in model["centroids"]]
        assert abs(max(cosines) - s) < 1e-4
        assert got == model["langs"][int(np.argmax(cosines))] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-4


def test_clusters_are_never_tiny():
    rng = np.random.default_rng(1)
    x = np.abs(np.concatenate([rng.normal(0, 1, (200, 16)) + 6 * np.eye(16)[0], rng.normal(0, 1, (200, 16)) + 6 * np.eye(16)[1], 9 * np.eye(16)[[5]]]))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = L.spherical_kmeans(x, 4)
    sizes = np.bincount((x @ centre.T).argmax(axis=1), minlength=len(centre))
    assert 2 <= len(centre) <= 4 and sizes.min() >= 10
    assert L.spherical_kmeans(x[:1], 4).shape == (1, 16)
    same = np.repeat(x[:1], 50, axis=0)
    assert len(L.spherical_kmeans(same, 4)) == 1


def test_mislabelled_rows_make_no_centroid(spark, docs):
    wrong = docs.where("lang = 'en' AND doc_id % 7 = 0").selectExpr("doc_id", "text", "'fr' AS lang")
    mixed = docs.where("NOT (lang = 'en' AND doc_id % 7 = 0)").select("doc_id", "text", "lang").unionByName(wrong)
    table = pd.read_parquet(f"{SF}/documents.parquet")
    english = table[(table.lang == "en") & (table.n_chars >= 200)].text.tolist()
    assert (L.judge(english, L.fit(mixed))[0] == "en").mean() > 0.98


def test_one_language_alone(docs):
    model = L.fit(docs.where("lang = 'en'"))
    assert set(model["langs"]) == {"en"}
    table = pd.read_parquet(f"{SF}/documents.parquet")
    assert L.judge(table[table.lang == "en"].text.tolist(), model)[2].mean() <= 0.05
