"""The training-data operators against brute force, on the small tables and on unusual rows."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from traderisk.llm import (chat_format, decontamination, language_id, near_dedup, packing, pretokens, quality_rules, token_counts,
                           token_files, toxicity, url_filter)
from traderisk.llm import queries as Q
from traderisk.llm.components import components

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "The cat sat on the mat."), (5, "one"), (6, "one"), (6, "one"), (7, LONG), (8, LONG + " x"),
       (9, "<|endoftext|> </s> it's ﬁne 漢字 ␛␛[INST]"), (10, "A b\n\nA b\nA B c d e A B c")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", None, 1, "clash") for i, t in ODD],
                                 "doc_id long, text string, lang string, source string, n_chars long, row_key string").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def shingle_sets(texts, k):
    fold = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    out = []
    for t in texts:
        w = WORDS.findall((t or "").translate(fold))
        out.append({tuple(w[j: j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute_components(ids, sets, percent=80):
    label = list(range(len(ids)))
    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for x, i in enumerate(ids):
        least[root(x)] = min(i, least.get(root(x), i))
    return [least[root(x)] for x in range(len(ids))]


def test_near_duplicates_match_brute_force(spark, docs):
    got = Q.QUERIES["op1_minhash_dedup"](spark, SF).toPandas().set_index("doc_id").sort_index()
    d = docs.sort_values("doc_id")
    sets = shingle_sets(d.text, 2)
    assert got.n_shingles.tolist() == [len(s) for s in sets]
    assert got.component_id.tolist() == brute_components(d.doc_id.tolist(), sets)


def test_a_chain_of_copies_is_one_component(spark):
    # Neighbours are alike, the ends aren't: stars alone would lose links.
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[i * 10: i * 10 + 200])) for i in range(20)]
    df = spark.createDataFrame(chain, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, k=2).toPandas().sort_values("doc_id")
    assert got.component_id.tolist() == brute_components([i for i, _ in chain], shingle_sets([t for _, t in chain], 2))
    assert got.component_id.nunique() == 1 and got.keeper.sum() == 1


def test_near_duplicates_of_odd_rows(odd, empty):
    got = near_dedup.near_duplicates(odd, k=2).toPandas()
    assert len(got) == len(ODD)
    one = got[got.doc_id.isin([5, 6])]
    assert set(one.component_id) == {5} and one.keeper.sum() == 1
    assert set(got[got.doc_id.isin([7, 8])].component_id) == {7}
    assert got[got.doc_id.isin([1, 2, 3])].n_shingles.sum() == 0
    kept = near_dedup.keep_one(odd, k=2)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 5, 7, 9, 10]
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.keep_one(empty).count() == 0


def test_components_of_a_path(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_leaks_match_brute_force(spark, docs):
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in Q.QUERIES["op2_decontamination"](spark, SF).collect()}
    copied = {(i, j) for i, t in zip(docs.doc_id, docs.text) for j, x in zip(bench.item_id, bench.text) if x in t}
    assert copied <= got

    def share(part, whole):
        part, whole = (re.findall(r"[^\W_]+", x.lower()) for x in (part, whole))
        k = min(3, len(part))
        a, b = ({tuple(w[i: i + k]) for i in range(len(w) - k + 1)} for w in (part, whole))
        return len(a & b) / len(a) if a else 1.0
    for i, j in got - copied:
        q, a = decontamination.question_answer(bench.set_index("item_id").text[j])
        assert min(share(q, docs.set_index("doc_id").text[i]), share(a, docs.set_index("doc_id").text[i])) >= 0.5


def test_index_blocks_give_the_same_leaks(spark, odd, empty):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).collect()}
    many = [decontamination.Index] and list(decontamination.indexes(items, index_parts=7))
    assert len(many) > 1
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {(rows[h[0]][0], h[1]) for index in many for h in index.hits([t for _, t in rows])} == whole
    odd_items = odd.select(odd["doc_id"].alias("item_id"), "text")
    assert decontamination.leaks(odd, odd_items).count() > 0
    assert decontamination.leaks(empty, odd_items).count() == 0 and decontamination.leaks(odd, odd_items.where("false")).count() == 0
    assert decontamination.keep_clean(odd, items).columns == odd.columns


def test_url_rules_and_model(spark):
    urls = ["http://A.example.org/es/1", "https://example.org/en/12?x", "http://x.fr.com/fr/a", "http://b.com/de/", "http://b.com/de",
            "http://org/", "notorg.xorg/", None, "nothing", "http://free-bets.example.net/x", "http://library.example.net/en/3", "http://c.org"]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, url_filter.labelled_urls(spark)).collect()}
    assert [got[i]["rule"] for i in range(len(urls))] == ["example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, "org/"] + [None] * 6
    assert [got[i]["verdict"] for i in range(4)] == ["block", "block", "allow", "block"]
    assert (got[9]["verdict"], got[10]["verdict"]) == ("block", "allow")
    assert (got[0]["host"], got[7]["host"], got[8]["path"], got[11]["path"]) == ("a.example.org", "", "", "")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pretoken_encoding_is_the_librarys(docs, name):
    enc = pretokens.encoder(pretokens.tokenizer_path(name))
    texts = docs.text.tolist() + [t or "" for _, t in ODD] + ["it's 'tis ''s  's x's5's a'st", "a\n\n b  \n's", "\t\tx\r\ny's'", "DON'T WE'LL ²½3", "  a "]
    assert [x.tolist() for x in enc.encode_all(texts)] == [e.ids for e in enc.whole.encode_batch(texts, add_special_tokens=False)]


def test_token_files(odd, empty):
    enc = pretokens.encoder(pretokens.tokenizer_path("word_bpe_49k.json"))
    got = token_files.token_files(odd).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted([i for i, _ in ODD], key=lambda i: (i is not None, i))
    want = sorted(zlib.crc32(np.array(enc.whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for _, t in ODD)
    assert sorted(r["ids_crc32"] for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert token_files.token_files(empty).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).choice(1 << 40, 5000, replace=False).astype(np.int64)
    _, slot = token_files.perfect_hash(keys)
    assert sorted(slot.tolist()) == list(range(5000))


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "␛[INST]␛␛", "<|endoftext|>", "", None, "  \n ", "x" * 5000, "[INS</s", "é漢🙂"]
    rows = [(c, t, r, x, "extra") for c in (1, None) for t, (r, x) in enumerate([(r, x) for x in texts for r in ("user", "assistant", None)])]
    df = spark.createDataFrame(rows + [(2, 0, "system", "only", "extra")], "conv_id long, turn long, role string, text string, alone string")
    out = chat_format.formatted_digests(df).toPandas()
    one = out[out.conv_id == 1].iloc[0]
    turns = [(r or "", x or "") for c, _, r, x, _ in rows if c == 1]
    loss = "".join(x for r, x in turns if r == "assistant")
    assert one.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
    assert (one.n_turns, one.loss_chars, one.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert out.conv_id.isna().sum() == len(turns) and chat_format.formatted_digests(df.where("false")).count() == 0


def test_quality_matches_its_sql(spark):
    import sys
    sys.path.insert(0, "tools")
    from oracle_check import compare, duck
    got = Q.QUERIES["op6_quality_rules"](spark, SF).toPandas()
    assert compare(got, duck(SF).sql(Q.ORACLES["op6_quality_rules"]).df()).startswith("OK")


def test_quality_of_odd_rows_and_boilerplate(spark, odd, empty):
    got = {r["doc_id"]: r for r in quality_rules.quality(odd).collect()}
    assert (got[10]["n_words"], got[10]["n_dup_lines"], got[10]["n_repeat_words"]) == (12, 1, 10)
    assert got[1]["n_words"] == got[2]["n_words"] == 0 and not got[1]["kept"]
    assert quality_rules.quality(empty).count() == 0
    line = " ".join(f"same{i}" for i in range(60))
    rows = [(i, f"{line}\nown {i}", "h") for i in range(30)] + [(99, line, "other")] + [(200 + i, line + " copy", "h2") for i in range(30)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # Documents are counted, so thirty copies on one host are boilerplate like thirty pages around one line.
    assert not any(kept[i] for i in range(30)) and kept[99] and not any(kept[200 + i] for i in range(30))


@pytest.mark.parametrize("few", [10**6, 0])
def test_quality_rejects_depleted_documents_as_its_sql(spark, monkeypatch, few):
    """A made table with hosts, boilerplate of all shares, repeats and copies, joined by broadcast and by salt."""
    import sys
    import duckdb
    sys.path.insert(0, "tools")
    from oracle_check import compare
    monkeypatch.setattr(quality_rules, "FEW_LINES", few)
    rng = np.random.default_rng(6)
    shared = [" ".join(f"common{j}w{k}" for k in range(12)) for j in range(8)]
    rows = []
    for i in range(400):
        own = [" ".join(f"own{i}x{rng.integers(10**6)}" for _ in range(12)) for _ in range(int(rng.integers(1, 9)))]
        lines = own + [shared[j].upper() if i % 2 else shared[j] + " !" for j in rng.integers(0, 8, int(rng.integers(0, 9)))]
        rng.shuffle(lines)
        rows.append((i if i % 50 else None, "\n".join(lines) if i % 97 else None, [None, "a", "b", "a"][i % 4]))
    rows += [(1000 + i, "\n".join(shared[:5]), "copies") for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = quality_rules.quality(docs).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    assert compare(got, con.sql(quality_rules.SQL).df()).startswith("OK")
    depleted = (~got["kept"] & ~got["base_failed"]).sum()
    assert 50 < depleted < 380 and got["kept"].sum() > 50


def test_packing(odd, empty):
    enc = pretokens.encoder(pretokens.tokenizer_path("byte_bpe_50k.json"))
    got = packing.pack(odd, 64).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 64
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    total = sum(len(enc.whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD)
    assert got.length.sum() == total and got.sequence_id.nunique() <= -(-total // 64) + 2
    assert packing.pack(empty, 64).count() == 0


def test_knapsack_finds_the_best_configuration():
    lengths, prices = np.array([3, 5, 7]), np.array([0.31, 0.52, 0.74])
    best = max((a * 0.31 + b * 0.52 + c * 0.74) for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 16)
    assert abs(packing.knapsack(lengths, prices, 16) @ prices - best) < 1e-9


def test_linear_program_covers_a_wide_histogram():
    lengths = np.arange(30, 2030)
    demand = np.random.default_rng(7).integers(1, 13, len(lengths))
    lengths, demand = np.append(lengths, 2048), np.append(demand, 100_000)
    served = sum(counts * share for counts, share in packing.solve(lengths, demand.astype(float), 2048))
    assert (served >= demand * (1 - 1e-6)).all()
    table = packing.plan(dict(zip(lengths.tolist(), demand.tolist())), 2048)
    last = table.groupby("length").tail(1)  # the last rows number all pieces of their length
    sequences = table.base.max() + 1
    assert len(last) == len(lengths) and table.attrs["lp_share"] > 0.75
    assert sequences <= 1.02 * (lengths @ demand) / 2048 + 2


def test_token_counts(odd, empty):
    c = token_counts.counter(pretokens.tokenizer_path("piece_bpe_32k.model"))
    assert c.splits
    got = token_counts.token_counts(odd).collect()
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == sorted((len((t or "").encode()), len(c.library.encode(t or ""))) for _, t in ODD)
    assert token_counts.token_counts(empty).count() == 0


def test_languages(spark, odd, empty):
    got = Q.QUERIES["op9_language_id"](spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.9 and got.score.between(0, 1).all()
    rows = language_id.languages(odd).collect()
    assert len(rows) == len(ODD) and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert language_id.languages(empty).count() == 0 and language_id.keep_known(odd).columns == odd.columns


def test_toxicity(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    got = Q.QUERIES["op10_toxicity"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9 and got.score.between(0, 1).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert toxicity.toxicity(odd, labels).count() == len(ODD)
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.toxicity(odd, labels.where("false")).count() == len(ODD)
    assert toxicity.keep_ordinary(odd, labels).columns == odd.columns


def test_toxicity_counts_every_context(spark):
    # "hub" follows 3,000 different words and is toxic: the shared backoff has all of them, in labelled texts or not.
    texts = [f"a{i} {'hub' if i % 2 or i >= 200 else 'calm'} b{i}" for i in range(3100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    pairs = set()
    for text in texts:
        words = text.split()
        pairs |= set(zip([None, *words], words))
    assert np.isclose(toxicity.fit(docs, labels)["shared"].max(), 3000 / len(pairs))


def test_pipeline_stages(spark, docs):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns and {r["doc_id"] for r in out.select("doc_id").collect()} <= set(docs.doc_id)
    kept = {r["doc_id"] for r in near_dedup.keep_one(frame).collect()}
    d = docs.sort_values("doc_id")
    assert kept == set(brute_components(d.doc_id.tolist(), shingle_sets(d.text, 5)))
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
