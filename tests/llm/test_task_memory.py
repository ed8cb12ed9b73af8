"""What a task holds while it hashes or encodes: bounded by a block of text, not by a batch."""

import tracemalloc

import numpy as np

from traderisk.llm import pretokens
from traderisk.llm import textkernels as K


def test_word_hashes_hold_a_block_of_text():
    texts = ["several words of one kind or other " * 100] * 400  # 1.4 million characters
    K.word_hashes(texts[:1])
    tracemalloc.start()
    words, at = K.word_hashes(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words) == 400 * 700 and at[-1] == len(words)
    assert peak < 24e6, peak  # 58 MB in blocks of a million characters


def test_word_hashes_are_the_same_in_any_block(monkeypatch):
    texts = ["", "Ein Wort", "a" * 700, "x y " * 400, "  ", "last one", "äöü ßé " * 300]
    whole = K.word_hashes(texts)
    monkeypatch.setattr(K, "BLOCK_CHARS", 64)
    blocks = K.word_hashes(texts)
    assert np.array_equal(whole[0], blocks[0]) and np.array_equal(whole[1], blocks[1])


def test_remembered_pretokens_stay_bounded_within_a_batch(monkeypatch):
    monkeypatch.setattr(pretokens, "REMEMBERED", 10)
    enc = pretokens.PretokenEncoder(pretokens.tokenizer_path("byte_bpe_50k.json"))
    texts = [f"word{i} other{i} {i}  \n mixed's 12{i}" for i in range(60)] + ["", "日本語 text", "<|endoftext|> x"]
    got = enc.encode_all(texts)
    assert [g.tolist() for g in got] == [enc.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(enc.memory) <= 40
