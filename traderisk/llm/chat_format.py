"""Operator 5: chat formatting with offset-aligned loss masks.

A conversation is rendered whole as ``[INST]role[/INST]text</s>`` per turn, encoded once with
offsets (the marks are special tokens, so no token crosses one), and a token is under the loss
mask if its span meets an assistant turn's text: both are sorted, so a binary search finds the
turn of every token.  Inside roles and texts a control string gets an escape character after its
first character, and the escape character is doubled; ``unescape`` undoes both.

Output: conv_id, formatted, ids, starts, ends, mask, one row per conversation.

Rows: turns are ordered by turn (null last), then role and text; a null role or text is empty;
each row with a null conv_id is a conversation of its own.  A conversation is one record and is
rendered in one task; tasks stream over sorted rows and hold one conversation at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traderisk.llm.common import map_batches, written
from traderisk.llm.pretokens import tokenizer_path

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
MARKS = (OPEN, CLOSE, END)
ESCAPE = "␛"
_CONTROL = re.compile("|".join(re.escape(m) for m in (*MARKS, "<|endoftext|>")))
_UNESCAPE = re.compile(f"{ESCAPE}(.)", re.DOTALL)
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(CLOSE) + "(.*?)" + re.escape(END), re.DOTALL)
FORMATTED = "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The text, and the spans (start, end) of the assistant texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + CLOSE, escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


@cache
def tokenizer(path: str):
    """The public tokenizer with the marks as special tokens and untrimmed offsets."""
    from tokenizers import Tokenizer, pre_tokenizers
    t = Tokenizer.from_file(path)
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    t.post_processor = None
    t.add_special_tokens(list(MARKS))
    return t


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Tokens whose span meets one of the sorted assistant spans."""
    if not len(spans):
        return np.zeros(len(starts), bool)
    turn = np.searchsorted(spans[:, 1], starts, side="right")  # the first span that ends after the token starts
    inside = turn < len(spans)
    return inside & (ends > spans[np.minimum(turn, len(spans) - 1), 0])


def format_conversations(rows: DataFrame, tokenizer_name: str = "byte_bpe_50k.json") -> DataFrame:
    path = tokenizer_path(tokenizer_name)
    keyed = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                        F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"))
    dealt = keyed.repartition("conv_id", "alone").sortWithinPartitions(
        "conv_id", "alone", F.col("turn").asc_nulls_last(), "role", "text")

    def done(conv_id, turns: list[tuple[str, str]]) -> dict:
        text, spans = render(turns)
        e = tokenizer(path).encode(text, add_special_tokens=False)
        offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
        return {"conv_id": conv_id, "formatted": text, "ids": e.ids, "starts": offsets[:, 0].tolist(), "ends": offsets[:, 1].tolist(),
                "mask": loss_mask(offsets[:, 0], offsets[:, 1], spans).tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())),
                            ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_()))])
        key, turns, out = None, [], []
        for batch in chain(batches, [None]):
            if batch is not None:
                for conv, alone, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "alone", "role", "text"))):
                    if (conv, alone) != key and turns:
                        out.append(done(key[0], turns))
                        turns = []
                    key = conv, alone
                    turns.append((role, text))
            elif turns:
                out.append(done(key[0], turns))
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    return map_batches(dealt, run, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the output alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text, mask = r["formatted"], np.array(r["mask"], bool)
                turns = [(unescape(a), unescape(b)) for a, b in _TURN.findall(text)]
                whole = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode())
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                loss = [unescape(text[r["starts"][s]: r["ends"][e - 1]]) for s, e in zip(edge[::2], edge[1::2])]
                rows.append({"conv_id": r["conv_id"], "n_turns": len(turns), "turns_sha256": whole.hexdigest(), "loss_chars": sum(map(len, loss)),
                             "loss_sha256": hashlib.sha256("".join(loss).encode()).hexdigest(), "formatted_chars": len(text)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))
    return map_batches(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted_digests(rows: DataFrame) -> DataFrame:
    return digests(written(format_conversations(rows), "formatted"))
