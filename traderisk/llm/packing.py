"""Operator 7: best-fit packing by a configuration linear program over the length histogram.

1. One Arrow pass encodes the texts, cuts what is longer than a sequence, and numbers the pieces
   of each length within their task.
2. Only the histogram (at most ``capacity`` counts) reaches the driver.  The configuration LP
   "cover every length's count with as few full sequences as possible" is solved by
   multiplicative weights until every length is covered: each round prices lengths, an unbounded
   knapsack dynamic program finds for every length its best configuration at these prices, those
   within ``NEAR`` of the best are used, and lengths they serve become cheaper.
3. The fractional solution is rounded without ever serving a length too often: of configurations
   that leave at most ``EMPTY`` of a sequence, the whole parts, then one more use of each as far as
   the counts allow.  What is left is packed by best fit over the histogram, again in whole
   configurations; the share of pieces that the program placed is logged.
4. The plan (bounded by the histogram, not by the documents) gives the n-th piece of a length its
   sequence and offset; pieces get n from per-task counts, so no length is gathered anywhere.

A null text is the empty text: one piece with the end id.  Repeated rows are packed each.  An
empty table gives no pieces.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traderisk.llm.common import map_batches, texts_of, written
from traderisk.llm.pretokens import encoder, tokenizer_path

LOG = logging.getLogger(__name__)
CAPACITY = 2048
STEP = 0.125  # of a length's demand that one use of a configuration serves at most
NEAR = 0.02
EMPTY = 0.005  # of a sequence in a configuration that the plan takes over
PRICE_FALL = 4.0  # a served length's price falls to exp(-PRICE_FALL)
PIECE_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary, part int, nth long"


def cut(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of n tokens: full pieces, the first may be shorter."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """The pieces with their ids (little-endian, 16 bits each if the vocabulary allows).

    ``nth`` numbers the pieces of one length within the task ``part``.
    """
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        enc = encoder(path)
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode_all(texts_of(batch))):
                ids = np.append(ids, np.array([end_id], enc.dtype))
                at = 0
                for k, n in enumerate(cut(len(ids), capacity)):
                    mine = ids[at: at + n]
                    out.append((doc_id, k, at, n, zlib.crc32(mine.astype("<u4").tobytes()), mine.tobytes(), part, int(seen[n])))
                    seen[n] += 1
                    at += n
            columns = list(zip(*out))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth"])
    return map_batches(docs.select("doc_id", "text"), run, PIECE_SCHEMA)


def knapsack_table(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(best value, length taken last or -1) by room."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if fit := fits[room]:
            value = prices[:fit] + best[room - lengths[:fit]]
            top = value.argmax()
            if value[top] > best[room]:
                best[room], choice[room] = value[top], top
    return best, choice


def configuration(lengths: np.ndarray, choice: np.ndarray, room: int) -> np.ndarray:
    """Counts by length of the configuration that the table has for this room."""
    counts = np.zeros(len(lengths), np.int64)
    while room > 0:
        if choice[room] < 0:
            room -= 1
            continue
        counts[choice[room]] += 1
        room -= int(lengths[choice[room]])
    return counts


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Counts by length of the configuration of most value within the capacity."""
    return configuration(lengths, knapsack_table(lengths, prices, capacity)[1], capacity)


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> Iterator[tuple[np.ndarray, float]]:
    """Fractional configurations (counts by length) that cover the whole demand, by multiplicative weights with knapsack pricing."""
    for used, times, share in _solved(lengths, demand, capacity):
        counts = np.zeros(len(lengths), np.int64)
        counts[used] = times
        yield counts, share


def _solved(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """``solve`` with each configuration as the lengths (their indices) in it and how often: a few numbers each."""
    served, prices, found = np.zeros(len(lengths)), lengths / capacity, {}
    while served.min() < 1.0:
        best, choice = knapsack_table(lengths, prices, capacity)
        value = prices + best[capacity - lengths]  # of the best configuration with this length
        enough = (1 - NEAR) * best[capacity]
        near = np.flatnonzero((served < 1.0) & (value >= enough))
        for i in near[np.argsort(-value[near], kind="stable")]:
            counts = configuration(lengths, choice, capacity - int(lengths[i]))
            counts[i] += 1
            used = np.flatnonzero(counts)
            if prices[used] @ counts[used] < enough:  # prices have fallen since the table
                continue
            times = float((demand[used] / counts[used]).min()) * STEP
            key = used.astype(np.int32).tobytes(), counts[used].astype(np.int32).tobytes()
            found[key] = found.get(key, 0.0) + times
            served[used] += counts[used] * times / demand[used]
            served[used] = np.where(served[used] > 1.0 - 1e-9, np.maximum(served[used], 1.0), served[used])
            prices[used] = np.where(served[used] < 1.0, lengths[used] / capacity * np.exp(-PRICE_FALL * served[used]), 0.0)
    return [(np.frombuffer(used, np.int32), np.frombuffer(counts, np.int32), share) for (used, counts), share in found.items()]


def fill(lengths: np.ndarray, left: np.ndarray, capacity: int) -> Iterator[tuple[np.ndarray, int]]:
    """Best fit over a histogram: the longest piece left, then the set of pieces that fills its
    sequence best, as often as the counts allow."""
    left = left.copy()
    while left.any():
        counts, room = np.zeros(len(lengths), np.int64), capacity
        while room > 0:
            fit = np.flatnonzero((left - counts > 0) & (lengths <= room))
            if not len(fit):
                break
            top = fit[-1]
            rest = room - lengths[fit]
            pair = fit[np.isin(rest, lengths[fit])]  # two pieces that close the sequence exactly
            if counts.any() and lengths[top] != room and len(pair):
                top = pair[-1]
            counts[top] += 1
            room -= lengths[top]
        used = counts > 0
        times = int((left[used] // counts[used]).min())
        yield counts, times
        left -= counts * times


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Rows (length, from_nth, per, base, place): the pieces of a length numbered from ``from_nth``
    on fill sequences from ``base`` on, ``per`` in each, the first at offset ``place``."""
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[n] for n in lengths], np.int64)
    rows, nth, base, lp_share = [], np.zeros(len(lengths), np.int64), 0, 0.0

    def use(used: np.ndarray, counts: np.ndarray, times: int) -> None:
        nonlocal base
        place = 0
        for i, n in zip(used[::-1].tolist(), counts[::-1].tolist()):
            rows.append((int(lengths[i]), int(nth[i]), n, base, place))
            nth[i] += n * times
            place += n * int(lengths[i])
        base += times

    if len(lengths):
        total = int(left.sum())

        def take(used: np.ndarray, counts: np.ndarray, most: int) -> None:
            times = min(most, int((left[used] // counts).min()))
            if times:
                use(used, counts, times)
                left[used] -= counts.astype(np.int64) * times
        found = sorted(_solved(lengths, left.astype(float), capacity), key=lambda x: -x[2])
        size = [int(lengths[used] @ counts) for used, counts, _ in found]
        full = [(n, *x) for n, x in zip(size, found) if n >= (1 - EMPTY) * capacity]
        for _, used, counts, share in full:
            take(used, counts, int(share))
        for _, used, counts, _ in sorted(full, key=lambda x: (-x[0], -(x[3] % 1))):
            take(used, counts, 1)
        lp_share = 1 - int(left.sum()) / total
        LOG.info("%d lengths, %d pieces: %.1f %% placed by %d configurations of the linear program (value %.1f, bound %.1f)", len(lengths),
                 total, 100 * lp_share, len(found), sum(x[2] for x in found), sum(n * m for n, m in histogram.items()) / capacity)
        for counts, times in fill(lengths, left, capacity):
            used = np.flatnonzero(counts)
            use(used, counts[used], times)
    table = pd.DataFrame(rows, columns=["length", "from_nth", "per", "base", "place"], dtype="int64")
    table.attrs["lp_share"] = lp_share
    return table


def place(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset.  ``cut_pieces`` is a written table."""
    spark = cut_pieces.sparkSession
    counts = cut_pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    numbered = (cut_pieces.drop("ids").join(shifts, ["part", "length"])
                .withColumn("nth", F.col("nth") + F.col("shift")).drop("shift", "part"))
    sent = spark.sparkContext.broadcast({int(n): g[["from_nth", "per", "base", "place"]].to_numpy() for n, g in table.groupby("length")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
            sequence, offset = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            for n in np.unique(length):
                rows, mine = sent.value[int(n)], length == n
                row = rows[np.searchsorted(rows[:, 0], nth[mine], "right") - 1]
                within = nth[mine] - row[:, 0]
                sequence[mine] = row[:, 2] + within // row[:, 1]
                offset[mine] = row[:, 3] + within % row[:, 1] * n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("piece"), batch.column("start"), pa.array(length.astype(np.int64)),
                 batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return map_batches(numbered, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return place(written(pieces(docs, capacity), "pieces"), capacity)


def sequences(placed: DataFrame, cut_pieces: DataFrame) -> DataFrame:
    """sequence_id and the ids (binary) of each packed sequence, pieces in order of offset."""
    keyed = placed.select("doc_id", "piece", "ids_crc32", "sequence_id", "offset").join(
        cut_pieces.select("doc_id", "piece", "ids_crc32", "ids").distinct(), ["doc_id", "piece", "ids_crc32"])
    one = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return keyed.groupBy("sequence_id").agg(F.aggregate(one, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
