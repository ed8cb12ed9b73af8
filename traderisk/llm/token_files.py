"""Operator 4: token-id files with a minimal perfect hash index.

``write`` range-partitions documents by doc_id and each task writes one shard below the shared
folder: a raw payload of little-endian ids (16 bits each if the vocabulary allows) and an index.
The index is a minimal perfect hash by "hash, displace": keys fall into buckets, each bucket
stores the seed that sends its keys to free slots, and a slot holds the key's fingerprint, its
record's offset and length.  A look-up is two hashes, one comparison and one read.

File format, little-endian.  NNNNN.ids: the ids.  NNNNN.idx: int64 header (magic, records,
slots, buckets, id bytes), then keys int64, null flags uint8, offsets int64 and lengths int64 in
payload order, then the seeds uint32, fingerprints uint32 and record numbers uint32 by slot.

Unusual rows: a null text is the empty text and holds the end id alone; rows with a null doc_id
come first and are read in order only (no key); a repeated doc_id keeps all its records side
by side, the index finding the first.  Texts of any length are written whole; columns beside
doc_id and text are not looked at.  An empty table writes no shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traderisk.llm.common import map_batches, scratch, texts_of
from traderisk.llm.pretokens import encoder, tokenizer_path
from traderisk.llm.textkernels import mix

MAGIC = 0x4D504854
KEYS_PER_BUCKET = 4
END_ID = 2


def _hash(keys: np.ndarray, seed) -> np.ndarray:
    return mix(keys.view(np.uint64) + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds by bucket, slot by key) for distinct int64 keys: every slot 0..n-1 is hit once."""
    n = len(keys)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    bucket = (_hash(keys, 0) % np.uint64(buckets)).astype(np.int64)
    seeds, slot = np.zeros(buckets, np.uint32), np.zeros(n, np.int64)
    free = np.ones(n, bool)
    by = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=buckets)
    first = np.concatenate([[0], np.cumsum(size)])
    for b in np.argsort(-size, kind="stable"):
        mine = by[first[b]: first[b + 1]]
        if not len(mine):
            break
        at = 1
        while True:  # a run of seeds at a time
            tried = (_hash(np.broadcast_to(keys[mine], (256, len(mine))).copy(), np.arange(at, at + 256)[:, None]) % np.uint64(n)).astype(np.int64)
            ok = free[tried].all(axis=1)
            if len(mine) > 1:
                s = np.sort(tried, axis=1)
                ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if ok.any():
                k = int(ok.argmax())
                seeds[b], slot[mine] = at + k, tried[k]
                free[tried[k]] = False
                break
            at += 256
    return seeds, slot


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 0xF1A6) >> np.uint64(32)).astype("<u4")


def pack_index(keys: np.ndarray, null: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, id_bytes: int) -> bytes:
    known = np.flatnonzero(null == 0)
    distinct, firsts = np.unique(keys[known], return_index=True)
    seeds, slot = perfect_hash(distinct)
    prints, records = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    prints[slot], records[slot] = fingerprint(distinct), known[firsts]
    head = np.array([MAGIC, len(keys), len(distinct), len(seeds), id_bytes], "<i8")
    return b"".join(x.tobytes() for x in (head, keys.astype("<i8"), null.astype("u1"), offsets.astype("<i8"), lengths.astype("<i8"),
                                          seeds.astype("<u4"), prints, records))


class Shard:
    """Reads one shard: ``records()`` in payload order, ``find(doc_id)`` in constant time."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.raw = files.open_input_file(f"{path}.ids")
        with files.open_input_file(f"{path}.idx") as f:
            blob = f.read()
        magic, n, slots, buckets, self.id_bytes = np.frombuffer(blob, "<i8", 5).tolist()
        if magic != MAGIC:
            raise ValueError(f"{path}.idx is no index of token ids")
        at, parts = 40, []
        for dtype, count in (("<i8", n), ("u1", n), ("<i8", n), ("<i8", n), ("<u4", buckets), ("<u4", slots), ("<u4", slots)):
            parts.append(np.frombuffer(blob, dtype, count, at))
            at += parts[-1].nbytes
        self.keys, self.null, self.offsets, self.lengths, self.seeds, self.prints, self.record = parts

    def ids(self, record: int) -> np.ndarray:
        self.raw.seek(int(self.offsets[record]) * self.id_bytes)
        return np.frombuffer(self.raw.read(int(self.lengths[record]) * self.id_bytes), f"<u{self.id_bytes}")

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document, None if the shard doesn't hold it."""
        if not len(self.prints):
            return None
        key = np.array([doc_id], np.int64)
        seed = self.seeds[int(_hash(key, 0)[0] % np.uint64(len(self.seeds)))]
        slot = int(_hash(key, seed)[0] % np.uint64(len(self.prints)))
        record = int(self.record[slot])
        if self.prints[slot] != fingerprint(key)[0] or self.keys[record] != doc_id:
            return None
        return self.ids(record)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """A folder named as Spark names it, in whatever store Arrow can open."""
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = END_ID) -> DataFrame:
    """Writes the shards; returns the manifest (shard, path, records, tokens, start): one row per shard.

    Ties of doc_id are split by the text's hash, so a repeated or null key may span shards.  A
    task writes under a name of its own and renames at the end: a repeated attempt replaces
    the same bytes, a lost one leaves nothing under the final name.
    """
    spark = docs.sparkSession
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        shard = TaskContext.get().partitionId()
        enc = encoder(path)
        keys, lengths, raw, temp = [], [], None, f"{root}/.{shard:05d}-{uuid.uuid4().hex}"
        for batch in batches:
            if raw is None:
                files.create_dir(root, recursive=True)
                raw = files.open_output_stream(temp)
            keys += batch.column("doc_id").to_pylist()
            for ids in enc.encode_all(texts_of(batch)):
                raw.write(ids.tobytes() + np.array([end_id], enc.dtype).tobytes())
                lengths.append(len(ids) + 1)
        if raw is None:
            return
        raw.close()
        n = np.array(lengths, np.int64)
        index = pack_index(np.array([k or 0 for k in keys], np.int64), np.array([k is None for k in keys], np.uint8),
                           np.cumsum(n) - n, n, enc.dtype.itemsize)
        with files.open_output_stream(f"{temp}.idx") as f:
            f.write(index)
        files.move(temp, f"{root}/{shard:05d}.ids")
        files.move(f"{temp}.idx", f"{root}/{shard:05d}.idx")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{shard:05d}"], "records": [len(n)], "tokens": [int(n.sum())]},
                                         schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("tokens", pa.int64())]))
    order = F.xxhash64("text")
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id", order).sortWithinPartitions("doc_id", order)
    shards = map_batches(dealt, run, "shard int, path string, records long, tokens long")
    manifest = f"{folder}/manifest.parquet"
    shards.write.parquet(manifest)
    totals = spark.read.schema(shards.schema).parquet(manifest)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def digests(manifest: DataFrame, folder: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, read from the files through the index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(files, f"{root}/{row['path']}")
                start, out = row["start"], []
                for i in range(row["records"]):
                    key, first = int(shard.keys[i]), i == 0 or shard.keys[i] != shard.keys[i - 1] or shard.null[i - 1]
                    ids = shard.find(key) if first and not shard.null[i] else shard.ids(i)
                    if ids is None or ids[-1] != end_id:
                        raise ValueError(f"shard {row['path']}: record {i} isn't found under its key")
                    out.append((None if shard.null[i] else key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    # One task per shard: the manifest is tiny, so tasks chosen by its size would read many shards each.
    return map_batches(manifest.repartition(max(1, manifest.count()), "shard"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame) -> DataFrame:
    """Write, then read back (the files stay in the shared folder of the session)."""
    folder = scratch(docs.sparkSession, "token-files")
    return digests(write(docs, folder), folder)
