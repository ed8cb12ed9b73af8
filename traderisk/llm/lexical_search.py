"""Operator 11: ranked lexical search by pipelined term partitioning.

Terms belong to owners by the share of documents that hold them, rarest first (``OWNERS``).  The
items travel in bundles; a bundle's state for a block of documents is a sparse set of
accumulators (item, document, score so far).  The state goes through the owners one after the
other: a cogroup brings it together with the owner's posting lists of the same block, the owner
adds its terms' integer contributions and hands the state on.  After the last owner each block
gives its best documents of each item, and a window over those selects the final ones.

Between owners a document is let go only when it cannot come back: its score plus the most that
the owners to come could add lies below the score that ``top`` documents of its block already
have.  So the result is exact.

Bounds: a block holds at most ``BLOCK_DOCS`` documents, a bundle ``BUNDLE_ITEMS`` items (one item
is never split), and ``WAVE`` bundles are broadcast at once, a row per item.  Posting lists are
kept only for words whose hash is set in a filter of 2**FILTER_BITS bits, of one size whatever the
number of items.  Terms are compared by 64-bit hash.

Rows: null or empty texts, and texts without a term, are in no result and not counted; every row is
a document or an item of its own, so repeated ids are ranked as often as they stand there, and
repeated items get their results each; ids may be null (null after all others at equal scores);
long texts are read whole, in blocks; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traderisk.llm.common import map_batches, written
from traderisk.llm.terms import blocks, hashes

TOP = 50
BLOCK_DOCS = 2048
BLOCK_POSTINGS = 1 << 21  # a block of fewer documents ends beyond so many postings
BUNDLE_ITEMS = 256
WAVE = 64
FILTER_BITS = 23
OWNERS = (64, 8, 1)  # an owner has the terms in at most 1/64, 1/8, all of the documents
MOST = 1_000_000  # above any term's part without its weight
POSTINGS = "block long, term long, df long, docs binary, tfs binary, ids array<long>, sizes array<long>"
STATE = "bundle long, block long, items array<struct<slot:int,item_id:long,rest:array<long>>>, ids array<long>, sizes array<long>, slot binary, doc binary, score binary"
FOUND = "bundle long, slot int, item_id long, doc_id long, score long"


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def item_terms(items: DataFrame) -> DataFrame:
    """bundle, slot, item_id, term (64-bit hash): the distinct terms of each item."""
    n = items.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        first, seen = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            h, text = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for block in blocks(batch.column("text")):
                h.append(hashes(block))
                text.append(block.text)
            pairs = np.unique(np.rec.fromarrays([np.concatenate(text), np.concatenate(h)], names="text,term"))
            nth = seen + pairs["text"]
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(first + nth // BUNDLE_ITEMS), pa.array((nth % BUNDLE_ITEMS).astype(np.int32)),
                 batch.column("item_id").take(pa.array(pairs["text"])), pa.array(pairs["term"].view(np.int64))],
                names=["bundle", "slot", "item_id", "term"])
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").coalesce(max(1, -(-n // BUNDLE_ITEMS)))
    return map_batches(rows, run, "bundle long, slot int, item_id long, term long")


def wanted_words(terms: DataFrame) -> np.ndarray:
    """The filter of the items' words: 2**FILTER_BITS bits, whatever the number of items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            cells[_cells(batch.column("term").to_numpy().view(np.uint64))] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(cells))], names=["cell"])
    bits = np.zeros(1 << FILTER_BITS, bool)
    found = map_batches(terms.select("term"), run, "cell long").distinct().toArrow()  # at most 2**FILTER_BITS numbers
    bits[found.column("cell").to_numpy()] = True
    return np.packbits(bits)


def postings(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Per block of documents a row (ids, sizes) of its documents, and a row (term, docs, tfs) per wanted word in it."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block, mask = TaskContext.get().partitionId() << 33, np.unpackbits(sent.value).astype(bool)
        ids, sizes, held, size = [], [], [], 0
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for part in blocks(batch.column("text")):
                n += np.bincount(part.text, minlength=len(n))
                h = hashes(part)
                passed = mask[_cells(h)]
                found = _counted(h[passed], len(ids) + part.text[passed], np.ones(int(passed.sum()), np.int64))
                held.append(found)
                size += len(found[0])
            ids += batch.column("doc_id").to_pylist()
            sizes += n.tolist()
            if len(ids) + batch.num_rows > BLOCK_DOCS or size > BLOCK_POSTINGS:
                yield _block_rows(block, ids, sizes, held)
                block, ids, sizes, held, size = block + 1, [], [], [], 0
        if ids:
            yield _block_rows(block, ids, sizes, held)
    return written(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, POSTINGS), "search-postings")


def _counted(term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by term and document, the counts of equal ones added up."""
    order = np.lexsort((doc, term))
    term, doc, tf = term[order], doc[order], tf[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return term[at], doc[at], np.add.reduceat(tf, at) if len(at) else tf


def _block_rows(block: int, ids: list, sizes: list, held: list) -> pa.RecordBatch:
    parts = [np.concatenate(x) for x in zip(*held)] or [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    term, doc, tf = _counted(*parts)
    edges = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1], [True]])) if len(term) else np.zeros(1, np.int64)
    lists = [(doc[a:b].astype(np.uint16).tobytes(), _narrow(tf[a:b])) for a, b in zip(edges[:-1], edges[1:])]
    n = len(lists)
    return pa.RecordBatch.from_arrays([
        pa.array([block] * (n + 1), pa.int64()),
        pa.array([None, *term[edges[:-1]].view(np.int64).tolist()], pa.int64()),
        pa.array([None, *np.diff(edges).tolist()], pa.int64()),
        pa.array([None, *(d for d, _ in lists)], pa.binary()),
        pa.array([None, *(t for _, t in lists)], pa.binary()),
        pa.array([ids, *[None] * n], pa.list_(pa.int64())),
        pa.array([sizes, *[None] * n], pa.list_(pa.int64()))], names=["block", "term", "df", "docs", "tfs", "ids", "sizes"])


def _narrow(tf: np.ndarray) -> bytes:
    """One byte a number if all fit, else eight."""
    return (tf.astype(np.uint8) if not len(tf) or tf.max() < 256 else tf).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == n else np.int64).astype(np.int64)


def stage(states, lists, owner: int, tokens: int, documents: int, top: int, last: bool):
    """One owner: its contributions added to the accumulators of every (bundle, block)."""
    def visit(key, state: pa.Table, owned: pa.Table) -> pa.Table:
        items = state.column("items")[0].as_py()
        sizes = state.column("sizes").combine_chunks().flatten().to_numpy()
        m = 50 + (50 * sizes * documents) // max(1, tokens)
        place = {x["slot"]: i for i, x in enumerate(items)}
        score = np.zeros((len(items), len(sizes)), np.int64)
        score[_from(state, "slot", np.uint16), _from(state, "doc", np.uint16)] = _from(state, "score", np.int64)
        for slots, w, docs, tfs in zip(*(owned.column(c).to_pylist() for c in ("slots", "w", "docs", "tfs"))):
            doc = np.frombuffer(docs, np.uint16)
            tf = _wide(tfs, len(doc))
            part = w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            for s in slots:
                score[place[s], doc] += part
        keep = score > 0
        if len(sizes) > top:
            best = np.partition(score, len(sizes) - top, axis=1)[:, len(sizes) - top]
            rest = np.array([0 if last else x["rest"][owner] for x in items], np.int64)
            keep &= score + rest[:, None] >= best[:, None]
        row, doc = np.nonzero(keep)
        if last:
            slot = np.array([x["slot"] for x in items], np.int32)
            item_ids = pa.array([x["item_id"] for x in items], pa.int64())
            ids = state.column("ids").combine_chunks().flatten()
            row, doc = _first(row, doc, score[row, doc], ids, top)
            return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(row), pa.int64()), pa.array(slot[row]), item_ids.take(pa.array(row)),
                                         ids.take(pa.array(doc)), pa.array(score[row, doc])], names=["bundle", "slot", "item_id", "doc_id", "score"])
        for name, x in (("slot", row.astype(np.uint16)), ("doc", doc.astype(np.uint16)), ("score", score[row, doc])):
            state = state.set_column(state.column_names.index(name), name, pa.array([x.tobytes()], pa.binary()))
        return state
    return states.groupBy("bundle", "block").cogroup(lists.groupBy("bundle", "block")).applyInArrow(visit, FOUND if last else STATE)


def _first(row: np.ndarray, doc: np.ndarray, score: np.ndarray, ids: pa.Array, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` of each row by score, then document id, nulls last."""
    void, number = ids.is_null().to_numpy(zero_copy_only=False)[doc], ids.fill_null(0).to_numpy()[doc]
    order = np.lexsort((number, void, -score, row))
    row, doc = row[order], doc[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row, "left")
    return row[nth < top], doc[nth < top]


def _from(state: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(state.column(column)[0].as_py(), kind)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item."""
    terms = written(item_terms(items), "search-items")
    blocks_of = postings(docs, wanted_words(terms))
    counted = blocks_of.where("term IS NULL").select(
        F.expr("aggregate(sizes, 0L, (a, x) -> a + x)").alias("tokens"),
        F.size(F.filter("sizes", lambda x: x > 0)).cast("long").alias("documents")).agg(F.sum("tokens"), F.sum("documents")).first()
    tokens, documents = counted[0] or 0, counted[1] or 0
    weight = F.floor(F.lit(1000) * F.log(F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1))).cast("long")
    owner = F.lit(len(OWNERS) - 1)
    for i in reversed(range(len(OWNERS) - 1)):
        owner = F.when(F.col("df") * OWNERS[i] <= documents, F.lit(i)).otherwise(owner)
    weighed = (blocks_of.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
               .join(terms.select("term").distinct(), "term").select("term", weight.alias("w"), owner.alias("owner")).where("w > 0"))
    entries = written(terms.join(weighed, "term"), "search-terms")
    # What the owners after each one can still add to an item.
    rest = F.array(*[F.sum(F.when(F.col("owner") > i, F.col("w") * MOST).otherwise(0)) for i in range(len(OWNERS))])
    bundles = written(entries.groupBy("bundle", "slot", "item_id").agg(rest.alias("rest"))
                      .groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("slot", "item_id", "rest"))).alias("items")), "search-bundles")
    numbers = sorted(r["bundle"] for r in bundles.select("bundle").collect())  # one in BUNDLE_ITEMS items
    empty, found = F.lit(b""), None
    for at in range(0, len(numbers), WAVE):
        wave = F.col("bundle").isin(numbers[at: at + WAVE])
        # Every bundle visits every block: a stated query set against all rows, with a row per item broadcast.
        states = (blocks_of.where("term IS NULL").select("block", "ids", "sizes").crossJoin(F.broadcast(bundles.where(wave)))
                  .select("bundle", "block", "items", "ids", "sizes", empty.alias("slot"), empty.alias("doc"), empty.alias("score")))
        owned = entries.where(wave).groupBy("bundle", "term", "w", "owner").agg(F.collect_list("slot").alias("slots"))
        for i in range(len(OWNERS)):
            lists = (blocks_of.where("term IS NOT NULL").join(owned.where(F.col("owner") == i), "term")
                     .select(F.col("bundle").alias("bundle"), F.col("block").alias("block"), "slots", "w", "docs", "tfs"))
            states = stage(states, lists, i, tokens, documents, top, i == len(OWNERS) - 1)
        found = states if found is None else found.unionByName(states)
    if found is None:
        found = docs.sparkSession.createDataFrame([], FOUND)
    order = Window.partitionBy("bundle", "slot").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
c AS (SELECT count(*) FILTER (len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
m AS (SELECT r, doc_id, 50 + ((50 * len(ts) * c.n) // c.l) AS m FROM d, c WHERE len(ts) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
f AS (SELECT t, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY t, c.n),
x AS (SELECT DISTINCT q, item_id, unnest(ts) AS t FROM i),
s AS (SELECT x.q, x.item_id, m.r, m.doc_id, sum(f.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * m.m)))::BIGINT AS score
      FROM x JOIN f USING (t) JOIN p USING (t) JOIN m ON m.r = p.r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
