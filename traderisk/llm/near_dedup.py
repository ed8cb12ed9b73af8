"""Operator 1: MinHash near-duplicate detection.

1. One Arrow pass takes each text's word-shingle set, a 128-bit digest of it and
   ``bands`` keys, each over ``rows`` universal hash minima of the set.
2. Documents of one set form a class; only one row per class goes on.
3. Classes that share a band key meet at the smallest class of the bucket (a star,
   never all pairs), and the full sets confirm or refute each such link.
4. Connected components (alternating stars) over the confirmed links.
5. Buckets that still hold several components: further stars, then pairs of classes of
   *different* components that share a rare element, confirmed the same way, so no link between different sets is
   lost to the stars; components again over all links.

At a similarity of 0.8, five rows and forty bands miss a pair with probability
(1 - 0.8**5)**40 = 1.3e-7; more similar pairs less.

Results, also for unusual rows: a document without words has the empty set, links
with nothing and is its own component; a repeated row belongs to its twin's class;
a null text counts as empty; a row with a null doc_id takes part, its component is the
smallest non-null doc_id of the class group, null if there is none.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traderisk.llm.common import map_batches, texts_of, written
from traderisk.llm.components import components
from traderisk.llm.textkernels import mix, shingles, word_hashes

BANDS, ROWS = 40, 5
PAIRS_PER_SALT = 200  # members confirmed against one copy of a leader's set
FEW_CONFIRMED = 0.02  # stars go on while they confirm this share of their pairs; then pairs are tried one by one
FREQUENCY_BITS = 21
A_WORD = r"[^\x20\x09-\x0D]"  # whatever is no white space


def hash_family(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """n multiply-shift functions (a * x + b) >> 32 over 64-bit words, a odd."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def minima(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over one set, a few thousand elements at a time."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(sets), 512):
        part = a[:, None] * sets[None, at: at + 512]
        part += b[:, None]
        np.minimum(out, part.min(axis=1) >> np.uint64(32), out=out)  # the shift keeps the order
    return out


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + column)
    return x.view(np.int64)


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set."""
    return (int(np.sum(mix(s + np.uint64(0xA5A5)), dtype=np.uint64).astype(np.int64)),
            int(np.sum(mix(s ^ np.uint64(0x5DEECE66D)) * np.uint64(3), dtype=np.uint64).astype(np.int64)))


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """uid, row_key, doc_id, n, d1, d2, bands: one row per document (band keys null for the empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = hash_family(bands * rows)
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            words, at = word_hashes(texts_of(batch))
            n, d1, d2, keys = [], [], [], []
            for i in range(batch.num_rows):
                s = shingles(words[at[i]: at[i + 1]], k)
                n.append(len(s))
                one, two = digest(s)
                d1.append(one)
                d2.append(two)
                keys.append(band_keys(minima(s, a, b), bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(uid, uid + len(n))), batch.column("row_key"), batch.column("doc_id"),
                 pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["uid", "row_key", "doc_id", "n", "d1", "d2", "bands"])
            uid += len(n)
    keyed = docs.select("doc_id", "text", row_key(docs).alias("row_key"))
    return map_batches(keyed, run, "uid long, row_key long, doc_id long, n long, d1 long, d2 long, bands array<long>")


def row_key(docs: DataFrame):
    """Finds a row again in a second scan: the same in every scan, spread evenly whatever the texts repeat."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The full set of each wanted row (cid, leader, salt, row_key, d1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = word_hashes(texts_of(batch))
            made = [shingles(words[at[i]: at[i + 1]], k) for i in range(batch.num_rows)]
            ok = np.array([digest(s)[0] == d for s, d in zip(made, batch.column("d1").to_pylist())], bool)
            out = pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("leader"), batch.column("salt"), pa.array([s.tobytes() for s in made], pa.binary())],
                names=["cid", "leader", "salt", "set"])
            yield out.filter(pa.array(ok))
    keyed = docs.select("text", row_key(docs).alias("row_key"))
    return map_batches(keyed.join(wanted, "row_key"), run, "cid long, leader long, salt int, set binary")


def confirm(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Of the pairs (leader, cid), those with 100 * intersection >= percent * union on the full sets.

    Pairs are distinct.  ``sets_of`` adds the set to each row (cid, leader, salt), one row for one:
    no aggregate stands above its join, so Spark may split a class that meets many leaders.  A leader with many members is copied to
    one salt per PAIRS_PER_SALT of them, so no task gets all members of a large group; each set
    travels once per leader.
    """
    salts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / PAIRS_PER_SALT).cast("int").alias("salts"))
    members = pairs.join(salts, "leader").select("cid", "leader", F.pmod(F.xxhash64("cid"), "salts").cast("int").alias("salt"))
    leaders = salts.select(F.col("leader").alias("cid"), "leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, mine = None, None
        for batch in batches:
            found = []
            for cid, leader, salt, s in zip(*(batch.column(c).to_pylist() for c in ("cid", "leader", "salt", "set"))):
                s = np.frombuffer(s, np.uint64)
                if (leader, salt) != group:
                    group, mine = (leader, salt), s if cid == leader else None
                elif cid != leader and mine is not None:
                    both = len(np.intersect1d(mine, s, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(s) - both):
                        found.append((cid, leader))
            yield pa.RecordBatch.from_pylist([{"a": c, "b": l} for c, l in found], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    dealt = sets_of(members.unionByName(leaders)).select("cid", "leader", "salt", "set")
    dealt = dealt.repartition("leader", "salt").sortWithinPartitions("leader", "salt", (F.col("cid") != F.col("leader")))
    return map_batches(dealt, run, "a long, b long")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(cid, token, n, left): so many of each set's rarest elements that two sets of the similarity share one.

    Two sets of Jaccard similarity t share at least t * n elements of either, so under any common
    order their first n - ceil(t * n) + 1 elements meet.  The order here is by a hashed frequency
    table of fixed size, rare first: what many sets share comes last and pairs nothing.  ``left``
    is the number of the set's elements from the token on, itself included: no two sets share
    more than that if the token is the first that they share.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << FREQUENCY_BITS, np.int64)
        for batch in batches:
            for s in batch.column("set").to_pylist():
                np.add.at(n, _frequency_cell(np.frombuffer(s, np.uint64)), 1)
        cells = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n[cells])], names=["cell", "n"])
    table = map_batches(sets.select("set"), count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2**FREQUENCY_BITS rows
    often = np.zeros(1 << FREQUENCY_BITS, np.int64)
    often[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    sent = sets.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, tokens, ns, lefts = [], [], [], []
            for cid, s in zip(batch.column("cid").to_pylist(), batch.column("set").to_pylist()):
                s = np.frombuffer(s, np.uint64)
                size = len(s) - -(-percent * len(s) // 100) + 1
                first = s[np.lexsort((s, sent.value[_frequency_cell(s)]))[:size]]
                cids.append(np.full(len(first), cid, np.int64))
                tokens.append(first.view(np.int64))
                ns.append(np.full(len(first), len(s), np.int64))
                lefts.append(len(s) - np.arange(len(first), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c or [np.zeros(0, np.int64)])) for c in (cids, tokens, ns, lefts)],
                                             names=["cid", "token", "n", "left"])
    return map_batches(sets.select("cid", "set"), run, "cid long, token long, n long, left long")


def _frequency_cell(s: np.ndarray) -> np.ndarray:
    return (mix(s) >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)


def _with(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Links of the components found so far (each node to its label) and further ones."""
    return comp.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links)


def _link_open_buckets(docs: DataFrame, met: DataFrame, tested: DataFrame, links: DataFrame, reps: DataFrame,
                       k: int, percent: int) -> DataFrame:
    """(node, label) over the first stars' links and all that buckets in several components still hold.

    Further stars, each around another class of the bucket, join most of what lies apart at a
    cost in proportion to the bucket.  Once a round of them confirms few of its pairs, classes of
    different components are paired where their sets share one of their rarest elements (which
    sets of the wanted similarity must) and confirmed: that is exact for all classes in open
    buckets, so the result does not depend on how many rounds of stars came before.
    """
    sets = comp = None
    for turn in itertools.count():
        comp = written(components(links if comp is None else _with(comp, more)), "components")
        labelled = met.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("label", "cid").alias("label"))
        several = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        rest = written(labelled.join(several, "key", "left_semi"), "open-buckets")
        if turn and share < FEW_CONFIRMED or rest.isEmpty():
            break
        if sets is None:  # the later rounds' classes are among the first round's
            alone = rest.select("cid").distinct().withColumn("leader", F.col("cid")).withColumn("salt", F.lit(0))
            sets = written(_sets(docs, alone.join(reps.select("cid", "row_key", "d1"), "cid"), k).select("cid", "set").dropDuplicates(["cid"]), "open-sets")
        order = F.xxhash64("cid", F.lit(turn))
        centre = rest.groupBy("key").agg(F.min_by("cid", order).alias("leader"), F.min_by("label", order).alias("at"))
        star = rest.join(centre, "key").where("label <> at").select(F.least("leader", "cid").alias("leader"), F.greatest("leader", "cid").alias("cid"))
        star = written(star.distinct().join(tested, ["leader", "cid"], "left_anti"), "stars")
        more = written(confirm(star, lambda wanted: wanted.join(sets, "cid"), percent), "star-links")
        share = more.count() / max(1, star.count())
        tested = tested.unionByName(star)
    if sets is None:
        return comp
    still = rest.select("cid", "label").distinct()
    prefixes = written(_prefixes(sets.join(still.select("cid"), "cid", "left_semi"), percent).join(still, "cid"), "open-prefixes")
    x, y = prefixes.alias("x"), prefixes.alias("y")
    # At the first shared element at most the smaller ``left`` is shared; the similarity asks for this much.
    enough = (100 + percent) * F.least("x.left", "y.left") >= percent * (F.col("x.n") + F.col("y.n"))
    across = (x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.cid") < F.col("y.cid")) & (F.col("x.label") != F.col("y.label")) & enough)
              .select(F.col("x.cid").alias("leader"), F.col("y.cid").alias("cid")).distinct()
              .join(tested, ["leader", "cid"], "left_anti"))
    more = written(confirm(written(across, "open-pairs"), lambda wanted: wanted.join(sets, "cid"), percent), "open-links")
    return comp if more.isEmpty() else written(components(_with(comp, more)), "components")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """uid, row_key, doc_id, n_shingles, component_id, keeper per document.

    component_id is the smallest doc_id reachable over links of at least ``percent`` per cent
    Jaccard similarity on sets of k-word shingles; keeper marks exactly one row per component.
    """
    docs = docs.select("doc_id", "text")
    sig = written(signatures(docs, k, bands, rows), "signatures")
    some = sig.where("n > 0")
    classes = some.groupBy("d1", "d2", "n").agg(F.min("uid").alias("cid"), F.min("doc_id").alias("least_id"))
    reps = written(some.join(classes.select(F.col("cid").alias("uid")), "uid", "left_semi")
                   .select(F.col("uid").alias("cid"), "row_key", "d1", "bands"), "classes")
    buckets = reps.select("cid", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("cid").alias("leader"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = written(buckets.join(shared, "key"), "buckets")
    stars = met.where("cid <> leader").select("leader", "cid").distinct()
    # A repeated row has its twin's key, so the look-up by key may give a set twice.
    links = written(confirm(stars, lambda wanted: _sets(docs, wanted.join(reps.select("cid", "row_key", "d1"), "cid"), k)
                            .dropDuplicates(["leader", "salt", "cid"]), percent), "star-links")
    comp = _link_open_buckets(docs, met.select("key", "cid"), stars, links, reps, k, percent)

    of_class = (classes.join(comp.withColumnRenamed("node", "cid"), "cid", "left")
                .select("d1", "d2", "n", "least_id", F.coalesce("label", "cid").alias("component")))
    group = of_class.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = of_class.drop("least_id").join(group, "component")
    rows_of = (sig.drop("bands").join(known, ["d1", "d2", "n"], "left")
               .withColumn("component", F.coalesce("component", "uid"))
               .withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))))
    at_least = rows_of.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keepers = at_least.groupBy("component").agg(F.min("uid").alias("keeper_uid"))
    return (rows_of.join(keepers, "component", "left")
            .select("uid", "row_key", "doc_id", F.col("n").alias("n_shingles"), "component_id",
                    (F.col("uid") == F.col("keeper_uid")).alias("keeper")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, one of each group of near duplicates; documents without words all stay, repeated ones too."""
    kept = near_duplicates(docs, k, percent).where("keeper and n_shingles > 0").select("row_key").distinct()
    cols = docs.columns
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], row_key(docs).alias("row_key"),
                        F.coalesce(docs["text"].rlike(A_WORD), F.lit(False)).alias("worded"))
    # A keeper's exact twin rows share its key: one of them stays.
    worded = keyed.where("worded").join(kept, "row_key").dropDuplicates(["row_key"])
    return worded.unionByName(keyed.where("not worded")).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
