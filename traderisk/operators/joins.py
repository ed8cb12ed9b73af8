"""Joins of a fact table to a dimension table, bounded and unbounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more than this part of all fact rows is joined from a broadcast list:
# fewer than HOT_KEYS keys can have that many.
HOT_KEYS = 1_000


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a fact table to a dimension table.

    By default no hint is given: the planner broadcasts the dimension only when
    its estimated size (Parquet file sizes through the plan) is under
    ``spark.sql.autoBroadcastJoinThreshold``, AQE re-checks with the measured
    size at run time, and beyond either bound the join stays sort-merge with
    skewed partitions split.
    """
    return fact.join(dim, on, how)


def attach_by_key(fact: DataFrame, dim: DataFrame, key: str, hot_rows: int | None = None) -> DataFrame:
    """``fact`` left-joined to ``dim`` (one row per ``key``), whatever the keys' frequencies.

    Rows without a key never reach a join: they get NULLs.  Keys with more than
    1 / HOT_KEYS of all rows (or more than ``hot_rows`` rows) — known to ``dim`` or
    not — take their values from a broadcast list of fewer than HOT_KEYS rows.
    Only the other rows are shuffled (or broadcast-joined, if ``dim`` is small), and
    none of their keys is hot.  A streaming ``fact`` is joined as it is: a
    micro-batch cannot be counted first.
    """
    values = [c for c in dim.columns if c != key]
    if fact.isStreaming:
        return fact.join(dim, key, "left").select(*fact.columns, *values)
    counts = fact.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    if hot_rows is None:
        total = counts.agg(F.sum("_rows").alias("_all"))  # 1 row
        hot = counts.crossJoin(F.broadcast(total)).where(F.col("_rows") * F.lit(HOT_KEYS) > F.col("_all")).select(key)
    else:
        hot = counts.where(F.col("_rows") > hot_rows).select(key)
    # dim is scanned once for the hot keys: they are the broadcast side of a semi join.
    hot_values = hot.join(dim.join(F.broadcast(hot), key, "left_semi"), key, "left").withColumn("_hot", F.lit(True))
    flagged = fact.join(F.broadcast(hot_values), key, "left")
    done = flagged.where(F.col("_hot") | F.col(key).isNull()).select(*fact.columns, *values)
    rest = flagged.where(F.col("_hot").isNull() & F.col(key).isNotNull()).select(*fact.columns)
    return done.unionByName(rest.join(dim, key, "left").select(*fact.columns, *values))
