"""C3 with hot, unknown and missing buyers: same rows as a plain join, and no task that holds one buyer."""

import statistics

import pytest
from pyspark.sql import functions as F

from traderisk.operators.joins import attach_by_key


@pytest.fixture(scope="module")
def deals(spark):
    """Half of the deals on one known buyer, a third without a buyer, a tenth on an unknown one, the rest spread."""
    i = F.col("id")
    buyer = (F.when(i % 30 < 15, F.lit("hot")).when(i % 30 < 25, F.lit(None).cast("string")).when(i % 30 < 28, F.lit("unknown"))
             .otherwise(F.concat(F.lit("b"), (i % 997).cast("string"))))
    return spark.range(60_000).select(i.alias("deal_id"), buyer.alias("buyer_id"))


@pytest.fixture(scope="module")
def profile(spark):
    rows = spark.range(900).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("buyer_id"), (F.col("id") * 2).alias("orders"))
    return rows.unionByName(spark.sql("SELECT 'hot' AS buyer_id, 7L AS orders")).withColumn("_tag", F.lit("x"))


@pytest.mark.parametrize("hot_rows", [None, 0, 10**9])
def test_equals_a_plain_left_join(deals, profile, hot_rows):
    got = attach_by_key(deals, profile, "buyer_id", hot_rows)
    assert got.columns == ["deal_id", "buyer_id", "orders", "_tag"]
    want = deals.join(profile, "buyer_id", "left").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_task_holds_a_buyer(spark, deals, profile):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach_by_key(deals, profile, "buyer_id")
        tasks = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(tasks) == 60_000
    # The tasks of the scan keep the hot rows evenly; those of the join have only the others.
    assert max(tasks) <= 60_000 / 8 + 1 and statistics.median(tasks) > 0


def test_empty_sides(deals, profile):
    assert attach_by_key(deals.where("false"), profile, "buyer_id").count() == 0
    got = attach_by_key(deals, profile.where("false"), "buyer_id")
    assert got.count() == 60_000 and got.where("orders IS NOT NULL").count() == 0
