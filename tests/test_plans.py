"""Plan-shape checks: the scale properties the design relies on stay true."""

import re
import statistics

from conftest import SF_SMALL, risk, ship

from pyspark.sql import functions as F

from traderisk.operators import clean as C
from traderisk.operators import features as FE
from traderisk.operators import ordering as O
from traderisk.sources.tables import tables


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_pipeline_ranks_by_buyer_block_never_buyer_alone(spark):
    t = tables(spark, SF_SMALL)
    plan = _plan(FE.engineer_features(t.shipments, t.country_risk))
    # Rows and the carry table meet on (buyer, block): one exchange of the rows,
    # two of the small carry table (its group-by and the re-key for the join).
    assert len(re.findall(r"Exchange hashpartitioning\(buyer_id#\d+, _block#\d+", plan)) <= 3
    # The row-level rank is never partitioned by buyer alone; only the bounded sample of keys is.
    specs = re.findall(r"row_number\(\) windowspecdefinition\(buyer_id#\d+, (_?\w+)#", plan)
    assert specs and set(specs) <= {"_block", "_key"}
    # The country-risk side is broadcast by the planner's size check (no hint needed).
    assert "BroadcastHashJoin" in plan and "ShuffledHashJoin" in plan


def test_rolling_features_shuffle_rows_twice_without_a_self_join(spark):
    t = tables(spark, SF_SMALL)
    plan = _plan(FE.rolling_buyer_features(C.clean_shipments(t.shipments)))
    # Only the carry table is joined: by (buyer, block), and the splits by broadcast.
    assert len(re.findall(r"(SortMergeJoin|ShuffledHashJoin) ", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(buyer_id#\d+, _halo#\d+", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(buyer_id#\d+, _block#\d+", plan)) <= 3


def test_undated_hot_buyer_is_spread_over_all_tasks(spark):
    """A third of all rows: one buyer, no dates.  The rows as they are dealt to the ranking tasks."""
    n = 60_000
    rows = spark.range(n).select(
        F.format_string("id%06d", "id").alias("shipment_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("b"), F.pmod(F.xxhash64("id"), F.lit(700)))).alias("buyer_id"),
        F.when(F.col("id") % 3 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 90).cast("int"))).alias("shipment_date"),
        F.lit(1).alias("payment_delay_days"))
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = O.rank_and_rollup(rows, {"delay": "payment_delay_days"})
        tasks = [r["count"] for r in ranked.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        hot = ranked.where("buyer_id = 'hot'").agg(F.count_distinct("buyer_order_rank"), F.max("buyer_order_rank"),
                                                   F.min("_buyer_rows"), F.min("_s_delay_total")).first()
        first = ranked.where("buyer_id = 'hot' AND buyer_order_rank = 1").first()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert sum(tasks) == n and max(tasks) <= 2 * statistics.median(tasks), sorted(tasks)
    assert tuple(hot) == (n // 3,) * 4
    assert first["shipment_id"] == f"id{n - 3:06d}"


def test_fill_medians_come_from_a_bounded_weight_table(spark):
    t = tables(spark, SF_SMALL)
    plan = _plan(C.country_risk_medians(C.clean_shipments(t.shipments), t.country_risk))
    assert "percentile" in plan and "partial_count" in plan


def test_top_countries_side_is_a_ten_row_list(spark):
    from traderisk.operators import dashboards as D
    t = tables(spark, SF_SMALL)
    plan = _plan(D.country_risk_over_time(t.shipments, t.country_risk))
    # the semi-join side is the 10-row top list
    assert "TakeOrderedAndProject(limit=10" in plan and "LeftSemi" in plan


def test_profile_scans_each_table_once_and_modes_need_no_buffer(spark):
    from traderisk.operators import history as H
    t = tables(spark, SF_SMALL)
    plan = _plan(H.dataset_profile(t.shipments, t.country_risk))
    assert plan.count("FileScan parquet") == 2 and "Join" not in plan and "CartesianProduct" not in plan
    plan = _plan(H.buyer_history(t.shipments))
    assert "mode(" not in plan and "ObjectHashAggregate" not in plan
    # The widest shuffle is of (buyer, country, category) counts, partially aggregated; rows are never shuffled.
    assert "Exchange hashpartitioning(buyer_id#" in plan and "partial_count(1)" in plan
