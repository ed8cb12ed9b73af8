"""Steps whose shuffles the larger tables feel: ingest, ranking, split label, modes."""

import datetime as dt
import re

from conftest import SF_SMALL, ship

from pyspark.sql import functions as F

from traderisk.operators import features as FE
from traderisk.operators import history as H
from traderisk.operators import model as M
from traderisk.operators import ordering as O
from traderisk.sources import fixtures
from traderisk.sources.tables import tables


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_shipments_meet_by_buyer_and_customers_meet_the_orders(spark):
    df = fixtures.build_shipments(spark, SF_SMALL)
    plan = _plan(df)
    assert len(re.findall(r"Exchange hashpartitioning\(c_custkey#\d+L?, \d+\), REBALANCE_PARTITIONS_BY_COL", plan)) == 1
    # No derived text is made before the rows' last shuffle.
    assert plan.index("exporter_") < plan.index("REBALANCE_PARTITIONS_BY_COL")
    logical = df._jdf.queryExecution().optimizedPlan().toString()
    custkeys = [line for line in logical.splitlines() if "Join Inner" in line and "c_custkey" in line]
    assert len(custkeys) == 1 and "o_custkey" in custkeys[0]


def test_months_of_risk_are_summed_before_the_nation_is_named(spark, tmp_path):
    """Two nations of one name stay apart by key; a nation listed twice counts twice, as in a join of the rows."""
    d = dt.datetime(2024, 3, 5)
    spark.createDataFrame([(1, d, "R", 0.04), (1, d, "N", 0.02), (2, d, "N", 0.05), (3, d, "N", 0.05)],
                          "l_suppkey long, l_shipdate timestamp_ntz, l_returnflag string, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 10), (2, 11), (3, 99)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(10, "X"), (11, "X"), (11, "X")], "n_nationkey long, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    df = fixtures.build_country_risk(spark, str(tmp_path))
    rows = sorted(tuple(r) for r in df.collect())
    assert [r[:2] for r in rows] == [("X", dt.date(2024, 3, 1))] * 2
    # Nation 10: one of two lines not returned; nation 11: its line, listed twice.
    assert sorted(r[2] for r in rows) == [(1000 * 2 * 1 // 2) / 10000, 1000 * 5 / 10000]
    # Lines are aggregated by two numbers; no name travels with them.
    assert re.search(r"partial_count\(1\)", _plan(df)) and "keys=[s_nationkey#" in _plan(df)


def test_only_buyers_of_several_blocks_have_carry_rows(spark, make_shipments):
    rows = [ship(f"h{i:03d}", buyer_id="hot", date=None if i % 7 == 0 else dt.date(2024, 1, 1) + dt.timedelta(i % 50), delay=i) for i in range(200)]
    rows += [ship(f"s{i:03d}", buyer_id=f"b{i % 20:02d}", delay=i) for i in range(60)] + [ship("n", buyer_id=None)]
    df = make_shipments(rows)
    columns = ["shipment_id", "buyer_id", "shipment_date", "payment_delay_days"]
    carry = O.block_totals(O.with_blocks(df, columns, 16), {"delay": "payment_delay_days"})
    assert {r.buyer_id for r in carry.collect()} == {"hot"}
    ranked = O.rank_and_rollup(df, {"delay": "payment_delay_days"}, heavy_rows=16).collect()
    assert len(ranked) == 260
    for buyer in ("hot", "b00", "b19"):
        mine = [r for r in rows if r[2] == buyer]
        order = sorted(mine, key=lambda r: (r[6] is None, r[6] or dt.date.min, r[0]), reverse=True)
        got = {r.shipment_id: r for r in ranked if r.buyer_id == buyer}
        assert [got[r[0]].buyer_order_rank for r in order] == list(range(1, len(mine) + 1))
        assert {(r._buyer_rows, r._s_delay_total, r._c_delay_total) for r in got.values()} == {(len(mine), sum(r[9] for r in mine), len(mine))}


def test_split_label_is_the_split_of_the_ordinals(spark):
    feats = spark.range(1, 400).select(F.concat(F.lit("s"), "id").alias("shipment_id"),
                                       F.concat(F.lit("b"), (F.col("id") * 7 % 13).cast("string")).alias("buyer_id"))
    feats = feats.withColumn("buyer_order_rank", F.expr("row_number() OVER (PARTITION BY buyer_id ORDER BY shipment_id)").cast("long"))
    for fraction in (0.0, 0.31, 0.8, 1.0):
        whole = {r.shipment_id: r.split for r in FE.positional_split(feats, fraction).collect()}
        label = {r.shipment_id: r.split for r in FE.positional_label(feats, fraction).collect()}
        assert whole == label and len(label) == 399
    # Exactly between two buyers.
    even = feats.where("buyer_id IN ('b1', 'b2')").groupBy("buyer_id").count().collect()
    both = feats.where("buyer_id IN ('b1', 'b2')")
    cut = {r.buyer_id: r["count"] for r in even}["b1"] / both.count()
    assert {(r.buyer_id, r.split) for r in FE.positional_label(both, cut).collect()} == {("b1", "train"), ("b2", "test")}


def test_training_frame_neither_joins_nor_shuffles_its_rows(spark):
    t = tables(spark, SF_SMALL)
    frame = M.training_frame(FE.engineer_features(t.shipments, t.country_risk))
    plan = _plan(frame)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert "BroadcastNestedLoopJoin" in plan  # one row


def test_history_modes_carry_counts_only(spark, make_shipments):
    t = tables(spark, SF_SMALL)
    plan = _plan(H.buyer_history(t.shipments))
    assert "Generate explode" not in plan
    for line in plan.splitlines():
        if "product_category" in line and "HashAggregate" in line:
            assert "payment_delay_days" not in line and "invoice_value_usd" not in line
    rows = [ship("a", buyer_id="b", category=None, country=None), ship("b", buyer_id="b", category="Z"), ship("c", buyer_id="b", category="A"),
            ship("d", buyer_id=None, invoice=10_000.0), ship("e", buyer_id="empty", category=None, country=None)]
    out = {r.buyer_id: r for r in H.buyer_history(make_shipments(rows)).collect()}
    assert set(out) == {"b", "empty"} and out["b"].primary_category == "A" and out["b"].primary_country == "INDIA"
    assert out["empty"].primary_category is None and out["b"].value_trend == "declining"


def test_first_shipments_sort_rows_of_first_days_only(spark, make_shipments):
    rows = [ship(f"s{b:02d}-{i * 37 % 60:02d}", buyer_id=f"b{b:02d}", country=f"C{i % 5}", category=f"P{i % 7}",
                 date=None if i % 11 == 0 else dt.date(2024, 1, 1) + dt.timedelta((i * 13 + b) % 29)) for b in range(40) for i in range(60)]
    rows += [ship("u2", buyer_id="undated", country="B", category="B", date=None), ship("u1", buyer_id="undated", country="A", category=None, date=None),
             ship("last", buyer_id="last", date=None), ship("day", buyer_id="last", country="Z", date=dt.date(9999, 12, 31)),
             ship("n2", buyer_id=None, country="X"), ship("n1", buyer_id=None, country="Y")]
    df = make_shipments(rows)

    def key(r):
        return r[6] or dt.date.max, r[6] is None
    first = {b: min((r for r in rows if r[2] == b), key=lambda r: (*key(r), r[0])) for b in {r[2] for r in rows}}
    for cells in (64, 4096, H.FIRST_DAY_CELLS):
        got = {r.buyer_id: (r.first_country, r.first_category) for r in H.buyer_first_shipment(df, cells).collect()}
        assert got == {b: (r[3], r[5]) for b, r in first.items()}
    # Few rows but those of first days reach the sort of min_by.
    days = sum(key(r) == key(first[r[2]]) for r in rows)
    assert days <= H._first_day_rows(df, H.FIRST_DAY_CELLS).count() <= days + 5 < len(rows) / 10
    plan = _plan(H.buyer_first_shipment(df))
    assert plan.index("partial_min_by") < plan.index("BroadcastHashJoin")
