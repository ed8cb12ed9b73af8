"""Deterministic mapping of the driver's star-schema tables onto the domain
tables (shipments, country_risk, deals).  See FIXTURES.md §2.

Plans are declarative: the big joins (lineitem ⋈ part, ⋈ (orders ⋈ customer))
are left to Catalyst/AQE (sort-merge or a runtime broadcast when a side turns
out small); only ``nation`` — bounded by the number of countries — is hinted.
Rows travel as the few source columns they need: customers meet the orders,
which are fewer than the lines, and names and derived texts come after the last shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _priority_digit() -> Column:
    return F.substring(F.col("o_orderpriority"), 1, 1)


def _padded(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(key).cast("string"), 8, "0"))


def build_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_type")

    placed = orders.join(customer, orders.o_custkey == customer.c_custkey).drop("o_custkey")
    rows = (li.join(part, li.l_partkey == part.p_partkey).drop("p_partkey")
              .join(placed, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey"))
    # A buyer's rows meet in few files, so that aggregates by buyer shrink before their shuffle; AQE
    # cuts a partition that a large buyer makes too big.
    rows = rows.hint("rebalance", F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))

    digit = _priority_digit()
    rt = (F.when(F.col("c_custkey") % 10 < 2, 2).when(F.col("c_custkey") % 10 < 5, 1).otherwise(0))
    base = (F.when(digit == "1", 0).when(digit == "2", 15).when(digit == "3", 30)
             .when(digit == "4", 60).otherwise(90))
    days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    jitter = ((days % 41) + 41) % 41 - 20
    h1 = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_linenumber") * 31 + F.col("l_orderkey") * 3) % 100
    h2 = (F.col("l_partkey") * 11 + F.col("l_suppkey") * 17 + F.col("l_linenumber") * 5 + F.col("l_orderkey") * 19) % 100
    terms = (F.when(digit == "1", "advance").when(digit == "2", "lc").when(digit == "3", "credit_30")
              .when(digit == "4", "credit_60").otherwise("credit_90"))

    staged = rows.select(
        F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
                    F.date_format(F.col("l_shipdate"), "yyyyMMdd")).alias("shipment_id"),
        _padded("exporter_", "l_suppkey").alias("exporter_id"),
        _padded("buyer_", "c_custkey").alias("buyer_id"),
        F.col("n_name").alias("buyer_country"),
        (F.col("l_partkey") % 21 + 1).cast("int").alias("hs_code"),
        F.col("p_type").alias("product_category"),
        F.col("l_shipdate").cast("date").alias("shipment_date"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("invoice_value_usd"),
        terms.alias("payment_terms"),
        F.greatest(F.lit(0), base + F.when(rt == 2, 20).when(rt == 1, 5).otherwise(0) + jitter)
         .cast("int").alias("payment_delay_days"),
        rt.alias("_rt"), h1.alias("_h1"), h2.alias("_h2"),
    )
    delay = F.col("payment_delay_days")
    disputed = (F.col("_h1") < (F.when(F.col("_rt") == 2, 12).when(F.col("_rt") == 1, 4).otherwise(1)
                                + F.when(delay > 120, 10).when(delay > 60, 5).otherwise(0))).cast("int")
    staged = staged.withColumn("was_disputed", disputed)
    paid = (F.col("_h2") < F.when(F.col("was_disputed") == 1, 20).when(F.col("_rt") == 2, 70)
            .when(F.col("_rt") == 1, 88).otherwise(97)).cast("int")
    return staged.withColumn("was_paid_in_full", paid).drop("_rt", "_h1", "_h2")


def build_country_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", "l_discount")
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Two numbers a supplier: small enough for the planner's broadcast far longer than with names.
    rows = li.join(supplier, li.l_suppkey == supplier.s_suppkey)
    month = F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("month")
    by_key = rows.groupBy("s_nationkey", month).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum((F.col("l_returnflag") != "R").cast("int")).alias("_not_returned"),
        F.sum(F.round(F.col("l_discount") * 100).cast("int")).alias("_disc_pts"),
    )
    agg = (by_key.join(F.broadcast(nation), by_key.s_nationkey == nation.n_nationkey)
           .groupBy("n_name", "n_nationkey", "month")
           .agg(*[F.sum(c).alias(c) for c in ("_n", "_not_returned", "_disc_pts")]))
    key = F.col("n_nationkey")

    def bounded(num: Column) -> Column:
        return F.least(F.floor(num.cast("double") / F.col("_n")), F.lit(10000)) / F.lit(10000.0)

    return agg.select(
        F.col("n_name").alias("country"),
        F.col("month"),
        bounded(F.lit(1000) * (F.lit(2) + F.lit(3) * (key % 5)) * F.col("_not_returned")).alias("political_stability_score"),
        bounded(F.lit(400) * (F.lit(1) + key % 3) * F.col("_disc_pts")).alias("currency_volatility_index"),
        F.when(key % 12 == 0, 1).otherwise(0).cast("int").alias("trade_sanctions_flag"),
    )


def build_deals(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Deals from orders; ``orders`` may be a streaming DataFrame."""
    if orders is None:
        orders = _read(spark, sf_dir, "orders")
    orders = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey))
    k = F.col("o_orderkey")
    return rows.select(
        k.alias("deal_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("deal_ts"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 7 == 1, F.lit("buyer_unknown"))
         .otherwise(_padded("buyer_", "c_custkey")).alias("buyer_id"),
        F.when(k % 11 == 0, F.lit("Atlantis")).otherwise(F.concat(F.lit(" "), F.lower(F.col("n_name"))))
         .alias("buyer_country"),
        (k % 21 + 1).cast("int").alias("hs_code"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("invoice_value_usd"),
        F.lit(None).cast("string").alias("product_category"),
        F.lit("credit_30").alias("payment_terms"),
    )
