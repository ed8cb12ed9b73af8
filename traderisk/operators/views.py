"""The three warehouse views and the leaderboard.

All are grouped aggregates or projections: partial aggregation runs map-side,
so a hot buyer or HS code costs one pre-aggregated row per map task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traderisk import constants as K
from traderisk.functions.scalar import half_up, safe_rate


def _as_of(as_of) -> Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, (dt.date, str)):
        return F.lit(str(as_of)).cast("date")
    return as_of


def mean_as_double(c) -> Column:
    """Mean as DOUBLE(sum) / count — exact sums for DECIMAL inputs."""
    x = F.col(c) if isinstance(c, str) else c
    return safe_rate(F.sum(x), F.count(x))


def buyer_risk_summary(shipments: DataFrame, as_of=None) -> DataFrame:
    """D3 + S3 + B11: one row per (buyer, country) with rates and a 0–100 score."""
    n = F.count(F.lit(1))
    dispute = safe_rate(F.sum(F.col("was_disputed").cast("int")), n)
    paid = safe_rate(F.sum(F.col("was_paid_in_full").cast("int")), n)
    avg_delay = F.avg("payment_delay_days")
    stats = shipments.groupBy("buyer_id", "buyer_country").agg(
        n.alias("total_shipments"),
        F.sum("invoice_value_usd").cast("double").alias("total_value"),
        avg_delay.alias("avg_delay_days"),
        dispute.alias("dispute_rate"),
        paid.alias("paid_in_full_rate"),
        F.max("shipment_date").alias("last_shipment"),
    )
    score = half_up(F.col("avg_delay_days") / F.lit(180.0) * F.lit(30.0)
                    + F.col("dispute_rate") * F.lit(40.0)
                    + (F.lit(1.0) - F.col("paid_in_full_rate")) * F.lit(30.0), 1)
    s = F.col("risk_score")
    # SQL CASE semantics: a NULL score falls through to the ELSE branch.
    category = (F.when(s < K.LOW_BAND_UPPER, F.lit(K.CATEGORY_LOW))
                .when(s < K.MEDIUM_BAND_UPPER, F.lit(K.CATEGORY_MEDIUM))
                .otherwise(F.lit(K.CATEGORY_HIGH)))
    return (stats.withColumn("days_since_last_order", F.datediff(_as_of(as_of), F.col("last_shipment")))
                 .withColumn("risk_score", score)
                 .withColumn("risk_category", category))


def buyer_risk_leaderboard(summary: DataFrame, n: int = K.LEADERBOARD_SIZE) -> DataFrame:
    """top-n by risk_score (non-null), ties by buyer then country.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps n
    rows, so only n × tasks rows ever reach the final merge.
    """
    return (summary.where(F.col("risk_score").isNotNull())
            .orderBy(F.col("risk_score").desc(), F.col("buyer_id").asc(), F.col("buyer_country").asc())
            .limit(n))


def country_risk_trend(country_risk: DataFrame, ordered: bool = True) -> DataFrame:
    """S4 (+ F1): composite 0–100 country index per (country, month)."""
    idx = half_up((F.lit(1.0) - F.col("political_stability_score")) * F.lit(50.0)
                  + F.col("currency_volatility_index") * F.lit(40.0)
                  + F.col("trade_sanctions_flag") * F.lit(10), 1)
    out = country_risk.select("country", "month", "political_stability_score", "currency_volatility_index",
                              "trade_sanctions_flag", idx.alias("composite_risk_index"))
    return out.orderBy("country", "month") if ordered else out


def shipment_outcomes_by_hs_code(shipments: DataFrame, ordered: bool = True) -> DataFrame:
    """D4 (+ F2): outcomes per (hs_code, product_category)."""
    n = F.count(F.lit(1))
    terms = F.col("payment_terms")
    out = shipments.groupBy("hs_code", "product_category").agg(
        n.alias("total_shipments"),
        F.sum("invoice_value_usd").cast("double").alias("total_value_usd"),
        half_up(mean_as_double("invoice_value_usd"), 0).alias("avg_invoice_value"),
        half_up(F.avg("payment_delay_days"), 1).alias("avg_delay_days"),
        safe_rate(F.sum(F.col("was_disputed").cast("int")), n).alias("dispute_rate"),
        safe_rate(F.sum(F.col("was_paid_in_full").cast("int")), n).alias("paid_in_full_rate"),
        F.count_if(terms == "advance").alias("advance_count"),
        F.count_if(terms == "lc").alias("lc_count"),
        F.count_if(terms.like("credit_%")).alias("credit_count"),
    )
    return out.orderBy(F.col("total_value_usd").desc()) if ordered else out


def register_views(spark: SparkSession, shipments: DataFrame, country_risk: DataFrame, as_of=None) -> list[str]:
    """Create-or-replace the three views as temp views."""
    buyer_risk_summary(shipments, as_of).createOrReplaceTempView("buyer_risk_summary")
    country_risk_trend(country_risk).createOrReplaceTempView("country_risk_trend")
    shipment_outcomes_by_hs_code(shipments).createOrReplaceTempView("shipment_outcomes_by_hs_code")
    return ["buyer_risk_summary", "country_risk_trend", "shipment_outcomes_by_hs_code"]
