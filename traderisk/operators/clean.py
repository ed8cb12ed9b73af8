"""Cleaning and the country-risk month join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traderisk.functions.scalar import strip_upper
from traderisk.functions.stats import weighted_medians
from traderisk.operators.joins import join_dimension

CRITICAL_COLUMNS = ["buyer_id", "buyer_country", "hs_code", "invoice_value_usd"]
RISK_FILL_COLUMNS = ["political_stability_score", "currency_volatility_index"]


def drop_incomplete(shipments: DataFrame) -> DataFrame:
    """B1: drop rows missing any critical field."""
    return shipments.na.drop(subset=CRITICAL_COLUMNS)


def drop_report(shipments: DataFrame) -> DataFrame:
    """B1 report: rows in, rows kept, rows dropped — one aggregate, one row."""
    incomplete = None
    for c in CRITICAL_COLUMNS:
        cond = F.col(c).isNull()
        incomplete = cond if incomplete is None else (incomplete | cond)
    return shipments.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(incomplete).alias("rows_dropped")) \
        .withColumn("rows_kept", F.col("rows_in") - F.col("rows_dropped"))


SHIPMENT_COLUMNS = ["shipment_id", "exporter_id", "buyer_id", "buyer_country", "hs_code", "product_category",
                    "shipment_date", "invoice_value_usd", "payment_terms", "payment_delay_days", "was_disputed",
                    "was_paid_in_full"]


def clean_shipments(shipments: DataFrame) -> DataFrame:
    """B1 → B2 → B3: drop incomplete rows, strip+upper the country, add the month key."""
    return drop_incomplete(shipments).select(
        *[strip_upper(c).alias(c) if c == "buyer_country" else F.col(c) for c in SHIPMENT_COLUMNS],
        F.trunc("shipment_date", "MM").alias("shipment_month"))


def clean_country_risk(country_risk: DataFrame) -> DataFrame:
    """B2 on the right-hand table."""
    return country_risk.withColumn("country", strip_upper("country"))


def _risk_side(country_risk: DataFrame) -> DataFrame:
    return clean_country_risk(country_risk).select(
        F.col("country").alias("_cr_country"), F.col("month").alias("_cr_month"),
        "political_stability_score", "currency_volatility_index", "trade_sanctions_flag")


def _join_cond(left: DataFrame, right: DataFrame):
    return (left["buyer_country"] == right["_cr_country"]) & (left["shipment_month"] == right["_cr_month"])


def country_risk_medians(clean: DataFrame, country_risk: DataFrame) -> DataFrame:
    """One-row medians of stability and volatility over the joined rows.

    Shipments are counted per (country, month) — a map-side-combined aggregate
    bounded by the panel size — and the risk rows matching each key are
    weighted by that count; the weighted table is a histogram of the joined
    values, so the exact median needs no second pass over the rows.
    """
    right = _risk_side(country_risk)
    keys = clean.groupBy("buyer_country", "shipment_month").agg(F.count(F.lit(1)).alias("_w"))
    weighted = keys.join(right, _join_cond(keys, right), "inner").select(*RISK_FILL_COLUMNS, "_w")
    return weighted_medians(weighted, RISK_FILL_COLUMNS, "_w")


def fill_country_risk(joined: DataFrame, medians: DataFrame) -> DataFrame:
    """B4 + B5: medians into missing scores, 0 into a missing sanctions flag."""
    # A global aggregate has exactly one row: a proven bound, so it is broadcast.
    cols = list(joined.columns)
    filled = joined.crossJoin(F.broadcast(medians))
    fills = {c: F.coalesce(F.col(c), F.col(f"{c}_median")) for c in RISK_FILL_COLUMNS}
    fills["trade_sanctions_flag"] = F.coalesce(F.col("trade_sanctions_flag"), F.lit(0)).cast("int")
    return filled.select(*[fills[c].alias(c) if c in fills else F.col(c) for c in cols])


def join_country_risk(clean: DataFrame, country_risk: DataFrame, fill: bool = True) -> DataFrame:
    """C1 + B4 + B5: left join on (country, month), then fill the gaps.

    Right-side duplicates fan out, as in a SQL join.  The medians used for the
    fill are over the *joined rows* (shipment-weighted), but are computed without
    materialising the join twice: shipments are first counted per (country,
    month) — a map-side-combined aggregate whose size is bounded by the panel —
    and those counts weight the risk values in an exact weighted median.
    """
    right = _risk_side(country_risk)
    joined = join_dimension(clean, right, _join_cond(clean, right), "left").drop("_cr_country", "_cr_month")
    if not fill:
        return joined
    return fill_country_risk(joined, country_risk_medians(clean, country_risk))
