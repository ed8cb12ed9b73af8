"""Dashboard tables, look-ups and roll-ups (C4, D8, D9, B15, E4, S15, B9, B10,
E3, D10, F5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traderisk import constants as K
from traderisk import schemas
from traderisk.functions.scalar import half_up, safe_rate, stability_band, strip_upper
from traderisk.functions.stats import exact_mean_scaled
from traderisk.operators.history import buyer_history
from traderisk.operators.views import buyer_risk_summary, country_risk_trend


# ---------------------------------------------------------------------------
# Charts
# ---------------------------------------------------------------------------
def top_countries_by_volume(shipments: DataFrame, n: int = K.TOP_COUNTRIES) -> DataFrame:
    """C4 helper: the n countries with the largest invoice total (ties by name)."""
    volume = (shipments.where(F.col("buyer_country").isNotNull())
              .groupBy(strip_upper("buyer_country").alias("country"))
              .agg(F.sum("invoice_value_usd").alias("trade_volume")))
    return volume.orderBy(F.col("trade_volume").desc(), F.col("country")).limit(n)


def country_risk_over_time(shipments: DataFrame, country_risk: DataFrame, n: int = K.TOP_COUNTRIES) -> DataFrame:
    """D8 + C4: mean composite index per (month, country) for the top-n countries.

    The top-n list has n rows (a proven bound), so it is broadcast into a
    left-semi join; the index is averaged over its one-decimal integer tenths.
    """
    top = top_countries_by_volume(shipments, n).select("country")
    trend = country_risk_trend(country_risk, ordered=False).withColumn("country", strip_upper("country"))
    kept = trend.join(F.broadcast(top), "country", "left_semi")
    return kept.groupBy("month", "country").agg(
        exact_mean_scaled("composite_risk_index", 1).alias("avg_composite_risk_index"),
        F.count(F.lit(1)).alias("n_points"),
    )


def exposure_by_category(shipments: DataFrame) -> DataFrame:
    """Total value and shipment-weighted dispute rate per product category."""
    n = F.count(F.lit(1))
    return (shipments.groupBy("product_category")
            .agg(F.sum("invoice_value_usd").cast("double").alias("total_value_usd"),
                 n.alias("total_shipments"),
                 safe_rate(F.sum(F.col("was_disputed").cast("int")), n).alias("dispute_rate"))
            .orderBy(F.col("total_value_usd").desc()))


def hs_sections(spark: SparkSession) -> DataFrame:
    """The fixed 21-row HS section table."""
    return spark.createDataFrame(K.HS_SECTIONS, schemas.HS_SECTION)


def exposure_by_hs_section(spark: SparkSession, shipments: DataFrame) -> DataFrame:
    """Exposure per HS code with its section label (21-row broadcast side)."""
    n = F.count(F.lit(1))
    per_code = shipments.groupBy("hs_code").agg(
        n.alias("total_shipments"),
        F.sum("invoice_value_usd").cast("double").alias("total_value_usd"),
        safe_rate(F.sum(F.col("was_disputed").cast("int")), n).alias("dispute_rate"),
    )
    return per_code.join(F.broadcast(hs_sections(spark)), "hs_code", "left").orderBy("hs_code")


def country_trend_last12(country_risk: DataFrame, months: int = K.TREND_LAST_MONTHS) -> DataFrame:
    """E4 + B14: each country's last 12 months, newest first, with a stability band.

    Partitions are countries of a country × month panel (bounded per country);
    the rank filter plans as a WindowGroupLimit before the shuffle.
    """
    trend = country_risk_trend(country_risk, ordered=False).withColumn("country", strip_upper("country"))
    w = Window.partitionBy("country").orderBy(F.col("month").desc())
    ranked = trend.withColumn("months_back", F.row_number().over(w).cast("long")).where(F.col("months_back") <= months)
    return ranked.select("country", "month", "months_back", "political_stability_score",
                         stability_band("political_stability_score").alias("stability_band"),
                         "currency_volatility_index", "trade_sanctions_flag", "composite_risk_index")


# ---------------------------------------------------------------------------
# Look-ups (whole-table by default; an id narrows the scan)
# ---------------------------------------------------------------------------
def buyer_lookup(shipments: DataFrame, buyer_id: str | None = None, as_of=None,
                 variant: str = "warehouse") -> DataFrame:
    """S15 + B9 + E3: the buyer-history record for every buyer (or one).

    ``warehouse`` (default): base figures come from the (buyer, country) view
    row with the most shipments (ties: country ascending).  ``file``: figures
    are the buyer aggregates over the cleaned rows (D1) and country/category
    those of the earliest shipment (E2).  Both take the value trend — and the
    warehouse variant the primary category — from the buyer history (D2).
    """
    if buyer_id is not None:
        # On the finished record: the trend compares with the mean of all shipments.  The
        # optimizer takes the filter down to every scan but that mean's.
        return buyer_lookup(shipments, None, as_of, variant).where(F.col("buyer_id") == F.lit(buyer_id))
    if variant == "file":
        from traderisk.operators.clean import clean_shipments
        from traderisk.operators.history import buyer_first_shipment, buyer_profile
        clean = clean_shipments(shipments)
        prof = buyer_profile(clean).join(buyer_first_shipment(clean), "buyer_id")
        trend = buyer_history(shipments).select("buyer_id", "value_trend")
        return prof.join(trend, "buyer_id", "left").select(
            "buyer_id",
            F.col("buyer_total_orders").alias("total_orders"),
            half_up("buyer_total_value", 2).alias("total_value_usd"),
            half_up("buyer_avg_delay", 1).alias("avg_payment_delay_days"),
            half_up("buyer_dispute_rate", 4).alias("dispute_rate"),
            half_up("buyer_paid_in_full_rate", 4).alias("paid_in_full_rate"),
            F.col("first_country").alias("primary_country"),
            F.col("first_category").alias("primary_category"),
            "value_trend",
        )
    if variant != "warehouse":
        raise ValueError(f"unknown look-up variant {variant!r}")
    summary = buyer_risk_summary(shipments, as_of)
    w = Window.partitionBy("buyer_id").orderBy(F.col("total_shipments").desc(), F.col("buyer_country"))
    picked = summary.withColumn("_pick", F.row_number().over(w)).where(F.col("_pick") == 1)
    hist = buyer_history(shipments).select("buyer_id", "primary_category", "value_trend")
    out = picked.join(hist, "buyer_id", "left")
    return out.select(
        "buyer_id",
        F.col("total_shipments").alias("total_orders"),
        half_up("total_value", 2).alias("total_value_usd"),
        half_up("avg_delay_days", 1).alias("avg_payment_delay_days"),
        half_up("dispute_rate", 4).alias("dispute_rate"),
        half_up("paid_in_full_rate", 4).alias("paid_in_full_rate"),
        F.col("buyer_country").alias("primary_country"),
        "primary_category", "value_trend",
    )


def country_trend_lookup(country_risk: DataFrame, country: str | None = None,
                         months: int = K.TREND_LOOKUP_MONTHS) -> DataFrame:
    """B10 + F4: first ``months`` months of each country (or one), both sides normalised."""
    trend = country_risk_trend(country_risk, ordered=False).withColumn("country", strip_upper("country"))
    if country is not None:
        trend = trend.where(F.col("country") == strip_upper(F.lit(country)))
    w = Window.partitionBy("country").orderBy(F.col("month"))
    return (trend.withColumn("month_index", F.row_number().over(w).cast("long"))
                 .where(F.col("month_index") <= months))


# ---------------------------------------------------------------------------
# Roll-ups over scored deals
# ---------------------------------------------------------------------------
def score_band_summary(scored: DataFrame) -> DataFrame:
    """Counts and shares per band, mean score, distinct countries."""
    s = F.col("risk_score")
    n = F.count(F.lit(1))
    low = F.count_if(s < K.LOW_BAND_UPPER)
    med = F.count_if((s >= K.LOW_BAND_UPPER) & (s < K.MEDIUM_BAND_UPPER))
    high = F.count_if(s >= K.MEDIUM_BAND_UPPER)
    out = scored.agg(
        n.alias("n_scored"), low.alias("n_low"), med.alias("n_medium"), high.alias("n_high"),
        exact_mean_scaled("risk_score", 1).alias("avg_score"),
        F.count_distinct("buyer_country").alias("n_countries"),
    )
    for band in ("low", "medium", "high"):
        out = out.withColumn(f"share_{band}", safe_rate(f"n_{band}", "n_scored"))
    return out


def recent_deals(scored: DataFrame, n: int = K.RECENT_DEALS) -> DataFrame:
    """the n newest scored deals (ties by deal_id)."""
    return (scored.orderBy(F.col("deal_ts").desc(), F.col("deal_id").desc()).limit(n)
            .select("deal_id", "deal_ts", "buyer_country", "hs_code", "invoice_value_usd", "risk_score",
                    "risk_category", "recommended_payment_terms"))
