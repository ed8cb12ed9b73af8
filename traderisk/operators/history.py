"""Buyer history (D2, A3's derived table) and buyer / country profiles (D1, D6),
plus the dataset profile (A9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traderisk import constants as K
from traderisk.functions.scalar import safe_rate, strip_upper
from traderisk.functions.stats import exact_mean_scaled
from traderisk.operators.clean import CRITICAL_COLUMNS
from traderisk.operators.features import default_risk_score

# Bits that tell the rows of buyers' first days from others: at most 2**19 words are broadcast.
FIRST_DAY_CELLS = 1 << 25


def _most_frequent(shipments: DataFrame, column: str, name: str) -> DataFrame:
    """(buyer_id, ``name``): each buyer's value with the most rows, the smallest one of equals; NULLs never count."""
    counted = shipments.where(F.col("buyer_id").isNotNull() & F.col(column).isNotNull()) \
        .groupBy("buyer_id", column).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy("buyer_id").agg(
        F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("value"))).alias("_top")) \
        .select("buyer_id", F.col("_top.value").alias(name))


def buyer_history(shipments: DataFrame) -> DataFrame:
    """One row per buyer over the raw shipments.

    The sums are one aggregate by buyer.  Two-phase modes beside it: rows are
    counted by (buyer, value) for country and for category, and the buyer keeps the
    value with the highest count; only the count travels with a value.  Every
    phase is an ordinary partial aggregate: no buffer of a buyer's values
    anywhere.  Ties go to the smallest value, NULLs are ignored, an all-NULL
    buyer gives NULL.  The value trend compares the buyer's mean invoice with the
    row-level mean of all shipments, those without a buyer included.
    """
    inv = F.col("invoice_value_usd")
    per_buyer = shipments.groupBy("buyer_id").agg(
        F.count("shipment_id").alias("total_orders"), F.sum(inv).alias("_s"), F.count(inv).alias("_c"),
        *[safe_rate(F.sum(c), F.count(c)).alias(name) for c, name in
          (("payment_delay_days", "avg_payment_delay_days"), ("was_disputed", "dispute_rate"), ("was_paid_in_full", "paid_in_full_rate"))],
        F.min("shipment_date").alias("first_order_date"), F.max("shipment_date").alias("last_order_date"))
    overall = shipments.agg(safe_rate(F.sum(inv), F.count(inv)).alias("_overall"))  # 1 row
    avg_inv, ov = F.col("avg_invoice_value"), F.col("_overall")
    trend = (F.when(avg_inv < F.lit(K.TREND_DECLINING_BELOW) * ov, F.lit("declining"))
             .when(avg_inv > F.lit(K.TREND_GROWING_ABOVE) * ov, F.lit("growing"))
             .otherwise(F.lit("stable")))
    named = (per_buyer.where(F.col("buyer_id").isNotNull())
             .join(_most_frequent(shipments, "buyer_country", "primary_country"), "buyer_id", "left")
             .join(_most_frequent(shipments, "product_category", "primary_category"), "buyer_id", "left")
             .select("buyer_id", "total_orders", F.col("_s").cast("double").alias("total_value_usd"), "avg_payment_delay_days",
                     "dispute_rate", "paid_in_full_rate", safe_rate("_s", "_c").alias("avg_invoice_value"),
                     "first_order_date", "last_order_date", "primary_country", "primary_category"))
    return named.crossJoin(F.broadcast(overall)).withColumn("value_trend", trend).drop("_overall")  # 1-row side


def buyer_profile(clean: DataFrame) -> DataFrame:
    """The six buyer features, one row per buyer (map-side combined)."""
    inv = F.col("invoice_value_usd")
    return clean.groupBy("buyer_id").agg(
        F.count("shipment_id").alias("buyer_total_orders"),
        F.sum(inv).cast("double").alias("buyer_total_value"),
        safe_rate(F.sum("payment_delay_days"), F.count("payment_delay_days")).alias("buyer_avg_delay"),
        safe_rate(F.sum("was_disputed"), F.count("was_disputed")).alias("buyer_dispute_rate"),
        safe_rate(F.sum(inv), F.count(inv)).alias("buyer_avg_invoice"),
        safe_rate(F.sum("was_paid_in_full"), F.count("was_paid_in_full")).alias("buyer_paid_in_full_rate"),
    )


def _first_day_rows(clean: DataFrame, cells: int) -> DataFrame:
    """The rows of their buyer's first day (``_day``: null dates last), and those few of other days that share a cell with one."""
    day = F.unix_date(F.coalesce(F.col("shipment_date"), F.lit("9999-12-31").cast("date"))).cast("long")
    rows = clean.withColumn("_day", day * 2 + F.col("shipment_date").isNull().cast("long"))
    first = rows.groupBy("buyer_id").agg(F.min("_day").alias("_day"))

    def celled(df: DataFrame) -> DataFrame:
        cell = F.xxhash64("buyer_id", "_day").bitwiseAND(F.lit(cells - 1))
        return df.withColumn("_word", F.shiftright(cell, 6)) \
            .withColumn("_bit", F.expr("shiftleft(1L, cast(xxhash64(buyer_id, _day) & 63 as int))"))
    words = celled(first).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    # At most cells / 64 rows, whatever the number of buyers.
    return celled(rows).join(F.broadcast(words), "_word").where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0)


def buyer_first_shipment(clean: DataFrame, cells: int = FIRST_DAY_CELLS) -> DataFrame:
    """Country and category of each buyer's earliest shipment (null dates
    last, ties by shipment_id) by ``min_by``.

    An aggregate that keeps texts sorts its whole input first, and spills it.  So each
    buyer's first day, a number, is found by a hash aggregate, and a broadcast bit per
    hashed (buyer, day) keeps nearly all other rows from ``min_by``.  Rows that share a
    cell only pass in vain: the result does not depend on ``cells`` (a power of two from 64).
    """
    # One aggregate a column: a column that nobody reads is not carried along.
    key = F.struct("_day", "shipment_id")
    return _first_day_rows(clean, cells).groupBy("buyer_id").agg(
        F.min_by("buyer_country", key).alias("first_country"), F.min_by("product_category", key).alias("first_category"))


def country_profile(country_risk: DataFrame, score_decimals: int = 4) -> DataFrame:
    """Per normalised country, mean stability / volatility over all months and
    the max sanctions flag.  Scores carry ``score_decimals`` decimals, so the
    means are taken over integer sums and do not depend on partition order."""
    return country_risk.groupBy(strip_upper("country").alias("country")).agg(
        exact_mean_scaled("political_stability_score", score_decimals).alias("avg_stability"),
        exact_mean_scaled("currency_volatility_index", score_decimals).alias("avg_volatility"),
        F.max("trade_sanctions_flag").alias("max_sanctions"),
        F.count(F.lit(1)).alias("n_months"),
    )


_DISTINCT = {"shipment_id": "n_shipment_ids", "buyer_id": "n_buyers", "exporter_id": "n_exporters",
             "buyer_country": "n_buyer_countries"}


def dataset_profile(shipments: DataFrame, country_risk: DataFrame) -> DataFrame:
    """Row counts, distinct keys, date range, incomplete rows and labels.

    One scan of each table and a two-level distinct: every row gives one (column,
    value) pair per counted column, pairs are de-duplicated by partial aggregates,
    map-side first, and the de-duplicated pairs are counted per column.  The row
    counts ride along as sums on the pairs of one column with few values.
    """
    incomplete = F.lit(False)
    for c in CRITICAL_COLUMNS:
        incomplete = incomplete | F.col(c).isNull()
    positive = F.coalesce(default_risk_score() > F.lit(K.LABEL_THRESHOLD), F.lit(False))

    def rows_of(table: DataFrame, columns: list[str], carrier: str, date: str, counts: dict[str, Column]) -> DataFrame:
        def pair(c: str) -> Column:
            mine = c == carrier
            zero = F.lit(0).cast("long")
            return F.struct(F.lit(c).alias("_column"), F.col(c).cast("string").alias("_value"),
                            F.when(F.lit(mine), F.col(date)).alias("_date"),
                            *[(when.cast("long") if mine else zero).alias(k) for k, when in counts.items()])
        return table.select(F.explode(F.array(*[pair(c) for c in columns])).alias("x")).select("x.*")

    complete, yes, no = ~incomplete, F.lit(True), F.lit(False)
    ship = rows_of(shipments, list(_DISTINCT), "buyer_country", "shipment_date", {
        "_ships": yes, "_incomplete": incomplete, "_positive": complete & positive, "_negative": complete & ~positive, "_months": no})
    risk = rows_of(country_risk, ["country"], "country", "month", {
        "_ships": no, "_incomplete": no, "_positive": no, "_negative": no, "_months": yes})
    sums = ["_ships", "_incomplete", "_positive", "_negative", "_months"]
    pairs = ship.unionByName(risk).groupBy("_column", "_value").agg(
        F.min("_date").alias("_min"), F.max("_date").alias("_max"), *[F.sum(c).alias(c) for c in sums])

    def of(column: str) -> Column:
        return F.col("_column") == column

    def distinct(column: str) -> Column:
        return F.count_if(of(column) & F.col("_value").isNotNull())

    def total(column: str, name: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0).cast("long")).alias(name)

    return pairs.agg(
        total("_ships", "n_shipments"),
        F.min(F.when(of("buyer_country"), F.col("_min"))).alias("first_shipment_date"),
        F.max(F.when(of("buyer_country"), F.col("_max"))).alias("last_shipment_date"),
        total("_incomplete", "n_incomplete"), total("_positive", "n_default_positive"), total("_negative", "n_default_negative"),
        *[distinct(column).alias(name) for column, name in _DISTINCT.items()],
        total("_months", "n_country_months"), distinct("country").alias("n_risk_countries"),
        F.min(F.when(of("country"), F.col("_min"))).alias("first_month"),
        F.max(F.when(of("country"), F.col("_max"))).alias("last_month"))
