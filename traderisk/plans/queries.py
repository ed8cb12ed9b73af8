"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame`` and, next to
each, the DuckDB oracle SQL that states the same result over the driver's
tables.  Every query reads whole tables; limits appear only where the limit is
the feature (leaderboard, top countries, recent deals, top features).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traderisk.operators import clean as C
from traderisk.operators import features as FE
from traderisk.operators import views as V
from traderisk.plans.oracle_sql import with_fixtures
from traderisk.sources.tables import tables

AS_OF = "2002-01-01"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_fixtures(*ctes, body=sql)
        return fn
    return deco


# ---------------------------------------------------------------------------
# Shared oracle CTEs
# ---------------------------------------------------------------------------
def half_up_sql(expr: str, digits: int) -> str:
    scale = f"CAST({10 ** digits} AS DOUBLE)"
    return f"(floor(({expr}) * {scale} + CAST(0.5 AS DOUBLE)) / {scale})"


def strip_upper_sql(expr: str) -> str:
    return f"upper(regexp_replace({expr}, '^\\s+|\\s+$', '', 'g'))"


CTE_CLEAN = f"""
clean AS (
  SELECT shipment_id, exporter_id, buyer_id, {strip_upper_sql('buyer_country')} AS buyer_country, hs_code,
         product_category, shipment_date, invoice_value_usd, payment_terms, payment_delay_days, was_disputed,
         was_paid_in_full, CAST(date_trunc('month', shipment_date) AS DATE) AS shipment_month
  FROM shipments
  WHERE buyer_id IS NOT NULL AND buyer_country IS NOT NULL AND hs_code IS NOT NULL AND invoice_value_usd IS NOT NULL
)"""

CTE_JOINED = f"""
cr AS (
  SELECT {strip_upper_sql('country')} AS cr_country, month AS cr_month, political_stability_score,
         currency_volatility_index, trade_sanctions_flag
  FROM country_risk
),
joined0 AS (
  SELECT c.*, cr.political_stability_score, cr.currency_volatility_index, cr.trade_sanctions_flag
  FROM clean c LEFT JOIN cr ON c.buyer_country = cr.cr_country AND c.shipment_month = cr.cr_month
),
med AS (
  SELECT median(political_stability_score) AS ps_med, median(currency_volatility_index) AS cv_med FROM joined0
),
joined AS (
  SELECT j.* REPLACE (coalesce(j.political_stability_score, med.ps_med) AS political_stability_score,
                      coalesce(j.currency_volatility_index, med.cv_med) AS currency_volatility_index,
                      CAST(coalesce(j.trade_sanctions_flag, 0) AS INTEGER) AS trade_sanctions_flag)
  FROM joined0 j CROSS JOIN med
)"""

LABEL_SCORE_SQL = (
    "CAST(0.3 AS DOUBLE) * CASE WHEN payment_delay_days IS NULL THEN NULL "
    "ELSE least(greatest(payment_delay_days / CAST(180.0 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) END"
    " + CAST(0.4 AS DOUBLE) * (CAST(was_disputed AS DOUBLE) * CAST(0.5 AS DOUBLE))"
    " + CAST(0.3 AS DOUBLE) * ((CAST(1 AS DOUBLE) - CAST(was_paid_in_full AS DOUBLE)) * CAST(0.3 AS DOUBLE))"
)

CTE_FEATURES = f"""
featured AS (
  SELECT shipment_id, exporter_id, buyer_id, buyer_country, hs_code, product_category, shipment_date,
         invoice_value_usd, payment_terms, payment_delay_days, was_disputed, was_paid_in_full,
         political_stability_score, currency_volatility_index, trade_sanctions_flag,
         COUNT(shipment_id) OVER b AS buyer_total_orders,
         CAST(SUM(invoice_value_usd) OVER b AS DOUBLE) AS buyer_total_value,
         CAST(SUM(payment_delay_days) OVER b AS DOUBLE) / COUNT(payment_delay_days) OVER b AS buyer_avg_delay,
         CAST(SUM(was_disputed) OVER b AS DOUBLE) / COUNT(was_disputed) OVER b AS buyer_dispute_rate,
         CAST(SUM(invoice_value_usd) OVER b AS DOUBLE) / COUNT(invoice_value_usd) OVER b AS buyer_avg_invoice,
         CAST(SUM(was_paid_in_full) OVER b AS DOUBLE) / COUNT(was_paid_in_full) OVER b AS buyer_paid_in_full_rate,
         ROW_NUMBER() OVER (PARTITION BY buyer_id ORDER BY shipment_date DESC NULLS FIRST, shipment_id DESC)
           AS buyer_order_rank,
         {LABEL_SCORE_SQL} AS payment_default_risk_score
  FROM joined
  WINDOW b AS (PARTITION BY buyer_id)
),
features AS (
  SELECT *, CAST(coalesce(payment_default_risk_score > CAST(0.3 AS DOUBLE), false) AS INTEGER) AS payment_default_risk
  FROM featured
)"""

BRS_SQL_CTE = f"""
brs0 AS (
  SELECT buyer_id, buyer_country, COUNT(*) AS total_shipments,
         CAST(SUM(invoice_value_usd) AS DOUBLE) AS total_value,
         AVG(payment_delay_days) AS avg_delay_days,
         CAST(SUM(was_disputed) AS DOUBLE) / COUNT(*) AS dispute_rate,
         CAST(SUM(was_paid_in_full) AS DOUBLE) / COUNT(*) AS paid_in_full_rate,
         MAX(shipment_date) AS last_shipment,
         CAST(date_diff('day', MAX(shipment_date), DATE '{AS_OF}') AS INTEGER) AS days_since_last_order
  FROM shipments GROUP BY buyer_id, buyer_country
),
brs AS (
  SELECT *, CASE WHEN risk_score < 30 THEN 'Low Risk' WHEN risk_score < 60 THEN 'Medium Risk' ELSE 'High Risk' END
              AS risk_category
  FROM (SELECT *, {half_up_sql("avg_delay_days / CAST(180 AS DOUBLE) * CAST(30 AS DOUBLE) + dispute_rate * CAST(40 AS DOUBLE) + (CAST(1 AS DOUBLE) - paid_in_full_rate) * CAST(30 AS DOUBLE)", 1)} AS risk_score
        FROM brs0)
)"""


# ---------------------------------------------------------------------------
# Views (D3, D4, S4) and the leaderboard
# ---------------------------------------------------------------------------
@query("buyer_risk_summary", "SELECT * FROM brs", (BRS_SQL_CTE,))
def q_buyer_risk_summary(spark, sf_dir):
    return V.buyer_risk_summary(tables(spark, sf_dir).shipments, as_of=AS_OF)


@query("buyer_risk_leaderboard",
       "SELECT * FROM brs WHERE risk_score IS NOT NULL ORDER BY risk_score DESC, buyer_id, buyer_country LIMIT 20",
       (BRS_SQL_CTE,))
def q_buyer_risk_leaderboard(spark, sf_dir):
    return V.buyer_risk_leaderboard(V.buyer_risk_summary(tables(spark, sf_dir).shipments, as_of=AS_OF))


COMPOSITE_SQL = half_up_sql(
    "(CAST(1 AS DOUBLE) - political_stability_score) * CAST(50 AS DOUBLE) + currency_volatility_index * CAST(40 AS DOUBLE)"
    " + trade_sanctions_flag * 10", 1)

CTE_TREND = f"""
trend AS (
  SELECT country, month, political_stability_score, currency_volatility_index, trade_sanctions_flag,
         {COMPOSITE_SQL} AS composite_risk_index
  FROM country_risk
)"""


@query("country_risk_trend", "SELECT * FROM trend ORDER BY country, month", (CTE_TREND,))
def q_country_risk_trend(spark, sf_dir):
    return V.country_risk_trend(tables(spark, sf_dir).country_risk)


@query("shipment_outcomes_by_hs_code", f"""
SELECT hs_code, product_category, COUNT(*) AS total_shipments,
       CAST(SUM(invoice_value_usd) AS DOUBLE) AS total_value_usd,
       {half_up_sql("CAST(SUM(invoice_value_usd) AS DOUBLE) / COUNT(invoice_value_usd)", 0)} AS avg_invoice_value,
       {half_up_sql("AVG(payment_delay_days)", 1)} AS avg_delay_days,
       CAST(SUM(was_disputed) AS DOUBLE) / COUNT(*) AS dispute_rate,
       CAST(SUM(was_paid_in_full) AS DOUBLE) / COUNT(*) AS paid_in_full_rate,
       COUNT(*) FILTER (WHERE payment_terms = 'advance') AS advance_count,
       COUNT(*) FILTER (WHERE payment_terms = 'lc') AS lc_count,
       COUNT(*) FILTER (WHERE payment_terms LIKE 'credit_%') AS credit_count
FROM shipments GROUP BY hs_code, product_category ORDER BY total_value_usd DESC""")
def q_shipment_outcomes_by_hs_code(spark, sf_dir):
    return V.shipment_outcomes_by_hs_code(tables(spark, sf_dir).shipments)


# ---------------------------------------------------------------------------
# Feature pipeline
# ---------------------------------------------------------------------------
@query("clean_shipments", "SELECT * FROM clean", (CTE_CLEAN,))
def q_clean_shipments(spark, sf_dir):
    return C.clean_shipments(tables(spark, sf_dir).shipments)


@query("country_risk_join", "SELECT * FROM joined", (CTE_CLEAN, CTE_JOINED))
def q_country_risk_join(spark, sf_dir):
    t = tables(spark, sf_dir)
    return C.join_country_risk(C.clean_shipments(t.shipments), t.country_risk)


@query("engineered_features", "SELECT * FROM features", (CTE_CLEAN, CTE_JOINED, CTE_FEATURES))
def q_engineered_features(spark, sf_dir):
    t = tables(spark, sf_dir)
    return FE.engineer_features(t.shipments, t.country_risk)


@query("default_label", f"""
SELECT shipment_id, buyer_id, payment_delay_days, was_disputed, was_paid_in_full, payment_default_risk_score,
       CAST(coalesce(payment_default_risk_score > CAST(0.3 AS DOUBLE), false) AS INTEGER) AS payment_default_risk
FROM (SELECT *, {LABEL_SCORE_SQL} AS payment_default_risk_score FROM clean)""", (CTE_CLEAN,))
def q_default_label(spark, sf_dir):
    return FE.clean_and_label(tables(spark, sf_dir).shipments).select(
        "shipment_id", "buyer_id", "payment_delay_days", "was_disputed", "was_paid_in_full",
        "payment_default_risk_score", "payment_default_risk")


@query("label_distribution", f"""
SELECT payment_default_risk, n_rows, CAST(n_rows AS DOUBLE) / CAST(SUM(n_rows) OVER () AS DOUBLE) AS share
FROM (SELECT CAST(coalesce({LABEL_SCORE_SQL} > CAST(0.3 AS DOUBLE), false) AS INTEGER) AS payment_default_risk,
             COUNT(*) AS n_rows
      FROM clean GROUP BY 1)""", (CTE_CLEAN,))
def q_label_distribution(spark, sf_dir):
    return FE.label_distribution(FE.clean_and_label(tables(spark, sf_dir).shipments))


@query("train_test_split", """
SELECT shipment_id, buyer_id, ordinal,
       CASE WHEN ordinal < floor(CAST(0.8 AS DOUBLE) * CAST(total AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
FROM (SELECT shipment_id, buyer_id,
             ROW_NUMBER() OVER (ORDER BY buyer_id, shipment_date ASC NULLS LAST, shipment_id ASC) - 1 AS ordinal,
             COUNT(*) OVER () AS total
      FROM clean)""", (CTE_CLEAN,))
def q_train_test_split(spark, sf_dir):
    t = tables(spark, sf_dir)
    return FE.positional_split(FE.engineer_features(t.shipments, t.country_risk))


@query("rolling_buyer_features", """
SELECT shipment_id, buyer_id, shipment_date,
       ROW_NUMBER() OVER w AS position,
       CAST(SUM(payment_delay_days) OVER r AS DOUBLE) / COUNT(payment_delay_days) OVER r AS rolling_avg_delay,
       CAST(SUM(was_disputed) OVER r AS DOUBLE) / COUNT(was_disputed) OVER r AS rolling_dispute_rate,
       COUNT(*) OVER r AS rolling_rows
FROM clean
WINDOW w AS (PARTITION BY buyer_id ORDER BY shipment_date ASC NULLS LAST, shipment_id ASC),
       r AS (PARTITION BY buyer_id ORDER BY shipment_date ASC NULLS LAST, shipment_id ASC
             ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""", (CTE_CLEAN,))
def q_rolling_buyer_features(spark, sf_dir):
    return FE.rolling_buyer_features(C.clean_shipments(tables(spark, sf_dir).shipments))


_FM_COLS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FE.K.FEATURE_COLUMNS)


@query("feature_matrix", f"""
SELECT shipment_id, {", ".join(f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in FE.K.FEATURE_COLUMNS)},
       payment_default_risk
FROM (SELECT shipment_id, {_FM_COLS}, payment_default_risk FROM features)""",
       (CTE_CLEAN, CTE_JOINED, CTE_FEATURES))
def q_feature_matrix(spark, sf_dir):
    t = tables(spark, sf_dir)
    return FE.feature_matrix(FE.engineer_features(t.shipments, t.country_risk))


# ---------------------------------------------------------------------------
# CSV ingest with rejected rows (A1, A4)
# ---------------------------------------------------------------------------
@query("csv_ingest", """
SELECT outcome, COUNT(*) AS n_rows, CAST(SUM(CASE WHEN outcome = 'loaded' THEN invoice_value_usd END) AS DOUBLE) AS loaded_value_usd
FROM (SELECT invoice_value_usd,
             CASE WHEN hs_code = 14 THEN 'wrong number of columns'
                  WHEN hs_code = 2 THEN 'shipment_date is no date'
                  WHEN hs_code = 5 THEN 'was_disputed is no flag'
                  WHEN hs_code = 9 THEN 'payment_delay_days is no int; was_paid_in_full is no flag'
                  ELSE 'loaded' END AS outcome
      FROM shipments)
GROUP BY outcome""")
def q_csv_ingest(spark, sf_dir):
    """All shipments as CSV lines, some sections' rows spoilt, loaded: rows per outcome and the value that arrived."""
    from traderisk import schemas
    from traderisk import session as S
    from traderisk.sources.loading import load_csv
    spoilt = {"shipment_date": ("hs_code = 2", "2024-13-45"), "was_disputed": ("hs_code = 5", "maybe"),
              "payment_delay_days": ("hs_code = 9", "ten"), "was_paid_in_full": ("hs_code = 9", "2")}
    cells = [F.when(F.expr(spoilt[c][0]), F.lit(spoilt[c][1])).otherwise(F.col(c).cast("string")).alias(c)
             if c in spoilt else F.col(c).cast("string").alias(c) for c in schemas.SHIPMENTS.fieldNames()]
    line = F.when(F.col("hs_code") == 14, F.to_csv(F.struct(*cells[:-2]))).otherwise(F.to_csv(F.struct(*cells)))
    source = S.unique_path(spark, "shipments-csv")
    tables(spark, sf_dir).shipments.select(line.alias("value")).write.text(source)
    loaded = load_csv(spark, source, schemas.SHIPMENTS, S.unique_path(spark, "shipments-from-csv"), header=False)
    outcomes = loaded.table.select(F.lit("loaded").alias("outcome"), "invoice_value_usd").unionByName(
        loaded.rejected.select(F.col("reason").alias("outcome"), F.lit(None).cast("decimal(18,2)").alias("invoice_value_usd")))
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"),
                                           F.sum("invoice_value_usd").cast("double").alias("loaded_value_usd"))


# The same matrix over shipments that lack values: every fill of B4 and B6 runs.
_GAPS = {"payment_delay_days": "hs_code % 5 = 2", "was_disputed": "hs_code % 7 = 3", "was_paid_in_full": "hs_code = 11",
         "shipment_date": "hs_code = 13"}
_GAPS_SQL = ", ".join(f"CASE WHEN NOT ({rule}) THEN {c} END AS {c}" for c, rule in _GAPS.items())
CTE_GAPS = f"""
gaps AS (SELECT * REPLACE ({_GAPS_SQL}) FROM shipments)"""


@query("feature_matrix_with_gaps", f"""
SELECT shipment_id, {", ".join(f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in FE.K.FEATURE_COLUMNS)},
       payment_default_risk
FROM (SELECT shipment_id, {_FM_COLS}, payment_default_risk FROM features)""",
       (CTE_GAPS, CTE_CLEAN.replace("FROM shipments", "FROM gaps"), CTE_JOINED, CTE_FEATURES))
def q_feature_matrix_with_gaps(spark, sf_dir):
    t = tables(spark, sf_dir)
    gaps = t.shipments.withColumns({c: F.when(~F.expr(rule), F.col(c)) for c, rule in _GAPS.items()})
    return FE.feature_matrix(FE.engineer_features(gaps, t.country_risk))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from traderisk.plans import queries_scoring  # noqa: F401  (registers the rest)
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    from traderisk.plans import queries_scoring  # noqa: F401
    return dict(ORACLE)

