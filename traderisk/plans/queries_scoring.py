"""Registered queries, part two: history, profiles, scoring, dashboards,
look-ups, roll-ups, the model and the stream.

The oracle SQL states every threshold, point, default and text itself, so a wrong
constant in the library shows as a mismatch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from traderisk import constants as K
from traderisk.operators import clean as C
from traderisk.operators import dashboards as D
from traderisk.operators import features as FE
from traderisk.operators import history as H
from traderisk.operators import model as M
from traderisk.operators import scoring as SC
from traderisk.plans.queries import (AS_OF, CTE_CLEAN, CTE_TREND, LABEL_SCORE_SQL, BRS_SQL_CTE, half_up_sql,
                                     query, strip_upper_sql)
from traderisk.sources import fixtures
from traderisk.sources.tables import tables
from traderisk.streaming.deals_stream import is_folder, materialise, run_available_now, score_deals_stream


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mean_scaled_sql(expr: str, digits: int) -> str:
    scale = f"CAST({10 ** digits} AS DOUBLE)"
    return (f"CAST(SUM(CAST(round(({expr}) * {scale}) AS BIGINT)) AS DOUBLE)"
            f" / (CAST(COUNT({expr}) AS DOUBLE) * {scale})")


def fmt_int_sql(template: str, expr: str) -> str:
    return f"printf({sql_str(template)}, CAST({half_up_sql(expr, 0)} AS BIGINT))"


def fmt_pct1_sql(template: str, expr: str) -> str:
    return f"printf({sql_str(template)}, {half_up_sql(f'({expr}) * CAST(100 AS DOUBLE)', 1)})"


def fmt_2dp_sql(template: str, expr: str) -> str:
    return f"printf({sql_str(template)}, {half_up_sql(expr, 2)})"


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


# ---------------------------------------------------------------------------
# Shared CTEs
# ---------------------------------------------------------------------------
CTE_HIST = f"""
h0 AS (
  SELECT buyer_id, COUNT(shipment_id) AS total_orders,
         CAST(SUM(invoice_value_usd) AS DOUBLE) AS total_value_usd,
         AVG(payment_delay_days) AS avg_payment_delay_days,
         CAST(SUM(was_disputed) AS DOUBLE) / COUNT(was_disputed) AS dispute_rate,
         CAST(SUM(was_paid_in_full) AS DOUBLE) / COUNT(was_paid_in_full) AS paid_in_full_rate,
         CAST(SUM(invoice_value_usd) AS DOUBLE) / COUNT(invoice_value_usd) AS avg_invoice_value,
         MIN(shipment_date) AS first_order_date, MAX(shipment_date) AS last_order_date
  FROM shipments WHERE buyer_id IS NOT NULL GROUP BY buyer_id
),
pc AS (
  SELECT buyer_id, buyer_country AS primary_country FROM (
    SELECT buyer_id, buyer_country,
           ROW_NUMBER() OVER (PARTITION BY buyer_id ORDER BY COUNT(*) DESC, buyer_country) AS rn
    FROM shipments WHERE buyer_country IS NOT NULL GROUP BY buyer_id, buyer_country) WHERE rn = 1
),
pg AS (
  SELECT buyer_id, product_category AS primary_category FROM (
    SELECT buyer_id, product_category,
           ROW_NUMBER() OVER (PARTITION BY buyer_id ORDER BY COUNT(*) DESC, product_category) AS rn
    FROM shipments WHERE product_category IS NOT NULL GROUP BY buyer_id, product_category) WHERE rn = 1
),
ov AS (SELECT CAST(SUM(invoice_value_usd) AS DOUBLE) / COUNT(invoice_value_usd) AS overall FROM shipments),
hist AS (
  SELECT h0.*, pc.primary_country, pg.primary_category,
         CASE WHEN avg_invoice_value < {d(0.7)} * ov.overall THEN 'declining'
              WHEN avg_invoice_value > {d(1.3)} * ov.overall THEN 'growing'
              ELSE 'stable' END AS value_trend
  FROM h0 LEFT JOIN pc USING (buyer_id) LEFT JOIN pg USING (buyer_id) CROSS JOIN ov
)"""

CTE_BP = """
bp AS (
  SELECT buyer_id, COUNT(shipment_id) AS buyer_total_orders,
         CAST(SUM(invoice_value_usd) AS DOUBLE) AS buyer_total_value,
         CAST(SUM(payment_delay_days) AS DOUBLE) / COUNT(payment_delay_days) AS buyer_avg_delay,
         CAST(SUM(was_disputed) AS DOUBLE) / COUNT(was_disputed) AS buyer_dispute_rate,
         CAST(SUM(invoice_value_usd) AS DOUBLE) / COUNT(invoice_value_usd) AS buyer_avg_invoice,
         CAST(SUM(was_paid_in_full) AS DOUBLE) / COUNT(was_paid_in_full) AS buyer_paid_in_full_rate
  FROM clean GROUP BY buyer_id
)"""

CTE_CP = f"""
cp AS (
  SELECT {strip_upper_sql('country')} AS country,
         {mean_scaled_sql('political_stability_score', 4)} AS avg_stability,
         {mean_scaled_sql('currency_volatility_index', 4)} AS avg_volatility,
         MAX(trade_sanctions_flag) AS max_sanctions,
         COUNT(*) AS n_months
  FROM country_risk GROUP BY 1
)"""

CTE_DF = f"""
df AS (
  SELECT d.deal_id, d.deal_ts, d.buyer_id, {strip_upper_sql('d.buyer_country')} AS buyer_country, d.hs_code,
         d.product_category, coalesce(d.payment_terms, 'credit_30') AS payment_terms,
         CAST(d.invoice_value_usd AS DOUBLE) AS invoice_value_usd,
         coalesce(bp.buyer_avg_delay, {d(30.0)}) AS payment_delay_days,
         coalesce(cp.avg_stability, {d(0.6)}) AS political_stability_score,
         coalesce(cp.avg_volatility, {d(0.3)}) AS currency_volatility_index,
         CAST(coalesce(cp.max_sanctions, 0) AS INTEGER) AS trade_sanctions_flag,
         CAST(coalesce(bp.buyer_total_orders, 0) AS BIGINT) AS buyer_total_orders,
         coalesce(bp.buyer_total_value, {d(0.0)}) AS buyer_total_value,
         coalesce(bp.buyer_avg_delay, {d(30.0)}) AS buyer_avg_delay,
         coalesce(bp.buyer_dispute_rate, {d(0.05)}) AS buyer_dispute_rate,
         coalesce(bp.buyer_avg_invoice, CAST(d.invoice_value_usd AS DOUBLE)) AS buyer_avg_invoice,
         coalesce(bp.buyer_paid_in_full_rate, {d(0.9)}) AS buyer_paid_in_full_rate,
         CAST(1 AS BIGINT) AS buyer_order_rank
  FROM deals d
  LEFT JOIN bp ON d.buyer_id = bp.buyer_id
  LEFT JOIN cp ON {strip_upper_sql('d.buyer_country')} = cp.country
)"""

INV_RULE = (f"invoice_value_usd > {d(float(3))} * buyer_avg_invoice"
            " AND buyer_avg_invoice > 0")

RULE_SCORE_SQL = f"""CAST(least(
    (CASE WHEN payment_delay_days > 60 THEN 30
          WHEN payment_delay_days > 30 THEN 10 ELSE 0 END)
  + (CASE WHEN buyer_dispute_rate > {d(0.1)} THEN 25
          WHEN buyer_dispute_rate > {d(0.05)} THEN 10 ELSE 0 END)
  + (CASE WHEN political_stability_score < {d(0.3)} THEN 20
          WHEN political_stability_score < {d(0.5)} THEN 10 ELSE 0 END)
  + (CASE WHEN trade_sanctions_flag = 1 THEN 15 ELSE 0 END)
  + (CASE WHEN buyer_paid_in_full_rate < {d(0.7)} THEN 15 ELSE 0 END)
  + (CASE WHEN {INV_RULE} THEN 10 ELSE 0 END), 100) AS DOUBLE)"""

RULE_REASONS_SQL = f"""coalesce(nullif(concat_ws(' | ',
    CASE WHEN payment_delay_days > 60 THEN {fmt_int_sql('High average payment delay (%d days)', 'payment_delay_days')} END,
    CASE WHEN buyer_dispute_rate > {d(0.1)} THEN {fmt_pct1_sql('Elevated dispute rate (%.1f%%)', 'buyer_dispute_rate')} END,
    CASE WHEN political_stability_score < {d(0.3)} THEN {sql_str("Low political stability in buyer's country")} END,
    CASE WHEN trade_sanctions_flag = 1 THEN {sql_str("Trade sanctions active on buyer's country")} END,
    CASE WHEN buyer_paid_in_full_rate < {d(0.7)} THEN {fmt_pct1_sql('Low payment completion rate (%.1f%%)', 'buyer_paid_in_full_rate')} END,
    CASE WHEN {INV_RULE} THEN {fmt_int_sql("Invoice value ($%,d) is 3x buyer's average — verify capacity", 'invoice_value_usd')} END
  ), ''), {sql_str('No significant risk indicators found')})"""


def model_reasons_sql(variant: str) -> str:
    if variant == "file":
        new_text = 'New buyer — no prior transaction history available'
        delay = (f"CASE WHEN payment_delay_days > 60 THEN {fmt_int_sql('Average payment delay of %d days — above threshold', 'payment_delay_days')}"
                 f" WHEN payment_delay_days > 30 THEN {fmt_int_sql('Moderate payment delay (%d days)', 'payment_delay_days')} END")
        sanctions = "trade_sanctions_flag = 1"
    else:
        new_text = 'Fallback scoring — BigQuery unavailable, using country & value only' if variant == "offline" else 'Buyer not found in BigQuery — using country-level risk only'
        delay = (f"CASE WHEN payment_delay_days > 60 "
                 f"THEN {fmt_int_sql('Average payment delay of %d days — above threshold', 'payment_delay_days')} END")
        sanctions = "trade_sanctions_flag <> 0"
    items = [
        f"CASE WHEN buyer_total_orders = 0 THEN {sql_str(new_text)}"
        f" WHEN buyer_total_orders < 5 THEN printf({sql_str('Limited history — only %d prior orders')}, buyer_total_orders)"
        f" ELSE printf({sql_str('Established buyer with %d prior orders')}, buyer_total_orders) END",
        delay,
        f"CASE WHEN political_stability_score < {d(0.4)} THEN {fmt_2dp_sql('Country stability score is low (%.2f)', 'political_stability_score')}"
        f" WHEN political_stability_score > {d(0.7)} THEN {fmt_2dp_sql('Relatively stable country (stability: %.2f)', 'political_stability_score')} END",
        f"CASE WHEN {sanctions} THEN {sql_str('Destination country has active trade sanctions')} END",
        f"CASE WHEN buyer_dispute_rate > {d(0.15)} THEN {fmt_pct1_sql('Buyer dispute rate is high (%.1f%%)', 'buyer_dispute_rate')} END",
    ]
    arr = "[" + ",\n     ".join(items) + "]"
    return (f"array_to_string(list_slice(list_filter({arr}, lambda x: x IS NOT NULL), 1, 3), ' | ')")


def band_sql(expr: str, kind: str) -> str:
    if kind == "category":
        labels = ('Low Risk', 'Medium Risk', 'High Risk')
    elif kind == "terms":
        labels = ('Credit terms acceptable (net 30/60)', 'Letter of Credit (LC) required', 'Advance payment only')
    else:
        labels = ('CREDIT OK', 'LC REQUIRED', 'ADVANCE PAYMENT')
    return (f"CASE WHEN {expr} < 30 THEN {sql_str(labels[0])} WHEN {expr} < 60 "
            f"THEN {sql_str(labels[1])} WHEN {expr} IS NOT NULL THEN {sql_str(labels[2])} END")


RELIABILITY_SQL = ("CASE WHEN buyer_total_orders > 0 AND payment_delay_days > 0 THEN greatest(CAST(0 AS DOUBLE), "
                   "CAST(100 AS DOUBLE) - payment_delay_days * CAST(1.5 AS DOUBLE) - buyer_dispute_rate * "
                   "CAST(200 AS DOUBLE)) ELSE CAST(100 AS DOUBLE) END")

def scored_cte(score: str, reasons: str) -> str:
    return f"""
rs AS (SELECT df.*, {score} AS _score, {reasons} AS supporting_reasons FROM df),
rs2 AS (
  SELECT *, {half_up_sql('_score', 1)} AS risk_score,
         {half_up_sql('currency_volatility_index', 3)} AS currency_volatility,
         {half_up_sql(RELIABILITY_SQL, 1)} AS buyer_reliability_score
  FROM rs
),
scored AS (
  SELECT deal_id, deal_ts, buyer_id, buyer_country, hs_code, invoice_value_usd, risk_score,
         {band_sql('_score', 'category')} AS risk_category,
         {band_sql('_score', 'terms')} AS recommended_payment_terms,
         {band_sql('risk_score', 'action')} AS action_label,
         supporting_reasons,
         {half_up_sql('political_stability_score', 3)} AS country_stability,
         currency_volatility,
         trade_sanctions_flag <> 0 AS trade_sanctions,
         {half_up_sql('payment_delay_days', 1)} AS avg_payment_delay,
         {half_up_sql('buyer_dispute_rate', 4)} AS dispute_rate,
         buyer_reliability_score,
         {half_up_sql('invoice_value_usd * (CAST(1 AS DOUBLE) - _score / CAST(100 AS DOUBLE))', 2)} AS suggested_credit_limit,
         CASE WHEN currency_volatility > {d(0.5)} THEN 'high'
              WHEN currency_volatility IS NOT NULL THEN 'normal' END AS volatility_band,
         CASE WHEN buyer_reliability_score >= 70 THEN 'good'
              WHEN buyer_reliability_score >= 40 THEN 'fair'
              WHEN buyer_reliability_score IS NOT NULL THEN 'poor' END AS reliability_band
  FROM rs2
)"""


CTE_SCORED = scored_cte(RULE_SCORE_SQL, RULE_REASONS_SQL)
SCORING_CTES = (CTE_CLEAN, CTE_BP, CTE_CP, CTE_DF, CTE_SCORED)


# ---------------------------------------------------------------------------
# Helpers: inputs of the scoring queries
# ---------------------------------------------------------------------------
def _deal_features(spark, sf_dir):
    t = tables(spark, sf_dir)
    bp = H.buyer_profile(C.clean_shipments(t.shipments))
    cp = H.country_profile(t.country_risk)
    return SC.deal_features(t.deals, bp, cp)


def _scored(spark, sf_dir):
    return SC.score_deals(_deal_features(spark, sf_dir))


# ---------------------------------------------------------------------------
# History and profiles
# ---------------------------------------------------------------------------
@query("buyer_history", "SELECT * FROM hist", (CTE_HIST,))
def q_buyer_history(spark, sf_dir):
    return H.buyer_history(tables(spark, sf_dir).shipments)


@query("buyer_profile", "SELECT * FROM bp", (CTE_CLEAN, CTE_BP))
def q_buyer_profile(spark, sf_dir):
    return H.buyer_profile(C.clean_shipments(tables(spark, sf_dir).shipments))


@query("country_profile", "SELECT * FROM cp", (CTE_CP,))
def q_country_profile(spark, sf_dir):
    return H.country_profile(tables(spark, sf_dir).country_risk)


INCOMPLETE_SQL = ("(buyer_id IS NULL OR buyer_country IS NULL OR hs_code IS NULL OR invoice_value_usd IS NULL)")


@query("dataset_profile", f"""
SELECT * FROM (
  SELECT COUNT(*) AS n_shipments, COUNT(DISTINCT shipment_id) AS n_shipment_ids,
         COUNT(DISTINCT buyer_id) AS n_buyers, COUNT(DISTINCT exporter_id) AS n_exporters,
         COUNT(DISTINCT buyer_country) AS n_buyer_countries,
         MIN(shipment_date) AS first_shipment_date, MAX(shipment_date) AS last_shipment_date,
         COUNT(*) FILTER (WHERE {INCOMPLETE_SQL}) AS n_incomplete,
         COUNT(*) FILTER (WHERE NOT {INCOMPLETE_SQL} AND coalesce({LABEL_SCORE_SQL} > {d(0.3)}, false))
           AS n_default_positive,
         COUNT(*) FILTER (WHERE NOT {INCOMPLETE_SQL} AND NOT coalesce({LABEL_SCORE_SQL} > {d(0.3)}, false))
           AS n_default_negative
  FROM shipments
) CROSS JOIN (
  SELECT COUNT(*) AS n_country_months, COUNT(DISTINCT country) AS n_risk_countries,
         MIN(month) AS first_month, MAX(month) AS last_month
  FROM country_risk
)""")
def q_dataset_profile(spark, sf_dir):
    t = tables(spark, sf_dir)
    return H.dataset_profile(t.shipments, t.country_risk)


# ---------------------------------------------------------------------------
# Scoring (C3, D5, S5–S11, S14) and explanations
# ---------------------------------------------------------------------------
@query("deal_features", "SELECT * FROM df", (CTE_CLEAN, CTE_BP, CTE_CP, CTE_DF))
def q_deal_features(spark, sf_dir):
    return _deal_features(spark, sf_dir)


@query("score_deals", "SELECT * FROM scored", SCORING_CTES)
def q_score_deals(spark, sf_dir):
    return SC.flatten_reasons(_scored(spark, sf_dir))


@query("rule_reasons", f"""
SELECT deal_id, {RULE_SCORE_SQL} AS rule_score, {RULE_REASONS_SQL} AS reasons FROM df""",
       (CTE_CLEAN, CTE_BP, CTE_CP, CTE_DF))
def q_rule_reasons(spark, sf_dir):
    f = _deal_features(spark, sf_dir)
    return f.select("deal_id", SC.rule_score().alias("rule_score"),
                    F.array_join(SC.rule_reasons(), " | ").alias("reasons"))


@query("deal_reasons", f"""
SELECT deal_id, {model_reasons_sql('file')} AS file_reasons, {model_reasons_sql('warehouse')} AS warehouse_reasons
FROM df""", (CTE_CLEAN, CTE_BP, CTE_CP, CTE_DF))
def q_deal_reasons(spark, sf_dir):
    f = _deal_features(spark, sf_dir)
    return f.select("deal_id", F.array_join(SC.model_reasons("file"), " | ").alias("file_reasons"),
                    F.array_join(SC.model_reasons("warehouse"), " | ").alias("warehouse_reasons"))


@query("deal_reasons_offline", f"""
SELECT deal_id, {model_reasons_sql('offline')} AS offline_reasons FROM df""", (CTE_CLEAN, CTE_BP, CTE_CP, CTE_DF))
def q_deal_reasons_offline(spark, sf_dir):
    """S8 when the warehouse cannot be reached: the other text for a new buyer."""
    f = _deal_features(spark, sf_dir)
    return f.select("deal_id", F.array_join(SC.model_reasons("warehouse", warehouse_online=False), " | ").alias("offline_reasons"))


@query("score_deals_constant", "SELECT * FROM scored", (CTE_CLEAN, CTE_BP, CTE_CP, CTE_DF, scored_cte("CAST(50 AS DOUBLE)", model_reasons_sql("warehouse"))))
def q_score_deals_constant(spark, sf_dir):
    """S14, warehouse mode without a model: the constant score and the warehouse reasons."""
    return SC.flatten_reasons(SC.score_deals(_deal_features(spark, sf_dir), fallback="constant"))


CTE_FIRST = """
fs AS (
  SELECT buyer_id, buyer_country AS first_country, product_category AS first_category
  FROM (SELECT buyer_id, buyer_country, product_category,
               ROW_NUMBER() OVER (PARTITION BY buyer_id ORDER BY shipment_date NULLS LAST, shipment_id) AS nth FROM clean)
  WHERE nth = 1
)"""

# File mode: the country of a known buyer's earliest shipment replaces the deal's.
CTE_DEALS_FILE = f"""
deals_file AS (
  SELECT d.* REPLACE (coalesce({strip_upper_sql('fs.first_country')}, d.buyer_country) AS buyer_country)
  FROM deals d LEFT JOIN fs ON d.buyer_id = fs.buyer_id
)"""


@query("deal_features_file", "SELECT * FROM df", (CTE_CLEAN, CTE_BP, CTE_CP, CTE_FIRST, CTE_DEALS_FILE, CTE_DF.replace("FROM deals d", "FROM deals_file d")))
def q_deal_features_file(spark, sf_dir):
    t = tables(spark, sf_dir)
    clean = C.clean_shipments(t.shipments)
    return SC.deal_features(t.deals, H.buyer_profile(clean), H.country_profile(t.country_risk), H.buyer_first_shipment(clean))


# ---------------------------------------------------------------------------
# Dashboards
# ---------------------------------------------------------------------------
@query("country_risk_over_time", f"""
SELECT t.month, t.country, {mean_scaled_sql('t.composite_risk_index', 1)} AS avg_composite_risk_index,
       COUNT(*) AS n_points
FROM (SELECT {strip_upper_sql('country')} AS country, month, composite_risk_index FROM trend) t
WHERE t.country IN (
  SELECT country FROM (
    SELECT {strip_upper_sql('buyer_country')} AS country, SUM(invoice_value_usd) AS v FROM shipments
    WHERE buyer_country IS NOT NULL GROUP BY 1 ORDER BY v DESC, country LIMIT 10))
GROUP BY t.month, t.country""", (CTE_TREND,))
def q_country_risk_over_time(spark, sf_dir):
    t = tables(spark, sf_dir)
    return D.country_risk_over_time(t.shipments, t.country_risk)


@query("exposure_by_category", """
SELECT product_category, CAST(SUM(invoice_value_usd) AS DOUBLE) AS total_value_usd, COUNT(*) AS total_shipments,
       CAST(SUM(was_disputed) AS DOUBLE) / COUNT(*) AS dispute_rate
FROM shipments GROUP BY product_category ORDER BY total_value_usd DESC""")
def q_exposure_by_category(spark, sf_dir):
    return D.exposure_by_category(tables(spark, sf_dir).shipments)


HS_VALUES = ", ".join(f"({code}, {sql_str(label)})" for code, label in K.HS_SECTIONS)


@query("exposure_by_hs_section", f"""
SELECT s.hs_code, s.total_shipments, s.total_value_usd, s.dispute_rate, h.hs_label
FROM (SELECT hs_code, COUNT(*) AS total_shipments, CAST(SUM(invoice_value_usd) AS DOUBLE) AS total_value_usd,
             CAST(SUM(was_disputed) AS DOUBLE) / COUNT(*) AS dispute_rate
      FROM shipments GROUP BY hs_code) s
LEFT JOIN (VALUES {HS_VALUES}) h(hs_code, hs_label) ON s.hs_code = h.hs_code
ORDER BY s.hs_code""")
def q_exposure_by_hs_section(spark, sf_dir):
    return D.exposure_by_hs_section(spark, tables(spark, sf_dir).shipments)


@query("country_trend_last12", f"""
SELECT country, month, months_back, political_stability_score,
       CASE WHEN political_stability_score > {d(0.6)} THEN 'stable'
            WHEN political_stability_score > {d(0.3)} THEN 'moderate'
            WHEN political_stability_score IS NOT NULL THEN 'unstable' END AS stability_band,
       currency_volatility_index, trade_sanctions_flag, composite_risk_index
FROM (SELECT {strip_upper_sql('country')} AS country, month, political_stability_score, currency_volatility_index,
             trade_sanctions_flag, composite_risk_index,
             ROW_NUMBER() OVER (PARTITION BY {strip_upper_sql('country')} ORDER BY month DESC) AS months_back
      FROM trend)
WHERE months_back <= 12""", (CTE_TREND,))
def q_country_trend_last12(spark, sf_dir):
    return D.country_trend_last12(tables(spark, sf_dir).country_risk)


# ---------------------------------------------------------------------------
# Look-ups (S15, B9, B10, E3, F4) — whole tables
# ---------------------------------------------------------------------------
@query("buyer_lookup", f"""
SELECT p.buyer_id, p.total_shipments AS total_orders,
       {half_up_sql('p.total_value', 2)} AS total_value_usd,
       {half_up_sql('p.avg_delay_days', 1)} AS avg_payment_delay_days,
       {half_up_sql('p.dispute_rate', 4)} AS dispute_rate,
       {half_up_sql('p.paid_in_full_rate', 4)} AS paid_in_full_rate,
       p.buyer_country AS primary_country, hist.primary_category, hist.value_trend
FROM (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY buyer_id ORDER BY total_shipments DESC, buyer_country)
                              AS rn FROM brs) WHERE rn = 1) p
LEFT JOIN hist ON p.buyer_id = hist.buyer_id""", (BRS_SQL_CTE, CTE_HIST))
def q_buyer_lookup(spark, sf_dir):
    return D.buyer_lookup(tables(spark, sf_dir).shipments, as_of=AS_OF)


@query("buyer_lookup_file", f"""
SELECT bp.buyer_id, bp.buyer_total_orders AS total_orders,
       {half_up_sql('bp.buyer_total_value', 2)} AS total_value_usd,
       {half_up_sql('bp.buyer_avg_delay', 1)} AS avg_payment_delay_days,
       {half_up_sql('bp.buyer_dispute_rate', 4)} AS dispute_rate,
       {half_up_sql('bp.buyer_paid_in_full_rate', 4)} AS paid_in_full_rate,
       fs.first_country AS primary_country, fs.first_category AS primary_category, hist.value_trend
FROM bp JOIN fs USING (buyer_id) LEFT JOIN hist ON bp.buyer_id = hist.buyer_id""", (CTE_CLEAN, CTE_BP, CTE_FIRST, CTE_HIST))
def q_buyer_lookup_file(spark, sf_dir):
    """S15 + E2, file mode: the cleaned aggregates and the earliest shipment of every buyer."""
    return D.buyer_lookup(tables(spark, sf_dir).shipments, variant="file")


@query("country_trend_lookup", f"""
SELECT * FROM (
  SELECT {strip_upper_sql('country')} AS country, month, political_stability_score, currency_volatility_index,
         trade_sanctions_flag, composite_risk_index,
         ROW_NUMBER() OVER (PARTITION BY {strip_upper_sql('country')} ORDER BY month) AS month_index
  FROM trend)
WHERE month_index <= 100""", (CTE_TREND,))
def q_country_trend_lookup(spark, sf_dir):
    return D.country_trend_lookup(tables(spark, sf_dir).country_risk)


# ---------------------------------------------------------------------------
# Roll-ups over scored deals
# ---------------------------------------------------------------------------
@query("score_band_summary", f"""
SELECT *, CAST(n_low AS DOUBLE) / CAST(n_scored AS DOUBLE) AS share_low,
       CAST(n_medium AS DOUBLE) / CAST(n_scored AS DOUBLE) AS share_medium,
       CAST(n_high AS DOUBLE) / CAST(n_scored AS DOUBLE) AS share_high
FROM (SELECT COUNT(*) AS n_scored,
             COUNT(*) FILTER (WHERE risk_score < 30) AS n_low,
             COUNT(*) FILTER (WHERE risk_score >= 30 AND risk_score < 60) AS n_medium,
             COUNT(*) FILTER (WHERE risk_score >= 60) AS n_high,
             {mean_scaled_sql('risk_score', 1)} AS avg_score,
             COUNT(DISTINCT buyer_country) AS n_countries
      FROM scored)""", SCORING_CTES)
def q_score_band_summary(spark, sf_dir):
    return D.score_band_summary(_scored(spark, sf_dir))


@query("recent_deals", f"""
SELECT deal_id, deal_ts, buyer_country, hs_code, invoice_value_usd, risk_score, risk_category,
       recommended_payment_terms
FROM scored ORDER BY deal_ts DESC, deal_id DESC LIMIT 30""", SCORING_CTES)
def q_recent_deals(spark, sf_dir):
    return D.recent_deals(_scored(spark, sf_dir))


# ---------------------------------------------------------------------------
# Model (S12, S13, D11, F6) — rows-only checks
# ---------------------------------------------------------------------------
# The full forest (200 trees of depth 16), fitted on all labelled rows of the split.
_MODELS: dict = {}


def _model_and_training(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _MODELS:
        t = tables(spark, sf_dir)
        training = M.training_frame(FE.engineer_features(t.shipments, t.country_risk))
        _MODELS[key] = (M.train_model(training), training)
    return _MODELS[key]


@query("model_metrics")
def q_model_metrics(spark, sf_dir):
    model, training = _model_and_training(spark, sf_dir)
    return M.model_metrics(model, training)


@query("model_scores")
def q_model_scores(spark, sf_dir):
    model, _ = _model_and_training(spark, sf_dir)
    return M.model_scores(model, _deal_features(spark, sf_dir))


@query("score_deals_model")
def q_score_deals_model(spark, sf_dir):
    """The full response of every deal, scored by the trained model."""
    model, _ = _model_and_training(spark, sf_dir)
    return SC.flatten_reasons(SC.score_deals(_deal_features(spark, sf_dir), model=model))


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    model, _ = _model_and_training(spark, sf_dir)
    return M.feature_importance(spark, model)


# ---------------------------------------------------------------------------
# Streaming (T1): same oracle as the batch scorer
# ---------------------------------------------------------------------------
@query("score_deals_stream", "SELECT * FROM scored", SCORING_CTES)
def q_score_deals_stream(spark, sf_dir):
    t = tables(spark, sf_dir)
    bp = materialise(H.buyer_profile(C.clean_shipments(t.shipments)), "buyer-profile")
    cp = materialise(H.country_profile(t.country_risk), "country-profile")
    orders_path = f"{sf_dir.rstrip('/')}/orders.parquet"
    schema = spark.read.parquet(orders_path).schema
    # A table is a folder of part files, or one file beside the other tables.
    if is_folder(spark, orders_path):
        orders_stream = spark.readStream.schema(schema).parquet(orders_path)
    else:
        orders_stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir.rstrip("/"))
    deals_stream = fixtures.build_deals(spark, sf_dir, orders=orders_stream)
    scored = score_deals_stream(deals_stream, bp, cp)
    return run_available_now(spark, scored, "scored-deals")
