"""Declared schemas of the domain tables (never inferred)."""

from pyspark.sql import types as T

SHIPMENTS = T.StructType([
    T.StructField("shipment_id", T.StringType()),
    T.StructField("exporter_id", T.StringType()),
    T.StructField("buyer_id", T.StringType()),
    T.StructField("buyer_country", T.StringType()),
    T.StructField("hs_code", T.IntegerType()),
    T.StructField("product_category", T.StringType()),
    T.StructField("shipment_date", T.DateType()),
    T.StructField("invoice_value_usd", T.DecimalType(18, 2)),
    T.StructField("payment_terms", T.StringType()),
    T.StructField("payment_delay_days", T.IntegerType()),
    T.StructField("was_disputed", T.IntegerType()),
    T.StructField("was_paid_in_full", T.IntegerType()),
])

COUNTRY_RISK = T.StructType([
    T.StructField("country", T.StringType()),
    T.StructField("month", T.DateType()),
    T.StructField("political_stability_score", T.DoubleType()),
    T.StructField("currency_volatility_index", T.DoubleType()),
    T.StructField("trade_sanctions_flag", T.IntegerType()),
])

BUYER_HISTORY = T.StructType([
    T.StructField("buyer_id", T.StringType()),
    T.StructField("total_orders", T.LongType()),
    T.StructField("total_value_usd", T.DoubleType()),
    T.StructField("avg_payment_delay_days", T.DoubleType()),
    T.StructField("dispute_rate", T.DoubleType()),
    T.StructField("paid_in_full_rate", T.DoubleType()),
    T.StructField("avg_invoice_value", T.DoubleType()),
    T.StructField("first_order_date", T.DateType()),
    T.StructField("last_order_date", T.DateType()),
    T.StructField("primary_country", T.StringType()),
    T.StructField("primary_category", T.StringType()),
    T.StructField("value_trend", T.StringType()),
])

DEALS = T.StructType([
    T.StructField("deal_id", T.LongType()),
    T.StructField("deal_ts", T.TimestampNTZType()),
    T.StructField("buyer_id", T.StringType()),
    T.StructField("buyer_country", T.StringType()),
    T.StructField("hs_code", T.IntegerType()),
    T.StructField("invoice_value_usd", T.DecimalType(18, 2)),
    T.StructField("product_category", T.StringType()),
    T.StructField("payment_terms", T.StringType()),
])

HS_SECTION = T.StructType([
    T.StructField("hs_code", T.IntegerType()),
    T.StructField("hs_label", T.StringType()),
])

MODEL_CONFIG = T.StructType([
    T.StructField("model_backend", T.StringType()),
    T.StructField("feature_columns", T.ArrayType(T.StringType())),
    T.StructField("test_accuracy", T.DoubleType()),
    T.StructField("score_bands", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("min", T.IntegerType()),
        T.StructField("max", T.IntegerType()),
        T.StructField("term", T.StringType()),
    ]))),
    T.StructField("score_to_term_fn", T.StringType()),
])
