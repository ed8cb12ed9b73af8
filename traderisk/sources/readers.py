"""Typed sources and sinks (A1–A5, A8).  Schemas are declared, never inferred.

Reading CSV here is strict: one row that does not fit ends the job.  ``loading.load_csv``
loads the rows that fit and keeps the others with their reasons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traderisk import schemas
from traderisk.sources.loading import FLAG_COLUMNS, flag_of, load_table  # noqa: F401  (load_table: A4)

def _flag(name: str):
    return F.when(F.col(name).isNull(), F.lit(None).cast("int")).otherwise(F.coalesce(
        flag_of(name), F.raise_error(F.concat(F.lit(f"{name} is no flag: "), F.col(name))).cast("int")))


def _typed_read(spark: SparkSession, path: str, schema, fmt: str) -> DataFrame:
    if fmt == "parquet":
        df = spark.read.parquet(path)
        # Parquet carries its own types; project to the declared schema so that
        # BOOLEAN flags, FLOAT64 invoices or extra columns are normalised.
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    if fmt == "csv":
        # Flags may be written as 0/1 or true/false: read as text, then mapped; other text fails.
        flags = [f.name for f in schema.fields if f.name in FLAG_COLUMNS]
        text = T.StructType([T.StructField(f.name, T.StringType() if f.name in flags else f.dataType) for f in schema.fields])
        df = (spark.read.schema(text).option("header", True).option("dateFormat", "yyyy-MM-dd")
              .option("mode", "FAILFAST").csv(path))
        return df.select(*[_flag(f.name).cast(f.dataType).alias(f.name) if f.name in flags else F.col(f.name) for f in schema.fields])
    raise ValueError(f"unsupported format {fmt!r}")


def read_shipments(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1: header CSV or Parquet with dates parsed by the declared schema."""
    return _typed_read(spark, path, schemas.SHIPMENTS, fmt)


def read_country_risk(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A2."""
    return _typed_read(spark, path, schemas.COUNTRY_RISK, fmt)


def read_buyer_history(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A3."""
    return _typed_read(spark, path, schemas.BUYER_HISTORY, fmt)


def read_deals(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _typed_read(spark, path, schemas.DEALS, fmt)


def write_csv(df: DataFrame, path: str) -> None:
    """A5: header CSV, ISO dates, one folder of part files (no single-file coalesce)."""
    df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


def write_model_config(spark: SparkSession, config: dict, path: str) -> None:
    """One-row JSON dataset with features, accuracy and score bands."""
    bands = [
        {"name": name, "min": lo, "max": hi, "term": term}
        for name, (lo, hi, term) in config["score_bands"].items()
    ]
    row = {
        "model_backend": config.get("model_backend", "spark-ml"),
        "feature_columns": list(config["feature_columns"]),
        "test_accuracy": float(config["test_accuracy"]) if config.get("test_accuracy") is not None else None,
        "score_bands": bands,
        "score_to_term_fn": config.get("score_to_term_fn", "score_terms"),
    }
    spark.createDataFrame([row], schemas.MODEL_CONFIG).coalesce(1).write.mode("overwrite").json(path)


def read_model_config(spark: SparkSession, path: str) -> dict:
    """Read the one-row config back (the only driver-side row we collect)."""
    rows = spark.read.schema(schemas.MODEL_CONFIG).json(path).take(1)
    if not rows:
        raise FileNotFoundError(path)
    r = rows[0].asDict(recursive=True)
    r["score_bands"] = {b["name"]: (b["min"], b["max"], b["term"]) for b in r["score_bands"]}
    return r
