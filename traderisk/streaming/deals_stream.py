"""Streaming deal scoring.

The same column expressions as batch scoring run over a streaming ``deals``
frame.  Joins are stream–static and stateless; the static profiles are
materialised once (written as Parquet in the shared folder) so micro-batches
do not recompute them.  Output and checkpoint live in the shared folder too, so
a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traderisk import session as S
from traderisk.operators.scoring import deal_features, flatten_reasons, score_deals
from traderisk.sources.readers import load_table


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a static side once and read it back (cuts its lineage)."""
    back, _ = load_table(df, S.unique_path(df.sparkSession, name))
    return back


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def score_deals_stream(deals_stream: DataFrame, buyer_profile: DataFrame, country_profile: DataFrame,
                       **score_kwargs) -> DataFrame:
    """Streaming DataFrame of scored deals (reasons flattened to one string)."""
    features = deal_features(deals_stream, buyer_profile, country_profile)
    return flatten_reasons(score_deals(features, **score_kwargs))


def run_available_now(spark: SparkSession, scored_stream: DataFrame, name: str = "scored-deals",
                      output_path: str | None = None, checkpoint_path: str | None = None) -> DataFrame:
    """Drain all available input with ``trigger(availableNow=True)`` into Parquet
    and return the written table as a batch DataFrame."""
    out = output_path or S.unique_path(spark, name)
    ckpt = checkpoint_path or S.unique_path(spark, f"{name}-checkpoint")
    spark.createDataFrame([], scored_stream.schema).write.mode("append").parquet(out)  # the folder exists even without input
    q = (scored_stream.writeStream.format("parquet").outputMode("append")
         .option("path", out).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    # The declared schema: input without rows gives an empty table.
    return spark.read.schema(scored_stream.schema).parquet(out)
