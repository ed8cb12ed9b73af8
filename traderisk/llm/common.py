"""Shared helpers: table reads, written intermediate tables, Arrow batch plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from traderisk.session import ensure_checkpoint_dir

ROWS_PER_SLICE = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for ``name`` below the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut there, so a lost
    executor costs re-reading files, never re-running what made them."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def drop(df: DataFrame) -> None:
    """Remove the files behind a table that ``written`` returned."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in small slices: kernels hold a few hundred texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, a null as the empty text."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over slices of a few hundred rows."""
    def run(batches):
        return fn(slices(batches))
    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, keep: Callable[[list[str]], np.ndarray], column: str = "text") -> DataFrame:
    """The rows whose text ``keep`` (texts to booleans) wants; columns of any name and type stay."""
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(keep(texts_of(batch, column)), pa.bool_()))
    return map_batches(df, run, df.schema)
