"""Truncate-and-load of typed tables (A4), atomic for readers, with a channel for rejected CSV rows (A1–A3).

A table is a folder of versions.  A load writes a new version beside the current
one and then marks it with an empty file whose name carries the row count; readers
take the newest marked version.  Creating that file is the only step that readers
can see, and it needs no rename, so it works on object stores too.  A load that is
killed leaves an unmarked version that nobody reads and the next load removes.

    <table>/v-00000007-3f2a…/part-….parquet
    <table>/v-00000007-3f2a…/_loaded.60000
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The usual row-group size: large enough for few footer entries at scale.
ROW_GROUP_BYTES = 128 * 1024 * 1024
FLAG_COLUMNS = ("was_disputed", "was_paid_in_full", "trade_sanctions_flag")
_VERSION = re.compile(r"v-(\d{8})-[0-9a-f]{12}")
_MARK = re.compile(r"_loaded\.(\d+)")
ACCEPTED = "accepted"


class _Folder:
    """The few Hadoop file-system calls that versions need, on whatever store ``path`` is."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = path.rstrip("/")

    def names(self, *below: str) -> list[str]:
        where = self._path("/".join([self.path, *below]))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def create(self, *below: str) -> None:
        self.fs.create(self._path("/".join([self.path, *below])), False).close()

    def remove(self, *below: str) -> None:
        self.fs.delete(self._path("/".join([self.path, *below])), True)


def _versions(folder: _Folder) -> list[tuple[str, int | None]]:
    """(version, rows), oldest first; rows is None where the load has not ended."""
    out = []
    for name in folder.names():
        if _VERSION.fullmatch(name):
            rows = [int(m[1]) for x in folder.names(name) if (m := _MARK.fullmatch(x))]
            out.append((name, rows[0] if rows else None))
    return out


def current_version(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """(folder, rows) of the table's newest complete version."""
    loaded = [(name, rows) for name, rows in _versions(_Folder(spark, path)) if rows is not None]
    return (f"{path.rstrip('/')}/{loaded[-1][0]}", loaded[-1][1]) if loaded else None


def open_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The table's newest complete version."""
    found = current_version(spark, path)
    if found is None:
        raise FileNotFoundError(f"no complete version of a table in {path}")
    version = found[0]
    if f"{ACCEPTED}=true" in _Folder(spark, version).names():
        version = f"{version}/{ACCEPTED}=true"
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(version)


def _load(df: DataFrame, path: str, partition: list[str], keep: int, rows_in: str = "") -> int:
    """Write and mark a version; returns its rows, taken from the footers of the files just written."""
    spark = df.sparkSession
    folder = _Folder(spark, path)
    before = _versions(folder)
    number = max((int(_VERSION.fullmatch(name)[1]) for name, _ in before), default=0) + 1
    version = f"v-{number:08d}-{uuid.uuid4().hex[:12]}"
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).partitionBy(*partition).parquet(f"{folder.path}/{version}")
    rows = _rows(spark, f"{folder.path}/{version}", rows_in)
    folder.create(version, f"_loaded.{rows}")
    complete = [name for name, n in before if n is not None]
    for name, n in before:
        # Readers that began on the versions kept still finish; a load killed earlier is cleared away.
        if n is None or name not in complete[len(complete) - keep:]:
            folder.remove(name)
    return rows


def _rows(spark: SparkSession, version: str, part: str = "") -> int:
    """Rows by the Parquet footers: no column is read.  (An ``Observation`` on the write would tell
    them too, but leaves the session in a state that Spark ML's closures cannot be shipped from.)"""
    if part and part not in _Folder(spark, version).names():
        return 0
    return spark.read.schema("none string").parquet(f"{version}/{part}" if part else version).count()


def load_table(df: DataFrame, path: str, keep: int = 1) -> tuple[DataFrame, int]:
    """A4: truncate-and-load a typed table; return the read-back frame and its row count.

    The count comes from the written files' footers, not from a second evaluation of
    ``df``.  ``keep`` earlier versions stay for readers that began on them.
    """
    rows = _load(df, path, [], keep)
    return open_table(df.sparkSession, path), rows


# ---------------------------------------------------------------------------
# CSV with a channel for rejected rows
# ---------------------------------------------------------------------------
def flag_of(name: str) -> Column:
    """0/1 or true/false as an integer, anything else NULL."""
    word = F.lower(F.trim(F.col(name)))
    return F.when(word.isin("1", "true"), 1).when(word.isin("0", "false"), 0)


def _typed(field: T.StructField) -> Column:
    """The text of a CSV field in its declared type, NULL if it does not fit."""
    text = F.trim(F.col(field.name))
    if field.name in FLAG_COLUMNS:
        return flag_of(field.name).cast(field.dataType)
    if isinstance(field.dataType, T.StringType):
        return F.col(field.name)
    if isinstance(field.dataType, T.DateType):
        text = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    return text.try_cast(field.dataType)


def checked_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Every row of the CSV in its declared types, with ``_line`` (the row as text) and ``_reason`` (NULL: accepted).

    A row is rejected when it has not the declared number of columns, or where a
    text that is not empty does not fit its column's type; all such columns are named.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField("_broken", T.StringType())])
    rows = (spark.read.schema(text).option("header", header).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_broken").csv(path))
    typed = [_typed(f).alias(f"_typed_{f.name}") for f in schema.fields]
    line = F.coalesce("_broken", F.to_csv(F.struct(*[f.name for f in schema.fields])))
    parsed = rows.select(*[f.name for f in schema.fields], "_broken", line.alias("_line"), *typed)

    def kind(f: T.StructField) -> str:
        return "flag" if f.name in FLAG_COLUMNS else f.dataType.simpleString()
    wrong = [F.when(F.col(f.name).isNotNull() & F.col(f"_typed_{f.name}").isNull(), F.lit(f"{f.name} is no {kind(f)}"))
             for f in schema.fields]
    reason = F.when(F.col("_broken").isNotNull(), F.lit("wrong number of columns")).otherwise(F.nullif(F.concat_ws("; ", *wrong), F.lit("")))
    return parsed.select(*[F.col(f"_typed_{f.name}").alias(f.name) for f in schema.fields], "_line", reason.alias("_reason"))


@dataclass
class CsvLoad:
    """What a CSV load made: the table, and the rejected rows (line, reason) written beside it."""

    table: DataFrame
    rows: int
    rejected: DataFrame
    rejected_rows: int


def load_csv(spark: SparkSession, csv_path: str, schema: T.StructType, path: str, header: bool = True, keep: int = 1) -> CsvLoad:
    """A1–A4 over CSV: load what fits the declared schema, keep every other row with its reason.

    One pass over the CSV writes both; both become readable in the same step.
    """
    checked = checked_csv(spark, csv_path, schema, header)
    good = F.col("_reason").isNull()
    # The line is kept of rejected rows only.
    split = checked.withColumn("_line", F.when(~good, F.col("_line"))).withColumn(ACCEPTED, good)
    rows = _load(split, path, [ACCEPTED], keep, f"{ACCEPTED}=true")
    version = current_version(spark, path)[0]
    parts = _Folder(spark, version).names()

    def part(value: str, of: T.StructType) -> DataFrame:
        if f"{ACCEPTED}={value}" not in parts:
            return spark.createDataFrame([], of)
        return spark.read.schema(of).parquet(f"{version}/{ACCEPTED}={value}")
    rejected = part("false", T.StructType([T.StructField("_line", T.StringType()), T.StructField("_reason", T.StringType())]))
    return CsvLoad(part("true", schema), rows, rejected.select(F.col("_line").alias("line"), F.col("_reason").alias("reason")),
                   _rows(spark, version, f"{ACCEPTED}=false"))
