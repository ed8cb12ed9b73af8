"""A1–A4: atomic truncate-and-load, rejected CSV rows."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest
from conftest import ship
from pyspark.sql import functions as F

from traderisk import schemas
from traderisk.sources import loading as L


@pytest.fixture()
def place():
    return os.path.join(tempfile.mkdtemp(prefix="traderisk-load-"), "table")


def ids(df):
    return sorted(r.shipment_id for r in df.collect())


def test_load_replaces_and_counts(spark, make_shipments, place):
    first, n = L.load_table(make_shipments([ship("a"), ship("b")]), place)
    assert n == 2 and ids(first) == ["a", "b"]
    second, n = L.load_table(make_shipments([ship("c")]), place)
    assert n == 1 and ids(second) == ids(L.open_table(spark, place)) == ["c"]
    assert ids(first) == ["a", "b"]  # a reader that began before still finishes
    assert L.current_version(spark, place)[1] == 1
    third, n = L.load_table(make_shipments([]), place)
    assert n == 0 and ids(third) == [] and third.schema == second.schema
    assert len([x for x in os.listdir(place) if x.startswith("v-")]) == 2  # the current one and one kept


def test_a_load_that_dies_leaves_the_table_as_it_was(spark, make_shipments, place):
    L.load_table(make_shipments([ship("a"), ship("b")]), place)
    rows = make_shipments([ship(f"n{i}") for i in range(200)]).repartition(8)
    broken = rows.withColumn("hs_code", F.when(F.col("shipment_id") == "n77", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("hs_code")))
    with pytest.raises(Exception, match="lost"):
        L.load_table(broken, place)
    assert ids(L.open_table(spark, place)) == ["a", "b"]
    # A driver killed between the write and the mark: a whole version without its mark.
    L._Folder(spark, place).create("v-00000009-0123456789ab", "part-0.parquet")
    assert ids(L.open_table(spark, place)) == ["a", "b"]
    table, n = L.load_table(make_shipments([ship("c")]), place)
    assert n == 1 and ids(table) == ["c"]
    marks = [any(f.startswith("_loaded.") for f in os.listdir(os.path.join(place, v))) for v in os.listdir(place)]
    assert all(marks) and len(marks) == 2


def test_open_without_a_complete_version(spark, place):
    with pytest.raises(FileNotFoundError):
        L.open_table(spark, place)


HEADER = ",".join(schemas.SHIPMENTS.fieldNames())
GOOD = "s1,e1,b1,INDIA,3,Textiles,2024-01-15,12.50,lc,10,0,true"


def write(lines):
    folder = tempfile.mkdtemp(prefix="traderisk-csv-")
    with open(os.path.join(folder, "rows.csv"), "w") as f:
        f.write("\n".join([HEADER, *lines]) + "\n")
    return folder


def test_bad_dates_flags_numbers_and_short_rows_are_reported(spark, place):
    lines = [GOOD,
             "s2,e1,b1,INDIA,3,Textiles,2024-02-30,12.50,lc,10,0,1",           # no such day
             "s3,e1,b1,INDIA,3,Textiles,15.01.2024,12.50,lc,10,0,1",
             "s4,e1,b1,INDIA,3,Textiles,2024-01-15,12.50,lc,10,maybe,1",
             "s5,e1,b1,INDIA,three,Textiles,2024-01-15,cheap,lc,10,0,1",
             "s6,e1,b1,INDIA,3,Textiles,2024-01-15,12.50",                     # short
             "s7,e1,b1,INDIA,3,Textiles,2024-01-15,12.50,lc,10,0,1,more",      # long
             's8,e1,b1,"INDIA, NORTH",3,,,,,,,FALSE']                          # empty cells are NULL, not wrong
    loaded = L.load_csv(spark, write(lines), schemas.SHIPMENTS, place)
    assert (loaded.rows, loaded.rejected_rows) == (2, 6)
    rows = {r.shipment_id: r for r in loaded.table.collect()}
    assert loaded.table.schema == schemas.SHIPMENTS and set(rows) == {"s1", "s8"}
    assert rows["s1"].shipment_date == dt.date(2024, 1, 15) and rows["s1"].invoice_value_usd == Decimal("12.50")
    assert rows["s1"].was_paid_in_full == 1 and rows["s8"].was_paid_in_full == 0
    assert rows["s8"].buyer_country == "INDIA, NORTH" and rows["s8"].shipment_date is None and rows["s8"].was_disputed is None
    reasons = {r.line.split(",")[0]: r.reason for r in loaded.rejected.collect()}
    assert reasons == {"s2": "shipment_date is no date", "s3": "shipment_date is no date", "s4": "was_disputed is no flag",
                       "s5": "hs_code is no int; invoice_value_usd is no decimal(18,2)",
                       "s6": "wrong number of columns", "s7": "wrong number of columns"}
    assert lines[5] in {r.line for r in loaded.rejected.collect()}
    assert ids(L.open_table(spark, place, schemas.SHIPMENTS)) == ["s1", "s8"]


def test_all_good_all_bad_and_empty(spark, place):
    good = L.load_csv(spark, write([GOOD]), schemas.SHIPMENTS, place)
    assert (good.rows, good.rejected_rows, good.rejected.count()) == (1, 0, 0)
    bad = L.load_csv(spark, write(["x"]), schemas.SHIPMENTS, place)
    assert (bad.rows, bad.rejected_rows, bad.table.count()) == (0, 1, 0) and bad.table.schema == schemas.SHIPMENTS
    none = L.load_csv(spark, write([]), schemas.SHIPMENTS, place)
    assert (none.rows, none.rejected_rows, none.table.count(), none.rejected.count()) == (0, 0, 0, 0)


def test_other_schemas(spark, place):
    folder = tempfile.mkdtemp(prefix="traderisk-csv-")
    with open(os.path.join(folder, "rows.csv"), "w") as f:
        f.write("country,month,political_stability_score,currency_volatility_index,trade_sanctions_flag\n"
                "INDIA,2024-01-01,0.5,0.25,0\nINDIA,2024-02-01,high,0.25,0\nINDIA,2024-03-01,0.5,0.25,yes\n")
    loaded = L.load_csv(spark, folder, schemas.COUNTRY_RISK, place)
    assert loaded.rows == 1 and sorted(r.reason for r in loaded.rejected.collect()) == [
        "political_stability_score is no double", "trade_sanctions_flag is no flag"]
