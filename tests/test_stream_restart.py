"""A stream that dies in a micro-batch goes on from its checkpoint; every deal comes out once."""

import os
import tempfile

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from traderisk.operators import clean as C
from traderisk.operators import history as H
from traderisk.operators import scoring as SC
from traderisk.sources.tables import tables
from traderisk.streaming import deals_stream as T


@pytest.fixture(scope="module")
def parts(spark):
    t = tables(spark, SF_SMALL)
    bp = T.materialise(H.buyer_profile(C.clean_shipments(t.shipments)), "restart-buyers")
    cp = T.materialise(H.country_profile(t.country_risk), "restart-countries")
    return t.deals, bp, cp


def files_of(deals, folder, n=4):
    for i in range(n):
        deals.where(F.col("deal_id") % n == i).coalesce(1).write.mode("append").parquet(os.path.join(folder, "in"))
    return os.path.join(folder, "in")


def stream(spark, deals, source, bp, cp, dies_at=None):
    rows = spark.readStream.schema(deals.schema).option("maxFilesPerTrigger", 1).parquet(source)
    if dies_at is not None:
        rows = rows.withColumn("hs_code", F.when(F.col("deal_id") == dies_at, F.raise_error(F.lit("executor lost")).cast("int"))
                               .otherwise(F.col("hs_code")))
    return T.score_deals_stream(rows, bp, cp)


def test_restart_after_a_failed_batch_gives_every_deal_once(spark, parts):
    deals, bp, cp = parts
    folder = tempfile.mkdtemp(prefix="traderisk-restart-")
    source, out, ckpt = files_of(deals, folder), os.path.join(folder, "out"), os.path.join(folder, "ckpt")
    # The last file in the order of arrival holds this deal: earlier batches are committed, its batch fails.
    newest = max((f for f in os.scandir(source) if f.name.endswith(".parquet")), key=lambda f: f.stat().st_mtime_ns).path
    victim = spark.read.parquet(newest).agg(F.max("deal_id")).first()[0]
    with pytest.raises(Exception, match="executor lost"):
        T.run_available_now(spark, stream(spark, deals, source, bp, cp, dies_at=victim), output_path=out, checkpoint_path=ckpt)
    committed = len([f for f in os.listdir(os.path.join(ckpt, "commits")) if f.isdigit()])
    assert 0 < committed < 4
    before = spark.read.parquet(out).count()
    assert 0 < before < deals.count()
    scored = T.run_available_now(spark, stream(spark, deals, source, bp, cp), output_path=out, checkpoint_path=ckpt)
    batch = SC.flatten_reasons(SC.score_deals(SC.deal_features(deals, bp, cp)))
    assert scored.count() == deals.count() == scored.select("deal_id").distinct().count()
    cols = sorted(batch.columns)
    assert scored.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(scored.select(cols)).count() == 0
    # Nothing new: a further start adds nothing.
    again = T.run_available_now(spark, stream(spark, deals, source, bp, cp), output_path=out, checkpoint_path=ckpt)
    assert again.count() == deals.count()


def test_files_that_arrive_between_runs_are_scored_once(spark, parts):
    deals, bp, cp = parts
    folder = tempfile.mkdtemp(prefix="traderisk-restart-")
    source, out, ckpt = os.path.join(folder, "in"), os.path.join(folder, "out"), os.path.join(folder, "ckpt")
    half = deals.where("deal_id % 2 = 0")
    half.coalesce(1).write.parquet(source)
    first = T.run_available_now(spark, stream(spark, deals, source, bp, cp), output_path=out, checkpoint_path=ckpt)
    assert first.count() == half.count()
    deals.where("deal_id % 2 = 1").coalesce(1).write.mode("append").parquet(source)
    second = T.run_available_now(spark, stream(spark, deals, source, bp, cp), output_path=out, checkpoint_path=ckpt)
    assert second.count() == deals.count() == second.select("deal_id").distinct().count()
