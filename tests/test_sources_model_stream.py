"""A1–A8 sources and sinks, S12/S13/D11/F6 model, T1 stream."""

import os
import tempfile

from conftest import SF_SMALL, ship
from pyspark.sql import functions as F

from traderisk import constants as K
from traderisk.operators import clean as C
from traderisk.operators import features as FE
from traderisk.operators import history as H
from traderisk.operators import model as M
from traderisk.operators import scoring as SC
from traderisk.operators import views as V
from traderisk.sources import readers as R
from traderisk.sources.tables import tables
from traderisk.streaming import deals_stream as T


def _tmp():
    return tempfile.mkdtemp(prefix="traderisk-test-")


def test_load_table_and_csv_round_trip(spark, make_shipments):
    df = make_shipments([ship("a"), ship("b", date=None), ship("c", invoice=12.5)])
    back, n = R.load_table(df, os.path.join(_tmp(), "ships"))
    assert n == 3 and back.schema == df.schema
    path = os.path.join(_tmp(), "csv")
    R.write_csv(df, path)
    again = R.read_shipments(spark, path, fmt="csv")
    assert sorted(again.collect()) == sorted(df.collect())


def test_parquet_reader_normalises_types(spark, make_shipments):
    df = make_shipments([ship("a", disputed=1)]).withColumn("was_disputed", F.lit(True)) \
        .withColumn("invoice_value_usd", F.col("invoice_value_usd").cast("double")).withColumn("extra", F.lit(1))
    path = os.path.join(_tmp(), "pq")
    df.write.parquet(path)
    r = R.read_shipments(spark, path).collect()[0]
    assert r.was_disputed == 1 and "extra" not in r.asDict()


def test_register_views(spark, make_shipments, make_risk):
    from conftest import risk
    names = V.register_views(spark, make_shipments([ship("a")]), make_risk([risk("X", "2024-01-01", 0.5, 0.5)]))
    for n in names:
        assert spark.table(n).count() == 1


def test_model_train_score_save_load_and_config(spark):
    t = tables(spark, SF_SMALL)
    training = T.materialise(M.training_frame(FE.engineer_features(t.shipments, t.country_risk)), "test-training")
    model = M.train_model(training, num_trees=5, max_depth=4)
    metrics = M.model_metrics(model, training).collect()[0]
    assert 0.0 <= metrics.test_accuracy <= 1.0 and 0.0 <= metrics.avg_risk_score <= 100.0
    majority = max(metrics.positive_rate, 1 - metrics.positive_rate)
    assert metrics.test_accuracy >= majority - 0.02
    feats = SC.deal_features(t.deals, H.buyer_profile(C.clean_shipments(t.shipments)), H.country_profile(t.country_risk))
    s1 = M.model_scores(model, feats)
    vals = [r.model_score for r in s1.collect()]
    assert len(vals) == t.deals.count() and all(0.0 <= v <= 100.0 for v in vals)
    path = os.path.join(_tmp(), "model")
    M.save_model(model, path)
    loaded = M.load_model(path)
    s2 = {r.deal_id: r.model_score for r in M.model_scores(loaded, feats).collect()}
    assert s2 == {r.deal_id: r.model_score for r in s1.collect()}
    imp = M.feature_importance(spark, model).collect()
    assert len(imp) == 10 and set(r.feature for r in imp) <= set(K.FEATURE_COLUMNS)
    scored = SC.score_deals(feats, model=model)
    assert scored.count() == t.deals.count()
    cfg_path = os.path.join(_tmp(), "config")
    R.write_model_config(spark, M.model_config(metrics.test_accuracy), cfg_path)
    cfg = R.read_model_config(spark, cfg_path)
    assert cfg["feature_columns"] == K.FEATURE_COLUMNS and cfg["score_bands"]["credit_ok"][2] == K.TERMS_LOW


def test_training_is_deterministic_for_a_seed(spark):
    t = tables(spark, SF_SMALL)
    training = T.materialise(M.training_frame(FE.engineer_features(t.shipments, t.country_risk)), "det-training")
    a = M.model_metrics(M.train_model(training, 4, 3, seed=1), training).collect()[0]
    b = M.model_metrics(M.train_model(training, 4, 3, seed=1), training).collect()[0]
    assert a.avg_risk_score == b.avg_risk_score


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    stream = q["score_deals_stream"](spark, SF_SMALL)
    batch = q["score_deals"](spark, SF_SMALL)
    cols = sorted(batch.columns)
    assert sorted(stream.columns) == cols
    assert stream.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(stream.select(cols)).count() == 0
