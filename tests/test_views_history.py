"""Views, history, look-ups."""

from conftest import risk, ship

from traderisk.operators import dashboards as D
from traderisk.operators import history as H
from traderisk.operators import views as V


def test_buyer_history_modes_and_trend(make_shipments):
    rows = [
        # b1: mode tie between FRANCE and INDIA (2 each) -> FRANCE; categories all null -> NULL
        ship("a1", buyer_id="b1", country="INDIA", invoice=10, category=None),
        ship("a2", buyer_id="b1", country="FRANCE", invoice=10, category=None),
        ship("a3", buyer_id="b1", country="INDIA", invoice=10, category=None),
        ship("a4", buyer_id="b1", country="FRANCE", invoice=10, category=None),
        ship("c1", buyer_id="b2", invoice=1000, category="Steel"),
        ship("d1", buyer_id="b3", invoice=100, category="Food"),
        ship("d2", buyer_id="b3", invoice=100, category="Glass"),
        ship("n1", buyer_id=None, invoice=500),
    ]
    out = {r.buyer_id: r for r in H.buyer_history(make_shipments(rows)).collect()}
    assert set(out) == {"b1", "b2", "b3"}
    assert out["b1"].primary_country == "FRANCE" and out["b1"].primary_category is None
    assert out["b3"].primary_category == "Food"
    # overall row mean = (40 + 1000 + 200 + 500) / 8 = 217.5
    assert out["b1"].value_trend == "declining" and out["b2"].value_trend == "growing"
    assert out["b3"].value_trend == "declining"
    assert out["b1"].total_orders == 4 and str(out["b1"].first_order_date) == "2024-01-15"


def test_value_trend_boundaries(make_shipments):
    # overall mean 100; buyers at exactly 0.7x and 1.3x stay stable
    rows = [ship("a", buyer_id="lo", invoice=70), ship("b", buyer_id="hi", invoice=130),
            ship("c", buyer_id="m1", invoice=100), ship("d", buyer_id="m2", invoice=100)]
    out = {r.buyer_id: r.value_trend for r in H.buyer_history(make_shipments(rows)).collect()}
    assert out == {"lo": "stable", "hi": "stable", "m1": "stable", "m2": "stable"}


def test_buyer_risk_summary_two_countries_and_lookup(make_shipments):
    rows = [ship("a", buyer_id="b1", country="INDIA", delay=180, disputed=1, paid=0),
            ship("b", buyer_id="b1", country="INDIA", delay=0),
            ship("c", buyer_id="b1", country="FRANCE", delay=90, date="2024-03-01")]
    df = make_shipments(rows)
    s = {(r.buyer_id, r.buyer_country): r for r in V.buyer_risk_summary(df, as_of="2024-03-11").collect()}
    india = s[("b1", "INDIA")]
    assert india.total_shipments == 2 and india.days_since_last_order == 56
    # (90/180)*30 + 0.5*40 + (1-0.5)*30 = 15 + 20 + 15 = 50
    assert india.risk_score == 50.0 and india.risk_category == "Medium Risk"
    look = D.buyer_lookup(df, as_of="2024-03-11").collect()
    assert len(look) == 1 and look[0].primary_country == "INDIA" and look[0].total_orders == 2
    one = D.buyer_lookup(df, buyer_id="b1").collect()
    assert len(one) == 1
    assert D.buyer_lookup(df, buyer_id="nobody").count() == 0


def test_buyer_lookup_file_variant(make_shipments):
    rows = [ship("a", buyer_id="b1", country="france", date="2024-01-01", category="Steel", delay=10),
            ship("b", buyer_id="b1", country="INDIA", date="2024-02-01", category="Food", delay=20),
            ship("c", buyer_id="b1", country="INDIA", date="2024-03-01", category="Food", delay=31)]
    r = D.buyer_lookup(make_shipments(rows), variant="file").collect()[0]
    assert (r.primary_country, r.primary_category, r.total_orders) == ("FRANCE", "Steel", 3)
    assert r.avg_payment_delay_days == 20.3 and r.value_trend == "stable"


def test_leaderboard_top_n_and_ties(make_shipments):
    rows = [ship(f"s{i}", buyer_id=f"b{i:02d}", delay=i * 5) for i in range(30)]
    lb = V.buyer_risk_leaderboard(V.buyer_risk_summary(make_shipments(rows)), n=5).collect()
    assert [r.buyer_id for r in lb] == ["b29", "b28", "b27", "b26", "b25"]


def test_hs_outcomes_like_semantics(make_shipments):
    rows = [ship("a", terms="creditX"), ship("b", terms="credit"), ship("c", terms="credit_30"),
            ship("d", terms="advance"), ship("e", terms="lc")]
    r = V.shipment_outcomes_by_hs_code(make_shipments(rows)).collect()[0]
    assert (r.advance_count, r.lc_count, r.credit_count) == (1, 1, 2)  # '_' matches any one character
    assert r.total_shipments == 5


def test_country_trend_and_lookups(make_risk):
    cr = make_risk([risk("India", f"2023-{m:02d}-01", 0.05 * m, 0.1, 1 if m == 1 else 0) for m in range(1, 13)]
                   + [risk("India", f"2024-{m:02d}-01", 0.7, 0.2) for m in range(1, 4)])
    trend = {str(r.month): r for r in V.country_risk_trend(cr).collect()}
    # (1 - 0.05)*50 + 0.1*40 + 10 = 61.5
    assert trend["2023-01-01"].composite_risk_index == 61.5
    last = D.country_trend_last12(cr).orderBy("months_back").collect()
    assert len(last) == 12 and str(last[0].month) == "2024-03-01" and last[0].stability_band == "stable"
    lk = D.country_trend_lookup(cr, country=" india ", months=5).collect()
    assert len(lk) == 5 and all(r.country == "INDIA" for r in lk)
    assert D.country_trend_lookup(cr, country="France").count() == 0


def test_country_profile_and_over_time(make_shipments, make_risk):
    cr = make_risk([risk("India", "2024-01-01", 0.1234, 0.5, 0), risk("INDIA", "2024-02-01", 0.2345, 0.1, 1),
                    risk("France", "2024-01-01", 0.9, 0.1, 0)])
    prof = {r.country: r for r in H.country_profile(cr).collect()}
    assert abs(prof["INDIA"].avg_stability - 0.17895) < 1e-12 and prof["INDIA"].max_sanctions == 1
    ships = make_shipments([ship("a", country="india", invoice=10), ship("b", country="France", invoice=5)])
    over = D.country_risk_over_time(ships, cr, n=1).collect()
    assert {r.country for r in over} == {"INDIA"} and len(over) == 2


def test_exposure_tables(spark, make_shipments):
    rows = [ship("a", hs_code=1, category="X", invoice=10, disputed=1), ship("b", hs_code=1, category="Y"),
            ship("c", hs_code=99, category="X")]
    df = make_shipments(rows)
    cat = {r.product_category: r for r in D.exposure_by_category(df).collect()}
    assert cat["X"].total_shipments == 2 and cat["X"].dispute_rate == 0.5
    hs = {r.hs_code: r for r in D.exposure_by_hs_section(spark, df).collect()}
    assert hs[1].hs_label == "Textiles" and hs[99].hs_label is None


def test_first_shipment_nulls_last(make_shipments):
    df = make_shipments([ship("a", date=None, country="X"), ship("b", date="2024-05-01", country="Y"),
                         ship("c", date="2024-05-01", country="Z")])
    r = H.buyer_first_shipment(df).collect()[0]
    assert r.first_country == "Y"


def test_dataset_profile(make_shipments, make_risk):
    df = make_shipments([ship("a"), ship("b", buyer_id=None), ship("c", delay=400, disputed=1, paid=0)])
    cr = make_risk([risk("INDIA", "2024-01-01", 0.1, 0.2)])
    p = H.dataset_profile(df, cr).collect()[0]
    assert (p.n_shipments, p.n_incomplete, p.n_default_positive, p.n_default_negative) == (3, 1, 1, 1)
    assert p.n_country_months == 1


def test_filter_reaches_scan(spark):
    """The buyer filter of a look-up is pushed to the Parquet scan."""
    from traderisk.sources.tables import tables
    t = tables(spark, "/root/testdata/sf0.001")
    plan = D.buyer_lookup(t.shipments, buyer_id="buyer_00000001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(buyer_id), EqualTo(buyer_id,buyer_00000001)]" in plan


def test_lookup_of_one_buyer_compares_with_all_shipments(make_shipments):
    from traderisk.operators.dashboards import buyer_lookup
    df = make_shipments([ship("a", buyer_id="big", invoice=1000.0), ship("b", buyer_id="big", invoice=900.0),
                         ship("c", buyer_id="small", invoice=10.0)])
    for variant in ("warehouse", "file"):
        trend = {b: buyer_lookup(df, b, variant=variant).first()["value_trend"] for b in ("big", "small")}
        assert trend == {"big": "growing", "small": "declining"}


def test_rounding_is_half_away_from_zero(spark):
    from traderisk.functions.scalar import half_up
    rows = spark.createDataFrame([(-2.5,), (2.5,), (-0.4,)], "x double").select(half_up("x", 0).alias("r")).collect()
    assert [r["r"] for r in rows] == [-3.0, 3.0, 0.0]
