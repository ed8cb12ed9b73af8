"""Cleaning, country normalisation, month join and median fill."""

from conftest import risk, ship
from pyspark.sql import functions as F

from traderisk.operators import clean as C


def test_drop_incomplete_and_report(make_shipments):
    df = make_shipments([
        ship("s1"),
        ship("s2", buyer_id=None),
        ship("s3", country=None),
        ship("s4", hs_code=None),
        ship("s5", invoice=None),
    ])
    assert [r.shipment_id for r in C.drop_incomplete(df).collect()] == ["s1"]
    rep = C.drop_report(df).collect()[0]
    assert (rep.rows_in, rep.rows_dropped, rep.rows_kept) == (5, 4, 1)


def test_strip_upper_handles_tabs_and_case(make_shipments):
    df = make_shipments([ship("a", country="\tindia "), ship("b", country="  India\n"), ship("c", country="INDIA")])
    got = {r.buyer_country for r in C.clean_shipments(df).collect()}
    assert got == {"INDIA"}


def test_month_key_and_null_date(make_shipments):
    df = make_shipments([ship("a", date="2024-03-31"), ship("b", date=None)])
    rows = {r.shipment_id: r.shipment_month for r in C.clean_shipments(df).collect()}
    assert str(rows["a"]) == "2024-03-01" and rows["b"] is None


def test_left_join_fans_out_duplicates_and_fills(make_shipments, make_risk):
    ships = make_shipments([
        ship("a", country="india", date="2024-01-10"),
        ship("b", country="INDIA", date="2024-02-10"),
        ship("c", country="ATLANTIS", date="2024-01-10"),
        ship("d", country="INDIA", date=None),
    ])
    cr = make_risk([
        risk(" India", "2024-01-01", 0.2, 0.1, 1),
        risk("INDIA", "2024-02-01", 0.4, 0.3, 0),
        risk("INDIA", "2024-02-01", 0.8, 0.5, 0),   # duplicate key: fan-out
    ])
    out = C.join_country_risk(C.clean_shipments(ships), cr)
    assert out.count() == 5
    rows = out.collect()
    # joined stability values: 0.2, 0.4, 0.8 -> median 0.4; misses (c, d) take it
    filled = sorted(r.political_stability_score for r in rows if r.shipment_id in ("c", "d"))
    assert filled == [0.4, 0.4]
    vols = sorted(r.currency_volatility_index for r in rows if r.shipment_id in ("c", "d"))
    assert vols == [0.3, 0.3]
    assert {r.trade_sanctions_flag for r in rows if r.shipment_id in ("c", "d")} == {0}
    assert sorted(r.political_stability_score for r in rows if r.shipment_id == "b") == [0.4, 0.8]


def test_median_is_shipment_weighted_and_interpolated(make_shipments, make_risk):
    # 3 shipments in JAN (0.1), 1 in FEB (0.5): weighted values 0.1,0.1,0.1,0.5 -> median 0.1
    ships = make_shipments([ship(f"j{i}", date="2024-01-05") for i in range(3)]
                           + [ship("f", date="2024-02-05"), ship("x", country="NOWHERE")])
    cr = make_risk([risk("INDIA", "2024-01-01", 0.1, 0.2), risk("INDIA", "2024-02-01", 0.5, 0.6)])
    out = C.join_country_risk(C.clean_shipments(ships), cr)
    x = out.where(F.col("shipment_id") == "x").collect()[0]
    assert x.political_stability_score == 0.1 and x.currency_volatility_index == 0.2
    # even count: 2 JAN (0.1) + 2 FEB (0.5) -> interpolated 0.3
    ships2 = make_shipments([ship("j1", date="2024-01-05"), ship("j2", date="2024-01-06"),
                             ship("f1", date="2024-02-05"), ship("f2", date="2024-02-06"),
                             ship("x", country="NOWHERE")])
    x2 = C.join_country_risk(C.clean_shipments(ships2), cr).where(F.col("shipment_id") == "x").collect()[0]
    assert abs(x2.political_stability_score - 0.3) < 1e-12


def test_no_match_at_all_keeps_nulls(make_shipments, make_risk):
    ships = make_shipments([ship("a", country="ATLANTIS"), ship("b", country="ATLANTIS")])
    cr = make_risk([risk("INDIA", "2024-01-01", 0.1, 0.2)])
    rows = C.join_country_risk(C.clean_shipments(ships), cr).collect()
    assert all(r.political_stability_score is None and r.currency_volatility_index is None for r in rows)
    assert all(r.trade_sanctions_flag == 0 for r in rows)


def test_empty_shipments(make_shipments, make_risk):
    ships = make_shipments([])
    cr = make_risk([risk("INDIA", "2024-01-01", 0.1, 0.2)])
    assert C.join_country_risk(C.clean_shipments(ships), cr).count() == 0
