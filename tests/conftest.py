import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from traderisk import schemas  # noqa: E402
from traderisk.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", 8)
    yield s
    s.stop()


def ship(shipment_id, buyer_id="buyer_1", country="INDIA", date="2024-01-15", invoice=100.0, delay=10,
         disputed=0, paid=1, hs_code=1, category="Textiles", terms="lc", exporter="exporter_1"):
    """One shipments row in declared-schema order."""
    d = dt.date.fromisoformat(date) if isinstance(date, str) else date
    inv = None if invoice is None else Decimal(str(invoice)).quantize(Decimal("0.01"))
    return (shipment_id, exporter, buyer_id, country, hs_code, category, d, inv, terms, delay, disputed, paid)


def risk(country, month, stability, volatility, sanctions=0):
    return (country, dt.date.fromisoformat(month), stability, volatility, sanctions)


@pytest.fixture()
def make_shipments(spark):
    def _make(rows):
        return spark.createDataFrame(rows, schemas.SHIPMENTS)
    return _make


@pytest.fixture()
def make_risk(spark):
    def _make(rows):
        return spark.createDataFrame(rows, schemas.COUNTRY_RISK)
    return _make
