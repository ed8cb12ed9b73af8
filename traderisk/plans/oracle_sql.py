"""DuckDB SQL for every oracle-checked query.

Each statement starts with the same CTEs that map the driver's tables onto the
domain tables (FIXTURES.md §2), then states the query as plain SQL.  Literal
fractions are written as DOUBLE casts because both SQL dialects read ``0.3`` as
DECIMAL; rounding uses ``floor(x * 10^n + 0.5) / 10^n`` exactly as the Spark
side does.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Domain tables from the driver's tables
# ---------------------------------------------------------------------------
FIXTURE_CTES = """
_s0 AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_extendedprice, l.l_shipdate,
         c.c_custkey, n.n_name, p.p_type, o.o_orderpriority,
         CASE WHEN c.c_custkey % 10 < 2 THEN 2 WHEN c.c_custkey % 10 < 5 THEN 1 ELSE 0 END AS rt,
         CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 15 WHEN '3' THEN 30
              WHEN '4' THEN 60 ELSE 90 END AS base,
         ((date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) % 41) + 41) % 41 - 20 AS jitter,
         (l.l_partkey * 7 + l.l_suppkey * 13 + l.l_linenumber * 31 + l.l_orderkey * 3) % 100 AS h1,
         (l.l_partkey * 11 + l.l_suppkey * 17 + l.l_linenumber * 5 + l.l_orderkey * 19) % 100 AS h2
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
_s1 AS (
  SELECT *, CAST(greatest(0, base + CASE rt WHEN 2 THEN 20 WHEN 1 THEN 5 ELSE 0 END + jitter) AS INTEGER) AS delay
  FROM _s0
),
_s2 AS (
  SELECT *, CASE WHEN h1 < (CASE rt WHEN 2 THEN 12 WHEN 1 THEN 4 ELSE 1 END)
                          + (CASE WHEN delay > 120 THEN 10 WHEN delay > 60 THEN 5 ELSE 0 END)
                 THEN 1 ELSE 0 END AS disputed
  FROM _s1
),
shipments AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS shipment_id,
         'exporter_' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS exporter_id,
         'buyer_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS buyer_id,
         n_name AS buyer_country,
         CAST(l_partkey % 21 + 1 AS INTEGER) AS hs_code,
         p_type AS product_category,
         CAST(l_shipdate AS DATE) AS shipment_date,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS invoice_value_usd,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'advance' WHEN '2' THEN 'lc' WHEN '3' THEN 'credit_30'
              WHEN '4' THEN 'credit_60' ELSE 'credit_90' END AS payment_terms,
         delay AS payment_delay_days,
         disputed AS was_disputed,
         CASE WHEN h2 < CASE WHEN disputed = 1 THEN 20 WHEN rt = 2 THEN 70 WHEN rt = 1 THEN 88 ELSE 97 END
              THEN 1 ELSE 0 END AS was_paid_in_full
  FROM _s2
),
country_risk AS (
  SELECT n.n_name AS country,
         CAST(date_trunc('month', CAST(l.l_shipdate AS DATE)) AS DATE) AS month,
         least(floor(CAST(1000 * (2 + 3 * (n.n_nationkey % 5)) * sum(CASE WHEN l.l_returnflag <> 'R' THEN 1 ELSE 0 END) AS DOUBLE)
                     / count(*)), 10000) / CAST(10000 AS DOUBLE) AS political_stability_score,
         least(floor(CAST(400 * (1 + n.n_nationkey % 3) * sum(CAST(round(l.l_discount * 100) AS INTEGER)) AS DOUBLE)
                     / count(*)), 10000) / CAST(10000 AS DOUBLE) AS currency_volatility_index,
         CAST(CASE WHEN n.n_nationkey % 12 = 0 THEN 1 ELSE 0 END AS INTEGER) AS trade_sanctions_flag
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  GROUP BY n.n_name, n.n_nationkey, CAST(date_trunc('month', CAST(l.l_shipdate AS DATE)) AS DATE)
),
deals AS (
  SELECT o.o_orderkey AS deal_id,
         o.o_orderdate AS deal_ts,
         CASE o.o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'buyer_unknown'
              ELSE 'buyer_' || lpad(CAST(c.c_custkey AS VARCHAR), 8, '0') END AS buyer_id,
         CASE WHEN o.o_orderkey % 11 = 0 THEN 'Atlantis' ELSE concat(' ', lower(n.n_name)) END AS buyer_country,
         CAST(o.o_orderkey % 21 + 1 AS INTEGER) AS hs_code,
         CAST(o.o_totalprice AS DECIMAL(18,2)) AS invoice_value_usd,
         CAST(NULL AS VARCHAR) AS product_category,
         'credit_30' AS payment_terms
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
)
"""


def with_fixtures(*ctes: str, body: str) -> str:
    extra = "".join(",\n" + c.strip() for c in ctes)
    return "WITH " + FIXTURE_CTES.strip() + extra + "\n" + body.strip()


ORACLE: dict[str, str] = {}


def register(name: str, *ctes: str, body: str) -> None:
    ORACLE[name] = with_fixtures(*ctes, body=body)


# Fixture tables themselves (checked by the tests, not registered as queries).
FIXTURE_CHECKS = {
    "shipments": with_fixtures(body="SELECT * FROM shipments"),
    "country_risk": with_fixtures(body="SELECT * FROM country_risk"),
    "deals": with_fixtures(body="SELECT * FROM deals"),
}
