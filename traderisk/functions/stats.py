"""Distributed exact statistics.

* ``weighted_medians`` — interpolated medians over a table that already is a
  bounded (value, weight) histogram, e.g. one row per (country, month).
* ``exact_medians_selection`` — interpolated medians of continuous columns by
  distributed selection (histogram rounds that narrow the search range); no
  task or driver ever holds more than a bounded number of values.
* ``exact_mean_scaled`` — the mean of fixed-precision doubles (scores rounded
  to n decimals) via integer sums, so the result does not depend on the order
  in which partitions are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _interpolate(lower: float, upper: float, n: int) -> float:
    """Interpolated median from the two middle values (Spark ``percentile`` form)."""
    pos = (n - 1) * 0.5
    lo_i, hi_i = int(pos // 1), int(-(-pos // 1))
    if lo_i == hi_i:
        return lower
    return (hi_i - pos) * lower + (pos - lo_i) * upper


def _bin(x, lo: float, hi: float, bins: int):
    """Monotone bin index of x in [lo, hi] (clipped, so float edges stay ordered)."""
    width = (hi - lo) / bins
    return F.greatest(F.lit(0), F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)))


def exact_medians_selection(df: DataFrame, cols: list[str], bins: int = 4096,
                            max_candidates: int = 100_000) -> dict[str, float | None]:
    """Exact interpolated medians of continuous columns by distributed selection.

    1. One aggregate: non-null count, min and max of every column.
    2. While a column's search range still holds more than ``max_candidates``
       rows and more than one value, one aggregate (all columns at once, map-side
       combined) counts rows in ``bins`` equal-width bins of the range; the bins
       holding the two middle ranks become the next range.
       A round that a few far-out values stretch takes these values off, so rounds
       go on until the range is small enough; there is no round limit.
    3. One aggregate of (value, count) inside each final range — at most
       ``max_candidates`` values — pins the middle ranks exactly.

    Every pass is a distributed aggregate over column-pruned rows; the driver
    receives at most ``bins`` counts or ``max_candidates`` values per column
    per pass, whatever the table size, and a value shared by many rows is one
    entry.  Returns plain floats (callers wrap them in a one-row frame).
    """
    first = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
                   *[F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(cols)],
                   *[F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    state = {}
    for i, c in enumerate(cols):
        n = first[f"n{i}"]
        if n == 0:
            continue
        # in-range predicate (a Column), rows below the range, target 0-based ranks
        state[c] = {"n": n, "cond": F.lit(True), "lo": first[f"lo{i}"], "hi": first[f"hi{i}"],
                    "below": 0, "in_range": n, "ranks": ((n - 1) // 2, n // 2)}
    medians: dict[str, float | None] = {c: None for c in cols}

    def narrowing():
        return [c for c, st in state.items() if st["in_range"] > max_candidates and st["lo"] < st["hi"]]

    while narrowing():
        active = narrowing()
        sel = []
        for c in active:
            st = state[c]
            x = F.col(c).cast("double")
            keep = st["cond"] & x.isNotNull()
            sel += [F.when(keep, _bin(x, st["lo"], st["hi"], bins)).alias(f"b_{c}"), F.when(keep, x).alias(f"v_{c}")]
        triples = ", ".join(f"'{c}', `b_{c}`, `v_{c}`" for c in active)
        long_df = df.select(*sel).select(F.expr(f"stack({len(active)}, {triples}) AS (_name, _bin, _value)")) \
            .where("_bin IS NOT NULL")
        cells_df = long_df.groupBy("_name", "_bin").agg(
            F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_min"), F.max("_value").alias("_max"))
        by_col: dict[str, list] = {c: [] for c in active}
        for r in cells_df.collect():  # ≤ bins rows per column
            by_col[r["_name"]].append((int(r["_bin"]), int(r["_n"]), float(r["_min"]), float(r["_max"])))
        for c in active:
            st = state[c]
            cells = sorted(by_col[c])
            running, picked = st["below"], []
            for b, n, _, _ in cells:
                for k in st["ranks"]:
                    if running <= k < running + n:
                        picked.append(b)
                running += n
            b1, b2 = min(picked), max(picked)
            kept = [cell for cell in cells if b1 <= cell[0] <= b2]
            x = F.col(c).cast("double")
            st["cond"] = st["cond"] & _bin(x, st["lo"], st["hi"], bins).between(b1, b2)
            st["below"] += sum(cell[1] for cell in cells if cell[0] < b1)
            st["in_range"] = sum(cell[1] for cell in kept)
            # The next range is the actual min/max of the kept rows: each round
            # separates at least the extreme values, so the search always ends.
            st["lo"], st["hi"] = min(cell[2] for cell in kept), max(cell[3] for cell in kept)

    live = list(state)
    if live:
        sel = [F.when(state[c]["cond"], F.col(c).cast("double")).alias(f"v_{c}") for c in live]
        pairs = ", ".join(f"'{c}', `v_{c}`" for c in live)
        vals = (df.select(*sel).select(F.expr(f"stack({len(live)}, {pairs}) AS (_name, _value)"))
                .where("_value IS NOT NULL").groupBy("_name", "_value").agg(F.count(F.lit(1)).alias("_n"))
                .collect())
        by_col = {c: [] for c in live}
        for r in vals:
            by_col[r["_name"]].append((float(r["_value"]), int(r["_n"])))
        for c in live:
            st = state[c]
            running, found = st["below"], {}
            for v, n in sorted(by_col[c]):
                for k in st["ranks"]:
                    if running <= k < running + n:
                        found[k] = v
                running += n
            k1, k2 = st["ranks"]
            medians[c] = _interpolate(found[k1], found[k2], st["n"])
    return medians


def weighted_medians(df: DataFrame, cols: list[str], weight: str) -> DataFrame:
    """One-row exact medians over a table that is already a (value, weight)
    histogram of bounded size — e.g. one row per (country, month) key."""
    return df.agg(*[F.expr(f"percentile(`{c}`, 0.5, `{weight}`)").cast("double").alias(f"{c}_median")
                    for c in cols])


def exact_mean_scaled(c, digits: int) -> Column:
    """Mean of values that carry at most ``digits`` decimals, order-independent."""
    scale = float(10 ** digits)
    x = F.col(c) if isinstance(c, str) else c
    total = F.sum(F.round(x * F.lit(scale)).cast("long"))
    return F.try_divide(total.cast("double"), F.count(x).cast("double") * F.lit(scale))
