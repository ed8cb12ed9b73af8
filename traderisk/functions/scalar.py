"""Column-expression helpers (all JVM-side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traderisk import constants as K


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c, digits: int) -> Column:
    """Round half away from zero.

    ``floor(x * 10^n + 0.5) / 10^n`` in DOUBLE gives the same bits in every
    engine, unlike ``round`` (decimal-text rounding in Spark, binary in others).
    """
    scale = float(10 ** digits)
    x = col(c)
    size = F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
    return F.when(x < 0, -size).otherwise(size)


def strip_upper(c) -> Column:
    """Python ``str.strip().upper()``: drop all leading/trailing whitespace."""
    return F.upper(F.regexp_replace(col(c), r"^\s+|\s+$", ""))


def clip01(c) -> Column:
    """``np.clip(x, 0, 1)`` keeping nulls (``least``/``greatest`` skip nulls)."""
    x = col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def score_category(score) -> Column:
    s = col(score)
    return (F.when(s < K.LOW_BAND_UPPER, F.lit(K.CATEGORY_LOW))
            .when(s < K.MEDIUM_BAND_UPPER, F.lit(K.CATEGORY_MEDIUM))
            .when(s.isNotNull(), F.lit(K.CATEGORY_HIGH)))


def score_terms(score) -> Column:
    s = col(score)
    return (F.when(s < K.LOW_BAND_UPPER, F.lit(K.TERMS_LOW))
            .when(s < K.MEDIUM_BAND_UPPER, F.lit(K.TERMS_MEDIUM))
            .when(s.isNotNull(), F.lit(K.TERMS_HIGH)))


def score_action(score) -> Column:
    s = col(score)
    return (F.when(s < K.LOW_BAND_UPPER, F.lit(K.ACTION_LOW))
            .when(s < K.MEDIUM_BAND_UPPER, F.lit(K.ACTION_MEDIUM))
            .when(s.isNotNull(), F.lit(K.ACTION_HIGH)))


def stability_band(c) -> Column:
    x = col(c)
    return (F.when(x > K.STABILITY_BAND_HIGH, F.lit("stable"))
            .when(x > K.STABILITY_BAND_MID, F.lit("moderate"))
            .when(x.isNotNull(), F.lit("unstable")))


def volatility_band(c) -> Column:
    x = col(c)
    return F.when(x > K.VOLATILITY_BAND_HIGH, F.lit("high")).when(x.isNotNull(), F.lit("normal"))


def reliability_band(c) -> Column:
    x = col(c)
    return (F.when(x >= K.RELIABILITY_BAND_HIGH, F.lit("good"))
            .when(x >= K.RELIABILITY_BAND_MID, F.lit("fair"))
            .when(x.isNotNull(), F.lit("poor")))


def safe_rate(numerator, denominator) -> Column:
    """``SAFE_DIVIDE``: NULL on a zero denominator, DOUBLE result."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def fmt_int(template: str, value) -> Column:
    """Python ``f"{x:.0f}"`` with half-up ties: round first, format as integer."""
    return F.format_string(template, half_up(value, 0).cast("long"))


def fmt_pct1(template: str, rate) -> Column:
    """Python ``f"{x:.1%}"``: rate*100 rounded half up to one decimal."""
    return F.format_string(template, half_up(col(rate) * F.lit(100.0), 1))


def fmt_2dp(template: str, value) -> Column:
    return F.format_string(template, half_up(value, 2))


def reasons_text(arr) -> Column:
    """Flatten a reasons array into one string (for display and hashing)."""
    return F.array_join(col(arr), " | ")
