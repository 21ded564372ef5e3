"""Text, label and random-number column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def iso_utc(ts) -> Column:
    """Unix seconds as ``YYYY-MM-DDTHH:MM:SSZ``."""
    return F.date_format(F.timestamp_seconds(_c(ts)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text) -> Column:
    """Unix seconds of an ISO-8601 string or of a bare number; naive clock means UTC; else NULL."""
    c = F.trim(_c(text))
    stamp = F.try_to_timestamp(c)
    return F.coalesce(c.try_cast("double"), F.unix_micros(stamp) / F.lit(1e6))


def sufficiency(n) -> Column:
    """How far a wallet's trade count carries: below 20, below 100, or enough."""
    n = _c(n)
    return F.when(n < 20, "prior-dominated").when(n < 100, "weak").otherwise("meaningful")


def khat_band(k) -> Column:
    k = _c(k)
    bad = k.isNull() | F.isnan(k) | (F.abs(k) == float("inf"))
    return F.when(bad, "undefined").when(k < 0.5, "good").when(k <= 0.7, "acceptable").otherwise("unreliable")


def uniform01(seed: int, stream: int, *keys) -> Column:
    """Uniform number fixed by its keys alone, so it is the same under any partitioning."""
    h = F.xxhash64(F.lit(seed), F.lit(stream), *[_c(k) for k in keys])
    return F.shiftrightunsigned(h, 11) * F.lit(2.0 ** -53)


def shape_hint(bias_z, dispersion_z, threshold) -> Column:
    """Which deviation dominates a rank histogram."""
    b, d, t = _c(bias_z), _c(dispersion_z), threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (F.when((F.abs(b) < t) & (F.abs(d) < t), "none")
             .when((F.abs(d) >= F.abs(b)) & (d > 0), "too narrow")
             .when(F.abs(d) >= F.abs(b), "too wide")
             .when(b > 0, "biased low").otherwise("biased high"))
