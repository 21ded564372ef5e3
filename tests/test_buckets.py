"""Equal-volume buckets on markets that one task could not hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fillwatch.operators import vpin


def greedy(vols, target, n):
    cum, out, level = np.cumsum(vols), [], 0.0
    for _ in range(n):
        at = int(np.searchsorted(cum, level + target))
        if at >= len(cum):
            break
        out.append(at)
        level = cum[at]
    return out


@pytest.mark.parametrize("kind", ["even", "whale", "whales", "heavy", "few", "growing"])
def test_bands_hold_every_close(kind):
    rng = np.random.default_rng(7)
    vols = {"even": rng.uniform(0.5, 1.5, 60_000), "heavy": rng.pareto(1.1, 60_000) + 1e-3, "few": rng.uniform(0.1, 5, 40),
            "whale": np.insert(rng.uniform(0.5, 1.5, 60_000), 30_000, 15_000.0), "growing": np.linspace(0.01, 3, 60_000),
            "whales": np.insert(rng.uniform(0.5, 1.5, 60_000), [3, 9_000, 9_001, 50_000], 7_000.0)}[kind]
    cum, n = np.cumsum(vols), 50
    target, slack = cum[-1] / n, cum[-1] * vpin.ROUNDING
    large = vols > target / vpin.FINE
    low, high = vpin.close_bands((cum - vols)[large], cum[large], target, n - 1, slack)
    closes = greedy(vols, target, n - 1)
    assert all(low[k] <= cum[at] <= high[k] for k, at in enumerate(closes))
    if kind != "few":
        near = sum(((cum >= a) & (cum <= b)).sum() for a, b in zip(low, high))
        assert near < 0.06 * len(vols)


def test_no_task_sees_a_whole_market(spark):
    """One market has most trades and a trade of a fifth of its volume; few of its trades are walked, and buckets are exact."""
    n = 40_000
    rows = spark.range(n).select(F.when(F.col("id") < n - 50, "whale").otherwise("small").alias("market"), F.col("id").alias("i"),
                                 F.when(F.col("id") == n // 3, 9_000.0).otherwise(0.5 + F.rand(3)).alias("vol")).toPandas()
    rows["i"] -= np.where(rows["market"] == "small", n - 50, 0)
    rows["cum"] = rows.groupby("market")["vol"].cumsum()
    near = vpin.close_candidates(spark.createDataFrame(rows), 50)
    got = near.toPandas()
    assert (got["market"] == "whale").sum() < 0.06 * n
    closes = {m: [r for b in vpin._close_points(iter([g.sort_values("i")])) for r in b["close_i"]] for m, g in got.groupby("market")}
    for m, g in rows.groupby("market"):
        assert closes[m] == greedy(g["vol"].to_numpy(), g["cum"].iloc[-1] / 50, 49)
