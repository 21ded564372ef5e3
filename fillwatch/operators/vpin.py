"""Equal-volume buckets and order-flow toxicity.

Buckets are closed greedily: volume is accumulated in time order, the bucket
closes on the trade that reaches the target, and the overshoot is forgotten.
Where a bucket closes therefore depends on every earlier close, which no window
can express. It can be searched for, though, in two short sequential passes:

* Only trades larger than a ``FINE``-th of the target can move a close by much, and a market has at most
  ``n_buckets * FINE`` of them. A walk over these alone gives each close a band of cumulative volume in which it lies: a close
  that falls into a large trade's jump is exactly its end, any other overshoots by less than a fine step.
* Only trades within the bands go through the exact walk, a few per cent of the volume at most.

Neither pass sees a whole market, however it is skewed and however large its largest trade is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwatch.config import CHUNK_SECONDS, MIN_STD
from fillwatch.operators.features import ORDER, buy_fraction
from fillwatch.operators.ordered import chunk_id, ordered_carry
from fillwatch.session import stored, width

#: Parts of a target; trades above one part are walked singly.
FINE = 1000
#: Share of a market's volume by which bands are widened against rounding.
ROUNDING = 1e-9
_BAND_DDL = "market STRING, low ARRAY<DOUBLE>, high ARRAY<DOUBLE>"
_CLOSE_DDL = "market STRING, close_i BIGINT"


def close_bands(before: np.ndarray, after: np.ndarray, target: float, n: int, slack: float) -> tuple[list[float], list[float]]:
    """Least and greatest cumulative volume at which each of ``n`` buckets can close, given the large trades' jumps in order."""
    low, high, lo, hi = [], [], 0.0, 0.0

    def ahead(x: float, shift: float, step: float) -> float:
        k = int(np.searchsorted(after, x - slack))
        if k < len(after) and x > before[k] + shift:
            return float(after[k])
        return min(x + step, float(before[k]) if k < len(after) and step else np.inf)

    for _ in range(n):
        lo, hi = ahead(lo + target, slack, 0.0), ahead(hi + target, -slack, target / FINE)
        low.append(lo - slack)
        high.append(hi + slack)
    return low, high


def _bands(n_buckets: int):
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        market, parts = None, []

        def done():
            before, after = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("before", "cum"))
            first = parts[0].iloc[0]
            return (market, *close_bands(before[after > 0], after[after > 0], first["target"], n_buckets - 1, first["slack"]))

        for pdf in batches:
            out = []
            for name, own in pdf.groupby("market", sort=False):
                if name != market and market is not None:
                    out.append(done())
                    parts = []
                market = name
                parts.append(own)
            yield pd.DataFrame(out, columns=["market", "low", "high"])
        if market is not None:
            yield pd.DataFrame([done()], columns=["market", "low", "high"])

    return go


def _close_points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk candidate trades in market order and emit the index of each bucket's last trade."""
    market, level, done = None, 0.0, 0
    for pdf in batches:
        names, cums = pdf["market"].to_numpy(), pdf["cum"].to_numpy()
        places = pdf["i"].to_numpy()
        targets, limits = pdf["target"].to_numpy(), pdf["n_close"].to_numpy()
        out = []
        starts = [0] + [k for k in range(1, len(names)) if names[k] != names[k - 1]] + [len(names)]
        for a, b in zip(starts[:-1], starts[1:]):
            if a == b:
                continue
            if names[a] != market:
                market, level, done = names[a], 0.0, 0
            here = a
            while done < limits[a]:
                here += int(cums[here:b].searchsorted(level + targets[a], side="left"))
                if here >= b:
                    break
                level = float(cums[here])
                out.append((market, int(places[here])))
                done += 1
        yield pd.DataFrame(out, columns=["market", "close_i"])


def close_candidates(run: DataFrame, n_buckets: int) -> DataFrame:
    """Trades ``market, i, cum, target, n_close`` at which a bucket may close, from running volumes ``market, i, vol, cum``."""
    facts = run.groupBy("market").agg(F.max("cum").alias("total")).where(F.col("total") >= MIN_STD).select(
        "market", (F.col("total") / n_buckets).alias("target"), (F.col("total") * ROUNDING).alias("slack"))
    large = run.join(facts, "market").where(F.col("vol") > F.col("target") / FINE).select(
        "market", "i", (F.col("cum") - F.col("vol")).alias("before"), "cum", "target", "slack")
    # a market without large trades has a row of its own, so that it gets bands, too
    none = facts.select("market", F.lit(-1).cast("long").alias("i"), F.lit(0.0).alias("before"), F.lit(0.0).alias("cum"), "target", "slack")
    bands = large.unionByName(none).repartition(width(run), "market").sortWithinPartitions("market", "i").mapInPandas(_bands(n_buckets), _BAND_DDL)
    inside = F.exists(F.arrays_zip("low", "high"), lambda b: (F.col("cum") >= b["low"]) & (F.col("cum") <= b["high"]))
    return run.select("market", "i", "cum").join(bands, "market").where(inside).join(facts, "market") \
              .select("market", "i", "cum", "target", F.lit(n_buckets - 1).alias("n_close"))


def volume_buckets(features: DataFrame, n_buckets: int = 50,
                   chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Features with relative volume ``vol``, running volume ``cum`` and 0-based ``bucket``."""
    if n_buckets < 1:
        raise ValueError("n_buckets must be >= 1")
    base = features.withColumn("vol", F.exp("log_size_ratio")).withColumn("chunk", chunk_id("ts", chunk_seconds))
    run = stored(ordered_carry(base, "market", ORDER, sums={"cum": F.col("vol")}), "running-volume")  # read four times below
    near = close_candidates(run, n_buckets)
    walk = near.repartition(width(near), "market").sortWithinPartitions("market", "i") \
               .mapInPandas(_close_points, _CLOSE_DDL)
    # At most n_buckets - 1 indices per market.
    closes = walk.groupBy("market").agg(F.collect_list("close_i").alias("closes"))
    spots = F.size(F.filter("closes", lambda c: c < F.col("i")))
    return run.join(closes, "market", "left").withColumn(
        "bucket", F.when(F.col("closes").isNull(), F.lit(0)).otherwise(spots).cast("int")).drop("closes")


def bucket_toxicity(bucketed: DataFrame) -> DataFrame:
    """|buy - sell| over volume of each bucket."""
    b = bucketed.groupBy("market", "bucket").agg(
        F.sum(F.col("buy_frac") * F.col("vol")).alias("buy"),
        F.sum((1.0 - F.col("buy_frac")) * F.col("vol")).alias("sell"),
        F.sum("vol").alias("bucket_vol"), F.count(F.lit(1)).alias("n_trades"))
    return b.select("market", "bucket", "bucket_vol", "n_trades",
                    F.when(F.col("bucket_vol") > 0, F.abs(F.col("buy") - F.col("sell")) / F.col("bucket_vol"))
                    .otherwise(0.0).alias("vpin"))


def trade_vpin(features: DataFrame, n_buckets: int = 50, native: bool = False,
               chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Each trade with the toxicity of the bucket it fell into."""
    bucketed = stored(volume_buckets(buy_fraction(features, native), n_buckets, chunk_seconds), "buckets")
    tox = bucket_toxicity(bucketed).select("market", "bucket", "vpin")
    return bucketed.join(tox, ["market", "bucket"])
