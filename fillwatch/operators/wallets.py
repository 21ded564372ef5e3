"""Wallet-level screening scores, ranks and shortlists."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fillwatch.config import CHUNK_SECONDS
from fillwatch.operators.features import size_zscore
from fillwatch.operators.ordered import average_ranks, global_position
from fillwatch.operators.vpin import trade_vpin
from fillwatch.session import scalar_row, stored


def size_scores(features: DataFrame) -> DataFrame:
    return size_zscore(features).groupBy("wallet").agg(F.max("abs_z").alias("score"))


def wallet_volumes(features: DataFrame) -> DataFrame:
    return features.groupBy("wallet").agg(F.sum(F.exp("log_size_ratio")).alias("volume"))


def vpin_scores(features: DataFrame, n_buckets: int = 50, native: bool = False,
                chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Volume-weighted mean toxicity of the buckets a wallet traded in."""
    rows = trade_vpin(features, n_buckets, native, chunk_seconds)
    return rows.groupBy("wallet").agg((F.sum(F.col("vol") * F.col("vpin")) / F.sum("vol")).alias("score"))


def volume_controlled(scores: DataFrame, volumes: DataFrame) -> DataFrame:
    """Residual of the score on log volume; 0 for wallets without volume or when fewer than two have any."""
    both = scores.join(volumes, "wallet")
    lv = F.when(F.col("volume") > 0, F.log("volume"))
    fit = both.agg(F.count(lv).alias("_n"), F.regr_slope("score", lv).alias("_b"),
                   F.regr_intercept("score", lv).alias("_a"), F.avg(F.when(lv.isNotNull(), F.col("score"))).alias("_m"))
    line = F.coalesce(F.col("_a") + F.col("_b") * lv, F.col("_m"))  # constant volume: mean only
    out = both.join(F.broadcast(fit))  # one row
    return out.select("wallet", "score", "volume",
                      F.when((F.col("_n") < 2) | lv.isNull(), 0.0).otherwise(F.col("score") - line).alias("residual"))


def rank_correlation(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman correlation over rows, NULL when a side is constant; equal pairs are merged first.

    The pairs are computed once and stored: sums of doubles computed anew can differ in their last digit, and then ranks would not meet their values."""
    tally = stored(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("_w")), "rank-pairs")
    ra = average_ranks(tally, a, "_ra", F.col("_w")).select(a, "_ra")
    rb = average_ranks(tally, b, "_rb", F.col("_w")).select(b, "_rb")
    x = tally.join(ra, a).join(rb, b)
    # Ranks have a known mean, (n + 1) / 2; centring first keeps the sums exact at scale.
    n = tally.agg(F.sum("_w").alias("_n"))
    x = x.join(F.broadcast(n)).select("_w", (F.col("_ra") - (F.col("_n") + 1) / 2.0).alias("u"),
                                      (F.col("_rb") - (F.col("_n") + 1) / 2.0).alias("v"))
    s = x.agg(F.sum(F.col("_w") * F.col("u") * F.col("v")).alias("uv"), F.sum("_w").alias("n"),
              F.sum(F.col("_w") * F.col("u") * F.col("u")).alias("uu"),
              F.sum(F.col("_w") * F.col("v") * F.col("v")).alias("vv"))
    return s.select(F.when((F.col("uu") > 0) & (F.col("vv") > 0),
                           F.col("uv") / F.sqrt(F.col("uu") * F.col("vv"))).alias("rho"),
                    F.coalesce(F.col("n"), F.lit(0)).alias("n"))


def vpin_robustness(features: DataFrame, n_buckets: int = 50) -> DataFrame:
    native = vpin_scores(features, n_buckets, True).withColumnRenamed("score", "native")
    proxy = vpin_scores(features, n_buckets, False).withColumnRenamed("score", "proxy")
    return rank_correlation(native.join(proxy, "wallet"), "native", "proxy")


def wash_hits(features: DataFrame, window_seconds: float = 60.0) -> DataFrame:
    """Per wallet and market: eligible trades and those with an opposite move close in time.

    Only the nearest opposite move on either side matters, so the trades are
    binned by time and each is also shown to the bins its window reaches into.
    A task sees one wallet's trades in one market within three bins.
    """
    width = max(float(window_seconds), float(CHUNK_SECONDS))
    base = features.where(F.coalesce(F.col("dy"), F.lit(0.0)) != 0.0).select(
        "market", "wallet", F.col("ts").cast("double").alias("ts"), F.signum("dy").alias("sgn"))
    home = F.floor(F.col("ts") / width).cast("long")
    lo = F.floor((F.col("ts") - window_seconds) / width).cast("long")
    hi = F.floor((F.col("ts") + window_seconds) / width).cast("long")
    shown = base.select("*", home.alias("home"), F.explode(F.sequence(lo, hi)).alias("bin"))
    before = Window.partitionBy("market", "wallet", "bin").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    # backwards, too: a frame to the end of the bin would be computed anew for every row
    after = Window.partitionBy("market", "wallet", "bin").orderBy(F.desc("ts")).rangeBetween(Window.unboundedPreceding, 0)
    up, down = F.when(F.col("sgn") > 0, F.col("ts")), F.when(F.col("sgn") < 0, F.col("ts"))
    near = shown.select("*", F.max(up).over(before).alias("pu"), F.max(down).over(before).alias("pd"),
                        F.min(up).over(after).alias("nu"), F.min(down).over(after).alias("nd")) \
                .where(F.col("home") == F.col("bin"))
    prev = F.when(F.col("sgn") > 0, F.col("pd")).otherwise(F.col("pu"))
    nxt = F.when(F.col("sgn") > 0, F.col("nd")).otherwise(F.col("nu"))
    hit = F.coalesce(F.col("ts") - prev <= window_seconds, F.lit(False)) | \
        F.coalesce(nxt - F.col("ts") <= window_seconds, F.lit(False))
    return near.groupBy("market", "wallet").agg(F.count(F.lit(1)).alias("eligible"),
                                                F.sum(hit.cast("int")).cast("long").alias("hits"))


def wash_scores(features: DataFrame, window_seconds: float = 60.0) -> DataFrame:
    """Hits over eligible trades pooled over markets where the wallet traded at least twice."""
    traded = features.groupBy("market", "wallet").agg(F.count(F.lit(1)).alias("_n"))
    pooled = traded.join(wash_hits(features, window_seconds), ["market", "wallet"], "left") \
        .withColumn("_ok", F.col("_n") >= 2)
    s = pooled.groupBy("wallet").agg(F.sum(F.when(F.col("_ok"), F.col("hits"))).alias("h"),
                                     F.sum(F.when(F.col("_ok"), F.col("eligible"))).alias("e"))
    return s.select("wallet", F.when(F.col("e") > 0, F.col("h") / F.col("e")).otherwise(0.0).alias("score"))


def ordinal_ranks(scores: DataFrame, score: str = "score", tie: str = "wallet", name: str = "rank") -> DataFrame:
    """0-based ranks, larger score larger rank, ties in ``tie`` order."""
    return global_position(scores, [score, tie], name)


def combine_and_flag(components: DataFrame, columns: Sequence[str], weights: Sequence[float],
                     quantile: float = 0.5, tie: str = "wallet_id") -> DataFrame:
    """Weighted mean of ordinal ranks and the flag for the top share.

    At least a tenth of the wallets is flagged. ``components`` has one row per
    wallet with ``tie`` and the score columns.
    """
    if not 0.0 <= quantile < 1.0:
        raise ValueError("quantile must be in [0, 1)")
    if any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must be non-negative and not all zero")
    ranked = components
    for c in columns:
        ranked = ordinal_ranks(ranked, c, tie, f"rank_{c}")
    combined = sum(F.col(f"rank_{c}") * float(w) for c, w in zip(columns, weights)) / float(sum(weights))
    ranked = ranked.withColumn("combined", combined).withColumn("_neg", -F.col("combined"))
    placed = global_position(ranked, ["_neg", tie], "_place").drop("_neg")
    n = scalar_row(placed.agg(F.count(F.lit(1)).alias("n")))["n"]
    n_flag = min(max(math.ceil((1.0 - quantile) * n), math.ceil(0.1 * n)), n)
    return placed.withColumn("flagged", F.col("_place") < n_flag).drop("_place")


def prefilter(features: DataFrame, ids: DataFrame, quantile: float = 0.5,
              weights: Sequence[float] = (1.0, 1.0, 1.0), n_buckets: int = 50,
              window_seconds: float = 60.0) -> DataFrame:
    """Rank-combined size, toxicity and wash scores with the shortlist flag."""
    comp = ids.select("wallet", "wallet_id")
    parts = [("size_zscore", size_scores(features)), ("vpin", vpin_scores(features, n_buckets)),
             ("wash", wash_scores(features, window_seconds))]
    for name, part in parts:
        comp = comp.join(part.withColumnRenamed("score", name), "wallet", "left") \
                   .withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))
    return combine_and_flag(comp, [n for n, _ in parts], weights, quantile)


def two_tier(ranking: DataFrame, theta: str = "theta", flag: str = "flagged", tie: str = "wallet_id") -> DataFrame:
    """Ranking score: flagged wallets keep theta, the others fall below the lowest flagged in id order."""
    facts = ranking.agg((F.coalesce(F.min(F.when(F.col(flag), F.col(theta))), F.min(theta)) - 1.0).alias("_floor"),
                        F.count(F.lit(1)).alias("_n"))
    below = F.col("_floor") - F.col(tie) / F.col("_n")
    return ranking.join(F.broadcast(facts)).withColumn(  # one row of facts
        "tier_score", F.when(F.col(flag), F.col(theta)).otherwise(below)).drop("_floor", "_n")


def counted_trades(features: DataFrame, ids: DataFrame) -> DataFrame:
    """Trades per wallet that count as evidence (each market's first trade does not)."""
    n = features.where("i >= 1").groupBy("wallet").agg(F.count(F.lit(1)).alias("n_trades"))
    return ids.join(n, "wallet", "left").withColumn("n_trades", F.coalesce("n_trades", F.lit(0)))


def mean_filtered_score(scores: DataFrame, ids: DataFrame) -> DataFrame:
    m = scores.groupBy("wallet").agg(F.avg("p_z").alias("mean_p_z"))
    return ids.join(m, "wallet", "left").withColumn("mean_p_z", F.coalesce("mean_p_z", F.lit(0.0)))


def top_k(scores: DataFrame, k: int, score: str = "score", tie: str = "wallet_id") -> DataFrame:
    """The ``k`` best wallets, ties to the lower id, listed by id."""
    return scores.orderBy(F.desc(score), tie).limit(max(int(k), 1)).orderBy(tie)


def ranking_table(scores: DataFrame, counts: DataFrame, score: str = "score", tie: str = "wallet_id") -> DataFrame:
    """Every wallet with its 1-based rank by score and its trade count."""
    joined = counts.join(scores.select("wallet", score), "wallet", "left") \
                   .withColumn(score, F.coalesce(F.col(score), F.lit(0.0))).withColumn("_neg", -F.col(score))
    return global_position(joined, ["_neg", tie], "_p").withColumn("rank", F.col("_p") + 1).drop("_p", "_neg")


def theta_without_slopes(posterior: DataFrame, a: float = 1.0, b: float = 19.0) -> DataFrame:
    """Beta-count propensity per wallet from trades after the first of each market."""
    s = posterior.where("i >= 1").groupBy("wallet").agg(F.sum("p_z").alias("_s"), F.count(F.lit(1)).alias("n_trades"))
    return s.select("wallet", ((a + F.col("_s")) / (a + b + F.col("n_trades"))).alias("theta"), "n_trades")


