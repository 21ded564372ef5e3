"""Per-trade features and dataset assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwatch.config import CHUNK_SECONDS, MIN_STD
from fillwatch.functions.mathx import logit, norm_cdf
from fillwatch.operators.clean import before_resolution, clean_trades
from fillwatch.operators.ordered import chunk_id, global_position, ordered_carry
from fillwatch.session import cut

ORDER = ["ts", "tx_hash"]


def compute_features(trades: DataFrame, chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Gap, whole-market mean size, log size ratio, logit price and its first difference.

    One shuffle of the trades on (market, time chunk); everything a chunk needs
    from its market's past arrives through the per-chunk summary.
    """
    base = trades.withColumn("chunk", chunk_id("ts", chunk_seconds)).withColumn("y", logit("price"))
    wide = ordered_carry(base, "market", ORDER, lags={"_pts": "ts", "_py": "y"},
                         totals={"_vol": F.col("size")}, index="i", count="_n")
    s_bar = F.col("_vol") / F.col("_n")
    gap = F.when(F.col("_pts").isNull(), 0.0).otherwise(
        F.greatest(F.col("ts") - F.col("_pts"), F.lit(0)).cast("double"))
    return wide.select("market", "chunk", "i", "ts", "tx_hash", "wallet", "side", "price", "size",
                       gap.alias("delta"), s_bar.alias("s_bar"),
                       F.log(F.col("size") / s_bar).alias("log_size_ratio"),
                       "y", (F.col("y") - F.col("_py")).alias("dy"))


def causal_features(trades: DataFrame, chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """As ``compute_features`` but with the mean size of the trades seen so far."""
    base = trades.withColumn("chunk", chunk_id("ts", chunk_seconds)).withColumn("y", logit("price"))
    wide = ordered_carry(base, "market", ORDER, lags={"_pts": "ts"}, sums={"_cum": F.col("size")}, index="i")
    s_bar = F.col("_cum") / (F.col("i") + 1)
    gap = F.when(F.col("_pts").isNull(), 0.0).otherwise(
        F.greatest(F.col("ts") - F.col("_pts"), F.lit(0)).cast("double"))
    return wide.select("market", "chunk", "i", "ts", "tx_hash", "wallet", "side", "price", "size",
                       gap.alias("delta"), s_bar.alias("s_bar"),
                       F.log(F.col("size") / s_bar).alias("log_size_ratio"), "y")


def build_dataset(raw: DataFrame, markets: DataFrame, days: float = 7.0, require_wallet: bool = True,
                  chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Clean, cut before resolution, and compute features for every market."""
    usable = cut(before_resolution(clean_trades(raw, require_wallet), markets, days))  # read twice by the features
    return compute_features(usable, chunk_seconds)


def empty_markets(raw: DataFrame, features: DataFrame) -> DataFrame:
    """Markets of the raw table that have no usable trade left; a build should refuse them."""
    return raw.select("market").distinct().join(features.select("market").distinct(), "market", "left_anti")


def require_dataset(raw: DataFrame, features: DataFrame) -> None:
    if not empty_markets(raw, features).isEmpty():
        raise ValueError("a market has no usable trade after cleaning")


def market_moments(features: DataFrame, column: str, prefix: str) -> DataFrame:
    return features.groupBy("market").agg(F.avg(column).alias(f"{prefix}_mean"),
                                          F.stddev_pop(column).alias(f"{prefix}_sd"))


def size_zscore(features: DataFrame) -> DataFrame:
    """|z| of the log size ratio within the market; a constant market scores 0."""
    stats = market_moments(features, "log_size_ratio", "lsr")
    z = F.abs((F.col("log_size_ratio") - F.col("lsr_mean")) / F.col("lsr_sd"))
    return features.join(stats, "market").withColumn(
        "abs_z", F.when(F.col("lsr_sd") < MIN_STD, 0.0).otherwise(z)).drop("lsr_mean", "lsr_sd")


def side_sign(side: str | Column = "side") -> Column:
    s = F.upper(F.col(side) if isinstance(side, str) else side)
    return F.when(s == "BUY", 1.0).when(s == "SELL", -1.0).otherwise(0.0)


def buy_fraction(features: DataFrame, native: bool = False) -> DataFrame:
    """Share of a trade counted as buying: price-move proxy, or the venue's side where known."""
    stats = features.groupBy("market").agg(F.stddev_pop("dy").alias("_sd"))
    proxy = F.when(F.col("dy").isNull() | F.col("_sd").isNull() | (F.col("_sd") < MIN_STD), 0.5) \
             .otherwise(norm_cdf(F.col("dy") / F.when(F.col("_sd") >= MIN_STD, F.col("_sd"))))
    if native:
        sign = side_sign()
        proxy = F.when(sign > 0, 1.0).when(sign < 0, 0.0).otherwise(proxy)
    return features.join(stats, "market").withColumn("buy_frac", proxy).drop("_sd")


def elapsed(features: DataFrame) -> DataFrame:
    """Seconds since the market's first trade."""
    first = features.groupBy("market").agg(F.min("ts").alias("_t0"))
    return features.join(first, "market").withColumn("t", (F.col("ts") - F.col("_t0")).cast("double")).drop("_t0")


def silence_gaps(features: DataFrame, stale_after: float) -> DataFrame:
    """Stretches of at least ``stale_after`` seconds without a trade."""
    return features.where(F.col("delta") >= stale_after).select(
        "market", (F.col("ts") - F.col("delta")).alias("gap_start"), F.col("ts").cast("double").alias("gap_end"),
        F.col("delta").alias("gap_seconds"))


def backwards_rows(arrivals: DataFrame, seq: str = "seq", rows_per_chunk: int = 100_000) -> DataFrame:
    """Rows that arrive with an older timestamp than something already seen, per market."""
    base = arrivals.withColumn("chunk", F.floor(F.col(seq) / rows_per_chunk).cast("long"))
    seen = ordered_carry(base, "market", [seq], maxes={"high": F.col("ts")})
    return seen.where(F.col("ts") < F.col("high")).withColumn("late_by", F.col("high") - F.col("ts")) \
               .drop("chunk", "high")


def wallet_ids(trades: DataFrame) -> DataFrame:
    """Dense wallet ids in order of first appearance over (market, ts, hash)."""
    first = trades.groupBy("wallet").agg(F.min(F.struct("market", *ORDER)).alias("_f"))
    flat = first.select("wallet", "_f.*")
    return global_position(flat, ["market", *ORDER, "wallet"], "wallet_id").select("wallet", "wallet_id")


def encode_wallets(trades: DataFrame, ids: DataFrame) -> DataFrame:
    """Attach ids; wallets outside the dimension get NULL (append them with ``extend_ids``)."""
    return trades.join(ids, "wallet", "left")


def extend_ids(ids: DataFrame, trades: DataFrame) -> DataFrame:
    """The dimension plus unseen wallets, numbered after the largest existing id."""
    fresh = wallet_ids(trades.join(ids, "wallet", "left_anti"))
    top = ids.agg(F.coalesce(F.max("wallet_id") + 1, F.lit(0)).alias("_base"))
    return ids.select("wallet", "wallet_id").unionByName(
        fresh.join(F.broadcast(top)).select("wallet", (F.col("wallet_id") + F.col("_base")).alias("wallet_id")))


def market_stats(trades: DataFrame) -> DataFrame:
    pairs = trades.groupBy("market", "wallet").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("v"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return pairs.groupBy("market").agg(
        F.sum("n").alias("n_trades"), (F.sum("v") / F.sum("n")).alias("s_bar"), F.min("a").alias("first_ts"),
        F.max("b").alias("last_ts"), F.count("wallet").alias("n_wallets"))


def standardization(features: DataFrame) -> DataFrame:
    return features.agg(F.avg("log_size_ratio").alias("m_s"), F.stddev_pop("log_size_ratio").alias("s_s"))


def starting_variances(features: DataFrame) -> DataFrame:
    v = F.var_pop("y")
    return features.agg((0.1 * v).alias("sigma2_0"), v.alias("sigma2_1"), v.alias("tau2_0"), (0.01 * v).alias("tau2_1"))


def concat_markets(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
