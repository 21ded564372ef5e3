"""Filters and cleaning of raw fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillwatch.config import CHUNK_SECONDS, DAY
from fillwatch.operators.ordered import chunk_id, ordered_carry
from fillwatch.session import scalar_row

#: Phrases that mark a political market question.
POLITICS_WORDS = (
    "election", "president", "presidential", "senate", "congress", "house of representatives",
    "governor", "primary", "trump", "biden", "harris", "vance", "walz", "republican", "democrat",
    "gop", "dnc", "supreme court", "impeach", "vote",
)


def valid_trade(require_wallet: bool = True) -> Column:
    ok = (F.col("size") > 0) & (F.col("price") > 0) & (F.col("price") < 1) & (F.col("tx_hash") != "")
    if require_wallet:
        ok = ok & F.col("wallet").isNotNull() & (F.col("wallet") != "")
    return F.coalesce(ok, F.lit(False))


def keep_first(df: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """One row per key, smallest in ``order``.

    ``row_number() = 1`` is planned with a map-side group limit, so a key copied
    a billion times sends one row per map task through the shuffle.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def clean_trades(raw: DataFrame, require_wallet: bool = True) -> DataFrame:
    """Drop unusable fills and keep the first fill of every transaction hash.

    "First" is the smallest (ts, price, size, wallet, market, side, ...). The copies are reduced by
    an aggregation, so however many there are of one hash, each map task ships at most one.
    """
    lead = [c for c in ("ts", "price", "size", "wallet", "market", "side") if c in raw.columns]
    rest = [c for c in raw.columns if c not in lead and c != "tx_hash"]
    first = raw.where(valid_trade(require_wallet)).groupBy("tx_hash").agg(F.min(F.struct(*lead, *rest)).alias("_f"))
    return first.select(*[F.col(c) if c == "tx_hash" else F.col(f"_f.{c}").alias(c) for c in raw.columns])


def scorable(raw: DataFrame) -> DataFrame:
    """Row-wise form of the cleaning predicate for streams of uncoerced strings."""
    price, size = F.col("price").try_cast("double"), F.col("size").try_cast("double")
    ts = F.col("ts").try_cast("double")
    ok = ((size > 0) & (price > 0) & (price < 1) & (F.length("wallet") > 0) & (F.length("tx_hash") > 0)
          & ts.isNotNull())
    return (raw.withColumn("_ok", F.coalesce(ok, F.lit(False)))
               .withColumns({"price": price, "size": size, "ts": ts}))


def split_scorable(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = scorable(raw)
    return marked.where("_ok").drop("_ok"), marked.where("NOT _ok").drop("_ok")


def before_resolution(trades: DataFrame, markets: DataFrame, days: float = 7.0) -> DataFrame:
    """Keep fills at least ``days`` before the close; an unknown close keeps all."""
    closes = markets.select("market", "close_ts")
    keep = F.col("close_ts").isNull() | (F.col("ts") < F.col("close_ts") - F.lit(days * DAY))
    return trades.join(closes, "market", "left").where(keep).drop("close_ts")


def parse_end_date(text: str | Column) -> Column:
    """Unix seconds of an end date in one of three layouts, naive meaning UTC; else NULL."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.trim(c)
    forms = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
    tries = [F.try_to_timestamp(c, F.lit(f)) for f in forms]
    return F.unix_seconds(F.coalesce(*tries)).cast("double")


def select_markets(markets: DataFrame, *, min_volume: float = 0.0, closed: bool | None = True,
                   keywords: Sequence[str] | None = None, limit: int | None = None,
                   offset: int = 0) -> DataFrame:
    """Markets by volume, closed flag and question keyword, largest volume first."""
    out = markets.where((F.col("volume") >= min_volume) & (F.coalesce(F.col("condition_id"), F.lit("")) != ""))
    if closed is not None:
        out = out.where(F.col("closed") == F.lit(closed))
    if keywords:
        text = F.lower(F.coalesce("question", F.lit("")))
        hit = F.lit(False)
        for word in keywords:
            hit = hit | F.contains(text, F.lit(word.lower()))
        out = out.where(hit)
    out = out.orderBy(F.desc("volume"), "market")
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def market_for_slug(markets: DataFrame) -> DataFrame:
    """One market per slug: closed before open, then larger volume."""
    return keep_first(markets, "slug", [F.desc("closed"), F.desc("volume"), F.col("market")])


def restrict_to_shortlist(markets: DataFrame, slugs: Sequence[str]) -> DataFrame:
    """Markets on an ordered list, with their place on it (the list is an argument, so it is small)."""
    spark = markets.sparkSession
    listed = spark.createDataFrame([(k, s) for k, s in enumerate(slugs)], "ord INT, slug STRING")
    return markets.join(F.broadcast(listed), "slug")


def in_markets(trades: DataFrame, ids: Sequence[str]) -> DataFrame:
    return trades.where(F.lower("market").isin([str(i).lower() for i in ids]))


def market_tail(features: DataFrame, n: int) -> DataFrame:
    """Last ``n`` trades of each market; the first survivor has no gap. ``s_bar`` is untouched."""
    sizes = features.groupBy("market").agg(F.count(F.lit(1)).alias("_n"))
    kept = features.join(sizes, "market").where(F.col("i") >= F.col("_n") - n)
    first = F.col("i") == F.greatest(F.col("_n") - n, F.lit(0))
    return kept.withColumn("delta", F.when(first, 0.0).otherwise(F.col("delta"))) \
               .withColumn("i", F.col("i") - F.greatest(F.col("_n") - n, F.lit(0))).drop("_n")


def newest(trades: DataFrame, n: int, chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """The ``n`` most recent fills of each market (a row budget is the feature here)."""
    cut_ = trades.withColumn("chunk", chunk_id("ts", chunk_seconds))
    numbered = ordered_carry(cut_, "market", ["ts", "tx_hash"], index="_i", count="_n")
    return numbered.where(F.col("_i") >= F.col("_n") - n).drop("_i", "_n", "chunk")


def flagged(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scores.where(F.col("p_z") >= threshold)


def in_window(df: DataFrame, start: float, end: float, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts).between(start, end))


def anchored_wallets(trades: DataFrame, address: str | None = None, pattern: str | None = None) -> DataFrame:
    """Distinct wallets with their anchor verdict; the pattern runs once per wallet."""
    hit = F.lit(False)
    if address:
        hit = hit | (F.lower("wallet") == F.lit(address.lower()))
    if pattern:
        hit = hit | F.col("wallet").rlike(rf"\A(?:{pattern})\z")
    return trades.where(F.col("wallet").isNotNull()).select("wallet").distinct() \
                 .withColumn("anchored", F.coalesce(hit, F.lit(False)))


def identity_mode(trades: DataFrame) -> DataFrame:
    """``wallet`` when a market publishes any identity, else ``anonymous``."""
    return trades.groupBy("market").agg(
        F.when(F.max(F.col("wallet").isNotNull()), "wallet").otherwise("anonymous").alias("mode"))


def require_identity(trades: DataFrame, requested: str) -> None:
    """Raise when wallet mode is asked for and some market has no wallet at all."""
    if requested == "wallet" and not identity_mode(trades).where("mode = 'anonymous'").isEmpty():
        raise ValueError("wallet mode requested but a market publishes no wallets")


def shortlist_wallets(features: DataFrame, wallets: DataFrame, min_trades: int = 10,
                      chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Trades of the kept wallets, gaps re-measured between survivors; thin markets dropped."""
    kept = features.join(wallets.select("wallet").distinct(), "wallet", "left_semi") \
                   .withColumn("chunk", chunk_id("ts", chunk_seconds)) \
                   .withColumnRenamed("i", "orig_i")
    numbered = ordered_carry(kept, "market", ["ts", "tx_hash"], lags={"_pts": "ts"}, index="i", count="_n")
    return numbered.where(F.col("_n") >= min_trades).withColumn(
        "delta", F.when(F.col("_pts").isNull(), 0.0)
        .otherwise(F.greatest(F.col("ts") - F.col("_pts"), F.lit(0)).cast("double"))).drop("_pts", "_n")


def holdout_split(features: DataFrame, share: float = 0.2) -> DataFrame:
    """Mark the last ``round(share * n)`` trades of each market as ``tail`` (ties round to even)."""
    sizes = features.groupBy("market").agg(F.count(F.lit(1)).alias("_n"))
    n_tail = F.bround(F.col("_n").cast("double") * share, 0)
    return features.join(sizes, "market").withColumn(
        "split", F.when(F.col("i") >= F.col("_n") - n_tail, "tail").otherwise("head")).drop("_n")


def distinct_values(df: DataFrame, column: str | Column) -> DataFrame:
    """How many different values (NULL counts as one) a should-be-constant column has."""
    c = F.col(column) if isinstance(column, str) else column
    return df.agg((F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))).alias("n_values"))


def require_single(df: DataFrame, column: str) -> None:
    if scalar_row(distinct_values(df, column))["n_values"] > 1:
        raise ValueError(f"{column} must hold a single value")


def regime_conflicts(rows: DataFrame, key: str, settings: Sequence[str]) -> DataFrame:
    """Settings that take several values within one key, with the count of values."""
    aggs = [F.count_distinct(F.col(s)).cast("bigint").alias(s) for s in settings]
    wide = rows.groupBy(key).agg(*aggs)
    return wide.unpivot([key], list(settings), "setting", "n_values").where("n_values > 1")
