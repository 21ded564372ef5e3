"""Wallet-anchored case tables over the scores of one market cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwatch.functions.labels import iso_utc, sufficiency
from fillwatch.operators.clean import anchored_wallets
from fillwatch.operators.event_study import EXACT
from fillwatch.operators.ordered import global_position

FLAT_TOL = 1e-6
LABELS = ("prior-dominated", "weak", "meaningful")


def wallet_table(scores: DataFrame, start: float, end: float, address: str | None = None,
                 pattern: str | None = None) -> DataFrame:
    """In-window wallets with score summary, total evidence, elevation and anchor flag, ranked; equal means by wallet.

    Many wallets share a mean, so it is summed and divided as a decimal: it doesn't depend on the order of trades, and equal means are equal."""
    inside = F.when(F.col("ts").between(start, end), F.col("p_z"))
    mean = F.when(F.count(inside) > 0, F.sum(inside.cast(EXACT)) / F.count(inside)).cast("double")
    per = scores.groupBy("wallet").agg(
        F.count(inside).alias("n_window"), F.count(F.lit(1)).alias("n_total"), mean.alias("mean_p_z"),
        F.max(inside).alias("max_p_z"), F.min(inside).alias("min_p_z")).where("n_window > 0")
    base = scores.agg(F.avg("p_z").alias("_base"))
    marks = anchored_wallets(scores, address, pattern)
    rows = per.join(F.broadcast(base)).join(marks, "wallet").select(  # one baseline row
        "wallet", "n_window", "n_total", "mean_p_z", "max_p_z", "min_p_z",
        (F.col("mean_p_z") - F.col("_base")).alias("elevation"), "anchored",
        sufficiency("n_total").alias("sufficiency"),
        ((F.col("max_p_z") - F.col("min_p_z")) < FLAT_TOL).alias("flat"), (-F.col("mean_p_z")).alias("_neg"))
    return global_position(rows, ["_neg", "wallet"], "_p").withColumn("rank", F.col("_p") + 1).drop("_p", "_neg")


def sufficiency_counts(wallets: DataFrame) -> DataFrame:
    spark = wallets.sparkSession
    dim = spark.createDataFrame([(s,) for s in LABELS], "sufficiency STRING")
    n = wallets.groupBy("sufficiency").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(n, "sufficiency", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def reported(wallets: DataFrame, top_k: int) -> DataFrame:
    """The top of the table plus every anchored wallet below it."""
    return wallets.where((F.col("rank") <= top_k) | F.col("anchored"))


def rank_of(wallets: DataFrame, wallet: str) -> DataFrame:
    return wallets.where(F.col("wallet") == wallet).select("wallet", "rank")


def top_trades(scores: DataFrame, start: float, end: float, limit: int, address: str | None = None,
               pattern: str | None = None) -> DataFrame:
    """Highest scores in the window, earlier trades first among equals."""
    best = scores.where(F.col("ts").between(start, end)).orderBy(F.desc("p_z"), "ts", "tx_hash").limit(limit)
    marks = anchored_wallets(best, address, pattern)
    return best.join(marks, "wallet", "left").select(
        "ts", iso_utc("ts").alias("iso"), "market", "wallet", "tx_hash", "p_z",
        F.coalesce("anchored", F.lit(False)).alias("anchored"))


def missing_markets(listed: DataFrame, scores: DataFrame) -> DataFrame:
    """Listed markets without a score, and scored markets that are not listed."""
    seen = scores.select("market").distinct()
    a = listed.select("market").distinct().join(seen, "market", "left_anti").withColumn("kind", F.lit("without_trades"))
    b = seen.join(listed.select("market"), "market", "left_anti").withColumn("kind", F.lit("off_list"))
    return a.unionByName(b)


def cluster_summary(scores: DataFrame, listed: DataFrame, start: float, end: float, address: str | None = None,
                    pattern: str | None = None) -> DataFrame:
    inside = F.when(F.col("ts").between(start, end), F.col("p_z"))
    s = scores.agg(F.count(F.lit(1)).alias("n_trades"), F.count(inside).alias("n_trades_window"),
                   F.avg("p_z").alias("baseline_mean"), F.avg(inside).alias("window_mean"))
    w = anchored_wallets(scores, address, pattern).agg(
        F.count(F.lit(1)).alias("n_wallets"), F.count(F.when(F.col("anchored"), 1)).alias("n_anchored"))
    m = missing_markets(listed, scores).agg(
        F.count(F.when(F.col("kind") == "without_trades", 1)).alias("n_without_trades"),
        F.count(F.when(F.col("kind") == "off_list", 1)).alias("n_off_list"))
    return s.join(F.broadcast(w)).join(F.broadcast(m))  # single rows


def verdict(summary: DataFrame, wallets: DataFrame, warm_start: bool) -> DataFrame:
    """What the run supports, as a code, from the cluster row and the in-window wallet table."""
    hit = wallets.where("anchored").agg(
        F.count(F.lit(1)).alias("n_in_window"), F.max("rank").alias("anchor_rank"), F.max("flat").alias("anchor_flat"),
        F.max("sufficiency").alias("anchor_sufficiency"), F.max("elevation").alias("anchor_elevation"))
    code = (F.when(~F.lit(warm_start), "cold_start").when(F.col("n_anchored") == 0, "no_anchor")
            .when(F.col("n_anchored") > 1, "several_anchors").when(F.col("n_in_window") == 0, "anchor_outside_window")
            .when(F.col("anchor_flat"), "untested")
            .when(F.col("anchor_sufficiency") == "meaningful", "timing_and_rank").otherwise("timing_only"))
    return summary.join(F.broadcast(hit)).select("n_anchored", "n_in_window", "anchor_rank", "anchor_sufficiency",
                                                 "anchor_elevation", code.alias("verdict"))


def timeline_overlay(events: DataFrame, scores: DataFrame, around: float = 3_600.0) -> DataFrame:
    """Dated events with the number and mean score of trades within ``around`` seconds.

    Trades are summed per time bin first; an event reads whole bins from the sums
    and only its two edge bins from the trades.
    """
    ev = events.select("event_ts", "label").distinct()
    lo, hi = F.col("event_ts") - around, F.col("event_ts") + around
    bin_of = lambda c: F.floor(c / around).cast("long")
    spans = ev.select("*", F.explode(F.sequence(bin_of(lo), bin_of(hi))).alias("bin"))
    whole = (F.col("bin") * around >= lo) & ((F.col("bin") + 1) * around <= hi)
    binned = scores.select("ts", "p_z", bin_of(F.col("ts")).alias("bin"))
    sums = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("p_z").alias("s"))
    inner = spans.where(whole).join(sums, "bin").select("event_ts", "label", "n", "s")
    edges = spans.where(~whole).join(binned, "bin").where(F.col("ts").between(lo, hi)) \
        .groupBy("event_ts", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("p_z").alias("s"))
    near = inner.unionByName(edges).groupBy("event_ts", "label").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return ev.join(near, ["event_ts", "label"], "left").select(
        "event_ts", iso_utc("event_ts").alias("iso"), "label", F.coalesce("n", F.lit(0)).alias("n_trades"),
        F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("mean_p_z"))
