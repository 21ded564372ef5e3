"""Costed, purged walk-forward backtest over scored markets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwatch.config import EMBARGO_S, EULER_GAMMA, N_SPLITS, THRESHOLDS, CostModel
from fillwatch.functions.mathx import entry_cost, norm_cdf, norm_ppf, sigmoid
from fillwatch.operators.clean import keep_first
from fillwatch.operators.ordered import global_position


def market_labels(scores: DataFrame, closes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per scored market: label span, outcome and, if unusable, why."""
    j = scores.select("market", "ts").join(closes.select("market", "close_ts"), "market", "left")
    live = F.when(F.col("ts") <= F.col("close_ts"), F.col("ts"))
    per = j.groupBy("market").agg(F.max("close_ts").alias("close_ts"), F.min(live).alias("label_start"))
    per = per.join(outcomes.select("market", "outcome"), "market", "left")
    reason = (F.when(F.col("close_ts").isNull(), "no_resolution").when(F.col("outcome").isNull(), "no_outcome")
              .when(F.col("label_start").isNull(), "no_trades_before_close"))
    return per.withColumn("reason", reason)


def panels(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Tradeable scores with their market's close and outcome; fills after the close are dropped."""
    good = labels.where("reason IS NULL").select("market", "close_ts", "outcome")
    return scores.join(good, "market").where(F.col("ts") <= F.col("close_ts")) \
                 .withColumn("price", sigmoid("x_mean"))


def positions(panel: DataFrame, thresholds: Sequence[float] = THRESHOLDS, cost: CostModel = CostModel()) -> DataFrame:
    """First crossing per market and threshold, priced and settled.

    Pass one finds the second of the first crossing for every threshold in a
    single hash aggregation; pass two looks only at the trades of those seconds
    to break ties by hash. The panel is never multiplied by the grid.
    """
    hits = panel.where(F.col("p_z") >= min(thresholds))
    firsts = hits.groupBy("market").agg(*[
        F.min(F.when(F.col("p_z") >= t, F.col("ts"))).alias(f"t{k}") for k, t in enumerate(thresholds)])
    grid = firsts.select("market", F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{k}").alias("ts")) for k, t in enumerate(thresholds)]))
        .alias("g")).select("market", "g.*").where("ts IS NOT NULL")
    cross = hits.join(grid, ["market", "ts"]).where(F.col("p_z") >= F.col("threshold"))
    cross = cross.withColumn("_key", F.concat_ws("|", "market", F.col("threshold").cast("string")))
    one = keep_first(cross, "_key", ["tx_hash"]).drop("_key")
    side = F.when(F.col("price") >= 0.5, "yes").otherwise("no")
    out = one.withColumn("side", side).withColumn("cost", entry_cost("price", "side", cost.spread, cost.fee_rate))
    payout = F.when(F.col("side") == "yes", F.col("outcome")).otherwise(1.0 - F.col("outcome"))
    return out.where(F.col("cost") < 1.0).select(
        "market", "threshold", F.col("ts").alias("entry_ts"), F.col("close_ts").alias("exit_ts"), "p_z", "price", "side",
        "cost", payout.alias("payout"), (payout - F.col("cost")).alias("ret"))


def market_blocks(labels: DataFrame, n_splits: int = N_SPLITS) -> DataFrame:
    """Contiguous blocks of near-equal size in (close, market) order; the first ones take the remainder."""
    if n_splits < 1:
        raise ValueError("n_splits must be at least 1")
    good = labels.where("reason IS NULL").select("market", "close_ts", "label_start")
    placed = global_position(good, ["close_ts", "market"], "pos")
    size = placed.agg(F.count(F.lit(1)).alias("n"))
    b = n_splits + 1
    q, rem = F.floor(F.col("n") / b), F.col("n") % b
    head = rem * (q + 1)
    block = F.when(F.col("pos") < head, F.floor(F.col("pos") / (q + 1))).otherwise(
        rem + F.floor((F.col("pos") - head) / F.greatest(q, F.lit(1))))
    return placed.join(F.broadcast(size)).select("market", "close_ts", "label_start", block.cast("int").alias("block"))


def fold_members(blocks: DataFrame, n_splits: int = N_SPLITS, embargo_s: float = EMBARGO_S) -> DataFrame:
    """``(fold, market, role)`` with role test, train or purged. A market appears at most once per fold."""
    if embargo_s < 0:
        raise ValueError("embargo_s must be non-negative")
    tests = blocks.where("block >= 1").groupBy((F.col("block") - 1).alias("fold")).agg(
        F.min("label_start").alias("test_start"), F.max("close_ts").alias("test_end"))
    spread_ = blocks.select("*", F.explode(F.sequence(F.greatest(F.col("block") - 1, F.lit(0)),
                                                      F.lit(n_splits - 1))).alias("fold"))
    j = spread_.join(F.broadcast(tests), "fold")  # at most n_splits rows
    role = (F.when(F.col("block") == F.col("fold") + 1, "test")
            .when(F.col("close_ts") <= F.col("test_start") - embargo_s, "train").otherwise("purged"))
    return j.select("fold", "market", role.alias("role"), "test_start", "test_end")


def folds(members: DataFrame) -> DataFrame:
    def n(role):
        return F.count(F.when(F.col("role") == role, 1))

    return members.groupBy("fold").agg(n("train").alias("n_train"), n("test").alias("n_test"), n("purged").alias("n_purged"),
                                       F.max("test_start").alias("test_start"), F.max("test_end").alias("test_end"))


# ---- Sharpe family ---------------------------------------------------------------------------

def sharpe(ret: Column | str = "ret") -> Column:
    """Aggregate: mean over sample sd, NULL below two values or without dispersion."""
    c = F.col(ret) if isinstance(ret, str) else ret
    sd = F.stddev_samp(c)
    return F.when((F.count(c) >= 2) & (sd > 0), F.avg(c) / F.when(sd > 0, sd))


def moments(df: DataFrame, ret: str = "ret", groups: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample sd and bias-corrected skewness and (non-excess) kurtosis."""
    a = df.groupBy(*groups).agg(F.count(ret).alias("n"), F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("sd"),
                                F.var_samp(ret).alias("var"), F.skewness(ret).alias("_g"), F.kurtosis(ret).alias("_k"),
                                sharpe(ret).alias("sharpe"))
    n = F.col("n").cast("double")
    g = F.when(F.col("n") > 2, F.col("_g") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).otherwise(F.col("_g"))
    corrected = ((n * n - 1.0) * (F.col("_k") + 3.0) - 3.0 * (n - 1.0) * (n - 1.0)) / \
        F.nullif((n - 2.0) * (n - 3.0), F.lit(0.0)) + 3.0
    k = F.when(F.col("n") > 3, corrected).otherwise(F.col("_k") + 3.0)
    undefined = F.isnan("_g") | F.col("_g").isNull()
    return a.select(*groups, "n", "mean", F.when(F.col("n") > 1, F.col("sd")).alias("sd"),
                    F.when(F.col("n") > 1, F.col("var")).alias("var"),
                    F.when(~undefined, g).alias("skewness"), F.when(~undefined, k).alias("kurtosis"), "sharpe")


def probabilistic_sharpe(m: DataFrame, benchmark: Column | float, name: str = "psr") -> DataFrame:
    """Probability that the true Sharpe exceeds ``benchmark``, from a moments row."""
    b = benchmark if isinstance(benchmark, Column) else F.lit(float(benchmark))
    sr = F.col("sharpe")
    v = 1.0 - F.col("skewness") * sr + 0.25 * (F.col("kurtosis") - 1.0) * sr * sr
    z = (sr - b) * F.sqrt(F.col("n") - 1.0) / F.sqrt(F.when(v > 0, v))
    return m.withColumn(name, F.when(z.isNotNull(), norm_cdf(z)))


def expected_max_sharpe(variance: Column | str, n_trials: Column | str) -> Column:
    v = F.col(variance) if isinstance(variance, str) else variance
    n = F.col(n_trials) if isinstance(n_trials, str) else n_trials
    safe = F.greatest(n.cast("double"), F.lit(2.0))
    z = (1.0 - EULER_GAMMA) * norm_ppf(1.0 - 1.0 / safe) + EULER_GAMMA * norm_ppf(1.0 - 1.0 / (safe * math.e))
    return F.when((n < 2) | (v == 0), 0.0).otherwise(F.sqrt(v) * z)


def deflated_sharpe(returns: DataFrame, trials: DataFrame, n_trials: int | None = None) -> DataFrame:
    """Deflated Sharpe of the selected returns against every trial searched (one row)."""
    t = trials.agg(F.count(F.lit(1)).alias("_nt"), F.count("sharpe").alias("n_trial_sharpes"),
                   F.when(F.count("sharpe") > 1, F.var_samp("sharpe")).otherwise(0.0).alias("trial_variance"))
    t = t.withColumn("n_trials", F.lit(n_trials).cast("long") if n_trials is not None else F.col("_nt")).drop("_nt")
    row = moments(returns).join(F.broadcast(t)).withColumn(
        "sr_benchmark", expected_max_sharpe("trial_variance", "n_trials"))
    row = probabilistic_sharpe(probabilistic_sharpe(row, 0.0, "psr_zero"), F.col("sr_benchmark"), "dsr")
    big = F.col("n") > 2
    return row.select("sharpe", F.col("n").alias("n_returns"), F.when(big, F.col("skewness")).alias("skewness"),
                      F.when(big, F.col("kurtosis")).alias("kurtosis"), "n_trials", "n_trial_sharpes", "trial_variance",
                      "sr_benchmark", "psr_zero", "dsr")


# ---- the run -----------------------------------------------------------------------------------

def select_thresholds(pos: DataFrame, members: DataFrame) -> DataFrame:
    """Best threshold per fold on its training markets, ties to the lowest; undefined everywhere gives no row."""
    train = members.where("role = 'train'").select("fold", "market")
    s = pos.join(train, "market").groupBy("fold", "threshold").agg(sharpe().alias("train_sharpe"))
    best = keep_first(s.where("train_sharpe IS NOT NULL"), "fold", [F.desc("train_sharpe"), F.col("threshold")])
    return best.select("fold", "threshold", "train_sharpe")


def trial_table(pos: DataFrame, members: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Every declared threshold held fixed over the pooled test folds; thresholds without a trade keep a row."""
    spark = pos.sparkSession
    grid = spark.createDataFrame([(float(t),) for t in thresholds], "threshold DOUBLE")
    test = members.where("role = 'test'").select("market")
    s = pos.join(test, "market").groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n_positions"), F.avg("ret").alias("mean_return"), F.sum("ret").alias("total_return"),
        F.avg((F.col("payout") > 0).cast("double")).alias("hit_rate"), sharpe().alias("sharpe"))
    return grid.join(s, "threshold", "left") \
        .withColumn("n_positions", F.coalesce("n_positions", F.lit(0))) \
        .withColumn("total_return", F.coalesce("total_return", F.lit(0.0)))


def out_of_sample(pos: DataFrame, members: DataFrame, chosen: DataFrame) -> DataFrame:
    """Test-fold positions taken at each fold's selected threshold."""
    test = members.where("role = 'test'").select("fold", "market")
    return pos.join(test, "market").join(F.broadcast(chosen), ["fold", "threshold"])  # one row per fold


def fold_report(members: DataFrame, chosen: DataFrame, oos: DataFrame) -> DataFrame:
    r = oos.groupBy("fold").agg(F.count(F.lit(1)).alias("n_positions"), F.avg("ret").alias("mean_return"),
                                F.sum("ret").alias("total_return"))
    return folds(members).join(chosen, "fold", "left").join(r, "fold", "left") \
        .withColumn("n_positions", F.coalesce("n_positions", F.lit(0))) \
        .withColumn("total_return", F.coalesce("total_return", F.lit(0.0)))


def run_backtest(scores: DataFrame, closes: DataFrame, outcomes: DataFrame, *,
                 thresholds: Sequence[float] = THRESHOLDS, cost: CostModel = CostModel(),
                 n_splits: int = N_SPLITS, embargo_s: float = EMBARGO_S) -> dict[str, DataFrame]:
    """All tables of one run. Positions are one row per (market, threshold) and shared by every fold."""
    if not thresholds:
        raise ValueError("thresholds must declare at least one entry")
    from fillwatch.session import cut
    labels = cut(market_labels(scores, closes, outcomes))
    pos = cut(positions(panels(scores, labels), thresholds, cost))
    members = fold_members(market_blocks(labels, n_splits), n_splits, embargo_s)
    chosen = select_thresholds(pos, members)
    oos = out_of_sample(pos, members, chosen)
    trials = trial_table(pos, members, thresholds)
    return {"positions": pos, "folds": fold_report(members, chosen, oos), "trials": trials, "oos": oos,
            "deflated": deflated_sharpe(oos, trials, len(thresholds)),
            "exclusions": labels.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))}
