"""Ranking metrics, restart stability and method comparison."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fillwatch.functions.special import t_quantile
from fillwatch.operators.ordered import global_position, global_prefix
from fillwatch.session import scalar_row


def _class_counts(df: DataFrame, truth: str, score: str, groups: Sequence[str]) -> DataFrame:
    """Per distinct score: positives, negatives, and how many of each lie below it in the group."""
    pos = F.sum(F.col(truth).cast("long"))
    tally = df.groupBy(*groups, score).agg(pos.alias("pos"), (F.count(F.lit(1)) - pos).alias("neg"))
    run = global_prefix(tally, [*groups, score], {"_p": F.col("pos"), "_n": F.col("neg")})
    run = run.withColumn("_p0", F.col("_p") - F.col("pos")).withColumn("_n0", F.col("_n") - F.col("neg"))
    total = run.groupBy(*groups).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.min("_p0").alias("_ps"),
                                     F.min("_n0").alias("_ns"), F.max(score).alias("_top"))
    joined = run.join(total, list(groups)) if groups else run.join(F.broadcast(total))  # one row without groups
    return joined.select(*groups, score, "pos", "neg", "P", "N", "_top",
                         (F.col("_p0") - F.col("_ps")).alias("pos_below"),
                         (F.col("_n0") - F.col("_ns")).alias("neg_below"))


def roc_auc(df: DataFrame, truth: str = "z_true", score: str = "z_score", groups: Sequence[str] = ()) -> DataFrame:
    """Tie-averaged rank-sum AUC; 0.5 when a class is absent."""
    c = _class_counts(df, truth, score, groups)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    agg = c.groupBy(*groups).agg(wins.alias("_w"), F.max("P").alias("n_pos"), F.max("N").alias("n_neg"))
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return agg.select(*groups, F.when(ok, F.col("_w") / (F.col("n_pos").cast("double") * F.col("n_neg"))).otherwise(0.5).alias("auc"),
                      "n_pos", "n_neg")


def roc_curve(df: DataFrame, truth: str = "z_true", score: str = "z_score") -> DataFrame:
    """One point per distinct score plus the origin; the plain diagonal when a class is absent."""
    c = _class_counts(df, truth, score, ())
    ok = (F.col("P") > 0) & (F.col("N") > 0)
    pts = c.where(ok).select(((F.col("N") - F.col("neg_below")) / F.col("N")).alias("fpr"),
                             ((F.col("P") - F.col("pos_below")) / F.col("P")).alias("tpr"),
                             F.col(score).cast("double").alias("threshold"))
    sums = df.agg(F.sum(F.col(truth).cast("long")).alias("P"), F.count(F.lit(1)).alias("T"),
                  F.max(F.col(score).cast("double")).alias("top"))
    mixed = (F.col("P") > 0) & (F.col("P") < F.col("T"))
    zero, one = F.lit(0.0), F.lit(1.0)
    corner = lambda f, t, th: F.struct(f.alias("fpr"), t.alias("tpr"), th.alias("threshold"))
    ends = sums.select(F.explode(F.when(mixed, F.array(corner(zero, zero, F.col("top") + 1.0))).otherwise(
        F.array(corner(zero, zero, one), corner(one, one, zero)))).alias("c")).select("c.*")
    return ends.unionByName(pts)


def recall_cutoff(n_wallets, n_insiders):
    return F.greatest(F.ceil(F.lit(0.1) * n_wallets), n_insiders)


def recall_at_k(scores: DataFrame, insiders: DataFrame, score: str = "score", tie: str = "wallet_id",
                k: int | None = None) -> DataFrame:
    """Share of labelled wallets among the best ``k`` (default: a tenth, at least all labelled)."""
    placed = global_position(scores.withColumn("_neg", -F.col(score)), ["_neg", tie], "_p")
    marked = placed.join(insiders.select("wallet").distinct().withColumn("_in", F.lit(True)), "wallet", "left")
    size = marked.agg(F.count(F.lit(1)).alias("n_wallets"), F.count("_in").alias("n_insiders"))
    cut = F.lit(k) if k is not None else recall_cutoff(F.col("n_wallets"), F.col("n_insiders"))
    joined = marked.join(F.broadcast(size.withColumn("k", F.greatest(F.least(cut, F.col("n_wallets")), F.lit(1)))))
    out = joined.agg(F.max("k").cast("long").alias("k"), F.max("n_insiders").alias("n_insiders"),
                     F.count(F.when(F.col("_in") & (F.col("_p") < F.col("k")), 1)).alias("n_found"),
                     F.max(F.when(F.col("_in"), F.col("_p") + 1)).alias("worst_rank"))
    return out.withColumn("recall", F.when(F.col("n_insiders") == 0, 1.0)
                          .otherwise(F.col("n_found") / F.col("n_insiders")))


def acceptance_gate(trades: DataFrame, wallet_scores: DataFrame, insiders: DataFrame, *, target_auc: float = 0.85,
                    truth: str = "z_true", score: str = "z_score") -> DataFrame:
    """Pooled AUC and labelled-wallet recall with the pass verdict, one row."""
    pooled = roc_auc(trades, truth, score).select("auc")
    return pooled.join(F.broadcast(recall_at_k(wallet_scores, insiders))).withColumn(
        "passed", (F.col("auc") >= target_auc) & (F.col("n_found") == F.col("n_insiders")))


# ---- Kendall tau-b without enumerating pairs -----------------------------------------------

def _inversions(q: np.ndarray, w: np.ndarray) -> float:
    """Sum of w_i * w_j over i < j with q_i > q_j."""
    n = len(q)
    if n <= 64:
        later = np.triu(q[:, None] > q[None, :], 1)
        return float(w @ later @ w)
    h = n // 2
    a = np.argsort(q[:h])
    cum = np.concatenate([[0.0], np.cumsum(w[:h][a])])
    below = cum[np.searchsorted(q[:h][a], q[h:])]
    return _inversions(q[:h], w[:h]) + _inversions(q[h:], w[h:]) + float(w[h:] @ (cum[-1] - below))


def _block_inversions(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of bounded size: inversions inside it less those inside its cells, or all of them."""
    pdf = pdf.sort_values("p")
    q, w = pdf["q"].to_numpy(), pdf["w"].to_numpy(dtype=float)
    total = _inversions(q, w)
    if pdf["kind"].iloc[0] == 1:
        for _, cell in pdf.groupby("pb", sort=False):
            total -= _inversions(cell["q"].to_numpy(), cell["w"].to_numpy(dtype=float))
    return pd.DataFrame({"d": [total]})


def kendall_tau(pairs: DataFrame, a: str, b: str, block: int = 50_000) -> DataFrame:
    """Kendall tau-b, NULL when a side is constant.

    Discordant pairs are inversions between the two orders. The order positions
    are cut into blocks of at most ``block`` rows on both axes: pairs in
    different blocks on both axes are counted from block totals, the rest inside
    single blocks. Work is n log n; no pair is ever materialized.
    """
    tally = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(
        F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("w"))
    pos = global_position(global_position(tally, ["a", "b"], "p"), ["b", "a"], "q")
    pos = pos.withColumn("pb", F.floor(F.col("p") / block)).withColumn("qb", F.floor(F.col("q") / block))

    # Pairs whose blocks differ on both axes: split by the highest bit in which the
    # q-blocks differ, then count, in p-block order, ones that precede zeros.
    cells = pos.groupBy("pb", "qb").agg(F.sum("w").alias("w"))
    levels = int(scalar_row(cells.agg(F.coalesce(F.max("qb"), F.lit(0)).alias("m")))["m"]).bit_length()
    two = F.pow(F.lit(2.0), F.col("lv"))
    bits = cells.select("pb", "qb", "w", F.explode(F.sequence(F.lit(0), F.lit(max(levels - 1, 0)))).alias("lv")) \
        .select("pb", "w", "lv", F.floor(F.col("qb") / (two * 2)).alias("prefix"), (F.floor(F.col("qb") / two) % 2).alias("bit"))
    per = bits.groupBy("lv", "prefix", "pb").agg(F.sum(F.col("w") * F.col("bit")).alias("ones"),
                                                 F.sum(F.col("w") * (1 - F.col("bit"))).alias("zeros"))
    past = Window.partitionBy("lv", "prefix").orderBy("pb").rowsBetween(Window.unboundedPreceding, -1)
    crossed = per.withColumn("before", F.coalesce(F.sum("ones").over(past), F.lit(0))) \
                 .agg(F.sum(F.col("zeros").cast("double") * F.col("before")).alias("d"))

    both = pos.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("pb").alias("blk")),
                                        F.struct(F.lit(1).alias("kind"), F.col("qb").alias("blk")))).alias("t"),
                      "p", "q", "w", "pb").select("t.*", "p", "q", "w", "pb")
    inner = both.groupBy("kind", "blk").applyInPandas(_block_inversions, "d double")
    disc = crossed.unionByName(inner).agg(F.sum("d").alias("dis"))

    def tied(*cols):
        return tally.groupBy(*cols).agg(F.sum("w").cast("double").alias("t")).agg(
            F.coalesce(F.sum(F.col("t") * (F.col("t") - 1) / 2.0), F.lit(0.0)).alias("t"))

    facts = disc.join(F.broadcast(tied("a").select(F.col("t").alias("ta")))) \
        .join(F.broadcast(tied("b").select(F.col("t").alias("tb")))) \
        .join(F.broadcast(tied("a", "b").select(F.col("t").alias("tab")))) \
        .join(F.broadcast(tally.agg(F.sum("w").cast("double").alias("n"))))  # all single rows
    all_pairs = F.col("n") * (F.col("n") - 1) / 2.0
    con = all_pairs - F.col("ta") - F.col("tb") + F.col("tab") - F.col("dis")
    spread = (all_pairs - F.col("ta")) * (all_pairs - F.col("tb"))
    return facts.select(F.when(spread > 0, (con - F.col("dis")) / F.sqrt(spread)).alias("tau"),
                        F.col("n").cast("long").alias("n"))


# ---- restarts ------------------------------------------------------------------------------

def elbo_convergence(trace: DataFrame, n_iter_max: int, tol: float) -> DataFrame:
    """Convergence verdict per run from ``(run_id, it, elbo)`` with consecutive iterations."""
    ends = trace.groupBy("run_id").agg(F.max("it").alias("_last"), F.count(F.lit(1)).alias("n_iter_run"))
    tip = trace.join(ends, "run_id").where(F.col("it") >= F.col("_last") - 1)
    two = tip.groupBy("run_id").agg(F.max("n_iter_run").alias("n_iter_run"),
                                    F.max(F.when(F.col("it") == F.col("_last"), F.col("elbo"))).alias("terminal_elbo"),
                                    F.max(F.when(F.col("it") < F.col("_last"), F.col("elbo"))).alias("_prev"))
    gain = F.col("terminal_elbo") - F.col("_prev")
    rel = F.abs(gain) / F.greatest(F.abs(F.col("_prev")), F.lit(1.0))
    return two.select("run_id", "terminal_elbo", "n_iter_run", (F.col("n_iter_run") >= n_iter_max).alias("hit_iter_cap"),
                      gain.alias("final_elbo_gain"), rel.alias("final_rel_elbo_change"),
                      F.coalesce(rel < tol, F.lit(False)).alias("converged"))


def spread(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Min, max, mean, population sd and range per column, NULLs ignored, long form."""
    long = df.unpivot(list(groups), list(columns), "metric", "value")
    return long.groupBy(*groups, "metric").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("sd"), (F.max("value") - F.min("value")).alias("spread"))


def run_patterns(members: DataFrame) -> DataFrame:
    """``runs, n``: wallets merged by the set of runs that list them."""
    sets = members.select("run_id", "wallet").distinct().groupBy("wallet").agg(
        F.sort_array(F.collect_set("run_id")).alias("runs"))
    return sets.groupBy("runs").agg(F.count(F.lit(1)).alias("n"))


def shared_counts(patterns: DataFrame) -> DataFrame:
    """``ra, rb, both``: wallets that two runs have in common, ``ra`` before ``rb``."""
    return patterns.select(F.explode("runs").alias("ra"), "runs", "n") \
        .select("ra", F.explode("runs").alias("rb"), "n").where("ra < rb") \
        .groupBy("ra", "rb").agg(F.sum("n").alias("both"))


def pairwise_jaccard(members: DataFrame, runs: DataFrame) -> DataFrame:
    """Mean Jaccard overlap over pairs of runs; two empty sets agree, one run gives NULL.

    Wallets are first merged by the set of runs that list them, so pairs are
    formed between runs, never between wallets.
    """
    patterns = run_patterns(members)
    sizes = patterns.select(F.explode("runs").alias("run_id"), "n").groupBy("run_id").agg(F.sum("n").alias("size"))
    shared = shared_counts(patterns)
    named = runs.select("run_id").distinct().join(sizes, "run_id", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    left = named.select(F.col("run_id").alias("ra"), F.col("size").alias("sa"))
    right = named.select(F.col("run_id").alias("rb"), F.col("size").alias("sb"))
    overlap = shared.join(left, "ra").join(right, "rb").agg(
        F.coalesce(F.sum(F.col("both") / (F.col("sa") + F.col("sb") - F.col("both"))), F.lit(0.0)).alias("_j"))
    counts = named.agg(F.count(F.lit(1)).cast("double").alias("_r"),
                       F.count(F.when(F.col("size") == 0, 1)).cast("double").alias("_e"))
    n_pairs = F.col("_r") * (F.col("_r") - 1) / 2.0
    empty_pairs = F.col("_e") * (F.col("_e") - 1) / 2.0
    return overlap.join(F.broadcast(counts)).select(  # single rows
        F.when(n_pairs > 0, (F.col("_j") + empty_pairs) / F.when(n_pairs > 0, n_pairs)).alias("mean_jaccard"),
        n_pairs.cast("long").alias("n_pairs"))


def stability(records: DataFrame, members: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Restart ensemble in one row: ranges, set overlap and the instability flag."""
    s = records.agg(F.count(F.lit(1)).alias("n_restarts"),
                    (F.max("pooled_auc") - F.min("pooled_auc")).alias("auc_spread"),
                    (F.max("terminal_elbo") - F.min("terminal_elbo")).alias("elbo_spread"),
                    F.avg("pooled_auc").alias("auc_mean"), F.stddev_pop("pooled_auc").alias("auc_sd"))
    j = pairwise_jaccard(members, records).select("mean_jaccard")
    return s.join(F.broadcast(j)).withColumn("unstable", F.coalesce(F.col("auc_spread") > threshold, F.lit(False)))


def convergence(records: DataFrame) -> DataFrame:
    """Ensemble verdict and whether picking the best restart means anything (records: one row per restart)."""
    c = records.agg(F.count(F.lit(1)).alias("n_restarts"), F.count(F.when(F.col("converged"), 1)).alias("n_converged"),
                    F.count(F.when(F.col("hit_iter_cap"), 1)).alias("n_at_cap"),
                    F.median(F.abs("final_elbo_gain")).alias("median_gain"),
                    (F.max("terminal_elbo") - F.min("terminal_elbo")).alias("elbo_spread"))
    ok = (F.col("n_restarts") < 2) | F.col("elbo_spread").isNull() | F.col("median_gain").isNull() | \
        (F.col("elbo_spread") >= F.col("median_gain"))
    return c.withColumn("converged", (F.col("n_restarts") > 0) & (F.col("n_converged") == F.col("n_restarts"))) \
            .withColumn("selection_meaningful", ok)


# ---- method comparison -----------------------------------------------------------------------

def mean_interval(df: DataFrame, groups: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """Mean and Student-t half width per group; a single value has half width 0."""
    s = df.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"))
    half = t_quantile(F.lit(0.5 + level / 2.0), (F.col("n") - 1).cast("double")) * F.col("_sd") / F.sqrt("n")
    return s.select(*groups, "n", "mean", F.when(F.col("n") > 1, half).otherwise(0.0).alias("half_width"))


def pareto_front(methods: DataFrame, cost: str = "seconds", gain: str = "auc", label: str = "label") -> DataFrame:
    """Flag methods no other method beats on both cost and gain (one row per method)."""
    best = global_prefix_max(methods, [cost, F.desc(gain), label], gain)
    return best.withColumn("on_front", F.col("_seen").isNull() | (F.col(gain) > F.col("_seen"))).drop("_seen")


def global_prefix_max(df: DataFrame, order, column: str) -> DataFrame:
    """Largest ``column`` among the rows before each row, via positions and two-level maxima."""
    placed = global_position(df, order, "_pos").withColumn("_blk", F.floor(F.col("_pos") / 100_000))
    tops = placed.groupBy("_blk").agg(F.max(column).alias("_m"))
    past = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)  # one row per 100,000 rows
    tops = tops.select("_blk", F.max("_m").over(past).alias("_old"))
    inside = Window.partitionBy("_blk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("_new", F.max(column).over(inside)).join(tops, "_blk") \
        .withColumn("_seen", F.greatest("_old", "_new")).drop("_old", "_new", "_blk", "_pos")

