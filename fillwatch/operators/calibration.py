"""Rank uniformity, interval coverage and failure accounting over replicate tables.

Works on the long form ``(seed, component, rank, hit)``; ``long_ranks`` turns the
nested store into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillwatch.functions.labels import shape_hint
from fillwatch.functions.mathx import logit, norm_ppf, wilson
from fillwatch.functions.special import binom_quantile, chi2_sf
from fillwatch.operators.ordered import group_quantiles
from fillwatch.session import scalar_row

# Fixed values of the calibration report.
NOMINAL = 0.90
BAND = (0.85, 0.95)
MAX_BINS = 20
MIN_EXPECTED = 5
MAX_FAILURE_RATE = 0.05


# ---- selection -------------------------------------------------------------------------------

def replicate_flags(rows: DataFrame) -> DataFrame:
    """``failed`` and ``degenerate`` columns; a missing flag means healthy."""
    f = F.col("flags")
    failed = F.coalesce(f["failed"], F.lit(False)) | F.col("ranks").isNull()
    degenerate = ~F.coalesce(f["vem_converged"], F.lit(True)) | F.coalesce(f["laplace_fallback"], F.lit(False))
    return rows.withColumns({"failed": failed, "degenerate": degenerate})


def usable(rows: DataFrame, include_degenerate: bool = False) -> DataFrame:
    marked = replicate_flags(rows).where(~F.col("failed"))
    return marked if include_degenerate else marked.where(~F.col("degenerate"))


def long_ranks(rows: DataFrame) -> DataFrame:
    ranks = rows.select("seed", "L", F.explode("ranks").alias("component", "rank"), "hits90")
    return ranks.select("seed", "L", "component", "rank", F.col("hits90")[F.col("component")].alias("hit"))


# ---- rank uniformity ---------------------------------------------------------------------------

def default_bins(n: Column, size: Column | int) -> Column:
    s = size if isinstance(size, Column) else F.lit(size)
    return F.greatest(F.lit(2), F.least(F.lit(MAX_BINS), F.floor(n / MIN_EXPECTED), s + 1)).cast("int")


def rank_histogram(ranks: DataFrame, size: int, bins: int) -> DataFrame:
    """Counts per component and bin with exact expectations, empty bins kept."""
    # Bin j holds ranks from ceil(j (L + 1) / bins) up to the next edge.
    edge = lambda j: -F.floor(-(j * (size + 1)) / F.lit(bins))
    guess = F.floor(F.col("rank") * bins / F.lit(size + 1))
    home = F.when(edge(guess + 1) <= F.col("rank"), guess + 1).otherwise(guess).cast("int")
    n = ranks.groupBy("component", home.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = ranks.groupBy("component").agg(F.count(F.lit(1)).alias("total"))
    frame = totals.select("component", "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = edge(F.col("bin") + 1) - edge(F.col("bin"))
    return frame.join(n, ["component", "bin"], "left").select(
        "component", "bin", F.coalesce("n", F.lit(0)).alias("n"), F.col("total"),
        (width / F.lit(float(size + 1))).alias("prob"), (F.col("total") * width / F.lit(float(size + 1))).alias("expected"))


def bin_bands(hist: DataFrame, bins: int, band_alpha: float) -> DataFrame:
    """Binomial band per bin at a level shared over the bins."""
    a = band_alpha / bins
    return hist.withColumn("band_lo", binom_quantile(F.lit(a / 2), "total", "prob")) \
               .withColumn("band_hi", binom_quantile(F.lit(1 - a / 2), "total", "prob"))


def pit_statistics(ranks: DataFrame, size: int, band_alpha: float) -> DataFrame:
    """Mean and variance of the PIT, KS distance, band half width and standardized departures.

    Ranks repeat heavily, so everything runs on the (component, rank) counts.
    """
    pit = (F.col("rank") + 0.5) / F.lit(float(size + 1))
    tally = ranks.groupBy("component", "rank").agg(F.count(F.lit(1)).alias("w")).withColumn("pit", pit)
    upto = Window.partitionBy("component").orderBy("rank")  # at most L + 1 rows
    whole = Window.partitionBy("component")
    t = tally.withColumn("cum", F.sum("w").over(upto)).withColumn("n", F.sum("w").over(whole))
    gap = F.greatest(F.col("cum") / F.col("n") - F.col("pit"),
                     F.col("pit") - (F.col("cum") - F.col("w")) / F.col("n"))
    s = t.groupBy("component").agg(
        F.max("n").alias("n"), F.max(gap).alias("ks_stat"), (F.sum(F.col("w") * F.col("pit")) / F.max("n")).alias("mean_pit"),
        (F.sum(F.col("w") * F.col("pit") * F.col("pit")) / F.max("n")).alias("_sq"))
    s = s.withColumn("var_pit", F.col("_sq") - F.col("mean_pit") * F.col("mean_pit")).drop("_sq")
    s = s.withColumns({
        "band_half_width": F.sqrt(F.log(F.lit(2.0 / band_alpha)) / (2.0 * F.col("n"))),
        "ks_floor": F.lit(1.0 / (2.0 * (size + 1))),
        "bias_z": (F.col("mean_pit") - 0.5) / F.sqrt(1.0 / (12.0 * F.col("n"))),
        "dispersion_z": (F.col("var_pit") - 1.0 / 12.0) / F.sqrt(1.0 / (180.0 * F.col("n")))})
    return s.withColumn("band_violation", F.col("ks_stat") > F.col("band_half_width")) \
            .withColumn("shape", shape_hint("bias_z", "dispersion_z", -norm_ppf(F.lit(band_alpha / 2.0))))


def chi_square(hist: DataFrame) -> DataFrame:
    d = F.col("n") - F.col("expected")
    return hist.groupBy("component").agg(F.sum(d * d / F.col("expected")).alias("chi2_stat"),
                                         (F.count(F.lit(1)) - 1).alias("dof"))


def holm(p_values: DataFrame, p: str = "p_value", name: str = "component") -> DataFrame:
    """Step-down adjusted p-values over all rows, ties by name; positions come from the global order."""
    from fillwatch.operators.metrics import global_prefix_max
    from fillwatch.operators.ordered import global_position
    m = p_values.agg(F.count(F.lit(1)).alias("_m"))
    placed = global_position(p_values, [p, name], "_i").join(F.broadcast(m))
    step = placed.withColumn("_a", F.least(F.lit(1.0), (F.col("_m") - F.col("_i")) * F.col(p)))
    run = global_prefix_max(step, ["_i"], "_a")
    return run.withColumn("p_value_adj", F.greatest("_a", F.coalesce("_seen", F.lit(0.0)))).drop("_seen", "_a", "_i", "_m")


def rank_uniformity(ranks: DataFrame, size: int, bins: int | None = None, alpha: float = 0.05) -> DataFrame:
    """Full uniformity table: chi-square, PIT band and Holm-adjusted verdict per component."""
    facts = scalar_row(ranks.agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"),
                                 F.count_distinct("component").alias("k"), F.count_distinct("seed").alias("n")))
    if facts["lo"] < 0 or facts["hi"] > size:
        raise ValueError("a rank lies outside 0..L")
    bins = bins or max(2, min(MAX_BINS, facts["n"] // MIN_EXPECTED, size + 1))
    band_alpha = alpha / facts["k"]
    chi = chi_square(rank_histogram(ranks, size, bins)).withColumn(
        "p_value", chi2_sf("chi2_stat", F.col("dof").cast("double")))
    out = holm(chi).join(pit_statistics(ranks, size, band_alpha), "component")
    return out.withColumn("rejected", F.col("p_value_adj") < alpha)


# ---- coverage ------------------------------------------------------------------------------------

def coverage(hits: DataFrame, *, nominal: float = NOMINAL, band=BAND, alpha: float = 0.05,
             n_rows: int | None = None) -> DataFrame:
    """Hit rate with its Wilson interval and verdict per component; ``alpha`` is shared over the rows."""
    per = hits.groupBy("component").agg(F.count("hit").alias("n"), F.count(F.when(F.col("hit"), 1)).alias("n_hits"))
    k = F.lit(n_rows) if n_rows else F.col("_k")
    # one extra row; the quantile is its own column so that it is evaluated once
    per = per.join(F.broadcast(per.agg(F.count(F.lit(1)).alias("_k")))).withColumn("_z", -norm_ppf(alpha / k / 2.0))
    lo, hi = wilson("n_hits", "n", "_z")
    p = F.col("n_hits") / F.when(F.col("n") > 0, F.col("n").cast("double"))
    out = per.select("component", "n", "n_hits", F.coalesce(p, F.lit(0.0)).alias("rate"), lo.alias("ci_lo"), hi.alias("ci_hi"))
    ok = (F.col("n") > 0) & (F.col("ci_lo") <= nominal) & (F.col("ci_hi") >= nominal)
    sure = ok & (F.col("ci_lo") >= band[0]) & (F.col("ci_hi") <= band[1])
    return out.withColumn("in_range", ok).withColumn("conclusive", sure).withColumn(
        "verdict", F.when(~ok, "fail").when(sure, "pass (conclusive)").otherwise("pass (underpowered)"))


def coverage_with_wallets(rows: DataFrame, **kw) -> DataFrame:
    """Coverage of the nested store: one row per component plus the pooled wallet intervals."""
    comp = long_ranks(rows).select("component", "hit")
    theta = rows.select(F.lit("theta_w").alias("component"), F.explode("theta_hits90").alias("hit"))
    return coverage(comp.unionByName(theta), **kw)


def cluster_rates(hits: DataFrame, cluster: str = "seed") -> DataFrame:
    """Spread of the hit rate between clusters (replicates)."""
    r = hits.groupBy(cluster).agg(F.avg(F.col("hit").cast("double")).alias("_r"), F.count("hit").alias("_n"))
    return r.agg(F.count(F.lit(1)).alias("n_replicates"), F.sum("_n").alias("n_intervals"), F.avg("_r").alias("mean_rate"),
                 F.coalesce(F.stddev_samp("_r"), F.lit(0.0)).alias("between_sd"))


def pooled_value(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.count(column).alias("n"), F.avg(column).alias("mean"),
                    F.when(F.count(column) == 1, 0.0).otherwise(F.stddev_samp(column)).alias("sd"))


# ---- bookkeeping -----------------------------------------------------------------------------------

def failure_accounting(rows: DataFrame) -> DataFrame:
    m = replicate_flags(rows)
    scored = ~F.col("failed")
    f = F.col("flags")
    a = m.agg(
        F.count(F.lit(1)).alias("n_replicates"), F.count(F.when(F.col("failed"), 1)).alias("n_failed"),
        F.count(F.when(scored, 1)).alias("n_scored"), F.count(F.when(scored & F.col("degenerate"), 1)).alias("n_degenerate"),
        F.count(F.when(scored & ~F.coalesce(f["vem_converged"], F.lit(True)), 1)).alias("n_nonconverged"),
        F.count(F.when(scored & F.coalesce(f["laplace_fallback"], F.lit(False)), 1)).alias("n_fallback"))
    return a.withColumn("failure_rate", F.when(F.col("n_replicates") > 0, F.col("n_failed") / F.col("n_replicates")).otherwise(0.0)) \
            .withColumn("degenerate_rate", F.when(F.col("n_scored") > 0, F.col("n_degenerate") / F.col("n_scored")).otherwise(0.0))


def error_counts(rows: DataFrame) -> DataFrame:
    return replicate_flags(rows).where("failed").groupBy(
        F.coalesce(F.nullif(F.col("flags.error"), F.lit("")), F.lit("unspecified")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def distinct_sizes(rows: DataFrame) -> DataFrame:
    z = F.lit(0)
    return rows.select(F.coalesce("size.K", z).alias("K"), F.coalesce("size.T", z).alias("T"),
                       F.coalesce("size.n_wallets", z).alias("n_wallets")).distinct()


def coverage_power(table: DataFrame, alpha: float = 0.05) -> DataFrame:
    """How much of a coverage table is conclusive: counts per verdict, names of the underpowered rows, smallest ``n``, level of a row."""
    weak = F.col("in_range") & ~F.col("conclusive")
    return table.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("conclusive"), 1)).alias("n_conclusive"),
                     F.count(F.when(weak, 1)).alias("n_underpowered"), F.count(F.when(~F.col("in_range"), 1)).alias("n_failed"),
                     F.sort_array(F.collect_list(F.when(weak, F.col("component")))).alias("underpowered"),
                     F.coalesce(F.min("n"), F.lit(0)).alias("min_n"), (F.lit(alpha) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("row_alpha"))


def flag_list(uniformity: DataFrame, cov: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Names of every check that did not pass; too many failed replicates are a flag of no component."""
    a = uniformity.where("rejected").select(F.lit("rank").alias("check"), "component")
    b = uniformity.where("band_violation AND NOT rejected").select(F.lit("band").alias("check"), "component")
    c = cov.where("NOT in_range").select(F.lit("coverage").alias("check"), "component")
    out = a.unionByName(b).unionByName(c)
    if failures is None:
        return out
    return out.unionByName(failures.where(F.col("failure_rate") > MAX_FAILURE_RATE).select(F.lit("failure_rate").alias("check"), F.lit("").alias("component")))


def store_regimes(rows: DataFrame) -> DataFrame:
    """One row: how many replicates, different draw counts and different priors a store has. A missing prior is an empty one."""
    prior = F.array_sort(F.map_entries(F.coalesce("prior", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("L").alias("n_sizes"), F.count_distinct(F.to_json(prior)).alias("n_priors"),
                    F.max("L").alias("L"))


def one_regime(rows: DataFrame) -> int:
    """The common number of draws; a store without replicates, with several draw counts or with several priors is refused,
    because its ranks can't be pooled."""
    row = scalar_row(store_regimes(rows))
    if not row["n"]:
        raise ValueError("no replicates to analyse")
    if row["n_sizes"] > 1:
        raise ValueError(f"replicates disagree on the number of draws: {row['n_sizes']} values")
    if row["n_priors"] > 1:
        raise ValueError(f"replicates disagree on the prior: {row['n_priors']} priors")
    return row["L"]


def store_flags(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Flags of a whole replicate store: refused if it mixes regimes, then ranks, coverage and failures of its usable rows."""
    good = usable(rows)
    size = one_regime(good)
    ranks = long_ranks(good)
    return flag_list(rank_uniformity(ranks, size, alpha=alpha), coverage_with_wallets(good, alpha=alpha), failure_accounting(rows))


def degenerate_sensitivity(rows: DataFrame, **kw) -> DataFrame:
    """Coverage with and without degenerate replicates."""
    strict = coverage(long_ranks(usable(rows)).select("component", "hit"), **kw).select("component", F.col("rate").alias("rate"))
    loose = coverage(long_ranks(usable(rows, True)).select("component", "hit"), **kw).select(
        "component", F.col("rate").alias("rate_with_degenerate"))
    return loose.join(strict, "component", "left")


# ---- ranks of truths -----------------------------------------------------------------------------

def rank_truth(draws: DataFrame, truth: DataFrame, nominal: float = NOMINAL) -> DataFrame:
    """Rank of the true value among the draws, and whether the central interval holds it."""
    tail = (1.0 - nominal) / 2.0
    below = draws.join(truth, "name").groupBy("name").agg(
        F.count(F.when(F.col("value") < F.col("truth"), 1)).alias("rank"), F.max("truth").alias("truth"))
    q = group_quantiles(draws, ["name"], "value", {"lo": tail, "hi": 1.0 - tail})
    return below.join(q, "name").withColumn("hit", F.col("truth").between(F.col("lo"), F.col("hi")))


def wallet_interval_hits(theta: DataFrame, nominal: float = NOMINAL) -> DataFrame:
    """Logit-normal interval check per wallet from ``(wallet, logit_mean, logit_var, theta_true)``."""
    z = -norm_ppf(F.lit((1.0 - nominal) / 2.0))
    half = z * F.sqrt(F.greatest("logit_var", F.lit(0.0)))
    return theta.withColumn("hit", F.abs(logit("theta_true") - F.col("logit_mean")) <= half)

