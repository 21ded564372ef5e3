"""Summaries of posterior draws in long form."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwatch.functions.mathx import norm_ppf, sigmoid
from fillwatch.operators.ordered import global_position, global_prefix, group_quantiles
from fillwatch.session import cut, scalar_row, stored


def trade_posteriors(latent: DataFrame, burnin: int = 0) -> DataFrame:
    """P(Z), P(V), E[X] and E[sigmoid X] per trade over the kept draws, chains pooled."""
    return latent.where(F.col("iter") >= burnin).groupBy("market", "i").agg(
        F.avg(F.col("z").cast("double")).alias("p_z"), F.avg(F.col("v").cast("double")).alias("p_v"),
        F.avg("x").alias("x_mean"), F.avg(sigmoid("x")).alias("pi_mean"))


def credible_interval(draws: DataFrame, keys: Sequence[str], value: str = "value", alpha: float = 0.05) -> DataFrame:
    return group_quantiles(draws, keys, value, {"lo": alpha / 2.0, "hi": 1.0 - alpha / 2.0})


def wallet_ranking(draws: DataFrame, counts: DataFrame, burnin: int = 0, alpha: float = 0.05) -> DataFrame:
    """Wallets by posterior mean propensity with median, interval and evidence."""
    kept = draws.where(F.col("iter") >= burnin)
    q = group_quantiles(kept, ["wallet"], "value", {"lo": alpha / 2.0, "median": 0.5, "hi": 1.0 - alpha / 2.0})
    m = kept.groupBy("wallet").agg(F.avg("value").alias("mean"))
    rows = m.join(q.drop("n"), "wallet").join(counts, "wallet", "left") \
            .withColumn("n_trades", F.coalesce("n_trades", F.lit(0))).withColumn("_neg", -F.col("mean"))
    return global_position(rows, ["_neg", "wallet"], "_p").withColumn("rank", F.col("_p") + 1).drop("_p", "_neg")


def _halves(draws: DataFrame) -> DataFrame:
    """Split every chain in two equal halves, dropping the middle draw of an odd chain."""
    size = draws.groupBy("name", "chain").agg((F.max("iter") + 1).alias("_n"))
    h = F.floor(F.col("_n") / 2)
    j = draws.join(size, ["name", "chain"])
    part = F.when(F.col("iter") < h, 0).when(F.col("iter") >= F.col("_n") - h, 1)
    return j.withColumn("part", part).where("part IS NOT NULL").select(
        "name", F.concat_ws("-", F.col("chain").cast("string"), F.col("part").cast("string")).alias("sub"),
        F.when(F.col("part") == 0, F.col("iter")).otherwise(F.col("iter") - F.col("_n") + h).alias("j"), "value")


def _rank_normal(split: DataFrame, value: str) -> DataFrame:
    """Replace values by normal scores of their tie-averaged ranks within ``name``."""
    tally = split.groupBy("name", value).agg(F.count(F.lit(1)).alias("_w"))
    run = global_prefix(tally, ["name", value], {"_u": F.col("_w")}).withColumn("_f", F.col("_u") - F.col("_w"))
    base = run.groupBy("name").agg(F.min("_f").alias("_s"), F.sum("_w").alias("_tot"))
    rank = F.col("_f") - F.col("_s") + (F.col("_w") + 1) / 2.0
    scored = run.join(base, "name").select("name", value, norm_ppf((rank - 0.375) / (F.col("_tot") + 0.25)).alias("zs"))
    return split.join(scored, ["name", value])


def _variance_ratio(split: DataFrame, value: str) -> DataFrame:
    c = split.groupBy("name", "sub").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    g = c.groupBy("name").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("k"), F.var_samp("m").alias("b"), F.avg("v").alias("w"))
    return g.select("name", F.when(F.col("w") > 0, F.sqrt(
        F.col("b") / F.when(F.col("w") > 0, F.col("w")) + (F.col("n") - 1) / F.col("n"))).alias("rhat"))


def rank_scores(draws: DataFrame) -> DataFrame:
    """``name, sub, j, value, zs``: the draws of the split chains with their normal scores, written once for all that read them."""
    return stored(_rank_normal(cut(_halves(draws)), "value").select("name", "sub", "j", "value", "zs"), "rank-scores")


def rhat(draws: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Rank-normalized split R-hat: the larger of the bulk and the folded form; NULL for one chain. ``ranked`` are the draws'
    ``rank_scores``, where they are at hand."""
    ranked = rank_scores(draws) if ranked is None else ranked
    split = ranked.drop("zs")
    bulk = _variance_ratio(ranked, "zs").withColumnRenamed("rhat", "_b")
    med = group_quantiles(split, ["name"], "value", {"_med": 0.5}).select("name", "_med")
    fold = split.join(med, "name").withColumn("far", F.abs(F.col("value") - F.col("_med"))).select("name", "sub", "j", "far")
    tail = _variance_ratio(_rank_normal(fold, "far"), "zs").withColumnRenamed("rhat", "_t")
    chains = draws.groupBy("name").agg(F.count_distinct("chain").alias("n_chains"))
    return bulk.join(tail, "name").join(chains, "name").select(
        "name", "n_chains", F.when(F.col("n_chains") > 1, F.greatest("_b", "_t")).alias("rhat"))


#: Draws of one chain in a packed row; lags of the first round (each round has twice as many).
CHAIN_CHUNK, FIRST_LAGS = 4096, 64


def _pack_chains(centred: DataFrame, chunk: int) -> DataFrame:
    """``name, sub, chunk, c``: runs of ``chunk`` places of a chain as dense arrays, 0 where there is no draw."""
    def dense(batches):
        for batch in batches:
            size, at = (pc.list_value_length(batch.column("s")).to_numpy(), batch.column("s").flatten())
            row = np.repeat(np.arange(len(size)), size)
            out = np.zeros((len(size), chunk))
            out[row, at.field("p").to_numpy()] = at.field("c").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("name", "sub", "chunk")), pa.array(list(out))], ["name", "sub", "chunk", "c"])

    places = centred.groupBy("name", "sub", F.expr(f"CAST(j AS BIGINT) div {chunk}").alias("chunk")).agg(
        F.collect_list(F.struct((F.col("j") % chunk).cast("int").alias("p"), "c")).alias("s"))
    return stored(places.mapInArrow(dense, "name STRING, sub STRING, chunk BIGINT, c ARRAY<DOUBLE>"), "ess-chains")


def _lag_sums(packed: DataFrame, first: int, lags: int, chunk: int) -> DataFrame:
    """``name, sub, lag, a``: sums of products of draws ``lag`` apart, for ``lags`` lags from ``first``.

    A packed row meets the two or more packed rows that lie so far ahead: an equi-join of packed rows, no draw is unfolded."""
    steps = range(first // chunk, (first + lags - 1 + chunk - 1) // chunk + 1)

    def products(batches):
        for batch in batches:
            own, other = (batch.column(c).flatten().to_numpy().reshape(-1, chunk) for c in ("c", "ahead"))
            step = batch.column("step").to_numpy()
            out = np.zeros((len(step), lags))
            for k in range(lags):
                shift = first + k - step * chunk  # place p meets place p + shift of the row ahead
                for d in np.unique(shift[np.abs(shift) < chunk]):
                    at = shift == d
                    a, b = (own[at, :chunk - d], other[at, d:]) if d >= 0 else (own[at, -d:], other[at, :chunk + d])
                    out[at, k] = np.einsum("ij,ij->i", a, b)
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("sub"), pa.array(list(out))], ["name", "sub", "a"])

    ahead = packed.select("name", "sub", F.col("c").alias("ahead"), F.explode(F.array(*[F.lit(s).cast("long") for s in steps])).alias("step"),
                          F.col("chunk").alias("at")).withColumn("chunk", F.col("at") - F.col("step"))
    met = packed.join(ahead, ["name", "sub", "chunk"]).select("name", "sub", "c", "ahead", "step")
    return met.mapInArrow(products, "name STRING, sub STRING, a ARRAY<DOUBLE>").select("name", "sub", F.posexplode("a").alias("k", "x")) \
              .groupBy("name", "sub", (F.col("k") + first).alias("lag")).agg(F.sum("x").alias("a"))


def bulk_ess(draws: DataFrame, first_lags: int = FIRST_LAGS, chunk: int = CHAIN_CHUNK, ranked: DataFrame | None = None) -> DataFrame:
    """Effective sample size of the rank-normalized split chains.

    Chains are packed in bounded runs, and the autocovariances of a round's lags are sums of products of runs. Rounds of
    doubling size go on until the initial-positive rule has stopped for every quantity, so
    no chain is gathered into one task and no lag limit is imposed.
    """
    z = (rank_scores(draws) if ranked is None else ranked).select("name", "sub", "j", "zs")
    per = z.groupBy("name", "sub").agg(F.count(F.lit(1)).alias("n"), F.avg("zs").alias("m"))
    packed = _pack_chains(z.join(per, ["name", "sub"]).select("name", "sub", "j", (F.col("zs") - F.col("m")).alias("c")), chunk)
    per = stored(per, "ess-shape")
    shape = per.groupBy("name").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("k"),
                                    F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("between"))
    acov, start, lags = None, 0, first_lags
    while True:
        block = _lag_sums(packed, start, lags, chunk).join(per.select("name", "sub", "n"), ["name", "sub"]) \
            .groupBy("name", "lag").agg(F.avg(F.col("a") / F.col("n")).alias("a"))
        acov = stored(block if acov is None else acov.unionByName(block), "ess-lags")
        start, lags = start + lags, 2 * lags
        ess = stored(_ess_from_lags(acov, shape, start), "ess")
        if scalar_row(ess.agg(F.coalesce(F.min(F.col("done").cast("int")), F.lit(1)).alias("ok")))["ok"]:
            return ess.select("name", "ess")


def _ess_from_lags(acov: DataFrame, shape: DataFrame, lags: int) -> DataFrame:
    """Geyer's initial monotone positive sequence on the lags known so far."""
    arr = acov.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("lag", "a"))).alias("s"))
    a = arr.join(shape, "name").withColumn("a", F.col("s.a"))
    n, k = F.col("n"), F.col("k")
    mean_var = F.col("a")[0] * n / (n - 1.0)
    plus = mean_var * (n - 1.0) / n + F.when(k > 1, F.col("between")).otherwise(0.0)
    a = a.withColumn("mv", mean_var).withColumn("plus", plus).where("plus > 0")
    rho = F.transform("a", lambda x, i: F.when(i == 0, 1.0).otherwise(1.0 - (F.col("mv") - x) / F.col("plus")))
    a = a.withColumn("rho", rho)
    pairs = F.transform(F.sequence(F.lit(0), (F.size("rho") / 2 - 1).cast("int")),
                        lambda i: F.get("rho", 2 * i) + F.get("rho", 2 * i + 1))
    state = F.aggregate(
        pairs, F.struct(F.lit(0.0).alias("sum"), F.lit(1e300).alias("low"), F.lit(False).alias("stop")),
        lambda s, p: F.when(s["stop"] | (p <= 0), F.struct(s["sum"].alias("sum"), s["low"].alias("low"), F.lit(True).alias("stop")))
        .otherwise(F.struct((s["sum"] + F.least(s["low"], p)).alias("sum"), F.least(s["low"], p).alias("low"),
                            F.lit(False).alias("stop"))))
    a = a.withColumn("st", state)
    total = n * k
    tau = F.greatest(-1.0 + 2.0 * F.col("st.sum"), 1.0 / F.log10(total.cast("double")))
    return a.select("name", (F.col("st.stop") | (F.lit(lags) >= n)).alias("done"), (total / tau).alias("ess"))


def parameter_summary(draws: DataFrame, burnin: int = 0, alpha: float = 0.05) -> DataFrame:
    """Mean, sd, interval, ESS and R-hat per parameter."""
    kept = draws.where(F.col("iter") >= burnin).withColumn("iter", F.col("iter") - burnin)
    ranked = rank_scores(kept)
    m = kept.groupBy("name").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return m.join(credible_interval(kept, ["name"], "value", alpha).drop("n"), "name") \
            .join(bulk_ess(kept, ranked=ranked), "name", "left").join(rhat(kept, ranked).select("name", "rhat"), "name", "left")


def diagnose(summary: DataFrame, limit: float = 1.01) -> DataFrame:
    worst = summary.agg(F.max("rhat").alias("worst_rhat"), F.min("ess").alias("min_ess"),
                        F.count(F.when(F.col("rhat") > limit, 1)).alias("n_flagged"))
    return worst


def flagged_parameters(summary: DataFrame, limit: float = 1.01) -> DataFrame:
    return summary.where(F.col("rhat") > limit).select("name", "rhat")


def degeneracy_rate(ess: DataFrame, n_particles: int, fraction: float = 0.25, groups: Sequence[str] = ()) -> DataFrame:
    """Share of steps whose effective size is below a fraction of the particles."""
    return ess.groupBy(*groups).agg(F.avg((F.col("ess") < fraction * n_particles).cast("double")).alias("degenerate_share"))


def weight_ess(weights: DataFrame, groups: Sequence[str], log_weight: str = "log_w") -> DataFrame:
    """Log normalizer and effective sample size per weight group, shifted by the maximum."""
    top = weights.groupBy(*groups).agg(F.max(log_weight).alias("_top"))
    w = F.exp(F.col(log_weight) - F.col("_top"))
    s = weights.join(top, list(groups)).groupBy(*groups).agg(F.max("_top").alias("_t"), F.sum(w).alias("_a"), F.sum(w * w).alias("_b"))
    return s.select(*groups, (F.col("_t") + F.log("_a")).alias("log_norm"),
                    (2.0 * F.log("_a") - F.log("_b")).alias("log_ess"), (F.col("_a") * F.col("_a") / F.col("_b")).alias("ess"))
