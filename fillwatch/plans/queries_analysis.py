"""Queries over metrics, event study, backtest, case tables, calibration and posterior draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from fillwatch.config import DAY, CostModel, OnlineConfig, Prior, WindowSpec
from fillwatch.functions import labels as lb
from fillwatch.functions import mathx as mx
from fillwatch.functions import special
from fillwatch.operators import (backtest, calibration, case_study, clean, event_study, features, metrics, posterior,
                                 wallets)
from fillwatch.plans.queries_core import RHO_SQL, r, sql_cdf, sql_horner
from fillwatch.plans.registry import query
from fillwatch.plans.views import sql
from fillwatch.sources import files

# ---- scalar functions ------------------------------------------------------------------------


def sql_ppf(p: str) -> str:
    q = f"({p} - 0.5)"
    rr = f"(0.180625 - {q} * {q})"
    t = f"sqrt(-ln(least({p}, 1 - {p})))"
    mid = f"{sql_horner(f'({t} - 1.6)', mx.AS241_MIDDLE_NUM)} / {sql_horner(f'({t} - 1.6)', mx.AS241_MIDDLE_DEN)}"
    far = f"{sql_horner(f'({t} - 5.0)', mx.AS241_TAIL_NUM)} / {sql_horner(f'({t} - 5.0)', mx.AS241_TAIL_DEN)}"
    return (f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {sql_horner(rr, mx.AS241_CENTRE_NUM)} / {sql_horner(rr, mx.AS241_CENTRE_DEN)} "
            f"WHEN {p} > 0 AND {p} < 1 THEN sign({q}) * (CASE WHEN {t} <= 5.0 THEN {mid} ELSE {far} END) END)")


@query("mth_scalar_functions", sql(f"""SELECT tx_hash, round(1 / (1 + exp(-y)), 9) AS sig, round(CASE WHEN 10 * y > 35 THEN 10 * y ELSE ln(1 + exp(10 * y)) END, 6) AS softplus,
round({sql_cdf('y')}, 9) AS cdf, round(0.1 * delta, 6) AS q0, round(0.5 / greatest(1 + log_size_ratio, 0.1), 6) AS r0 FROM features""", "features"))
def _(t):
    return t.features.select("tx_hash", r(mx.sigmoid("y"), 9).alias("sig"), r(mx.log1pexp(F.col("y") * 10)).alias("softplus"),
                             r(mx.norm_cdf("y"), 9).alias("cdf"), r(mx.process_variance(0, "delta", 0.1, 1.0)).alias("q0"),
                             r(mx.obs_variance(0, "log_size_ratio", 0.5, 0.1)).alias("r0"))


@query("mth4_weight_ess", sql("""SELECT market, round(top + ln(a), 9) AS log_norm, round(2 * ln(a) - ln(b), 9) AS log_ess, round(a * a / b, 6) AS ess FROM (
  SELECT market, max(m) AS top, sum(exp(y - m)) AS a, sum(exp(2 * (y - m))) AS b FROM (SELECT market, y, max(y) OVER (PARTITION BY market) AS m FROM features_big)
  GROUP BY market)""", "features_big"))
def _(t):
    return posterior.weight_ess(t.features_big, ["market"], "y").select("market", r("log_norm", 9).alias("log_norm"),
                                                                        r("log_ess", 9).alias("log_ess"), r("ess").alias("ess"))


@query("mth5_normal_quantile", f"SELECT o_orderkey, round({sql_ppf('p')}, 9) AS z FROM (SELECT o_orderkey, (o_orderkey % 9999 + 1) / 10000.0 AS p FROM orders)")
def _(t):
    o = t.read("orders").select("o_orderkey", ((F.col("o_orderkey") % 9999 + 1) / F.lit(10000.0)).alias("p"))
    return o.select("o_orderkey", r(mx.norm_ppf("p"), 9).alias("z"))


@query("mth6_chi2_even", """SELECT o_orderkey, round(exp(-h) * (1 + h + h * h / 2 + h * h * h / 6), 9) AS sf FROM (SELECT o_orderkey, (o_orderkey % 500) / 20.0 AS h FROM orders)""")
def _(t):
    return t.read("orders").select("o_orderkey", r(mx.chi2_sf_even((F.col("o_orderkey") % 500) / F.lit(10.0), F.lit(8)), 9).alias("sf"))


@query("mth6_chi2_any", """SELECT o_orderkey, round(exp(-h) * (1 + h + h * h / 2 + h * h * h / 6), 9) AS sf FROM (SELECT o_orderkey, (o_orderkey % 500) / 20.0 AS h FROM orders)""")
def _(t):
    return t.read("orders").select("o_orderkey", r(special.chi2_sf((F.col("o_orderkey") % 500) / F.lit(10.0), F.lit(8.0)), 9).alias("sf"))


def binom_sql(q: str, n: str, p: str) -> str:
    """Smallest k whose cumulative binomial probability reaches q."""
    return f"""(SELECT min(k) FROM (SELECT k, sum(exp(lgamma({n} + 1.0) - lgamma(k + 1.0) - lgamma({n} - k + 1.0) + k * ln({p}) + ({n} - k) * ln(1 - {p}))) OVER (ORDER BY k) AS c
      FROM (SELECT unnest(range({n} + 1)) AS k)) WHERE c >= {q} * (1 - 1e-12))"""


def t_views(dofs: str, p: float = 0.975) -> dict[str, str]:
    """``tq(dof, t)``: Student quantiles of ``dofs(dof)`` by halving an interval, the distribution function by Simpson's rule."""
    density = "exp(lgamma((dof + 1) / 2.0) - lgamma(dof / 2.0)) / sqrt(dof * pi()) * pow(1 + pow(mid * j / 400, 2) / dof, -(dof + 1) / 2.0)"
    below = f"0.5 + mid / 1200 * list_sum([CASE WHEN j = 0 OR j = 400 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * {density} for j in range(401)])"
    return {"bis": f"""SELECT dof, 0.0e0 AS lo, 16.0e0 AS hi, 0 AS it FROM ({dofs})
              UNION ALL SELECT dof, CASE WHEN c < {p} THEN mid ELSE lo END, CASE WHEN c < {p} THEN hi ELSE mid END, it + 1 FROM (
              SELECT *, {below} AS c FROM (SELECT *, (lo + hi) / 2 AS mid FROM bis b WHERE it < 45))""",
            "tq": "SELECT dof, (lo + hi) / 2 AS t FROM bis WHERE it = 45"}


@query("mth7_quantiles", sql(f"""SELECT o.dof, round(t, 6) AS t975, CAST({binom_sql('0.975', 'o.n', '0.1e0')} AS DOUBLE) AS binom975
FROM (SELECT o_custkey % 50 + 2 AS dof, count(*) AS n FROM orders GROUP BY 1) o JOIN tq ON tq.dof = o.dof""", **t_views("SELECT DISTINCT o_custkey % 50 + 2 AS dof FROM orders")))
def _(t):
    o = t.read("orders").groupBy((F.col("o_custkey") % 50 + 2).alias("dof")).agg(F.count("*").alias("n"))
    return o.select("dof", r(special.t_quantile(F.lit(0.975), F.col("dof").cast("double"))).alias("t975"),
                    special.binom_quantile(F.lit(0.975), "n", F.lit(0.1)).alias("binom975"))


@query("mth8_log_priors", """SELECT o_orderkey, round(-3 * ln(v) - 1 / v, 6) AS log_sigma2, round(-ln(pi() * 2.5) - ln(1 + (v / 2.5) * (v / 2.5)), 6) AS log_beta
FROM (SELECT o_orderkey, o_totalprice / 100000 AS v FROM orders)""")
def _(t):
    v = F.col("o_totalprice") / 100000
    return t.read("orders").select("o_orderkey", r(mx.log_invgamma(v, 2.0, 1.0)).alias("log_sigma2"), r(mx.log_cauchy(v, 2.5)).alias("log_beta"))


@query("mth8_joint_prior", """SELECT o_orderkey, round(-3 * ln(v) - 1 / v - 3 * ln(w) - 1 / w + 2 * (-ln(pi() * 2.5)) - ln(1 + v * v / 6.25) - ln(1 + w * w / 6.25), 6) AS log_p
FROM (SELECT o_orderkey, o_totalprice / 100000 AS v, o_totalprice / 50000 AS w FROM orders)""")
def _(t):
    from fillwatch.operators.em import log_prior
    v, w = F.col("o_totalprice") / 100000, F.col("o_totalprice") / 50000
    p = t.read("orders").select("o_orderkey", v.alias("sigma2_0"), w.alias("sigma2_1"), F.lit(0.3).alias("q_01"), F.lit(0.4).alias("q_10"),
                                v.alias("beta_S"), w.alias("beta_Z"))
    return p.select("o_orderkey", r(log_prior(Prior(), parts=("sigma2", "q", "beta"))).alias("log_p"))


@query("mth10_costs", sql("""SELECT tx_hash, round(0.07 * price * (1 - price), 9) AS fee, ceil(round(7.0 * size * price * (1 - price), 9)) / 100.0 AS billed,
round(CASE WHEN price >= 0.5 THEN price ELSE 1 - price END + 0.01 + 0.07 * price * (1 - price), 9) AS cost FROM trades""", "trades"))
def _(t):
    c = CostModel()
    side = F.when(F.col("price") >= 0.5, "yes").otherwise("no")
    return t.trades.select("tx_hash", r(mx.taker_fee("price", c.fee_rate), 9).alias("fee"),
                           mx.billed_fee("price", "size", c.fee_rate).alias("billed"),
                           r(mx.entry_cost("price", side, c.spread, c.fee_rate), 9).alias("cost"))


@query("mth11_learning_rate", "SELECT o_orderkey, round(power(o_orderkey + 50.0, -0.6), 9) AS rho, CAST(0.02 AS DOUBLE) AS fixed_rho, round(least(1 / (1 - 0.98 + 1e-12), 1e6), 6) AS eff FROM orders")
def _(t):
    c = OnlineConfig(schedule="robbins_monro")
    return t.read("orders").select("o_orderkey", r(mx.learning_rate("o_orderkey", c.schedule, c.forgetting, c.rho_alpha, c.rho_t0), 9).alias("rho"),
                                   r(mx.learning_rate("o_orderkey", "fixed", 0.98, 0.6, 50.0), 9).alias("fixed_rho"),
                                   r(mx.effective_window(0.98)).alias("eff"))


@query("strf1_iso", sql("SELECT tx_hash, strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(ts AS DOUBLE) AS back FROM trades", "trades"))
def _(t):
    x = t.trades.select("tx_hash", lb.iso_utc("ts").alias("iso"))
    return x.withColumn("back", lb.parse_iso("iso"))


@query("strf2_sufficiency", sql("""SELECT wallet, CASE WHEN count(*) < 20 THEN 'prior-dominated' WHEN count(*) < 100 THEN 'weak' ELSE 'meaningful' END AS label
FROM trades_big GROUP BY wallet""", "trades_big"))
def _(t):
    return t.trades_big.groupBy("wallet").agg(F.count("*").alias("n")).select("wallet", lb.sufficiency("n").alias("label"))


@query("strf3_khat_band", """SELECT o_orderkey, CASE WHEN k IS NULL THEN 'undefined' WHEN k < 0.5 THEN 'good' WHEN k <= 0.7 THEN 'acceptable' ELSE 'unreliable' END AS band
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 3 THEN (o_orderkey % 100) / 100.0 END AS k FROM orders)""")
def _(t):
    k = F.when(F.col("o_orderkey") % 10 != 3, (F.col("o_orderkey") % 100) / F.lit(100.0))
    return t.read("orders").select("o_orderkey", lb.khat_band(k).alias("band"))


# ---- metrics -----------------------------------------------------------------------------------

AVG_RANK_SQL = "SELECT doc_id, rank() OVER (ORDER BY z_score) + (count(*) OVER (PARTITION BY z_score) - 1) / 2.0 AS avg_rank FROM labelled"


@query("win10_average_ranks", sql(AVG_RANK_SQL, "labelled"))
def _(t):
    from fillwatch.operators.ordered import average_ranks
    x = t.labelled
    return x.join(average_ranks(x, "z_score").drop("n"), "z_score").select("doc_id", "avg_rank")


AUC_SQL = """(sum(rk) FILTER (WHERE z = 1) - count(*) FILTER (WHERE z = 1) * (count(*) FILTER (WHERE z = 1) + 1) / 2.0)
 / (count(*) FILTER (WHERE z = 1) * count(*) FILTER (WHERE z = 0))"""


@query("evl1_roc_auc", sql(f"""SELECT 'toxic' AS target, round({AUC_SQL}, 9) AS auc FROM (SELECT z_true AS z, rank() OVER (ORDER BY z_score) + (count(*) OVER (PARTITION BY z_score) - 1) / 2.0 AS rk FROM labelled)
UNION ALL SELECT 'quality', round({AUC_SQL}, 9) FROM (SELECT z_quality AS z, rank() OVER (ORDER BY z_score) + (count(*) OVER (PARTITION BY z_score) - 1) / 2.0 AS rk FROM labelled)""", "labelled"))
def _(t):
    a = metrics.roc_auc(t.labelled).select(F.lit("toxic").alias("target"), r("auc", 9).alias("auc"))
    b = metrics.roc_auc(t.labelled, "z_quality").select(F.lit("quality").alias("target"), r("auc", 9).alias("auc"))
    return a.unionByName(b)


@query("evl1_roc_auc_by_market", sql(f"""SELECT market, round(CASE WHEN bool_or(z = 1) AND bool_or(z = 0) THEN {AUC_SQL} ELSE 0.5 END, 9) AS auc FROM (
SELECT market, z_true AS z, rank() OVER (PARTITION BY market ORDER BY z_score) + (count(*) OVER (PARTITION BY market, z_score) - 1) / 2.0 AS rk FROM labelled) GROUP BY market""", "labelled"))
def _(t):
    return metrics.roc_auc(t.labelled, groups=["market"]).select("market", r("auc", 9).alias("auc"))


@query("evl2_roc_curve", sql("""SELECT round(fp / max(fp) OVER (), 9) AS fpr, round(tp / max(tp) OVER (), 9) AS tpr, threshold FROM (
  SELECT z_score AS threshold, sum(sum(z_true)) OVER (ORDER BY z_score DESC) AS tp, sum(sum(1 - z_true)) OVER (ORDER BY z_score DESC) AS fp FROM labelled GROUP BY z_score
  UNION ALL SELECT max(z_score) + 1, 0, 0 FROM labelled)""", "labelled"))
def _(t):
    return metrics.roc_curve(t.labelled).select(r("fpr", 9).alias("fpr"), r("tpr", 9).alias("tpr"), "threshold")


@query("win11_cumulative_counts", sql("""SELECT z_score, sum(sum(z_true)) OVER (ORDER BY z_score DESC) AS tp, sum(sum(1 - z_true)) OVER (ORDER BY z_score DESC) AS fp
FROM labelled GROUP BY z_score""", "labelled"))
def _(t):
    from fillwatch.operators.ordered import global_prefix
    x = t.labelled.groupBy("z_score").agg(F.sum("z_true").alias("pos"), F.sum(1 - F.col("z_true")).alias("neg"))
    return global_prefix(x, [F.desc("z_score")], {"tp": F.col("pos"), "fp": F.col("neg")}).select("z_score", "tp", "fp")


PAIR_SQL = "SELECT wallet, sum(size) AS a, count(*) AS b FROM trades_big GROUP BY wallet"


@query("evl3_spearman", sql(RHO_SQL, "trades_big", pairs=PAIR_SQL))
def _(t):
    p = t.trades_big.groupBy("wallet").agg(F.sum("size").alias("a"), F.count("*").alias("b"))
    return wallets.rank_correlation(p, "a", "b").select(r("rho").alias("rho"), "n")


@query("evl4_kendall", sql("""SELECT round(s / sqrt(ta * tb), 9) AS tau FROM (SELECT sum(sign(x.a - y.a) * sign(x.b - y.b)) AS s,
sum(abs(sign(x.a - y.a))) AS ta, sum(abs(sign(x.b - y.b))) AS tb FROM pairs x, pairs y WHERE x.wallet < y.wallet)""", "trades_big", pairs=PAIR_SQL))
def _(t):
    p = t.trades_big.groupBy("wallet").agg(F.sum("size").alias("a"), F.count("*").alias("b"))
    return metrics.kendall_tau(p, "a", "b", block=2000).select(r("tau", 9).alias("tau"))


WALLET_SCORE_SQL = "SELECT wallet, wallet_id, round(avg(p_z), 9) AS score, CAST(wallet AS BIGINT) < 5 AS lab FROM scores JOIN wallet_dim USING (wallet) GROUP BY wallet, wallet_id"


def wallet_scores(t):
    s = t.scores.groupBy("wallet").agg(r(F.avg("p_z"), 9).alias("score")).join(features.wallet_ids(t.trades), "wallet")
    return s, s.where(F.col("wallet").cast("long") < 5).select("wallet")


@query("evl6_recall_at_k", sql("""SELECT greatest(ceil(0.1 * n), m)::BIGINT AS k, m AS n_insiders, f AS n_found, round(f / m, 9) AS recall, w AS worst_rank FROM (
SELECT count(*) AS n, count(*) FILTER (WHERE lab) AS m, count(*) FILTER (WHERE lab AND pos <= kk) AS f, max(pos) FILTER (WHERE lab) AS w FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, wallet_id) AS pos, greatest(ceil(0.1 * count(*) OVER ()), count(*) FILTER (WHERE lab) OVER ()) AS kk FROM ws))""",
    "scores", "wallet_dim", ws=WALLET_SCORE_SQL))
def _(t):
    s, ins = wallet_scores(t)
    return metrics.recall_at_k(s, ins).select("k", "n_insiders", "n_found", r("recall", 9).alias("recall"), "worst_rank")


@query("evl7_acceptance_gate", sql(f"""SELECT auc, f AS n_found, m AS n_insiders, auc >= 0.85 AND f = m AS passed FROM (
SELECT count(*) FILTER (WHERE lab) AS m, count(*) FILTER (WHERE lab AND pos <= kk) AS f FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, wallet_id) AS pos, greatest(ceil(0.1 * count(*) OVER ()), count(*) FILTER (WHERE lab) OVER ()) AS kk FROM ws)),
(SELECT round({AUC_SQL}, 9) AS auc FROM (SELECT z, rank() OVER (ORDER BY p_z) + (count(*) OVER (PARTITION BY p_z) - 1) / 2.0 AS rk FROM (
  SELECT p_z, CASE WHEN CAST(wallet AS BIGINT) < 5 THEN 1 ELSE 0 END AS z FROM scores)))""", "scores", "wallet_dim", ws=WALLET_SCORE_SQL))
def _(t):
    s, ins = wallet_scores(t)
    lab = t.scores.withColumn("z_true", (F.col("wallet").cast("long") < 5).cast("int"))
    return metrics.acceptance_gate(lab, s, ins, score="p_z").select(r("auc", 9).alias("auc"), "n_found", "n_insiders", "passed")


def traces(t):
    """Running totals per customer stand in for objective traces of restarts."""
    o = t.read("orders").groupBy(F.concat(F.lit("r"), (F.col("o_custkey") % 8).cast("string")).alias("run_id"),
                                 (F.col("o_orderkey") % 12).alias("it")).agg(F.sum("o_totalprice").alias("v"))
    return o.select("run_id", "it", (F.lit(-1e9) / (F.col("it") + 1) + F.col("v")).alias("elbo"))


TRACE_SQL = """SELECT 'r' || (o_custkey % 8) AS run_id, o_orderkey % 12 AS it, -1e9 / (o_orderkey % 12 + 1) + sum(o_totalprice) AS elbo FROM orders GROUP BY 1, 2"""
CONV_SQL = """SELECT run_id, terminal_elbo, n_iter_run, n_iter_run >= 12 AS hit_iter_cap, terminal_elbo - prev AS final_elbo_gain,
abs(terminal_elbo - prev) / greatest(abs(prev), 1) AS final_rel_elbo_change, abs(terminal_elbo - prev) / greatest(abs(prev), 1) < 0.09 AS converged
FROM (SELECT run_id, max(elbo) FILTER (WHERE k = 1) AS terminal_elbo, max(elbo) FILTER (WHERE k = 2) AS prev, count(*) AS n_iter_run FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY it DESC) AS k FROM tr) GROUP BY run_id)"""


@query("evl8_elbo_convergence", sql("""SELECT run_id, round(terminal_elbo, 2) AS terminal_elbo, n_iter_run, hit_iter_cap, round(final_elbo_gain, 2) AS final_elbo_gain,
round(final_rel_elbo_change, 9) AS final_rel_elbo_change, converged FROM cv""", tr=TRACE_SQL, cv=CONV_SQL))
def _(t):
    return metrics.elbo_convergence(traces(t), 12, 0.09).select(
        "run_id", r("terminal_elbo", 2).alias("terminal_elbo"), "n_iter_run", "hit_iter_cap", r("final_elbo_gain", 2).alias("final_elbo_gain"),
        r("final_rel_elbo_change", 9).alias("final_rel_elbo_change"), "converged")


def restart_sets(t):
    c = t.read("orders").select("o_custkey", "o_orderkey")
    return c.select(F.concat(F.lit("r"), (F.col("o_orderkey") % 8).cast("string")).alias("run_id"), F.col("o_custkey").alias("wallet")).distinct()


SETS_SQL = "SELECT DISTINCT 'r' || (o_orderkey % 8) AS run_id, o_custkey AS wallet FROM orders"
JAC_SQL = """SELECT avg(coalesce(b, 0) / (x.n + y.n - coalesce(b, 0))) AS mean_jaccard, count(*) AS n_pairs FROM (SELECT run_id, count(*) AS n FROM sets GROUP BY run_id) x
JOIN (SELECT run_id, count(*) AS n FROM sets GROUP BY run_id) y ON x.run_id < y.run_id
LEFT JOIN (SELECT p.run_id AS ra, q.run_id AS rb, count(*) AS b FROM sets p JOIN sets q ON p.wallet = q.wallet AND p.run_id < q.run_id GROUP BY 1, 2) s ON s.ra = x.run_id AND s.rb = y.run_id"""


@query("jon11_pairwise_jaccard", sql("SELECT round(mean_jaccard, 9) AS mean_jaccard, n_pairs FROM jac", sets=SETS_SQL, jac=JAC_SQL))
def _(t):
    s = restart_sets(t)
    return metrics.pairwise_jaccard(s, s).select(r("mean_jaccard", 9).alias("mean_jaccard"), "n_pairs")


@query("set3_set_sizes", sql("""SELECT p.run_id AS ra, q.run_id AS rb, count(*) AS n_shared
FROM sets p JOIN sets q ON p.wallet = q.wallet AND p.run_id < q.run_id GROUP BY 1, 2""", sets=SETS_SQL))
def _(t):
    return metrics.shared_counts(metrics.run_patterns(restart_sets(t))).withColumnRenamed("both", "n_shared")


RECORD_SQL = "SELECT cv.*, (length(run_id) + CAST(substr(run_id, 2) AS INTEGER)) / 100.0 + 0.8 AS pooled_auc FROM cv"


def records(t):
    return metrics.elbo_convergence(traces(t), 12, 0.09).withColumn(
        "pooled_auc", (F.length("run_id") + F.substring("run_id", 2, 3).cast("int")) / F.lit(100.0) + 0.8)


@query("evl9_stability", sql("""SELECT count(*) AS n_restarts, round(max(pooled_auc) - min(pooled_auc), 9) AS auc_spread, round(avg(pooled_auc), 9) AS auc_mean,
round(stddev_pop(pooled_auc), 9) AS auc_sd, round(max(terminal_elbo) - min(terminal_elbo), 2) AS elbo_spread, max(pooled_auc) - min(pooled_auc) > 0.05 AS unstable,
(SELECT round(mean_jaccard, 9) FROM jac) AS mean_jaccard FROM rec""", tr=TRACE_SQL, cv=CONV_SQL, rec=RECORD_SQL, sets=SETS_SQL, jac=JAC_SQL))
def _(t):
    s = metrics.stability(records(t), restart_sets(t))
    return s.select("n_restarts", *[r(c, d).alias(c) for c, d in (("auc_spread", 9), ("auc_mean", 9), ("auc_sd", 9), ("elbo_spread", 2), ("mean_jaccard", 9))], "unstable")


@query("evl10_convergence", sql("""SELECT count(*) AS n_restarts, count(*) FILTER (WHERE converged) AS n_converged, count(*) FILTER (WHERE hit_iter_cap) AS n_at_cap,
round(median(abs(final_elbo_gain)), 2) AS median_gain, bool_and(converged) AS converged,
max(terminal_elbo) - min(terminal_elbo) >= median(abs(final_elbo_gain)) AS selection_meaningful FROM cv""", tr=TRACE_SQL, cv=CONV_SQL))
def _(t):
    return metrics.convergence(records(t)).select("n_restarts", "n_converged", "n_at_cap", r("median_gain", 2).alias("median_gain"), "converged", "selection_meaningful")


@query("agg8_spread", """SELECT o_orderstatus, 'o_totalprice' AS metric, round(min(o_totalprice), 6) AS min, round(max(o_totalprice), 6) AS max, round(avg(o_totalprice), 4) AS mean,
round(stddev_pop(o_totalprice), 4) AS sd, round(max(o_totalprice) - min(o_totalprice), 4) AS spread FROM orders GROUP BY o_orderstatus""")
def _(t):
    s = metrics.spread(t.read("orders"), ["o_totalprice"], ["o_orderstatus"])
    return s.select("o_orderstatus", "metric", r("min").alias("min"), r("max").alias("max"), r("mean", 4).alias("mean"), r("sd", 4).alias("sd"), r("spread", 4).alias("spread"))


@query("agg9_mean_interval", sql("""SELECT g.o_orderpriority, g.n, round(g.mean, 6) AS mean, round(tq.t * g.s / sqrt(g.n), 3) AS half_width
FROM (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS s FROM orders GROUP BY 1) g JOIN tq ON tq.dof = g.n - 1""",
    **t_views("SELECT DISTINCT count(*) - 1 AS dof FROM orders GROUP BY o_orderpriority")))
def _(t):
    m = metrics.mean_interval(t.read("orders"), ["o_orderpriority"], "o_totalprice")
    return m.select("o_orderpriority", "n", r("mean").alias("mean"), r("half_width", 3).alias("half_width"))


METHOD_SQL = "SELECT CAST(o_custkey AS VARCHAR) AS label, round(min(o_totalprice), 2) AS seconds, round(max(o_totalprice), 2) AS auc FROM orders GROUP BY 1"


@query("evl11_pareto_front", sql("""SELECT label, seconds, auc,
coalesce(auc > max(auc) OVER (ORDER BY seconds, auc DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS on_front FROM m""", m=METHOD_SQL))
def _(t):
    m = t.read("orders").groupBy(F.col("o_custkey").cast("string").alias("label")).agg(r(F.min("o_totalprice"), 2).alias("seconds"), r(F.max("o_totalprice"), 2).alias("auc"))
    return metrics.pareto_front(m)


# ---- event study -------------------------------------------------------------------------------

REASON_SQL = """CASE WHEN close_ts IS NULL THEN 'no_resolution' WHEN n_trades = 0 THEN 'no_trades_before_close' WHEN n_window = 0 THEN 'empty_window'
 WHEN close_ts - 432000 - first_ts <= 0 THEN 'history_too_short' END"""
STATS_SQL = f"""SELECT *, {REASON_SQL} AS reason, close_ts - 432000 - first_ts AS max_offset FROM (
  SELECT s.market, max(close_ts) AS close_ts, count(*) FILTER (WHERE ts <= close_ts) AS n_trades,
    count(*) FILTER (WHERE ts >= close_ts - 432000 AND ts < close_ts - 86400) AS n_window,
    CAST(sum(CAST(CAST(p_z AS VARCHAR) AS DECIMAL(38,18))) FILTER (WHERE ts >= close_ts - 432000 AND ts < close_ts - 86400) AS DOUBLE) / nullif(count(p_z) FILTER (WHERE ts >= close_ts - 432000 AND ts < close_ts - 86400), 0) AS window_mean,
    max(p_z) FILTER (WHERE ts >= close_ts - 432000 AND ts < close_ts - 86400) AS window_max,
    CAST(sum(CAST(CAST(p_z AS VARCHAR) AS DECIMAL(38,18))) FILTER (WHERE ts <= close_ts) AS DOUBLE) / nullif(count(p_z) FILTER (WHERE ts <= close_ts), 0) AS baseline_mean, min(ts) FILTER (WHERE ts <= close_ts) AS first_ts
  FROM scores s LEFT JOIN markets m ON m.market = s.market GROUP BY s.market)"""


@query("evt2_window_stats", sql("""SELECT market, n_trades, n_window, round(window_mean, 9) AS window_mean, window_max, round(baseline_mean, 9) AS baseline_mean,
round(window_mean - baseline_mean, 9) AS elevation, round(window_max - baseline_mean, 9) AS max_elevation, reason FROM st""", "scores", "markets", st=STATS_SQL))
def _(t):
    s = event_study.window_stats(t.scores, t.markets)
    return s.select("market", "n_trades", "n_window", r("window_mean", 9).alias("window_mean"), "window_max", r("baseline_mean", 9).alias("baseline_mean"),
                    r("elevation", 9).alias("elevation"), r("max_elevation", 9).alias("max_elevation"), "reason")


@query("evt1_window_spec", sql("""SELECT market, close_ts - 432000 AS window_start, close_ts - 86400 AS window_end, true AS locked FROM markets WHERE close_ts IS NOT NULL""", "markets"))
def _(t):
    w = WindowSpec()
    return t.markets.where("close_ts IS NOT NULL").select("market", (F.col("close_ts") - w.before).alias("window_start"),
                                                          (F.col("close_ts") - w.embargo).alias("window_end"), F.lit(w.locked).alias("locked"))


@query("evt3_terminal_move", sql("""SELECT market, count(*) FILTER (WHERE late) AS n_terminal, round(coalesce(max(x_mean) FILTER (WHERE kd = 1)
 - coalesce(max(x_mean) FILTER (WHERE NOT late AND k2 = 1), max(x_mean) FILTER (WHERE late AND ku = 1)), 0), 9) AS terminal_move FROM (
  SELECT *, CASE WHEN late THEN row_number() OVER (PARTITION BY market, late ORDER BY ts DESC, tx_hash DESC) END AS kd,
    row_number() OVER (PARTITION BY market, late ORDER BY ts DESC, tx_hash DESC) AS k2, row_number() OVER (PARTITION BY market, late ORDER BY ts, tx_hash) AS ku
  FROM (SELECT s.*, ts >= close_ts - 86400 AS late FROM scores s JOIN markets m ON m.market = s.market WHERE ts <= close_ts)) GROUP BY market""", "scores", "markets"))
def _(t):
    return event_study.terminal_move(t.scores, t.markets).select("market", "n_terminal", r("terminal_move", 9).alias("terminal_move"))


N_NULL = 999
NULL_SQL = f"""SELECT d.market, d.draw, count(s.p_z) AS n_win, CAST(sum(CAST(CAST(s.p_z AS VARCHAR) AS DECIMAL(38,18)))  AS DOUBLE) / nullif(count(s.p_z) , 0) AS null_mean, max(s.p_z) AS null_max FROM (
  SELECT market, close_ts, draw, (draw + 0.5) / {N_NULL}.0 * max_offset AS o FROM st, (SELECT unnest(range({N_NULL})) AS draw) WHERE reason IS NULL) d
LEFT JOIN scores s ON s.market = d.market AND s.ts >= close_ts - 432000 - o AND s.ts < close_ts - 86400 - o GROUP BY d.market, d.draw"""


@query("jon7_shifted_windows", sql("SELECT market, draw, n_win, round(null_mean, 9) AS null_mean, null_max FROM nul", "scores", "markets", st=STATS_SQL, nul=NULL_SQL))
def _(t):
    st = event_study.window_stats(t.scores, t.markets)
    w = event_study.shifted_windows(t.scores, event_study.null_offsets(st, N_NULL, scheme="stratified"))
    return w.select("market", "draw", "n_win", r("null_mean", 9).alias("null_mean"), "null_max")


P_SQL = """SELECT st.market, st.reason, (1 + count(*) FILTER (WHERE null_mean >= window_mean)) / (1 + count(null_mean)) AS p_value,
(1 + count(*) FILTER (WHERE null_max >= window_max)) / (1 + count(null_mean)) AS p_value_max, avg(null_mean) - max(baseline_mean) AS null_mean,
stddev_samp(null_mean) AS null_sd, (max(window_mean) - avg(null_mean)) / stddev_samp(null_mean) AS z_score, count(null_mean) AS n_null
FROM st JOIN nul ON nul.market = st.market GROUP BY st.market, st.reason"""


@query("evt4_market_results", sql("""SELECT st.market, st.reason, p.n_null, round(p.p_value, 9) AS p_value, round(p.p_value_max, 9) AS p_value_max, round(p.null_mean, 9) AS null_mean,
round(p.null_sd, 9) AS null_sd, round(p.z_score, 6) AS z_score FROM st LEFT JOIN p ON p.market = st.market""", "scores", "markets", st=STATS_SQL, nul=NULL_SQL, p=P_SQL))
def _(t):
    x = event_study.market_results(t.scores, t.markets, n=N_NULL, scheme="stratified")
    return x.select("market", "reason", "n_null", *[r(c, d).alias(c) for c, d in (("p_value", 9), ("p_value_max", 9), ("null_mean", 9), ("null_sd", 9), ("z_score", 6))])


@query("evt4_random_null")
def _(t):
    return event_study.market_results(t.scores, t.markets, seed=7)


CROSS_SQL = """SELECT x.market, draw, window_mean, CAST(sum(CAST(CAST(p.p_z AS VARCHAR) AS DECIMAL(38,18)))  AS DOUBLE) / nullif(count(p.p_z) , 0) AS m FROM (
  SELECT market, draw, window_mean, CASE WHEN spot >= start THEN spot + own ELSE spot END AS pos FROM (
    SELECT *, CAST(floor((turn - floor(turn)) * (total - own)) AS BIGINT) AS spot FROM (
      SELECT *, (draw * n_window + k) * 0.6180339887498949e0 AS turn FROM (
        SELECT st.market, st.window_mean, st.n_window, b.start, b.own, (SELECT count(*) FROM pool) AS total, d.draw, unnest(range(1, st.n_window + 1)) AS k
        FROM st JOIN (SELECT market, min(pos) AS start, count(*) AS own FROM pool GROUP BY market) b ON b.market = st.market,
          (SELECT unnest(range(199)) AS draw) d WHERE st.reason IS NULL) WHERE total > own))) x JOIN pool p USING (pos) GROUP BY x.market, draw, window_mean"""


@query("evt6_cross_market", sql("""SELECT st.market, round((1 + count(*) FILTER (WHERE m >= c.window_mean)) / (1 + count(m)), 9) AS p_value_cross
FROM st LEFT JOIN cr c ON c.market = st.market WHERE st.reason IS NULL GROUP BY st.market""", "scores", "markets", st=STATS_SQL,
    pool="SELECT s.market, s.tx_hash, s.p_z, row_number() OVER (ORDER BY s.market, s.tx_hash) - 1 AS pos FROM scores s JOIN st ON st.market = s.market AND st.reason IS NULL", cr=CROSS_SQL))
def _(t):
    x = event_study.cross_market_p(t.scores, event_study.window_stats(t.scores, t.markets), scheme="stratified")
    return x.withColumn("p_value_cross", r("p_value_cross", 9))


@query("evt7_exclusions", sql("SELECT reason, count(*) AS n FROM st WHERE reason IS NOT NULL GROUP BY reason", "scores", "markets", st=STATS_SQL))
def _(t):
    return event_study.exclusion_counts(event_study.window_stats(t.scores, t.markets))


@query("evt8_study_summary", sql("""SELECT (SELECT count(*) FROM st) AS n_markets, n AS n_analysed, n_significant, round(2 * h, 9) AS fisher_stat,
round(exp(-h) * list_sum(list_transform(range(n), lambda j: power(h, j) / factorial(CAST(j AS INTEGER)))), 9) AS fisher_p
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE p_value < 0.05) AS n_significant, -sum(ln(p_value)) AS h FROM p)""",
    "scores", "markets", st=STATS_SQL, nul=NULL_SQL, p=P_SQL))
def _(t):
    x = event_study.market_results(t.scores, t.markets, n=N_NULL, scheme="stratified")
    return event_study.study_summary(x).select("n_markets", "n_analysed", "n_significant", r("fisher_stat", 9).alias("fisher_stat"), r("fisher_p", 9).alias("fisher_p"))


@query("evt9_rejection_rates", """SELECT o_orderpriority AS arm, round(avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END), 9) AS rejection_rate, count(*) AS n
FROM (SELECT o_orderpriority, (o_orderkey * 7919 % 1000 + 1) / 1000.0 AS p FROM orders) GROUP BY 1""")
def _(t):
    p = t.read("orders").select(F.col("o_orderpriority").alias("arm"), ((F.col("o_orderkey") * 7919 % 1000 + 1) / F.lit(1000.0)).alias("p_value"))
    return event_study.rejection_rates(p, ["arm"]).withColumn("rejection_rate", r("rejection_rate", 9))


@query("jon8_last_before_embargo", sql("""SELECT market, tx_hash FROM (SELECT s.market, tx_hash, row_number() OVER (PARTITION BY s.market ORDER BY ts DESC, tx_hash DESC) AS k
FROM scores s JOIN markets m ON m.market = s.market WHERE ts < close_ts - 86400) WHERE k = 1""", "scores", "markets"))
def _(t):
    j = t.scores.join(t.markets.select("market", "close_ts"), "market").where(F.col("ts") < F.col("close_ts") - DAY)
    return clean.keep_first(j, "market", [F.desc("ts"), F.desc("tx_hash")]).select("market", "tx_hash")


# ---- backtest ------------------------------------------------------------------------------------

LABEL_SQL = """SELECT market, close_ts, label_start, outcome, CASE WHEN close_ts IS NULL THEN 'no_resolution' WHEN outcome IS NULL THEN 'no_outcome'
 WHEN label_start IS NULL THEN 'no_trades_before_close' END AS reason FROM (
  SELECT s.market, max(close_ts) AS close_ts, max(outcome) AS outcome, min(ts) FILTER (WHERE ts <= close_ts) AS label_start
  FROM {scores} s LEFT JOIN {markets} m ON m.market = s.market GROUP BY s.market)"""
POS_SQL = """SELECT market, threshold, ts AS entry_ts, p_z, price, side, cost, payout, payout - cost AS ret FROM (
  SELECT *, CASE WHEN side = 'yes' THEN outcome ELSE 1 - outcome END AS payout, CASE WHEN side = 'yes' THEN price ELSE 1 - price END + 0.01 + 0.07 * price * (1 - price) AS cost FROM (
    SELECT *, CASE WHEN price >= 0.5 THEN 'yes' ELSE 'no' END AS side FROM (
      SELECT s.market, g.threshold, s.ts, s.p_z, CASE WHEN x_mean >= 0 THEN 1 / (1 + exp(-x_mean)) ELSE exp(x_mean) / (1 + exp(x_mean)) END AS price, l.outcome,
        row_number() OVER (PARTITION BY s.market, g.threshold ORDER BY s.ts, s.tx_hash) AS k
      FROM scores_month s JOIN lab l ON l.market = s.market AND l.reason IS NULL AND s.ts <= l.close_ts
      JOIN (SELECT CAST(round(0.5 + 0.05 * unnest(range(9)), 2) AS DOUBLE) AS threshold) g ON s.p_z >= g.threshold) WHERE k = 1)) WHERE cost < 1"""
BLOCK_SQL = "SELECT *, ntile(5) OVER (ORDER BY close_ts, market) - 1 AS block FROM lab WHERE reason IS NULL"
MEMBER_SQL = """SELECT f.fold, b.market, CASE WHEN b.block = f.fold + 1 THEN 'test' WHEN b.close_ts <= f.test_start - 86400 THEN 'train' ELSE 'purged' END AS role, f.test_start, f.test_end
FROM bl b JOIN (SELECT block - 1 AS fold, min(label_start) AS test_start, max(close_ts) AS test_end FROM bl WHERE block >= 1 GROUP BY block) f ON b.block <= f.fold + 1"""
SHARPE = "CASE WHEN count(ret) >= 2 AND stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) END"
CHOSEN_SQL = f"""SELECT fold, threshold, train_sharpe FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train_sharpe DESC, threshold) AS k FROM (
  SELECT fold, threshold, {SHARPE} AS train_sharpe FROM pos JOIN mem ON mem.market = pos.market AND role = 'train' GROUP BY fold, threshold) WHERE train_sharpe IS NOT NULL) WHERE k = 1"""
TRIAL_SQL = f"""SELECT g.threshold, count(ret) AS n_positions, avg(ret) AS mean_return, coalesce(sum(ret), 0) AS total_return, avg(CASE WHEN payout > 0 THEN 1.0 WHEN payout IS NOT NULL THEN 0.0 END) AS hit_rate,
{SHARPE} AS sharpe FROM (SELECT CAST(round(0.5 + 0.05 * unnest(range(9)), 2) AS DOUBLE) AS threshold) g
LEFT JOIN (SELECT pos.* FROM pos JOIN mem ON mem.market = pos.market AND role = 'test') p ON p.threshold = g.threshold GROUP BY g.threshold"""
BT = dict(lab=LABEL_SQL.format(scores="scores_month", markets="markets_month"), pos=POS_SQL, bl=BLOCK_SQL, mem=MEMBER_SQL, ch=CHOSEN_SQL, tri=TRIAL_SQL,
          oos="SELECT mem.fold, pos.* FROM pos JOIN mem ON mem.market = pos.market AND role = 'test' JOIN ch ON ch.fold = mem.fold AND ch.threshold = pos.threshold")
BT_VIEWS = ("scores_month", "markets_month")


def month_labels(t):
    return backtest.market_labels(t.scores_month, t.markets_month, t.markets_month)


def month_positions(t):
    return backtest.positions(backtest.panels(t.scores_month, month_labels(t)))


def month_members(t):
    return backtest.fold_members(backtest.market_blocks(month_labels(t)))


@query("jon1_market_labels", sql("SELECT market, close_ts, label_start, outcome, reason FROM lab", "scores", "markets", lab=LABEL_SQL.format(scores="scores", markets="markets")))
def _(t):
    return backtest.market_labels(t.scores, t.markets, t.markets).select("market", "close_ts", "label_start", "outcome", "reason")


@query("agg10_exclusion_counts", sql("SELECT reason, count(*) AS n FROM lab WHERE reason IS NOT NULL GROUP BY reason", "scores", "markets", lab=LABEL_SQL.format(scores="scores", markets="markets")))
def _(t):
    return event_study.exclusion_counts(backtest.market_labels(t.scores, t.markets, t.markets))


@query("bkt1_panels", sql("""SELECT l.market, count(*) AS n, round(sum(1 / (1 + exp(-x_mean))), 6) AS price_sum, max(l.outcome) AS outcome FROM scores s JOIN lab l ON l.market = s.market
WHERE l.reason IS NULL AND s.ts <= l.close_ts GROUP BY l.market""", "scores", "markets", lab=LABEL_SQL.format(scores="scores", markets="markets")))
def _(t):
    p = backtest.panels(t.scores, backtest.market_labels(t.scores, t.markets, t.markets))
    return p.groupBy("market").agg(F.count("*").alias("n"), r(F.sum("price")).alias("price_sum"), F.max("outcome").alias("outcome"))


@query("bkt2_positions", sql("SELECT market, threshold, entry_ts, p_z, round(price, 9) AS price, side, round(cost, 9) AS cost, payout, round(ret, 9) AS ret FROM pos", *BT_VIEWS, **BT))
def _(t):
    return month_positions(t).select("market", "threshold", "entry_ts", "p_z", r("price", 9).alias("price"), "side", r("cost", 9).alias("cost"), "payout", r("ret", 9).alias("ret"))


@query("jon9_threshold_grid", sql("SELECT threshold, count(*) AS n_markets, round(sum(ret), 6) AS total FROM pos GROUP BY threshold", *BT_VIEWS, **BT))
def _(t):
    return month_positions(t).groupBy("threshold").agg(F.count("*").alias("n_markets"), r(F.sum("ret")).alias("total"))


@query("bkt3_walk_forward", sql("SELECT fold, market, role FROM mem", *BT_VIEWS, **BT))
def _(t):
    return month_members(t).select("fold", "market", "role")


@query("bkt3_folds", sql("""SELECT fold, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'test') AS n_test, count(*) FILTER (WHERE role = 'purged') AS n_purged,
max(test_start) AS test_start, max(test_end) AS test_end FROM mem GROUP BY fold""", *BT_VIEWS, **BT))
def _(t):
    return backtest.folds(month_members(t))


MOM_SQL = """SELECT threshold, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, var_samp(ret) AS var, skewness(ret) AS skewness,
CASE WHEN count(ret) > 3 THEN kurtosis(ret) + 3 END AS kurtosis, CASE WHEN count(ret) >= 2 AND stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) END AS sharpe FROM pos GROUP BY threshold"""


@query("agg7_moments", sql("SELECT threshold, n, round(mean, 9) AS mean, round(sd, 9) AS sd, round(var, 9) AS var, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis FROM mo", *BT_VIEWS, **BT, mo=MOM_SQL))
def _(t):
    m = backtest.moments(month_positions(t), "ret", ["threshold"])
    return m.select("threshold", "n", r("mean", 9).alias("mean"), r("sd", 9).alias("sd"), r("var", 9).alias("var"), r("skewness").alias("skewness"), r("kurtosis").alias("kurtosis"))


@query("bkt4_sharpe", sql("SELECT threshold, round(sharpe, 9) AS sharpe FROM mo", *BT_VIEWS, **BT, mo=MOM_SQL))
def _(t):
    return month_positions(t).groupBy("threshold").agg(r(backtest.sharpe(), 9).alias("sharpe"))


PSR_Z = "((sharpe - {b}) * sqrt(n - 1) / sqrt(CASE WHEN 1 - skewness * sharpe + 0.25 * (kurtosis - 1) * sharpe * sharpe > 0 THEN 1 - skewness * sharpe + 0.25 * (kurtosis - 1) * sharpe * sharpe END))"


@query("bkt5_probabilistic_sharpe", sql(f"SELECT threshold, round({sql_cdf('z')}, 9) AS psr FROM (SELECT threshold, {PSR_Z.format(b='0.05')} AS z FROM mo)", *BT_VIEWS, **BT, mo=MOM_SQL))
def _(t):
    m = backtest.moments(month_positions(t), "ret", ["threshold"])
    return backtest.probabilistic_sharpe(m, 0.05).select("threshold", r("psr", 9).alias("psr"))


EMS = f"sqrt(v) * (0.4227843350984671 * {sql_ppf('(1 - 1.0 / n)')} + 0.5772156649015329 * {sql_ppf('(1 - 1.0 / (n * exp(1)))')})"


@query("bkt6_expected_max_sharpe", f"SELECT o_orderkey, round(CASE WHEN n < 2 OR v = 0 THEN 0 ELSE {EMS} END, 9) AS sr0 FROM (SELECT o_orderkey, CAST(o_orderkey % 40 + 2 AS DOUBLE) AS n, (o_orderkey % 7) / 10.0 AS v FROM orders)")
def _(t):
    o = t.read("orders").select("o_orderkey", (F.col("o_orderkey") % 40 + 2).alias("n"), (F.col("o_orderkey") % 7 / F.lit(10.0)).alias("v"))
    return o.select("o_orderkey", r(backtest.expected_max_sharpe("v", "n"), 9).alias("sr0"))


@query("bkt8_select_thresholds", sql("SELECT fold, threshold, round(train_sharpe, 9) AS train_sharpe FROM ch", *BT_VIEWS, **BT))
def _(t):
    return backtest.select_thresholds(month_positions(t), month_members(t)).withColumn("train_sharpe", r("train_sharpe", 9))


@query("bkt9_trials", sql("SELECT threshold, n_positions, round(mean_return, 9) AS mean_return, round(total_return, 6) AS total_return, round(hit_rate, 9) AS hit_rate, round(sharpe, 9) AS sharpe FROM tri", *BT_VIEWS, **BT))
def _(t):
    x = backtest.trial_table(month_positions(t), month_members(t))
    return x.select("threshold", "n_positions", r("mean_return", 9).alias("mean_return"), r("total_return").alias("total_return"), r("hit_rate", 9).alias("hit_rate"), r("sharpe", 9).alias("sharpe"))


@query("bkt7_deflated_sharpe", sql(f"""SELECT round(sharpe, 9) AS sharpe, n AS n_returns, round(v, 9) AS trial_variance, round(sr0, 9) AS sr_benchmark, round({sql_cdf('z0')}, 6) AS psr_zero, round({sql_cdf('z1')}, 6) AS dsr FROM (
  SELECT *, {PSR_Z.format(b='0')} AS z0, {PSR_Z.format(b='sr0')} AS z1 FROM (SELECT *, {EMS.replace('n)', '9.0)').replace('(n *', '(9.0 *')} AS sr0 FROM (
    SELECT count(ret) AS n, avg(ret) / stddev_samp(ret) AS sharpe, skewness(ret) AS skewness, kurtosis(ret) + 3 AS kurtosis, (SELECT var_samp(sharpe) FROM tri) AS v FROM oos)))""", *BT_VIEWS, **BT))
def _(t):
    d = backtest.run_backtest(t.scores_month, t.markets_month, t.markets_month)["deflated"]
    return d.select(r("sharpe", 9).alias("sharpe"), "n_returns", r("trial_variance", 9).alias("trial_variance"), r("sr_benchmark", 9).alias("sr_benchmark"), r("psr_zero").alias("psr_zero"), r("dsr").alias("dsr"))


@query("bkt10_fold_report", sql("""SELECT f.fold, n_train, n_test, n_purged, ch.threshold, round(ch.train_sharpe, 9) AS train_sharpe, coalesce(o.n, 0) AS n_positions, round(o.m, 9) AS mean_return, round(coalesce(o.s, 0), 6) AS total_return
FROM (SELECT fold, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'test') AS n_test, count(*) FILTER (WHERE role = 'purged') AS n_purged FROM mem GROUP BY fold) f
LEFT JOIN ch ON ch.fold = f.fold LEFT JOIN (SELECT fold, count(*) AS n, avg(ret) AS m, sum(ret) AS s FROM oos GROUP BY fold) o ON o.fold = f.fold""", *BT_VIEWS, **BT))
def _(t):
    x = backtest.run_backtest(t.scores_month, t.markets_month, t.markets_month)["folds"]
    return x.select("fold", "n_train", "n_test", "n_purged", "threshold", r("train_sharpe", 9).alias("train_sharpe"), "n_positions", r("mean_return", 9).alias("mean_return"), r("total_return").alias("total_return"))


# ---- case study ------------------------------------------------------------------------------------

CS_A, CS_B, CS_PAT = 1704672000.0, 1705708800.0, "14[0-9]"
CASE_SQL = f"""SELECT *, max_p_z - min_p_z < 1e-6 AS flat, row_number() OVER (ORDER BY mean_p_z DESC, wallet) AS rank FROM (
  SELECT wallet, count(*) FILTER (WHERE ts BETWEEN {CS_A} AND {CS_B}) AS n_window, count(*) AS n_total, avg(p_z) FILTER (WHERE ts BETWEEN {CS_A} AND {CS_B}) AS mean_p_z,
    max(p_z) FILTER (WHERE ts BETWEEN {CS_A} AND {CS_B}) AS max_p_z, min(p_z) FILTER (WHERE ts BETWEEN {CS_A} AND {CS_B}) AS min_p_z,
    regexp_full_match(wallet, '{CS_PAT}') AS anchored, CASE WHEN count(*) < 20 THEN 'prior-dominated' WHEN count(*) < 100 THEN 'weak' ELSE 'meaningful' END AS sufficiency
  FROM scores GROUP BY wallet) WHERE n_window > 0"""


def case_wallets(t, pattern=CS_PAT):
    return case_study.wallet_table(t.scores, CS_A, CS_B, pattern=pattern)


@query("cas1_wallet_table", sql("""SELECT wallet, n_window, n_total, round(mean_p_z, 9) AS mean_p_z, max_p_z, min_p_z, round(mean_p_z - (SELECT avg(p_z) FROM scores), 9) AS elevation,
anchored, sufficiency, flat FROM cs""", "scores", cs=CASE_SQL))
def _(t):
    return case_wallets(t).select("wallet", "n_window", "n_total", r("mean_p_z", 9).alias("mean_p_z"), "max_p_z", "min_p_z", r("elevation", 9).alias("elevation"), "anchored", "sufficiency", "flat")


@query("cas2_sufficiency_counts", sql("""SELECT d.s AS sufficiency, count(cs.wallet) AS n FROM (VALUES ('prior-dominated'), ('weak'), ('meaningful')) d(s)
LEFT JOIN cs ON cs.sufficiency = d.s GROUP BY d.s""", "scores", cs=CASE_SQL))
def _(t):
    return case_study.sufficiency_counts(case_wallets(t))


LISTED = ["click", "error", "nothing"]


@query("cas3_cluster_summary", sql(f"""SELECT count(*) AS n_trades, count(*) FILTER (WHERE ts BETWEEN {CS_A} AND {CS_B}) AS n_trades_window, round(avg(p_z), 9) AS baseline_mean,
round(avg(p_z) FILTER (WHERE ts BETWEEN {CS_A} AND {CS_B}), 9) AS window_mean, count(DISTINCT wallet) AS n_wallets, count(DISTINCT wallet) FILTER (WHERE regexp_full_match(wallet, '{CS_PAT}')) AS n_anchored,
1 AS n_without_trades, count(DISTINCT market) FILTER (WHERE market NOT IN ('click', 'error')) AS n_off_list FROM scores""", "scores"))
def _(t):
    listed = t.spark.createDataFrame([(m,) for m in LISTED], "market STRING")
    s = case_study.cluster_summary(t.scores, listed, CS_A, CS_B, pattern=CS_PAT)
    return s.withColumn("baseline_mean", r("baseline_mean", 9)).withColumn("window_mean", r("window_mean", 9))


@query("jon10_market_differences", sql("""SELECT market, 'off_list' AS kind FROM (SELECT DISTINCT market FROM scores EXCEPT (SELECT 'click' UNION ALL SELECT 'error'))
UNION ALL SELECT 'nothing', 'without_trades'""", "scores"))
def _(t):
    return case_study.missing_markets(t.spark.createDataFrame([(m,) for m in LISTED], "market STRING"), t.scores)


@query("cas4_verdict", sql("""SELECT count(*) FILTER (WHERE anchored) AS n_in_window, max(rank) FILTER (WHERE anchored) AS anchor_rank,
CASE WHEN bool_or(flat) FILTER (WHERE anchored) THEN 'untested' WHEN max(sufficiency) FILTER (WHERE anchored) = 'meaningful' THEN 'timing_and_rank' ELSE 'timing_only' END AS verdict FROM (
  SELECT * REPLACE (wallet = '7' AS anchored) FROM cs)""", "scores", cs=CASE_SQL))
def _(t):
    w = case_study.wallet_table(t.scores, CS_A, CS_B, address="7")
    listed = t.spark.createDataFrame([(m,) for m in LISTED], "market STRING")
    s = case_study.cluster_summary(t.scores, listed, CS_A, CS_B, address="7")
    return case_study.verdict(s, w, True).select("n_in_window", "anchor_rank", "verdict")


@query("cas5_timeline", sql("""SELECT e.event_ts, e.label, count(s.ts) AS n_trades, round(avg(s.p_z), 9) AS mean_p_z FROM (
  SELECT DISTINCT CAST(CAST(ts AS BIGINT) // 86400 * 86400 + 3600 AS DOUBLE) AS event_ts, 'day' AS label FROM scores) e
LEFT JOIN scores s ON s.ts BETWEEN e.event_ts - 5000 AND e.event_ts + 5000 GROUP BY e.event_ts, e.label""", "scores"))
def _(t):
    ev = t.scores.select((F.floor(F.col("ts") / 86400) * 86400.0 + 3600.0).alias("event_ts"), F.lit("day").alias("label"))
    return case_study.timeline_overlay(ev, t.scores, 5000.0).select("event_ts", "label", "n_trades", r("mean_p_z", 9).alias("mean_p_z"))


@query("top3_top_trades", sql(f"""SELECT ts, market, wallet, tx_hash, p_z, regexp_full_match(wallet, '{CS_PAT}') AS anchored FROM scores WHERE ts BETWEEN {CS_A} AND {CS_B}
ORDER BY p_z DESC, ts, tx_hash LIMIT 25""", "scores"))
def _(t):
    return case_study.top_trades(t.scores, CS_A, CS_B, 25, pattern=CS_PAT).drop("iso")


@query("top4_reported", sql("SELECT wallet, rank, anchored FROM cs WHERE rank <= 10 OR anchored", "scores", cs=CASE_SQL))
def _(t):
    return case_study.reported(case_wallets(t), 10).select("wallet", "rank", "anchored")


@query("top5_rank_of", sql("SELECT wallet, rank FROM cs WHERE wallet = '42'", "scores", cs=CASE_SQL))
def _(t):
    return case_study.rank_of(case_wallets(t), "42")


@query("src15_cluster_scores", sql("SELECT market, wallet, count(*) AS n, round(avg(p_z), 9) AS m FROM scores WHERE market IN ('click', 'error') GROUP BY market, wallet", "scores"))
def _(t):
    listed = t.spark.createDataFrame([(m,) for m in LISTED], "market STRING")
    path = files.scratch_path(t.spark, "cluster-scores")
    files.write_scores(t.scores, path, "replay", "events")
    return files.load_cluster_scores(t.spark, path, listed).groupBy("market", "wallet").agg(F.count("*").alias("n"), r(F.avg("p_z"), 9).alias("m"))


# ---- calibration --------------------------------------------------------------------------------

HIST_SQL = """SELECT c.component, b.bin, count(x.rank) AS n, c.total * (b.hi - b.lo) / 100.0 AS expected FROM (SELECT component, count(*) AS total FROM replicate_ranks GROUP BY component) c
CROSS JOIN (SELECT j AS bin, CAST(ceil(j * 100 / 7.0) AS INTEGER) AS lo, CAST(ceil((j + 1) * 100 / 7.0) AS INTEGER) AS hi FROM (SELECT unnest(range(7)) AS j)) b
LEFT JOIN replicate_ranks x ON x.component = c.component AND x.rank >= b.lo AND x.rank < b.hi GROUP BY c.component, b.bin, c.total, b.hi, b.lo"""


@query("cal1_rank_histogram", sql("SELECT component, bin, n, round(expected, 6) AS expected FROM h", "replicate_ranks", h=HIST_SQL))
def _(t):
    return calibration.rank_histogram(t.replicate_ranks, 99, 7).select("component", "bin", "n", r("expected").alias("expected"))


@query("cal2_default_bins", sql("SELECT component, CAST(greatest(2, least(20, count(*) // 5, 100)) AS INTEGER) AS bins FROM replicate_ranks GROUP BY component", "replicate_ranks"))
def _(t):
    return t.replicate_ranks.groupBy("component").agg(F.count("*").alias("n")).select("component", calibration.default_bins(F.col("n"), 99).alias("bins"))


@query("cal3_chi_square", sql("SELECT component, round(sum((n - expected) * (n - expected) / expected), 6) AS chi2_stat, count(*) - 1 AS dof FROM h GROUP BY component", "replicate_ranks", h=HIST_SQL))
def _(t):
    return calibration.chi_square(calibration.rank_histogram(t.replicate_ranks, 99, 7)).withColumn("chi2_stat", r("chi2_stat"))


PIT_SQL = """SELECT component, n, ks AS ks_stat, mp AS mean_pit, vp AS var_pit, (mp - 0.5) / sqrt(1 / (12.0 * n)) AS bias_z, (vp - 1 / 12.0) / sqrt(1 / (180.0 * n)) AS dispersion_z,
sqrt(ln(2 / 0.0125) / (2.0 * n)) AS half FROM (SELECT component, count(*) AS n, avg(pit) AS mp, var_pop(pit) AS vp, max(greatest(k / m - pit, pit - (k - 1) / m)) AS ks FROM (
  SELECT component, (rank + 0.5) / 100.0 AS pit, row_number() OVER (PARTITION BY component ORDER BY rank) AS k, count(*) OVER (PARTITION BY component) AS m FROM replicate_ranks) GROUP BY component)"""


@query("cal4_pit_statistics", sql("""SELECT component, n, round(ks_stat, 9) AS ks_stat, round(mean_pit, 9) AS mean_pit, round(var_pit, 9) AS var_pit, round(half, 9) AS band_half_width,
round(bias_z, 6) AS bias_z, round(dispersion_z, 6) AS dispersion_z, ks_stat > half AS band_violation FROM pit""", "replicate_ranks", pit=PIT_SQL))
def _(t):
    p = calibration.pit_statistics(t.replicate_ranks, 99, 0.0125)
    return p.select("component", "n", *[r(c, d).alias(c) for c, d in (("ks_stat", 9), ("mean_pit", 9), ("var_pit", 9), ("band_half_width", 9), ("bias_z", 6), ("dispersion_z", 6))], "band_violation")


@query("cal5_bin_bands", sql(f"""SELECT component, bin, n, round(expected, 6) AS expected, CAST({binom_sql('0.0125e0 / 7 / 2', 'total', 'prob')} AS DOUBLE) AS band_lo,
CAST({binom_sql('(1 - 0.0125e0 / 7 / 2)', 'total', 'prob')} AS DOUBLE) AS band_hi FROM (SELECT *, CAST(round(sum(n) OVER (PARTITION BY component)) AS BIGINT) AS total,
  expected / sum(n) OVER (PARTITION BY component) AS prob FROM h)""", "replicate_ranks", h=HIST_SQL))
def _(t):
    b = calibration.bin_bands(calibration.rank_histogram(t.replicate_ranks, 99, 7), 7, 0.0125)
    return b.select("component", "bin", "n", r("expected").alias("expected"), "band_lo", "band_hi")


@query("cal6_shape_hint", """SELECT o_orderkey, CASE WHEN abs(b) < 2.5 AND abs(d) < 2.5 THEN 'none' WHEN abs(d) >= abs(b) AND d > 0 THEN 'too narrow' WHEN abs(d) >= abs(b) THEN 'too wide'
WHEN b > 0 THEN 'biased low' ELSE 'biased high' END AS shape FROM (SELECT o_orderkey, (o_orderkey % 21 - 10) / 2.0 AS b, (o_orderkey % 19 - 9) / 2.0 AS d FROM orders)""")
def _(t):
    k = F.col("o_orderkey")
    return t.read("orders").select("o_orderkey", lb.shape_hint((k % 21 - 10) / F.lit(2.0), (k % 19 - 9) / F.lit(2.0), 2.5).alias("shape"))


@query("cal7_holm", """SELECT component, round(max(least(1.0, (m - i) * p)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 9) AS p_value_adj FROM (
  SELECT CAST(o_orderkey AS VARCHAR) AS component, (o_orderkey * 7919 % 100003 + 1) / 1e9 AS p, count(*) OVER () AS m,
  row_number() OVER (ORDER BY (o_orderkey * 7919 % 100003 + 1) / 1e9, CAST(o_orderkey AS VARCHAR)) - 1 AS i FROM orders)""")
def _(t):
    p = t.read("orders").select(F.col("o_orderkey").cast("string").alias("component"), ((F.col("o_orderkey") * 7919 % 100003 + 1) / F.lit(1e9)).alias("p_value"))
    return calibration.holm(p).select("component", r("p_value_adj", 9).alias("p_value_adj"))


def chi2_tail_sql(x: str, dof: str, steps: int = 4000) -> str:
    """Upper chi-square tail by Simpson's rule on the density up to x."""
    return f"""(SELECT greatest(0, 1 - sum(CASE WHEN j = 0 OR j = {steps} THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * CASE WHEN j = 0 THEN 0
      ELSE exp(({dof} / 2.0 - 1) * ln({x} * j / {steps}) - {x} * j / {steps} / 2 - {dof} / 2.0 * ln(2) - lgamma({dof} / 2.0)) END) * {x} / {steps} / 3)
      FROM (SELECT unnest(range({steps} + 1)) AS j))"""


UNIFORM_SQL = f"""SELECT component, chi2_stat, dof, p_value, max(least(1.0, (m - i) * p_value)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS p_value_adj FROM (
  SELECT *, row_number() OVER (ORDER BY p_value, component) - 1 AS i, count(*) OVER () AS m FROM (SELECT *, {chi2_tail_sql('chi2_stat', 'dof')} AS p_value FROM (
    SELECT component, sum((n - expected) * (n - expected) / expected) AS chi2_stat, count(*) - 1 AS dof FROM h20 GROUP BY component)))"""
HIST20_SQL = HIST_SQL.replace("j * 100 / 7.0", "j * 100 / 20.0").replace("(j + 1) * 100 / 7.0", "(j + 1) * 100 / 20.0").replace("range(7)", "range(20)")


@query("cal8_rank_uniformity", sql(f"""SELECT u.component, round(chi2_stat, 6) AS chi2_stat, dof, round(p_value, 6) AS p_value, round(p_value_adj, 6) AS p_value_adj, p_value_adj < 0.05 AS rejected,
round(ks_stat, 9) AS ks_stat, ks_stat > sqrt(ln(2 / (0.05 / 3)) / (2.0 * n)) AS band_violation FROM u JOIN pit USING (component)""",
    "replicate_ranks", h20=HIST20_SQL, u=UNIFORM_SQL, pit=PIT_SQL))
def _(t):
    u = calibration.rank_uniformity(t.replicate_ranks, 99)
    return u.select("component", r("chi2_stat").alias("chi2_stat"), "dof", r("p_value").alias("p_value"), r("p_value_adj").alias("p_value_adj"), "rejected",
                    r("ks_stat", 9).alias("ks_stat"), "band_violation")


def wilson_sql(h: str, n: str, z: str) -> str:
    return (f"greatest(0, ({h} / {n} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n}) - {z} / (1 + {z} * {z} / {n}) * sqrt({h} / {n} * (1 - {h} / {n}) / {n} + {z} * {z} / (4 * {n} * {n})))",
            f"least(1, ({h} / {n} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n}) + {z} / (1 + {z} * {z} / {n}) * sqrt({h} / {n} * (1 - {h} / {n}) / {n} + {z} * {z} / (4 * {n} * {n})))")


W_LO, W_HI = wilson_sql("h", "n", "z")


@query("cal9_wilson", sql(f"""SELECT priority, round({W_LO}, 9) AS lo, round({W_HI}, 9) AS hi FROM (SELECT priority, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) AS h,
{sql_ppf('0.975e0')} AS z FROM replicate_ranks GROUP BY priority)""", "replicate_ranks"))
def _(t):
    g = t.replicate_ranks.groupBy("priority").agg(F.count("*").alias("n"), F.count(F.when(F.col("hit"), 1)).alias("h"))
    lo, hi = mx.wilson("h", "n")
    return g.select("priority", r(lo, 9).alias("lo"), r(hi, 9).alias("hi"))


@query("cal10_coverage", sql(f"""SELECT component, CAST(n AS BIGINT) AS n, CAST(h AS BIGINT) AS n_hits, round(h / n, 9) AS rate, round({W_LO}, 9) AS ci_lo, round({W_HI}, 9) AS ci_hi,
CASE WHEN NOT ({W_LO} <= 0.9 AND {W_HI} >= 0.9) THEN 'fail' WHEN {W_LO} >= 0.85 AND {W_HI} <= 0.95 THEN 'pass (conclusive)' ELSE 'pass (underpowered)' END AS verdict FROM (
  SELECT component, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) AS h, -{sql_ppf('(0.05 / 3 / 2)')} AS z FROM replicate_ranks GROUP BY component)""", "replicate_ranks"))
def _(t):
    c = calibration.coverage(t.replicate_ranks)
    return c.select("component", "n", "n_hits", r("rate", 9).alias("rate"), r("ci_lo", 9).alias("ci_lo"), r("ci_hi", 9).alias("ci_hi"), "verdict")


@query("cal11_cluster_rates", sql("""SELECT count(*) AS n_replicates, sum(n) AS n_intervals, round(avg(rt), 9) AS mean_rate, round(stddev_samp(rt), 9) AS between_sd FROM (
  SELECT seed % 200 AS c, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS rt, count(*) AS n FROM replicate_ranks GROUP BY 1)""", "replicate_ranks"))
def _(t):
    x = calibration.cluster_rates(t.replicate_ranks.withColumn("seed", F.col("seed") % 200))
    return x.withColumn("mean_rate", r("mean_rate", 9)).withColumn("between_sd", r("between_sd", 9))


def replicate_store(t):
    """Replicate rows with nested flags built from the orders."""
    k = F.col("seed")
    flags = F.struct((k % 7 != 0).alias("vem_converged"), F.when(k % 5 == 0, k % 10 == 0).alias("laplace_fallback"),
                     (k % 11 == 0).alias("failed"), F.when(k % 22 == 0, "singular").alias("error"))
    x = t.replicate_ranks
    return x.select("seed", F.lit(99).alias("L"), F.when(k % 11 != 0, F.create_map("component", "rank")).alias("ranks"),
                    F.create_map("component", "hit").alias("hits90"), F.array("hit", ~F.col("hit")).alias("theta_hits90"), flags.alias("flags"),
                    F.struct((k % 3).cast("int").alias("K"), F.lit(100).alias("T"), (k % 2).cast("int").alias("n_wallets")).alias("size"))


STORE_SQL = "SELECT *, seed % 11 = 0 AS failed, seed % 7 = 0 OR coalesce(CASE WHEN seed % 5 = 0 THEN seed % 10 = 0 END, false) AS degenerate FROM replicate_ranks"


@query("flt15_usable", sql("SELECT failed, degenerate, count(*) AS n FROM s GROUP BY failed, degenerate", "replicate_ranks", s=STORE_SQL))
def _(t):
    return calibration.replicate_flags(replicate_store(t)).groupBy("failed", "degenerate").agg(F.count("*").alias("n"))


@query("cal12_failures", sql("""SELECT count(*) AS n_replicates, count(*) FILTER (WHERE failed) AS n_failed, count(*) FILTER (WHERE NOT failed) AS n_scored, count(*) FILTER (WHERE NOT failed AND degenerate) AS n_degenerate,
round(avg(CASE WHEN failed THEN 1.0 ELSE 0.0 END), 9) AS failure_rate, round(count(*) FILTER (WHERE NOT failed AND degenerate) / count(*) FILTER (WHERE NOT failed), 9) AS degenerate_rate FROM s""", "replicate_ranks", s=STORE_SQL))
def _(t):
    x = calibration.failure_accounting(replicate_store(t))
    return x.select("n_replicates", "n_failed", "n_scored", "n_degenerate", r("failure_rate", 9).alias("failure_rate"), r("degenerate_rate", 9).alias("degenerate_rate"))


@query("cal12_error_counts", sql("SELECT CASE WHEN seed % 22 = 0 THEN 'singular' ELSE 'unspecified' END AS error, count(*) AS n FROM s WHERE failed GROUP BY 1", "replicate_ranks", s=STORE_SQL))
def _(t):
    return calibration.error_counts(replicate_store(t))


@query("cal13_sensitivity", sql("""SELECT component, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 9) AS rate_with_degenerate, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT degenerate), 9) AS rate
FROM s WHERE NOT failed GROUP BY component""", "replicate_ranks", s=STORE_SQL))
def _(t):
    x = calibration.degenerate_sensitivity(replicate_store(t))
    return x.select("component", r("rate", 9).alias("rate"), r("rate_with_degenerate", 9).alias("rate_with_degenerate"))


@query("cal13_sizes", sql("SELECT DISTINCT CAST(seed % 3 AS INTEGER) AS K, 100 AS T, CAST(seed % 2 AS INTEGER) AS n_wallets FROM replicate_ranks", "replicate_ranks"))
def _(t):
    return calibration.distinct_sizes(replicate_store(t))


def skewed_store(t):
    """Replicates of which one component's ranks are too low and its intervals too narrow, and a ninth of which failed."""
    x, low = replicate_store(t), F.map_contains_key("hits90", F.lit("P"))
    return x.select("seed", "L", F.when(low, F.transform_values("ranks", lambda k, v: F.floor(v / 2).cast("int"))).otherwise(F.col("ranks")).alias("ranks"),
                    F.when(low, F.transform_values("hits90", lambda k, v: v & (F.col("seed") % 10 < 7))).otherwise(F.col("hits90")).alias("hits90"),
                    F.array().cast("array<boolean>").alias("theta_hits90"), "flags", F.create_map(F.lit("a"), F.lit(1.0)).alias("prior"))


SKEW_SQL = f"""SELECT component, CASE WHEN component = 'P' THEN rank // 2 ELSE rank END AS rank, CASE WHEN component = 'P' THEN hit AND seed % 10 < 7 ELSE hit END AS hit
FROM ({STORE_SQL}) WHERE NOT failed AND NOT degenerate"""
SKEW_HIST_SQL = HIST20_SQL.replace("replicate_ranks", "skew")
SKEW_COVER_SQL = f"""SELECT component FROM (SELECT component, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) AS h,
  -{sql_ppf('(0.05 / 3 / 2)')} AS z FROM skew GROUP BY component) WHERE NOT ({W_LO} <= 0.9 AND {W_HI} >= 0.9)"""


@query("cal13_flags", sql(f"""SELECT 'rank' AS "check", component FROM u WHERE p_value_adj < 0.05
UNION ALL SELECT 'band', component FROM u JOIN pit USING (component) WHERE p_value_adj >= 0.05 AND ks_stat > sqrt(ln(2 / (0.05 / 3)) / (2.0 * n))
UNION ALL SELECT 'coverage', component FROM ({SKEW_COVER_SQL})
UNION ALL SELECT 'failure_rate', '' FROM (SELECT avg(CASE WHEN failed THEN 1.0 ELSE 0.0 END) AS fr FROM ({STORE_SQL})) WHERE fr > 0.05""",
    "replicate_ranks", skew=SKEW_SQL, h20=SKEW_HIST_SQL, u=UNIFORM_SQL, pit=PIT_SQL.replace("replicate_ranks", "skew")))
def _(t):
    return calibration.store_flags(skewed_store(t))


@query("cal13_power", sql(f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE verdict = 2) AS n_conclusive, count(*) FILTER (WHERE verdict = 1) AS n_underpowered, count(*) FILTER (WHERE verdict = 0) AS n_failed,
coalesce(string_agg(component, ',' ORDER BY component) FILTER (WHERE verdict = 1), '') AS underpowered, CAST(min(n) AS BIGINT) AS min_n, round(0.05 / count(*), 9) AS row_alpha FROM (
  SELECT component, n, CASE WHEN NOT ({W_LO} <= 0.9 AND {W_HI} >= 0.9) THEN 0 WHEN {W_LO} >= 0.85 AND {W_HI} <= 0.95 THEN 2 ELSE 1 END AS verdict FROM (
  SELECT component || (seed % 40) AS component, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) AS h, -{sql_ppf('(0.05 / 120 / 2)')} AS z FROM replicate_ranks GROUP BY 1))""", "replicate_ranks"))
def _(t):
    x = t.replicate_ranks.withColumn("component", F.concat("component", (F.col("seed") % 40).cast("string")))
    w = calibration.coverage_power(calibration.coverage(x, n_rows=120))
    return w.withColumn("underpowered", F.array_join("underpowered", ",")).withColumn("row_alpha", r("row_alpha", 9))


@query("cal11_pooled_auc", sql("SELECT count(a) AS n, round(avg(a), 9) AS mean, round(stddev_samp(a), 9) AS sd FROM (SELECT CASE WHEN seed % 4 <> 0 THEN rank / 100.0 END AS a FROM replicate_ranks)", "replicate_ranks"))
def _(t):
    x = calibration.pooled_value(t.replicate_ranks.select(F.when(F.col("seed") % 4 != 0, F.col("rank") / F.lit(100.0)).alias("z_auc")), "z_auc")
    return x.select("n", r("mean", 9).alias("mean"), r("sd", 9).alias("sd"))


@query("flt18_store_regimes", sql("SELECT count(*) AS n, 1 AS n_sizes, count(DISTINCT seed % 3) AS n_priors, 99 AS L FROM replicate_ranks", "replicate_ranks"))
def _(t):
    """Stores whose replicates have several priors are told apart by the whole map."""
    x = replicate_store(t).withColumn("prior", F.when(F.col("seed") % 3 != 0, F.create_map(F.lit("a"), (F.col("seed") % 3).cast("double"), F.lit("b"), F.lit(1.0))))
    return calibration.store_regimes(x)


QUANT = "quantile_cont(value, {q})"


@query("cal14_rank_truth", sql(f"""SELECT name, count(*) FILTER (WHERE value < tv) AS rank, round({QUANT.format(q=0.05)}, 9) AS lo, round({QUANT.format(q=0.95)}, 9) AS hi,
max(tv) BETWEEN {QUANT.format(q=0.05)} AND {QUANT.format(q=0.95)} AS hit FROM (SELECT *, idx / 50.0 - 0.5 AS tv FROM draws) GROUP BY name""", "draws"))
def _(t):
    truth = t.draws.groupBy("name").agg((F.max("idx") / 50.0 - 0.5).alias("truth"))
    return calibration.rank_truth(t.draws, truth).select("name", "rank", r("lo", 9).alias("lo"), r("hi", 9).alias("hi"), "hit")


@query("cal14_wallet_hits", f"""SELECT o_orderkey, abs(ln(th / (1 - th)) - lm) <= {sql_ppf('0.95e0')} * sqrt(greatest(lv, 0)) AS hit FROM (
  SELECT o_orderkey, (o_orderkey % 98 + 1) / 100.0 AS th, (o_custkey % 11 - 5) / 2.0 AS lm, (o_orderkey % 5 - 1) / 2.0 AS lv FROM orders)""")
def _(t):
    k = F.col("o_orderkey")
    x = t.read("orders").select("o_orderkey", ((k % 98 + 1) / F.lit(100.0)).alias("theta_true"), ((F.col("o_custkey") % 11 - 5) / F.lit(2.0)).alias("logit_mean"),
                                ((k % 5 - 1) / F.lit(2.0)).alias("logit_var"))
    return calibration.wallet_interval_hits(x).select("o_orderkey", "hit")


# ---- posterior draws ------------------------------------------------------------------------------

LATENT_SQL = "SELECT name AS market, idx AS i, iter, chain, value * 4 AS x, CAST(value > 0.05 AS INTEGER) AS v, CAST(value > 0.1 AS INTEGER) AS z FROM draws"


def latent(t):
    v = F.col("value")
    return t.draws.select(F.col("name").alias("market"), F.col("idx").alias("i"), "iter", "chain", (v * 4).alias("x"), (v > 0.05).cast("int").alias("v"), (v > 0.1).cast("int").alias("z"))


@query("pst1_trade_posteriors", sql("""SELECT market, i, round(avg(z), 9) AS p_z, round(avg(v), 9) AS p_v, round(avg(x), 9) AS x_mean, round(avg(1 / (1 + exp(-x))), 9) AS pi_mean
FROM lat WHERE iter >= 50 GROUP BY market, i""", "draws", lat=LATENT_SQL))
def _(t):
    return posterior.trade_posteriors(latent(t), 50).select("market", "i", *[r(c, 9).alias(c) for c in ("p_z", "p_v", "x_mean", "pi_mean")])


@query("agg11_credible_interval", sql("SELECT name, round(quantile_cont(value, 0.025), 9) AS lo, round(quantile_cont(value, 0.975), 9) AS hi, count(*) AS n FROM draws GROUP BY name", "draws"))
def _(t):
    return posterior.credible_interval(t.draws, ["name"]).select("name", r("lo", 9).alias("lo"), r("hi", 9).alias("hi"), "n")


@query("pst2_wallet_ranking", sql("""SELECT name AS wallet, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.025), 9) AS lo, round(quantile_cont(value, 0.975), 9) AS hi,
max(idx) AS n_trades, row_number() OVER (ORDER BY avg(value) DESC, name) AS rank FROM draws WHERE iter >= 50 GROUP BY name""", "draws"))
def _(t):
    d = t.draws.withColumnRenamed("name", "wallet")
    n = d.groupBy("wallet").agg(F.max("idx").alias("n_trades"))
    return posterior.wallet_ranking(d, n, 50).select("wallet", *[r(c, 9).alias(c) for c in ("mean", "median", "lo", "hi")], "n_trades", "rank")


def chains(t):
    """Draws regrouped into four equally long chains."""
    return t.draws.select("name", (F.col("iter") % 4).alias("chain"), F.floor(F.col("iter") / 4).alias("iter"), "value")


HALF_SQL = """SELECT name, sub, value FROM (SELECT name, chain || '-' || CASE WHEN it < h THEN 0 WHEN it >= n - h THEN 1 END AS sub, value FROM (
  SELECT *, n // 2 AS h FROM (SELECT name, iter % 4 AS chain, iter // 4 AS it, value, max(iter // 4) OVER (PARTITION BY name, iter % 4) + 1 AS n FROM draws))) WHERE sub IS NOT NULL"""


def rhat_sql(src: str, col: str) -> str:
    z = sql_ppf("p")
    return f"""SELECT name, sqrt(var_samp(m) / avg(v) + (min(n) - 1) / min(n)) AS rh FROM (SELECT name, sub, count(*) AS n, avg(zs) AS m, var_samp(zs) AS v FROM (
  SELECT name, sub, {z} AS zs FROM (SELECT name, sub, (rank() OVER (PARTITION BY name ORDER BY {col}) + (count(*) OVER (PARTITION BY name, {col}) - 1) / 2.0 - 0.375) / (count(*) OVER (PARTITION BY name) + 0.25) AS p FROM {src}))
  GROUP BY name, sub) GROUP BY name"""


@query("pst4_rhat", sql("SELECT b.name, 4 AS n_chains, round(greatest(b.rh, t.rh), 6) AS rhat FROM bulk b, tail t WHERE t.name = b.name", "draws", half=HALF_SQL,
    fold="SELECT name, sub, abs(value - quantile_cont(value, 0.5) OVER (PARTITION BY name)) AS far FROM half", bulk=rhat_sql("half", "value"), tail=rhat_sql("fold", "far")))
def _(t):
    return posterior.rhat(chains(t)).withColumn("rhat", r("rhat"))


def ess_views(src: str) -> dict[str, str]:
    """Views that end in ``ess(name, ess)`` and ``rh(name, rhat)`` for draws ``src(name, chain, it, value)``."""
    z = sql_ppf("p")
    return {"half": f"""SELECT name, sub, j, value FROM (SELECT name, chain || '-' || CASE WHEN it < h THEN 0 WHEN it >= n - h THEN 1 END AS sub, CASE WHEN it < h THEN it ELSE it - n + h END AS j, value FROM (
           SELECT *, n // 2 AS h FROM (SELECT *, max(it) OVER (PARTITION BY name, chain) + 1 AS n FROM {src}))) WHERE sub IS NOT NULL""",
         "zz": f"""SELECT name, sub, j, {z} AS zs FROM (SELECT name, sub, j, (rank() OVER (PARTITION BY name ORDER BY value) + (count(*) OVER (PARTITION BY name, value) - 1) / 2.0 - 0.375)
           / (count(*) OVER (PARTITION BY name) + 0.25) AS p FROM half)""",
         "cz": "SELECT *, zs - avg(zs) OVER (PARTITION BY name, sub) AS c, count(*) OVER (PARTITION BY name, sub) AS n FROM zz",
         "pr": "SELECT a.name, a.sub, b.j - a.j AS lag, sum(a.c * b.c) AS s FROM cz a JOIN cz b ON a.name = b.name AND a.sub = b.sub AND b.j >= a.j GROUP BY 1, 2, 3",
         "ac": """SELECT g.name, g.lag, avg(coalesce(s, 0) / g.n) AS a FROM (SELECT DISTINCT name, sub, n, unnest(range(2 * n)) AS lag FROM cz) g LEFT JOIN pr USING (name, sub, lag) GROUP BY g.name, g.lag""",
         "sh": "SELECT name, min(n) AS n, count(*) AS k, coalesce(var_samp(m), 0) AS between_ FROM (SELECT name, sub, count(*) AS n, avg(zs) AS m FROM zz GROUP BY name, sub) GROUP BY name",
         "rho": """SELECT ac.name, lag, n, k, CASE WHEN lag = 0 THEN 1 ELSE 1 - (mv - a) / (mv * (n - 1.0) / n + between_) END AS r
           FROM ac JOIN (SELECT sh.*, a * n / (n - 1.0) AS mv FROM sh JOIN ac ON ac.name = sh.name AND ac.lag = 0) m ON m.name = ac.name""",
         "gy": """SELECT *, max(CASE WHEN p <= 0 THEN 1 ELSE 0 END) OVER w AS stopped, min(p) OVER w AS low FROM (
           SELECT name, any_value(n) AS n, any_value(k) AS k, lag // 2 AS m, sum(r) AS p FROM rho GROUP BY name, lag // 2) WINDOW w AS (PARTITION BY name ORDER BY m)""",
         "ess": """SELECT name, any_value(n) * any_value(k) / greatest(-1 + 2 * coalesce(sum(low) FILTER (WHERE stopped = 0), 0), 1 / log10(any_value(n) * any_value(k))) AS ess FROM gy GROUP BY name""",
         "fold": "SELECT name, sub, abs(value - quantile_cont(value, 0.5) OVER (PARTITION BY name)) AS far FROM half",
         "bulk": rhat_sql("half", "value"), "tail": rhat_sql("fold", "far"), "rh": "SELECT b.name, greatest(b.rh, t.rh) AS rhat FROM bulk b JOIN tail t ON t.name = b.name"}


CHAIN_SQL = "SELECT name, iter % 4 AS chain, iter // 4 AS it, value FROM draws"


@query("pst5_bulk_ess", sql("SELECT name, round(ess, 4) AS ess FROM ess", "draws", ch=CHAIN_SQL, **ess_views("ch")))
def _(t):
    return posterior.bulk_ess(chains(t)).withColumn("ess", r("ess", 4))


@query("pst3_parameter_summary", sql("""SELECT k.name, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd, round(quantile_cont(value, 0.025), 9) AS lo,
round(quantile_cont(value, 0.975), 9) AS hi, round(any_value(ess), 4) AS ess, round(any_value(rhat), 6) AS rhat FROM ch k JOIN ess USING (name) JOIN rh USING (name) GROUP BY k.name""",
    "draws", ch=f"SELECT name, chain, it - 5 AS it, value FROM ({CHAIN_SQL}) WHERE it >= 5", **ess_views("ch")))
def _(t):
    s = posterior.parameter_summary(chains(t), 5)
    return s.select("name", *[r(c, 9).alias(c) for c in ("mean", "sd", "lo", "hi")], r("ess", 4).alias("ess"), r("rhat").alias("rhat"))


@query("pst6_diagnose", sql("SELECT round(max(rhat), 6) AS worst_rhat, round(min(ess), 4) AS min_ess, count(*) FILTER (WHERE rhat > 1.01) AS n_flagged FROM ess JOIN rh USING (name)",
                            "draws", ch=CHAIN_SQL, **ess_views("ch")))
def _(t):
    c = chains(t)
    d = posterior.diagnose(posterior.bulk_ess(c).join(posterior.rhat(c), "name"))
    return d.select(r("worst_rhat").alias("worst_rhat"), r("min_ess", 4).alias("min_ess"), "n_flagged")


@query("pst7_degeneracy", "SELECT o_orderpriority, round(avg(CASE WHEN o_totalprice < 0.25 * 400000 THEN 1.0 ELSE 0.0 END), 9) AS degenerate_share FROM orders GROUP BY o_orderpriority")
def _(t):
    e = t.read("orders").withColumnRenamed("o_totalprice", "ess")
    return posterior.degeneracy_rate(e, 400000, 0.25, ["o_orderpriority"]).withColumn("degenerate_share", r("degenerate_share", 9))

