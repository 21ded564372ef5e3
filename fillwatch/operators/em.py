"""Distributed variational EM for the switching model.

Trades are packed and bucketed by segment once. One E-step is one pass over the packed
store: the propensities of a segment's wallets come beside its head, the segments
of a task are filtered in lock-step, and what the M-step needs is summed on the way
out, per segment and per (segment, wallet). Trades are not exchanged again in any
iteration. With non-zero slopes the propensities need a Newton search and the
slopes an IRLS search; both are driver loops over passes of the same kind.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwatch.config import DENOM_FLOOR, SIZE_SCALE_FLOOR, ModelParams, Prior
from fillwatch.functions.mathx import log1pexp, log_beta, log_cauchy, log_invgamma, logit, sigmoid
from fillwatch.operators import lockstep
from fillwatch.operators.kernel import irls, logit_float, remap
from fillwatch.operators.packed import DESIGN, DESIGN_DDL, Group, Packed, groups, lists, pack_design, pack_segments, row_sums, wallet_sums
from fillwatch.operators.scoring import KEYS, SEGMENT_ROWS, STATE, filter_scores, first_guess, states_apart
from fillwatch.session import cut, scalar_row, stored

STATS = ("ss_v0", "ss_v1", "n_v0", "n_v1", "n_00", "n_01", "n_10", "n_11", "ss_z0", "ss_z1", "n_z0", "n_z1")
MAX_LOG_VARIANCE, MIN_PRECISION = 16.0, 1e-8
#: Trades before a segment that give its first start in an iteration.
LEAD_ROWS = 2_000


def sufficient_terms(gamma: float = 1.0) -> dict[str, Column]:
    """Per-trade contributions to the M-step statistics of ``filter_scores`` output.

    The previous trade's moments are columns of the scores, so no window is needed.
    """
    inc = "CASE WHEN delta > 0 THEN (power(x_mean - prev_mu, 2) + x_var + prev_var) / delta END"
    moved = "CASE WHEN delta > 0 AND prev_mu IS NOT NULL THEN 1D END"
    obs = f"(power(y - x_mean, 2) + x_var) * greatest(1D + {float(gamma)!r}D * log_size_ratio, {DENOM_FLOOR!r}D)"
    terms = {"ss_v0": f"(1D - p_v) * {inc}", "ss_v1": f"p_v * {inc}", "n_v0": f"(1D - p_v) * {moved}", "n_v1": f"p_v * {moved}",
             "n_00": "(1D - prev_v1) * (1D - p_v)", "n_01": "(1D - prev_v1) * p_v", "n_10": "prev_v1 * (1D - p_v)", "n_11": "prev_v1 * p_v",
             "ss_z0": f"(1D - p_z) * {obs}", "ss_z1": f"p_z * {obs}", "n_z0": "1D - p_z", "n_z1": "p_z"}
    return {k: F.expr(v) for k, v in terms.items()}


def _total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def wallet_summary(scores: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Everything one iteration needs, summed per wallet."""
    later = F.col("i") >= 1
    return scores.groupBy("wallet").agg(
        *[_total(c).alias(k) for k, c in sufficient_terms(gamma).items()],
        F.sum("log_evidence").alias("log_marginal"), _total(F.col("prev_z1")).alias("prev_z"),
        F.count("prev_z1").alias("n_prev"), _total(F.when(later, F.col("p_z"))).alias("s_w"),
        F.count(F.when(later, 1)).alias("n_w"))


def sufficient_statistics(summary: DataFrame) -> DataFrame:
    return summary.agg(*[F.sum(k).alias(k) for k in STATS], F.sum("log_marginal").alias("log_marginal"),
                       (F.sum("prev_z") / F.nullif(F.sum("n_prev"), F.lit(0))).alias("m_z"))


def m_step(stats: dict, params: ModelParams, prior: Prior = Prior()) -> ModelParams:
    return remap(params, prior, [float(stats[k] or 0.0) for k in STATS])


def m_step_columns(stats: DataFrame, prior: Prior = Prior()) -> DataFrame:
    """The same closed forms as columns over statistics rows (one fit per row)."""
    def q(sw, st):
        return F.least(F.greatest((prior.q_a + F.col(sw)) / (prior.q_a + prior.q_b + F.col(sw) + F.col(st)), F.lit(1e-6)), F.lit(1.0 - 1e-6))

    def ig(ss, n):
        return F.greatest((prior.sigma2_b + F.col(ss) / 2.0) / (prior.sigma2_a + F.col(n) / 2.0 + 1.0), F.lit(1e-6))

    def ps(ss, n):
        return F.greatest((F.col(ss) + 2 * prior.tau2_b) / (F.col(n) + 2 * prior.tau2_a), F.lit(1e-6))

    s0, t0 = ig("ss_v0", "n_v0"), ps("ss_z0", "n_z0")
    return stats.select(q("n_01", "n_00").alias("q_01"), q("n_10", "n_11").alias("q_10"), s0.alias("sigma2_0"),
                        F.greatest(ig("ss_v1", "n_v1"), s0).alias("sigma2_1"), t0.alias("tau2_0"),
                        F.least(ps("ss_z1", "n_z1"), t0).alias("tau2_1"))


# ---- propensities and slopes -----------------------------------------------------------------

def design_rows(scores: DataFrame, m_s: float, s_s: float, m_z: float) -> DataFrame:
    """Standardized covariates and targets of the informed-trade regression (first trades excluded)."""
    x = F.col("log_size_ratio") - m_s
    x_s = x * 0.5 / s_s if s_s > SIZE_SCALE_FLOOR else x
    return scores.where("i >= 1").select("wallet", x_s.alias("x_s"), (F.col("prev_z1") - m_z).alias("x_z"), F.col("p_z").alias("target"))


def theta_newton(rows: DataFrame | Packed, wallets: DataFrame, params: ModelParams, max_iter: int = 25, tol: float = 1e-10,
                 halvings: int = 40) -> DataFrame:
    """Per-wallet mode of the penalized logistic level with fixed offsets, and its curvature.

    Every Newton pass sends each wallet's point to the blocks it has rows in and sums gradient, curvature and objective per block and
    wallet; a second pass prices all step halvings of a round at once. Rows stay packed where they are. A search that has not
    come to rest after ``max_iter`` passes is warned about.
    """
    a, b = params.a, params.b
    data = rows if isinstance(rows, Packed) else pack_design(rows)
    state = stored(wallets.select("wallet", logit("theta").alias("phi")), "theta-start")
    per_block, zero = 8, F.lit(0.0)

    def penalty(phi):
        return a * phi - (a + b) * log1pexp(phi)

    def offset(g: Group) -> np.ndarray:
        return params.beta_S * g.rows("x_s") + params.beta_Z * g.rows("x_z")

    def value(g: Group, eta: np.ndarray) -> np.ndarray:
        return g.per_wallet(g.rows("target") * eta - np.logaddexp(0.0, eta))

    def local(g: Group):
        eta = offset(g) + g.of_wallets("phi")
        pi = 1.0 / (1.0 + np.exp(-eta))
        return g.per_wallet(g.rows("target") - pi), g.per_wallet(pi * (1.0 - pi)), value(g, eta)

    def curvature(st):
        s, j = sigmoid("phi"), st.join(wallet_sums(data.beside(st.select("wallet", "phi")), local, ("g", "h", "o")), "wallet", "left")
        return j.select("wallet", "phi", (F.coalesce("g", zero) + a - (a + b) * s).alias("grad"),
                        (F.coalesce("h", zero) + (a + b) * s * (1.0 - s)).alias("hess"),
                        (F.coalesce("o", zero) + penalty(F.col("phi"))).alias("obj"))

    for _ in range(max_iter):
        now = stored(curvature(state).withColumn("move", F.col("grad") / F.col("hess")), "theta-step")
        done, open_ = None, now
        for block in range(0, halvings, per_block):
            scales = [0.5 ** k for k in range(block, min(block + per_block, halvings))]
            names = [f"c{k}" for k in range(len(scales))]

            def tries(g: Group, scales=scales):
                off, phi, move = offset(g), g.of_wallets("phi"), g.of_wallets("move")
                return [np.nan_to_num(value(g, off + phi + move * s)) for s in scales]

            priced = open_.join(wallet_sums(data.beside(open_.select("wallet", "phi", "move")), tries, names), "wallet", "left")
            cand = lambda k: F.col("phi") + F.col("move") * scales[k]  # noqa: E731, B023
            pick = None
            for k in reversed(range(len(scales))):
                good = F.coalesce(f"c{k}", zero) + penalty(cand(k)) >= F.col("obj") - 1e-12
                pick = F.when(good, cand(k)) if pick is None else F.when(good, cand(k)).otherwise(pick)
            priced = stored(priced.select("wallet", "phi", "grad", "hess", "obj", "move", pick.alias("new")), "theta-tries")
            found = priced.where("new IS NOT NULL").select("wallet", "phi", "new")
            done = found if done is None else done.unionByName(found)
            open_ = priced.where("new IS NULL").drop("new")
            if open_.isEmpty():
                break
        nxt = stored(done.unionByName(open_.select("wallet", "phi", F.col("phi").alias("new"))), "theta-next")
        gap = scalar_row(nxt.agg(F.max(F.abs(F.col("new") - F.col("phi"))).alias("d"), F.max(F.abs("new")).alias("m")))
        state = nxt.select("wallet", F.col("new").alias("phi"))
        if gap["d"] is None or gap["d"] / max(1.0, gap["m"]) < tol:
            break
    else:
        warnings.warn(f"propensities still moved by {gap['d']:.3g} after {max_iter} Newton passes", stacklevel=2)
    return curvature(state).select("wallet", sigmoid("phi").alias("theta"), F.col("phi").alias("logit_mean"),
                                   (1.0 / F.col("hess")).alias("logit_var"))


def slope_irls(rows: DataFrame | Packed, theta: DataFrame | None, params: ModelParams, prior: Prior = Prior()):
    """Pooled slopes (and the intercept in anonymous mode); returns ``(params, information)``. Each pass returns one row per task."""
    anon, base = params.anonymous, logit_float(params.prior_mean)
    data = rows if isinstance(rows, Packed) else pack_design(rows)
    packed = data.table if anon or theta is None else stored(data.beside(theta.select("wallet", logit("theta").alias("off"))), "slope-design")
    known = "off" in packed.columns
    start, scales = ([params.alpha, params.beta_S, params.beta_Z], [prior.alpha_scale, prior.beta_scale, prior.beta_scale]) if anon else \
        ([params.beta_S, params.beta_Z], [prior.beta_scale, prior.beta_scale])
    k, scale = len(start), np.asarray(scales)
    if packed.isEmpty():
        return params, np.zeros((k, k))

    def design(g: Group):
        x = np.column_stack([g.rows("x_s"), g.rows("x_z")])
        if anon:
            return np.column_stack([np.ones(len(x)), x]), np.zeros(len(x))
        off = g.of_wallets("off") if known else np.full(len(x), base)
        return x, np.where(np.isnan(off), base, off)

    def objective(cands):
        def value(g):
            x, off = design(g)
            return [np.sum(g.rows("target") * eta - np.logaddexp(0.0, eta)) for eta in (off + x @ np.asarray(b) for b in cands)]

        row = scalar_row(row_sums(packed, value, [f"o{j}" for j in range(len(cands))]))
        return [row[j] - float(np.sum(np.log1p((np.asarray(b) / scale) ** 2))) for j, b in enumerate(cands)]

    def curvature(b):
        def local(g):
            x, off = design(g)
            mu = 1.0 / (1.0 + np.exp(-(off + x @ b)))
            return [*(x.T @ (g.rows("target") - mu)), *((x * (mu * (1.0 - mu))[:, None]).T @ x).ravel()]

        row = np.array(scalar_row(row_sums(packed, local, [f"s{j}" for j in range(k + k * k)])))
        c = 2.0 / (scale ** 2 + np.asarray(b) ** 2)
        return row[:k] - c * b, row[k:].reshape(k, k) + np.diag(c)

    beta, info = irls(objective, curvature, start)
    if anon:
        return replace(params, alpha=float(beta[0]), beta_S=float(beta[1]), beta_Z=float(beta[2])), info
    return replace(params, beta_S=float(beta[0]), beta_Z=float(beta[1])), info


# ---- the E-step over packed segments --------------------------------------------------------------

SUMMARY_DDL = ("market STRING, seg BIGINT, wallets ARRAY<STRING>, stats ARRAY<DOUBLE>, log_marginal DOUBLE, prev_z DOUBLE, n_prev BIGINT, "
               "s_w ARRAY<DOUBLE>, n_w ARRAY<DOUBLE>, first_y DOUBLE, mu DOUBLE, var DOUBLE, v1 DOUBLE, z1 DOUBLE")
_TRADES = "w ARRAY<INT>, x ARRAY<DOUBLE>, prev ARRAY<DOUBLE>, target ARRAY<DOUBLE>"


def _statistics(g: Group, f: lockstep.Filtered, y, delta, lsr, gamma: float) -> np.ndarray:
    """The twelve M-step statistics of each segment: ``sufficient_terms`` summed."""
    before_mu, before_var, before_v, _ = f.before[:, 0]
    later, pv, pz = ~np.isnan(before_mu), f.p_v[0], f.p_z[0]
    moved = later & (delta > 0)
    grown = np.zeros(len(y))
    grown[moved] = ((f.mu[0] - before_mu)[moved] ** 2 + f.var[0][moved] + before_var[moved]) / delta[moved]
    seen = (((y - f.mu[0]) ** 2) + f.var[0]) * np.maximum(1.0 + gamma * lsr, DENOM_FLOOR)
    was = np.where(later, before_v, 0.0)
    terms = np.stack([(1 - pv) * grown, pv * grown, (1 - pv) * moved, pv * moved, (1 - was) * (1 - pv) * later, (1 - was) * pv * later,
                      was * (1 - pv), was * pv, (1 - pz) * seen, pz * seen, 1 - pz, pz])
    return np.add.reduceat(terms, g.at, axis=1).T


def _e_step(params: ModelParams, const, trades: bool):
    """Packed segments in, one summary row per segment out; with ``trades`` also what the regressions need of each trade."""
    def go(batches):
        for g in groups(batches):
            col = g.batch.column
            seg = col("seg").to_numpy()
            y, delta, lsr = g.rows("y"), g.rows("delta"), g.rows("lsr")
            theta = g.of_wallets("theta") if "theta" in g.batch.schema.names else np.full(len(y), np.nan)
            init = np.zeros((len(STATE), 1, len(seg)))
            if "in_mu" in g.batch.schema.names:
                init[:, 0] = [np.nan_to_num(col(f"in_{c}").to_numpy(zero_copy_only=False)) for c in STATE]
            f = lockstep.run([params], const, g.lengths, seg == 0, y, delta, lsr, lockstep.log_odds([params], theta), init)
            later = ~np.isnan(f.before[0, 0])
            prev = np.where(later, f.before[3, 0], 0.0)
            total = lambda x: np.add.reduceat(x, g.at)  # noqa: E731, B023
            out = [*(col(c) for c in (*KEYS, "wallets")), pa.array(list(_statistics(g, f, y, delta, lsr, params.gamma))), pa.array(total(f.ev[0])),
                   pa.array(total(prev)), pa.array(total(later.astype(np.int64))), g.wallet_lists(g.per_wallet(f.p_z[0] * later)),
                   g.wallet_lists(g.per_wallet(later)), pa.array(y[g.at]), *(pa.array(x) for x in f.ends[:, 0])]
            names = [c.split()[0] for c in SUMMARY_DDL.split(", ")]
            if trades:
                out += [col("w"), *(lists(x, g.lengths) for x in (lsr, np.where(later, prev, np.nan), f.p_z[0]))]
                names += ["w", "x", "prev", "target"]
            yield pa.RecordBatch.from_arrays(out, names)

    return go


def e_step(data: Packed, params: ModelParams, const, theta: DataFrame | None, starts: DataFrame | None, trades: bool = False) -> DataFrame:
    """One pass; nothing that is packed is exchanged. ``starts`` holds the states of later segments, where there are any."""
    packed = data.table if theta is None or params.anonymous else data.beside(theta.select("wallet", "theta"))
    if starts is not None:
        packed = packed.join(starts.select(*KEYS, *[F.col(c).alias(f"in_{c}") for c in STATE]).hint("shuffle_hash"), KEYS, "left")
    return packed.mapInArrow(_e_step(params, const, trades), f"{SUMMARY_DDL}, {_TRADES}" if trades else SUMMARY_DDL)


def settled_e_step(data: Packed, params: ModelParams, const, theta, leads: Packed | None, trades: bool, tol: float = 1e-12):
    """E-step whose segments start where their predecessors end, to within ``tol``: ``(summary, starts)``.

    ``leads`` (the trades before each later segment) give the first starts, so that as a rule one pass over all trades settles them.
    Segments whose start moved run again, and their new summaries take the place of the old ones. ``None``: all segments begin a market."""
    if leads is None:
        return stored(e_step(data, params, const, theta, None, trades), "e-step"), None
    heads = leads.table.select(*KEYS, F.lit(0).cast("long").alias("first_i"), F.col("y")[0].alias("y"))
    guess = first_guess(heads, [params]).select(*KEYS, *[F.col(c)[0].alias(c) for c in STATE])
    starts, todo, done = stored(e_step(leads, params, const, theta, guess).select(*KEYS, *STATE), "e-starts"), data, None
    while True:
        ran = e_step(todo, params, const, theta, starts, trades)
        done = stored(ran if done is None else done.join(again, KEYS, "left_anti").unionByName(ran), "e-step")
        ends = done.select("market", (F.col("seg") + 1).alias("seg"), *[F.col(c).alias(f"n_{c}") for c in STATE])
        far = F.greatest(*[F.abs(F.col(c) - F.col(f"n_{c}")) for c in STATE])
        moved = stored(starts.join(ends, KEYS).withColumn("moved", far > tol), "e-moves")
        starts = moved.select(*KEYS, *[F.col(f"n_{c}").alias(c) for c in STATE])
        again = moved.where("moved").select(*KEYS)
        if again.isEmpty():
            return done, starts
        todo = Packed(data.table.join(again.hint("shuffle_hash"), KEYS, "left_semi"), data.pairs.join(again, KEYS, "left_semi"))


def segment_totals(summary: DataFrame) -> DataFrame:
    """One row: the statistics, the log marginal and the mean of the previous flags over all segments."""
    return summary.agg(*[F.sum(F.col("stats")[k]).alias(c) for k, c in enumerate(STATS)], F.sum("log_marginal").alias("log_marginal"),
                       (F.sum("prev_z") / F.nullif(F.sum("n_prev"), F.lit(0))).alias("m_z"))


def wallet_totals(summary: DataFrame) -> DataFrame:
    pairs = summary.select(F.explode(F.arrays_zip("wallets", "s_w", "n_w")).alias("r")).select(F.col("r.wallets").alias("wallet"), "r.s_w", "r.n_w")
    return pairs.groupBy("wallet").agg(F.sum("s_w").alias("s_w"), F.sum("n_w").cast("long").alias("n_w"))


def packed_design(summary: DataFrame, pairs: DataFrame, m_s: float, s_s: float, m_z: float) -> Packed:
    """The regression's rows of an E-step with trades, first trades of markets left out."""
    def go(batches):
        for g in groups(batches):
            x, prev = g.rows("x"), g.rows("prev")
            later = ~np.isnan(prev)
            n = np.add.reduceat(later.astype(np.int64), g.at)
            x = (x - m_s) * (0.5 / s_s) if s_s > SIZE_SCALE_FLOOR else x - m_s
            w = (g.w - np.repeat(g.first_wallet[:-1], g.lengths)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(g.batch.column(c) for c in (*KEYS, "wallets")),
                                              *(lists(v[later], n) for v in (w, x, prev - m_z, g.rows("target")))], [*KEYS, "wallets", "w", *DESIGN])

    return Packed.store(summary.mapInArrow(go, DESIGN_DDL), "fit-design", pairs)


# ---- the fit --------------------------------------------------------------------------------

def raw_units(beta_s, beta_z, alpha, m_s, s_s, m_z):
    """Size slope and intercept on the scale of the raw covariates, of numbers or of columns; a constant size keeps its slope."""
    if isinstance(s_s, Column):
        slope = F.when(s_s > SIZE_SCALE_FLOOR, beta_s * 0.5 / F.when(s_s > SIZE_SCALE_FLOOR, s_s)).otherwise(beta_s)
    else:
        slope = beta_s * 0.5 / s_s if s_s > SIZE_SCALE_FLOOR else beta_s
    return slope, alpha - slope * m_s - beta_z * m_z


@dataclass
class Fit:
    """A fitted model: driver scalars plus the per-wallet propensity table."""

    params: ModelParams
    theta: DataFrame
    trace: list[float]
    m_s: float
    s_s: float
    m_z: float
    score_m_z: float
    information: np.ndarray
    stats: dict
    theta_scored: DataFrame | None
    params_scored: ModelParams
    starts: DataFrame | None = None

    @property
    def converged_iterations(self) -> int:
        return len(self.trace)

    @property
    def beta_s_raw(self) -> float:
        return raw_units(self.params.beta_S, self.params.beta_Z, self.params.alpha, self.m_s, self.s_s, self.m_z)[0]

    @property
    def alpha_raw(self) -> float:
        """Intercept on the raw covariate scale; 0 in wallet mode."""
        if not self.params.anonymous:
            return 0.0
        return raw_units(self.params.beta_S, self.params.beta_Z, self.params.alpha, self.m_s, self.s_s, self.m_z)[1]

    def scores(self, features: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
        """Per-trade posterior of the last E-step."""
        return filter_scores(features, self.params_scored, self.theta_scored, m_s=self.m_s, s_s=self.s_s, m_z=self.score_m_z,
                             segment_rows=segment_rows, guess=self.starts)


def fit_em(features: DataFrame, *, params: ModelParams | None = None, prior: Prior = Prior(), n_iter: int = 50,
           tol: float = 1e-3, estimate_slopes: bool = False, anonymous: bool = False,
           segment_rows: int = SEGMENT_ROWS, wallets: DataFrame | None = None) -> Fit:
    """Variational EM over all markets of ``features``; ``wallets`` may supply starting propensities."""
    data = pack_segments(features, segment_rows)
    facts = scalar_row(features.agg(F.var_pop("y").alias("v"), F.avg("log_size_ratio").alias("m"),
                                    F.stddev_pop("log_size_ratio").alias("s"), F.max("i").alias("top")))
    leads = pack_segments(features, segment_rows, min(LEAD_ROWS, segment_rows)) if (facts["top"] or 0) >= segment_rows else None
    p = params or ModelParams.from_variance(facts["v"], anonymous)
    m_s, s_s, m_z = facts["m"], facts["s"], 0.0
    theta = wallets
    info = np.zeros((3, 3) if p.anonymous else (2, 2))
    trace: list[float] = []
    starts, fit_theta = None, None
    while True:
        scored_theta, scored_params, scored_mz = theta, p, m_z
        slopes = estimate_slopes or p.beta_S != 0.0 or p.beta_Z != 0.0
        summary, starts = settled_e_step(data, p, (m_s, s_s, m_z), theta, leads, slopes)
        stats = scalar_row(segment_totals(summary)).asDict()
        trace.append(stats["log_marginal"])
        m_z_new = stats["m_z"] if stats["m_z"] is not None else m_z
        stop = len(trace) > 1 and abs(trace[-1] - trace[-2]) / max(abs(trace[-2]), 1.0) < tol
        if not stop:
            design = packed_design(summary, data.pairs, m_s, s_s, m_z_new) if slopes else None
            if not p.anonymous:
                if p.beta_S == 0.0 and p.beta_Z == 0.0:
                    d = p.a + p.b + F.col("n_w")
                    m = (p.a + F.col("s_w")) / d
                    # curvature of the level at its mode: counts times theta (1 - theta)
                    theta = wallet_totals(summary).select("wallet", m.alias("theta"), logit(m).alias("logit_mean"),
                                                          (1.0 / (d * m * (1.0 - m))).alias("logit_var"))
                else:
                    names = wallet_totals(summary).select("wallet")
                    base = names.withColumn("theta", F.lit(None).cast("double")) if theta is None else \
                        names.join(theta.select("wallet", "theta"), "wallet", "left")
                    theta = stored(theta_newton(design, base.select("wallet", F.coalesce("theta", F.lit(p.prior_mean)).alias("theta")), p), "theta")
                fit_theta = theta
            p = m_step(stats, p, prior)
            if estimate_slopes:
                p, info = slope_irls(design, theta, p, prior)
        m_z = m_z_new
        if stop or len(trace) >= n_iter:
            break
    if fit_theta is None:
        fit_theta = data.pairs.select("wallet").distinct().select(
            "wallet", F.lit(p.prior_mean).alias("theta"), logit(F.lit(p.prior_mean)).alias("logit_mean"), F.lit(0.0).alias("logit_var"))
    # sums over segments depend in their last digits on the order of rows, so every reader of the fit gets the same written table
    kept = stored(fit_theta, "fit-theta")
    scored_theta = kept if scored_theta is fit_theta else scored_theta
    guess = None if starts is None else starts.select(*KEYS, (F.col("seg") * segment_rows).alias("first_i"), *[F.array(c).alias(c) for c in STATE])
    return Fit(p, kept, trace, m_s, s_s, m_z, scored_mz, info, stats, scored_theta, scored_params, guess)


# ---- densities over parameter tables ----------------------------------------------------------

def log_prior(prior: Prior = Prior(), parts: Sequence[str] = ("sigma2", "q", "beta", "tau2")) -> Column:
    """Joint log prior of a parameter row (columns named as in ``ModelParams``)."""
    terms = {
        "sigma2": [log_invgamma(c, prior.sigma2_a, prior.sigma2_b) for c in ("sigma2_0", "sigma2_1")],
        "q": [log_beta(c, prior.q_a, prior.q_b) for c in ("q_01", "q_10")],
        "beta": [log_cauchy(c, prior.beta_scale) for c in ("beta_S", "beta_Z")],
        "tau2": [log_invgamma(c, prior.tau2_a, prior.tau2_b) for c in ("tau2_0", "tau2_1")]}
    flat = [t for k in parts for t in terms[k]]
    out = flat[0]
    for t in flat[1:]:
        out = out + t
    return out


def laplace_rows(stats: DataFrame, params: ModelParams, prior: Prior = Prior()) -> DataFrame:
    """Unconstrained mean, variance and fallback flag per scalar parameter from a statistics row."""
    extra = prior.q_a + prior.q_b - 2.0
    prec = {
        "sigma2_0": (0.5 * F.col("ss_v0") + prior.sigma2_b) / params.sigma2_0,
        "sigma2_1": (0.5 * F.col("ss_v1") + prior.sigma2_b) / params.sigma2_1,
        "q_01": (extra + F.col("n_01") + F.col("n_00")) * (params.q_01 * (1 - params.q_01)),
        "q_10": (extra + F.col("n_10") + F.col("n_11")) * (params.q_10 * (1 - params.q_10)),
        "tau2_0": (0.5 * F.col("ss_z0") + prior.tau2_b) / params.tau2_0,
        "tau2_1": (0.5 * F.col("ss_z1") + prior.tau2_b) / params.tau2_1}
    rows = F.explode(F.array(*[F.struct(
        F.lit(k).alias("name"), F.lit(_free(k, getattr(params, k))).alias("mean_u"), c.alias("precision")) for k, c in prec.items()]))
    out = stats.select(rows.alias("r")).select("r.*")
    bad = F.col("precision").isNull() | F.isnan("precision") | (F.col("precision") <= 0)
    size = F.coalesce(F.nanvl(F.abs("precision"), F.lit(0.0)), F.lit(0.0))
    var = F.when(bad, 1.0 / F.greatest(size, F.lit(MIN_PRECISION))).otherwise(1.0 / F.when(~bad, F.col("precision")))
    return out.select("name", "mean_u", "precision", F.least(var, F.lit(MAX_LOG_VARIANCE)).alias("var_u"),
                      (bad | (var > MAX_LOG_VARIANCE)).alias("fallback"))


def _free(name: str, value: float) -> float:
    return float(np.log(value / (1.0 - value))) if name.startswith("q_") else float(np.log(value))


def laplace_logpdf(draws: DataFrame, posterior: DataFrame) -> DataFrame:
    """Log density on the natural scale of long draws ``(draw, name, value)`` under independent scalar blocks."""
    j = draws.join(posterior.select("name", "mean_u", "var_u"), "name")
    is_q = F.col("name").startswith("q_")
    u = F.when(is_q, F.log(F.col("value") / (1.0 - F.col("value")))).otherwise(F.log("value"))
    jac = F.when(is_q, -F.log("value") - F.log1p(-F.col("value"))).otherwise(-F.log("value"))
    d = u - F.col("mean_u")
    dens = -0.5 * (float(np.log(2 * np.pi)) + F.log("var_u") + d * d / F.col("var_u")) + jac
    return j.groupBy("draw").agg(F.sum(dens).alias("log_pdf"))


# ---- shortlist first, then fit ------------------------------------------------------------------

def shortlist_fit(features: DataFrame, ids: DataFrame, insiders: DataFrame, *, quantile: float = 0.5, n_iter: int = 50,
                  tol: float = 1e-3) -> tuple[Fit, DataFrame]:
    """Fit on the trades of shortlisted wallets only; returns the fit and the recall of labelled wallets."""
    from fillwatch.operators.clean import shortlist_wallets
    from fillwatch.operators.metrics import recall_at_k
    from fillwatch.operators.wallets import prefilter, two_tier
    pre = cut(prefilter(features, ids, quantile))
    subset = shortlist_wallets(features, pre.where("flagged"))
    fit = fit_em(subset, n_iter=n_iter, tol=tol)
    ranked = pre.select("wallet", "wallet_id", "flagged").join(fit.theta.select("wallet", "theta"), "wallet", "left") \
                .withColumn("theta", F.coalesce("theta", F.lit(fit.params.prior_mean)))
    recall = recall_at_k(two_tier(ranked), insiders, score="tier_score")
    return fit, recall
