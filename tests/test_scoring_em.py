import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fillwatch.config import ModelParams, OnlineConfig, Prior
from fillwatch.operators import em, features, scoring
from fillwatch.operators.kernel import OnlineState
from helpers import brute_features, by_market, mixture_filter, random_trades, trades

P = ModelParams(sigma2_0=1e-5, sigma2_1=1e-3, tau2_0=0.8, tau2_1=0.05, beta_S=0.4, beta_Z=0.7)


def rows_and_features(spark, **kw):
    rows = random_trades(11, **kw)
    return rows, features.compute_features(trades(spark, rows))


def test_filter_matches_textbook_recursion(spark):
    rows, f = rows_and_features(spark)
    feats = brute_features(rows)
    theta = spark.createDataFrame([("w1", 0.3), ("w2", 0.01)], "wallet STRING, theta DOUBLE")
    th = {"w1": 0.3, "w2": 0.01}
    got = {r.tx_hash: r for r in scoring.filter_scores(f, P, theta, m_s=0.1, s_s=1.3, m_z=0.05).collect()}
    for rs in by_market(rows).values():
        seq = [(feats[r[6]][3], feats[r[6]][1], feats[r[6]][2]) for r in rs]
        level = lambda i: math.log(th.get(rs[i][1], 0.05) / (1 - th.get(rs[i][1], 0.05)))  # noqa: E731, B023
        for r, w in zip(rs, mixture_filter(seq, P, level, 0.1, 1.3, 0.05)):
            g = got[r[6]]
            assert g.p_z == pytest.approx(w["p_z"], abs=1e-9) and g.x_mean == pytest.approx(w["x"], abs=1e-9)
            assert g.log_evidence == pytest.approx(w["ev"], abs=1e-9) and g.x_var == pytest.approx(w["var"], rel=1e-9)


@pytest.mark.parametrize("n", [10, 37])
def test_segments_do_not_change_scores(spark, n):
    _, f = rows_and_features(spark)
    whole = {r.tx_hash: r for r in scoring.filter_scores(f, P).collect()}
    cutup = {r.tx_hash: r for r in scoring.filter_scores(f, P, segment_rows=n).collect()}
    assert whole.keys() == cutup.keys()
    for k in whole:
        assert whole[k].p_z == pytest.approx(cutup[k].p_z, abs=1e-9)
        assert whole[k].prev_mu == pytest.approx(cutup[k].prev_mu, abs=1e-9) if whole[k].prev_mu is not None else cutup[k].prev_mu is None


def test_rows_without_a_start_state_have_empty_lists(spark):
    _, f = rows_and_features(spark)
    cut_up = scoring._segmented(f, None, 10)
    heads = cut_up.where("seg > 0 and i = seg * 10").withColumn("first_i", F.col("i"))
    for starts in (None, scoring.first_guess(heads, [P])):
        assert scoring.headed(cut_up, starts).where(" or ".join(f"in_{c} is null" for c in scoring.STATE)).isEmpty()


def test_rounds_grow_with_the_logarithm_where_a_start_is_felt_for_long(spark, monkeypatch):
    rows = [("a", f"w{k % 3}", 1000 + k // 200, 0.3 + 0.4 * (k * 37 % 101) / 101, 1.0 + k % 5, "BUY", f"t{k:04d}") for k in range(400)]
    slow = ModelParams(sigma2_0=1e-9, sigma2_1=1e-8, tau2_0=1.0, tau2_1=0.5)
    f = features.compute_features(trades(spark, rows)).cache()
    whole = {r.i: r for r in scoring.filter_scores(f, slow).collect()}
    passes, launch = [], scoring._launch
    monkeypatch.setattr(scoring, "_launch", lambda *a, **kw: passes.append(1) or launch(*a, **kw))
    got = {r.i: r for r in scoring.filter_scores(f, slow, segment_rows=8).collect()}
    assert len(passes) <= 6  # 8, 32, 128, 512 rows
    assert got.keys() == whole.keys() and all(got[i].x_mean == pytest.approx(whole[i].x_mean, abs=1e-11) for i in got)


def test_dropping_the_tail_keeps_earlier_scores(spark):
    rows, _ = rows_and_features(spark, markets=("a",))
    rs = by_market(rows)["a"]
    full = {r.tx_hash: r.p_z for r in scoring.online_scores(trades(spark, rs), P).collect()}
    head = {r.tx_hash: r.p_z for r in scoring.online_scores(trades(spark, rs[:70]), P).collect()}
    assert len(head) == 70 and all(full[k] == v for k, v in head.items())


@pytest.mark.parametrize("config", [OnlineConfig(), OnlineConfig(schedule="robbins_monro"), OnlineConfig(n_refresh=20, beta_window=30)])
def test_online_rounds_equal_one_pass(spark, config):
    rows, _ = rows_and_features(spark)
    theta = spark.createDataFrame([("w1", 0.3)], "wallet STRING, theta DOUBLE")
    got = {r.tx_hash: r for r in scoring.online_scores(trades(spark, rows), P, config, theta=theta, segment_rows=25).collect()}
    for rs in by_market(rows).values():
        st, counts = OnlineState(P, config), {}
        for r in rs:
            c = counts.get(r[1]) or (st.warm_wallet(0.3) if r[1] == "w1" else None)
            out, counts[r[1]] = st.trade(float(r[2]), r[3], r[4], r[1], c)
            assert got[r[6]].p_z == pytest.approx(out[0], abs=1e-12)


def test_frozen_online_scorer_is_the_plain_filter(spark):
    rows, _ = rows_and_features(spark)
    t = trades(spark, rows)
    a = {r.tx_hash: r.p_z for r in scoring.online_scores(t, P, OnlineConfig(forgetting=1.0), segment_rows=30).collect()}
    b = {r.tx_hash: r.p_z for r in scoring.filter_scores(features.causal_features(t), P).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


def test_seeded_statistics_reproduce_parameters():
    from fillwatch.operators.kernel import remap, seed_statistics
    p = ModelParams(sigma2_0=0.9, sigma2_1=1.5, tau2_0=1.1, tau2_1=0.2, q_01=0.2, q_10=0.5)
    s = seed_statistics(p, Prior(), 400.0)
    q = remap(p, Prior(), s)
    for k in ("sigma2_0", "sigma2_1", "tau2_0", "tau2_1", "q_01", "q_10"):
        assert getattr(q, k) == pytest.approx(getattr(p, k), rel=1e-6)


def brute_em(rows, n_iter):
    """Plain EM with slopes at zero, straight from the model equations."""
    feats = brute_features(rows)
    mk = by_market(rows)
    seqs = {m: [(feats[r[6]][3], feats[r[6]][1], feats[r[6]][2]) for r in rs] for m, rs in mk.items()}
    ys = np.array([s[0] for q in seqs.values() for s in q])
    p = ModelParams.from_variance(float(np.var(ys)))
    theta, trace = {}, []
    for _ in range(n_iter):
        tot, ss_v, n_v, ss_z, n_z = 0.0, [0., 0.], [0., 0.], [0., 0.], [0., 0.]
        trans, sw, nw = np.zeros((2, 2)), {}, {}
        for m, rs in mk.items():
            lev = lambda i: math.log(theta.get(rs[i][1], .05) / (1 - theta.get(rs[i][1], .05)))  # noqa: E731, B023
            out = mixture_filter(seqs[m], p, lev)
            tot += sum(o["ev"] for o in out)
            for i, o in enumerate(out):
                y, d, ls = seqs[m][i]
                for z, w in enumerate((1 - o["p_z"], o["p_z"])):
                    ss_z[z] += w * ((y - o["x"]) ** 2 + o["var"]) * max(1 + ls, .1)
                    n_z[z] += w
                if i:
                    b = out[i - 1]
                    trans += np.outer([1 - b["p_v"], b["p_v"]], [1 - o["p_v"], o["p_v"]])
                    sw[rs[i][1]] = sw.get(rs[i][1], 0) + o["p_z"]
                    nw[rs[i][1]] = nw.get(rs[i][1], 0) + 1
                    if d > 0:
                        for v, w in enumerate((1 - o["p_v"], o["p_v"])):
                            ss_v[v] += w * ((o["x"] - b["x"]) ** 2 + o["var"] + b["var"]) / d
                            n_v[v] += w
        trace.append(tot)
        theta = {w: (1 + sw[w]) / (20 + nw[w]) for w in sw}
        s = [max((1 + a / 2) / (3 + n / 2), 1e-6) for a, n in zip(ss_v, n_v)]
        t = [(a + 2e-9) / (n + 2e-9) for a, n in zip(ss_z, n_z)]
        p = replace(p, sigma2_0=s[0], sigma2_1=max(s), tau2_0=t[0], tau2_1=min(t), q_01=(1 + trans[0, 1]) / (2 + trans[0].sum()),
                    q_10=(1 + trans[1, 0]) / (2 + trans[1].sum()))
    return p, theta, trace


def test_em_matches_brute_force(spark):
    rows, f = rows_and_features(spark, n=60)
    p, theta, trace = brute_em(rows, 3)
    fit = em.fit_em(f, n_iter=3, tol=0.0, segment_rows=25)
    assert fit.trace == pytest.approx(trace, rel=1e-9)
    for k in ("sigma2_0", "sigma2_1", "tau2_0", "tau2_1", "q_01", "q_10"):
        assert getattr(fit.params, k) == pytest.approx(getattr(p, k), rel=1e-7)
    got = {r.wallet: r.theta for r in fit.theta.collect()}
    assert got.keys() == theta.keys() and all(got[w] == pytest.approx(theta[w], rel=1e-8) for w in got)


def test_em_stops_on_tolerance_and_runs_anonymous(spark):
    _, f = rows_and_features(spark, n=60)
    assert len(em.fit_em(f, n_iter=30, tol=0.5).trace) == 2
    fit = em.fit_em(f, n_iter=2, anonymous=True, estimate_slopes=True)
    assert fit.params.anonymous and fit.params.beta_S != 0.0 and fit.alpha_raw != 0.0


def test_newton_finds_each_wallets_mode(spark):
    rnd = np.random.default_rng(0)
    data = [(f"w{k % 3}", float(rnd.normal()), float(rnd.uniform()), float(rnd.uniform())) for k in range(60)]
    rows = spark.createDataFrame(data, "wallet STRING, x_s DOUBLE, x_z DOUBLE, target DOUBLE")
    start = spark.createDataFrame([("w0", .05), ("w1", .05), ("w2", .05), ("idle", .05)], "wallet STRING, theta DOUBLE")
    p = ModelParams(beta_S=0.8, beta_Z=-0.5)
    got = {r.wallet: r for r in em.theta_newton(rows, start, p).collect()}
    assert got["idle"].theta == pytest.approx(0.05, abs=1e-8)
    for w in ("w0", "w1", "w2"):
        phi = got[w].logit_mean
        grad = 1 - 20 / (1 + math.exp(-phi)) + sum(t - 1 / (1 + math.exp(-(phi + .8 * a - .5 * b))) for n, a, b, t in data if n == w)
        assert grad == pytest.approx(0.0, abs=1e-6)


def test_slopes_have_zero_penalized_gradient(spark):
    rnd = np.random.default_rng(1)
    data = [("w", float(rnd.normal()), float(rnd.normal()), float(rnd.uniform())) for _ in range(80)]
    rows = spark.createDataFrame(data, "wallet STRING, x_s DOUBLE, x_z DOUBLE, target DOUBLE")
    p, info = em.slope_irls(rows, None, ModelParams())
    x = np.array([d[1:3] for d in data])
    b = np.array([p.beta_S, p.beta_Z])
    mu = 1 / (1 + np.exp(-(x @ b + math.log(1 / 19))))
    grad = x.T @ (np.array([d[3] for d in data]) - mu) - 2 * b / (2.5 ** 2 + b ** 2)
    assert np.abs(grad).max() < 1e-4 and info.shape == (2, 2)


def test_laplace_density_integrates_transform(spark):
    st = spark.createDataFrame([tuple(float(k + 1) for k in range(12))], ", ".join(f"{k} DOUBLE" for k in em.STATS))
    post = em.laplace_rows(st, ModelParams())
    assert post.count() == 6 and post.where("fallback").count() == 0
    d = spark.createDataFrame([(0, "sigma2_0", 0.1)], "draw INT, name STRING, value DOUBLE")
    r = post.where("name = 'sigma2_0'").first()
    want = -0.5 * (math.log(2 * math.pi) + math.log(r.var_u) + (math.log(.1) - r.mean_u) ** 2 / r.var_u) - math.log(.1)
    assert em.laplace_logpdf(d, post).first().log_pdf == pytest.approx(want)


def test_level_falls_back_to_prior_mean(spark):
    t = trades(spark, random_trades(1, n=5))
    lev = scoring.with_level(t, ModelParams()).select(F.first("level")).first()[0]
    assert lev == pytest.approx(math.log(1 / 19))


def test_an_iteration_passes_over_the_trades_once(spark, monkeypatch):
    f = features.compute_features(trades(spark, random_trades(6, n=900)))
    passed, step = [], em.e_step

    def counted(data, *args, **kw):
        passed.append(data.table.agg(F.sum(F.size("y"))).first()[0])
        return step(data, *args, **kw)

    monkeypatch.setattr(em, "LEAD_ROWS", 100, raising=False)
    monkeypatch.setattr(em, "e_step", counted)
    em.fit_em(f, n_iter=1, segment_rows=400)
    assert sum(passed) < 1.3 * f.count()


def test_no_pass_exchanges_packed_trades(spark):
    """What lies above the packed segments of an E-step is a join without an exchange on their side."""
    from fillwatch.operators.packed import pack_segments
    _, f = rows_and_features(spark, n=60)
    data = pack_segments(f, 20)
    theta = spark.createDataFrame([("w1", 0.3)], "wallet STRING, theta DOUBLE")
    plan = em.e_step(data, P, (0.0, 1.0, 0.0), theta, None)._jdf.queryExecution().executedPlan().toString()
    trades_side = plan.split("ShuffledHashJoin")[1].split("ObjectHashAggregate")[0]
    assert "Exchange" not in trades_side and "Bucketed: true" in trades_side


def test_parameter_sets_may_differ_in_everything(spark):
    _, f = rows_and_features(spark)
    sets = [P, ModelParams(a=2.0, b=5.0, q_01=0.2), ModelParams(anonymous=True, alpha=-1.0)]
    for n in (30, 100_000):
        got = {(r.pset, r.market): r.log_marginal for r in scoring.log_marginals(f, sets, segment_rows=n).collect()}
        for k, p in enumerate(sets):
            for r in scoring.filter_scores(f, p).groupBy("market").agg(F.sum("log_evidence").alias("s")).collect():
                assert got[k, r.market] == pytest.approx(r.s, abs=1e-8)


def test_few_and_many_segments_walk_alike():
    """Lock-step and plain floats give the same filter."""
    from fillwatch.operators import lockstep
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 30, 90)
    n = int(lengths.sum())
    y, delta, lsr, theta = rng.normal(size=n), rng.exponential(5, n), rng.normal(size=n), rng.uniform(0.01, 0.6, n)
    fresh, init = rng.random(90) < 0.5, rng.uniform(0.1, 0.9, (4, 2, 90))
    sets = [P, ModelParams(q_01=0.3)]
    before, found = lockstep.FEW, []
    try:
        for lockstep.FEW in (0, 10 ** 9):
            found.append(lockstep.run(sets, (0.1, 1.3, 0.05), lengths, fresh, y, delta, lsr, lockstep.log_odds(sets, theta), init))
    finally:
        lockstep.FEW = before
    for c in ("q", "mu", "var", "ev", "before", "ends"):
        np.testing.assert_allclose(getattr(found[0], c), getattr(found[1], c), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("params", [[ModelParams(sigma2_0=0.08, sigma2_1=1.3, tau2_0=0.01, tau2_1=0.001)], [P], [P, ModelParams(beta_Z=0.7)]])
def test_pieces_of_long_segments_walk_alike(params, monkeypatch):
    from fillwatch.operators import lockstep
    rng = np.random.default_rng(5)
    lengths, sets = np.array([70_000, 300, 60_123]), len(params)
    n = int(lengths.sum())
    y, delta, lsr, theta = rng.normal(size=n), rng.exponential(5, n) * (rng.random(n) < 0.7), rng.normal(size=n), rng.uniform(0.01, 0.6, n)
    args = (params, (0.1, 1.3, 0.05), lengths, np.array([True, False, False]), y, delta, lsr, lockstep.log_odds(params, theta), rng.uniform(0.1, 0.9, (4, sets, 3)))
    whole = lockstep._run(*args)
    walked, plain = [], lockstep._walk
    monkeypatch.setattr(lockstep, "_walk", lambda *a: walked.append(len(a[4])) or plain(*a))
    cut = lockstep.run(*args)
    for c in ("q", "mu", "var", "ev", "before", "ends"):
        np.testing.assert_allclose(getattr(cut, c), getattr(whole, c), rtol=1e-9, atol=1e-11)
    if params[0].sigma2_0 == 0.08:
        assert max(walked, default=0) <= lockstep.PIECE  # the long segments are not walked trade by trade


def test_long_markets_take_a_bounded_number_of_rounds(spark, monkeypatch):
    monkeypatch.setattr(scoring, "MAX_ROUNDS", 3)
    t = trades(spark, random_trades(11))
    short = scoring.online_scores(t, P, segment_rows=1)
    assert len({f.split("round=")[1].split("/")[0] for f in short.inputFiles()}) == 3
    whole = {r.tx_hash: (r.p_z, r.theta) for r in scoring.online_scores(t, P).collect()}
    assert {r.tx_hash: (r.p_z, r.theta) for r in short.collect()} == whole
    assert scoring.online_scores(t.limit(0), P).count() == 0


def test_fitted_propensities_are_written_once(spark):
    _, f = rows_and_features(spark, n=60)
    fit = em.fit_em(f, n_iter=4)
    plan = fit.theta._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan  # read, not summed again in another order
    assert fit.theta_scored is None or len(fit.trace) == 4 or fit.theta_scored is fit.theta
