import pytest

from fillwatch.config import DAY, WindowSpec
from fillwatch.operators import backtest, case_study, event_study, posterior, wallets
from helpers import scores

T0 = 1.7e9
HOUR = 3600.0


def hourly(market, n=600, planted=None, base=0.05):
    rows = []
    for k in range(n):
        age = (n - k) * HOUR
        p = planted if planted and DAY < age <= 5 * DAY else base + 0.001 * (k % 7)
        rows.append((T0 + k * HOUR, f"{market}{k:04d}", market, f"w{k % 5}", p, 0.1, 0.01 * k))
    return rows


def closes(spark, rows):
    return spark.createDataFrame(rows, "market STRING, close_ts DOUBLE")


END = T0 + 600 * HOUR


def test_planted_window_is_found_and_quiet_market_is_not(spark):
    s = scores(spark, hourly("hot", planted=0.6) + hourly("calm"))
    r = {x.market: x for x in event_study.market_results(s, closes(spark, [("hot", END), ("calm", END)]), n=99).collect()}
    assert r["hot"].p_value == pytest.approx(0.01) and r["hot"].elevation > 0.3 and r["hot"].p_value_max == pytest.approx(0.01, abs=0.35)
    assert r["calm"].p_value > 0.05 and r["hot"].n_null == 99


def test_exclusion_reasons(spark):
    early = [(T0 + k * HOUR, f"e{k}", "early", "w", .1, .1, 0.) for k in range(10)]
    short = [(END - 4.5 * DAY + k * HOUR, f"s{k}", "short", "w", .1, .1, 0.) for k in range(10)]
    late = [(END + 10 + k, f"l{k}", "late", "w", .1, .1, 0.) for k in range(3)]
    s = scores(spark, early + short + late + hourly("gone")[:3])
    c = closes(spark, [("early", END), ("short", END), ("late", END)])
    got = {r.market: r.reason for r in event_study.market_results(s, c, n=50).collect()}
    assert got == {"early": "empty_window", "short": "history_too_short", "late": "no_trades_before_close", "gone": "no_resolution"}


def test_other_markets_do_not_move_a_p_value(spark):
    c = closes(spark, [("a", END), ("b", END)])
    one = event_study.market_results(scores(spark, hourly("a")), c, n=60, seed=3).first().p_value
    two = event_study.market_results(scores(spark, hourly("a") + hourly("b", planted=.4)), c, n=60, seed=3).where("market = 'a'").first().p_value
    assert one == two


def test_shifted_windows_against_scan(spark):
    rows = hourly("m", 300)
    s = scores(spark, rows)
    spec = WindowSpec(2 * DAY, 0.5 * DAY)
    end = T0 + 300 * HOUR
    st = event_study.window_stats(s, closes(spark, [("m", end)]), spec)
    off = event_study.null_offsets(st, 25, seed=1)
    want = {}
    for r in off.collect():
        hit = [x[4] for x in rows if end - spec.before - r.offset <= x[0] < end - spec.embargo - r.offset]
        want[r.draw] = (len(hit), sum(hit) / len(hit), max(hit))
    for r in event_study.shifted_windows(s, off, spec).collect():
        assert (r.n_win, r.null_max) == (want[r.draw][0], want[r.draw][2]) and r.null_mean == pytest.approx(want[r.draw][1])


def test_cross_market_needs_another_market(spark):
    st = event_study.window_stats(scores(spark, hourly("a")), closes(spark, [("a", END)]))
    assert event_study.cross_market_p(scores(spark, hourly("a")), st, n=9).first().p_value_cross is None
    s = scores(spark, hourly("a", planted=.9) + hourly("b"))
    st = event_study.window_stats(s, closes(spark, [("a", END), ("b", END)]))
    got = {r.market: r.p_value_cross for r in event_study.cross_market_p(s, st, n=19).collect()}
    assert got["a"] == pytest.approx(1 / 20) and 0 < got["b"] <= 1


def test_cross_market_picks_unfold_in_all_tasks_and_are_not_broadcast(spark):
    s = scores(spark, hourly("a", planted=.9) + hourly("b"))
    st = event_study.window_stats(s, closes(spark, [("a", END), ("b", END)])).cache()
    plan = event_study.cross_market_p(s, st, n=19)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and any("SortMergeJoin" in x and "pos#" in x for x in plan.splitlines())


def test_no_frame_reaches_to_the_end_of_its_group(spark):
    s = scores(spark, hourly("a"))
    off = event_study.null_offsets(event_study.window_stats(s, closes(spark, [("a", END)])), 5)
    f = spark.sql("SELECT 'a' AS market, 'w' AS wallet, id AS ts, pow(-1, id) AS dy FROM range(9)")
    for df in (event_study.shifted_windows(s, off), wallets.wash_hits(f, 60.0)):
        assert "unboundedfollowing" not in df._jdf.queryExecution().executedPlan().toString().lower()


def test_terminal_move_without_trades_is_zero(spark):
    rows = [(T0, "a", "m", "w", .1, .1, 2.0)]
    r = event_study.terminal_move(scores(spark, rows), closes(spark, [("m", T0 + 3 * DAY)])).first()
    assert (r.terminal_move, r.n_terminal) == (0.0, 0)


def panel_rows(k, outcome_price=0.6):
    start = T0 + 10 * DAY * k
    ps = [0.4, 0.55, 0.6, 0.7, 0.8, 0.95]
    from math import log
    price = 0.55 + 0.02 * (k % 8)
    return [(start + j * DAY * 0.8, f"{k}-{j}", f"m{k:02d}", "w", p, .1, log(price / (1 - price))) for j, p in enumerate(ps)]


def test_positions_first_crossing_and_costs(spark):
    s = scores(spark, panel_rows(0))
    c = closes(spark, [("m00", T0 + 5 * DAY)])
    o = spark.createDataFrame([("m00", 1.0)], "market STRING, outcome DOUBLE")
    pos = {r.threshold: r for r in backtest.positions(backtest.panels(s, backtest.market_labels(s, c, o))).collect()}
    assert pos[0.5].entry_ts == T0 + 0.8 * DAY and pos[0.9].p_z == 0.95 and len(pos) == 9
    assert pos[0.5].cost == pytest.approx(0.55 + 0.01 + 0.07 * 0.55 * 0.45) and pos[0.5].ret == pytest.approx(1 - pos[0.5].cost)


def test_walk_forward_purges_overlap(spark):
    rows = [x for k in range(20) for x in panel_rows(k)]
    s = scores(spark, rows)
    c = closes(spark, [(f"m{k:02d}", T0 + 10 * DAY * k + (5 if k != 3 else 60) * DAY) for k in range(20)])
    o = spark.createDataFrame([(f"m{k:02d}", float(k % 2)) for k in range(20)], "market STRING, outcome DOUBLE")
    labels = backtest.market_labels(s, c, o)
    m = backtest.fold_members(backtest.market_blocks(labels)).collect()
    ends = {r.market: r.close_ts for r in labels.collect()}
    assert all(ends[r.market] <= r.test_start - DAY for r in m if r.role == "train")
    assert any(r.role == "purged" for r in m)
    out = backtest.run_backtest(s, c, o)
    assert out["folds"].count() == 4 and out["trials"].count() == 9
    d = out["deflated"].first()
    assert d.n_trials == 9 and d.n_returns == out["oos"].count()


def test_undefined_sharpe_is_null(spark):
    pos = spark.createDataFrame([(0.5, 0.2), (0.5, 0.2), (0.6, 0.1)], "threshold DOUBLE, ret DOUBLE")
    assert all(r.s is None for r in pos.groupBy("threshold").agg(backtest.sharpe().alias("s")).collect())


def test_case_verdicts(spark):
    rows = hourly("m", 200) + [(T0 + k * HOUR, f"x{k}", "m", "0xA", .3, .1, 0.) for k in range(3)]
    s, listed = scores(spark, rows), spark.createDataFrame([("m",), ("n",)], "market STRING")
    a, b = T0, T0 + 100 * HOUR

    def verdict(warm=True, **anchor):
        return case_study.verdict(case_study.cluster_summary(s, listed, a, b, **anchor), case_study.wallet_table(s, a, b, **anchor), warm).first().verdict

    assert verdict(False, address="0xA") == "cold_start" and verdict(address="nobody") == "no_anchor"
    assert verdict(pattern="w.") == "several_anchors" and verdict(address="0xA") == "untested"
    assert verdict(address="w1") == "timing_only"
    t = case_study.wallet_table(s, a, b, address="0xa")
    assert case_study.reported(t, 1).where("anchored").count() == 1
    assert {r.kind for r in case_study.missing_markets(listed, s).collect()} == {"without_trades"}


def test_rhat_and_ess_tell_mixing_from_stuck_chains(spark):
    import random
    rnd = random.Random(2)
    good = [("g", c, k, rnd.gauss(0, 1)) for c in range(4) for k in range(200)]
    stuck = [("s", c, k, rnd.gauss(3.0 * c, 1)) for c in range(4) for k in range(200)]
    d = spark.createDataFrame(good + stuck, "name STRING, chain INT, iter INT, value DOUBLE")
    r = {x.name: x.rhat for x in posterior.rhat(d).collect()}
    assert r["g"] < 1.02 and r["s"] > 1.5
    e = {x.name: x.ess for x in posterior.bulk_ess(d).collect()}
    assert 400 < e["g"] < 1300 and e["s"] < 40
    assert posterior.rhat(d.where("chain = 0 AND name = 'g'")).first().rhat is None


def test_wallets_of_equal_mean_rank_by_wallet(spark):
    s = scores(spark, [(T0, "1", "m", "a", .2, .1, 0.0), *((T0 + k, f"b{k}", "m", "b", p, .1, 0.0) for k, p in enumerate((.1, .2, .3)))])
    got = {r.wallet: (r.rank, r.mean_p_z) for r in case_study.wallet_table(s, T0 - 1, T0 + DAY).collect()}
    assert got == {"a": (1, .2), "b": (2, .2)}  # the sum of doubles is above 0.6


def test_parameter_summary_ranks_the_draws_once(spark, monkeypatch):
    rows = [("g", c, k, float((k * 37 + c * 11) % 101)) for c in range(2) for k in range(40)]
    d, ranked, rank = spark.createDataFrame(rows, "name string, chain int, iter int, value double"), [], posterior._rank_normal
    want = posterior.rhat(d).first().rhat
    monkeypatch.setattr(posterior, "_rank_normal", lambda split, value: ranked.append(value) or rank(split, value))
    got = posterior.parameter_summary(d).first()
    assert sorted(ranked) == ["far", "value"] and abs(got.rhat - want) < 1e-12 and got.ess > 0
