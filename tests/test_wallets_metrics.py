import math
import random

import pytest
from pyspark.sql import functions as F

from fillwatch.operators import features, metrics, vpin, wallets
from helpers import T0, by_market, logit, random_trades, trades


def greedy(vols, n):
    target, acc, b, out = sum(vols) / n, 0.0, 0, []
    for v in vols:
        out.append(b)
        acc += v
        if acc >= target and b < n - 1:
            b, acc = b + 1, 0.0
    return out


@pytest.mark.parametrize("n_buckets", [1, 4, 50])
def test_volume_buckets_match_sequential_rule(spark, n_buckets):
    rows = random_trades(5, ("a", "b"), 150)
    rows.append(("b", "w0", T0 + 50, 0.5, 9000.0, "BUY", "whale"))
    f = features.compute_features(trades(spark, rows))
    got = {r.tx_hash: r.bucket for r in vpin.volume_buckets(f, n_buckets).collect()}
    for rs in by_market(rows).values():
        s_bar = sum(r[4] for r in rs) / len(rs)
        assert [got[r[6]] for r in rs] == greedy([r[4] / s_bar for r in rs], n_buckets)


def test_native_sides_reverse_a_misclassified_market(spark):
    price, rows = 0.5, []
    for k in range(12):
        first = k < 6
        price = price + 0.02 if (k % 2 == 0) == first else price + 0.021
        rows.append(("m", "A" if first else "B", T0 + k, round(price, 4), 10.0, "BUY" if first else ("BUY" if k % 2 else "SELL"), f"{k:02d}"))
    f = features.compute_features(trades(spark, rows))
    native = {r.wallet: r.score for r in wallets.vpin_scores(f, 2, native=True).collect()}
    assert native["A"] == pytest.approx(1.0) and native["B"] == pytest.approx(0.0)


def test_wash_scores_against_all_pairs(spark):
    rows = random_trades(9, ("a",), 200, wallets=4, span=40_000)
    f = features.compute_features(trades(spark, rows))
    rs = by_market(rows)["a"]
    sign = {r[6]: 0 for r in rs}
    for p, c in zip(rs, rs[1:]):
        d = logit(c[3]) - logit(p[3])
        sign[c[6]] = (d > 0) - (d < 0)
    for w in (60.0, 900.0, 7200.0):
        got = {r.wallet: r.score for r in wallets.wash_scores(f, w).collect()}
        for name in got:
            mine = [r for r in rs if r[1] == name and sign[r[6]] != 0]
            hit = sum(any(sign[a[6]] != sign[b[6]] and abs(a[2] - b[2]) <= w for b in mine) for a in mine)
            assert got[name] == pytest.approx(hit / len(mine) if mine else 0.0)


def test_prefilter_flags_at_least_a_tenth_and_validates(spark):
    rows = random_trades(3, ("a", "b"), 100, wallets=11)
    t = trades(spark, rows)
    f, ids = features.compute_features(t), features.wallet_ids(t)
    assert wallets.prefilter(f, ids, quantile=0.99).where("flagged").count() == 2
    assert wallets.prefilter(f, ids, quantile=0.5).where("flagged").count() == 6
    with pytest.raises(ValueError):
        wallets.prefilter(f, ids, quantile=1.0)
    with pytest.raises(ValueError):
        wallets.combine_and_flag(ids, ["wallet_id"], [-1.0])


def test_auc_curve_and_ties(spark):
    df = spark.createDataFrame([(0, .1), (0, .4), (1, .4), (1, .8)], "z_true INT, z_score DOUBLE")
    assert metrics.roc_auc(df).first().auc == pytest.approx(0.875)
    pts = {(r.fpr, r.tpr) for r in metrics.roc_curve(df).collect()}
    assert pts == {(0.0, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 1.0)}
    one = df.where("z_true = 1")
    assert metrics.roc_auc(one).first().auc == 0.5
    assert {(r.fpr, r.tpr) for r in metrics.roc_curve(one).collect()} == {(0.0, 0.0), (1.0, 1.0)}


@pytest.mark.parametrize("block", [3, 16, 10_000])
def test_kendall_counts_without_pairs(spark, block):
    rnd = random.Random(4)
    pts = [(rnd.randrange(9), rnd.randrange(9)) for _ in range(90)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "a DOUBLE, b DOUBLE")
    con = tie_a = tie_b = 0
    for i in range(90):
        for j in range(i):
            x, y = pts[i][0] - pts[j][0], pts[i][1] - pts[j][1]
            con += (x * y > 0) - (x * y < 0)
            tie_a, tie_b = tie_a + (x != 0), tie_b + (y != 0)
    assert metrics.kendall_tau(df, "a", "b", block).first().tau == pytest.approx(con / math.sqrt(tie_a * tie_b))


def test_constant_side_has_no_rank_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a DOUBLE, b DOUBLE")
    assert wallets.rank_correlation(df, "a", "b").first().rho is None
    assert metrics.kendall_tau(df, "a", "b").first().tau is None


def test_rank_correlation_of_sums_that_differ_in_each_evaluation(spark):
    noisy = F.udf(lambda k: k + random.random() * 1e-9, "double").asNondeterministic()
    pairs = spark.range(60).select(noisy("id").alias("a"), noisy("id").alias("b"))
    row = wallets.rank_correlation(pairs, "a", "b").first()
    assert row.n == 60 and row.rho == pytest.approx(1.0)


def test_rank_correlation_of_repeated_pairs(spark):
    rows = [(1.0, 2.0)] * 3 + [(2.0, 1.0), (3.0, 4.0), (3.0, 4.0), (None, 9.0), (9.0, None)]
    row = wallets.rank_correlation(spark.createDataFrame(rows, "a DOUBLE, b DOUBLE"), "a", "b").first()
    ra, rb = [2, 2, 2, 4, 5.5, 5.5], [3, 3, 3, 1, 5.5, 5.5]
    u, v = [x - 3.5 for x in ra], [x - 3.5 for x in rb]
    dot = lambda x, y: sum(i * j for i, j in zip(x, y))
    assert row.n == 6 and row.rho == pytest.approx(dot(u, v) / math.sqrt(dot(u, u) * dot(v, v)))


def test_jaccard_with_empty_runs(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "run_id STRING")
    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3)], "run_id STRING, wallet INT")
    # pairs: ab 1/3, cd both empty 1, the other four 0
    assert metrics.pairwise_jaccard(members, runs).first().mean_jaccard == pytest.approx((1 / 3 + 1) / 6)


def test_recall_gate_and_top_k(spark):
    s = spark.createDataFrame([(f"w{k}", k, float(10 - k)) for k in range(10)], "wallet STRING, wallet_id INT, score DOUBLE")
    ins = spark.createDataFrame([("w0",), ("w5",)], "wallet STRING")
    r = metrics.recall_at_k(s, ins).first()
    assert (r.k, r.n_found, r.recall, r.worst_rank) == (2, 1, 0.5, 6)
    none = metrics.recall_at_k(s, ins.limit(0)).first()
    assert none.recall == 1.0
    assert [r.wallet_id for r in wallets.top_k(s, 3).collect()] == [0, 1, 2]


def test_two_tier_pushes_unflagged_below(spark):
    df = spark.createDataFrame([(0, .2, True), (1, .9, False), (2, .1, True), (3, .5, False)], "wallet_id INT, theta DOUBLE, flagged BOOLEAN")
    got = {r.wallet_id: r.tier_score for r in wallets.two_tier(df).collect()}
    assert got == {0: .2, 2: .1, 1: pytest.approx(.1 - 1 - .25), 3: pytest.approx(.1 - 1 - .75)}


def test_mean_interval_uses_student_t(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0)], "m STRING, v DOUBLE")
    got = {r.m: r.half_width for r in metrics.mean_interval(df, ["m"], "v").collect()}
    assert got["a"] == pytest.approx(4.302652729911275 / math.sqrt(3), rel=1e-9) and got["b"] == 0.0
