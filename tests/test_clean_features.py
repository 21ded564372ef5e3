import math

import pytest
from pyspark.sql import functions as F

from fillwatch.operators import clean, features
from fillwatch.operators.ordered import average_ranks, global_position, global_prefix, group_quantiles
from helpers import T0, brute_features, by_market, random_trades, trades


def test_cleaning_rules_and_first_copy(spark):
    rows = [("m", "A", 10, 0.5, 1.0, "BUY", "h1"), ("m", "B", 9, 0.4, 2.0, "BUY", "h1"), ("m", "A", 11, 1.0, 1.0, "BUY", "h2"),
            ("m", "A", 11, 0.5, 0.0, "BUY", "h3"), ("m", "", 11, 0.5, 1.0, "BUY", "h4"), ("m", None, 11, 0.5, 1.0, "BUY", "h5"),
            ("m", "A", 11, 0.5, 1.0, "BUY", ""), ("m", "A", 12, 0.5, 1.0, "SELL", "h6")]
    df = trades(spark, rows)
    got = {(r.tx_hash, r.wallet) for r in clean.clean_trades(df).collect()}
    assert got == {("h1", "B"), ("h6", "A")}
    assert {r.tx_hash for r in clean.clean_trades(df, require_wallet=False).collect()} == {"h1", "h4", "h5", "h6"}


def test_dedupe_shrinks_copies_before_the_shuffle(spark):
    df = trades(spark, [("m", "A", k, 0.5, 1.0, "BUY", "same") for k in range(50)])
    kept = clean.clean_trades(df)
    assert kept.count() == 1
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan
    first = clean.keep_first(df, "tx_hash", ["ts"])
    assert first.first().ts == 0 and "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 7])
@pytest.mark.parametrize("width", [600, 3600, 10**7])
def test_features_match_brute_force_for_any_chunking(spark, partitions, n, width):
    partitions(n)
    rows = random_trades(1)
    want = brute_features(rows)
    df = trades(spark, rows).orderBy(F.rand(3))
    for r in features.compute_features(df, width).collect():
        i, d, l, y = want[r.tx_hash]
        assert r.i == i and r.delta == d
        assert r.log_size_ratio == pytest.approx(l, abs=1e-9) and r.y == pytest.approx(y, abs=1e-12)


def test_causal_mean_includes_current_trade(spark):
    rows = [("m", "A", T0 + k, 0.5, float(s), "BUY", f"h{k}") for k, s in enumerate([2, 4, 9])]
    got = [r.log_size_ratio for r in features.causal_features(trades(spark, rows)).orderBy("i").collect()]
    assert got == pytest.approx([0.0, math.log(4 / 3), math.log(9 / 5)])


def test_adding_a_market_changes_nothing_else(spark):
    rows = random_trades(2, ("a", "b"))
    one = {r.tx_hash: r.log_size_ratio for r in features.compute_features(trades(spark, [r for r in rows if r[0] == "a"])).collect()}
    two = {r.tx_hash: r.log_size_ratio for r in features.compute_features(trades(spark, rows)).collect() if r.market == "a"}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-12) for k in one)


def test_wallet_ids_by_first_appearance(spark):
    rows = [("m1", "A", 1, .5, 1., "", "a"), ("m1", "B", 2, .5, 1., "", "b"), ("m1", "A", 3, .5, 1., "", "c"),
            ("m2", "C", 1, .5, 1., "", "d"), ("m2", "A", 2, .5, 1., "", "e")]
    ids = features.wallet_ids(trades(spark, rows))
    assert {r.wallet: r.wallet_id for r in ids.collect()} == {"A": 0, "B": 1, "C": 2}
    more = trades(spark, rows + [("m0", "Z", 1, .5, 1., "", "z")])
    assert {r.wallet: r.wallet_id for r in features.extend_ids(ids, more).collect()} == {"A": 0, "B": 1, "C": 2, "Z": 3}


def test_shortlist_keeps_elapsed_time(spark):
    rows = [("m", "A" if k % 2 == 0 else "B", T0 + k, .5, 1., "", f"{k:03d}") for k in range(21)]
    f = features.compute_features(trades(spark, rows))
    keep = spark.createDataFrame([("A",)], "wallet STRING")
    got = clean.shortlist_wallets(f, keep).orderBy("i").collect()
    assert len(got) == 11 and [r.delta for r in got] == [0.0] + [2.0] * 10
    assert clean.shortlist_wallets(f, keep, min_trades=12).count() == 0


def test_market_tail_and_newest(spark):
    rows = [("m", "A", T0 + 10 * k, .5, 1., "", f"{k:03d}") for k in range(8)]
    t = clean.market_tail(features.compute_features(trades(spark, rows)), 3).orderBy("i").collect()
    assert [(r.i, r.delta) for r in t] == [(0, 0.0), (1, 10.0), (2, 10.0)]
    assert {r.tx_hash for r in clean.newest(trades(spark, rows), 2).collect()} == {"006", "007"}


def test_holdout_rounds_half_to_even(spark):
    rows = [("m", "A", T0 + k, .5, 1., "", f"{k:03d}") for k in range(5)]
    f = features.compute_features(trades(spark, rows))
    n = clean.holdout_split(f, 0.5).where("split = 'tail'").count()
    assert n == round(2.5)


def test_anchor_matches_address_or_whole_pattern(spark):
    t = trades(spark, [("m", w, 1, .5, 1., "", w) for w in ("0xAB", "0xABC", "q")])
    assert {r.wallet for r in clean.anchored_wallets(t, address="0xab").where("anchored").collect()} == {"0xAB"}
    assert {r.wallet for r in clean.anchored_wallets(t, pattern="0xAB.?").where("anchored").collect()} == {"0xAB", "0xABC"}
    assert clean.anchored_wallets(t).where("anchored").count() == 0


def test_guards(spark):
    t = trades(spark, [("m", None, 1, .5, 1., "", "a")])
    with pytest.raises(ValueError):
        clean.require_identity(t, "wallet")
    with pytest.raises(ValueError):
        features.require_dataset(t, features.compute_features(clean.clean_trades(t)))
    with pytest.raises(ValueError):
        clean.require_single(spark.createDataFrame([(1,), (2,)], "L INT"), "L")


def test_backwards_rows(spark):
    df = spark.createDataFrame([("m", k, t) for k, t in enumerate([5, 7, 6, 7, 9, 1])], "market STRING, seq LONG, ts LONG")
    got = {(r.seq, r.late_by) for r in features.backwards_rows(df, rows_per_chunk=2).collect()}
    assert got == {(2, 1), (5, 8)}


@pytest.mark.parametrize("n", [1, 5])
def test_global_order_tools(spark, n):
    vals = [3.0, 1.0, 2.0, 2.0, 2.0, 5.0, 4.0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vals)], "k INT, v DOUBLE")
    pos = {r.k: r.pos for r in global_position(df, ["v", "k"], partitions=n).collect()}
    assert sorted(pos, key=pos.get) == sorted(range(7), key=lambda k: (vals[k], k)) and sorted(pos.values()) == list(range(7))
    run = {r.v: r.s for r in global_prefix(df.groupBy("v").count(), ["v"], {"s": F.col("count")}, n).collect()}
    assert run == {1.0: 1, 2.0: 4, 3.0: 5, 4.0: 6, 5.0: 7}
    assert {r.v: r.avg_rank for r in average_ranks(df, "v").collect()}[2.0] == 3.0


def test_group_quantiles_interpolate(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 2, 10]] + [("b", 7.0)], "g STRING, v DOUBLE")
    got = {r.g: (r.q25, r.q50) for r in group_quantiles(df, ["g"], "v", {"q25": .25, "q50": .5}).collect()}
    assert got == {"a": (1.75, 2.0), "b": (7.0, 7.0)}


def test_ordering_breaks_ties_by_hash(spark):
    rows = [("m", "A", T0, .5, 1., "", h) for h in ("c", "a", "b")]
    got = [r.tx_hash for r in features.compute_features(trades(spark, rows)).orderBy("i").collect()]
    assert got == [r[6] for r in by_market(rows)["m"]] == ["a", "b", "c"]
