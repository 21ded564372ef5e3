import json

import pytest
from pyspark.sql import functions as F

from fillwatch.config import ModelParams
from fillwatch.operators import calibration, em, features
from fillwatch.sources import files, venues
from helpers import random_trades, trades


def texts(spark, docs):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "value STRING")


def test_trade_payload_aliases_and_defaults(spark):
    docs = [{"timestamp": "1700000000", "price": "0.43", "size": "12", "proxyWallet": "0xA", "side": "buy", "transactionHash": "h1", "conditionId": "c", "asset": "t"},
            {"timestamp": 1700000000.9, "price": 0.5, "wallet": "0xB", "transaction_hash": "h2", "condition_id": "d"}]
    a, b = venues.normalize_trades(texts(spark, docs)).orderBy("tx_hash").collect()
    assert (a.market, a.wallet, a.ts, a.price, a.size, a.side, a.asset_id) == ("c", "0xA", 1700000000, 0.43, 12.0, "BUY", "t")
    assert (b.market, b.wallet, b.ts, b.size, b.side) == ("d", "0xB", 1700000000, 0.0, "")


def test_market_tags_of_both_shapes(spark):
    docs = [{"id": "1", "conditionId": "c1", "volume": "10.5", "closed": True, "tags": ["Politics", "US"], "endDate": None},
            {"id": "2", "condition_id": "c2", "tags": [{"label": "A"}, {"name": "B"}, {"slug": "s"}, {"x": 1}]}, {"id": "3"}]
    got = {r.id: r for r in venues.normalize_markets(texts(spark, docs)).collect()}
    assert got["1"].tags == ["Politics", "US"] and got["2"].tags == ["A", "B", "s"] and got["3"].tags == []
    assert got["1"].volume == 10.5 and got["2"].condition_id == "c2" and got["3"].volume == 0.0


def test_anonymous_rows_and_strictness(spark):
    ok = {"trade_id": "t1", "ticker": "K", "created_time": "2026-06-30T17:10:01.851Z", "count_fp": "43.33", "yes_price_dollars": "0.46", "taker_side": "yes"}
    rows = [ok, {**ok, "trade_id": "t2", "yes_price_dollars": None, "no_price": 30, "taker_side": "NO"}, {**ok, "trade_id": ""},
            {**ok, "trade_id": "t3", "created_time": "later"}, {**ok, "trade_id": "t4", "count_fp": None}, {**ok, "trade_id": "t5", "yes_price_dollars": "x"}]
    df = venues.normalize_anonymous(texts(spark, [{"trades": rows, "cursor": ""}, {"cursor": ""}]))
    got = {r.tx_hash: r for r in df.collect()}
    assert got["t1"].price == 0.46 and got["t1"].size == 43.33 and got["t1"].ts == 1782839401 and got["t1"].wallet is None and got["t1"].side == "BUY"
    assert got["t2"].price == pytest.approx(0.7) and got["t2"].side == "SELL"
    assert [got[k].error for k in ("", "t3", "t4", "t5")] == ["missing trade_id", "bad created_time", "bad count", "bad price"]
    with pytest.raises(Exception, match="bad payload row"):
        venues.strict(df).collect()


def test_feed_frames(spark):
    pay = {"asset": "a", "conditionId": "c", "price": 0.4, "proxyWallet": "w", "side": "BUY", "size": 5, "timestamp": 1700000001, "transactionHash": "h"}
    env = {"topic": "activity", "type": "trades", "timestamp": 1700000009500, "payload": pay}
    no_clock = {**env, "payload": {k: v for k, v in pay.items() if k != "timestamp"}}
    docs = [env, no_clock, "", "  ", "{torn", "[1]", {**env, "topic": "prices"}, {**env, "payload": "x"}, {**env, "payload": {**pay, "price": "abc"}}]
    df = venues.decode_frames(texts(spark, docs))
    assert {r["kind"]: r["count"] for r in df.groupBy("kind").count().collect()} == {"trade": 2, "keepalive": 2, "bad": 4, "other": 1}
    assert sorted(r.ts for r in df.where("kind = 'trade'").collect()) == [1700000001, 1700000009]
    assert venues.quarantined(texts(spark, docs)).count() == 4
    assert venues.feed_trades(texts(spark, docs), ["C"]).count() == 2


def test_feed_frames_are_parsed_once(spark):
    plan = venues.feed_trades(texts(spark, ["{}"]), ["C"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 2  # envelope and payload


def test_capture_round_trip_skips_bad_lines(spark, tmp_path):
    t = trades(spark, random_trades(1, n=10))
    files.append_capture(t, str(tmp_path / "cap"))
    (tmp_path / "cap" / "extra.json").write_text('\n{"timestamp": 1, "pri\n   \n')
    good, bad = files.read_capture(spark, str(tmp_path / "cap"))
    assert good.count() == 20 and bad.count() == 1
    assert files.compact_capture(spark, str(tmp_path / "cap"), str(tmp_path / "pq")) == 20
    a = [r.tx_hash for r in files.read_replay(spark, str(tmp_path / "pq"), "parquet").collect()]
    b = [r[6] for r in sorted(random_trades(1, n=10), key=lambda r: (r[2], r[6]))]
    assert a == b


def test_canonical_capture_is_reproducible(spark, tmp_path):
    t = trades(spark, random_trades(2, n=30))

    def dump(df, name):
        files.write_capture(df, str(tmp_path / name), 1)
        return "".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*")))

    assert dump(t, "a") == dump(t.orderBy(F.rand(1)), "b")


def test_scores_need_replay_provenance(spark, tmp_path):
    s = spark.createDataFrame([(1.0, "h", "m", "w", .5, .1, None)], "ts DOUBLE, tx_hash STRING, market STRING, wallet STRING, p_z DOUBLE, p_v DOUBLE, x_mean DOUBLE")
    path = str(tmp_path / "s")
    with pytest.raises(ValueError):
        files.replay_provenance(spark, path)
    files.write_scores(s, path, "live", "feed")
    with pytest.raises(ValueError):
        files.replay_provenance(spark, path)
    files.write_scores(s, path, "replay", "feed")
    assert files.replay_provenance(spark, path).first().mode == "replay"
    r = files.load_scores(spark, path).first()
    assert r.x_mean == 0.0 and r.market == "m"
    assert files.load_cluster_scores(spark, path, spark.createDataFrame([("z",)], "market STRING")).count() == 0
    (tmp_path / "s" / "part-bad.json").write_text("{oops\n")
    with pytest.raises(Exception):
        files.load_scores(spark, path).collect()


def test_metadata_shapes(spark, tmp_path):
    (tmp_path / "a.meta.json").write_text(json.dumps({"close_time": "2024-01-01T00:00:00Z", "result": "yes"}))
    (tmp_path / "b.meta.json").write_text(json.dumps({"ticker": "K2", "close_ts": 5, "outcome": 0.97, "settlement": "down"}))
    rec = files.metadata_records(spark, str(tmp_path / "*.meta.json"), sidecars=True)
    assert {(r.market, r.close_ts) for r in files.resolutions(rec).collect()} == {("a", 1704067200.0), ("K2", 5.0)}
    assert {(r.market, r.outcome) for r in files.outcomes(rec).collect()} == {("a", 1.0), ("K2", 0.0)}
    (tmp_path / "obj.json").write_text(json.dumps({"m1": 12, "m2": {"endDate": "2024-01-01"}, "m3": {"x": 1}}))
    obj = files.metadata_records(spark, str(tmp_path / "obj.json"))
    assert {(r.market, r.close_ts) for r in files.resolutions(obj).collect()} == {("m1", 12.0), ("m2", 1704067200.0)}
    (tmp_path / "arr.json").write_text(json.dumps([{"slug": "s", "close_ts": 3, "outcome": True}, {"close_ts": 4, "outcome": "maybe"}]))
    arr = files.metadata_records(spark, str(tmp_path / "arr.json"))
    assert {r.market for r in files.resolutions(arr).collect()} == {"s", "row1"}
    assert {(r.market, r.outcome) for r in files.outcomes(arr).collect()} == {("s", 1.0)}


def test_outcome_types(spark):
    """The text "1.0" settles nothing, the number does."""
    values = {"a": '{"outcome": "1.0"}', "b": '{"outcome": 1.0}', "c": '{"outcome": "1.0", "result": "no"}', "d": '{"outcome": 0}', "e": "1.0", "f": '{"outcome": 0.5}', "g": '{"outcome": "1"}'}
    rec = spark.createDataFrame(list(values.items()), "key STRING, value STRING")
    assert {r.market: r.outcome for r in files.outcomes(rec).collect()} == {"b": 1.0, "c": 0.0, "d": 0.0, "e": 1.0, "g": 1.0}


def test_outcome_words(spark):
    words = {"YES": 1.0, " up ": 1.0, "True": 1.0, "no": 0.0, "0": 0.0, "0.97": None, "unsettled": None}
    df = spark.createDataFrame([(w,) for w in words], "w STRING").select("w", files.verdict_value(F.col("w")).alias("v"))
    assert {r.w: r.v for r in df.collect()} == words


def manifest(**kw):
    return {"schema_version": 1, "case": "x", "markets": [{"condition_id": "c", "slug": "s", "question": "q"}],
            "analysis_window": {"start": "2024-01-01T00:00:00Z", "end": "2024-01-05T00:00:00Z"}, "wallet_anchor": {"address": "0xA"},
            "doj_timeline": [{"ts": "2024-01-03T00:00:00Z", "label": "b"}, {"ts": "2024-01-02T00:00:00Z", "label": "a"}], **kw}


def test_manifest_validation(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps(manifest(), indent=1))
    m = files.load_manifest(spark, str(p))
    assert [r.label for r in files.manifest_timeline(m).collect()] == ["a", "b"] and files.manifest_markets(m).first().market == "c"
    for bad in (manifest(schema_version=9), manifest(markets=[]), manifest(analysis_window={"start": "2024-02-01", "end": "2024-01-01"}),
                manifest(markets=[{"condition_id": "c", "slug": "s"}, {"slug": "t"}]), manifest(doj_timeline=[{"ts": "soon", "label": "a"}]),
                manifest(doj_timeline=[{"ts": "2024-01-03T00:00:00Z"}]), manifest(wallet_anchor={"address_pattern": "(0x"})):
        p.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            files.load_manifest(spark, str(p))


def replicate(seed, **kw):
    return {"seed": seed, "schema_version": 1, "L": 99, "ranks": {"q_01": seed * 7 % 100}, "hits90": {"q_01": seed % 10 != 0}, "theta_hits90": [True, seed % 2 == 0],
            "z_auc": 0.8, "flags": {"vem_converged": True, "laplace_fallback": False, "failed": False}, "size": {"K": 1, "T": 2, "n_wallets": 3}, **kw}


def test_replicate_store(spark, tmp_path):
    d = tmp_path / "r"
    d.mkdir()
    rows = [replicate(k) for k in range(60)] + [replicate(3), replicate(60, ranks=None), replicate(61, flags={"vem_converged": False})]
    (d / "a.json").write_text("\n".join(map(json.dumps, rows)))
    df = files.load_replicates(spark, str(d))
    assert df.count() == 62
    f = calibration.failure_accounting(df).first()
    assert (f.n_failed, f.n_degenerate, f.n_scored) == (1, 1, 61)
    assert calibration.usable(df).count() == 60 and calibration.usable(df, True).count() == 61
    cov = {r.component: r for r in calibration.coverage_with_wallets(calibration.usable(df)).collect()}
    assert cov["q_01"].n_hits == 54 and cov["q_01"].in_range and cov["theta_w"].verdict == "fail"
    assert files.remaining_keys(spark.range(70).withColumnRenamed("id", "seed"), df).count() == 8
    (d / "b.json").write_text(json.dumps(replicate(99, schema_version=2)))
    with pytest.raises(ValueError):
        files.load_replicates(spark, str(d))


def test_miscalibrated_ranks_are_rejected(spark):
    good = [(k, "a", k % 100, True) for k in range(400)]
    bad = [(k, "b", (k % 2) * 99, True) for k in range(400)]
    df = spark.createDataFrame(good + bad, "seed INT, component STRING, rank INT, hit BOOLEAN")
    got = {r.component: r for r in calibration.rank_uniformity(df, 99).collect()}
    assert not got["a"].rejected and got["b"].rejected and got["b"].shape == "too narrow" and got["b"].band_violation
    with pytest.raises(ValueError):
        calibration.rank_uniformity(df, 50)


def test_benchmark_rows_skip_missing_gate(spark):
    df = spark.createDataFrame([("a", json.dumps({"method": "em", "gate": {"pooled_auc": .9, "gate_pass": True}, "timings": {"mean_sec_per_run": 2.0}})),
                                ("b", json.dumps({"method": "pg", "gate": None}))], "label STRING, value STRING")
    r = files.benchmark_rows(df).collect()
    assert len(r) == 1 and r[0].pooled_auc == .9 and r[0].ci_half_width == 0.0


def test_warm_start_artifact(spark, tmp_path):
    f = features.compute_features(trades(spark, random_trades(1, n=30)))
    fit = em.fit_em(f, n_iter=1)
    files.save_warm_start(fit, spark, str(tmp_path / "art"))
    p, m_s, s_s, m_z, theta = files.load_warm_start(spark, str(tmp_path / "art"))
    assert p == fit.params and (m_s, s_s, m_z) == (fit.m_s, fit.s_s, fit.m_z) and theta.count() == fit.theta.count()
    with pytest.raises(ValueError):
        files.warm_start_from({"params": {"beta_S": 0.3}})
    with pytest.raises(KeyError):
        files.warm_start_from({})
    assert files.warm_start_from({"best_restart": {"params": {"q_01": 0.2}}})[0] == ModelParams(q_01=0.2)
    assert files.cold_start()[0].sigma2_0 == 0.1


def test_summary_and_csv(spark, tmp_path):
    files.write_summary(spark.createDataFrame([(1, None)], "n INT, p DOUBLE"), str(tmp_path / "s"), 3, source="x")
    got = json.loads(next((tmp_path / "s").glob("part-*")).read_text())
    assert got == {"n": 1, "p": None, "schema_version": 3, "source": "x"}
    files.write_table_csv(spark.createDataFrame([("a", 1)], "w STRING, r INT"), str(tmp_path / "c"))
    assert max((tmp_path / "c").glob("part-*"), key=lambda f: f.stat().st_size).read_text().splitlines() == ["w,r", "a,1"]


def test_processed_markets_prune_by_partition(spark, tmp_path):
    t = trades(spark, random_trades(4, ("a", "b", "c"), 20))
    f = features.compute_features(t)
    files.save_processed(f, features.wallet_ids(t), str(tmp_path / "p"))
    got, ids = files.load_processed(spark, str(tmp_path / "p"), ["b"])
    assert got.count() == 20 and ids.count() == t.select("wallet").distinct().count()
    assert "PartitionFilters: [isnotnull(market" in got._jdf.queryExecution().executedPlan().toString()
