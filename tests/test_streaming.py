import pytest
from pyspark.sql import functions as F

from fillwatch.config import ModelParams, OnlineConfig
from fillwatch.operators import scoring
from fillwatch.sources import files
from fillwatch.streaming import jobs
from helpers import T0, by_market, random_trades, trades

P = ModelParams(sigma2_0=1e-5, sigma2_1=1e-3, tau2_0=0.8, tau2_1=0.05)


def feed(spark, rows, folder):
    files.as_capture(trades(spark, rows)).coalesce(1).write.mode("append").json(folder)


def drain(stream, base, fmt="parquet"):
    jobs.sink(stream, f"{base}/out", f"{base}/chk", fmt).awaitTermination()


def test_stream_in_two_batches_equals_batch_replay(spark, tmp_path):
    base = str(tmp_path)
    rows = random_trades(21, ("a", "b"), 60)
    cutoff = T0 + 100_000
    for part in ([r for r in rows if r[2] < cutoff], [r for r in rows if r[2] >= cutoff]):
        feed(spark, part, f"{base}/in")
        drain(jobs.score_stream(jobs.unique_trades(jobs.read_capture_stream(spark, f"{base}/in"), "30 days"), P), base)
    live = {r.tx_hash: r.p_z for r in spark.read.parquet(f"{base}/out").where("kind = 'scored'").collect()}
    want = {r.tx_hash: r.p_z for r in scoring.online_scores(trades(spark, rows), P).collect()}
    assert live.keys() == want.keys() and all(live[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_late_trades_are_marked_or_fatal(spark, tmp_path):
    base = str(tmp_path)
    rs = by_market(random_trades(22, ("a",), 20))["a"]
    feed(spark, rs[5:], f"{base}/in")
    stream = lambda late: jobs.score_stream(jobs.read_capture_stream(spark, f"{base}/in"), P, OnlineConfig(), late=late)
    drain(stream("mark"), base)
    feed(spark, rs[:5], f"{base}/in")
    drain(stream("mark"), base)
    got = spark.read.parquet(f"{base}/out")
    assert got.where("kind = 'late'").count() == 5 and got.where("late_by <= 0").count() == 0
    feed(spark, [("a", "w", T0 - 10, .5, 1., "BUY", "old")], f"{base}/in")
    with pytest.raises(Exception):
        drain(stream("fail"), base)


def test_equal_timestamps_are_not_late(spark, tmp_path):
    base = str(tmp_path)
    for h in ("b", "a"):
        feed(spark, [("m", "w", T0, .5, 1., "BUY", h)], f"{base}/in")
        drain(jobs.score_stream(jobs.read_capture_stream(spark, f"{base}/in"), P), base)
    assert spark.read.parquet(f"{base}/out").where("kind = 'scored'").count() == 2


def test_frames_route_and_sink(spark, tmp_path):
    base = str(tmp_path)
    frame = ('{"topic":"activity","type":"trades","timestamp":1,"payload":{"price":"0.5","size":"1","timestamp":5,'
             '"transactionHash":"h","conditionId":"c","proxyWallet":"w","side":"buy"}}')
    spark.createDataFrame([(frame,), ("{bad",), ("",)], "value STRING").coalesce(1).write.text(f"{base}/in")
    df = jobs.read_frame_stream(spark, f"{base}/in", 1)
    drain(df, base)
    got = {r.kind: r.raw for r in spark.read.parquet(f"{base}/out").collect()}
    assert set(got) >= {"trade", "bad"}


def test_restart_does_not_repeat_hashes(spark, tmp_path):
    base = str(tmp_path)
    rows = random_trades(23, ("a",), 15)
    for _ in range(2):
        feed(spark, rows, f"{base}/in")
        jobs.sink_capture(jobs.unique_trades(jobs.read_capture_stream(spark, f"{base}/in"), "30 days"), f"{base}/out", f"{base}/chk").awaitTermination()
    assert spark.read.json(f"{base}/out").count() == 15


def test_window_counts(spark, tmp_path):
    base = str(tmp_path)
    feed(spark, [("m", "w", T0 + k * 600, .5, 2., "BUY", f"{k}") for k in range(40)], f"{base}/in")
    drain(jobs.feed_counts(jobs.read_capture_stream(spark, f"{base}/in"), "1 hour", "0 seconds"), base)
    out = spark.read.parquet(f"{base}/out")
    assert out.agg(F.max("n_trades")).first()[0] == 6 and out.agg(F.sum("volume")).first()[0] > 60


def test_every_row_is_routed_once(spark, tmp_path):
    base = str(tmp_path)
    rs = [("m", "w", T0 + 1000 * k, .5, 1., "BUY", f"h{k}") for k in range(20)]
    route = lambda: jobs.route_trades(jobs.read_capture_stream(spark, f"{base}/in"), 5000.0, 2)
    feed(spark, rs[10:] + rs[10:12] + [("m", "w", T0, 0., 1., "BUY", "bad")], f"{base}/in")
    drain(route(), base)
    feed(spark, rs[:3] + rs[15:17], f"{base}/in")
    jobs.end_capture(spark, f"{base}/in")
    drain(route(), base)
    got = {r.kind: r.n for r in spark.read.parquet(f"{base}/out").groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert got == {"trade": 10, "duplicate": 4, "invalid": 1, "late": 3}
    assert spark.read.parquet(f"{base}/out").where("kind = 'late' AND late_by <= 5000").count() == 0


def test_end_marker_closes_open_windows(spark, tmp_path):
    base = str(tmp_path)
    feed(spark, [("m", "w", T0 + k * 600, .5, 2., "BUY", f"{k}") for k in range(40)], f"{base}/in")
    jobs.end_capture(spark, f"{base}/in")
    drain(jobs.feed_counts(jobs.read_capture_stream(spark, f"{base}/in")), base)
    out = spark.read.parquet(f"{base}/out")
    assert out.agg(F.sum("n_trades")).first()[0] == 40 and out.where("market <> 'm'").count() == 0 and out.agg(F.sum("n_seconds")).first()[0] == 40


class _Handle:
    """State of one key in memory, counting the calls that cross to the store."""

    def __init__(self):
        self.calls, self.kept = 0, {}

    def getValueState(self, name, *schema):
        return _State(self, name)

    getListState = getMapState = getValueState


class _State:
    def __init__(self, handle, name):
        self.h, self.name = handle, name

    def _call(self):
        self.h.calls += 1
        return self.h.kept.setdefault(self.name, [])

    def exists(self):
        return bool(self._call())

    def get(self):
        rows = self._call()
        return rows[0] if self.name in ("top", "market") else iter(rows)

    def update(self, row):
        self._call()[:] = [row]

    def put(self, rows):
        self._call()[:] = rows

    def appendValue(self, row):
        self._call().append(row)

    def containsKey(self, key):
        return key in dict(self._call())

    def getValue(self, key):
        return dict(self._call())[key]

    def updateValue(self, key, row):
        self._call().append((key, row))


def test_router_does_not_ask_the_store_for_each_row():
    import pandas as pd
    h, r = _Handle(), jobs.TradeRouter(100.0, ["tx_hash", "ts"])
    r.init(h)
    batch = lambda lo, hi: pd.DataFrame({"ok": True, "tx_hash": [f"h{k}" for k in range(lo, hi)] * 2, "ts": [float(k) for k in range(lo, hi)] * 2})
    kinds = [list(x["kind"]) for b in ((0, 500), (450, 900)) for x in r.handleInputRows((0,), iter([batch(*b)]), None)]
    assert kinds[0] == ["trade"] * 500 + ["duplicate"] * 500 and kinds[1][:50] == ["duplicate"] * 50 and kinds[1][50:450] == ["trade"] * 400
    assert h.calls < 20 and min(ts for _, tss in h.kept["seen"] for ts in tss) == 799.0


def test_scorer_sorts_a_micro_batch_and_emits_slices(monkeypatch):
    import numpy as np
    import pandas as pd
    monkeypatch.setattr(jobs, "SLICE_ROWS", 64)
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"market": "m", "ts": rng.integers(0, 90, 300), "tx_hash": [f"{k * 7919 % 1000}" for k in range(300)], "wallet": [f"w{k % 9}" for k in range(300)],
                         "price": rng.uniform(.05, .95, 300), "size": rng.uniform(1, 9, 300)})
    s = jobs.MarketScorer(P, OnlineConfig(), jobs.Prior(), (0.0, 1.0, 0.0), "fail")
    s.init(_Handle())
    parts = list(s.handleInputRows(("m",), iter([rows[:100], rows[100:]]), None))
    assert max(map(len, parts)) == 64
    got = pd.concat(parts)
    want = rows.sort_values(["ts", "tx_hash"])
    assert got["tx_hash"].tolist() == want["tx_hash"].tolist() and (got["kind"] == "scored").all()


def test_frozen_scorer_neither_walks_trades_nor_asks_for_each_wallet(monkeypatch):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(4)
    n = 700
    rows = pd.DataFrame({"market": "m", "ts": np.sort(rng.integers(0, 400, n)), "tx_hash": [f"{k:04d}" for k in range(n)], "wallet": [f"w{k % 90}" for k in range(n)],
                         "price": rng.uniform(.001, .999, n), "size": rng.uniform(1, 9, n)})
    warm = rows.assign(warm=np.where(np.arange(n) % 90 < 30, .3, np.nan))
    second = rows[:40].assign(tx_hash=[f"late{k}" for k in range(40)])
    for fed, anonymous in ((rows, False), (warm, False), (rows, True)):
        params, frozen = ModelParams(sigma2_0=1e-5, sigma2_1=1e-3, tau2_0=0.8, tau2_1=0.05, beta_S=.4, beta_Z=.7, anonymous=anonymous, alpha=-1.0), OnlineConfig(forgetting=1.0)
        last = fed[400:].assign(ts=fed["ts"][400:] + 3)
        st, want, seen = jobs.OnlineState(params, frozen), {}, {}
        for r in [*fed[:400].itertuples(), *last.itertuples()]:
            th = getattr(r, "warm", np.nan)
            sc, _ = st.trade(float(r.ts), r.price, r.size, r.wallet, seen.setdefault(r.wallet, st.warm_wallet(th) if th == th else None))
            want[r.tx_hash] = sc[:3]
        late = second[second["ts"] < fed["ts"][399]]
        with monkeypatch.context() as m:
            m.setattr(jobs.OnlineState, "trade", None)
            m.setattr(jobs, "SLICE_ROWS", 128)
            h, s = _Handle(), jobs.MarketScorer(params, frozen, jobs.Prior(), (0.0, 1.0, 0.0), "mark")
            s.init(h)
            got = pd.concat([x for b in (fed[:400], pd.concat([last, late])) for x in s.handleInputRows(("m",), iter([b]), None)])
        scored = got[got["kind"] == "scored"].set_index("tx_hash")
        assert len(scored) == n and all(abs(scored.loc[k, c] - v[j]) < 1e-12 for k, v in want.items() for j, c in enumerate(("p_z", "p_v", "x_mean")))
        gone = got[got["kind"] == "late"]
        assert len(gone) == len(late) > 0 and gone["p_z"].isna().all() and (gone["late_by"] == fed["ts"][399] - gone["ts"]).all()
        assert h.calls < 20 or "warm" in fed
