"""Structured Streaming: feed ingest, keyed stateful scoring, feed health.

One scorer state per market: its filter and statistics in a value state, the
per-wallet counts in a map state so that a trade touches only its own wallet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fillwatch.config import ModelParams, OnlineConfig, Prior
from fillwatch.operators.clean import valid_trade
from fillwatch.operators.kernel import OnlineState
from fillwatch.schemas import CAPTURE_DDL
from fillwatch.sources.files import as_capture, capture_columns
from fillwatch.sources.venues import decode_frames

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT_DDL = ("kind STRING, ts DOUBLE, tx_hash STRING, market STRING, wallet STRING, p_z DOUBLE, p_v DOUBLE, x_mean DOUBLE, "
           "late_by DOUBLE")
_OUT = [c.split()[0] for c in OUT_DDL.split(", ")]
_FED = ["ts", "tx_hash", "wallet", "price", "size", "warm"]
#: Trades of a market that are Python objects at a time.
SLICE_ROWS = 20_000


def _fed_schema(warm: bool) -> pa.Schema:
    return pa.schema([(c, pa.large_string() if c in ("tx_hash", "wallet") else pa.float64()) for c in (_FED if warm else _FED[:-1])])


# ---- ingest ---------------------------------------------------------------------------------------

def read_capture_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Tail a folder of capture files; whole files only, so no torn lines."""
    reader = spark.readStream.schema(CAPTURE_DDL)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return capture_columns(reader.json(folder))


def read_frame_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Raw feed frames, decoded and classified; route ``kind`` to the trade sink or the quarantine."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return decode_frames(reader.load(folder))


#: Market of the row that ends a finite capture, and its time (the last second of the year 9999).
END_MARKET, END_TS = "__end__", 253_402_300_799


def end_capture(spark: SparkSession, folder: str) -> None:
    """Append the end marker to a finite capture. A stream that reads it moves its watermark behind all real trades, so open windows
    and sessions are closed and come out; later trades would be late, so a capture that goes on must not be ended."""
    row = spark.createDataFrame([(END_MARKET, END_TS)], "market STRING, ts BIGINT")
    empty = [F.lit(None).cast("string").alias(c) for c in ("price", "size", "wallet", "side", "tx_hash")]
    as_capture(row.select("*", *empty)).write.mode("append").json(folder)


def sink(stream: DataFrame, path: str, checkpoint: str, fmt: str = "json", available_now: bool = True):
    """Append-only exactly-once file sink."""
    w = stream.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def sink_capture(trades: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    return sink(as_capture(trades), path, checkpoint, "json", available_now)


# ---- scoring ----------------------------------------------------------------------------------------

def unique_trades(stream: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """Valid trades, one per hash within the watermark horizon."""
    ok = stream.where(valid_trade()).withColumn("event_time", F.timestamp_seconds("ts"))
    return ok.withWatermark("event_time", horizon).dropDuplicatesWithinWatermark(["tx_hash"])


class TradeRouter(StatefulProcessor):
    """Sends each trade of a hash bucket one way: ``trade`` (first of its hash), ``duplicate``, ``late`` or ``invalid``."""

    def __init__(self, horizon: float, columns: list[str]):
        self.horizon, self.columns = horizon, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "tx_hash ARRAY<STRING>, ts ARRAY<DOUBLE>")
        self.top = handle.getValueState("top", "ts DOUBLE")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.top.get()[0] if self.top.exists() else None
        top = before
        # hashes of one bucket within the horizon, as rows of many: a map state costs a call for each trade
        known = {tx: ts for txs, tss in self.seen.get() for tx, ts in zip(txs, tss)} if before is not None else {}
        for batch in rows:  # slices of the micro-batch; none is held
            kinds, lates, fresh = [], [], {}
            for ok, tx, ts in zip(batch["ok"].tolist(), batch["tx_hash"].tolist(), batch["ts"].tolist()):
                late = None
                if not ok:
                    kind = "invalid"
                elif before is not None and ts < before - self.horizon:
                    kind, late = "late", before - ts
                elif tx in known:
                    kind = "duplicate"
                else:
                    kind = "trade"
                    known[tx] = fresh[tx] = float(ts)
                    top = float(ts) if top is None else max(top, float(ts))
                kinds.append(kind)
                lates.append(late)
            if fresh:
                self.seen.appendValue((list(fresh), list(fresh.values())))
            out = batch[self.columns].copy()
            out["kind"], out["late_by"] = kinds, pd.Series(lates, dtype="float64", index=out.index)
            yield out
        if top is not None and top != before:
            self.top.update((top,))
            if before is not None and top // self.horizon > before // self.horizon:
                # a copy of what is older than the horizon would be late, so its hash need not be kept; once per horizon
                kept = [x for x in known.items() if x[1] >= top - self.horizon]
                parts = (kept[k:k + SLICE_ROWS] for k in range(0, len(kept), SLICE_ROWS))
                self.seen.put([([tx for tx, _ in p], [ts for _, ts in p]) for p in parts])

    def close(self) -> None:
        pass


def route_trades(stream: DataFrame, horizon: float = 3600.0, buckets: int = 64) -> DataFrame:
    """Every row of the stream once, with ``kind`` and, for late ones, ``late_by``: nothing is dropped uncounted.

    State is kept per bucket of hashes, so no market is one key; a hash is forgotten when its copies would be late. A row is
    late if it is older by more than ``horizon`` than the newest trade that its bucket had before this micro-batch."""
    _rocks(stream.sparkSession)
    names = [c for c in stream.columns if c not in ("ok", "bucket", "kind", "late_by")]
    fed = stream.select(*names, F.coalesce(valid_trade(), F.lit(False)).alias("ok"),
                        F.pmod(F.xxhash64(F.coalesce("tx_hash", F.lit(""))), F.lit(buckets)).alias("bucket"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fed.select(*names).schema)
    return fed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=TradeRouter(horizon, names), outputStructType=f"{ddl}, kind STRING, late_by DOUBLE",
        outputMode="Append", timeMode="None").where(~F.col("market").eqNullSafe(F.lit(END_MARKET)))


def _rocks(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class MarketScorer(StatefulProcessor):
    """Scores a market's trades in (ts, hash) order and carries its state between micro-batches."""

    def __init__(self, params: ModelParams, config: OnlineConfig, prior: Prior, const, late: str):
        self.params, self.config, self.prior, self.const, self.late = params, config, prior, const, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("market", "state STRING")
        self.wallets = handle.getMapState("wallets", "wallet STRING", "s DOUBLE, n DOUBLE, theta DOUBLE")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        st = OnlineState(self.params, self.config, self.prior, *self.const)
        stored = False
        if self.state.exists():
            st.load(self.state.get()[0])
            stored = self.wallets.exists()  # else no wallet is asked for one by one
        # the micro-batch is held in Arrow columns only; Python objects exist for a slice of it at a time
        held = pa.concat_tables([pa.Table.from_pandas(b[[c for c in _FED if c in b]], _fed_schema("warm" in b), preserve_index=False) for b in rows])
        order = pc.sort_indices(held, [("ts", "ascending"), ("tx_hash", "ascending")])
        seen: dict[str, tuple | None] = {}

        def counts(wl: str, th: float | None) -> tuple | None:
            if wl not in seen:
                if stored and self.wallets.containsKey((wl,)):
                    seen[wl] = tuple(self.wallets.getValue((wl,)))
                else:
                    seen[wl] = st.warm_wallet(th) if th is not None and th == th else None
            return seen[wl]

        score = self._fixed if self.config.frozen else self._adaptive
        for at in range(0, len(order), SLICE_ROWS):
            part = held.take(order[at:at + SLICE_ROWS])
            yield score(key[0], st, part, counts, seen, stored)
        for wl, c in seen.items():
            if c is not None:
                self.wallets.updateValue((wl,), c)
        self.state.update((st.dump(),))

    def _late(self, market: str, tx: str) -> None:
        if self.late == "fail":
            raise ValueError(f"trade {tx} of market {market} is older than one already scored")

    def _adaptive(self, market: str, st: OnlineState, part: pa.Table, counts, seen: dict, stored: bool) -> pd.DataFrame:
        """Trade by trade: each one moves the parameters of the next."""
        out = []
        cols = [c.to_numpy().tolist() if pa.types.is_floating(c.type) else c.to_pylist() for c in part.columns]  # numbers: NaN where null
        warm = cols.pop() if "warm" in part.column_names else [None] * len(part)
        for ts, tx, wl, price, size, th in zip(*cols, warm):
            if st.last_ts is not None and ts < st.last_ts:
                self._late(market, tx)
                out.append(("late", ts, tx, market, wl, None, None, None, st.last_ts - ts))
                continue
            sc, seen[wl] = st.trade(ts, price, size, wl, counts(wl, th))
            out.append(("scored", ts, tx, market, wl, sc[0], sc[1], sc[2], None))
        return pd.DataFrame(out, columns=_OUT)

    def _fixed(self, market: str, st: OnlineState, part: pa.Table, counts, seen: dict, stored: bool) -> pd.DataFrame:
        """Parameters and wallet counts stand still, so a slice is one segment of the filter and its features are columns."""
        ts, tx = part["ts"].to_numpy(), part["tx_hash"]
        n_late = 0 if st.last_ts is None else int(np.searchsorted(ts, st.last_ts))  # the slice is in order
        if n_late:
            self._late(market, tx[0].as_py())
        out = part.select(["ts", "tx_hash", "wallet"]).to_pandas()
        out["kind"], out["market"], out["late_by"] = "scored", market, np.nan
        out[["p_z", "p_v", "x_mean"]] = np.nan
        if n_late:
            out.loc[:n_late - 1, "kind"], out.loc[:n_late - 1, "late_by"] = "late", st.last_ts - ts[:n_late]
        live = part.slice(n_late)
        if len(live):
            theta = np.full(len(live), np.nan)
            if stored or "warm" in live.column_names:
                warm = live["warm"].to_numpy().tolist() if "warm" in live.column_names else [None] * len(live)
                known = (counts(wl, th) for wl, th in zip(live["wallet"].to_pylist(), warm))
                theta = np.array([np.nan if c is None else c[2] for c in known])
            p_z, p_v, x_mean = st.fixed_trades(ts[n_late:], live["price"].to_numpy(), live["size"].to_numpy(), theta)
            out.loc[n_late:, "p_z"], out.loc[n_late:, "p_v"], out.loc[n_late:, "x_mean"] = p_z, p_v, x_mean
        return out[_OUT]

    def close(self) -> None:
        pass


def score_stream(trades: DataFrame, params: ModelParams, config: OnlineConfig = OnlineConfig(), *,
                 theta: DataFrame | None = None, prior: Prior = Prior(), const=(0.0, 1.0, 0.0),
                 late: str = "mark") -> DataFrame:
    """Stateful scores per trade. ``late='fail'`` stops on a trade older than one already scored."""
    _rocks(trades.sparkSession)
    fed = trades.where(F.col("market") != END_MARKET).select("market", "ts", "tx_hash", F.coalesce("wallet", F.lit("")).alias("wallet"), "price", "size")
    if theta is not None:
        fed = fed.join(theta.select("wallet", F.col("theta").alias("warm")), "wallet", "left")
    return fed.groupBy("market").transformWithStateInPandas(
        statefulProcessor=MarketScorer(params, config, prior, const, late), outputStructType=OUT_DDL,
        outputMode="Append", timeMode="None")


# ---- feed health ---------------------------------------------------------------------------------------

def _not_end():
    """An aggregate, so that the filter on it stays above the watermark that the marker moves."""
    return (F.max("market") != END_MARKET).alias("real")


def feed_counts(stream: DataFrame, width: str = "1 hour", horizon: str = "1 hour") -> DataFrame:
    """Trades, volume and distinct seconds per market and tumbling window. Seconds of a window are a set, bounded by its width.
    Windows still open at the end of a finite capture come out if it was ended by ``end_capture``."""
    timed = stream.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", horizon)
    return timed.groupBy("market", F.window("event_time", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n_trades"), F.sum("size").alias("volume"), F.size(F.collect_set("ts")).alias("n_seconds"), _not_end()) \
        .where("real").select("market", F.unix_seconds("w.start").alias("window_start"), "n_trades", "volume", "n_seconds")


def activity_sessions(stream: DataFrame, gap: str = "2 hours", horizon: str = "1 hour") -> DataFrame:
    """Stretches of activity separated by silence of at least ``gap``; for the last one see ``feed_counts``."""
    timed = stream.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", horizon)
    return timed.groupBy("market", F.session_window("event_time", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_trades"), _not_end()) \
        .where("real").select(
        "market", F.unix_seconds("w.start").alias("session_start"), F.unix_seconds("w.end").alias("session_end"), "n_trades")
