"""Trade scoring with the switching filter, as Spark jobs.

The filter is sequential inside a market. To keep a huge market out of a single
task, markets are cut into segments of bounded row count that run in parallel
from guessed start states. The end state of a segment is the start state of the
next; segments whose start state moved are run again until none moves. The filter
forgets its start quickly, so a couple of rounds settle it, and the rounds go on
for as long as it takes: after k rounds the first k segments are exact. Short segments
become ``GROW`` times as long from round to round, up to ``LONGEST`` rows, so where trades are
dense in time and a start is felt for many of them, the rounds grow with the logarithm. A task runs its
segments in lock-step (``lockstep``), for any number of parameter sets at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwatch.config import CHUNK_SECONDS, ModelParams, OnlineConfig, Prior
from fillwatch.functions.mathx import logit
from fillwatch.operators import lockstep
from fillwatch.operators.features import ORDER, causal_features
from fillwatch.operators.kernel import OnlineState
from fillwatch.session import scalar_row, scratch_path, stored, width

SEGMENT_ROWS = 100_000
#: Rows that a task filters together; a segment that is not complete waits for the rest.
GROUP_ROWS = 200_000
#: Growth of segments that have not settled in a round, and the longest that they become by it.
GROW, LONGEST = 4, 400_000
#: Rounds of the adaptive scorer, however long the longest market is.
MAX_ROUNDS = 16
KEYS = ["market", "seg"]
STATE = lockstep.STATE
_STATES = ", ".join(f"{c} ARRAY<DOUBLE>" for c in STATE)
STATE_DDL = f"market STRING, seg BIGINT, {_STATES}, log_marginal ARRAY<DOUBLE>"
SCORE_DDL = ("market STRING, i BIGINT, ts DOUBLE, tx_hash STRING, wallet STRING, y DOUBLE, delta DOUBLE, "
             "log_size_ratio DOUBLE, q00 DOUBLE, q01 DOUBLE, q10 DOUBLE, q11 DOUBLE, p_z DOUBLE, p_v DOUBLE, x_mean DOUBLE, "
             "x_var DOUBLE, log_evidence DOUBLE, prev_mu DOUBLE, prev_var DOUBLE, prev_v1 DOUBLE, prev_z1 DOUBLE")
_PASS = ["market", "i", "ts", "tx_hash", "wallet", "y", "delta", "log_size_ratio"]
_MADE = ["q00", "q01", "q10", "q11", "p_z", "p_v", "x_mean", "x_var", "log_evidence", "prev_mu", "prev_var", "prev_v1", "prev_z1"]


def with_level(features: DataFrame, params: ModelParams, theta: DataFrame | None = None) -> DataFrame:
    """Insider log-odds level per trade: the wallet's propensity, its prior mean, or the pooled intercept."""
    if params.anonymous:
        return features.withColumn("level", F.lit(float(params.alpha)))
    if theta is None:
        return features.withColumn("level", logit(F.lit(params.prior_mean)))
    known = theta.select("wallet", F.col("theta").alias("_th"))
    return features.join(known, "wallet", "left").withColumn(
        "level", logit(F.coalesce("_th", F.lit(params.prior_mean)))).drop("_th")


def _segmented(features: DataFrame, theta: DataFrame | None, segment_rows: int, *extra: str) -> DataFrame:
    rows = features.select("market", "i", F.col("ts").cast("double").alias("ts"), "tx_hash", "wallet", "y", "delta", "log_size_ratio",
                           F.expr(f"i div {segment_rows}").alias("seg"), *extra)
    if theta is None:
        return rows.withColumn("theta", F.lit(None).cast("double"))
    return rows.join(theta.select("wallet", "theta"), "wallet", "left")


def doubles(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """NaN where null."""
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def whole_segments(batches: Iterator[pa.RecordBatch], rows: int = GROUP_ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete segments of a stream sorted by (market, seg, i), with the number of rows of each segment."""
    held, n = [], 0

    def starts(table: pa.Table) -> np.ndarray:
        market, seg = (table.column(c).combine_chunks() for c in KEYS)
        new = pc.or_(pc.not_equal(market[1:], market[:-1]), pc.not_equal(seg[1:], seg[:-1])) if len(market) > 1 else None
        return np.concatenate([[0], np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1]) if new is not None else np.array([0])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            at = starts(table)
            if len(at) > 1:
                yield table.slice(0, at[-1]), np.diff(at)
                table = table.slice(at[-1])
            held, n = table.to_batches(), table.num_rows
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.diff(np.concatenate([starts(table), [table.num_rows]]))


def init_states(table: pa.Table, at: np.ndarray, sets: int) -> np.ndarray:
    """Start states (4, sets, segments) from the ``in_`` columns of the segments' first rows; zeros where empty."""
    out = np.zeros((len(STATE), sets, len(at)))
    for j, c in enumerate(STATE):
        for g, x in enumerate(table.column(f"in_{c}").take(pa.array(at)).to_pylist()):
            if x:
                out[j, :, g] = x
    return out


def _run(params: Sequence[ModelParams], const, rows: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Filter a stream of rows sorted by (market, seg, i); emit scores of one set, or end states of every set."""
    def nullable(x):
        return pa.array(x, from_pandas=True)

    def go(batches):
        for table, lengths in whole_segments(batches):
            at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            seg = table.column("seg").to_numpy()[at]
            y, delta, lsr, theta = (doubles(table.column(c)).astype(float) for c in ("y", "delta", "log_size_ratio", "theta"))
            f = lockstep.run(params, const, lengths, seg == 0, y, delta, lsr, lockstep.log_odds(params, theta), init_states(table, at, len(params)))
            if rows:
                made = [*f.q[:, 0], f.p_z[0], f.p_v[0], f.mu[0], f.var[0], f.ev[0], *f.before[:, 0]]
                yield from pa.Table.from_arrays([*(table.column(c) for c in _PASS), *map(nullable, made)], [*_PASS, *_MADE]).to_batches(50_000)
            else:
                totals = np.add.reduceat(f.ev, at, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [table.column("market").take(pa.array(at)).combine_chunks(), pa.array(seg),
                     *(pa.array(list(x.T)) for x in f.ends), pa.array(list(totals.T))], ["market", "seg", *STATE, "log_marginal"])

    return go


def headed(segmented: DataFrame, starts: DataFrame | None, order: Sequence[str] = ("i",)) -> DataFrame:
    """Start states at segment heads; segments spread over tasks, rows in order.

    Other rows have empty lists: a run of null lists costs Arrow's writer a step for each of them, again for every row."""
    empty = F.array().cast("array<double>")
    if starts is None:
        fed = segmented.select("*", *[empty.alias(f"in_{c}") for c in STATE])
    else:
        heads = starts.select(*KEYS, F.col("first_i").alias("i"), *[F.col(c).alias(f"in_{c}") for c in STATE])
        fed = segmented.join(heads, [*KEYS, "i"], "left").withColumns({f"in_{c}": F.coalesce(f"in_{c}", empty) for c in STATE})
    return fed.repartition(width(fed), *KEYS).sortWithinPartitions(*KEYS, *order)


def _launch(segmented: DataFrame, starts: DataFrame | None, params, const, rows: bool) -> DataFrame:
    return headed(segmented, starts).mapInArrow(_run(params, const, rows), SCORE_DDL if rows else STATE_DDL)


def states_apart(a: Sequence[str] = STATE, b: Sequence[str] = tuple(f"n_{c}" for c in STATE)) -> Column:
    """Largest difference of two states held as arrays over parameter sets."""
    return F.greatest(*[F.array_max(F.zip_with(x, y, lambda u, v: F.abs(u - v))) for x, y in zip(a, b)])


def first_guess(heads: DataFrame, params: Sequence[ModelParams]) -> DataFrame:
    """Start states of later segments from their first trades ``(market, seg, first_i, y)``."""
    per_set = lambda f: F.array(*[F.lit(float(f(p))) for p in params])
    return heads.select(*KEYS, "first_i", F.array_repeat("y", len(params)).alias("mu"), per_set(lambda p: p.tau2_0).alias("var"),
                        per_set(lockstep.stationary).alias("v1"), per_set(lambda p: p.prior_mean).alias("z1"))


def segment_starts(segmented: DataFrame, params: Sequence[ModelParams], const, segment_rows: int,
                   guess: DataFrame | None = None, tol: float = 1e-12, single: bool | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The trades in the segments that they ended up in, and the start state of every later one of these, iterated until
    no start moves by more than ``tol``.

    ``guess`` (states of an earlier run, e.g. the previous model iteration) only
    saves rounds. The starts are ``None`` when every market fits one segment, which a
    caller that knows can say with ``single``.
    """
    if single is None:
        single = not scalar_row(segmented.agg(F.max("seg").alias("s")))["s"]
    if single:
        return segmented, None
    heads = segmented.where((F.col("seg") > 0) & (F.col("i") == F.col("seg") * segment_rows)).withColumn("first_i", F.col("i"))
    starts = stored(first_guess(heads, params) if guess is None else guess.select(*KEYS, "first_i", *STATE), "segment-starts")
    todo = segmented
    ends = None
    while True:
        ran = _launch(todo, starts, params, const, rows=False).select(*KEYS, *STATE)
        if ends is not None:
            kept = ends.join(again, KEYS, "left_anti")
            ran = kept.unionByName(ran)
        ends = stored(ran, "segment-ends")
        nxt = ends.select("market", (F.col("seg") + 1).alias("seg"), *[F.col(c).alias(f"n_{c}") for c in STATE])
        moved = stored(starts.join(nxt, KEYS).withColumn("moved", states_apart() > tol), "segment-moves")
        starts = moved.select(*KEYS, "first_i", *[F.col(f"n_{c}").alias(c) for c in STATE])
        again = moved.where("moved").select(*KEYS)
        if again.isEmpty():
            return segmented, starts
        if segment_rows * GROW <= LONGEST:
            # a longer segment starts where its first part does and ends where its last part does; it runs if a part's start moved
            segment_rows *= GROW
            whole = F.expr(f"seg div {GROW}")
            segmented = segmented.withColumn("seg", F.expr(f"i div {segment_rows}"))
            starts = starts.where(F.col("seg") % GROW == 0).withColumn("seg", whole)
            ends = ends.where(F.col("seg") % GROW == GROW - 1).withColumn("seg", whole)
            again = again.withColumn("seg", whole).distinct()
        todo = segmented.join(again, KEYS, "left_semi")


def one_segment(features: DataFrame, segment_rows: int) -> bool:
    return (scalar_row(features.agg(F.max("i").alias("top")))["top"] or 0) < segment_rows


def filter_scores(features: DataFrame, params: ModelParams, theta: DataFrame | None = None, *, m_s: float = 0.0,
                  s_s: float = 1.0, m_z: float = 0.0, segment_rows: int = SEGMENT_ROWS, tol: float = 1e-12,
                  guess: DataFrame | None = None, return_starts: bool = False, single: bool | None = None):
    """Filtered P(Z), P(V), E[X], Var[X] and one-step evidence for every trade of ``compute_features`` output."""
    single = one_segment(features, segment_rows) if single is None else single
    segmented = _segmented(features, theta, segment_rows)
    segmented, starts = segment_starts(segmented, [params], (m_s, s_s, m_z), segment_rows, guess, tol, single)
    out = _launch(segmented, starts, [params], (m_s, s_s, m_z), rows=True)
    return (out, starts) if return_starts else out


def log_marginals(features: DataFrame, param_sets: Sequence[ModelParams], theta: DataFrame | None = None, *,
                  m_s: float = 0.0, s_s: float = 1.0, m_z: float = 0.0, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Log marginal likelihood per (parameter set, market); sum over markets for the set total.

    All sets go through one pass: trades are shuffled once, and the filter's state has an axis for the sets. Sets may differ in anything."""
    segmented = _segmented(features, theta, segment_rows)
    const = (m_s, s_s, m_z)
    segmented, starts = segment_starts(segmented, param_sets, const, segment_rows, single=one_segment(features, segment_rows))
    ends = _launch(segmented, starts, param_sets, const, rows=False)
    return ends.select("market", F.posexplode("log_marginal").alias("pset", "v")).groupBy("pset", "market").agg(F.sum("v").alias("log_marginal"))


def heldout_likelihood(scores: DataFrame, split: DataFrame) -> DataFrame:
    """Predictive log-likelihood of the tail trades per market; ``split`` marks trades ``(market, i, split)``."""
    tail = scores.join(split.where("split = 'tail'").select("market", "i"), ["market", "i"], "left_semi")
    return tail.groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.sum("log_evidence").alias("log_lik"))


def heldout_summary(per_market: DataFrame) -> DataFrame:
    return per_market.agg(F.count(F.lit(1)).alias("n_markets"), F.sum("n").alias("n"), F.sum("log_lik").alias("log_lik"),
                          (F.sum("log_lik") / F.sum("n")).alias("per_trade"))


# ---- known path -----------------------------------------------------------------------------------

PATH_DDL = "market STRING, i BIGINT, x_mean DOUBLE, x_var DOUBLE, log_lik DOUBLE"
PATH_ENDS_DDL = "market STRING, seg BIGINT, mu DOUBLE, var DOUBLE"


def _path_run(p: ModelParams, last: bool):
    def go(batches):
        for table, lengths in whole_segments(batches):
            at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            seg = table.column("seg").to_numpy()[at]
            init = np.stack([np.where(seg > 0, doubles(table.column(c).take(pa.array(at))), start) for c, start in (("in_mu", 0.0), ("in_var", p.s0_2))])
            y, delta, lsr, v, z = (doubles(table.column(c)).astype(float) for c in ("y", "delta", "log_size_ratio", "v", "z"))
            mu, var, ll, ends = lockstep.run_known_path(p, lengths, y, delta, lsr, v, z, init)
            if last:
                yield pa.RecordBatch.from_arrays([table.column("market").take(pa.array(at)).combine_chunks(), *map(pa.array, (seg, *ends))],
                                                 [*KEYS, "mu", "var"])
            else:
                yield from pa.Table.from_arrays([table.column("market"), table.column("i"), *map(pa.array, (mu, var, ll))],
                                                ["market", "i", "x_mean", "x_var", "log_lik"]).to_batches(50_000)

    return go


def known_path_filter(features: DataFrame, params: ModelParams, segment_rows: int = SEGMENT_ROWS,
                      tol: float = 1e-12) -> DataFrame:
    """Kalman filter for given ``v`` and ``z`` columns, with the same segment rounds."""
    rows = features.select("market", F.expr(f"i div {segment_rows}").alias("seg"), "i", "y", "delta", "log_size_ratio", "v", "z")

    def launch(starts, last):
        null = F.lit(None).cast("double")
        fed = rows.select("*", null.alias("in_mu"), null.alias("in_var")) if starts is None else rows.join(starts, KEYS, "left")
        return fed.repartition(width(fed), *KEYS).sortWithinPartitions(*KEYS, "i") \
                  .mapInArrow(_path_run(params, last), PATH_ENDS_DDL if last else PATH_DDL)

    if one_segment(features, segment_rows):
        return launch(None, False)
    starts = stored(rows.where((F.col("seg") > 0) & (F.col("i") == F.col("seg") * segment_rows)).select(
        *KEYS, F.col("y").alias("in_mu"), F.lit(params.tau2_0).alias("in_var")), "path-starts")
    while True:
        ends = launch(starts, True).select("market", (F.col("seg") + 1).alias("seg"), F.col("mu").alias("n_mu"), F.col("var").alias("n_var"))
        both = stored(starts.join(ends, KEYS), "path-moves")
        far = F.greatest(F.abs(F.col("in_mu") - F.col("n_mu")), F.abs(F.col("in_var") - F.col("n_var")))
        starts = both.select(*KEYS, F.col("n_mu").alias("in_mu"), F.col("n_var").alias("in_var"))
        if both.where(far > tol).isEmpty():
            return launch(starts, False)


# ---- adaptive scorer over stored trades -----------------------------------------------------------

ONLINE_DDL = ("kind INT, market STRING, wallet STRING, ts DOUBLE, tx_hash STRING, p_z DOUBLE, p_v DOUBLE, x_mean DOUBLE, "
              "log_evidence DOUBLE, s DOUBLE, n DOUBLE, theta DOUBLE, state STRING")
_ONLINE_COLS = [c.split()[0] for c in ONLINE_DDL.split(", ")]


def _online_run(batches: Iterator[pd.DataFrame], make) -> Iterator[pd.DataFrame]:
    """Adapt through rows sorted by (market, i); emit scores (0), wallet counts (1), market states (2)."""
    market, st, wallets = None, None, {}

    def flush():
        rows = [(1, market, w, None, None, None, None, None, None, c[0], c[1], c[2], None) for w, c in wallets.items() if c]
        return rows + [(2, market, None, None, None, None, None, None, None, None, None, None, st.dump())]

    for pdf in batches:
        out = []
        for mk, wl, ts, tx, price, size, state, s, n, th, warm in zip(*[pdf[c].tolist() for c in (
                "market", "wallet", "ts", "tx_hash", "price", "size", "state", "s", "n", "theta", "warm")]):
            if mk != market:
                if market is not None:
                    out += flush()
                market, st, wallets = mk, make(), {}
                if isinstance(state, str):
                    st.load(state)
            if wl not in wallets:
                wallets[wl] = (s, n, th) if n == n and n is not None else st.warm_wallet(warm) if warm == warm and warm is not None else None
            sc, wallets[wl] = st.trade(ts, price, size, wl, wallets[wl])
            out.append((0, mk, wl, ts, tx, sc[0], sc[1], sc[2], sc[4], None, None, sc[5], None))
        yield pd.DataFrame(out, columns=_ONLINE_COLS)
    if market is not None:
        yield pd.DataFrame(flush(), columns=_ONLINE_COLS)


def online_scores(trades: DataFrame, params: ModelParams, config: OnlineConfig = OnlineConfig(), *,
                  theta: DataFrame | None = None, prior: Prior = Prior(), m_s: float = 0.0, s_s: float = 1.0,
                  m_z: float = 0.0, segment_rows: int = SEGMENT_ROWS, chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Adaptive scores in replay order.

    Parameters after a trade depend on every earlier trade, so a market advances
    one segment per round, all markets side by side. Segments have ``segment_rows``
    trades, more in markets so long that it would take over ``MAX_ROUNDS`` rounds;
    a task streams through its segment and holds the counts of the wallets in it.
    A round is one job that reads its own segment of the trades and writes a folder
    of scores, market states and counts of the wallets it met; the next one reads
    the latest counts of the wallets from there, so the driver keeps nothing.
    """
    spark = trades.sparkSession
    longest = scalar_row(trades.groupBy("market").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")))["n"] or 0
    step = max(segment_rows, -(-longest // MAX_ROUNDS))
    rows = causal_features(trades, chunk_seconds).select("market", "i", F.col("ts").cast("double").alias("ts"), "tx_hash",
                                                         F.coalesce("wallet", F.lit("")).alias("wallet"), "price", "size")
    if theta is not None:
        rows = rows.join(theta.select("wallet", F.col("theta").alias("warm")), "wallet", "left")
    else:
        rows = rows.withColumn("warm", F.lit(None).cast("double"))
    rows = rows.withColumn("seg", F.expr(f"i div {step}"))
    source, path = scratch_path(spark, "online-trades"), scratch_path(spark, "online-scores")
    rows.write.partitionBy("seg").parquet(source)
    rows = spark.read.schema(rows.schema).parquet(source)

    def make():
        return OnlineState(params, config, prior, m_s, s_s, m_z)

    def written() -> DataFrame:
        return spark.read.schema(f"{ONLINE_DDL}, round INT").parquet(path)

    for k in range(max(-(-longest // step), 1)):
        now = rows.where(F.col("seg") == k).drop("seg")
        if k == 0:
            null = F.lit(None)
            fed = now.withColumns({"state": null.cast("string"), "s": null.cast("double"), "n": null.cast("double"),
                                   "theta": null.cast("double")})
        else:
            heads = written().where((F.col("kind") == 2) & (F.col("round") == k - 1)).select("market", F.lit(k * step).cast("long").alias("i"), "state")
            counts = written().where("kind = 1").groupBy("market", "wallet").agg(
                F.max_by(F.struct("s", "n", "theta"), "round").alias("_c")).select("market", "wallet", "_c.*")
            fed = now.join(heads, ["market", "i"], "left").join(counts, ["market", "wallet"], "left")
        fed.repartition(width(fed), "market").sortWithinPartitions("market", "i").mapInPandas(
            lambda b: _online_run(b, make), ONLINE_DDL).write.parquet(f"{path}/round={k}")
    return written().where("kind = 0").select("ts", "tx_hash", "market", "wallet", "p_z", "p_v", "x_mean", "log_evidence", "theta")


def replay(raw: DataFrame, params: ModelParams, config: OnlineConfig = OnlineConfig(), *, markets=None,
           seen: DataFrame | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """Validate, filter, de-duplicate and score a capture; returns scores and the skip report."""
    from fillwatch.operators.clean import keep_first, scorable

    marked = scorable(raw)
    usable = marked.where("_ok").drop("_ok")
    if markets:
        usable = usable.where(F.lower("market").isin([str(m).lower() for m in markets]))
    unique = keep_first(usable, "tx_hash", [*ORDER, "market"])
    if seen is not None:
        unique = unique.join(seen.select("tx_hash"), "tx_hash", "left_anti")
    scores = online_scores(unique, params, config, **kw)
    report = raw.agg(F.count(F.lit(1)).alias("n_in")).join(
        F.broadcast(unique.agg(F.count(F.lit(1)).alias("n_scored"), F.count_distinct("market").alias("n_markets")))) \
        .withColumn("n_skipped", F.col("n_in") - F.col("n_scored"))
    return scores, report
