"""Queries over sources, sinks, scoring, fitting and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from fillwatch.config import ModelParams, OnlineConfig
from fillwatch.operators import clean, em, features, scoring
from fillwatch.operators.ordered import ordered_carry
from fillwatch.plans.queries_core import r
from fillwatch.plans.registry import query
from fillwatch.plans.views import sql
from fillwatch.session import cut
from fillwatch.sources import files, venues
from fillwatch.streaming import jobs

# ---- sources: payload text is derived from the trades, then read back ----------------------------


@query("src1_read_capture", sql("SELECT market, count(*) AS n, round(sum(size), 4) AS volume, max(ts) AS last_ts FROM raw_trades GROUP BY market", "raw_trades"))
def _(t):
    path = files.scratch_path(t.spark, "capture")
    files.append_capture(t.raw, path)
    good, _bad = files.read_capture(t.spark, path)
    return good.groupBy("market").agg(
        F.count("*").alias("n"), r(F.sum("size"), 4).alias("volume"), F.max("ts").alias("last_ts"))


@query("src2_read_replay", sql("SELECT tx_hash, ts, market FROM raw_trades", "raw_trades"))
def _(t):
    path = files.scratch_path(t.spark, "replay")
    files.write_capture(t.raw, path)
    return files.read_replay(t.spark, path).select("tx_hash", "ts", "market")


def payloads(t):
    """Trade payloads with both field spellings, empty and odd values."""
    n = F.col("tx_hash").cast("long")
    even = n % 2 == 0
    return t.raw.select(F.to_json(F.struct(
        F.col("ts").cast("string").alias("timestamp"), F.when(n % 17 != 0, F.col("price").cast("string")).alias("price"),
        F.col("size").cast("string").alias("size"), F.when(even, F.col("wallet")).alias("proxyWallet"),
        F.when(~even, F.col("wallet")).alias("wallet"), F.lower("side").alias("side"),
        F.when(even, F.col("tx_hash")).alias("transactionHash"), F.when(~even, F.col("tx_hash")).alias("transaction_hash"),
        F.when(even, F.col("market")).alias("conditionId"), F.when(~even, F.col("market")).alias("condition_id"))).alias("value"))


@query("src4_normalize_trades", sql("""SELECT market, wallet, ts, CASE WHEN CAST(tx_hash AS BIGINT) % 17 = 0 THEN 0.0 ELSE round(price, 9) END AS price, size, side, tx_hash, '' AS asset_id FROM raw_trades""", "raw_trades"))
def _(t):
    return venues.normalize_trades(payloads(t)).withColumn("price", r("price", 9))


@query("src5_normalize_markets", sql("""SELECT market AS condition_id, slug, question, round(volume, 4) AS volume, closed, end_date, 2 AS n_tags, market AS tag FROM markets""", "markets"))
def _(t):
    m = t.markets.select(F.to_json(F.struct(
        F.col("market").alias("conditionId"), "slug", "question", F.col("volume").cast("string").alias("volume"), "closed",
        F.col("end_date").alias("endDate"), F.array(F.struct(F.col("market").alias("label")), F.struct(F.lit("x").alias("label"))).alias("tags"))).alias("value"))
    return venues.normalize_markets(m).select("condition_id", "slug", "question", r("volume", 4).alias("volume"), "closed", "end_date",
                                              F.size("tags").alias("n_tags"), F.element_at("tags", 1).alias("tag"))


@query("src6_tags", sql("SELECT market || '|politics' AS tags FROM markets", "markets"))
def _(t):
    m = t.markets.select(F.to_json(F.struct(F.array("market", F.lit("politics")).alias("tags"))).alias("value"))
    return venues.normalize_markets(m).select(F.array_join("tags", "|").alias("tags"))


@query("src7_anonymous_trades", sql("""SELECT market, CAST(NULL AS VARCHAR) AS wallet, ts, CASE k WHEN 0 THEN round(price, 6) WHEN 1 THEN floor(price * 100) / 100 WHEN 2 THEN 1 - round(price, 6) ELSE 1 - floor(price * 100) / 100 END AS price,
size, CASE WHEN k < 2 THEN 'BUY' ELSE 'SELL' END AS side, tx_hash FROM (SELECT *, CAST(tx_hash AS BIGINT) % 5 AS k FROM raw_trades) WHERE k < 4""", "raw_trades").replace(
    "CASE k WHEN 0", "round(CASE k WHEN 0").replace("ELSE 1 - floor(price * 100) / 100 END AS price", "ELSE 1 - floor(price * 100) / 100 END, 6) AS price"))
def _(t):
    k = F.col("tx_hash").cast("long") % 5
    cents = F.floor(F.col("price") * 100).cast("string")
    dollars = F.format_string("%.6f", F.round("price", 6))
    row = F.struct(F.col("tx_hash").alias("trade_id"), F.col("market").alias("ticker"),
                   F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'.25Z'").alias("created_time"),
                   F.when(k == 0, dollars).alias("yes_price_dollars"), F.when(k == 1, cents).alias("yes_price"),
                   F.when(k == 2, dollars).alias("no_price_dollars"), F.when(k == 3, cents).alias("no_price"),
                   F.col("size").cast("string").alias("count_fp"), F.when(k < 2, "yes").when(k < 4, "NO").otherwise("maybe").alias("taker_side"))
    body = t.raw.select(F.to_json(F.struct(F.array(row).alias("trades"))).alias("value"))
    rows = venues.normalize_anonymous(body)
    return rows.where("error IS NULL").select("market", "wallet", "ts", r("price").alias("price"), "size", "side", "tx_hash")


@query("src7_anonymous_errors", sql("SELECT 'unknown taker_side' AS error, count(*) AS n FROM raw_trades WHERE CAST(tx_hash AS BIGINT) % 5 = 4", "raw_trades"))
def _(t):
    k = F.col("tx_hash").cast("long") % 5
    row = F.struct(F.col("tx_hash").alias("trade_id"), F.col("market").alias("ticker"), F.lit("2024-01-01T00:00:00Z").alias("created_time"),
                   F.lit("0.5").alias("yes_price_dollars"), F.lit("1").alias("count"), F.when(k < 4, "yes").otherwise("maybe").alias("taker_side"))
    body = t.raw.select(F.to_json(F.struct(F.array(row).alias("trades"))).alias("value"))
    return venues.normalize_anonymous(body).where("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n"))


@query("src10_created_seconds", "SELECT o_orderkey, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) + 3723 AS ts FROM orders")
def _(t):
    text = F.concat(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd"), F.lit("T01:02:03.999"),
                    F.when(F.col("o_orderkey") % 2 == 0, "Z").otherwise(""))
    return t.read("orders").select("o_orderkey", venues.created_seconds(text).alias("ts"))


@query("src11_anonymous_markets", """SELECT CAST(o_orderkey AS VARCHAR) AS ticker, o_orderstatus IN ('F', 'P') AS resolved, round(o_totalprice, 2) AS volume FROM orders""")
def _(t):
    st = F.when(F.col("o_orderstatus") == "F", " Settled ").when(F.col("o_orderstatus") == "P", "closed").otherwise("active")
    m = t.read("orders").select(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("ticker"), st.alias("status"),
                                                   F.col("o_totalprice").cast("string").alias("volume"))).alias("value"))
    return venues.normalize_anonymous_markets(m).select("ticker", "resolved", r("volume", 2).alias("volume"))


def frames(t):
    """Feed frames around the trades: keepalives, other topics, torn and non-numeric frames."""
    n = F.col("tx_hash").cast("long")
    pay = F.struct(F.when(n % 3 != 0, F.col("ts")).alias("timestamp"), F.when(n % 19 == 0, "n/a").otherwise(F.col("price").cast("string")).alias("price"),
                   F.col("size").cast("string").alias("size"), F.col("wallet").alias("proxyWallet"), F.col("side"), F.col("tx_hash").alias("transactionHash"),
                   F.col("market").alias("conditionId"))
    full = F.to_json(F.struct(F.when(n % 7 == 0, "prices").otherwise("activity").alias("topic"), F.lit("trades").alias("type"),
                              (F.col("ts") * 1000).alias("timestamp"), pay.alias("payload")))
    return t.raw.select(F.when(n % 11 == 0, "").when(n % 13 == 0, F.substring(full, 1, 40)).otherwise(full).alias("value"))


FRAME_SQL = """SELECT *, CASE WHEN n % 11 = 0 THEN 'keepalive' WHEN n % 13 = 0 THEN 'bad' WHEN n % 7 = 0 THEN 'other' WHEN n % 19 = 0 THEN 'bad' ELSE 'trade' END AS kind
FROM (SELECT *, CAST(tx_hash AS BIGINT) AS n FROM raw_trades)"""


@query("src12_feed_kinds", sql("SELECT kind, count(*) AS n FROM fr GROUP BY kind", "raw_trades", fr=FRAME_SQL))
def _(t):
    return venues.decode_frames(frames(t)).groupBy("kind").agg(F.count("*").alias("n"))


@query("src12_feed_trades", sql("SELECT tx_hash, market, ts, side FROM fr WHERE kind = 'trade'", "raw_trades", fr=FRAME_SQL))
def _(t):
    return venues.feed_trades(frames(t)).select("tx_hash", "market", "ts", "side")


@query("src13_merge_pages", """SELECT tx_hash, page, pos FROM (SELECT *, row_number() OVER (PARTITION BY tx_hash ORDER BY page, pos) AS k FROM (
  SELECT CAST(l_orderkey AS VARCHAR) AS tx_hash, l_linenumber AS page, l_partkey AS pos FROM lineitem)) WHERE k = 1""")
def _(t):
    p = t.read("lineitem").select(F.col("l_orderkey").cast("string").alias("tx_hash"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("pos"))
    return venues.merge_pages(p).select("tx_hash", "page", "pos")


@query("src14_load_scores", sql("SELECT market, count(*) AS n, round(avg(p_z), 9) AS m FROM scores GROUP BY market", "scores"))
def _(t):
    path = files.scratch_path(t.spark, "scores")
    files.write_scores(t.scores, path, "replay", "events")
    files.replay_provenance(t.spark, path)
    return files.load_scores(t.spark, path).groupBy("market").agg(F.count("*").alias("n"), r(F.avg("p_z"), 9).alias("m"))


def metadata(t):
    k = F.col("o_orderkey")
    when = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rec = F.to_json(F.struct(
        F.when(k % 4 == 0, F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("close_ts"), F.when(k % 4 == 1, when).alias("close_time"),
        F.when(k % 4 == 2, when).alias("end_date"), F.when(k % 2 == 0, F.concat(F.lit("m"), k)).alias("ticker"),
        F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "0.97").alias("outcome"), F.when(k % 5 == 0, "down").alias("settlement")))
    return t.read("orders").select(F.concat(F.lit("k"), k).alias("key"), rec.alias("value"))


@query("src16_resolutions", """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'm' || o_orderkey ELSE 'k' || o_orderkey END AS market, CAST(epoch_us(o_orderdate) // 1000000 AS DOUBLE) AS close_ts
FROM orders WHERE o_orderkey % 4 <> 3""")
def _(t):
    return files.resolutions(metadata(t))


@query("src17_outcomes", """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'm' || o_orderkey ELSE 'k' || o_orderkey END AS market, CASE WHEN o_orderkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS outcome
FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0""")
def _(t):
    return files.outcomes(metadata(t))


@query("src20_remaining_keys", "SELECT o_orderkey AS seed FROM orders WHERE o_orderkey % 3 <> 0")
def _(t):
    o = t.read("orders").select(F.col("o_orderkey").alias("seed"))
    return files.remaining_keys(o, o.where("seed % 3 = 0"))


@query("jon4_skip_seen", sql("SELECT market, count(*) AS n FROM trades WHERE CAST(tx_hash AS BIGINT) % 10 <> 0 GROUP BY market", "trades"))
def _(t):
    seen = t.scores.where(F.col("tx_hash").cast("long") % 10 == 0).select("tx_hash")
    return t.trades.join(seen, "tx_hash", "left_anti").groupBy("market").agg(F.count("*").alias("n"))


@query("jon5_semi_join", sql("SELECT market, count(*) AS n FROM trades_big WHERE wallet IN (SELECT 'c' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY market", "trades_big"))
def _(t):
    urgent = t.read("orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("wallet"))
    return t.trades_big.join(urgent, "wallet", "left_semi").groupBy("market").agg(F.count("*").alias("n"))


@query("jon3_theta_lookup", sql("""SELECT tx_hash, round(CASE WHEN CAST(wallet AS BIGINT) % 2 = 0 THEN 0.25 ELSE 0.05 END, 9) AS theta FROM trades""", "trades").replace("0.25 ELSE 0.05 END", "0.25e0 ELSE 0.05e0 END"))
def _(t):
    theta = t.trades.where(F.col("wallet").cast("long") % 2 == 0).select("wallet").distinct().withColumn("theta", F.lit(0.25))
    lev = scoring.with_level(t.trades, ModelParams(), theta)
    return lev.select("tx_hash", r(1.0 / (1.0 + F.exp(-F.col("level"))), 9).alias("theta"))


@query("snk2_compact_capture", sql("SELECT count(*) AS n, round(sum(price), 4) AS p FROM raw_trades", "raw_trades"))
def _(t):
    src, dst = files.scratch_path(t.spark, "lines"), files.scratch_path(t.spark, "compact")
    files.append_capture(t.raw, src)
    files.compact_capture(t.spark, src, dst)
    return files.read_replay(t.spark, dst, "parquet").agg(F.count("*").alias("n"), r(F.sum("price"), 4).alias("p"))


@query("snk4_processed", sql("SELECT market, count(*) AS n, round(max(s_bar), 6) AS s_bar FROM features WHERE market IN ('click', 'view') GROUP BY market", "features"))
def _(t):
    path = files.scratch_path(t.spark, "processed")
    files.save_processed(t.stored_features, features.wallet_ids(t.trades), path)
    f, _ids = files.load_processed(t.spark, path, ["click", "view"])
    return f.groupBy("market").agg(F.count("*").alias("n"), r(F.max("s_bar")).alias("s_bar"))


# ---- scoring -----------------------------------------------------------------------------------------

P = ModelParams(sigma2_0=1e-6, sigma2_1=1e-4, tau2_0=1.0, tau2_1=0.05)
LEVEL = "ln(0.05e0 / 0.95e0)"
# One filter step per recursion: the carried row of every market meets its next trade.


def filter_sql(p: ModelParams | None = None, g: str = "g", src: str = "features") -> str:
    """``p`` None: parameters and the wallet's log odds are columns s0, s1, t0, t1, q01, q10, lev of ``src``."""
    s0, s1, t0, t1 = ("f.s0", "f.s1", "f.t0", "f.t1") if p is None else (f"{x!r}e0" if "e" not in repr(x) else repr(x) for x in (p.sigma2_0, p.sigma2_1, p.tau2_0, p.tau2_1))
    q01, q10, lev = ("f.q01", "f.q10", "f.lev") if p is None else (f"{p.q_01!r}e0", f"{p.q_10!r}e0", LEVEL)
    return f"""SELECT market, CAST(-1 AS BIGINT) AS i, 0.0e0 AS mu, 1.0e0 AS var, 0.0e0 AS v1, 0.0e0 AS z1, 0.0e0 AS ev FROM (SELECT DISTINCT market FROM features)
UNION ALL
SELECT market, i, mu + s, q0 * (c0 + (d0 - s) * (d0 - s)) + q1 * (c1 + (d1 - s) * (d1 - s)) + q2 * (c2 + (d2 - s) * (d2 - s)) + q3 * (c3 + (d3 - s) * (d3 - s)), q2 + q3, q1 + q3, top + ln(tot)
FROM (SELECT *, q0 * d0 + q1 * d1 + q2 * d2 + q3 * d3 AS s FROM (
 SELECT *, exp(a0 - top) / tot AS q0, exp(a1 - top) / tot AS q1, exp(a2 - top) / tot AS q2, exp(a3 - top) / tot AS q3 FROM (
 SELECT *, exp(a0 - top) + exp(a1 - top) + exp(a2 - top) + exp(a3 - top) AS tot FROM (
 SELECT *, greatest(a0, a1, a2, a3) AS top FROM (
 SELECT market, i, mu, w0 / (w0 + r0) * err AS d0, w0 / (w0 + r1) * err AS d1, w1 / (w1 + r0) * err AS d2, w1 / (w1 + r1) * err AS d3,
  (1 - w0 / (w0 + r0)) * w0 AS c0, (1 - w0 / (w0 + r1)) * w0 AS c1, (1 - w1 / (w1 + r0)) * w1 AS c2, (1 - w1 / (w1 + r1)) * w1 AS c3,
  lv0 + lz0 + greatest(-0.5 * (ln(2 * pi()) + ln(w0 + r0) + err * err / (w0 + r0)), -500) AS a0, lv0 + lz1 + greatest(-0.5 * (ln(2 * pi()) + ln(w0 + r1) + err * err / (w0 + r1)), -500) AS a1,
  lv1 + lz0 + greatest(-0.5 * (ln(2 * pi()) + ln(w1 + r0) + err * err / (w1 + r0)), -500) AS a2, lv1 + lz1 + greatest(-0.5 * (ln(2 * pi()) + ln(w1 + r1) + err * err / (w1 + r1)), -500) AS a3
 FROM (SELECT f.market, f.i, g.mu, f.y - g.mu AS err, g.var + {s0} * f.delta AS w0, g.var + {s1} * f.delta AS w1,
  {t0} / greatest(1 + f.log_size_ratio, 0.1e0) AS r0, {t1} / greatest(1 + f.log_size_ratio, 0.1e0) AS r1,
  ln(greatest(CASE WHEN f.i = 0 THEN 1 - {q01} / ({q01} + {q10}) ELSE (1 - g.v1) * (1 - {q01}) + g.v1 * {q10} END, 1e-300)) AS lv0, ln(greatest(CASE WHEN f.i = 0 THEN {q01} / ({q01} + {q10}) ELSE (1 - g.v1) * {q01} + g.v1 * (1 - {q10}) END, 1e-300)) AS lv1,
  CASE WHEN f.i = 0 THEN 0 ELSE -ln(1 + exp({lev})) END AS lz0, CASE WHEN f.i = 0 THEN -500 ELSE {lev} - ln(1 + exp({lev})) END AS lz1
 FROM {g} g JOIN {src} f ON f.market = g.market AND f.i = g.i + 1))))))"""


FILTER_SQL = filter_sql(P)


@query("sco1_filter_scores", sql("SELECT market, i, round(z1, 6) AS p_z, round(v1, 6) AS p_v, round(mu, 6) AS x_mean, round(ev, 6) AS log_evidence FROM g WHERE i >= 0", "features", g=FILTER_SQL))
def _(t):
    s = scoring.filter_scores(t.stored_features, P)
    return s.select("market", "i", r("p_z").alias("p_z"), r("p_v").alias("p_v"), r("x_mean").alias("x_mean"), r("log_evidence").alias("log_evidence"))


@query("sco1_filter_segmented", sql("SELECT market, i, round(z1, 6) AS p_z, round(v1, 6) AS p_v, round(mu, 6) AS x_mean FROM g WHERE i >= 0", "features", g=FILTER_SQL))
def _(t):
    s = scoring.filter_scores(t.stored_features, P, segment_rows=500)
    return s.select("market", "i", r("p_z").alias("p_z"), r("p_v").alias("p_v"), r("x_mean").alias("x_mean"))


OTHER = ModelParams(sigma2_0=1e-5, sigma2_1=1e-3, tau2_0=2.0, tau2_1=0.1)


@query("sco2_log_marginals", sql("""SELECT 0 AS pset, market, round(sum(ev), 4) AS log_marginal FROM g WHERE i >= 0 GROUP BY market
UNION ALL SELECT 1, market, round(sum(ev), 4) FROM g1 WHERE i >= 0 GROUP BY market""", "features", g=FILTER_SQL, g1=filter_sql(OTHER, "g1")))
def _(t):
    return scoring.log_marginals(t.stored_features, [P, OTHER]).select("pset", "market", r("log_marginal", 4).alias("log_marginal"))


@query("sco3_heldout", sql("""SELECT market, count(*) AS n, round(sum(ev), 4) AS log_lik FROM (SELECT *, count(*) OVER (PARTITION BY market) AS n FROM g WHERE i >= 0)
WHERE i >= n - round_even(0.2 * n, 0) GROUP BY market""", "features", g=FILTER_SQL))
def _(t):
    f = t.stored_features
    h = scoring.heldout_likelihood(scoring.filter_scores(f, P), clean.holdout_split(f))
    return h.select("market", "n", r("log_lik", 4).alias("log_lik"))


PATH_SQL = f"""SELECT market, CAST(-1 AS BIGINT) AS i, 0.0e0 AS mu, 1.0e0 AS var, 0.0e0 AS ll FROM (SELECT DISTINCT market FROM features)
UNION ALL SELECT market, i, mu + w / (w + rr) * err, (1 - w / (w + rr)) * w, greatest(-0.5 * (ln(2 * pi()) + ln(w + rr) + err * err / (w + rr)), -500) FROM (
 SELECT f.market, f.i, g.mu, f.y - g.mu AS err, g.var + CASE WHEN f.i % 7 = 0 THEN {P.sigma2_1!r} ELSE {P.sigma2_0!r} END * f.delta AS w,
  CASE WHEN f.i % 11 = 0 THEN {P.tau2_1!r}e0 ELSE {P.tau2_0!r}e0 END / greatest(1 + f.log_size_ratio, 0.1e0) AS rr FROM g JOIN features f ON f.market = g.market AND f.i = g.i + 1)"""


@query("sco4_known_path", sql("SELECT market, i, round(mu, 6) AS x_mean, round(var, 6) AS x_var, round(ll, 6) AS log_lik FROM g WHERE i >= 0", "features", g=PATH_SQL))
def _(t):
    f = t.stored_features.withColumn("v", (F.col("i") % 7 == 0).cast("int")).withColumn("z", (F.col("i") % 11 == 0).cast("int"))
    s = scoring.known_path_filter(f, P, segment_rows=700)
    return s.select("market", "i", r("x_mean").alias("x_mean"), r("x_var").alias("x_var"), r("log_lik").alias("log_lik"))


@query("sco5_online_scores")
def _(t):
    return scoring.online_scores(cut(t.trades), P, OnlineConfig(), segment_rows=20_000)


@query("sco6_replay_report", sql("""SELECT (SELECT count(*) FROM raw_trades) AS n_in, count(*) AS n_scored, count(DISTINCT market) AS n_markets, (SELECT count(*) FROM raw_trades) - count(*) AS n_skipped
FROM trades WHERE market IN ('click', 'view')""", "raw_trades", "trades"))
def _(t):
    return scoring.replay(t.raw, P, markets=["Click", "view"])[1]


# ---- fitting --------------------------------------------------------------------------------------------

def posterior_rows(t):
    """Stand-in posterior over the features with the previous row's moments alongside."""
    n = F.col("tx_hash").cast("long")
    f = t.stored_features.withColumns({"p_z": n * 7919 % 1000 / F.lit(1000.0), "p_v": n * 104729 % 1000 / F.lit(1000.0), "x_mean": F.col("y") * 0.9,
                                       "x_var": (n % 10 + 1) / F.lit(10.0), "log_evidence": -F.abs("y")})
    return ordered_carry(f, "market", ["ts", "tx_hash"], lags={"prev_mu": "x_mean", "prev_var": "x_var", "prev_v1": "p_v", "prev_z1": "p_z"})


POST_SQL = """SELECT *, lag(x) OVER w AS px, lag(var) OVER w AS pvar, lag(v1) OVER w AS pv, lag(z1) OVER w AS pz FROM (
  SELECT *, (CAST(tx_hash AS BIGINT) * 7919 % 1000) / 1000.0e0 AS z1, (CAST(tx_hash AS BIGINT) * 104729 % 1000) / 1000.0e0 AS v1, y * 0.9e0 AS x, (CAST(tx_hash AS BIGINT) % 10 + 1) / 10.0e0 AS var FROM features)
WINDOW w AS (PARTITION BY market ORDER BY i)"""
STAT_SQL = """SELECT sum((1 - v1) * ((x - px) * (x - px) + var + pvar) / delta) FILTER (WHERE delta > 0) AS ss_v0, sum(v1 * ((x - px) * (x - px) + var + pvar) / delta) FILTER (WHERE delta > 0) AS ss_v1,
sum(1 - v1) FILTER (WHERE delta > 0) AS n_v0, sum(v1) FILTER (WHERE delta > 0) AS n_v1, sum((1 - pv) * (1 - v1)) AS n_00, sum((1 - pv) * v1) AS n_01, sum(pv * (1 - v1)) AS n_10, sum(pv * v1) AS n_11,
sum((1 - z1) * ((y - x) * (y - x) + var) * greatest(1 + log_size_ratio, 0.1)) AS ss_z0, sum(z1 * ((y - x) * (y - x) + var) * greatest(1 + log_size_ratio, 0.1)) AS ss_z1, sum(1 - z1) AS n_z0, sum(z1) AS n_z1, avg(pz) AS m_z FROM po"""


@query("agg4_sufficient_statistics", sql("SELECT " + ", ".join(f"round({c}, 4) AS {c}" for c in em.STATS) + ", round(m_z, 9) AS m_z FROM ss", "features", po=POST_SQL, ss=STAT_SQL))
def _(t):
    s = em.sufficient_statistics(em.wallet_summary(posterior_rows(t)))
    return s.select(*[r(c, 4).alias(c) for c in em.STATS], r("m_z", 9).alias("m_z"))


@query("agg5_m_step", sql("""SELECT round(q01, 9) AS q_01, round(q10, 9) AS q_10, round(s0, 9) AS sigma2_0, round(greatest(s1, s0), 9) AS sigma2_1, round(t0, 9) AS tau2_0, round(least(t1, t0), 9) AS tau2_1 FROM (
SELECT (1 + n_01) / (2 + n_01 + n_00) AS q01, (1 + n_10) / (2 + n_10 + n_11) AS q10, (1 + ss_v0 / 2) / (3 + n_v0 / 2) AS s0, (1 + ss_v1 / 2) / (3 + n_v1 / 2) AS s1, (ss_z0 + 2e-9) / (n_z0 + 2e-9) AS t0, (ss_z1 + 2e-9) / (n_z1 + 2e-9) AS t1 FROM ss)""",
    "features", po=POST_SQL, ss=STAT_SQL))
def _(t):
    m = em.m_step_columns(em.sufficient_statistics(em.wallet_summary(posterior_rows(t))))
    return m.select(*[r(c, 9).alias(c) for c in m.columns])


@query("agg6_theta_counts", sql("SELECT wallet, round((1 + sum(z1)) / (20 + count(*)), 9) AS theta FROM po WHERE i >= 1 GROUP BY wallet", "features", po=POST_SQL))
def _(t):
    from fillwatch.operators.wallets import theta_without_slopes
    return theta_without_slopes(posterior_rows(t)).select("wallet", r("theta", 9).alias("theta"))


EM_ROUNDS = 40


def em_sql(body: str) -> str:
    """The fit written out: filter, statistics and parameters of each round as views of the one before; ``stop`` is the round it ends with."""
    extra = {"p0": "SELECT 0.1e0 * v AS s0, v AS s1, v AS t0, 0.01e0 * v AS t1, 0.05e0 AS q01, 0.5e0 AS q10 FROM (SELECT var_pop(y) AS v FROM features)"}
    for k in range(EM_ROUNDS):
        lev = "ln(0.05e0 / 0.95e0)" if not k else "ln(th.theta / (1 - th.theta))"
        extra[f"f{k}"] = f"SELECT f.*, p.*, {lev} AS lev FROM features f" + (f" JOIN th{k} th USING (wallet)" if k else "") + f", p{k} p"
        extra[f"g{k}"] = filter_sql(None, f"g{k}", f"f{k}")
        extra[f"po{k}"] = f"""SELECT f.wallet, f.i, f.y, f.delta, f.log_size_ratio, g.mu AS x, g.var, g.v1, g.z1, g.ev, lag(g.mu) OVER w AS px, lag(g.var) OVER w AS pvar,
          lag(g.v1) OVER w AS pv, lag(g.z1) OVER w AS pz FROM g{k} g JOIN features f ON f.market = g.market AND f.i = g.i WINDOW w AS (PARTITION BY f.market ORDER BY f.i)"""
        extra[f"ss{k}"] = STAT_SQL.replace("avg(pz) AS m_z FROM po", f"sum(ev) AS lm FROM po{k}").replace("WHERE delta > 0", "WHERE delta > 0 AND px IS NOT NULL")
        extra[f"th{k + 1}"] = f"""SELECT wallet, (1 + coalesce(sum(z1) FILTER (WHERE i >= 1), 0)) / (20 + count(*) FILTER (WHERE i >= 1)) AS theta,
          20 + count(*) FILTER (WHERE i >= 1) AS d FROM po{k} GROUP BY wallet"""
        extra[f"p{k + 1}"] = f"""SELECT s0, greatest(s1, s0) AS s1, t0, least(t1, t0) AS t1, least(greatest(q01, 1e-6), 1 - 1e-6) AS q01, least(greatest(q10, 1e-6), 1 - 1e-6) AS q10 FROM (
          SELECT (1 + n_01) / (2 + n_01 + n_00) AS q01, (1 + n_10) / (2 + n_10 + n_11) AS q10, greatest((1 + ss_v0 / 2) / (3 + n_v0 / 2), 1e-6) AS s0,
          greatest((1 + ss_v1 / 2) / (3 + n_v1 / 2), 1e-6) AS s1, greatest((ss_z0 + 2e-9) / (n_z0 + 2e-9), 1e-6) AS t0, greatest((ss_z1 + 2e-9) / (n_z1 + 2e-9), 1e-6) AS t1 FROM ss{k})"""
    rounds = range(EM_ROUNDS)
    extra["trace"] = " UNION ALL ".join(f"SELECT {k} AS it, lm FROM ss{k}" for k in rounds)
    extra["stop"] = """SELECT coalesce(min(it) FILTER (WHERE abs(lm - was) / greatest(abs(was), 1) < 1e-3), max(it)) AS it FROM (SELECT *, lag(lm) OVER (ORDER BY it) AS was FROM trace)"""
    extra["thetas"] = " UNION ALL ".join(f"SELECT {k} AS it, * FROM th{k}" for k in range(1, EM_ROUNDS))
    extra["filtered"] = " UNION ALL ".join(f"SELECT {k} AS it, market, i, z1, ev FROM g{k}" for k in rounds)
    text = sql(body, "features", **extra)
    for k in rounds:
        for v in ("f", "po", "ss", "th", "p"):
            text = text.replace(f"\n{v}{k} AS (", f"\n{v}{k} AS MATERIALIZED (")
    return text.replace("\nfeatures AS (", "\nfeatures AS MATERIALIZED (")


@query("fit1_em_trace", em_sql("SELECT CAST(it AS INTEGER) AS it, round(lm, 3) AS log_marginal FROM trace WHERE it <= (SELECT it FROM stop)"))
def _(t):
    fit = em.fit_em(t.stored_features)
    return t.spark.createDataFrame(list(enumerate(fit.trace)), "it INT, log_marginal DOUBLE").withColumn("log_marginal", r("log_marginal", 3))


@query("fit1_em_theta", em_sql("""SELECT wallet, round(theta, 6) AS theta, round(ln(theta / (1 - theta)), 6) AS logit_mean, round(1 / (d * theta * (1 - theta)), 6) AS logit_var
FROM thetas WHERE it = (SELECT it FROM stop)"""))
def _(t):
    return em.fit_em(t.stored_features).theta.select("wallet", *[r(c, 6).alias(c) for c in ("theta", "logit_mean", "logit_var")])


@query("fit1_em_scores", em_sql("""SELECT market, count(*) AS n, round(avg(z1), 6) AS mean_p_z, round(sum(ev), 3) AS log_marginal FROM filtered
WHERE i >= 0 AND it = (SELECT it FROM stop) GROUP BY market"""))
def _(t):
    f = t.stored_features
    return em.fit_em(f).scores(f).groupBy("market").agg(F.count("*").alias("n"), r(F.avg("p_z")).alias("mean_p_z"), r(F.sum("log_evidence"), 3).alias("log_marginal"))


def newton_sql(rounds: int = 30) -> str:
    """Each wallet's penalized level by plain Newton steps, written out."""
    extra = {"po": POST_SQL, "rows": "SELECT wallet, 0.5e0 * log_size_ratio * 0.5e0 - 0.3e0 * pz AS off, z1 AS target FROM po WHERE i >= 1",
             "n0": "SELECT wallet, ln(0.05e0 / 0.95e0) AS phi FROM (SELECT DISTINCT wallet FROM trades)"}
    for k in range(rounds):
        extra[f"n{k + 1}"] = f"""SELECT n.wallet, n.phi + greatest(least((coalesce(sum(target - 1 / (1 + exp(-off - phi))), 0) + 1 - 20 / (1 + exp(-any_value(phi))))
          / (coalesce(sum(1 / (1 + exp(-off - phi)) * (1 - 1 / (1 + exp(-off - phi)))), 0) + 20 / (1 + exp(-any_value(phi))) * (1 - 1 / (1 + exp(-any_value(phi))))), 1), -1) AS phi
          FROM n{k} n LEFT JOIN rows r ON r.wallet = n.wallet GROUP BY n.wallet, n.phi"""
    text = sql(f"""SELECT wallet, round(1 / (1 + exp(-phi)), 6) AS theta, round(phi, 6) AS logit_mean, round(1 / h, 6) AS logit_var FROM (
      SELECT n.wallet, n.phi, coalesce(sum(1 / (1 + exp(-off - phi)) * (1 - 1 / (1 + exp(-off - phi)))), 0) + 20 / (1 + exp(-phi)) * (1 - 1 / (1 + exp(-phi))) AS h
      FROM n{rounds} n LEFT JOIN rows r ON r.wallet = n.wallet GROUP BY n.wallet, n.phi)""", "features", "trades", **extra)
    for k in range(rounds + 1):
        text = text.replace(f"\nn{k} AS (", f"\nn{k} AS MATERIALIZED (")
    return text.replace("\nrows AS (", "\nrows AS MATERIALIZED (")


@query("fit2_theta_newton", newton_sql())
def _(t):
    rows = em.design_rows(posterior_rows(t), 0.0, 1.0, 0.0)
    p = ModelParams(beta_S=0.5, beta_Z=-0.3)
    w = t.trades.select("wallet").distinct().withColumn("theta", F.lit(p.prior_mean))
    return em.theta_newton(rows, w, p).select("wallet", *[r(c, 6).alias(c) for c in ("theta", "logit_mean", "logit_var")])


def slopes_sql(rounds: int = 25) -> str:
    """Pooled intercept and slopes by Newton steps, each a three by three system solved by Cramer's rule."""
    mu = "1 / (1 + exp(-b0 - b1 * c1 - b2 * c2))"
    local = f"""SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2,
      sum(target - {mu}) - 2 * any_value(b0) / (100 + any_value(b0) ** 2) AS g0, sum(c1 * (target - {mu})) - 2 * any_value(b1) / (6.25 + any_value(b1) ** 2) AS g1,
      sum(c2 * (target - {mu})) - 2 * any_value(b2) / (6.25 + any_value(b2) ** 2) AS g2,
      sum({mu} * (1 - {mu})) + 2 / (100 + any_value(b0) ** 2) AS h00, sum(c1 * {mu} * (1 - {mu})) AS h01, sum(c2 * {mu} * (1 - {mu})) AS h02,
      sum(c1 * c1 * {mu} * (1 - {mu})) + 2 / (6.25 + any_value(b1) ** 2) AS h11, sum(c1 * c2 * {mu} * (1 - {mu})) AS h12,
      sum(c2 * c2 * {mu} * (1 - {mu})) + 2 / (6.25 + any_value(b2) ** 2) AS h22 FROM rows, """
    extra = {"po": POST_SQL, "rows": "SELECT log_size_ratio * 0.5e0 AS c1, pz AS c2, z1 AS target FROM po WHERE i >= 1",
             "b0": "SELECT -1.0e0 AS b0, 0.0e0 AS b1, 0.0e0 AS b2"}
    for k in range(rounds):
        extra[f"l{k}"] = f"{local} b{k}"
        extra[f"b{k + 1}"] = f"""SELECT b0 + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / d AS b0,
          b1 + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / d AS b1,
          b2 + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / d AS b2
          FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS d FROM l{k})"""
    extra["last"] = f"{local} b{rounds}"
    text = sql("""SELECT 'alpha' AS name, round(b0, 5) AS value, round(h00, 2) AS information FROM last
      UNION ALL SELECT 'beta_S', round(b1, 5), round(h11, 2) FROM last UNION ALL SELECT 'beta_Z', round(b2, 5), round(h22, 2) FROM last""", "features", **extra)
    for k in range(rounds + 1):
        text = text.replace(f"\nb{k} AS (", f"\nb{k} AS MATERIALIZED (").replace(f"\nl{k} AS (", f"\nl{k} AS MATERIALIZED (")
    return text.replace("\nrows AS (", "\nrows AS MATERIALIZED (")


@query("fit3_slopes", slopes_sql())
def _(t):
    p, info = em.slope_irls(em.design_rows(posterior_rows(t), 0.0, 1.0, 0.0), None, ModelParams(anonymous=True, alpha=-1.0))
    rows = [(n, getattr(p, n), float(info[k][k])) for k, n in enumerate(("alpha", "beta_S", "beta_Z"))]
    return t.spark.createDataFrame(rows, "name STRING, value DOUBLE, information DOUBLE").select("name", r("value", 5).alias("value"), r("information", 2).alias("information"))


@query("fit4_raw_units", """SELECT o_orderkey, round(b * 0.5e0 / s, 9) AS beta_s_raw, round(a - b * 0.5e0 / s * 0.3e0 - 0.2e0 * 0.1e0, 9) AS alpha_raw FROM (SELECT o_orderkey, o_orderkey % 7 / 10.0e0 AS b, (o_custkey % 5 + 1) / 2.0e0 AS s, o_orderkey % 3 - 1 AS a FROM orders)""")
def _(t):
    k = F.col("o_orderkey")
    b, s, a = k % 7 / F.lit(10.0), (F.col("o_custkey") % 5 + 1) / F.lit(2.0), k % 3 - 1
    slope, level = em.raw_units(b, F.lit(0.2), a, F.lit(0.3), s, F.lit(0.1))
    return t.read("orders").select("o_orderkey", r(slope, 9).alias("beta_s_raw"), r(level, 9).alias("alpha_raw"))


@query("fit5_anonymous_level", sql("SELECT market, count(*) AS n, round(sum(ev), 4) AS log_lik FROM g WHERE i >= 0 GROUP BY market", "features", g=FILTER_SQL))
def _(t):
    import math
    from dataclasses import replace
    anon = replace(P, anonymous=True, alpha=math.log(0.05 / 0.95))
    s = scoring.filter_scores(t.stored_features, anon)
    return s.groupBy("market").agg(F.count("*").alias("n"), r(F.sum("log_evidence"), 4).alias("log_lik"))


@query("fit6_shortlist_fit")
def _(t):
    ids = features.wallet_ids(t.trades)
    insiders = t.trades.where(F.col("wallet").cast("long") < 5).select("wallet").distinct()
    return em.shortlist_fit(t.stored_features, ids, insiders)[1]


LAPLACE_SQL = """SELECT name, mean_u, pr AS precision, least(var, 16) AS var_u, bad OR var > 16 AS fallback FROM (
  SELECT *, CASE WHEN bad THEN 1 / greatest(abs(pr), 1e-8) ELSE 1 / pr END AS var FROM (SELECT *, pr <= 0 AS bad FROM (
  SELECT 'sigma2_0' AS name, (0.5 * ss_v0 + 1) / 0.1 AS pr, ln(0.1e0) AS mean_u FROM ss UNION ALL SELECT 'sigma2_1', (0.5 * ss_v1 + 1) / 1.0, ln(1.0e0) FROM ss
  UNION ALL SELECT 'q_01', (n_01 + n_00) * 0.05 * 0.95, ln(0.05e0 / 0.95e0) FROM ss UNION ALL SELECT 'q_10', (n_10 + n_11) * 0.25, ln(0.5e0 / 0.5e0) FROM ss
  UNION ALL SELECT 'tau2_0', 0.5 * ss_z0 + 1e-9, ln(1.0e0) FROM ss UNION ALL SELECT 'tau2_1', (0.5 * ss_z1 + 1e-9) / 0.01, ln(0.01e0) FROM ss)))"""


@query("fit7_laplace", sql("SELECT name, round(mean_u, 9) AS mean_u, round(precision, 4) AS precision, round(var_u, 12) AS var_u, fallback FROM lp", "features", po=POST_SQL, ss=STAT_SQL, lp=LAPLACE_SQL))
def _(t):
    s = em.sufficient_statistics(em.wallet_summary(posterior_rows(t)))
    return em.laplace_rows(s, ModelParams()).select("name", r("mean_u", 9).alias("mean_u"), r("precision", 4).alias("precision"), r("var_u", 12).alias("var_u"), "fallback")


@query("fit7_logpdf", sql("""SELECT draw, round(sum(-0.5 * (ln(2 * pi()) + ln(var_u) + (u - mean_u) * (u - mean_u) / var_u) + jac), 3) AS log_pdf FROM (
  SELECT draw, lp.*, CASE WHEN name LIKE 'q%' THEN ln(x / (1 - x)) ELSE ln(x) END AS u, CASE WHEN name LIKE 'q%' THEN -ln(x) - ln(1 - x) ELSE -ln(x) END AS jac
  FROM (SELECT o_orderkey AS draw, (o_orderkey % 97 + 1) / 100.0e0 AS x FROM orders), lp) GROUP BY draw""", "features", po=POST_SQL, ss=STAT_SQL, lp=LAPLACE_SQL))
def _(t):
    """Density of draws of all six parameters, one draw per order."""
    post = cut(em.laplace_rows(em.sufficient_statistics(em.wallet_summary(posterior_rows(t))), ModelParams()))
    names = F.explode(F.array(*[F.lit(n) for n in ("sigma2_0", "sigma2_1", "q_01", "q_10", "tau2_0", "tau2_1")]))
    draws = t.read("orders").select(F.col("o_orderkey").alias("draw"), names.alias("name"), ((F.col("o_orderkey") % 97 + 1) / F.lit(100.0)).alias("value"))
    return em.laplace_logpdf(draws, post).select("draw", r("log_pdf", 3).alias("log_pdf"))


# ---- streaming: the stream reads files that Spark wrote from the given tables -----------------------------

def streamed(t, build, name, fmt="parquet", ended=False):
    """Write the raw trades as a capture, run a stream over it to the end, and read the sink."""
    base = files.scratch_path(t.spark, name)
    files.write_capture(t.raw, f"{base}/in")
    if ended:
        jobs.end_capture(t.spark, f"{base}/in")
    stream = build(jobs.read_capture_stream(t.spark, f"{base}/in"))
    q = jobs.sink(stream, f"{base}/out", f"{base}/chk", fmt)
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).format(fmt).load(f"{base}/out")


@query("str1_ingest", sql("SELECT market, count(*) AS n, max(ts) AS last_ts FROM raw_trades GROUP BY market", "raw_trades"))
def _(t):
    return streamed(t, lambda s: s, "ingest").groupBy("market").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query("str2_stateful_scores")
def _(t):
    return streamed(t, lambda s: jobs.score_stream(jobs.unique_trades(s), P), "scored")


@query("str5_frozen_stream", sql("SELECT market, count(*) AS n, count(*) AS n_scored FROM trades GROUP BY market", "trades"))
def _(t):
    """Frozen stream scores joined with the batch replay of the same trades: every score must agree."""
    frozen = OnlineConfig(forgetting=1.0)
    live = streamed(t, lambda s: jobs.score_stream(jobs.unique_trades(s), P, frozen), "frozen").where("kind = 'scored'")
    batch = scoring.filter_scores(features.causal_features(t.trades), P).select("tx_hash", F.col("p_z").alias("b"))
    j = live.join(batch, "tx_hash")
    same = F.abs(F.col("p_z") - F.col("b")) < 1e-9
    return j.groupBy("market").agg(F.count("*").alias("n"), F.count(F.when(same, 1)).alias("n_scored"))


@query("str3_stream_dedupe", sql("SELECT market, count(DISTINCT tx_hash) AS n FROM trades GROUP BY market", "trades"))
def _(t):
    out = streamed(t, lambda s: jobs.unique_trades(s.unionByName(s)), "dedupe")
    return out.groupBy("market").agg(F.count("*").alias("n"))


@query("str4_late_policy", sql("""SELECT t.market, CASE WHEN CAST(tx_hash AS BIGINT) % 10 = 0 AND ts < top THEN 'late' ELSE 'scored' END AS kind, count(*) AS n,
max(CASE WHEN CAST(tx_hash AS BIGINT) % 10 = 0 AND ts < top THEN CAST(top - ts AS DOUBLE) END) AS max_late
FROM trades t JOIN (SELECT market, max(ts) AS top FROM trades WHERE CAST(tx_hash AS BIGINT) % 10 <> 0 GROUP BY market) m ON m.market = t.market GROUP BY t.market, 2""", "trades"))
def _(t):
    """Trades shifted back by a varying lag after the scorer has moved on are set aside as late."""
    base = files.scratch_path(t.spark, "late")
    late = F.col("tx_hash").cast("long") % 10 == 0
    files.append_capture(t.trades.where(~late), f"{base}/in")
    chk, out = f"{base}/chk", f"{base}/out"

    def run():
        s = jobs.score_stream(jobs.read_capture_stream(t.spark, f"{base}/in"), P)
        jobs.sink(s, out, chk, "parquet").awaitTermination()

    run()
    files.append_capture(t.trades.where(late), f"{base}/in")
    run()
    return t.spark.read.parquet(out).groupBy("market", "kind").agg(F.count("*").alias("n"), F.max("late_by").alias("max_late"))


@query("str3_trade_routes", sql("""SELECT market, kind, count(*) AS n FROM (
  SELECT market, CASE WHEN NOT coalesce(size > 0 AND price > 0 AND price < 1 AND tx_hash <> '' AND wallet <> '', false) THEN 'invalid' WHEN c = 1 THEN 'trade' ELSE 'duplicate' END AS kind
  FROM raw_trades, (SELECT unnest([1, 2]) AS c)) GROUP BY market, kind""", "raw_trades"))
def _(t):
    """Each trade of the capture comes twice; every row is accounted for."""
    out = streamed(t, lambda s: jobs.route_trades(s.unionByName(s)).drop("late_by"), "routes", ended=True)
    return out.groupBy("market", "kind").agg(F.count("*").alias("n"))


@query("str6_feed_counts", sql("""SELECT market, ts // 3600 * 3600 AS window_start, count(*) AS n_trades, round(sum(size), 4) AS volume, count(DISTINCT ts) AS n_seconds FROM raw_trades
GROUP BY market, ts // 3600""", "raw_trades"))
def _(t):
    return streamed(t, lambda s: jobs.feed_counts(s), "counts", ended=True).withColumn("volume", r("volume", 4))


@query("str6_activity_sessions", sql("""SELECT market, min(ts) AS session_start, max(ts) + 7200 AS session_end, count(*) AS n_trades FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY market ORDER BY ts, tx_hash) AS sid FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY market ORDER BY ts, tx_hash) < 7200 THEN 0 ELSE 1 END AS fresh FROM raw_trades))
GROUP BY market, sid""", "raw_trades"))
def _(t):
    return streamed(t, lambda s: jobs.activity_sessions(s), "sessions", ended=True)
