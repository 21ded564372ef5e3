"""Queries over cleaning, features, wallets and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fillwatch.functions import mathx as mx
from fillwatch.operators import clean, features, vpin, wallets
from fillwatch.plans.registry import query
from fillwatch.plans.views import LONG_CHUNK, sql


def r(col, digits: int = 6):
    """Rounded double for comparison across engines."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


# ---- cleaning -----------------------------------------------------------------------------

@query("flt1_clean_trades", sql("SELECT market, wallet, ts, round(price, 6) AS price, size, side, tx_hash FROM trades_big",
                                "trades_big"))
def _(t):
    return t.trades_big.select("market", "wallet", "ts", r("price").alias("price"), "size", "side", "tx_hash")


@query("flt1_clean_events", sql("SELECT market, count(*) AS n, round(sum(price), 6) AS p, round(sum(size), 4) AS s FROM trades GROUP BY market",
                                "trades"))
def _(t):
    return t.trades.groupBy("market").agg(F.count("*").alias("n"), r(F.sum("price")).alias("p"),
                                          r(F.sum("size"), 4).alias("s"))


@query("flt2_scorable", sql("""SELECT market, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_skipped FROM (
  SELECT market, coalesce(TRY_CAST(size AS DOUBLE) > 0 AND TRY_CAST(price AS DOUBLE) > 0 AND TRY_CAST(price AS DOUBLE) < 1
    AND length(wallet) > 0 AND length(tx_hash) > 0 AND TRY_CAST(ts AS DOUBLE) IS NOT NULL, false) AS ok FROM dirty)
GROUP BY market""", "raw_trades", dirty="""SELECT market, tx_hash, CAST(ts AS VARCHAR) AS ts, CAST(size AS VARCHAR) AS size,
  CASE WHEN CAST(tx_hash AS BIGINT) % 11 = 0 THEN 'n/a' ELSE CAST(price AS VARCHAR) END AS price,
  CASE WHEN CAST(tx_hash AS BIGINT) % 13 = 0 THEN '' ELSE wallet END AS wallet FROM raw_trades"""))
def _(t):
    n = F.col("tx_hash").cast("long")
    dirty = t.raw.select("market", "tx_hash", F.col("ts").cast("string").alias("ts"),
                         F.col("size").cast("string").alias("size"),
                         F.when(n % 11 == 0, "n/a").otherwise(F.col("price").cast("string")).alias("price"),
                         F.when(n % 13 == 0, "").otherwise(F.col("wallet")).alias("wallet"))
    return clean.scorable(dirty).groupBy("market").agg(
        F.count(F.when(F.col("_ok"), 1)).alias("n_ok"), F.count(F.when(~F.col("_ok"), 1)).alias("n_skipped"))


@query("flt3_before_resolution", sql("""SELECT t.market, count(*) AS n, max(t.ts) AS last_ts FROM trades t LEFT JOIN markets m USING (market)
WHERE m.close_ts IS NULL OR t.ts < m.close_ts - 7 * 86400 GROUP BY t.market""", "trades", "markets"))
def _(t):
    return clean.before_resolution(t.trades, t.markets).groupBy("market").agg(
        F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query("flt4_parse_end_date", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL
  ELSE CAST(epoch_us(o_orderdate) // 1000000 AS DOUBLE) + CASE WHEN o_orderkey % 5 IN (1, 2) THEN 3723 ELSE 0 END END AS end_ts FROM orders""")
def _(t):
    d = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    k = F.col("o_orderkey") % 5
    text = F.when(k == 1, F.concat(d, F.lit("T01:02:03Z"))).when(k == 2, F.concat(d, F.lit("T01:02:03"))) \
            .when(k == 4, F.lit("next week")).otherwise(d)
    return t.read("orders").select("o_orderkey", clean.parse_end_date(text).alias("end_ts"))


@query("flt5_select_markets", sql("""SELECT market, round(volume, 4) AS volume FROM markets
WHERE volume >= 100 AND condition_id <> '' AND closed AND question ILIKE '%vote%' ORDER BY volume DESC LIMIT 3""", "markets"))
def _(t):
    return clean.select_markets(t.markets, min_volume=100.0, closed=True, keywords=clean.POLITICS_WORDS, limit=3) \
                .select("market", r("volume", 4).alias("volume"))


@query("flt6_market_for_slug", """SELECT slug, market, closed, round(volume, 2) AS volume FROM (
  SELECT *, row_number() OVER (PARTITION BY slug ORDER BY closed DESC, volume DESC, market) AS k FROM (
    SELECT 'p' || (o_custkey % 50) AS slug, CAST(o_orderkey AS VARCHAR) AS market, o_orderstatus = 'F' AS closed,
      o_totalprice AS volume FROM orders)) WHERE k = 1""")
def _(t):
    m = t.read("orders").select(F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("slug"),
                                F.col("o_orderkey").cast("string").alias("market"),
                                (F.col("o_orderstatus") == "F").alias("closed"), F.col("o_totalprice").alias("volume"))
    return clean.market_for_slug(m).select("slug", "market", "closed", r("volume", 2).alias("volume"))


@query("flt7_shortlist", sql("""SELECT s.ord, m.slug, m.market FROM markets m JOIN
(VALUES (0, 'will-click'), (1, 'will-view'), (2, 'will-nothing')) s(ord, slug) USING (slug)""", "markets"))
def _(t):
    return clean.restrict_to_shortlist(t.markets, ["will-click", "will-view", "will-nothing"]).select("ord", "slug", "market")


@query("flt8_market_filter", sql("SELECT market, count(*) AS n FROM trades WHERE lower(market) IN ('click', 'error') GROUP BY market", "trades"))
def _(t):
    return clean.in_markets(t.trades, ["CLICK", "Error"]).groupBy("market").agg(F.count("*").alias("n"))


@query("flt9_market_tail", sql("""SELECT market, i - greatest(n - 100, 0) AS i, tx_hash,
  CASE WHEN i = greatest(n - 100, 0) THEN 0.0 ELSE delta END AS delta, round(s_bar, 6) AS s_bar
FROM (SELECT *, count(*) OVER (PARTITION BY market) AS n FROM features) WHERE i >= n - 100""", "features"))
def _(t):
    return clean.market_tail(t.stored_features, 100).select("market", "i", "tx_hash", "delta", r("s_bar").alias("s_bar"))


@query("flt10_newest", sql("""SELECT market, tx_hash, ts FROM (SELECT *, row_number() OVER
(PARTITION BY market ORDER BY ts DESC, tx_hash DESC) AS k FROM trades_big) WHERE k <= 20""", "trades_big"))
def _(t):
    return clean.newest(t.trades_big, 20, LONG_CHUNK).select("market", "tx_hash", "ts")


@query("flt11_flagged", sql("SELECT market, count(*) AS n, min(p_z) AS lowest FROM scores WHERE p_z >= 0.9 GROUP BY market", "scores"))
def _(t):
    return clean.flagged(t.scores, 0.9).groupBy("market").agg(F.count("*").alias("n"), F.min("p_z").alias("lowest"))


WIN_A, WIN_B = 1704672000.0, 1705276800.0


@query("flt12_in_window", sql(f"SELECT market, count(*) AS n FROM scores WHERE ts BETWEEN {WIN_A} AND {WIN_B} GROUP BY market", "scores"))
def _(t):
    return clean.in_window(t.scores, WIN_A, WIN_B).groupBy("market").agg(F.count("*").alias("n"))


@query("flt13_anchor", sql("SELECT DISTINCT wallet, regexp_full_match(wallet, '1[0-4].?') OR lower(wallet) = '7' AS anchored FROM trades", "trades"))
def _(t):
    return clean.anchored_wallets(t.trades, "7", "1[0-4].?")


@query("flt14_identity_mode", sql("""SELECT market, CASE WHEN bool_or(market <> 'view' AND wallet IS NOT NULL) THEN 'wallet' ELSE 'anonymous' END AS mode
FROM trades GROUP BY market""", "trades"))
def _(t):
    return clean.identity_mode(t.trades.withColumn("wallet", F.when(F.col("market") != "view", F.col("wallet"))))


@query("flt16_shortlist_wallets", sql("""SELECT market, i - 0 AS orig_i, row_number() OVER w - 1 AS i, tx_hash,
  CASE WHEN row_number() OVER w = 1 THEN 0.0 ELSE CAST(ts - lag(ts) OVER w AS DOUBLE) END AS delta
FROM (SELECT *, count(*) OVER (PARTITION BY market) AS n FROM features_big
      WHERE CAST(substr(wallet, 2) AS BIGINT) % 4 = 0) WHERE n >= 10
WINDOW w AS (PARTITION BY market ORDER BY ts, tx_hash)""", "features_big"))
def _(t):
    f = t.stored_features_big
    keep = f.select("wallet").where(F.substring("wallet", 2, 20).cast("long") % 4 == 0)
    return clean.shortlist_wallets(f, keep, 10, LONG_CHUNK).select("market", "orig_i", "i", "tx_hash", "delta")


@query("flt17_holdout", sql("""SELECT market, split, count(*) AS n, sum(delta) AS gap FROM (SELECT *, CASE WHEN i >= n - round_even(0.2 * n, 0)
THEN 'tail' ELSE 'head' END AS split FROM (SELECT *, count(*) OVER (PARTITION BY market) AS n FROM features_big)) GROUP BY market, split""", "features_big"))
def _(t):
    return clean.holdout_split(t.stored_features_big).groupBy("market", "split").agg(F.count("*").alias("n"), F.sum("delta").alias("gap"))


@query("flt18_regime_conflicts", """SELECT o_custkey, setting, n_values FROM (
  SELECT o_custkey, count(DISTINCT o_orderstatus) AS status, count(DISTINCT o_orderpriority) AS priority FROM orders GROUP BY o_custkey)
UNPIVOT (n_values FOR setting IN (status, priority)) WHERE n_values > 1""")
def _(t):
    o = t.read("orders").select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return clean.regime_conflicts(o, "o_custkey", ["status", "priority"])


# ---- features ------------------------------------------------------------------------------

FEATURE_SQL = """SELECT market, i, tx_hash, delta, round(s_bar, 6) AS s_bar, round(log_size_ratio, 6) AS log_size_ratio,
round(y, 6) AS y FROM {0}"""


@query("win1_features", sql(FEATURE_SQL.format("features"), "features"))
def _(t):
    return t.features.select("market", "i", "tx_hash", "delta", r("s_bar").alias("s_bar"),
                             r("log_size_ratio").alias("log_size_ratio"), r("y").alias("y"))


@query("win1_features_big", sql(FEATURE_SQL.format("features_big"), "features_big"))
def _(t):
    return t.features_big.select("market", "i", "tx_hash", "delta", r("s_bar").alias("s_bar"),
                                 r("log_size_ratio").alias("log_size_ratio"), r("y").alias("y"))


@query("win2_causal_features", sql("""SELECT market, tx_hash, round(avg(size) OVER w, 6) AS s_bar, round(ln(size / avg(size) OVER w), 6) AS log_size_ratio
FROM trades_big WINDOW w AS (PARTITION BY market ORDER BY ts, tx_hash ROWS UNBOUNDED PRECEDING)""", "trades_big"))
def _(t):
    return features.causal_features(t.trades_big, LONG_CHUNK).select(
        "market", "tx_hash", r("s_bar").alias("s_bar"), r("log_size_ratio").alias("log_size_ratio"))


@query("win3_dataset", sql("""SELECT market, count(*) AS n, round(sum(delta), 3) AS span, round(sum(lsr), 6) AS lsr FROM (
  SELECT market, coalesce(ts - lag(ts) OVER w, 0) AS delta, ln(size / avg(size) OVER (PARTITION BY market)) AS lsr FROM (
    SELECT t.* FROM trades t LEFT JOIN markets m USING (market) WHERE m.close_ts IS NULL OR t.ts < m.close_ts - 7 * 86400)
  WINDOW w AS (PARTITION BY market ORDER BY ts, tx_hash)) GROUP BY market""", "trades", "markets"))
def _(t):
    f = features.build_dataset(t.raw, t.markets)
    return f.groupBy("market").agg(F.count("*").alias("n"), r(F.sum("delta"), 3).alias("span"),
                                   r(F.sum("log_size_ratio")).alias("lsr"))


Z_SQL = """SELECT *, CASE WHEN stddev_pop(log_size_ratio) OVER (PARTITION BY market) < 1e-12 THEN 0.0 ELSE
abs((log_size_ratio - avg(log_size_ratio) OVER (PARTITION BY market)) / stddev_pop(log_size_ratio) OVER (PARTITION BY market)) END AS abs_z
FROM features"""


@query("win4_size_zscore", sql("SELECT market, tx_hash, round(abs_z, 6) AS abs_z FROM z", "features", z=Z_SQL))
def _(t):
    return features.size_zscore(t.stored_features).select("market", "tx_hash", r("abs_z").alias("abs_z"))


def sql_horner(x, coeffs):
    out = repr(float(coeffs[0])).replace("e", "E")
    for c in coeffs[1:]:
        out = f"({out} * {x} + {float(c)!r})"
    return out


def sql_cdf(x: str) -> str:
    """The same published CDF approximation in SQL."""
    z = f"abs({x})"
    near = f"exp(-({x})*({x})/2.0) * {sql_horner(z, mx.WEST_NUM)} / {sql_horner(z, mx.WEST_DEN)}"
    frac = f"({z} + 0.65)"
    for k in ("4.0", "3.0", "2.0", "1.0"):
        frac = f"({z} + {k} / {frac})"
    tail = (f"(CASE WHEN {z} > 37.0 THEN 0.0 WHEN {z} < 7.07106781186547 THEN {near} "
            f"ELSE exp(-({x})*({x})/2.0) / {frac} / 2.506628274631 END)")
    return f"(CASE WHEN ({x}) > 0 THEN 1.0 - {tail} ELSE {tail} END)"


BUY_SQL = f"""SELECT *, CASE WHEN dy IS NULL OR sd < 1e-12 THEN 0.5 ELSE {sql_cdf('(dy / sd)')} END AS proxy
FROM (SELECT *, stddev_pop(dy) OVER (PARTITION BY market) AS sd FROM features)"""


@query("win5_buy_fraction", sql("""SELECT market, tx_hash, round(proxy, 6) AS proxy,
round(CASE upper(side) WHEN 'BUY' THEN 1.0 WHEN 'SELL' THEN 0.0 ELSE proxy END, 6) AS native FROM b""", "features", b=BUY_SQL))
def _(t):
    both = features.buy_fraction(features.buy_fraction(t.stored_features).withColumnRenamed("buy_frac", "proxy"), native=True)
    return both.select("market", "tx_hash", r("proxy").alias("proxy"), r("buy_frac").alias("native"))


# Sequential twin of the greedy buckets: one trade per market and step.
BUCKET_STEP = """SELECT market, i, vol, target, 0 AS bucket, vol AS acc FROM v WHERE i = 0
UNION ALL
SELECT v.market, v.i, v.vol, v.target,
  CASE WHEN g.acc >= g.target AND g.bucket < {last} THEN g.bucket + 1 ELSE g.bucket END,
  CASE WHEN g.acc >= g.target AND g.bucket < {last} THEN v.vol ELSE g.acc + v.vol END
FROM g JOIN v ON v.market = g.market AND v.i = g.i + 1"""
VOL_SQL = """SELECT market, i, wallet, tx_hash, side, dy, exp(log_size_ratio) AS vol,
sum(exp(log_size_ratio)) OVER (PARTITION BY market) / {n} AS target FROM features"""


def bucket_sql(body: str, n: int = 50, **extra: str) -> str:
    return sql(body, "features", v=VOL_SQL.format(n=n), g=BUCKET_STEP.format(last=n - 1), **extra)


@query("win6_volume_buckets", bucket_sql("""SELECT market, bucket, count(*) AS n, round(sum(vol), 6) AS vol, max(i) AS last_i
FROM g GROUP BY market, bucket"""))
def _(t):
    return vpin.volume_buckets(t.stored_features).groupBy("market", "bucket").agg(
        F.count("*").alias("n"), r(F.sum("vol")).alias("vol"), F.max("i").alias("last_i"))


@query("win7_elapsed", sql("SELECT market, tx_hash, CAST(ts - min(ts) OVER (PARTITION BY market) AS DOUBLE) AS t FROM features", "features"))
def _(t):
    return features.elapsed(t.stored_features).select("market", "tx_hash", "t")


@query("win8_silence_gaps", sql("""SELECT market, ts - delta AS gap_start, CAST(ts AS DOUBLE) AS gap_end, delta AS gap_seconds
FROM features WHERE delta >= 7200""", "features"))
def _(t):
    return features.silence_gaps(t.features, 7200.0)


@query("win9_backwards", """SELECT market, seq, ts, late_by FROM (SELECT *, max(ts) OVER (PARTITION BY market ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - ts AS late_by FROM (
  SELECT o_orderpriority AS market, o_orderkey AS seq, o_orderkey * 10 + o_custkey % 20 AS ts FROM orders)) WHERE late_by > 0""")
def _(t):
    o = t.read("orders").select(F.col("o_orderpriority").alias("market"), F.col("o_orderkey").alias("seq"),
                                (F.col("o_orderkey") * 10 + F.col("o_custkey") % 20).alias("ts"))
    return features.backwards_rows(o, "seq").select("market", "seq", "ts", "late_by")


# ---- wallets -------------------------------------------------------------------------------

@query("wal1_wallet_ids", sql("SELECT wallet, wallet_id FROM wallet_dim", "wallet_dim"))
def _(t):
    return features.wallet_ids(t.trades)


@query("wal2_size_scores", sql("SELECT wallet, round(max(abs_z), 6) AS score FROM z GROUP BY wallet", "features", z=Z_SQL))
def _(t):
    return wallets.size_scores(t.stored_features).select("wallet", r("score").alias("score"))


@query("wal3_side_sign", sql("SELECT market, sum(CASE upper(side) WHEN 'BUY' THEN 1.0 WHEN 'SELL' THEN -1.0 ELSE 0.0 END) AS net FROM trades_big GROUP BY market", "trades_big"))
def _(t):
    return t.trades_big.groupBy("market").agg(F.sum(features.side_sign()).alias("net"))


VPIN_EXTRA = dict(
    b=BUY_SQL,
    tb="SELECT g.market, g.i, g.bucket, g.vol, b.wallet, {frac} AS bf FROM g, b WHERE b.market = g.market AND b.i = g.i",
    q="SELECT market, bucket, abs(sum(bf * vol) - sum((1 - bf) * vol)) / sum(vol) AS vpin FROM tb GROUP BY market, bucket",
    ws="SELECT wallet, sum(vol * vpin) / sum(vol) AS score FROM tb, q WHERE q.market = tb.market AND q.bucket = tb.bucket GROUP BY wallet")


def vpin_sql(body: str, native: bool = False, **more: str) -> str:
    frac = "CASE upper(b.side) WHEN 'BUY' THEN 1.0 WHEN 'SELL' THEN 0.0 ELSE b.proxy END" if native else "b.proxy"
    return bucket_sql(body, **{k: v.replace("{frac}", frac) for k, v in VPIN_EXTRA.items()}, **more)


@query("wal4_vpin", vpin_sql("SELECT wallet, round(score, 6) AS score FROM ws"))
def _(t):
    return wallets.vpin_scores(t.stored_features).select("wallet", r("score").alias("score"))


@query("wal4_vpin_native", vpin_sql("SELECT wallet, round(score, 6) AS score FROM ws", native=True))
def _(t):
    return wallets.vpin_scores(t.stored_features, native=True).select("wallet", r("score").alias("score"))


@query("wal5_wallet_volumes", sql("SELECT wallet, round(sum(exp(log_size_ratio)), 6) AS volume FROM features_big GROUP BY wallet", "features_big"))
def _(t):
    return wallets.wallet_volumes(t.features_big).select("wallet", r("volume").alias("volume"))


@query("wal6_volume_controlled", sql("""SELECT wallet, round(score - (a + b * ln(volume)), 6) AS residual FROM w,
(SELECT regr_slope(score, ln(volume)) AS b, regr_intercept(score, ln(volume)) AS a FROM w)""", "features", z=Z_SQL,
    w="SELECT wallet, max(abs_z) AS score, sum(exp(log_size_ratio)) AS volume FROM z GROUP BY wallet"))
def _(t):
    f = t.stored_features
    return wallets.volume_controlled(wallets.size_scores(f), wallets.wallet_volumes(f)).select("wallet", r("residual").alias("residual"))


RHO_SQL = "SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM pairs)"


@query("wal7_vpin_robustness", bucket_sql(RHO_SQL, b=BUY_SQL,
    tb="""SELECT g.market, g.bucket, g.vol, b.wallet, b.proxy AS bf,
  CASE upper(b.side) WHEN 'BUY' THEN 1.0 WHEN 'SELL' THEN 0.0 ELSE b.proxy END AS nf FROM g, b WHERE b.market = g.market AND b.i = g.i""",
    q="""SELECT market, bucket, abs(sum(bf * vol) - sum((1 - bf) * vol)) / sum(vol) AS pv,
  abs(sum(nf * vol) - sum((1 - nf) * vol)) / sum(vol) AS nv FROM tb GROUP BY market, bucket""",
    pairs="SELECT wallet, sum(vol * nv) / sum(vol) AS a, sum(vol * pv) / sum(vol) AS b FROM tb, q WHERE q.market = tb.market AND q.bucket = tb.bucket GROUP BY wallet"))
def _(t):
    return wallets.vpin_robustness(t.stored_features).select(r("rho").alias("rho"), "n")


def wash_sql(view: str, w: int) -> dict[str, str]:
    return dict(
        el=f"SELECT market, wallet, ts, sign(dy) AS s FROM {view} WHERE dy <> 0",
        hit=f"""SELECT market, wallet, count(*) AS eligible, count(*) FILTER (WHERE opp > 0) AS hits FROM (
  SELECT market, wallet, CASE WHEN s > 0 THEN count(*) FILTER (WHERE s < 0) OVER w ELSE count(*) FILTER (WHERE s > 0) OVER w END AS opp
  FROM el WINDOW w AS (PARTITION BY market, wallet ORDER BY ts RANGE BETWEEN {w} PRECEDING AND {w} FOLLOWING)) GROUP BY market, wallet""",
        wash=f"""SELECT wallet, CASE WHEN sum(eligible) > 0 THEN sum(hits) / sum(eligible) ELSE 0.0 END AS score FROM (
  SELECT n.wallet, hits, eligible FROM (SELECT market, wallet, count(*) AS n FROM {view} GROUP BY market, wallet HAVING count(*) >= 2) n
  JOIN hit ON hit.market = n.market AND hit.wallet = n.wallet) GROUP BY wallet""")


@query("jon6_wash_hits", sql("SELECT * FROM hit", "features", **wash_sql("features", 21600)))
def _(t):
    return wallets.wash_hits(t.features, 21600.0)


@query("wal8_wash_scores", sql("""SELECT d.wallet, round(coalesce(score, 0), 6) AS score FROM (SELECT DISTINCT wallet FROM features_big) d
LEFT JOIN wash USING (wallet)""", "features_big", **wash_sql("features_big", 2592000)))
def _(t):
    return wallets.wash_scores(t.stored_features_big, 2592000.0).select("wallet", r("score").alias("score"))


@query("wal9_ordinal_ranks", sql("""SELECT wallet, row_number() OVER (ORDER BY score, wallet) - 1 AS rank FROM (
  SELECT wallet, round(sum(size), 3) AS score FROM trades_big GROUP BY wallet)""", "trades_big"))
def _(t):
    s = t.trades_big.groupBy("wallet").agg(r(F.sum("size"), 3).alias("score"))
    return wallets.ordinal_ranks(s).select("wallet", "rank")


PRE_SQL = """SELECT *, row_number() OVER (ORDER BY combined DESC, wallet_id) <= greatest(ceil(0.5 * n), ceil(0.1 * n)) AS flagged FROM (
  SELECT wallet, wallet_id, count(*) OVER () AS n, (row_number() OVER (ORDER BY size_zscore, wallet_id) - 1
    + row_number() OVER (ORDER BY vpin, wallet_id) - 1 + row_number() OVER (ORDER BY wash, wallet_id) - 1) / 3.0 AS combined FROM c)"""


@query("wal10_prefilter", vpin_sql("SELECT wallet, wallet_id, round(combined, 6) AS combined, flagged FROM p", z=Z_SQL,
    **wash_sql("features", 60),
    dim="""SELECT wallet, row_number() OVER (ORDER BY market, ts, tx_hash) - 1 AS wallet_id FROM (
  SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY market, ts, tx_hash) AS k FROM trades) WHERE k = 1""",
    c="""SELECT dim.wallet, wallet_id, coalesce(sz.score, 0) AS size_zscore, coalesce(ws.score, 0) AS vpin, coalesce(wash.score, 0) AS wash
FROM dim LEFT JOIN (SELECT wallet, max(abs_z) AS score FROM z GROUP BY wallet) sz ON sz.wallet = dim.wallet
LEFT JOIN ws ON ws.wallet = dim.wallet LEFT JOIN wash ON wash.wallet = dim.wallet""", p=PRE_SQL))
def _(t):
    out = wallets.prefilter(t.stored_features, features.wallet_ids(t.trades))
    return out.select("wallet", "wallet_id", r("combined").alias("combined"), "flagged")


@query("wal11_two_tier", sql("""SELECT wallet, round(CASE WHEN flagged THEN theta ELSE coalesce(min(theta) FILTER (WHERE flagged) OVER (), min(theta) OVER ())
 - 1 - wallet_id / count(*) OVER () END, 9) AS tier_score FROM (
  SELECT wallet, wallet_id, avg(p_z) AS theta, count(*) % 2 = 0 AS flagged FROM scores JOIN wallet_dim USING (wallet) GROUP BY wallet, wallet_id)""",
    "scores", "wallet_dim"))
def _(t):
    s = t.scores.groupBy("wallet").agg(F.avg("p_z").alias("theta"), (F.count("*") % 2 == 0).alias("flagged"))
    return wallets.two_tier(s.join(features.wallet_ids(t.trades), "wallet")).select("wallet", r("tier_score", 9).alias("tier_score"))


@query("wal12_counted_trades", sql("""SELECT d.wallet, d.wallet_id, count(f.i) AS n_trades FROM wallet_dim d
LEFT JOIN (SELECT * FROM features WHERE i >= 1) f USING (wallet) GROUP BY d.wallet, d.wallet_id""", "features", "wallet_dim"))
def _(t):
    return wallets.counted_trades(t.features, features.wallet_ids(t.trades))


@query("wal13_mean_score", sql("SELECT wallet, round(avg(p_z), 9) AS mean_p_z FROM scores GROUP BY wallet", "scores"))
def _(t):
    ids = t.trades.select("wallet").distinct()
    return wallets.mean_filtered_score(t.scores, ids).select("wallet", r("mean_p_z", 9).alias("mean_p_z"))


# ---- aggregates, joins, top-k --------------------------------------------------------------

@query("agg1_market_stats", sql("""SELECT market, count(*) AS n_trades, round(avg(size), 6) AS s_bar, min(ts) AS first_ts, max(ts) AS last_ts,
count(DISTINCT wallet) AS n_wallets FROM trades_big GROUP BY market""", "trades_big"))
def _(t):
    return features.market_stats(t.trades_big).withColumn("s_bar", r("s_bar"))


@query("agg2_standardization", sql("SELECT round(avg(log_size_ratio), 6) AS m_s, round(stddev_pop(log_size_ratio), 6) AS s_s FROM features_big", "features_big"))
def _(t):
    return features.standardization(t.features_big).select(r("m_s").alias("m_s"), r("s_s").alias("s_s"))


@query("agg3_starting_variances", sql("""SELECT round(0.1 * v, 6) AS sigma2_0, round(v, 6) AS sigma2_1, round(v, 6) AS tau2_0, round(0.01 * v, 6) AS tau2_1
FROM (SELECT var_pop(y) AS v FROM features_big)""", "features_big"))
def _(t):
    return features.starting_variances(t.features_big).select(*[r(c).alias(c) for c in ("sigma2_0", "sigma2_1", "tau2_0", "tau2_1")])


@query("jon2_encode_wallets", sql("SELECT tx_hash, wallet_id FROM trades JOIN wallet_dim USING (wallet)", "wallet_dim"))
def _(t):
    return features.encode_wallets(t.trades, features.wallet_ids(t.trades)).select("tx_hash", "wallet_id")


@query("top1_top_k", sql("""SELECT wallet, wallet_id FROM (SELECT wallet, wallet_id, count(*) AS n FROM trades JOIN wallet_dim USING (wallet)
GROUP BY wallet, wallet_id ORDER BY n DESC, wallet_id LIMIT 10)""", "wallet_dim"))
def _(t):
    n = t.trades.groupBy("wallet").agg(F.count("*").alias("score"))
    return wallets.top_k(n.join(features.wallet_ids(t.trades), "wallet"), 10).select("wallet", "wallet_id")


@query("top2_wallet_ranking", sql("""SELECT row_number() OVER (ORDER BY score DESC, wallet_id) AS rank, wallet, wallet_id, round(score, 6) AS score, n_trades FROM (
  SELECT wallet, wallet_id, max(round(abs_z, 6)) AS score, count(*) FILTER (WHERE i >= 1) AS n_trades FROM z JOIN wallet_dim USING (wallet) GROUP BY wallet, wallet_id)""",
    "features", "wallet_dim", z=Z_SQL))
def _(t):
    s = wallets.size_scores(t.stored_features).select("wallet", r("score").alias("score"))
    counts = wallets.counted_trades(t.stored_features, features.wallet_ids(t.trades))
    return wallets.ranking_table(s, counts).select("rank", "wallet", "wallet_id", "score", "n_trades")


@query("set1_concat", sql("SELECT market, count(*) AS n FROM (SELECT market FROM trades UNION ALL SELECT market FROM trades_big) GROUP BY market", "trades", "trades_big"))
def _(t):
    return features.concat_markets(t.trades, t.trades_big).groupBy("market").agg(F.count("*").alias("n"))

