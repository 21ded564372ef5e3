"""Trade, market, score, draw and replicate tables derived from the given parquet tables.

Every derivation exists twice: as a Spark plan (``Tables``) and as a SQL view
text for the independent check (``CTES``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.config import DAY
from fillwatch.operators import clean, features
from fillwatch.session import cut, prepare

#: Day-resolution history spans years, so its chunks are a month wide.
LONG_CHUNK = 30 * DAY


def _seconds(col: str):
    return F.unix_seconds(F.col(col).cast("timestamp"))


class Tables:
    """Lazily derived tables over one folder of parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        prepare(spark)
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # -- event-based trades: few markets, dense in time
    @cached_property
    def raw(self) -> DataFrame:
        side = F.when(F.col("event_id") % 3 == 0, "BUY").when(F.col("event_id") % 3 == 1, "SELL").otherwise("")
        return self.read("events").select(
            F.col("event_type").alias("market"), F.col("user_id").cast("string").alias("wallet"),
            _seconds("ts").alias("ts"),
            (F.regexp_extract("props", "([0-9]+)", 1).cast("double") / F.lit(99.0)).alias("price"),
            F.col("value").alias("size"), side.alias("side"), F.col("event_id").cast("string").alias("tx_hash"))

    @cached_property
    def trades(self) -> DataFrame:
        return clean.clean_trades(self.raw)

    @cached_property
    def features(self) -> DataFrame:
        return features.compute_features(cut(self.trades))  # the features read the trades twice

    @cached_property
    def stored_features(self) -> DataFrame:
        """Features written once, for queries that read them several times."""
        return cut(self.features)

    @cached_property
    def markets(self) -> DataFrame:
        m = F.col("market")
        per = self.raw.groupBy("market").agg(F.max("ts").alias("t1"), F.sum("size").alias("volume"))
        return per.select(
            "market", F.when(m != "view", F.col("t1").cast("double")).alias("close_ts"),
            F.when(m != "signup", (F.length("market") % 2).cast("double")).alias("outcome"),
            m.alias("condition_id"), F.concat(F.lit("will-"), m).alias("slug"),
            F.concat(F.lit("Will the "), m, F.when(F.length("market") > 5, " vote pass?").otherwise(" rise?"))
            .alias("question"), "volume", (m != "view").alias("closed"),
            F.when(m != "view", F.date_format(F.timestamp_seconds("t1"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("end_date"))

    @cached_property
    def scores(self) -> DataFrame:
        """Stand-in scores computed from the row itself, so that analyses of scores have exact twins."""
        n = F.col("tx_hash").cast("long")
        return self.trades.select(
            F.col("ts").cast("double").alias("ts"), "tx_hash", "market", "wallet",
            (n * 7919 % 1000 / F.lit(1000.0)).alias("p_z"), (n * 104729 % 1000 / F.lit(1000.0)).alias("p_v"),
            F.log(F.col("price") / (1.0 - F.col("price"))).alias("x_mean"))

    # -- order-based trades: many markets, years of history, repeated hashes and ties
    def _orders(self, market) -> DataFrame:
        li, od = self.read("lineitem"), self.read("orders")
        side = F.when(F.col("l_returnflag") == "A", "BUY").when(F.col("l_returnflag") == "R", "SELL").otherwise("")
        return li.join(od, li.l_orderkey == od.o_orderkey).select(
            market.alias("market"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("wallet"),
            _seconds("l_shipdate").alias("ts"), F.round(F.col("l_discount") * 10, 6).alias("price"),
            F.col("l_quantity").alias("size"), side.alias("side"),
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("tx_hash"),
            ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 101) % 1000 / F.lit(1000.0)).alias("p_z"))

    @cached_property
    def raw_big_scored(self) -> DataFrame:
        return self._orders(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))

    @cached_property
    def raw_big(self) -> DataFrame:
        return self.raw_big_scored.drop("p_z")

    @cached_property
    def trades_big(self) -> DataFrame:
        return clean.clean_trades(self.raw_big)

    @cached_property
    def features_big(self) -> DataFrame:
        return features.compute_features(cut(self.trades_big), LONG_CHUNK)

    @cached_property
    def stored_features_big(self) -> DataFrame:
        return cut(self.features_big)

    @cached_property
    def raw_month(self) -> DataFrame:
        d = F.col("l_shipdate")
        return self._orders(F.concat(F.lit("m"), (F.year(d) * 100 + F.month(d)).cast("string")))

    @cached_property
    def scores_month(self) -> DataFrame:
        kept = clean.clean_trades(self.raw_month)  # p_z comes last in the tie order
        return cut(kept.select(F.col("ts").cast("double").alias("ts"), "tx_hash", "market", "wallet", "p_z",
                               F.col("p_z").alias("p_v"), F.log(F.col("price") / (1.0 - F.col("price"))).alias("x_mean")))

    @cached_property
    def markets_month(self) -> DataFrame:
        per = self.raw_month.groupBy("market").agg(F.max("ts").alias("t1"))
        return per.select("market", F.col("t1").cast("double").alias("close_ts"),
                          (F.substring("market", 6, 2).cast("int") % 2).cast("double").alias("outcome"))

    # -- labels, draws, replicates
    @cached_property
    def labelled(self) -> DataFrame:
        return self.read("labels").join(self.read("documents").select("doc_id", "lang", "n_chars"), "doc_id").select(
            "doc_id", F.col("lang").alias("market"), F.col("toxic").alias("z_true"),
            F.col("quality").alias("z_quality"), F.col("n_chars").cast("double").alias("z_score"))

    @cached_property
    def draws(self) -> DataFrame:
        return self.read("embeddings").select(
            F.lit("r0").alias("run_id"), F.col("vec_id").alias("iter"), F.col("label").alias("chain"),
            F.posexplode("embedding").alias("idx", "value")).select(
            "run_id", F.concat(F.lit("p"), F.col("idx").cast("string")).alias("name"), "idx", "iter", "chain",
            F.col("value").cast("double").alias("value"))

    @cached_property
    def replicate_ranks(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.read("orders").select(
            k.alias("seed"), F.col("o_orderstatus").alias("component"), (k * 31 % 100).cast("int").alias("rank"),
            (k * 17 % 10 != 0).alias("hit"), F.col("o_orderpriority").alias("priority"),
            F.col("o_totalprice").alias("elapsed_s"))


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "raw_trades": ((), """SELECT event_type AS market, CAST(user_id AS VARCHAR) AS wallet,
  CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 99.0 AS price, value AS size,
  CASE event_id % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE '' END AS side,
  CAST(event_id AS VARCHAR) AS tx_hash FROM events"""),
    "trades": (("raw_trades",), """SELECT market, wallet, ts, price, size, side, tx_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY tx_hash
    ORDER BY ts, price, size, wallet, market, side) AS k FROM raw_trades
  WHERE size > 0 AND price > 0 AND price < 1 AND tx_hash <> '' AND wallet <> '') WHERE k = 1"""),
    "features": (("trades",), """SELECT market, wallet, ts, price, size, side, tx_hash, i, s_bar, y,
  CASE WHEN i = 0 THEN 0.0 ELSE CAST(ts - pts AS DOUBLE) END AS delta, ln(size / s_bar) AS log_size_ratio, y - py AS dy
FROM (SELECT *, row_number() OVER w - 1 AS i, lag(ts) OVER w AS pts, lag(y) OVER w AS py,
  avg(size) OVER (PARTITION BY market) AS s_bar
  FROM (SELECT *, ln(least(greatest(price, 1e-6), 1 - 1e-6) / (1 - least(greatest(price, 1e-6), 1 - 1e-6))) AS y FROM trades)
  WINDOW w AS (PARTITION BY market ORDER BY ts, tx_hash))"""),
    "markets": (("raw_trades",), """SELECT market, CASE WHEN market <> 'view' THEN CAST(t1 AS DOUBLE) END AS close_ts,
  CASE WHEN market <> 'signup' THEN CAST(length(market) % 2 AS DOUBLE) END AS outcome, market AS condition_id,
  'will-' || market AS slug,
  'Will the ' || market || CASE WHEN length(market) > 5 THEN ' vote pass?' ELSE ' rise?' END AS question,
  volume, market <> 'view' AS closed,
  CASE WHEN market <> 'view' THEN strftime(make_timestamp(t1 * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS end_date
FROM (SELECT market, max(ts) AS t1, sum(size) AS volume FROM raw_trades GROUP BY market)"""),
    "scores": (("trades",), """SELECT CAST(ts AS DOUBLE) AS ts, tx_hash, market, wallet,
  (CAST(tx_hash AS BIGINT) * 7919 % 1000) / 1000.0 AS p_z, (CAST(tx_hash AS BIGINT) * 104729 % 1000) / 1000.0 AS p_v,
  ln(price / (1 - price)) AS x_mean FROM trades"""),
    "raw_big": ((), """SELECT 's' || l_suppkey AS market, 'c' || o_custkey AS wallet,
  CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT) AS ts, round(l_discount * 10, 6) AS price, l_quantity AS size,
  CASE l_returnflag WHEN 'A' THEN 'BUY' WHEN 'R' THEN 'SELL' ELSE '' END AS side,
  l_orderkey || '-' || l_linenumber AS tx_hash,
  ((l_partkey * 37 + l_linenumber * 101) % 1000) / 1000.0 AS p_z,
  'm' || (year(l_shipdate) * 100 + month(l_shipdate)) AS month_market
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "trades_big": (("raw_big",), """SELECT market, wallet, ts, price, size, side, tx_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY tx_hash
    ORDER BY ts, price, size, wallet, market, side) AS k FROM raw_big
  WHERE size > 0 AND price > 0 AND price < 1 AND tx_hash <> '' AND wallet <> '') WHERE k = 1"""),
    "features_big": (("trades_big",), """SELECT market, wallet, ts, price, size, side, tx_hash, i, s_bar, y,
  CASE WHEN i = 0 THEN 0.0 ELSE CAST(ts - pts AS DOUBLE) END AS delta, ln(size / s_bar) AS log_size_ratio, y - py AS dy
FROM (SELECT *, row_number() OVER w - 1 AS i, lag(ts) OVER w AS pts, lag(y) OVER w AS py,
  avg(size) OVER (PARTITION BY market) AS s_bar
  FROM (SELECT *, ln(least(greatest(price, 1e-6), 1 - 1e-6) / (1 - least(greatest(price, 1e-6), 1 - 1e-6))) AS y FROM trades_big)
  WINDOW w AS (PARTITION BY market ORDER BY ts, tx_hash))"""),
    "scores_month": (("raw_big",), """SELECT CAST(ts AS DOUBLE) AS ts, tx_hash, month_market AS market, wallet, p_z,
  ln(price / (1 - price)) AS x_mean FROM (
  SELECT *, row_number() OVER (PARTITION BY tx_hash
    ORDER BY ts, price, size, wallet, month_market, side, p_z) AS k FROM raw_big
  WHERE size > 0 AND price > 0 AND price < 1 AND tx_hash <> '' AND wallet <> '') WHERE k = 1"""),
    "markets_month": (("raw_big",), """SELECT month_market AS market, CAST(max(ts) AS DOUBLE) AS close_ts,
  CAST(CAST(substr(month_market, 6, 2) AS INTEGER) % 2 AS DOUBLE) AS outcome FROM raw_big GROUP BY month_market"""),
    "labelled": ((), """SELECT l.doc_id, d.lang AS market, l.toxic AS z_true, l.quality AS z_quality,
  CAST(d.n_chars AS DOUBLE) AS z_score FROM labels l JOIN documents d USING (doc_id)"""),
    "draws": ((), """SELECT 'r0' AS run_id, 'p' || (k - 1) AS name, k - 1 AS idx, vec_id AS iter, label AS chain,
  CAST(embedding[k] AS DOUBLE) AS value
FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)"""),
    "replicate_ranks": ((), """SELECT o_orderkey AS seed, o_orderstatus AS component, CAST(o_orderkey * 31 % 100 AS INTEGER) AS rank,
  (o_orderkey * 17 % 10 <> 0) AS hit, o_orderpriority AS priority, o_totalprice AS elapsed_s FROM orders"""),
    "wallet_dim": (("trades",), """SELECT wallet, row_number() OVER (ORDER BY market, ts, tx_hash) - 1 AS wallet_id FROM (
  SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY market, ts, tx_hash) AS k FROM trades) WHERE k = 1"""),
}


def sql(body: str, *names: str, **extra: str) -> str:
    """Prefix ``body`` with the named views (and what they build on) plus ad-hoc ones."""
    seen: dict[str, str] = {}

    def add(name: str) -> None:
        if name in seen:
            return
        for dep in CTES[name][0]:
            add(dep)
        seen[name] = CTES[name][1]

    for n in names:
        add(n)
    seen.update(extra)
    parts = ",\n".join(f"{n} AS ({t})" for n, t in seen.items())
    recursive = "RECURSIVE " if any(f"FROM {n} " in t or f"JOIN {n} " in t for n, t in extra.items()) else ""
    return f"WITH {recursive}{parts}\n{body}"
