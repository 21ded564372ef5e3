"""Queries that write derived tables to shared storage in a library format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fillwatch.operators import em, features, wallets
from fillwatch.plans.queries_analysis import STORE_SQL, replicate_store
from fillwatch.plans.queries_core import Z_SQL, r
from fillwatch.plans.queries_model import P, streamed
from fillwatch.plans.registry import query
from fillwatch.plans.views import sql
from fillwatch.session import cut
from fillwatch.sources import files, venues
from fillwatch.streaming import jobs


@query("src3_tail_capture", sql("SELECT market, count(*) AS n, round(sum(price), 6) AS p FROM raw_trades GROUP BY market", "raw_trades"))
def _(t):
    base = files.scratch_path(t.spark, "tail")
    files.write_capture(t.raw, f"{base}/in")
    tail = jobs.read_capture_stream(t.spark, f"{base}/in", files_per_trigger=1)
    jobs.sink(tail, f"{base}/out", f"{base}/chk", "parquet").awaitTermination()
    return t.spark.read.schema(tail.schema).parquet(f"{base}/out").groupBy("market").agg(F.count("*").alias("n"), r(F.sum("price")).alias("p"))


@query("src6_tag_lists", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus || '|' || o_orderpriority WHEN 1 THEN o_orderpriority ELSE '' END AS tags FROM orders""")
def _(t):
    k = F.col("o_orderkey") % 3
    plain = F.to_json(F.struct("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("tags")))
    objects = F.to_json(F.struct("o_orderkey", F.array(F.struct(F.col("o_orderpriority").alias("name")), F.struct(F.lit("").alias("name"))).alias("tags")))
    texts = t.read("orders").select("o_orderkey", F.when(k == 0, plain).when(k == 1, objects).otherwise(F.lit("{}")).alias("value"))
    d = F.from_json("value", venues.MARKET_JSON)
    return texts.select("o_orderkey", F.array_join(venues.tag_list(d["tags"]), "|").alias("tags"))


@query("src8_yes_price", """SELECT o_orderkey, round(CASE o_orderkey % 4 WHEN 0 THEN p WHEN 1 THEN c / 100.0 WHEN 2 THEN 1 - p ELSE 1 - c / 100.0 END, 6) AS price
FROM (SELECT o_orderkey, (o_custkey % 99 + 1) / 100.0e0 AS p, o_custkey % 99 + 1 AS c FROM orders)""")
def _(t):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey") % 99 + 1
    dollars = (c / F.lit(100.0)).cast("string")
    d = F.struct(F.when(k == 0, dollars).alias("yes_price_dollars"), F.when(k == 1, c.cast("string")).alias("yes_price"),
                 F.when(k == 2, dollars).alias("no_price_dollars"), F.when(k == 3, c.cast("string")).alias("no_price"))
    return t.read("orders").select("o_orderkey", d.alias("d")).select("o_orderkey", r(venues.yes_price(F.col("d"))).alias("price"))


@query("src9_contract_count", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice, 2) ELSE CAST(o_custkey AS DOUBLE) END AS size FROM orders")
def _(t):
    d = F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice").cast("string")).alias("count_fp"), F.col("o_custkey").cast("string").alias("count"))
    return t.read("orders").select("o_orderkey", d.alias("d")).select("o_orderkey", r(venues.contract_count(F.col("d")), 2).alias("size"))


@query("src18_provenance", sql("SELECT 'replay' AS mode, 'events' AS input, count(*) AS n FROM scores", "scores"))
def _(t):
    path = files.scratch_path(t.spark, "provenance")
    files.write_scores(t.scores, path, "replay", "events")
    n = files.load_scores(t.spark, path).agg(F.count("*").alias("n"))
    return files.replay_provenance(t.spark, path).select("mode", "input").join(F.broadcast(n))


@query("src19_replicates", sql("SELECT failed, degenerate, count(*) AS n, sum(CASE WHEN failed THEN NULL ELSE rank END)::BIGINT AS rank_sum FROM s GROUP BY failed, degenerate", "replicate_ranks", s=STORE_SQL))
def _(t):
    from fillwatch.operators.calibration import replicate_flags
    path = files.scratch_path(t.spark, "replicates")
    store = replicate_store(t).withColumn("schema_version", F.lit(1))
    store.unionByName(store.where("seed % 3 = 0")).write.json(path)  # a third of the rows twice
    rows = replicate_flags(files.load_replicates(t.spark, path))
    total = F.aggregate(F.map_values("ranks"), F.lit(0), lambda a, x: a + x)
    return rows.groupBy("failed", "degenerate").agg(F.count("*").alias("n"), F.sum(total).alias("rank_sum"))


@query("src22_manifest", sql("SELECT market, slug, question FROM markets", "markets"))
def _(t):
    path = files.scratch_path(t.spark, "manifest")
    listed = F.sort_array(F.collect_list(F.struct(F.col("market").alias("condition_id"), "slug", "question")))  # a manifest lists a handful
    t.markets.agg(F.to_json(F.struct(
        F.lit(1).alias("schema_version"), F.lit("events").alias("case"), listed.alias("markets"),
        F.struct(F.lit("2024-01-08T00:00:00Z").alias("start"), F.lit("2024-01-20T00:00:00Z").alias("end")).alias("analysis_window")))).write.text(path)
    return files.manifest_markets(files.load_manifest(t.spark, path))


@query("src23_benchmark_rows", """SELECT CAST(o_orderkey AS VARCHAR) AS label, o_orderstatus AS method, round(o_totalprice, 2) AS mean_sec, o_orderkey % 2 = 0 AS gate_pass FROM orders WHERE o_orderkey % 5 <> 0""")
def _(t):
    k = F.col("o_orderkey")
    gate = F.when(k % 5 != 0, F.struct(F.lit(0.9).alias("pooled_auc"), (k % 2 == 0).alias("gate_pass")))
    texts = t.read("orders").select(k.cast("string").alias("label"), F.to_json(F.struct(
        F.col("o_orderstatus").alias("method"), gate.alias("gate"), F.struct(F.col("o_totalprice").alias("mean_sec_per_run")).alias("timings"))).alias("value"))
    return files.benchmark_rows(texts).select("label", "method", r("mean_sec", 2).alias("mean_sec"), "gate_pass")


@query("src24_warm_start", sql("SELECT count(DISTINCT wallet) AS n_wallets, count(DISTINCT wallet) AS n_equal FROM trades", "trades"))
def _(t):
    path = files.scratch_path(t.spark, "artifact")
    fit = em.fit_em(t.stored_features)
    files.save_warm_start(fit, t.spark, path)
    theta = files.load_warm_start(t.spark, path)[4]
    j = theta.join(fit.theta.select("wallet", F.col("theta").alias("was")), "wallet")
    return j.agg(F.count("*").alias("n_wallets"), F.count(F.when(F.col("theta") == F.col("was"), 1)).alias("n_equal"))


@query("snk1_stream_sink", sql("SELECT market, count(*) AS n, max(ts) AS last_ts FROM raw_trades GROUP BY market", "raw_trades"))
def _(t):
    base = files.scratch_path(t.spark, "sink")
    files.write_capture(t.raw, f"{base}/in")
    jobs.sink_capture(jobs.read_capture_stream(t.spark, f"{base}/in"), f"{base}/out", f"{base}/chk").awaitTermination()
    return files.read_capture(t.spark, f"{base}/out")[0].groupBy("market").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query("snk3_canonical_capture", sql("SELECT count(*) AS n, 0 AS n_out_of_order FROM raw_trades", "raw_trades"))
def _(t):
    """Every file of the capture is sorted by (ts, hash): no line is older than the line before it."""
    path = files.scratch_path(t.spark, "canonical")
    files.write_capture(t.raw, path)
    lines = t.spark.read.json(path, schema="timestamp LONG, transaction_hash STRING").select(
        F.input_file_name().alias("market"), F.monotonically_increasing_id().alias("seq"), F.col("timestamp").alias("ts"))
    bad = features.backwards_rows(lines, "seq").agg(F.count("*").cast("int").alias("n_out_of_order"))
    return lines.agg(F.count("*").alias("n")).join(F.broadcast(bad))


@query("snk5_score_sink", sql("SELECT market, 2 * count(*) AS n FROM scores GROUP BY market", "scores"))
def _(t):
    """Replay truncates, live appends: replay, replay, live leaves every score twice."""
    path = files.scratch_path(t.spark, "score-sink")
    for mode in ("replay", "replay", "live"):
        files.write_scores(t.scores, path, mode, "events")
    return files.load_scores(t.spark, path).groupBy("market").agg(F.count("*").alias("n"))


@query("snk6_summary", sql("SELECT 3 AS schema_version, 'events' AS origin, count(*) AS n_trades, count(DISTINCT wallet) AS n_wallets FROM trades", "trades"))
def _(t):
    path = files.scratch_path(t.spark, "summary")
    s = t.trades.agg(F.count("*").alias("n_trades"), F.count_distinct("wallet").alias("n_wallets"))
    files.write_summary(s, path, 3, origin="events")
    return t.spark.read.json(path, schema="schema_version INT, origin STRING, n_trades LONG, n_wallets LONG")


@query("snk7_ranking_csv", sql("""SELECT row_number() OVER (ORDER BY score DESC, wallet_id) AS rank, wallet, score FROM (
  SELECT wallet, wallet_id, max(round(abs_z, 6)) AS score FROM z JOIN wallet_dim USING (wallet) GROUP BY wallet, wallet_id)""", "features", "wallet_dim", z=Z_SQL))
def _(t):
    path = files.scratch_path(t.spark, "csv")
    s = wallets.size_scores(t.stored_features).select("wallet", r("score").alias("score"))
    table = wallets.ranking_table(s, wallets.counted_trades(t.stored_features, features.wallet_ids(t.trades)))
    files.write_table_csv(table.select("rank", "wallet", "score"), path)
    return t.spark.read.option("header", "true").schema("rank LONG, wallet STRING, score DOUBLE").csv(path)


@query("str2_stream_equals_replay", sql("SELECT market, count(*) AS n, count(*) AS n_equal FROM trades GROUP BY market", "trades"))
def _(t):
    """Adaptive scores of the stream against the batch rounds over the same trades."""
    from fillwatch.operators.scoring import online_scores
    live = streamed(t, lambda s: jobs.score_stream(jobs.unique_trades(s), P), "adaptive").where("kind = 'scored'")
    batch = online_scores(cut(t.trades), P, segment_rows=700).select("tx_hash", F.col("p_z").alias("b"))
    j = live.join(batch, "tx_hash")
    return j.groupBy("market").agg(F.count("*").alias("n"), F.count(F.when(F.abs(F.col("p_z") - F.col("b")) < 1e-9, 1)).alias("n_equal"))
