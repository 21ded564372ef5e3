"""Captures, scores, metadata and artifacts on shared storage: readers and writers."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.config import ModelParams
from fillwatch.functions.labels import parse_iso
from fillwatch.operators.clean import keep_first, parse_end_date
from fillwatch.schemas import CAPTURE_DDL, MANIFEST_DDL, REPLICATE_DDL, SCORES_DDL
from fillwatch.session import scalar_row, scratch_path, width  # noqa: F401

COLD_VARIANCE = 1.0


# ---- captures ---------------------------------------------------------------------------------

def capture_columns(df: DataFrame) -> DataFrame:
    """Capture field names to trade column names, text coerced where it is a number."""
    return df.select(F.col("condition_id").alias("market"), "wallet", F.col("timestamp").try_cast("double").cast("long").alias("ts"),
                     F.col("price").try_cast("double").alias("price"), F.col("size").try_cast("double").alias("size"), "side",
                     F.col("transaction_hash").alias("tx_hash"), "asset_id")


def read_capture(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Trades of a JSON-lines capture and the lines that could not be parsed; blank lines are ignored."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("_j", F.from_json("value", CAPTURE_DDL + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"}))
    good = capture_columns(parsed.where("_j._bad IS NULL").select("_j.*").drop("_bad"))
    return good, parsed.where("_j._bad IS NOT NULL").select("value")


def read_replay(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A stored capture in total order (downstream windows order for themselves)."""
    df = read_capture(spark, path)[0] if fmt == "json" else capture_columns(
        spark.read.parquet(path).select(*[F.col(c).cast("string").alias(c) for c in (p.split()[0] for p in CAPTURE_DDL.split(", "))]))
    return df.orderBy("ts", "tx_hash")


def as_capture(trades: DataFrame) -> DataFrame:
    return trades.select(F.col("ts").alias("timestamp"), "price", "size", "wallet", "side", F.col("tx_hash").alias("transaction_hash"),
                         F.col("market").alias("condition_id"), F.lit("").alias("asset_id"))


def append_capture(trades: DataFrame, path: str) -> None:
    as_capture(trades).write.mode("append").json(path)


def write_capture(trades: DataFrame, path: str, partitions: int | None = None) -> None:
    """Canonical capture: range-partitioned and sorted by (ts, hash), NULL fields kept."""
    n = partitions or int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = trades.repartitionByRange(n, "ts", "tx_hash").sortWithinPartitions("ts", "tx_hash")
    as_capture(out).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def compact_capture(spark: SparkSession, source: str, target: str) -> int:
    """JSON-lines capture to Parquet, bad lines skipped; returns the stored row count."""
    as_capture(read_capture(spark, source)[0]).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).count()


# ---- processed markets ----------------------------------------------------------------------------

def save_processed(features: DataFrame, ids: DataFrame, path: str, hot_splits: int | None = None) -> None:
    """Features by market, market statistics and the wallet dimension. Rows of one market are spread
    over several writers (as many as there are shuffle partitions), so a large market does not pass through one task."""
    n = hot_splits or width(features)
    spread = features.repartition(F.col("market"), F.pmod(F.xxhash64("chunk"), F.lit(n)))
    spread.write.mode("overwrite").partitionBy("market").parquet(f"{path}/features")
    features.groupBy("market").agg(F.count(F.lit(1)).alias("n_trades"), F.max("s_bar").alias("s_bar")) \
            .write.mode("overwrite").parquet(f"{path}/market_stats")
    ids.write.mode("overwrite").parquet(f"{path}/wallets")


def load_processed(spark: SparkSession, path: str, markets=None) -> tuple[DataFrame, DataFrame]:
    """Features (pruned to the asked-for markets) and the wallet dimension."""
    f = spark.read.option("basePath", f"{path}/features").parquet(f"{path}/features")
    if markets:
        f = f.where(F.col("market").isin(list(markets)))
    return f, spark.read.parquet(f"{path}/wallets")


# ---- scores ---------------------------------------------------------------------------------------

def load_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score lines, strict: a malformed line fails the job. Missing market is '', missing x_mean is 0."""
    df = spark.read.schema(SCORES_DDL).option("mode", "FAILFAST").json(path)
    return df.withColumn("market", F.coalesce("market", F.lit(""))).withColumn("x_mean", F.coalesce("x_mean", F.lit(0.0)))


def load_cluster_scores(spark: SparkSession, path: str, listed: DataFrame) -> DataFrame:
    return load_scores(spark, path).join(listed.select("market"), "market", "left_semi")


def write_scores(scores: DataFrame, path: str, mode: str, source: str, warm_start: str | None = None) -> None:
    """Replay overwrites, live appends; the provenance row carries no clock, so reruns are identical."""
    if mode not in ("replay", "live"):
        raise ValueError("mode must be replay or live")
    scores.select(*[c.split()[0] for c in SCORES_DDL.split(", ")]).write.mode("overwrite" if mode == "replay" else "append").json(path)
    spark = scores.sparkSession
    spark.createDataFrame([(mode, source, warm_start)], "mode STRING, input STRING, warm_start STRING").coalesce(1) \
         .write.mode("overwrite").option("ignoreNullFields", "false").json(path.rstrip("/") + ".meta.json")


def replay_provenance(spark: SparkSession, path: str) -> DataFrame:
    """Provenance row of a score folder; refuses anything that is not a replay."""
    try:
        meta = spark.read.schema("mode STRING, input STRING, warm_start STRING").json(path.rstrip("/") + ".meta.json")
        row = scalar_row(meta)
    except Exception as exc:
        raise ValueError(f"{path} has no readable provenance record") from exc
    if row is None or row["mode"] != "replay":
        raise ValueError(f"{path} was not produced by a replay")
    return meta


# ---- metadata ---------------------------------------------------------------------------------------

# Field names in the order of precedence.
CLOSE_KEYS = ("close_ts", "close_time", "end_date", "endDate")
MARKET_KEYS = ("market", "condition_id", "ticker", "conditionId", "slug")
OUTCOME_KEYS = ("outcome", "result", "settlement", "winning_outcome", "resolved_to")


def metadata_records(spark: SparkSession, path: str, sidecars: bool = False) -> DataFrame:
    """``(key, value)`` with one JSON text per record, from sidecar files, one object, or one array."""
    whole = spark.read.text(path, wholetext=True)
    if sidecars:
        stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.meta\.json$", 1)
        return whole.select(stem.alias("key"), "value")
    is_map = F.ltrim("value").startswith("{")
    obj = whole.where(is_map).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    arr = whole.where(~is_map).select(F.posexplode(F.from_json("value", "array<string>")).alias("k", "value")) \
               .select(F.concat(F.lit("row"), F.col("k")).alias("key"), "value")
    return obj.unionByName(arr)


def _pick(keys, value: str = "value"):
    return [F.nullif(F.get_json_object(value, f"$.{k}"), F.lit("")) for k in keys]


def _end_seconds(key: str):
    """A JSON number as it is, a JSON text by the layouts that the pre-resolution filter knows; anything else is no time."""
    found = F.try_variant_get(F.try_parse_json("value"), f"$.{key}", "variant")
    kind = F.schema_of_variant(found)
    return F.when(kind == "STRING", parse_end_date(F.try_variant_get(found, "$", "string"))) \
            .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(found, "$", "double"))


def resolutions(records: DataFrame) -> DataFrame:
    """Close time per market: the first present field wins; numbers are accepted as they are."""
    plain = F.col("value").try_cast("double")
    close = F.coalesce(plain, *[_end_seconds(k) for k in CLOSE_KEYS])
    market = F.when(plain.isNotNull(), F.col("key")).otherwise(F.coalesce(*_pick(MARKET_KEYS), F.col("key")))
    return records.select(market.alias("market"), close.alias("close_ts")).where("close_ts IS NOT NULL")


# The words that settle a market.
YES_WORDS, NO_WORDS = ("yes", "y", "true", "1", "up"), ("no", "n", "false", "0", "down")


def verdict_value(text):
    """Settled payout of a text: a yes/no word; a price settles nothing."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(*YES_WORDS), 1.0).when(t.isin(*NO_WORDS), 0.0)


def _exact(number):
    return F.when(number.isin(0.0, 1.0), number)


def _settled(key: str):
    """Payout of a record's field by its JSON type: a text or a truth value by its word, a number if exactly 0 or 1."""
    found = F.try_variant_get(F.try_parse_json("value"), f"$.{key}", "variant")
    word = F.schema_of_variant(found).isin("STRING", "BOOLEAN")
    return F.when(word, verdict_value(F.try_variant_get(found, "$", "string"))).otherwise(_exact(F.try_variant_get(found, "$", "double")))


def outcomes(records: DataFrame) -> DataFrame:
    """Settled payout per market. A record that is no object has lost its JSON type, so there 1.0 settles as a number would."""
    is_obj = F.ltrim("value").startswith("{")
    bare = F.coalesce(verdict_value(F.col("value")), _exact(F.col("value").try_cast("double")))
    settled = F.when(is_obj, F.coalesce(*[_settled(k) for k in OUTCOME_KEYS])).otherwise(bare)
    market = F.when(is_obj, F.coalesce(*_pick(MARKET_KEYS), F.col("key"))).otherwise(F.col("key"))
    return records.select(market.alias("market"), settled.alias("outcome")).where("outcome IS NOT NULL")


def manifest_faults(manifest: DataFrame, schema_version: int = 1) -> DataFrame:
    """``fault`` texts of a manifest row: what is missing or wrong, with the place of the entry where it is one of a list."""
    def each(column: str, missing, text: str):
        return F.transform(F.filter(F.transform(F.coalesce(column, F.array()), lambda m, i: F.when(missing(m), i)), lambda i: i.isNotNull()),
                           lambda i: F.format_string(text, i))

    start, end = parse_iso("analysis_window.start"), parse_iso("analysis_window.end")
    one = lambda bad, text: F.when(F.coalesce(bad, F.lit(True)), F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    faults = F.concat(
        one(F.col("schema_version") != schema_version, "unsupported manifest version"), one(blank(F.col("case")), "no case id"),
        one(F.coalesce(F.size("markets"), F.lit(0)) < 1, "no markets"),
        each("markets", lambda m: blank(m["slug"]), "markets[%d]: no slug"), each("markets", lambda m: blank(m["condition_id"]), "markets[%d]: no condition id"),
        one(start.isNull() | end.isNull() | (start > end), "no valid window"),
        each("doj_timeline", lambda e: parse_iso(e["ts"]).isNull(), "doj_timeline[%d]: no valid time"),
        each("doj_timeline", lambda e: blank(e["label"]), "doj_timeline[%d]: no label"))
    return manifest.select(F.explode(faults).alias("fault"))


def load_manifest(spark: SparkSession, path: str, schema_version: int = 1) -> DataFrame:
    """Case manifest as one nested row, refused with all its faults when the version, a key of an entry, a time, the window or the
    anchor's pattern is wrong. A manifest is one small file by nature."""
    df = spark.read.schema(MANIFEST_DDL).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    faults = sorted(r["fault"] for r in manifest_faults(df, schema_version).collect())
    pattern = scalar_row(df.select("wallet_anchor.address_pattern"))
    if pattern is not None and pattern[0] is not None:
        try:
            re.compile(pattern[0])
        except re.error as exc:
            faults.append(f"anchor pattern is no regular expression ({exc})")
    if faults:
        raise ValueError("; ".join(faults))
    return df


def manifest_markets(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode("markets").alias("m")).select(F.col("m.condition_id").alias("market"), "m.slug", "m.question")


def manifest_timeline(manifest: DataFrame) -> DataFrame:
    t = manifest.select(F.explode("doj_timeline").alias("e")).select(parse_iso("e.ts").alias("event_ts"), "e.label", "e.source")
    return t.orderBy("event_ts")


# ---- replicate store, benchmarks, artifacts -----------------------------------------------------------

def load_replicates(spark: SparkSession, path: str, schema_version: int = 1) -> DataFrame:
    """Replicate rows, first per seed; a foreign version or a missing seed is refused."""
    df = spark.read.schema(REPLICATE_DDL).option("mode", "FAILFAST").json(path)
    check_replicates(df, schema_version)
    # place in the store: file, split of the file, line of the split
    placed = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_l"))
    return keep_first(placed, "seed", ["_f", "_b", "_l"]).drop("_f", "_b", "_l")


def check_replicates(df: DataFrame, schema_version: int = 1) -> None:
    bad = F.col("seed").isNull() | F.col("schema_version").isNull() | (F.col("schema_version") != schema_version)
    if not df.where(bad).isEmpty():
        raise ValueError("replicate store has rows without seed or with another schema version")


def remaining_keys(wanted: DataFrame, done: DataFrame, key: str = "seed") -> DataFrame:
    return wanted.join(done.select(key), key, "left_anti")


BENCH_JSON = ("method STRING, gate STRUCT<pooled_auc: DOUBLE, gate_pass: BOOLEAN>, config STRUCT<N: INT, n_iter: INT>, inputs STRUCT<K: INT>, "
              "timings STRUCT<mean_sec_per_run: DOUBLE, ci_half_width_sec_per_run: DOUBLE>, kendall_tau_vs_baseline DOUBLE")


def benchmark_rows(texts: DataFrame, label: str = "label", column: str = "value") -> DataFrame:
    """Summary rows of benchmark files; files without a gate result are skipped."""
    p = texts.select(label, F.from_json(column, BENCH_JSON).alias("b")).where("b.gate IS NOT NULL")
    return p.select(label, F.coalesce("b.method", F.lit("")).alias("method"), "b.config.N", "b.config.n_iter", "b.inputs.K",
                    F.col("b.timings.mean_sec_per_run").alias("mean_sec"),
                    F.coalesce("b.timings.ci_half_width_sec_per_run", F.lit(0.0)).alias("ci_half_width"),
                    "b.gate.pooled_auc", "b.gate.gate_pass", F.col("b.kendall_tau_vs_baseline").alias("tau"))


def save_warm_start(fit, spark: SparkSession, path: str) -> None:
    """Model artifact: one JSON row of scalars and the propensity table keyed by address."""
    payload = json.dumps({"params": asdict(fit.params), "m_S": fit.m_s, "s_S": fit.s_s, "m_Z": fit.m_z})
    spark.createDataFrame([(payload,)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{path}/model")
    fit.theta.select("wallet", "theta").write.mode("overwrite").parquet(f"{path}/theta")


def warm_start_from(payload: dict) -> tuple[ModelParams, float, float, float]:
    """Parameters and centring constants; constants may be missing only while the slopes are zero."""
    body = payload if "params" in payload else payload.get("best_restart", {})
    if "params" not in body:
        raise KeyError("artifact has no params block")
    known = {f.name for f in fields(ModelParams)}
    values = {k: (bool(v) if k == "anonymous" else float(v)) for k, v in body["params"].items() if k in known}
    params = ModelParams(**values)
    missing = [k for k in ("m_S", "s_S", "m_Z") if k not in body]
    if missing and (params.beta_S or params.beta_Z):
        raise ValueError("artifact has slopes but lacks " + ", ".join(missing))
    return params, float(body.get("m_S", 0.0)), float(body.get("s_S", 1.0)), float(body.get("m_Z", 0.0))


def load_warm_start(spark: SparkSession, path: str):
    """``(params, m_s, s_s, m_z, theta)`` of a saved artifact."""
    text = scalar_row(spark.read.text(f"{path}/model", wholetext=True))["value"]
    return (*warm_start_from(json.loads(text)), spark.read.parquet(f"{path}/theta"))


def cold_start() -> tuple[ModelParams, float, float, float]:
    return ModelParams.from_variance(COLD_VARIANCE), 0.0, 1.0, 0.0


# ---- summaries ---------------------------------------------------------------------------------------

def write_summary(summary: DataFrame, path: str, schema_version: int = 1, **extra: str) -> None:
    """One-row summary as JSON with its schema version and extra provenance columns."""
    cols = {"schema_version": F.lit(schema_version), **{k: F.lit(v) for k, v in extra.items()}}
    summary.withColumns(cols).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_table_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", "true").csv(path)
