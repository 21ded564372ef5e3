"""Normalization of venue payloads held as JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwatch.operators.clean import keep_first

TRADE_JSON = ("timestamp STRING, price STRING, size STRING, proxyWallet STRING, wallet STRING, side STRING, "
              "transactionHash STRING, transaction_hash STRING, conditionId STRING, condition_id STRING, asset STRING, asset_id STRING")
MARKET_JSON = ("id STRING, conditionId STRING, condition_id STRING, slug STRING, question STRING, volume STRING, "
               "closed BOOLEAN, endDate STRING, end_date STRING, tags ARRAY<STRING>")
ANON_TRADE_JSON = ("trade_id STRING, ticker STRING, created_time STRING, yes_price_dollars STRING, yes_price STRING, "
                   "no_price_dollars STRING, no_price STRING, count_fp STRING, count STRING, taker_side STRING")
ANON_MARKET_JSON = ("ticker STRING, title STRING, status STRING, close_time STRING, expiration_time STRING, "
                    "volume_fp STRING, volume STRING")
#: Statuses after which a market no longer trades.
RESOLVED = ("closed", "determined", "settled", "finalized")


def _first_text(*cols: Column) -> Column:
    """First non-empty text, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def _number(c: Column) -> Column:
    """Missing or empty means 0; text that is no number means NULL."""
    return F.when(c.isNull() | (c == ""), F.lit(0.0)).otherwise(c.try_cast("double"))


def trade_fields(d: Column) -> list[Column]:
    """Trade columns from a parsed payload struct with either field spelling."""
    return [_first_text(d["conditionId"], d["condition_id"]).alias("market"),
            _first_text(d["proxyWallet"], d["wallet"]).alias("wallet"),
            _number(d["timestamp"]).cast("long").alias("ts"), _number(d["price"]).alias("price"), _number(d["size"]).alias("size"),
            F.upper(F.coalesce(d["side"], F.lit(""))).alias("side"),
            _first_text(d["transactionHash"], d["transaction_hash"]).alias("tx_hash"),
            _first_text(d["asset"], d["asset_id"]).alias("asset_id")]


def normalize_trades(payloads: DataFrame, column: str = "value") -> DataFrame:
    parsed = payloads.withColumn("_d", F.from_json(column, TRADE_JSON))
    keep = [F.col(c) for c in payloads.columns if c != column]
    return parsed.select(*keep, *trade_fields(F.col("_d")))


def tag_list(tags: Column) -> Column:
    """Tags given as plain strings or as objects carrying a label, a name or a slug."""
    def one(t):
        def get(k):
            return F.nullif(F.get_json_object(t, f"$.{k}"), F.lit(""))
        return F.when(t.startswith("{"), F.coalesce(get("label"), get("name"), get("slug"))).otherwise(t)

    named = F.filter(F.transform(tags, one), lambda t: t.isNotNull())
    return F.coalesce(named, F.array().cast("array<string>"))


def normalize_markets(payloads: DataFrame, column: str = "value") -> DataFrame:
    d = F.from_json(column, MARKET_JSON)
    p = payloads.select(d.alias("d"), F.col(column).alias("raw"))
    return p.select(F.coalesce("d.id", F.lit("")).alias("id"), _first_text(F.col("d.conditionId"), F.col("d.condition_id")).alias("condition_id"),
                    F.coalesce("d.slug", F.lit("")).alias("slug"), F.coalesce("d.question", F.lit("")).alias("question"),
                    _number(F.col("d.volume")).alias("volume"), F.coalesce("d.closed", F.lit(False)).alias("closed"),
                    F.coalesce(F.nullif("d.endDate", F.lit("")), F.nullif("d.end_date", F.lit(""))).alias("end_date"),
                    tag_list(F.col("d.tags")).alias("tags"), "raw")


# ---- anonymous venue --------------------------------------------------------------------------

def yes_price(d: Column) -> Column:
    """YES-leg price: own dollars, own cents, or one minus the other leg; the first present field decides."""
    yd, yc, nd, nc = (d[k] for k in ("yes_price_dollars", "yes_price", "no_price_dollars", "no_price"))
    return (F.when(yd.isNotNull(), yd.try_cast("double")).when(yc.isNotNull(), yc.try_cast("double") / 100.0)
             .when(nd.isNotNull(), 1.0 - nd.try_cast("double")).when(nc.isNotNull(), 1.0 - nc.try_cast("double") / 100.0))


def contract_count(d: Column) -> Column:
    return F.when(d["count_fp"].isNotNull(), d["count_fp"].try_cast("double")).otherwise(d["count"].try_cast("double"))


def created_seconds(text: Column) -> Column:
    """Whole unix seconds of an RFC-3339 stamp; a stamp without zone means UTC."""
    return F.unix_seconds(F.try_to_timestamp(F.nullif(F.trim(text), F.lit(""))))


def normalize_anonymous(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Rows of the ``trades`` arrays of response bodies, with an ``error`` for rows that break the contract."""
    body = F.from_json(column, f"trades ARRAY<STRUCT<{ANON_TRADE_JSON.replace(' STRING', ': STRING')}>>")
    rows = payloads.select(F.explode(body["trades"]).alias("d"))
    d = F.col("d")
    side = F.lower(F.trim(F.coalesce(d["taker_side"], F.lit(""))))
    out = rows.select(F.coalesce(d["ticker"], F.lit("")).alias("market"), F.lit(None).cast("string").alias("wallet"),
                      created_seconds(d["created_time"]).alias("ts"), yes_price(d).alias("price"), contract_count(d).alias("size"),
                      F.when(side == "yes", "BUY").when(side == "no", "SELL").alias("side"),
                      F.coalesce(d["trade_id"], F.lit("")).alias("tx_hash"), F.lit("").alias("asset_id"))
    error = (F.when(F.col("tx_hash") == "", "missing trade_id").when(F.col("market") == "", "missing ticker")
              .when(F.col("side").isNull(), "unknown taker_side").when(F.col("ts").isNull(), "bad created_time")
              .when(F.col("price").isNull(), "bad price").when(F.col("size").isNull(), "bad count"))
    return out.withColumn("error", error)


def strict(rows: DataFrame) -> DataFrame:
    """Fail the job on the first bad row instead of setting it aside."""
    ok = F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("bad payload row: "), F.col("error"))).cast("boolean"))
    return rows.where(ok).drop("error")


def normalize_anonymous_markets(payloads: DataFrame, column: str = "value") -> DataFrame:
    d = F.from_json(column, ANON_MARKET_JSON)
    p = payloads.select(d.alias("d"), F.col(column).alias("raw"))
    status = F.coalesce("d.status", F.lit(""))
    vol = F.when(F.col("d.volume_fp").isNotNull(), _number(F.col("d.volume_fp"))).otherwise(_number(F.col("d.volume")))
    return p.select(F.coalesce("d.ticker", F.lit("")).alias("ticker"), F.coalesce("d.title", F.lit("")).alias("title"), status.alias("status"),
                    F.coalesce(F.nullif("d.close_time", F.lit("")), F.col("d.expiration_time")).alias("close_time"), vol.alias("volume"),
                    F.lower(F.trim(status)).isin(*RESOLVED).alias("resolved"), "raw")


# ---- live feed ----------------------------------------------------------------------------------

def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns computed once a row, however often later steps read them: the optimizer would copy their expressions into each reader."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(made)).alias("_once")).select(*df.columns, "_once.*")


def decode_frames(frames: DataFrame, column: str = "value") -> DataFrame:
    """Classify feed frames and decode trades: ``kind`` is trade, keepalive, other or bad."""
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    env = F.from_json(F.col(column), "topic STRING, type STRING, timestamp STRING, payload STRING")
    body = F.from_json(F.col("_e.payload"), TRADE_JSON)
    p = _once(_once(frames, _t=text, _ok=F.try_parse_json(text).isNotNull() & text.startswith("{"), _e=env), _d=body)
    stamp = F.coalesce(F.col("_d.timestamp").try_cast("double"),
                       F.when(F.col("_d.timestamp").isNull(), F.col("_e.timestamp").try_cast("double") / 1000.0))
    fields = [f for f in trade_fields(F.col("_d"))]
    wanted = (F.col("_e.topic") == "activity") & (F.col("_e.type") == "trades")
    bad_number = (F.col("_d.price").isNotNull() & F.col("_d.price").try_cast("double").isNull()) | \
        (F.col("_d.size").isNotNull() & F.col("_d.size").try_cast("double").isNull()) | \
        (F.col("_d.timestamp").isNotNull() & F.col("_d.timestamp").try_cast("double").isNull())
    kind = (F.when(F.col("_t") == "", "keepalive").when(~F.col("_ok"), "bad").when(~F.coalesce(wanted, F.lit(False)), "other")
             .when(F.col("_d").isNull() | ~F.coalesce(F.col("_e.payload").startswith("{"), F.lit(False)) | bad_number, "bad").otherwise("trade"))
    out = p.select(kind.alias("kind"), F.col(column).alias("raw"), F.coalesce(stamp, F.lit(0.0)).cast("long").alias("_ts"), *fields)
    return out.withColumn("ts", F.col("_ts")).drop("_ts")


def feed_trades(frames: DataFrame, markets=None, column: str = "value") -> DataFrame:
    t = decode_frames(frames, column).where("kind = 'trade'").drop("kind", "raw")
    return t.where(F.lower("market").isin([str(m).lower() for m in markets])) if markets else t


def quarantined(frames: DataFrame, column: str = "value") -> DataFrame:
    return decode_frames(frames, column).where("kind = 'bad'").select("raw")


def merge_pages(pages: DataFrame, order=("page", "pos")) -> DataFrame:
    """Union of overlapping result pages: first occurrence of a hash wins (sort by ``ts`` descending to list)."""
    return keep_first(pages, "tx_hash", list(order))
