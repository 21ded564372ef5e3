"""Order-dependent building blocks that stay balanced under key skew.

A plain ``Window.partitionBy(market).orderBy(ts)`` puts a whole market into one
task. The operators here split each market into time chunks, run the window
inside the chunk, and carry what the chunk needs from the past through a small
per-chunk summary. For orders that are not time (scores, values) a range
partitioning spreads the rows evenly and per-partition offsets give global
positions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillwatch.session import cut

_ROW_BITS = 33


def chunk_id(ts, seconds: float) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(ts / F.lit(float(seconds))).cast("long")


def ordered_carry(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    *,
    chunk: str = "chunk",
    lags: Mapping[str, str] | None = None,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    index: str | None = None,
    count: str | None = None,
) -> DataFrame:
    """Lag, running sum/max, row index and group totals per ``key`` in ``order``.

    ``lags`` maps output to input column (previous row of the key). ``sums`` and
    ``maxes`` are running values including the current row. ``totals`` are sums
    over the whole key. ``index`` is the 0-based position and ``count`` the size
    of the key. Rows are windowed per ``(key, chunk)``; ``chunk`` must follow the
    order. The summary has one row per (key, chunk), so its own window is bounded
    by the time span of the data, not by its volume.
    """
    lags, sums, maxes, totals = dict(lags or {}), dict(sums or {}), dict(maxes or {}), dict(totals or {})
    last_row = F.max_by(F.struct(*[F.col(c).alias(f"_v{k}") for k, c in enumerate(lags.values())]),
                        F.struct(*order)) if lags else F.lit(None)
    aggs = [F.count(F.lit(1)).alias("_n"), last_row.alias("_last")]
    aggs += [F.sum(e).alias(f"_s{k}") for k, e in enumerate(sums.values())]
    aggs += [F.max(e).alias(f"_m{k}") for k, e in enumerate(maxes.values())]
    aggs += [F.sum(e).alias(f"_t{k}") for k, e in enumerate(totals.values())]
    past = Window.partitionBy(key).orderBy(chunk)
    before = past.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    carried = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
               F.sum("_n").over(whole).alias("_nk")]
    if lags:
        carried.append(F.lag("_last").over(past).alias("_last0"))
    carried += [F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0.0)).alias(f"_s0{k}") for k in range(len(sums))]
    carried += [F.max(f"_m{k}").over(before).alias(f"_m0{k}") for k in range(len(maxes))]
    carried += [F.sum(f"_t{k}").over(whole).alias(f"_tk{k}") for k in range(len(totals))]
    summary = df.groupBy(key, chunk).agg(*aggs).select(key, chunk, *carried)

    inside = Window.partitionBy(key, chunk).orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = [F.row_number().over(inside).alias("_rn")]
    local += [F.lag(c).over(inside).alias(f"_l{k}") for k, c in enumerate(lags.values())]
    local += [F.sum(e).over(running).alias(f"_r{k}") for k, e in enumerate(sums.values())]
    local += [F.max(e).over(running).alias(f"_x{k}") for k, e in enumerate(maxes.values())]
    out = df.select("*", *local).join(summary, [key, chunk])

    cols = [F.col(c) for c in df.columns]
    for k, name in enumerate(lags):
        cols.append(F.when(F.col("_rn") > 1, F.col(f"_l{k}"))
                    .otherwise(F.col(f"_last0._v{k}")).alias(name))
    cols += [(F.col(f"_s0{k}") + F.col(f"_r{k}")).alias(name) for k, name in enumerate(sums)]
    cols += [F.greatest(F.col(f"_m0{k}"), F.col(f"_x{k}")).alias(name) for k, name in enumerate(maxes)]
    cols += [F.col(f"_tk{k}").alias(name) for k, name in enumerate(totals)]
    if index:
        cols.append((F.col("_n0") + F.col("_rn") - 1).cast("long").alias(index))
    if count:
        cols.append(F.col("_nk").cast("long").alias(count))
    return out.select(*cols)


def global_position(df: DataFrame, order: Sequence[Column | str], name: str = "pos",
                    partitions: int | None = None) -> DataFrame:
    """0-based position of every row in a total order, without a one-task window.

    The rows are range-partitioned, sorted inside the partitions and written
    once (so the position is a fact about stored data); the position is then the
    partition's offset plus the row's place in it. Give a total order: rows that
    tie on every order column cannot be split.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    stored = stored.withColumn("_mid", F.monotonically_increasing_id()) \
                   .withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    # One row per partition: at most ``n`` rows, which bounds this window and the broadcast.
    offsets = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part",
        F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    place = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return stored.join(F.broadcast(offsets), "_part") \
                 .select(*df.columns, (F.col("_off") + place).cast("long").alias(name))


def global_prefix(df: DataFrame, order: Sequence[Column | str], sums: Mapping[str, Column],
                  partitions: int | None = None) -> DataFrame:
    """Running sums (current row included) in a total order over the whole frame."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    stored = stored.withColumn("_mid", F.monotonically_increasing_id()) \
                   .withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored.groupBy("_part").agg(*[F.sum(e).alias(f"_s{k}") for k, e in enumerate(sums.values())]) \
        .select("_part", *[F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0)).alias(f"_o{k}")
                           for k in range(len(sums))])
    inside = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = stored.select("*", *[F.sum(e).over(inside).alias(f"_r{k}") for k, e in enumerate(sums.values())])
    return local.join(F.broadcast(offsets), "_part").select(
        *df.columns, *[(F.col(f"_o{k}") + F.col(f"_r{k}")).alias(name) for k, name in enumerate(sums)])


def average_ranks(df: DataFrame, value: str, name: str = "avg_rank", rows: Column | None = None) -> DataFrame:
    """Distinct values with their count and 1-based tie-averaged rank: ``(value, n, name)``; a row stands for ``rows`` rows."""
    tally = df.where(F.col(value).isNotNull()).groupBy(value).agg((F.count(F.lit(1)) if rows is None else F.sum(rows)).alias("n"))
    run = global_prefix(tally, [value], {"_upto": F.col("n")})
    return run.select(value, "n", (F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2.0).alias(name))


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group without collecting a group.

    Values are globally ordered by ``(keys, value)``; the two order statistics
    each quantile needs are picked by position. Repeated values are merged first,
    so a value held by many rows costs one row.
    """
    tally = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    run = global_prefix(tally, [*keys, value], {"_upto": F.col("_w")})
    run = run.withColumn("_from", F.col("_upto") - F.col("_w"))
    sizes = run.groupBy(*keys).agg(F.sum("_w").alias("_size"), F.min("_from").alias("_start"))
    placed = run.join(sizes, list(keys)).withColumn("_lo", F.col("_from") - F.col("_start")) \
                .withColumn("_hi", F.col("_upto") - F.col("_start") - 1)
    picks = []
    for k, p in enumerate(probs.values()):
        h = (F.col("_size") - 1) * F.lit(float(p))
        for tag, at in (("f", F.floor(h)), ("c", F.ceil(h))):
            picks.append(F.max(F.when((F.col("_lo") <= at) & (at <= F.col("_hi")), F.col(value))).alias(f"_{tag}{k}"))
        picks.append(F.max(h - F.floor(h)).alias(f"_w{k}"))
    out = placed.groupBy(*keys).agg(F.max("_size").alias("n"), *picks)
    return out.select(*keys, "n", *[
        (F.col(f"_f{k}") + (F.col(f"_c{k}") - F.col(f"_f{k}")) * F.col(f"_w{k}")).alias(name)
        for k, name in enumerate(probs)])
