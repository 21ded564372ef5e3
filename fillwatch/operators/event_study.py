"""Pre-close event study with a time-shift permutation null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fillwatch.config import CHUNK_SECONDS, WindowSpec
from fillwatch.functions.labels import uniform01
from fillwatch.functions.mathx import chi2_sf_even
from fillwatch.operators.ordered import chunk_id, global_position
from fillwatch.session import width

#: Scores are added up as decimals, so sums are exact in any order and the same trades have the same mean wherever they are met.
EXACT = "decimal(28,18)"
#: Picks that one row is unfolded into at a time.
PICKS = 4096
#: Reasons in the order they are tested.
REASONS = ("no_resolution", "no_trades_before_close", "empty_window", "history_too_short", "too_few_null")
MIN_NULL_DRAWS = 30


def _exact_mean(score, n):
    """Mean of exact sums: one division of two numbers that don't depend on the order of rows."""
    return F.when(n > 0, F.sum(score.cast(EXACT)).cast("double") / n)


def window_stats(scores: DataFrame, closes: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Counts, window mean and max, baseline and reason per market with scores. One partial aggregation."""
    joined = scores.join(closes.select("market", "close_ts"), "market", "left")
    ts, p = F.col("ts"), F.when(F.col("ts") <= F.col("close_ts"), F.col("p_z"))
    inside = (ts >= F.col("close_ts") - spec.before) & (ts < F.col("close_ts") - spec.embargo)
    win = F.when(inside, F.col("p_z"))
    agg = joined.groupBy("market").agg(
        F.max("close_ts").alias("close_ts"), F.count(p).alias("n_trades"), F.count(win).alias("n_window"),
        _exact_mean(win, F.count(win)).alias("window_mean"), F.max(win).alias("window_max"), _exact_mean(p, F.count(p)).alias("baseline_mean"),
        F.min(F.when(p.isNotNull(), ts)).alias("first_ts"))
    room = F.col("close_ts") - spec.before - F.col("first_ts")
    reason = (F.when(F.col("close_ts").isNull(), REASONS[0]).when(F.col("n_trades") == 0, REASONS[1])
              .when(F.col("n_window") == 0, REASONS[2]).when(room <= 0, REASONS[3]))
    return agg.select("*", (F.col("window_mean") - F.col("baseline_mean")).alias("elevation"),
                      (F.col("window_max") - F.col("baseline_mean")).alias("max_elevation"),
                      room.alias("max_offset"), reason.alias("reason"))


def terminal_move(scores: DataFrame, closes: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Filtered price change over the embargo, anchored at the last score before it. One partial aggregation."""
    j = scores.join(closes.where("close_ts IS NOT NULL").select("market", "close_ts"), "market") \
              .where(F.col("ts") <= F.col("close_ts"))
    late, at = F.col("ts") >= F.col("close_ts") - spec.embargo, F.struct("ts", "tx_hash")
    out = j.groupBy("market").agg(
        F.count(F.when(late, 1)).alias("n_terminal"), F.max_by("x_mean", F.when(late, at)).alias("_end"),
        F.max_by("x_mean", F.when(~late, at)).alias("_anchor"), F.min_by("x_mean", F.when(late, at)).alias("_first"))
    move = F.col("_end") - F.coalesce("_anchor", "_first")
    return out.select("market", F.coalesce(move, F.lit(0.0)).alias("terminal_move"), "n_terminal")


def null_offsets(stats: DataFrame, n: int, seed: int = 0, scheme: str = "random") -> DataFrame:
    """``n`` backward shifts per analysable market; ``stratified`` spreads them evenly."""
    draws = stats.where("reason IS NULL").select("market", "close_ts", "max_offset",
                                                 F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    u = (F.col("draw") + 0.5) / float(n) if scheme == "stratified" else uniform01(seed, 1, "market", "draw")
    return draws.withColumn("offset", u * F.col("max_offset")).drop("max_offset")


def shifted_windows(scores: DataFrame, offsets: DataFrame, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """Count, mean and max of ``p_z`` in every shifted window, without joining windows to trades.

    Both ends of a window become marker rows sorted in among the trades of their
    time chunk. Running totals give counts and sums by difference, which is exact for decimals; the maximum is
    the suffix maximum of the first chunk, the prefix maximum of the last and the
    chunk maxima between.
    """
    none = F.lit(0).cast("decimal(38,18)")
    length = spec.before - spec.embargo
    width = min(float(CHUNK_SECONDS), length / 2.0)
    lo = F.col("close_ts") - spec.before - F.col("offset")
    hi = F.col("close_ts") - spec.embargo - F.col("offset")
    marks = offsets.select("market", "draw", F.explode(F.array(
        F.struct(lo.alias("ts"), F.lit("a").alias("end")), F.struct(hi.alias("ts"), F.lit("b").alias("end")))).alias("m")) \
        .select("market", "draw", "m.ts", "m.end", F.lit(0).alias("kind"), F.lit(None).cast("double").alias("p_z"))
    last = offsets.groupBy("market").agg(F.max("close_ts").alias("_close"))
    kept = scores.join(last, "market").where(F.col("ts") <= F.col("_close")).select(
        "market", F.lit(None).cast("int").alias("draw"), "ts", F.lit(None).cast("string").alias("end"),
        F.lit(1).alias("kind"), "p_z")
    u = kept.unionByName(marks).withColumn("chunk", chunk_id("ts", width)).withColumn("x", F.col("p_z").cast(EXACT))
    before = Window.partitionBy("market").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = u.groupBy("market", "chunk").agg(F.sum("kind").alias("n"), F.coalesce(F.sum("x"), none).alias("s"),
                                              F.max("p_z").alias("top"))
    carry = chunks.select("market", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
                          F.coalesce(F.sum("s").over(before).cast("decimal(38,18)"), none).alias("s0"))
    inside = Window.partitionBy("market", "chunk").orderBy("ts", "kind")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # from the end backwards: a frame to the end of the chunk would be computed anew for every row
    onward = Window.partitionBy("market", "chunk").orderBy(F.desc("ts"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = u.select("*", F.sum("kind").over(upto).alias("rn"), F.coalesce(F.sum("x").over(upto), none).alias("rs"),
                 F.max("p_z").over(upto).alias("pre"), F.max("p_z").over(onward).alias("suf")).where("kind = 0")
    m = m.join(carry, ["market", "chunk"]).select("market", "draw", "end", "chunk", "pre", "suf",
                                                  (F.col("n0") + F.col("rn")).alias("n"),
                                                  (F.col("s0") + F.col("rs")).cast("decimal(38,18)").alias("s"))

    def at(end, col):
        return F.max(F.when(F.col("end") == end, F.col(col)))

    w = m.groupBy("market", "draw").agg(
        (at("b", "n") - at("a", "n")).alias("n_win"), (at("b", "s") - at("a", "s")).alias("sum_win"),
        at("a", "suf").alias("head"), at("b", "pre").alias("foot"), at("a", "chunk").alias("ca"), at("b", "chunk").alias("cb"))
    spans = w.where(F.col("cb") > F.col("ca") + 1).select(
        "market", "draw", F.explode(F.sequence(F.col("ca") + 1, F.col("cb") - 1)).alias("chunk"))
    middle = spans.join(chunks.where("top IS NOT NULL").select("market", "chunk", "top"), ["market", "chunk"]) \
                  .groupBy("market", "draw").agg(F.max("top").alias("mid"))
    return w.join(middle, ["market", "draw"], "left").select(
        "market", "draw", "n_win",
        F.when(F.col("n_win") > 0, F.col("sum_win").cast("double") / F.col("n_win")).alias("null_mean"),
        F.when(F.col("n_win") > 0, F.greatest("head", "mid", "foot")).alias("null_max"))


def market_results(scores: DataFrame, closes: DataFrame, *, spec: WindowSpec = WindowSpec(), n: int = 999,
                   seed: int = 0, scheme: str = "random") -> DataFrame:
    """Primary test per market: statistics, null summary, add-one p-values and the exclusion reason."""
    stats = window_stats(scores, closes, spec)
    null = shifted_windows(scores, null_offsets(stats, n, seed, scheme), spec)
    beats = F.col("null_mean") >= F.col("window_mean")
    per = null.join(stats.select("market", "window_mean", "window_max"), "market").groupBy("market").agg(
        F.count("null_mean").alias("n_null"), F.count(F.when(F.col("n_win") == 0, 1)).alias("n_null_empty"),
        F.avg("null_mean").alias("_nm"), F.stddev_samp("null_mean").alias("_nsd"),
        F.count(F.when(beats, 1)).alias("_ge"),
        F.count(F.when(F.col("null_max") >= F.col("window_max"), 1)).alias("_gemax"))
    out = stats.join(per, "market", "left").join(terminal_move(scores, closes, spec), "market", "left")
    few = F.col("reason").isNull() & (F.coalesce("n_null", F.lit(0)) < min(MIN_NULL_DRAWS, n))
    out = out.withColumn("reason", F.when(few, REASONS[4]).otherwise(F.col("reason")))
    ok = F.col("reason").isNull()
    sd = F.when(F.col("n_null") > 1, F.col("_nsd")).otherwise(0.0)
    return out.select(
        "market", "reason", "close_ts", "n_trades", "n_window", "window_mean", "baseline_mean", "elevation", "window_max",
        "max_elevation", "n_null", "n_null_empty",
        F.when(ok, (1 + F.col("_ge")) / (1 + F.col("n_null"))).alias("p_value"),
        F.when(ok, (1 + F.col("_gemax")) / (1 + F.col("n_null"))).alias("p_value_max"),
        F.when(ok, F.col("_nm") - F.col("baseline_mean")).alias("null_mean"), F.when(ok, sd).alias("null_sd"),
        F.when(ok & (sd > 0), (F.col("window_mean") - F.col("_nm")) / F.when(sd > 0, sd)).alias("z_score"),
        "terminal_move", "n_terminal")


def cross_market_p(scores: DataFrame, results: DataFrame, n: int = 199, seed: int = 0, scheme: str = "random") -> DataFrame:
    """Robustness p-value: window means against draws from every other analysed market.

    Scores of analysed markets get global positions ordered by market, so "all
    other markets" is the position range with the market's own block cut out, and
    drawing is an equi-join on positions. A market's picks are unfolded ``PICKS`` at a time, so no row holds a whole window,
    and spread over all tasks before that.
    ``stratified`` takes the picks of all draws at equal steps of the golden ratio instead of at random.
    """
    analysed = results.where("reason IS NULL").select("market", "n_window", "window_mean")
    pool = global_position(scores.join(analysed.select("market"), "market", "left_semi")
                           .select("market", "tx_hash", "p_z"), ["market", "tx_hash"], "pos")
    blocks = pool.groupBy("market").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("own"))
    total = pool.agg(F.count(F.lit(1)).alias("total"))
    plan = analysed.join(blocks, "market").join(F.broadcast(total))
    others = F.col("total") - F.col("own")
    parts = plan.where(others > 0).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_window") - 1) / PICKS))).alias("part"))
    # a few rows, one per market, lie in one task; what they unfold to must not
    picks = parts.repartition(width(pool), "market", "draw", "part").select(
        "*", F.explode(F.sequence(F.col("part") * PICKS + 1, F.least((F.col("part") + 1) * PICKS, F.col("n_window")))).alias("k"))
    turn = (F.col("draw") * F.col("n_window") + F.col("k")) * F.lit(0.6180339887498949)
    u = turn - F.floor(turn) if scheme == "stratified" else uniform01(seed, 2, "market", "draw", "k")
    spot = F.floor(u * others).cast("long")
    picks = picks.withColumn("spot", spot).withColumn(
        "pos", F.when(F.col("spot") >= F.col("start"), F.col("spot") + F.col("own")).otherwise(F.col("spot")))
    # by merging: the planner takes the picks for as few as the rows that they unfold from, and would broadcast them
    means = picks.select("market", "draw", "pos", "window_mean").join(pool.select("pos", "p_z").hint("merge"), "pos") \
        .groupBy("market", "draw", "window_mean").agg(_exact_mean(F.col("p_z"), F.count("p_z")).alias("m"))
    p = means.groupBy("market").agg(
        ((1 + F.count(F.when(F.col("m") >= F.col("window_mean"), 1))) / (1 + F.count(F.lit(1)))).alias("p_value_cross"))
    return analysed.select("market").join(p, "market", "left")


def study_summary(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Fisher-combined verdict over the analysed markets."""
    ok = F.col("reason").isNull()
    s = results.agg(F.count(F.lit(1)).alias("n_markets"), F.count(F.when(ok, 1)).alias("n_analysed"),
                    F.count(F.when(ok & (F.col("p_value") < alpha), 1)).alias("n_significant"),
                    (-2.0 * F.sum(F.when(ok, F.log("p_value")))).alias("_f"))
    enough = F.col("n_analysed") >= 2
    return s.select("n_markets", "n_analysed", "n_significant", F.when(enough, F.col("_f")).alias("fisher_stat"),
                    F.when(enough, chi2_sf_even("_f", 2 * F.col("n_analysed"))).alias("fisher_p"))


def exclusion_counts(results: DataFrame) -> DataFrame:
    return results.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def rejection_rates(p_values: DataFrame, groups, alpha: float = 0.05, p: str = "p_value") -> DataFrame:
    return p_values.where(F.col(p).isNotNull()).groupBy(*groups).agg(
        F.avg((F.col(p) < alpha).cast("double")).alias("rejection_rate"), F.count(F.lit(1)).alias("n"))
