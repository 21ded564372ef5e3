"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Documents fall into blocks by a hash, so the blocks of a source are a random partition of it and their numbers a random
permutation. A source's quota is the number of blocks it gives, counted once per pass. The quotas of all sources are
split among the output shards by a binary tree: the left half of a node draws its blocks from the node's without
replacement, source by source from the exact hypergeometric distribution. The shards then own disjoint ranges of each
source's blocks, and their rows are shuffled locally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillwatch.llm.common import WORD_SQL, stored, unit_hash

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
BLOCK_WORDS = 65_536
SUPER_BITS = 10  # blocks added up in one window
SLICES = 1024  # of one block, added up in one window
_TAKES = "array<struct<from_block:long,from_u:double,to_block:long,to_u:double,most:long>>"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_SQL)).cast("long")


def _key(source: str = "source") -> Column:
    """Sources by code point with null after all others (a leading 1 against 0)."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """``key, size, target`` from ``key, size``, one row per source (the windows here see one row per source).

    The targets are ``weight * level`` cut at ``limit * size``. Sources in the order of the level at which they are cut: the
    first whose share of what the cut ones leave stays below its own limit gives the level."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("key")) - 1)
    ranked = ranked.withColumn("w", F.element_at(table, (F.col("rank") % len(weights) + 1).cast("int"))) \
                   .withColumn("cap", F.lit(float(limit)) * F.col("size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "key")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    level = (F.lit(share) * F.sum("size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) \
        / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level)
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "key", "level"))).over(everything)
    return levels.withColumn("at", first).select("key", "rank", "size", F.least(F.coalesce(F.col("at.level") * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """Number of good ones among ``draws`` of ``total`` with ``good`` good ones, by inversion at ``u`` in [0, 1).

    The sum runs over twelve standard deviations to both sides of the mode; what lies beyond is below a double's resolution."""
    total, good, draws = total.cast("double"), good.cast("double"), draws.cast("double")
    low, high = F.greatest(F.lit(0.0), draws + good - total), F.least(good, draws)
    mode = F.floor((draws + 1) * (good + 1) / (total + 2)).cast("double")
    p = good / F.greatest(total, F.lit(1.0))
    width = F.ceil(12 * F.sqrt(draws * p * (1 - p) * (total - draws) / F.greatest(total - 1, F.lit(1.0)))) + 12
    a, b = F.greatest(low, mode - width).cast("long"), F.greatest(F.least(high, mode + width), low).cast("long")
    support = F.sequence(a, b)

    def after(k: Column, x: Column) -> Column:
        k = k.cast("double")
        return x * (good - k) * (draws - k) / ((k + 1) * (total - good - draws + k + 1))

    one, zero = F.lit(1.0), F.lit(0.0)
    mass = F.aggregate(support, F.struct(one.alias("p"), zero.alias("t")), lambda s, k: F.struct(after(k, s["p"]).alias("p"), (s["t"] + s["p"]).alias("t")))["t"]
    below = F.aggregate(support, F.struct(one.alias("p"), zero.alias("t"), F.lit(0).cast("long").alias("n")),
                        lambda s, k: F.struct(after(k, s["p"]).alias("p"), (s["t"] + s["p"]).alias("t"),
                                              (s["n"] + F.when(s["t"] + s["p"] <= u * mass, 1).otherwise(0)).cast("long").alias("n")))["n"]
    return F.least(a + below, b)


def _numbers(name: str) -> Column:
    """1 to the size of an array."""
    return F.when(F.size(name) > 0, F.sequence(F.lit(1), F.size(name))).otherwise(F.array().cast("array<int>"))


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """``shard, quota`` (an array, a number per source) from one row ``quota``: the leaves of the splitting tree."""
    nodes = quotas.select(F.lit(0).alias("node"), "quota")
    for level in range(levels):
        total = F.aggregate("quota", F.lit(0).cast("long"), lambda s, q: s + q)
        start = F.struct(F.col("total").alias("rest"), F.floor(F.col("total") / 2).cast("long").alias("room"), F.array().cast("array<long>").alias("left"))

        def draw(s: Column, k: Column) -> Column:
            own = F.element_at("quota", k)
            x = hypergeometric(s["rest"], own, s["room"], unit_hash(F.lit(seed), F.lit(level), F.col("node"), k))
            return F.struct((s["rest"] - own).alias("rest"), (s["room"] - x).alias("room"), F.concat(s["left"], F.array(x)).alias("left"))

        halves = nodes.withColumn("total", total).withColumn("left", F.aggregate(_numbers("quota"), start, draw)["left"])
        pair = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quota")),
                       F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quota", "left", lambda q, x: q - x).alias("quota")))
        nodes = halves.select(F.explode(pair).alias("n")).select("n.node", "n.quota")
    return nodes.select(F.col("node").alias("shard"), "quota")


def _block(blocks: Column, seed: int) -> Column:
    return F.floor(unit_hash(F.lit(seed), F.col("doc_id")) * blocks).cast("long")


def _place(seed: int) -> Column:
    """Place of a document within its block, from 0 to below 1."""
    return unit_hash(F.lit(seed), F.lit("fill"), F.col("doc_id"))


def _running(blocks: DataFrame) -> DataFrame:
    """``blocks(key, block, words, ...)`` with ``upto``, the words of the source's blocks up to each."""
    blocks = blocks.withColumn("super", F.shiftright("block", SUPER_BITS))
    supers = blocks.groupBy("key", "super").agg(F.sum("words").alias("n")).select(
        "key", "super", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("key", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.join(supers, ["key", "super"]).withColumn("upto", F.col("base") + F.sum("words").over(inside))


def _after(block: Column, u: Column) -> Column:
    """A document's place in its source can be compared with the place at ``block, u``."""
    return F.struct("block", "u") > F.struct(block, u)


def fill(items: DataFrame, gaps: DataFrame) -> DataFrame:
    """``key, takes``: which of the ``items(key, block, u, words)`` fill the ``gaps(key, gap, block, u)`` behind a place, until none left fits.

    A source's documents are in the order of (block, u). Each round passes over those longer than the gap and takes the others up
    to the first that does not fit any more; the next round starts behind it with what is left. That is less than the document at which the
    round ended, so a few rounds settle all sources. A take is a range of places, ends exclusive, and the largest size in it.

    The end of a round is found by sums over blocks, then over ``SLICES`` slices of one block, then over the rows of one slice; no
    task folds a source."""
    takes, gaps = None, stored(gaps.select("key", "gap", F.col("block").alias("from_block"), F.col("u").alias("from_u")), "mix-gaps")
    while True:
        items = stored(items.join(gaps, "key").where(_after(F.col("from_block"), F.col("from_u")) & (F.col("words") <= F.col("gap")))
                       .select("key", "block", "u", "words"), "mix-open")
        if items.isEmpty():
            break
        blocks = stored(items.groupBy("key", "block").agg(F.sum("words").alias("words")), "mix-fill-blocks")
        over = F.min(F.when(F.col("upto") > F.col("gap"), F.struct("block", (F.col("upto") - F.col("words")).alias("given"))))
        ends = stored(_running(blocks).join(gaps, "key").groupBy("key", "gap", "from_block", "from_u").agg(over.alias("over"), F.max("upto").alias("all"))
                      .select("key", "gap", "from_block", "from_u", "all", F.col("over.block").alias("last"), F.col("over.given").alias("given")), "mix-ends")
        inside = items.join(ends.where("last is not null").select("key", "gap", "last", "given"), "key").where("block = last").withColumn(
            "slice", F.floor(F.col("u") * SLICES))
        by_slice = Window.partitionBy("key").orderBy("slice")
        slices = inside.groupBy("key", "slice", "gap", "given").agg(F.sum("words").alias("words")).withColumn("upto", F.col("given") + F.sum("words").over(by_slice))
        slices = stored(slices.where("upto > gap").groupBy("key").agg(F.min(F.struct("slice", (F.col("upto") - F.col("words")).alias("given"))).alias("s"))
                        .select("key", "s.slice", F.col("s.given").alias("before")), "mix-slices")
        by_place = Window.partitionBy("key").orderBy("u")  # rows at one place are taken or left together
        stops = inside.join(slices, ["key", "slice"]).withColumn("upto", F.col("before") + F.sum("words").over(by_place)).groupBy("key").agg(
            F.min(F.when(F.col("upto") > F.col("gap"), F.col("u"))).alias("to_u"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))), F.max("before")).alias("taken"))
        done = stored(ends.join(stops, "key", "left").select(
            "key", "gap", "from_block", "from_u", F.coalesce("last", F.lit((1 << 63) - 1)).alias("to_block"), F.coalesce("to_u", F.lit(0.0)).alias("to_u"),
            (F.col("gap") - F.coalesce("taken", "all")).alias("rest")), "mix-takes")
        own = done.select("key", F.struct("from_block", "from_u", "to_block", "to_u", F.col("gap").alias("most")).alias("take"))
        takes = own if takes is None else takes.unionByName(own)
        gaps = stored(done.where("rest > 0").select("key", F.col("rest").alias("gap"), F.col("to_block").alias("from_block"), F.col("to_u").alias("from_u")), "mix-gaps")
    if takes is None:
        return gaps.select("key", F.array().cast(_TAKES).alias("takes")).limit(0)
    return takes.groupBy("key").agg(F.collect_list("take").alias("takes"))


def mixing_plan(sized: DataFrame, *, block_words: int = BLOCK_WORDS, shard_bits: int = 6, seed: int = 1, weights=WEIGHTS,
                share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """One row per source: targets, blocks, quotas and the shards' ranges, from ``sized(doc_id, source, size)``.

    A source gives ``full`` whole passes over its blocks, then its first ``whole`` blocks once more, and of the others the
    documents that ``takes`` describe (see ``fill``), so that what is missing to the target is less than any document left in the
    source. Rows that repeat a document id have one place; those of them that fit are taken together."""
    keyed = sized.select("doc_id", _key().alias("key"), "size")
    sizes = stored(keyed.groupBy("key").agg(F.sum("size").alias("size")), "mix-sources")
    target = source_targets(sizes, weights=weights, share=share, limit=limit)
    info = stored(target.select(
        "key", "rank", "size", "target", F.greatest(F.ceil(F.col("size") / block_words), F.lit(1)).cast("long").alias("blocks"),
        F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long").alias("full"))
        .withColumn("rest", F.floor(F.col("target") - F.col("full") * F.col("size")).cast("long")), "mix-targets")
    blocks = stored(keyed.withColumnRenamed("size", "words").join(info, "key").withColumn("block", _block(F.col("blocks"), seed))
                    .groupBy("key", "block").agg(F.sum("words").alias("words"), F.first("rest").alias("rest")), "mix-blocks")
    running = _running(blocks)
    whole = running.groupBy("key").agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("block") + 1)).alias("whole"),
                                       F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("given"))
    info = stored(info.join(whole, "key", "left").withColumn("whole", F.coalesce("whole", F.lit(0))).withColumn(
        "gap", F.col("rest") - F.coalesce("given", F.lit(0))).drop("given"), "mix-passes")
    items = keyed.withColumnRenamed("size", "words").join(info.where("gap > 0"), "key").withColumn("block", _block(F.col("blocks"), seed)).where(
        (F.col("block") >= F.col("whole")) & (F.col("words") > 0) & (F.col("words") <= F.col("gap"))).select("key", "block", _place(seed).alias("u"), "words")
    chosen = fill(items, info.where("gap > 0").select("key", "gap", (F.col("whole") - 1).alias("block"), F.lit(1.0).alias("u")))
    info = stored(info.join(chosen, "key", "left").withColumn("takes", F.coalesce("takes", F.array().cast(_TAKES))).withColumn(
        "quota", F.col("full") * F.col("blocks") + F.col("whole") + (F.size("takes") > 0).cast("long")), "mix-quotas")
    leaves = split_quotas(info.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "quota"))), lambda x: x["quota"]).alias("quota")), shard_bits, seed)
    ranges = leaves.select("shard", F.posexplode("quota").alias("rank", "n")).groupBy("rank").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("shard", "n"))), lambda x: x["n"]).alias("per_shard"))
    ends = F.transform(_numbers("per_shard"), lambda k: F.aggregate(F.slice("per_shard", F.lit(1), k), F.lit(0).cast("long"), lambda s, x: s + x))
    return stored(info.join(ranges.select("rank", ends.alias("ends")), "rank"), "mix-plan").select(
        "key", F.col("size").alias("source_size"), "target", "blocks", "full", "whole", "takes", "ends")


def mix(docs: DataFrame, plan: DataFrame, *, seed: int = 1, size: Column | None = None) -> DataFrame:
    """``docs`` (all columns) with ``source_size``, ``target``, ``copies`` and ``shards``, the shard of each copy.

    ``size`` is the number of words of a row, counted from ``text`` if not given; it is only looked at inside a take.
    The plan has a row per source; a source with a third of all rows is split by the skew join where it is too large to
    broadcast."""
    rows = docs.drop("source_size", "target", "copies", "shards").withColumn("key", _key()).join(plan, "key")
    rows = rows.withColumn("block", _block(F.col("blocks"), seed))
    rows = rows.withColumn("u", _place(seed))
    words = word_count() if size is None else size
    more = (F.col("block") < F.col("whole")) | F.exists("takes", lambda t: _after(t["from_block"], t["from_u"]) & (
        F.struct("block", "u") < F.struct(t["to_block"], t["to_u"])) & (words > 0) & (words <= t["most"]))
    rows = rows.withColumn("copies", (F.col("full") + more.cast("long")).cast("int"))
    place = F.transform(F.slice(F.sequence(F.lit(0), F.greatest("copies", F.lit(1))), F.lit(1), F.col("copies")), lambda p: F.size(
        F.filter("ends", lambda e: e <= F.least(p * F.col("blocks") + F.col("block"), F.col("full") * F.col("blocks") + F.col("whole")))))
    return rows.withColumn("shards", place).drop("key", "blocks", "full", "whole", "takes", "ends", "block", "u")


def mixed_rows(mixed: DataFrame, *, seed: int = 1) -> DataFrame:
    """A row for each copy that the mix takes, with its ``shard``; shuffled within each shard."""
    rows = mixed.where("copies > 0").select("*", F.posexplode("shards").alias("copy", "shard")).drop("shards", "copies")
    return rows.repartition("shard").withColumn("at", unit_hash(F.lit(seed), F.lit("shuffle"), F.col("doc_id"), F.col("copy"))) \
               .sortWithinPartitions("shard", "at").drop("at")


def mix_sources(docs: DataFrame, *, seed: int = 1, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, shards`` of each row.

    ``size`` counts words; ``taken`` is ``copies * size``, documents are taken whole, 0 to 2 times. Null text has size 0; such
    rows take nothing. Null sources are one source, the last. Null ids fall into one block of their source. Repeated rows
    are rows of their own, taken together. An empty table gives an empty result, other columns are not read. All choices are
    hashes of ids and the seed, so reruns agree.
    """
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size")), "mix-sizes")
    out = mix(sized, mixing_plan(sized, seed=seed, **options), seed=seed, size=F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "shards")
