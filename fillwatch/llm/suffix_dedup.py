"""Removal of repeated byte strings with a distributed difference-cover suffix array.

Sampling. Each 400-byte window has one anchor: the leftmost of its 128-byte grams with the smallest hash. Equal windows
have their anchors at the same place, so anchors cover all differences between equal windows, as the residues of a
difference cover do, and grams that occur once rule out every window they anchor. The bytes between two anchors are a phrase.

Suffix array. Runs of repeated anchors are strings of phrases, and the suffixes at anchors are sorted by the difference
cover modulo three: sort the triples at positions 1 and 2 (mod 3), recurse on their names, then merge the suffixes at
positions 0 (mod 3), whose keys end in sampled ranks. Ranks count smaller suffixes by prefix sums over sorted keys; nothing is
sorted in one task. Adjacent suffixes are compared phrase by phrase, which gives each anchor the longest prefix it shares.

Bytes. A window inside a shared phrase prefix is repeated; one whose anchor's gram occurs once is not. What is left are windows
that reach over the edge of a repeat. They are compared, with all windows at the same distance from an anchor with the same
gram, first by the bytes that a block of neighbouring windows has in common and by those it covers, then, one block for all
that cover the same bytes, by two 64-bit hashes of the window.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillwatch.llm.common import Scratch, map_rows
from fillwatch.session import bucketed, width

LENGTH = 400
GRAM = 128
BLOCK = 32
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
STEP = 1 << 16
BATCH_BYTES = 4 << 20  # of texts or of their anchors in a worker at once
_M = (1 << 64) - 1


@lru_cache(maxsize=4)
def _tables(base: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, base^0.. and base^-0.. modulo 2^64 for one step of positions."""
    rng = np.random.default_rng([base & 0xFFFFFFFF, salt])
    inverse = pow(base, -1, 1 << 64)
    up, down = np.ones(STEP + 1, np.uint64), np.ones(STEP + 1, np.uint64)
    up[1:], down[1:] = np.uint64(base), np.uint64(inverse)
    return rng.integers(1, 1 << 63, 256, dtype=np.uint64), np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _power(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """base^at from a table of base^0..base^STEP."""
    if at.max(initial=0) < STEP:
        return table[at]
    high = at // STEP
    return table[at - high * STEP] * _steps(table, int(high.max()) + 1)[high]


def _powers(table: np.ndarray, n: int) -> np.ndarray:
    """base^0, base^1, ... base^(n - 1)."""
    if n <= STEP:
        return table[:n]
    return (_steps(table, -(-n // STEP))[:, None] * table[:STEP]).ravel()[:n]


def _steps(table: np.ndarray, n: int) -> np.ndarray:
    steps = np.ones(n, np.uint64)
    steps[1:] = table[STEP]
    return np.cumprod(steps, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Hashes of byte ranges of one text: two independent polynomials modulo 2^64 over random byte values."""

    def __init__(self, data: bytes, salt: int = 0):
        self.b = np.frombuffer(data, np.uint8)
        self.salt, self.sums = salt, {}

    def lane(self, k: int) -> np.ndarray:
        if k not in self.sums:
            byte, up, _ = _tables(BASES[k], self.salt)
            self.sums[k] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[self.b] * _powers(up, len(self.b)), dtype=np.uint64)])
        return self.sums[k]

    def ranges(self, start: np.ndarray, end: np.ndarray, k: int = 0) -> np.ndarray:
        g = self.lane(k)
        return _mixed((g[end] - g[start]) * _power(_tables(BASES[k], self.salt)[2], start) + (end - start).astype(np.uint64))

    def everywhere(self, size: int) -> np.ndarray:
        """Hash of the range of ``size`` bytes at every place, as ``ranges`` gives it."""
        g = self.lane(0)
        return _mixed((g[size:] - g[:-size]) * _powers(_tables(BASES[0], self.salt)[2], len(g) - size) + np.uint64(size))


def anchors(h: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all windows of a text, ascending, and the first window of each."""
    n = len(h.b)
    key = (h.everywhere(GRAM) & np.uint64(_M - 0xFFFFFFFF)) | np.arange(n - GRAM + 1, dtype=np.uint64)
    width, low, span = LENGTH - GRAM + 1, key, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n - LENGTH + 1], low[width - span:width - span + n - LENGTH + 1])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[begin], begin


def _keyed(docs: DataFrame) -> DataFrame:
    """``d, th, doc_id, text``: two keys of the text (120 bits of its SHA-256), so equal texts are one text in every scan."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = [F.conv(F.substring(F.sha2(text, 256), at, 15), 16, 10).cast("long") for at in (1, 16)]
    return docs.select(key[0].alias("d"), key[1].alias("th"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _long(x) -> pa.Array:
    return pa.array(np.asarray(x).view(np.int64) if len(x) else np.zeros(0, np.int64), pa.int64())


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([np.asarray(r).astype(np.uint64).view(np.int64) if r.dtype == np.uint64 else r.astype(np.int64) for r in rows], pa.list_(pa.int64()))


def _ragged(values: np.ndarray, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``values[first:past]`` of each row end to end, the offsets of the rows, and the row of each value."""
    at = np.concatenate([[0], np.cumsum(past - first)])
    row = np.repeat(np.arange(len(first)), past - first)
    return values[np.arange(at[-1]) - at[row] + first[row]], at, row


def loop_phrases(pos: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Which phrases repeat the gram they start with before it ends: the text has their length as its period there."""
    return (gram[1:] == gram[:-1]) & (np.diff(pos) < GRAM)


def loops(data: np.ndarray, pos: np.ndarray, begin: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of periodic stretches, ``first, past, step``: each window in [first, past) has the bytes of the one ``step`` before
    it, by comparison of bytes. Both are repeated, and phrases need not tell so."""
    k = np.flatnonzero(loop_phrases(pos, gram))
    start, _, row = _ragged(np.arange(len(data)), begin[k], begin[k + 1])
    step = np.diff(pos)[k][row]
    here = start + step <= len(data) - LENGTH
    start, step = start[here], step[here]
    same = np.zeros(len(start), bool)
    for p in np.unique(step):
        mine = np.flatnonzero(step == p)
        low, high = start[mine[0]], start[mine[-1]] + LENGTH
        run = np.concatenate([[0], np.cumsum(data[low:high] == data[low + p:high + p])])
        same[mine] = run[start[mine] + LENGTH - low] - run[start[mine] - low] == LENGTH
    at, step = (start + step)[same], step[same]
    edge = np.flatnonzero((np.diff(at) != 1) | (np.diff(step) != 0)) + 1
    first, last = np.concatenate([np.zeros(min(len(at), 1), np.int64), edge]), np.concatenate([edge, [len(at)] * min(len(at), 1)]).astype(np.int64)
    return at[first], at[last - 1] + 1, step[first]


def anchor_table(texts: DataFrame, salt: int) -> DataFrame:
    """``d, th, n, pos, begin, gram, sym, sym2, loops``: length, anchors, first window of each, hash of each anchor's gram, two hashes of each
    phrase (from an anchor to the end of the next one's gram; one less than anchors), and periodic windows as (first, past, step)."""
    span = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "past", "step")]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, n, pos, begin, gram, sym, sym2, again = [], [], [], [], [], [], [], []
        for k, data in enumerate(batch.column(2).to_pylist()):
            if len(data) < LENGTH:
                continue
            h = Hasher(data, salt)
            p, b = anchors(h)
            keep.append(k)
            n.append(len(data))
            pos.append(p)
            begin.append(b)
            gram.append(h.ranges(p, p + GRAM))
            sym.append(h.ranges(p[:-1], p[1:] + GRAM))
            sym2.append(h.ranges(p[:-1], p[1:] + GRAM, 1))
            again.append([{"first": int(x), "past": int(y), "step": int(z)} for x, y, z in zip(*loops(h.b, p, b, gram[-1]))])
        at = pa.array(keep, pa.int32())
        return pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(n, pa.int64()), *map(_lists, (pos, begin, gram, sym, sym2)), pa.array(again, span)],
                               ["d", "th", "n", "pos", "begin", "gram", "sym", "sym2", "loops"])

    return map_rows(texts.select("d", "th", "text"), run, "d long, th long, n long, pos array<long>, begin array<long>, gram array<long>, sym array<long>, "
                    "sym2 array<long>, loops array<struct<first:long,past:long,step:long>>", BATCH_BYTES)


def phrase_strings(marked: DataFrame) -> DataFrame:
    """Phrases between repeated anchors outside periodic stretches, ``t, i, x, x1, x2, ww, prefix, ends``: text, anchor number, this symbol
    and the next two of its string (numbers above 0; 0 past the end), the bytes of the three, and the symbols from here on that
    make up a window with the bytes up to the end of each."""
    names = ["t", "i", "x", "x1", "x2", "ww"]
    kinds = pa.schema([*[(c, pa.int64()) for c in names], ("prefix", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def run(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for t, pos, gram, sym, rep in _columns(batch, "t", "pos", "gram", "sym", "rep"):
            pos, gram, sym = np.array(pos), np.array(gram), np.array(sym, np.int64)
            often = np.zeros(len(pos), bool)
            often[rep] = True
            use = np.zeros(len(pos) + 2, bool)
            use[:len(pos) - 1] = often[:-1] & often[1:] & ~loop_phrases(pos, gram)
            k = np.flatnonzero(use)
            if not len(k):
                continue
            stop = np.flatnonzero(~use)
            end = stop[np.searchsorted(stop, k)]
            x = np.concatenate([np.maximum(sym & ((1 << 63) - 1), 1), [0, 0, 0]])
            x1, x2 = np.where(k + 1 < end, x[k + 1], 0), np.where(k + 2 < end, x[k + 2], 0)
            past = np.minimum(np.searchsorted(pos, pos[k] + LENGTH), end)
            prefix, at, row = _ragged(sym, k, past)
            ends = _ragged(pos, k + 1, past + 1)[0] - pos[k][row]
            offsets = pa.array(at, pa.int32())
            out.append(pa.table([*[pa.array(c) for c in (np.full(len(k), t), k, x[k], x1, x2, pos[np.minimum(k + 3, end)] - pos[k])],
                                 pa.ListArray.from_arrays(offsets, pa.array(prefix)), pa.ListArray.from_arrays(offsets, pa.array(ends))], schema=kinds))
        return pa.concat_tables(out) if out else kinds.empty_table()

    return map_rows(marked, run, ", ".join(f"{c} long" for c in names) + ", prefix array<long>, ends array<long>", BATCH_BYTES)


def _prefix(rows: DataFrame, keys: list[str], sums: list[str], scratch: Scratch) -> DataFrame:
    """``keys`` and ``sums`` of rows with distinct keys, each of ``sums`` replaced by its sum over the rows with smaller keys. Rows are range-partitioned,
    sorted, and written with their partition and place, which are then facts of stored data."""
    n = width(rows)
    laid = scratch.store(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()), "suffix-laid")
    # One row per partition.
    past = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = laid.groupBy("part").agg(*[F.sum(c).alias(f"{c}_all") for c in sums]).select("part", *[F.coalesce(F.sum(f"{c}_all").over(past), F.lit(0)).alias(f"{c}_base") for c in sums])
    inside = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = laid.select(*keys, "part", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(c) for c in sums])
    out = scratch.store(local.join(F.broadcast(base), "part").select(*keys, *[(F.col(c) + F.col(f"{c}_base")).alias(c) for c in sums]), "suffix-smaller")
    scratch.drop(laid)
    return out


def suffix_ranks(rows: DataFrame, need: int = LENGTH, keys: tuple[str, ...] = ("d", "th", "run"), scratch: Scratch | None = None, stride: int = 1) -> DataFrame:
    """``keys, i, rank`` of ``rows(keys, i, x, w)``, the symbols (numbers above 0) at places i of strings and their bytes: the number of suffixes
    that are smaller in the order of their symbols (the end of a string is smaller than any). Suffixes that agree on symbols of ``need``
    bytes, or entirely, may tie or come in any order. A string ends where i + ``stride`` is missing. ``x1, x2, ww`` may be given.

    Only names that several suffixes have, and that cover less than ``need`` bytes, are open: they and the name after each
    go to the next level, so levels shrink by far more than a third.
    """
    scratch = scratch or Scratch()
    at, i = [*keys, "i"], F.col("i")
    lane = Window.partitionBy(*keys, i % stride).orderBy("i")

    def ahead(value: str, by: int) -> Column:
        return F.coalesce(F.when(F.lead("i", by).over(lane) == i + by * stride, F.lead(value, by).over(lane)), F.lit(0)).cast("long")

    kind = F.expr(f"(i div {stride}) % 3").alias("kind")
    if "x1" in rows.columns:
        t, own = rows.select(*at, kind, "x", "x1", "x2", "ww"), False
    else:
        t, own = scratch.store(rows.select(*at, kind, "x", ahead("x", 1).alias("x1"), ahead("x", 2).alias("x2"),
                                           (F.col("w") + ahead("w", 1) + ahead("w", 2)).alias("ww")), "suffix-triples"), True
    # The name of a triple is 1 + the number of sampled suffixes with smaller triples.
    triple = ["x", "x1", "x2"]
    tally = scratch.store(t.where("kind > 0").groupBy(*triple).agg(F.count(F.lit(1)).alias("m"), F.min("ww").alias("least")), "suffix-tally")
    before = _prefix(tally.select(*triple, "m"), triple, ["m"], scratch)
    names = tally.join(before.withColumnRenamed("m", "less"), triple).select(
        *triple, F.lit(True).alias("named"), (F.col("less") + 1).alias("r"), ((F.col("m") > 1) & (F.col("x2") > 0) & (F.col("least") < need)).alias("open"))
    full = scratch.store(t.withColumn("named", F.col("kind") > 0).join(names, [*triple, "named"], "left").select(*at, "kind", "x", "x1", "ww", "r", "open"), "suffix-named")
    scratch.drop(tally, before, *([t] if own else []))
    if not full.where("open").isEmpty():
        behind = Window.partitionBy(*keys, i % (3 * stride)).orderBy("i")
        chosen = full.where("kind > 0").withColumn("after", F.lag(F.when(F.col("open"), i)).over(behind) == i - 3 * stride).where("open or after")
        deeper = suffix_ranks(chosen.select(*at, F.col("r").alias("x"), F.col("ww").alias("w")), need, keys, scratch, 3 * stride)
        placed = scratch.store(full.where("open").select(*at, "r").join(deeper, at), "suffix-deeper")
        least = placed.groupBy("r").agg(F.min("rank").alias("least"))
        deep = placed.join(least, "r").select(*at, (F.col("r") + F.col("rank") - F.col("least")).alias("exact"))
        finer = scratch.store(full.join(deep, at, "left").withColumn("r", F.coalesce("exact", "r")).drop("exact"), "suffix-finer")
        scratch.drop(full, deeper, placed)
        full = finer
    keyed = scratch.store(full.select(*at, "kind", "x", "x1", "r", ahead("r", 1).alias("r1"), ahead("r", 2).alias("r2")), "suffix-keys")
    scratch.drop(full)

    def merged(kinds: tuple[int, int], order: list[str]) -> DataFrame:
        """What the suffixes of two kinds add to the ranks: those of kind 0 count the smaller ones of both (of kind 2 only, in the second
        merge), the sampled ones start from their rank among themselves and count the smaller ones of kind 0."""
        part = keyed.where(F.col("kind").isin(*kinds))
        count = part.groupBy(*order).agg(*[F.sum((F.col("kind") == k).cast("long")).alias(f"n{k}") for k in kinds])
        less = _prefix(count, order, [f"n{k}" for k in kinds], scratch)
        below = F.col("n0") + F.col("n1") if kinds == (0, 1) else F.col("n2")
        return scratch.store(part.join(less, order).select(*at, F.when(F.col("kind") == 0, below).otherwise(F.col("r") - 1 + F.col("n0")).alias("rank")), "suffix-merged")

    one, two = merged((0, 1), ["x", "r1"]), merged((0, 2), ["x", "x1", "r2"])
    ranks = scratch.store(one.unionByName(two).groupBy(*at).agg(F.sum("rank").cast("long").alias("rank")), "suffix-ranks")
    scratch.drop(keyed, one, two)
    return ranks


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Number of leading elements that two arrays share."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def shared_prefixes(strings: DataFrame, ranks: DataFrame, scratch: Scratch) -> DataFrame:
    """``t, k, bytes``: of each anchor, the bytes of the longest phrase prefix that an adjacent suffix shares.

    Suffixes are range-partitioned by rank and sorted; a task compares each with the one before it and hands on its first
    and its last, which are compared across partitions afterwards."""
    rows = strings.select("t", "i", "prefix", "ends").join(ranks, ["t", "i"])
    rows = rows.repartitionByRange(width(rows), "rank", "t", "i").sortWithinPartitions("rank", "t", "i")
    edge = "part int, side int, prefix array<long>, ends array<long>"

    def compare(batches):
        from pyspark import TaskContext
        part, last, opened = TaskContext.get().partitionId(), None, False
        kinds = pa.schema([("t", pa.int64()), ("k", pa.int64()), ("bytes", pa.int64()), ("part", pa.int32()), ("side", pa.int32()),
                           ("prefix", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

        def border(row, side):
            return pa.record_batch([pa.array([v], f.type) for v, f in zip((row[0], row[1], 0, part, side, row[2].tolist(), row[3].tolist()), kinds)], schema=kinds)

        for batch in batches:
            if not batch.num_rows:
                continue
            t, i = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            at = batch.column(2).offsets.to_numpy()
            prefix, ends = (batch.column(c).values.to_numpy(zero_copy_only=False) for c in (2, 3))
            shift = batch.column(3).offsets.to_numpy() - at  # lists of both columns have equal lengths
            best = np.zeros(batch.num_rows, np.int64)
            row = lambda j: (int(t[j]), int(i[j]), prefix[at[j]:at[j + 1]], ends[at[j] + shift[j]:at[j + 1] + shift[j]])
            if not opened:
                opened = True
                yield border(row(0), 0)
            else:
                n = _agree(last[2], row(0)[2])
                if n:
                    best[0] = row(0)[3][n - 1]
                    yield pa.record_batch([pa.array([v], f.type) for v, f in zip((last[0], last[1], int(last[3][n - 1]), None, None, None, None), kinds)], schema=kinds)
            size, first = np.diff(at), prefix[np.minimum(at[:-1], len(prefix) - 1)]
            for j in (np.flatnonzero((first[1:] == first[:-1]) & (size[1:] > 0) & (size[:-1] > 0)) + 1).tolist():
                n = _agree(prefix[at[j - 1]:at[j]], prefix[at[j]:at[j + 1]])
                best[j - 1] = max(best[j - 1], ends[at[j - 1] + shift[j - 1] + n - 1])
                best[j] = max(best[j], ends[at[j] + shift[j] + n - 1])
            good = np.flatnonzero(best)
            empty = [pa.nulls(len(good), f.type) for f in list(kinds)[3:]]
            yield pa.record_batch([pa.array(t[good]), pa.array(i[good]), pa.array(best[good]), *empty], schema=kinds)
            last = tuple(x.copy() if isinstance(x, np.ndarray) else x for x in row(batch.num_rows - 1))
        if opened:
            yield border(last, 1)

    found = scratch.store(rows.select("t", "i", "prefix", "ends").mapInArrow(compare, f"t long, k long, bytes long, {edge}"), "suffix-shared")
    # Two rows per partition: the last of one and the first of the next.
    order = Window.orderBy("part", "side")
    pairs = found.where("part is not null").select("t", "k", "side", "prefix", "ends", *[F.lead(c).over(order).alias(f"o{c}") for c in ("t", "k", "side", "prefix", "ends")])
    pairs = pairs.where("side = 1 and oside = 0").withColumn("n", _common("prefix", "oprefix")).where("n > 0")
    sides = pairs.select("t", "k", F.element_at("ends", F.col("n")).alias("bytes")).unionByName(
        pairs.select(F.col("ot").alias("t"), F.col("ok").alias("k"), F.element_at("oends", F.col("n")).alias("bytes")))
    return found.where("part is null").select("t", "k", "bytes").unionByName(sides).groupBy("t", "k").agg(F.max("bytes").alias("bytes"))


def _common(a: str, b: str) -> Column:
    """Number of leading elements that two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.when(F.array_position(same, F.lit(False)) == 0, F.size(same)).otherwise(F.array_position(same, F.lit(False)).cast("int") - 1).cast("int")


def window_states(n: int, pos: np.ndarray, begin: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of a text: its anchor, whether it lies inside a shared phrase prefix, and whether it may be
    repeated at all. ``reach`` is the bytes from each anchor that are shared, 0 if its gram occurs once."""
    start = np.arange(n - LENGTH + 1)
    mark = np.zeros(len(start) + 1, np.int64)
    long = np.flatnonzero(reach >= LENGTH)
    np.add.at(mark, pos[long], 1)
    np.add.at(mark, np.minimum(pos[long] + reach[long] - LENGTH + 1, len(start)), -1)
    own = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(start)))
    return own, np.cumsum(mark)[:-1] > 0, reach[own] > 0


_MARKED = ("n", "pos", "begin", "rep", "shared", "loops")


def _states(n: int, pos: list[int], begin: list[int], rep: list[int], shared: list | None, again: list) -> tuple:
    """Anchors' places, and for each window its anchor, known to be repeated, possible, the distance from its start to the anchor,
    and whether it repeats an earlier window of the same periodic stretch."""
    p, reach = np.array(pos), np.zeros(len(pos), np.int64)
    reach[rep] = GRAM
    for x in shared or ():
        reach[x["k"]] += x["bytes"]
    own, inside, may = window_states(n, p, np.array(begin), reach)
    later = np.zeros(len(own), bool)
    for x in again:
        later[x["first"]:x["past"]] = True
        inside[x["first"] - x["step"]:x["past"]] = True
    return p, own, inside, may, p[own] - np.arange(len(own)), later


def _columns(batch: pa.RecordBatch, *names: str):
    return zip(*[batch.column(c).to_pylist() for c in names])


def open_ranges(marked: DataFrame) -> DataFrame:
    """``gram, low, high``: distances to their anchor of the windows that phrases leave open."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        gram, low, high = [], [], []
        for g, *state in _columns(batch, "gram", *_MARKED):
            _, own, inside, may, away, _ = _states(*state)
            at = np.flatnonzero(may & ~inside)
            if not len(at):
                continue
            cut = np.flatnonzero(np.concatenate([[True], own[at][1:] != own[at][:-1]]))
            gram += [g[k] for k in own[at][cut].tolist()]
            low += np.minimum.reduceat(away[at], cut).tolist()
            high += np.maximum.reduceat(away[at], cut).tolist()
        return pa.record_batch([pa.array(c, pa.int64()) for c in (gram, low, high)], ["gram", "low", "high"])

    return map_rows(marked, run, "gram long, low long, high long", BATCH_BYTES).groupBy("gram").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _asked(state: tuple, asked: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows in the open ranges that may be repeated: start, anchor, block of distances, and the anchors' places. Of a periodic
    stretch, the windows of its first period stand for the others."""
    p, own, _, may, away, later = _states(*state)
    low, high = np.full(len(p), 1 << 40), np.full(len(p), -1)
    for x in asked:
        low[x["k"]], high[x["k"]] = x["low"], x["high"]
    at = np.flatnonzero(may & ~later & (away >= low[own]) & (away <= high[own]))
    return at, own[at], away[at] // BLOCK, p


def open_cores(texts: DataFrame, salt: int) -> DataFrame:
    """``d, th, start, wide, h, c, c2``: the open windows of a block (``BLOCK`` distances from one anchor), the hash of the bytes they
    have in common, and two hashes of the bytes they cover. None of them is repeated unless ``h`` is; all are if ``c, c2`` are."""
    names = ["d", "th", "start", "wide", "h", "c", "c2"]

    def run(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for d, th, data, asked, *state in _columns(batch, "d", "th", "text", "asked", *_MARKED):
            at, own, block, p = _asked(state, asked)
            if len(at):
                first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (block[1:] != block[:-1]) | (np.diff(at) != 1)]))
                wide = np.diff(first, append=len(at))
                core, start = p[own[first]] - BLOCK * block[first], at[first]
                hasher = Hasher(data, salt)
                out.append(pa.table([pa.array(np.full(len(first), d)), pa.array(np.full(len(first), th)), pa.array(start), pa.array(wide),
                                     _long(hasher.ranges(core, core + LENGTH - BLOCK + 1)), *[_long(hasher.ranges(start, start + wide - 1 + LENGTH, k)) for k in (0, 1)]], names))
        kinds = pa.schema([(c, pa.int64()) for c in names])
        return pa.concat_tables(out).cast(kinds) if out else kinds.empty_table()

    return map_rows(texts, run, ", ".join(f"{c} long" for c in names), BATCH_BYTES)


def open_windows(texts: DataFrame, salt: int) -> DataFrame:
    """``d, th, start, h, h2`` of the windows in ``blocks`` of (start, wide)."""
    def run(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for d, th, data, blocks in _columns(batch, "d", "th", "text", "blocks"):
            at = np.concatenate([np.arange(x["start"], x["start"] + x["wide"]) for x in blocks])
            h = Hasher(data, salt)
            out.append(pa.table([pa.array(np.full(len(at), d)), pa.array(np.full(len(at), th)), pa.array(at), _long(h.ranges(at, at + LENGTH)), _long(h.ranges(at, at + LENGTH, 1))],
                                ["d", "th", "start", "h", "h2"]))
        return pa.concat_tables(out)

    return map_rows(texts, run, "d long, th long, start long, h long, h2 long", BATCH_BYTES)


def repeated_windows(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``d, th, n, inside, starts`` of distinct ``texts(d, th, text)`` with a repeated gram: the runs (start, wide) of windows that phrases
    and periods prove repeated, and those that comparing windows does."""
    salt = 0
    while True:
        table = scratch.store(anchor_table(texts, salt).withColumn("t", F.monotonically_increasing_id()), "suffix-anchors")
        grams = table.select("t", F.posexplode("gram").alias("k", "gram"))
        often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("gram")
        rep = scratch.store(grams.join(often, "gram").groupBy("t").agg(F.sort_array(F.collect_list("k")).alias("rep")), "suffix-repeated")
        known = scratch.store(table.join(rep, "t"), "suffix-known")
        # Two phrases of one symbol are told apart by their second hash; then everything is hashed anew with another salt.
        both = known.select(F.explode(F.arrays_zip("sym", "sym2")).alias("s"))
        clash = not both.groupBy("s.sym").agg(F.min("s.sym2").alias("a"), F.max("s.sym2").alias("b")).where("a <> b").isEmpty()
        scratch.drop(table, rep)
        if not clash:
            break
        scratch.drop(known)
        salt += 1
    strings = scratch.store(phrase_strings(known.select("t", "pos", "gram", "sym", "rep")), "suffix-strings")
    ranks = suffix_ranks(strings.select("t", "i", "x", "x1", "x2", "ww"), LENGTH, ("t",), scratch)
    shared = shared_prefixes(strings, ranks, scratch).groupBy("t").agg(F.collect_list(F.struct("k", "bytes")).alias("shared"))
    marked = scratch.store(known.drop("sym", "sym2").join(shared, "t", "left"), "suffix-marked")
    scratch.drop(known, strings, ranks)
    wanted = open_ranges(marked)
    places = marked.select("t", F.explode(F.transform("rep", lambda k: F.struct(k.alias("k"), F.get("gram", k).alias("gram")))).alias("p")).select("t", "p.k", "p.gram")
    asked = scratch.store(places.join(wanted, "gram").groupBy("t").agg(F.collect_list(F.struct("k", "low", "high")).alias("asked")), "suffix-asked")
    states = marked.join(asked, "t").select("d", "th", "asked", *_MARKED)
    cores = scratch.store(open_cores(texts.select("d", "th", "text").join(states, ["d", "th"]), salt), "suffix-cores")
    # Blocks that cover the same bytes are repeated whole, and one of them stands for all where other bytes surround the same core.
    covers = scratch.store(cores.groupBy("h", "c", "c2").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("d", "th", "start", "wide")).alias("one")).select("h", "c", "c2", "m", "one.*"), "suffix-covers")
    mixed = covers.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("h")
    blocks = scratch.store(covers.join(mixed, "h").groupBy("d", "th").agg(F.collect_list(F.struct("start", "wide")).alias("blocks")), "suffix-blocks")
    windows = scratch.store(open_windows(texts.select("d", "th", "text").join(blocks, ["d", "th"]), salt), "suffix-windows")
    again = windows.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h", "h2")
    known = cores.join(covers.where("m > 1").select("h", "c", "c2"), ["h", "c", "c2"]).select("d", "th", "start", "wide").unionByName(
        windows.join(again, ["h", "h2"]).select("d", "th", "start", F.lit(1).cast("long").alias("wide")))
    starts = known.groupBy("d", "th").agg(F.collect_list(F.struct("start", "wide")).alias("starts"))

    def proven(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = []
        for state in _columns(batch, *_MARKED):
            edge = np.flatnonzero(np.diff(_states(*state)[2].astype(np.int8), prepend=0, append=0))
            runs.append([{"start": int(a), "wide": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
        return pa.record_batch([batch.column("d"), batch.column("th"), batch.column("n"), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("wide", pa.int64())])))],
                               ["d", "th", "n", "inside"])

    inside = map_rows(marked.select("d", "th", *_MARKED), proven, "d long, th long, n long, inside array<struct<start:long,wide:long>>", BATCH_BYTES)
    found = scratch.store(inside.join(starts, ["d", "th"], "left"), "suffix-found")
    scratch.drop(marked, asked, cores, covers, blocks, windows)
    return found


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed`` of each row: every byte covered by a 400-byte string that also
    starts anywhere else, in the same text or another, is removed; ``removed`` lists the maximal runs as (start, end).

    Matches never cross texts; texts are UTF-8 bytes, null counts as empty and shorter texts than 400 bytes stay as they are.
    Equal texts are looked at once; they repeat each other's bytes, so nothing of at least 400 bytes is left of them, whatever their
    ids. Null ids are ids of their own. A long periodic text is a few ranges of windows. An empty table gives an empty result; other
    columns are not read.
    """
    scratch, keyed = Scratch(), _keyed(docs)
    # One row of each text, in buckets of its keys, so that joins do not send texts around again.
    texts = scratch.own(bucketed(keyed.groupBy("d", "th").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("m")), ["d", "th"], "suffix-texts"))
    found = repeated_windows(texts, scratch)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, gone, runs, digest, spans = [], [], [], [], []
        for data, m, inside, starts in _columns(batch, "text", "m", "inside", "starts"):
            mark = np.zeros(len(data) + 1, np.int64)
            if m > 1 and len(data) >= LENGTH:
                mark[0], mark[-1] = 1, -1
            else:
                known = [*(inside or ()), *(starts or ())]
                first = np.array([x["start"] for x in known], np.int64)
                np.add.at(mark, first, 1)
                np.add.at(mark, first + np.array([x["wide"] for x in known], np.int64) + LENGTH - 1, -1)
            out = np.cumsum(mark)[:-1] > 0
            edge = np.flatnonzero(np.diff(out.astype(np.int8), prepend=0, append=0))
            size.append(len(data))
            gone.append(int(out.sum()))
            runs.append(len(edge) // 2)
            digest.append(hashlib.sha256(np.frombuffer(data, np.uint8)[~out].tobytes()).hexdigest())
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.record_batch([batch.column("d"), batch.column("th"), *[pa.array(c, pa.int64()) for c in (size, gone, runs)], pa.array(digest, pa.string()), pa.array(spans, kind)],
                               ["d", "th", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    rows = texts.join(found.drop("n"), ["d", "th"], "left").select("d", "th", "text", "m", "inside", "starts")
    judged = scratch.store(map_rows(rows, cut, "d long, th long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>", BATCH_BYTES), "suffix-judged")
    scratch.drop(found, texts)
    return keyed.select("d", "th", "doc_id").join(judged, ["d", "th"]).drop("d", "th")
