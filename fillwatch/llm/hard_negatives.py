"""Hard negatives of anchors, by a secondary sort of scored pairs.

Rows are cut into blocks. Each block of anchors meets each block of rows once, as a product of two matrices of whole numbers, so
scores are exact. Of what a task scores, only pairs that can still be chosen leave it: first the best positives of
each anchor, then, once an anchor's positives are known, the best negatives within each of its windows. A pair is packed
into one binary key (anchor, descending score, negatives after positives, id) whose bytes sort in that order;
``repartitionAndSortWithinPartitions`` deals the keys by anchor and sorts them, and a streaming iterator
reads on: a positive opens its window, a negative is emitted for each open window it falls into, and nothing but the
open windows is held. A window lies below its positive, so the positive always comes first.

Rows with a null id, label or vector, or a null or non-finite component take no part. Components beyond 2^28 whole units are
set to that, so that scores fit a long. Vectors of different lengths are multiplied over the components that both have. Rows
that repeat an id are rows of their own (each is an anchor if its id says so, and the other a positive or negative of it). Ties go to the
smaller id. An anchor without positives, or a window without negatives, gives no rows, and so does an empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwatch.llm.common import stored
from fillwatch.llm.vectors import usable, whole
from fillwatch.operators.ordered import global_position
from fillwatch.session import width

ANCHOR_BLOCK, ROW_BLOCK, SLICE, BITS = 32_768, 2048, 512, 28
_EXACT, _LOW = 1 << 53, -(1 << 63) + 1
WINDOWS = "array<struct<anchor:bigint,score:bigint>>"
PAIR = "anchor BIGINT, anchor_id BIGINT, id BIGINT, score BIGINT"
_KEY = struct.Struct(">QQBQ")
_TOP = 1 << 63  # signed numbers plus this sort as unsigned bytes do


def pack_key(anchor: int, score: int, negative: bool, vec_id: int) -> bytes:
    return _KEY.pack(anchor + _TOP, _TOP - 1 - score, negative, vec_id + _TOP)


def unpack_key(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, vec_id = _KEY.unpack(key)
    return anchor - _TOP, _TOP - 1 - score, bool(negative), vec_id - _TOP


def dealt_by(key: bytes) -> int:
    """Partition number before the modulus: all keys of an anchor meet."""
    return zlib.crc32(key[:8])


class Block:
    """One packed block in order of position: position, id, label, and the vectors as a matrix."""

    def __init__(self, items: pa.StructArray):
        self.pos, self.id, self.label = (items.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        lists = items.field(3)
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        self.x = np.zeros((len(size), int(size.max(initial=0))), dtype=np.int64)
        self.x[np.arange(self.x.shape[1])[None, :] < size[:, None]] = flat

    def scores(self, other: "Block", at: slice) -> np.ndarray:
        w = min(self.x.shape[1], other.x.shape[1])
        a, b = self.x[at, :w], other.x[:, :w]
        if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(w, 1) < _EXACT:
            return (a.astype(float) @ b.T.astype(float)).astype(np.int64)  # every partial sum is a whole number below 2^53
        return a @ b.T


class Best:
    """The best ``n`` scored rows of each of ``m`` anchors so far; ties go to the smaller row number, which follows the id."""

    def __init__(self, m: int, n: int):
        self.score, self.pos, self.id = np.full((m, n), _LOW), np.zeros((m, n), dtype=np.int64), np.zeros((m, n), dtype=np.int64)

    def add(self, scores: np.ndarray, allowed: np.ndarray, block: Block, at: slice) -> None:
        """Anchors ``at`` against one block: its best few of each anchor join those held, and the best of both stay."""
        held, n = np.where(allowed, scores, _LOW), self.score.shape[1]
        every, cols = np.arange(len(held)), []
        for _ in range(n):
            cols.append(held.argmax(1))  # the first of equal scores: blocks are in id order
            if cols[-1].size and held[every, cols[-1]].max() == _LOW:
                cols.pop()
                break
            held[every, cols[-1]] = _LOW
        if cols:
            col = np.stack(cols, axis=1)
            score = np.where(np.take_along_axis(allowed, col, 1), np.take_along_axis(scores, col, 1), _LOW)
            score, pos, ids = (np.concatenate(x, axis=1) for x in ((self.score[at], score), (self.pos[at], block.pos[col]), (self.id[at], block.id[col])))
            order = np.lexsort((pos, -score))[:, :n]
            self.score[at], self.pos[at], self.id[at] = (np.take_along_axis(x, order, 1) for x in (score, pos, ids))


def _pairs(anchors: Block, best: list[Best]) -> pa.RecordBatch:
    """Distinct pairs held in any of ``best``."""
    score, pos, ids = (np.concatenate([getattr(b, c) for b in best], axis=1) for c in ("score", "pos", "id"))
    row, col = np.nonzero(score > _LOW)
    found = np.stack([anchors.pos[row], anchors.id[row], ids[row, col], score[row, col], pos[row, col]])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(found, axis=1)[:4]], ["anchor", "anchor_id", "id", "score"])


def window_of(score: int) -> tuple[int, int]:
    """Least and greatest score of a negative: 50 * score <= 100 * s <= 95 * score."""
    return -(-score // 2), 95 * score // 100


def _dealt(anchors: DataFrame, rows: DataFrame, blocks: int, lanes: int) -> DataFrame:
    """Each anchor block followed by the row blocks of one lane; there are ``blocks * lanes`` such runs, of like size."""
    left = anchors.select("a", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(-1).cast("long").alias("block"), "items", "windows")
    right = rows.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("a"),
                        F.pmod("block", F.lit(lanes)).cast("int").alias("lane"), "block", "items", F.lit(None).cast(WINDOWS).alias("windows"))
    return left.unionByName(right).repartition(max(width(rows), blocks * lanes), "a", "lane").sortWithinPartitions("a", "lane", "block")


def _runs(batches: Iterator[pa.RecordBatch], start, add) -> Iterator[pa.RecordBatch]:
    """``start(anchors, windows)`` at the head of a run, ``add(anchors, state, block)`` for each of its row blocks, its pairs at the end."""
    run, anchors, state = None, None, None
    for batch in batches:
        for k, (a, block, lane) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "block", "lane")))):
            head = block < 0
            if not head and run != (a, lane):  # no anchors here, or none with a positive
                continue
            block = Block(batch.column("items")[k].values)
            if head:
                if anchors is not None:
                    yield _pairs(anchors, state[0])
                run, anchors, state = (a, lane), block, start(block, batch.column("windows")[k].values)
            else:
                for i in range(0, len(anchors.pos), SLICE):
                    add(anchors, state, block, slice(i, i + SLICE))
    if anchors is not None:
        yield _pairs(anchors, state[0])


def _keyed(pairs: DataFrame, negative: bool) -> RDD:
    return pairs.select("anchor", "score", "id", "anchor_id").rdd.map(
        lambda r: (pack_key(r[0], r[1], negative, r[2]), r[3]))


def first_positives(pairs: RDD, n: int) -> Iterator[tuple[int, int, int, int]]:
    """Of keys in order, the first ``n`` of each anchor."""
    now, seen = None, 0
    for key, anchor_id in pairs:
        anchor, score, _, vec_id = unpack_key(key)
        if anchor != now:
            now, seen = anchor, 0
        seen += 1
        if seen <= n:
            yield anchor, anchor_id, vec_id, score


def stream_negatives(pairs, n: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Keys in order, positives and negatives mixed: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    now, open_ = None, []
    for key, anchor_id in pairs:
        anchor, score, negative, vec_id = unpack_key(key)
        if anchor != now:
            now, open_ = anchor, []
        if not negative:
            low, high = window_of(score)
            if low <= high:
                open_.append([low, high, vec_id, score, 0])
            continue
        for w in open_:
            if w[0] <= score <= w[1] and w[4] < n:
                w[4] += 1
                yield anchor_id, w[2], w[4], vec_id, w[3], score
        open_ = [w for w in open_ if w[4] < n and w[0] <= score]


RESULT = "anchor_id LONG, positive_id LONG, rank INT, negative_id LONG, positive_score LONG, negative_score LONG"


def mine(vectors: DataFrame, *, vec_id: str = "vec_id", vec: str = "embedding", label: Column | str = "label", anchors: Column | None = None,
         scale: int = 256, positives: int = 5, negatives: int = 3, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels
    that score between 50 and 95 % of the positive. ``anchors`` says which rows are anchors (all, if not given)."""
    spark = vectors.sparkSession
    v, tag = F.col(vec).cast("array<double>"), F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), tag.cast("long").alias("label"), v.alias("v"),
                          F.coalesce(F.lit(True) if anchors is None else anchors, F.lit(False)).alias("is_anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("v", whole(F.col("v"), scale, BITS))
    rows = stored(global_position(rows, ["id", "label", "v"]), "negatives-rows")  # "pos" tells rows apart, whatever their ids
    n_rows, n_anchors = rows.count(), rows.where("is_anchor").count()
    if not n_rows or not n_anchors:
        return spark.createDataFrame([], RESULT)
    parts, blocks, row_blocks = width(rows), -(-n_anchors // anchor_block), -(-n_rows // row_block)
    lanes = max(1, min(row_blocks, -(-4 * parts // blocks)))
    items = F.array_sort(F.collect_list(F.struct("pos", "id", "label", "v"))).alias("items")
    packed = stored(rows.groupBy(F.expr(f"pos div {row_block}").alias("block")).agg(items), "negatives-row-blocks")
    block_of = F.pmod(F.xxhash64("pos"), F.lit(blocks).cast("long"))
    heads = stored(rows.where("is_anchor").groupBy(block_of.alias("a")).agg(items), "negatives-anchor-blocks")

    def positive_pairs(batches):
        def add(a, state, b, at):
            s = a.scores(b, at)
            state[0][0].add(s, (a.label[at, None] == b.label[None, :]) & (a.pos[at, None] != b.pos[None, :]), b, at)

        return _runs(batches, lambda a, _: ([Best(len(a.pos), positives)],), add)

    def negative_pairs(batches):
        def start(a, windows):
            place = {p: i for i, p in enumerate(a.pos.tolist())}
            low, high = np.ones((positives, len(a.pos)), dtype=np.int64), np.zeros((positives, len(a.pos)), dtype=np.int64)  # empty windows
            used = [0] * len(a.pos)
            for anchor, score in zip(windows.field(0).to_pylist(), windows.field(1).to_pylist()):
                i = place[anchor]
                low[used[i], i], high[used[i], i] = window_of(score)
                used[i] += 1
            return [Best(len(a.pos), negatives) for _ in range(positives)], low, high

        def add(a, state, b, at):
            s, other = a.scores(b, at), a.label[at, None] != b.label[None, :]
            for best, low, high in zip(*state):
                best.add(s, other & (s >= low[at, None]) & (s <= high[at, None]), b, at)

        return _runs(batches, start, add)

    none = heads.withColumn("windows", F.lit(None).cast(WINDOWS))
    found = _dealt(none, packed, blocks, lanes).mapInArrow(positive_pairs, PAIR)
    firsts = _keyed(found, False).repartitionAndSortWithinPartitions(parts, dealt_by).mapPartitions(lambda it: first_positives(it, positives))
    firsts = stored(spark.createDataFrame(firsts, PAIR), "negatives-positives")
    windows = firsts.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(blocks).cast("long")).alias("a")).agg(
        F.collect_list(F.struct("anchor", "score")).alias("windows"))
    rest = _dealt(heads.join(windows, "a"), packed, blocks, lanes).mapInArrow(negative_pairs, PAIR)
    both = _keyed(firsts, False).union(_keyed(rest, True))
    out = both.repartitionAndSortWithinPartitions(parts, dealt_by).mapPartitions(lambda it: stream_negatives(it, negatives))
    return spark.createDataFrame(out, RESULT)
