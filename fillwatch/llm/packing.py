"""Sum-of-squares packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwatch.llm.bpe import text_ids
from fillwatch.llm.common import map_rows, stored

CAPACITY = 1024
GROUP_ROWS = 20_000  # open pieces packed by one task; full sequences need no packing
BIN_BITS = 20


def pieces(docs: DataFrame, tokenizer: str, *, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """``row_id, doc_id, piece, start, length, ids_crc32``: each document's ids and ``end_id``, cut only if longer
    than ``capacity``; then the first piece takes what the full ones leave."""
    def cut(batch: pa.RecordBatch) -> pa.Table:
        row, doc, piece, start, length, crc = [], [], [], [], [], []
        for r, d, t in zip(*[c.to_pylist() for c in batch.columns]):
            data = text_ids(tokenizer, t or "").tobytes() + np.uint32(end_id).tobytes()
            n = len(data) // 4
            head = n % capacity or capacity
            edges = [0, *range(head, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                row.append(r)
                doc.append(d)
                piece.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(data[4 * a:4 * b]))
        return pa.table([pa.array(row, pa.int64()), pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                         pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                        ["row_id", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, cut, "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long")


class SumOfSquares:
    """Open bins by residual gap. A piece goes where the sum over gaps of (open bins)^2 becomes smallest:
    a bin of gap g moves to gap g - s (full ones leave), or a new bin opens with gap capacity - s.
    Ties go to the smallest gap, and to an open bin before a new one."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = 0

    def place(self, size: int) -> tuple[int, int]:
        """Bin number and offset for the next piece."""
        count, cap = self.count, self.capacity
        change = count[:cap - size + 1] - count[size:]  # gap g >= size moves to g - size: 2 (N(g-s) - N(g)) + 2
        change = 2 * change + 2
        change[0] = 1 - 2 * count[size]  # a bin that becomes full
        change[count[size:] == 0] = np.iinfo(np.int64).max
        g = int(change.argmin()) + size
        fresh = 2 * int(count[cap - size]) + 1 if size < cap else 0
        if fresh < change[g - size]:
            b, g = self.opened, cap
            self.opened += 1
        else:
            b = self.bins[g].pop()
            count[g] -= 1
        if g > size:
            self.bins[g - size].append(b)
            count[g - size] += 1
        return b, cap - g


def fill_bins(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece (sizes in falling order). Bins that end with a gap of at most a 32nd of the capacity stay;
    the pieces of the others are placed anew, among themselves, as long as that needs fewer bins."""
    out, todo, used, best = [(0, 0)] * len(sizes), list(range(len(sizes))), 0, None
    while todo:
        bins = SumOfSquares(capacity)
        placed = [bins.place(sizes[k]) for k in todo]
        if best is not None and bins.opened >= best:
            break
        load = np.bincount([b for b, _ in placed], [sizes[k] for k in todo], bins.opened)
        done = capacity - load <= capacity // 32
        number = used + np.cumsum(done) - 1
        loose = used + int(done.sum()) + np.cumsum(~done) - 1  # numbers of the others, if they are not placed better
        for k, (b, o) in zip(todo, placed):
            out[k] = (int(number[b] if done[b] else loose[b]), o)
        used += int(done.sum())
        best = bins.opened - int(done.sum())
        todo = [k for k, (b, _) in zip(todo, placed) if not done[b]]
    return out


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 2, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Pieces of exactly ``capacity`` ids are sequences by themselves. The others, at most one of each document, are dealt by
    a hash into groups of about ``group_rows``, and each group is packed by one task, largest pieces first, so that a
    task's work does not grow with the data; its bins stay within the group. Null and empty texts are the end id alone.
    Repeated rows are packed as often as they come, null ids too; an empty table gives an empty result; other columns are
    not read. The table of pieces is written once, so a lost executor never packs a second version of them.
    """
    cut = stored(pieces(docs, tokenizer, end_id=end_id, capacity=capacity), "pack-pieces")
    rest = cut.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_rows))

    def fill(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(part)  # the groups of one task: group_rows small rows each
        if not frames:
            return
        rows = pd.concat(frames)
        for group, df in rows.groupby("grp", sort=True):
            df = df.sort_values(["length", "doc_id", "row_id", "piece"], ascending=[False, True, True, True])
            placed = fill_bins(df["length"].tolist(), capacity)
            df["sequence_id"] = [-1 - ((group << BIN_BITS) + b) for b, _ in placed]
            df["offset"] = [o for _, o in placed]
            yield df.drop(columns=["grp", "row_id"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = rest.withColumn("grp", F.pmod(F.xxhash64("row_id"), F.lit(groups)).cast("long")) \
                 .repartition(groups, "grp").mapInPandas(fill, schema)
    full = cut.where(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
