"""Trades packed one row per segment, stored in buckets, for jobs that pass over the same trades many times.

A packed row holds a segment's columns as lists, its distinct wallets, and for each trade the place of its wallet among them.
What a pass needs per wallet (a propensity, a search point) is sent to the segments as lists beside their wallets: only
(segment, wallet) pairs are shuffled. The packed rows are bucketed by their key and stay where they are. What a pass
finds per wallet comes back as lists, too, summed within the segment, so a wallet with a third of all trades costs
one pair per segment it trades in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwatch.operators.scoring import GROUP_ROWS, KEYS, _segmented, whole_segments
from fillwatch.session import bucketed, stored, width

_HEAD = "market STRING, seg BIGINT, wallets ARRAY<STRING>, w ARRAY<INT>"


def lists(values, lengths: np.ndarray) -> pa.ListArray:
    """Values laid end to end as one list per length."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _packed(table: pa.Table, lengths: np.ndarray, columns: Sequence[str]) -> list[pa.Array]:
    """``wallets``, ``w`` and the named columns as lists."""
    at, names, places = 0, [], []
    for n in lengths.tolist():
        coded = table.column("wallet").slice(at, n).combine_chunks().dictionary_encode(null_encoding="encode")
        names.append(coded.dictionary)
        places.append(coded.indices)
        at += n
    return [lists(pa.concat_arrays(names), np.array([len(x) for x in names])), lists(pa.concat_arrays(places).cast(pa.int32()), lengths),
            *(lists(table.column(c).cast(pa.float64()), lengths) for c in columns)]


@dataclass(frozen=True)
class Packed:
    """``table``: bucketed packed rows; ``pairs``: market, seg, k, wallet of every wallet of every packed row."""

    table: DataFrame
    pairs: DataFrame

    @classmethod
    def store(cls, packed: DataFrame, name: str, pairs: DataFrame | None = None) -> "Packed":
        table = bucketed(packed, KEYS, name)
        if pairs is None:
            pairs = stored(table.select(*KEYS, F.posexplode("wallets").alias("k", "wallet")), f"{name}-pairs")
        return cls(table, pairs)

    def beside(self, values: DataFrame) -> DataFrame:
        """The packed rows with one list for each column of ``values`` (one row per wallet), in the order of ``wallets``."""
        names = [c for c in values.columns if c != "wallet"]
        sent = self.pairs.join(values, "wallet", "left").groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("k", *names))).alias("_s"))
        return self.table.join(sent.select(*KEYS, *[F.col("_s")[c].alias(c) for c in names]).hint("shuffle_hash"), KEYS)


def pack_segments(features: DataFrame, segment_rows: int, lead: int = 0) -> Packed:
    """One exchange of the trades, after which no pass exchanges them again.

    With ``lead``, only that many last trades of each full segment, under the number of the segment that they lead into."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, lengths in whole_segments(batches):
            at = pa.array(np.concatenate([[0], np.cumsum(lengths)[:-1]]))
            heads = [table.column(c).take(at).combine_chunks() for c in KEYS]
            yield pa.RecordBatch.from_arrays([*heads, *_packed(table, lengths, ("y", "delta", "log_size_ratio"))],
                                             [*KEYS, "wallets", "w", "y", "delta", "lsr"])

    rows = _segmented(features, None, segment_rows).select(*KEYS, "i", "wallet", "y", "delta", "log_size_ratio")
    if lead:
        rows = rows.where(F.col("i") % segment_rows >= segment_rows - lead).withColumn("seg", F.col("seg") + 1)
    made = rows.repartition(width(rows), *KEYS).sortWithinPartitions(*KEYS, "i").mapInArrow(
        go, f"{_HEAD}, y ARRAY<DOUBLE>, delta ARRAY<DOUBLE>, lsr ARRAY<DOUBLE>")
    return Packed.store(made, "packed-leads" if lead else "packed-segments")


DESIGN = ("x_s", "x_z", "target")
DESIGN_DDL = f"{_HEAD}, {', '.join(f'{c} ARRAY<DOUBLE>' for c in DESIGN)}"


def pack_design(rows: DataFrame, block_rows: int = GROUP_ROWS) -> Packed:
    """Regression rows ``wallet, x_s, x_z, target`` in blocks of the partitions they lie in: no exchange, whatever the wallets."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, block = [], 0, TaskContext.get().partitionId() << 32

        def full():
            table = pa.Table.from_batches(held)
            return pa.RecordBatch.from_arrays([pa.array([""]), pa.array([block]), *_packed(table, np.array([n]), DESIGN)], [*KEYS, "wallets", "w", *DESIGN])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= block_rows:
                yield full()
                held, n, block = [], 0, block + 1
        if n:
            yield full()

    return Packed.store(rows.select("wallet", *DESIGN).mapInArrow(go, DESIGN_DDL), "packed-design")


class Group:
    """Some packed rows of one batch, laid end to end."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        self.sizes = pa.compute.list_value_length(batch.column("wallets")).to_numpy()
        self.lengths = pa.compute.list_value_length(batch.column("w")).to_numpy()
        self.first_wallet = np.concatenate([[0], np.cumsum(self.sizes)])
        self.at = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.w = batch.column("w").flatten().to_numpy(zero_copy_only=False) + np.repeat(self.first_wallet[:-1], self.lengths)

    def rows(self, name: str) -> np.ndarray:
        """A column of the trades."""
        return self.batch.column(name).flatten().to_numpy(zero_copy_only=False)

    def of_wallets(self, name: str) -> np.ndarray:
        """A column sent beside the wallets, for each trade; NaN where null."""
        return self.wallets(name)[self.w]

    def wallets(self, name: str) -> np.ndarray:
        return self.batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(float)

    def per_wallet(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.w, weights=values, minlength=int(self.first_wallet[-1]))

    def wallet_lists(self, values: np.ndarray) -> pa.ListArray:
        return lists(values, self.sizes)


def groups(batches: Iterator[pa.RecordBatch], rows: int = GROUP_ROWS) -> Iterator[Group]:
    """Packed rows of about ``rows`` trades at a time."""
    for batch in batches:
        n = pa.compute.list_value_length(batch.column("w")).to_numpy().cumsum() if batch.num_rows else np.zeros(0, dtype=int)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(n, (n[a - 1] if a else 0) + rows, side="right")))
            yield Group(batch.slice(a, b - a))
            a = b


def wallet_sums(packed: DataFrame, fn: Callable[[Group], Sequence[np.ndarray]], names: Sequence[str]) -> DataFrame:
    """``fn`` gives one number per wallet of a group for each name; their sums per wallet."""
    def go(batches):
        for g in groups(batches):
            yield pa.RecordBatch.from_arrays([g.batch.column("wallets"), *(g.wallet_lists(x) for x in fn(g))], ["wallets", *names])

    found = packed.mapInArrow(go, f"wallets ARRAY<STRING>, {', '.join(f'{c} ARRAY<DOUBLE>' for c in names)}")
    flat = found.select(F.explode(F.arrays_zip("wallets", *names)).alias("r")).select(F.col("r.wallets").alias("wallet"), *[F.col(f"r.{c}") for c in names])
    return flat.groupBy("wallet").agg(*[F.sum(c).alias(c) for c in names])


def row_sums(packed: DataFrame, fn: Callable[[Group], Sequence[float]], names: Sequence[str]) -> DataFrame:
    """``fn`` gives one number per name of a group; one row of their sums."""
    def go(batches):
        total = np.zeros(len(names))
        for g in groups(batches):
            total += np.array(fn(g), dtype=float)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], list(names))

    return packed.mapInArrow(go, ", ".join(f"{c} DOUBLE" for c in names)).agg(*[F.sum(c).alias(c) for c in names])
