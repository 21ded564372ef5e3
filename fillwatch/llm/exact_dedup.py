"""Exact de-duplication by composable polynomial fingerprints.

The fingerprint of a byte string b_0..b_(n-1) is the pair of polynomials sum(b_i * B^(n-1-i)) modulo
two primes. Fingerprints of chunks combine by length-shifted arithmetic, H(xy) = H(x) * B^len(y) +
H(y), so a huge text is hashed chunk by chunk and only (position, length, hash) rows meet.
Texts with equal fingerprint and length are then compared with the first of them, chunk by chunk.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwatch.llm.common import SPACE_SQL, map_rows, stored

#: Two primes below 2^31 and a base for each: products of a byte and a power stay below 2^39,
#: so 2^24 of them add up in 64 bits.
LANES = ((2147483647, 1000003), (2147483629, 69621))
CHUNK_BYTES = 1 << 18


@lru_cache(maxsize=8)
def _powers(prime: int, base: int) -> np.ndarray:
    """base^0, base^1, ... for the bytes of one chunk, modulo prime."""
    out = np.ones(CHUNK_BYTES, np.int64)
    have = 1
    while have < len(out):  # B^(i+have) = B^i * B^have
        step = int(out[have - 1]) * base % prime
        take = min(have, len(out) - have)
        out[have:have + take] = out[:take] * step % prime
        have += take
    return out


def chunk_hash(data: bytes, lanes=LANES) -> list[int]:
    """Fingerprint of one chunk, a number for each lane."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)[::-1]
    return [int((b * _powers(p, base)[:len(b)]).sum() % p) for p, base in lanes]


def combine(left: list[int], right: list[int], right_len: int, lanes=LANES) -> list[int]:
    """Fingerprint of a concatenation."""
    return [(x * pow(base, right_len, p) + y) % p for x, y, (p, base) in zip(left, right, lanes)]


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_SQL, " ")


def _slices(data: bytes) -> list[bytes]:
    """Chunks of a text; an empty one has one empty chunk."""
    return [data[k:k + CHUNK_BYTES] for k in range(0, max(len(data), 1), CHUNK_BYTES)]


def fingerprints(df: DataFrame, lanes=LANES) -> DataFrame:
    """``row_id, n_bytes, fp`` of ``df(row_id, text)``; ``fp`` has a number for each lane."""
    def hash_parts(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, at, size, h = [], [], [], []
        for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for k, part in enumerate(_slices(data)):
                ids.append(row)
                at.append(k)
                size.append(len(part))
                h.append(chunk_hash(part, lanes))
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(size, pa.int64()),
                                pa.array(h, pa.list_(pa.int64()))], ["row_id", "chunk", "n", "h"])

    rows = map_rows(df.select("row_id", F.col("text").cast("binary")), hash_parts, "row_id long, chunk int, n long, h array<long>")
    # H(x_1..x_k) folds from the left; the list has one small row for each 256 KiB of the text.
    parts = F.sort_array(F.collect_list(F.struct("chunk", "n", "h")))
    folded = F.aggregate("parts", F.array(*[F.lit(0).cast("long")] * len(lanes)), lambda acc, x: F.array(*[
        F.pmod(F.pmod(acc[k] * _power_mod(x["n"], base, p), F.lit(p)) + x["h"][k], F.lit(p))
        for k, (p, base) in enumerate(lanes)]))
    return rows.groupBy("row_id").agg(F.sum("n").alias("n_bytes"), parts.alias("parts")).select(
        "row_id", "n_bytes", folded.alias("fp"))


def _parts(df: DataFrame) -> DataFrame:
    """``row_id, lead, chunk, part`` of ``df(row_id, lead, text)``."""
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(r, q, k, part) for r, q, t in zip(*[c.to_pylist() for c in batch.columns]) for k, part in enumerate(_slices(t))]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                               ["row_id", "lead", "chunk", "part"])

    return map_rows(df.select("row_id", "lead", F.col("text").cast("binary")), cut, "row_id long, lead long, chunk int, part binary")


def _power_mod(n, base: int, prime: int) -> F.Column:
    """base^n modulo prime by squaring over the bits of n (chunks have less than 2^20 bytes)."""
    squares, x = [], base % prime
    for _ in range(20):
        squares.append(x)
        x = x * x % prime
    return F.aggregate(
        F.transform(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).cast("long").alias("s")) for k, s in enumerate(squares)]),
                    lambda e: F.when(F.getbit(n, e["k"]) == 1, e["s"]).otherwise(F.lit(1).cast("long"))),
        F.lit(1).cast("long"), lambda acc, s: F.pmod(acc * s, F.lit(prime)))


def _led(rows: DataFrame, name: str) -> DataFrame:
    """``rows(row_id, doc_id, n_bytes, fp)`` that share length and fingerprint, each with its group's first row.

    The groups are written first, so that the join deals plain rows and a hot group can be split."""
    groups = stored(rows.groupBy("n_bytes", "fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("first"), F.count(F.lit(1)).alias("m"))
                    .where("m > 1").select("n_bytes", "fp", F.col("first.row_id").alias("lead")), f"{name}-groups")
    return stored(rows.join(groups, ["n_bytes", "fp"]), f"{name}-members")


def judged(docs: DataFrame, *, lanes=LANES) -> DataFrame:
    """``docs`` (all columns) with ``keep_id, group_size, kept, text_sha256``, see ``exact_dedup``."""
    names = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    base = stored(docs.select(*[F.col(c).alias(f"in_{k}") for k, c in enumerate(names)], F.col("doc_id").cast("long").alias("doc_id"),
                              F.monotonically_increasing_id().alias("row_id"),
                              F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256")), "exact-rows")
    texts = base.select("row_id", normalised(F.col(f"in_{names.index('text')}")).alias("text"))
    todo = _led(base.select("row_id", "doc_id").join(fingerprints(texts, lanes), "row_id"), "exact")
    settled = None
    while not todo.isEmpty():
        # What is to be compared grows with the data, so it is never broadcast: one plan at every size.
        parts = stored(_parts(texts.hint("merge").join(todo.select("row_id", "lead"), "row_id")), "exact-parts")
        first = parts.where("row_id = lead").select("lead", "chunk", F.col("part").alias("first"))
        same = parts.where("row_id <> lead").join(first, ["lead", "chunk"], "left").select(
            "row_id", F.coalesce(F.col("part") == F.col("first"), F.lit(False)).alias("same"))
        differs = same.groupBy("row_id").agg(F.bool_and("same").alias("same")).where("not same").select("row_id", F.lit(1).alias("other"))
        seen = stored(todo.join(differs, "row_id", "left"), "exact-compared")
        good = seen.where("other is null").select("row_id", "lead")
        settled = good if settled is None else settled.unionByName(good)
        todo = _led(seen.where("other = 1").select("row_id", "doc_id", "n_bytes", "fp"), "exact")
    if settled is None:
        settled = todo.select("row_id", "lead")
    sizes = settled.groupBy("lead").agg(F.count(F.lit(1)).alias("group_size"))
    heads = stored(sizes.join(base.select(F.col("row_id").alias("lead"), F.col("doc_id").alias("keep_id")), "lead"), "exact-heads")
    places = stored(settled.join(heads, "lead"), "exact-places")
    return base.join(places, "row_id", "left").select(
        *[F.col(f"in_{k}").alias(c) for k, c in enumerate(names)],
        F.when(F.col("lead").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("lead").isNull() | (F.col("lead") == F.col("row_id"))).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, *, lanes=LANES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of blanks, tabs, newlines, vertical tabs, form feeds and
    carriage returns became one space; the row with the smallest ``doc_id`` stays. Null text counts as empty, and empty texts
    are equal to each other. Rows that repeat an id and a text are equal rows: one of them stays. Null ids come after all
    others. An empty table gives an empty result; other columns are not read. Equal fingerprints alone decide nothing:
    rows that differ from the first of their group are grouped again among themselves until none is left.
    """
    return judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lanes=lanes).drop("text")
