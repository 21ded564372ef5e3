"""Lines that many documents share, dropped from every document, by a perfect hash of line hashes.

A line's key is the line without white space at its ends and with A-Z in lower case. Keys are 128-bit cryptographic
hashes. One aggregation counts the documents of each key; keys of two documents or more are indexed by a sharded minimal
perfect hash (``perfect_hash``) whose slots hold fingerprints and counts. A key of one document needs no slot: its
fingerprint is not found. Documents then probe the arrays; lines are never joined. While the arrays are smaller than
``broadcast_bytes`` every task probes them beside the texts. Beyond that, documents send packed hashes to the shards, dealt by
shard and salt, and the hashes that are to go come back as one list per document.

Null texts and empty texts are one empty line, which has no key and stays. Rows are documents: rows that repeat an id or
a whole row count one by one. Null ids are kept. A long text is held by one task while its lines are hashed, as one set of
16 bytes for each distinct line. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwatch.llm import perfect_hash
from fillwatch.llm.common import map_rows, stored
from fillwatch.session import width

BLANK = b" \t\n\x0b\x0c\r"
SHARD_KEYS, BROADCAST_BYTES, SALT_ROWS = 16_384, 32 << 20, 1_000_000
RESULT = "doc_id BIGINT, n_lines BIGINT, n_dropped BIGINT, kept_text STRING"


def key_of(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # bytes: only A-Z have a lower case


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def lanes(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def split_lines(text: bytes) -> tuple[list[bytes], list[bytes | None]]:
    """The lines, and each one's hash, None where it has no key."""
    lines = text.split(b"\n")
    made: dict[bytes, bytes | None] = {b"": None}
    out = []
    for x in lines:
        k = key_of(x)
        if k not in made:
            made[k] = digest(k)
        out.append(made[k])
    return lines, out


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for x in batch.column(column).cast(pa.large_binary()):
        yield x.as_py() or b""


def line_counts(docs: DataFrame) -> DataFrame:
    """``low, high, n``: the hashes of all keys and the documents of each."""
    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[bytes] = []
        for text in _texts(batch, 0):
            found += {h for h in split_lines(text)[1] if h}
        low, high = lanes(found)
        return pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(high.view(np.int64))], ["low", "high"])

    rows = map_rows(docs.select(F.col("text").cast("string").alias("text")), hashes, "low BIGINT, high BIGINT")
    return rows.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"))


def build_index(counts: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, int]:
    """The shards ``shard, seed, pilots, prints, counts`` (a stored table), how many there can be, and their bytes."""
    counts = stored(counts, "line-counts")
    shards = max(1, -(-counts.count() // shard_keys))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        low = batch.column(0).to_numpy().view(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(perfect_hash.shard_of(low, shards)), *batch.columns], ["shard", "low", "high", "n"])

    def solve(table: pa.Table) -> pa.Table:
        low, high, n = (table.column(c).to_numpy() for c in ("low", "high", "n"))
        seed, *arrays = perfect_hash.build(low.view(np.uint64), high.view(np.uint64), n)
        return pa.table({"shard": [table.column("shard")[0].as_py()], "seed": [seed],
                         **dict(zip(("pilots", "prints", "counts"), ([a.tobytes()] for a in arrays)))})

    placed = map_rows(counts, place, "shard BIGINT, low BIGINT, high BIGINT, n BIGINT")
    table = stored(placed.groupBy("shard").applyInArrow(solve, "shard BIGINT, seed BIGINT, pilots BINARY, prints BINARY, counts BINARY"),
                   "line-index")
    size = table.agg(F.sum(F.length("pilots") + F.length("prints") + F.length("counts"))).first()[0]
    return table, shards, size or 0


def _joined(lines: list[bytes], gone: list[bool]) -> tuple[int, int, bytes]:
    return len(lines), sum(gone), b"\n".join([x for x, g in zip(lines, gone) if not g])


def _result(ids: pa.Array, made: list[tuple[int, int, bytes]]) -> pa.Table:
    n, dropped, text = (list(x) for x in zip(*made))
    return pa.table({"doc_id": ids, "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()),
                     "kept_text": pa.array(text, pa.large_binary()).cast(pa.large_string()).cast(pa.string())})


def _probe_beside(docs: DataFrame, parts: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """Every task holds all arrays (the caller has checked their size)."""
    held = docs.sparkSession.sparkContext.broadcast([tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in parts.collect()])
    built: list[perfect_hash.Index] = []

    def probe(batch: pa.RecordBatch) -> pa.Table:
        if not built:
            built.append(perfect_hash.Index(shards, held.value))
        split = [split_lines(t) for t in _texts(batch, 1)]
        flat = list({h for _, hs in split for h in hs if h})
        often = {h for h, n in zip(flat, built[0].count(*lanes(flat))) if n >= min_docs} if flat else set()
        return _result(batch.column(0), [_joined(ls, [h in often for h in hs]) for ls, hs in split])

    return map_rows(docs, probe, RESULT)


def _probe_by_shard(docs: DataFrame, parts: DataFrame, shards: int, min_docs: int, salt_rows: int) -> DataFrame:
    """Documents send packed hashes to the shards; a document is known by its id and the hash of its text."""
    keyed = docs.withColumn("t", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    salts = max(1, -(-docs.count() // salt_rows))

    def send(batch: pa.RecordBatch) -> pa.Table:
        ids, marks, where, packed = [], [], [], []
        for d, t, mark in zip(batch.column(0).to_pylist(), _texts(batch, 1), batch.column(2).to_pylist()):
            found = list({h for h in split_lines(t)[1] if h})
            if found:
                shard = perfect_hash.shard_of(lanes(found)[0], shards)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order])) + 1
                for group in np.split(order, cuts):
                    ids.append(d)
                    marks.append(mark)
                    where.append(int(shard[group[0]]))
                    packed.append(b"".join([found[k] for k in group]))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "t": pa.array(marks, pa.string()), "shard": pa.array(where, pa.int64()),
                         "packed": pa.array(packed, pa.binary())})

    probes = map_rows(keyed.select("doc_id", "text", "t"), send, "doc_id BIGINT, t STRING, shard BIGINT, packed BINARY") \
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "t"), F.lit(salts)))
    arrays = parts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    both = arrays.select("shard", "salt", F.lit(0).alias("kind"), "seed", "pilots", "prints", "counts", *[
        F.lit(None).cast(c).alias(n) for n, c in (("doc_id", "long"), ("t", "string"), ("packed", "binary"))]).unionByName(
        probes.select("shard", "salt", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seed"), *[
            F.lit(None).cast("binary").alias(c) for c in ("pilots", "prints", "counts")], "doc_id", "t", "packed"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held = None, None
        for batch in batches:
            ids, marks, hits = [], [], []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    index, held = perfect_hash.Index(shards, [tuple(r[c] for c in ("shard", "seed", "pilots", "prints", "counts"))]), r["shard"]
                    continue
                if r["shard"] != held:  # no key of this shard is in two documents
                    continue
                found = [r["packed"][k:k + 16] for k in range(0, len(r["packed"]), 16)]
                often = [h for h, n in zip(found, index.count(*lanes(found))) if n >= min_docs]
                if often:
                    ids.append(r["doc_id"])
                    marks.append(r["t"])
                    hits.append(b"".join(often))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.string()), pa.array(hits, pa.binary())], ["doc_id", "t", "hits"])

    answers = both.repartition(width(docs), "shard", "salt").sortWithinPartitions("shard", "salt", "kind") \
                  .mapInArrow(look_up, "doc_id BIGINT, t STRING, hits BINARY")
    gone = answers.groupBy(F.col("doc_id").alias("d"), F.col("t").alias("u")).agg(F.collect_set("hits").alias("hits"))

    def drop(batch: pa.RecordBatch) -> pa.Table:
        made = []
        for text, hits in zip(_texts(batch, 1), batch.column(2).to_pylist()):
            often = {h[k:k + 16] for h in hits or () for k in range(0, len(h), 16)}
            lines, hs = split_lines(text)
            made.append(_joined(lines, [h in often for h in hs]))
        return _result(batch.column(0), made)

    fed = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")), "left").select("doc_id", "text", "hits")
    return map_rows(fed, drop, RESULT)


def drop_lines(docs: DataFrame, min_docs: int = 10, *, shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES,
               salt_rows: int = SALT_ROWS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text``: all lines whose key at least ``min_docs`` documents have are gone."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts, shards, size = build_index(line_counts(slim).where("n >= 2"), shard_keys)
    if size <= broadcast_bytes:
        return _probe_beside(slim, parts, shards, min_docs)
    return _probe_by_shard(slim, parts, shards, min_docs, salt_rows)
