"""Shared helpers of the document operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.session import prepare, stored  # noqa: F401

#: A word, and the six characters that end one, in Python's and in Spark's pattern language.
WORD = r"[^ \t-\r]+"
WORD_SQL = r"[^\x20\x09-\x0D]+"
SPACE_SQL = r"[\x20\x09-\x0D]+"
find_words = re.compile(WORD).findall


def open_session(spark: SparkSession) -> None:
    """Ship the package, keep Arrow batches small enough for a worker that holds long texts, and let the files of a shuffle go at
    the end of its query: operators go on from stored tables."""
    prepare(spark)
    if spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") != "true":
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "1000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_session(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def in_slices(batch: pa.RecordBatch, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most about ``max_bytes``; a row that is larger comes alone."""
    at, n = 0, batch.num_rows
    while at < n:
        size = n - at
        while size > 1 and batch.slice(at, size).nbytes > max_bytes:
            size = (size + 1) // 2
        yield batch.slice(at, size)
        at += size


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str, max_bytes: int | None = None) -> DataFrame:
    """Apply ``fn`` to each Arrow batch, or to slices of it of at most about ``max_bytes``; a batch without rows gives none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, max_bytes or 1 << 62):
                out = fn(part)
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                else:
                    yield out

    return df.mapInArrow(run, schema)


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all but the ``used`` columns under names that no operator has, and the way back to the old names."""
    names = [c if c in used else f"carried_{k}" for k, c in enumerate(docs.columns)]
    quoted = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*[c.alias(n) for c, n in zip(quoted, names)]), lambda df: df.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


class Scratch:
    """Tables written to the shared scratch folder that go as soon as their last reader is done."""

    def __init__(self) -> None:
        self.folders: set[str] = set()

    def store(self, df: DataFrame, name: str) -> DataFrame:
        return self.own(stored(df, name))

    def own(self, table: DataFrame) -> DataFrame:
        """``table``, just written to a folder of its own, which ``drop`` may delete."""
        self.folders |= _folders(table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of ``tables`` that were stored here; nothing that reads them may run afterwards."""
        for table in tables:
            spark = table.sparkSession
            for folder in _folders(table) & self.folders:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
                self.folders.discard(folder)


def _folders(table: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in table.inputFiles()}


def bucket_of(col: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``: the split rule of the labelled tasks."""
    return F.crc32(col.cast("string").cast("binary")) % modulus


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns only, so reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))
