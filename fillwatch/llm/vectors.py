"""Embedding rows as whole-number vectors, and blocks of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.llm.common import open_session


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_session(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")


def usable(vec: Column) -> Column:
    """Neither null nor with a null, infinite or undefined component."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def whole(vec: Column, scale: int, bits: int) -> Column:
    """floor(scale * x) of each component; beyond 2^bits the nearest number within, so that sums of squares stay exact."""
    top = F.lit(float(1 << bits))
    return F.transform(vec, lambda x: F.floor(F.least(F.greatest(F.floor(x.cast("double") * F.lit(float(scale))).cast("double"), -top), top)).cast("int"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """int64 rows of a list column whose lists all have ``dims`` items."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
