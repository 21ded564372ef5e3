"""Token counts of whole texts by the whole-token shortcut (see ``bpe``)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwatch.llm.bpe import token_counter
from fillwatch.llm.common import map_rows


def count_tokens(docs: DataFrame, tokenizer: str, *, text: str = "text", limit: int = 512) -> DataFrame:
    """``docs.doc_id`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library; the counts are
    the library's own, without special tokens, truncation or padding. Map-only: no shuffle.

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids stay as they are, an
    empty table gives an empty result, other columns are not read. The size of a text is bounded
    by the worker's memory only.
    """
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        count_one = token_counter(tokenizer).count
        return pa.record_batch([batch.column(0), pa.array([count_one(t or "") for t in batch.column(1).to_pylist()], pa.int64()),
                                batch.column(2)], ["doc_id", "n_tokens", "n_bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    out = map_rows(rows, count, "doc_id long, n_tokens long, n_bytes long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
