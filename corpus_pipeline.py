"""A training corpus from raw documents: language, copies, near copies, mixture, packed sequences.

Each stage takes (spark, docs, sf_dir), reads all its predecessor kept, and is written as Parquet. Other columns than the text
and what a stage works on are carried under neutral names, so no column of the input can clash with a stage's own. All stages
take an empty table to an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from fillwatch.llm.common import aside, bucket_of, open_session, stored

SHINGLE_WORDS, SIMILARITY = 5, 80  # near copies: five-word shingles of which the union shares 80 % or more
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without a letter. A text in several languages stays. Where no row
    of the training split has a language, every text with a letter stays. Repeated rows and null ids stay or go by their texts."""
    open_session(spark)
    model = language_id.fit(docs.where(bucket_of(F.col("doc_id"), 5) != 0).select("doc_id", "text", "lang"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(language_id.labels(docs, model)["lang_pred"] != language_id.UNDETERMINED)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts stays, the one with the smallest id; null ids come last."""
    open_session(spark)
    plain, back = aside(docs, "doc_id", "text")
    return back(exact_dedup.judged(plain).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the smallest id (of one id's texts, the one with the smallest hash).
    Rows with a null id and texts without words take no part and stay."""
    open_session(spark)
    found = stored(jaccard_join.jaccard_components(docs, percent=SIMILARITY, width=SHINGLE_WORDS).where("doc_id is not null and n_shingles > 0"), "near-copies")
    row = F.struct("doc_id", "text_hash")
    first = found.groupBy("component_id").agg(F.min(row).alias("first"))
    gone = found.join(first, "component_id").where(row != F.col("first")).select(F.col("doc_id").alias("gone_id"), "text_hash").distinct()
    plain, back = aside(docs, "doc_id", "text")
    here = (F.col("doc_id").cast("long") == F.col("gone_id")) & (F.xxhash64("text") == F.col("text_hash"))
    return back(plain.join(gone, here, "left_anti"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their target weights; a document that the mix takes twice comes twice. See ``mixing.mix_sources`` for odd rows."""
    open_session(spark)
    plain, back = aside(docs, "doc_id", "text", "source")
    sized = stored(plain.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                                mixing.word_count().alias("size")), "mix-sizes")
    return back(mixing.mixed_rows(mixing.mix(plain, mixing.mixing_plan(sized))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    open_session(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", identify_language), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies),
          ("mix_sources", mix_sources), ("best_fit_packing", pack_sequences)]

#: Language identification and the hashed choices of the mix have no SQL form; tests compare the stages with plain versions one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_session(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
