"""Registered queries of the document operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.llm import (centroids, exact_dedup, hard_negatives, jaccard_join, language_id, line_dedup, mixing, packing, quality_model,
                           quality_rules, secret_scan, suffix_dedup, token_counts)
from fillwatch.llm.common import bucket_of, documents
from fillwatch.llm.vectors import embeddings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


ORACLES["op5_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)
"""


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("removed")


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", bucket_of(F.col("doc_id"), 5) == 0)
    model = language_id.fit(docs.where("not held_out").select("doc_id", "text", "lang"))
    return docs.select("doc_id", "held_out", language_id.labels(docs, model).alias("label")).select("doc_id", "held_out", "label.*")


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    return secret_scan.scan(documents(spark, sf_dir)).select(
        "doc_id", *[secret_scan.counts(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.span_text(base).cast("binary"), 256).alias("base_sha256"), secret_scan.span_text(spans).alias("spans"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", bucket_of(F.col("doc_id"), 3) == 1)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality_model.fit(docs.where("not held_out").select("doc_id", "text").join(labels, "doc_id"))
    return quality_model.score(docs.select("doc_id", "held_out", "text"), model).drop("text")


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.described(centroids.cluster(embeddings(spark, sf_dir)))


def _clustering_sql(rounds: int = 10, k: int = 8) -> str:
    """The rounds written out: each assigns by exact distances and floors the means."""
    nearest = """SELECT v.r, arg_min(c.c, (d.d, c.c)) AS c, min(d.d) AS d FROM v, {0} c,
      LATERAL (SELECT list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.x, c.x)])::BIGINT AS d) d GROUP BY v.r"""
    parts = ["""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
      [floor(1024 * e::DOUBLE)::BIGINT for e in embedding] AS x, sha256('3:' || vec_id) AS h
    FROM embeddings WHERE len(embedding) = 64 AND len([e for e in embedding if e IS NOT NULL AND isfinite(e)]) = 64)""",
             f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INT AS c, x FROM v ORDER BY h NULLS LAST, x LIMIT {k})"]
    for j in range(rounds):
        parts.append(f"a{j} AS MATERIALIZED ({nearest.format(f'c{j}')})")
        parts.append(f"""m{j} AS MATERIALIZED (SELECT c, list(m ORDER BY i) AS x FROM (SELECT c, i, floor(sum(e)::HUGEINT / count(*))::BIGINT AS m
      FROM (SELECT a.c, unnest(v.x) AS e, generate_subscripts(v.x, 1) AS i FROM a{j} a JOIN v USING (r)) GROUP BY c, i) GROUP BY c)""")
        parts.append(f"c{j + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{j} o LEFT JOIN m{j} m USING (c))")
    parts.append(f"a{rounds} AS MATERIALIZED ({nearest.format(f'c{rounds}')})")
    return ",\n".join(parts) + f"""
SELECT vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.c = a.c"""


ORACLES["op11_centroid_clustering"] = _clustering_sql()


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(embeddings(spark, sf_dir), label=moved, anchors=F.col("vec_id") % 50 == 0)


ORACLES["op12_hard_negatives"] = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * e::DOUBLE) for e in embedding] AS x
           FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len([e for e in embedding if e IS NULL OR NOT isfinite(e)]) = 0),
s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
      FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.r, p.id ORDER BY s.score DESC, s.id) AS rank,
             s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op13_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents),
l AS MATERIALIZED (SELECT r, doc_id, unnest(t) AS line, generate_subscripts(t, 1) AS i FROM d),
k AS MATERIALIZED (SELECT *, translate(regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g'),
                                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY r
"""
