"""The registered queries of the subpackage: each applies its operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from piste.functions.core import fround
from piste.llm import (hard_negatives, lengths, licences, mixing, multi_index, ngram_join, order_minhash, pii, quality, quotes, secrets, tiling,
                       whitening)
from piste.llm.common import table

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "links", "copies")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~quality.held_out()))
    scored = docs.select("doc_id", quality.held_out().alias("held_out"), quality.scorer(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.laid_out(mixing.plan(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", "taken", *[fround(c, 6).alias(c) for c in ("position", "again")])


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"), across=True)


def op5_pii_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op6_secret_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.by_limit(lengths.histogram(table(spark, sf_dir, "documents")))


def op8_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_quality_classifier, op3_curriculum_mix, op4_quotation_links, op5_pii_candidates,
    op6_secret_guess_cost, op7_length_histogram, op8_license_windows, op9_string_tiling, op10_order_minhash,
    op11_multi_index, op12_hard_negatives, op13_whitening)}
QUERIES["pipeline"] = corpus_pipeline.run

#: Time at which the demand of a schedule reaches the part ``x`` of its whole, for the three schedules.
_TIMES = """CASE place % 3
  WHEN 0 THEN least(sqrt(greatest(1 + 2 * ({x} * 1.5::DOUBLE), 0)) - 1, 1)
  WHEN 1 THEN least({x}, 1)
  ELSE CASE WHEN {x} * 1.125::DOUBLE < 0.625 THEN least(sqrt(greatest(1 + 2 * ({x} * 1.125::DOUBLE), 0)) - 1, 1)
            ELSE least(0.5::DOUBLE + (sqrt(greatest(2.25 - 4 * ({x} * 1.125::DOUBLE - 0.625), 0)) - 1.5) / -2, 1) END END"""
#: Waterfilling in SQL: sources by size cap over weight; one level up to which the weights share.
_OP3 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
b AS (SELECT *, ('0x' || key[1:8])::BIGINT % 4096 AS bucket FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM b GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place FROM s),
v AS (SELECT *, [5.0, 2.0, 1.0][(place % 3 + 1)::INT]::DOUBLE AS weight FROM w),
r AS (SELECT *, source_size * 2.0::DOUBLE AS top, source_size * 2.0::DOUBLE / weight AS ratio FROM v),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
        - coalesce(sum(top) OVER (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
        row_number() OVER (ORDER BY ratio, source IS NULL, encode(source)) AS rank FROM r),
t AS (SELECT source, source_size, place, least(top, coalesce((SELECT arg_min(level, rank) FROM l WHERE level <= ratio), ratio) * weight)::DOUBLE AS target FROM l),
c AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY bucket, key, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM b),
k AS (SELECT doc_id, size, source_size, target, place, spot, least(size, greatest(floor(target) - spot, 0))::BIGINT AS first,
             least(size, greatest(floor(target) - spot - source_size, 0))::BIGINT AS second
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, first + second AS taken, round(CASE WHEN first > 0 THEN """ + _TIMES.format(x="(spot::DOUBLE / target)") + """ END, 6) AS position,
       round(CASE WHEN second > 0 THEN """ + _TIMES.format(x="((spot + source_size)::DOUBLE / target)") + """ END, 6) AS again
FROM k
"""
#: Every query with all rows; the search measures its margin on up to 256 queries, so it is exact on small tables.
_OP11 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL
           AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.x, c.x) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
_OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda e: floor(e::DOUBLE * 256)) AS x FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND p.place <= 5
       AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
ORACLE: dict[str, str] = {"op3_curriculum_mix": _OP3, "op11_multi_index": _OP11, "op12_hard_negatives": _OP12}
