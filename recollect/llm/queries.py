"""Registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_topk, jaccard_join, language_id, line_dedup, quality, sharding, surrogates, toxicity
from ._spark import table

RANKS = "byte_bpe_multi_50k.tiktoken"
SURROGATE_KEY = "registered-query"  # a deployment passes a secret of its own


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality.classify(table(spark, sf_dir, "documents"), trusted)


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = language_id.fold("doc_id", 5) == 0
    scored = toxicity.score(docs, toxicity.train(docs, labels.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.drop_shared_lines(docs, min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.fold("doc_id", 4) == 2
    model = language_id.train(docs.filter(~held_out))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=24)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"), size=5, percent=80)
    return classes.select("doc_id", "n_shingles", "component_id")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return decontaminate.digest(found)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_surrogates": op2_surrogates,
        "op3_toxicity": op3_toxicity,
        "op4_line_dedup": op4_line_dedup,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_language_id": op6_language_id,
        "op7_sharding": op7_sharding,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_exact_topk": op9_exact_topk,
        "op10_decontamination": op10_decontamination,
    }


#: Margin characters of a line, for SQL.
_MARGIN = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4_SQL = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, pos, parts[pos] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM docs)),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, {_MARGIN}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.doc_id, pos, line, common.k IS NOT NULL AND keyed.doc_id < last AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP9_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1]::HUGEINT * p[2]))::BIGINT AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def _lowered(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


OP10_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_lowered("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all({_lowered("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS size, list_slice(ws, s, s + least(10, len(ws)) - 1) AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
grams AS (
  SELECT doc_id, size, s, list_slice(ws, s, s + size - 1) AS g
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS s FROM w, sizes WHERE len(ws) >= size)),
occ AS (SELECT doc_id, item_id, s, grams.size FROM grams JOIN win USING (size, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM occ) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op9_exact_topk": OP9_SQL, "op10_decontamination": OP10_SQL}
