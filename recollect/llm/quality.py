"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model.

`classify` trains the model of `ngram_model.py` on all trusted documents (never on a part
of them) and scores every document by it.  A document is kept if its perplexity is at most
its language's limit: the `quantile` of the perplexities of trusted documents of that
language, each under the half of the model that has not seen it.  Languages without
trusted documents, and rows without language, take the limit of all trusted documents.

Texts that are null or empty have no perplexity and aren't kept.  Without any trusted
document nothing has a perplexity and nothing is kept.  Repeated rows are answered alike;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialize
from .ngram_model import HEAD, ByteModel, score

TRUSTED_SENT = 2_000_000
LIMITS_SENT = 100_000
QUANTILE = 0.99


def marked(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """docs with `trusted`: whether the doc_id is trusted.  The ids are broadcast up to TRUSTED_SENT of them, else joined by a shuffle."""
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).alias("_id")).filter("_id is not null").distinct()
    few = ids.limit(TRUSTED_SENT + 1).count() <= TRUSTED_SENT
    joined = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("_id"), "left")
    return joined.withColumn("trusted", F.col("_id").isNotNull()).drop("_id")


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, limit, keep), one row for each input row."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    source = marked(source.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")), trusted_ids)
    scored = materialize(score(source, ByteModel(source.filter("trusted").select("text", "half")), head))
    known = scored.filter("trusted and perplexity is not null")
    limit = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("limit")
    by_lang = materialize(known.filter("lang is not null").groupBy("lang").agg(limit))
    overall = known.agg(limit).first()["limit"]
    few = by_lang.limit(LIMITS_SENT + 1).count() <= LIMITS_SENT
    joined = scored.join(F.broadcast(by_lang) if few else by_lang, "lang", "left")
    limit = F.coalesce("limit", F.lit(overall).cast("double"))
    return joined.select("doc_id", "lang", "n_bytes", "perplexity", limit.alias("limit"), F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("keep"))
