"""From raw documents to token ids: five stages, each a call of one training-data operator.

Every stage works on all rows its predecessor kept.  All but the last return the
columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup
from recollect.llm._spark import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, with the language predicted from their text; rejected ones go.

    Texts that are null, empty or without a letter are rejected; so is all where no row has a language to learn from.
    """
    model = language_id.train(docs)
    found = language_id.predict(docs, model, keep=("text", "source", "n_chars"))
    return found.filter(~F.col("rejected")).withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; `n_chars` follows.  A null text becomes an empty one; null ids lose no line."""
    kept = line_dedup.drop_shared_lines(docs, min_chars=40, min_docs=5, keep=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of the smallest id, and of rows with that id the first by text.

    Texts without words are in no class and stay, one row for each id and text; rows without an id come last in their class.
    """
    classes = jaccard_join.jaccard_classes(docs, size=5, percent=80)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    best = classes.filter("class is not null").groupBy("class").agg(first).select("first.doc_id", "first.text_key")
    stay = classes.filter("class is null").select("doc_id", "text_key").union(best).toDF("_id", "_key")
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    kept = keyed.join(stay.distinct(), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text_key"]).select(*COLUMNS)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; a text without words holds none."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), size=10)
    leaks = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    return docs.join(leaks.distinct(), same, "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again as a check; an empty text has no ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_shared_lines),
    ("jaccard_join", keep_one_of_each_class),
    ("decontamination", remove_benchmark_leaks),
    ("byte_bpe", encode),
]

#: Centroid prediction and BPE have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
