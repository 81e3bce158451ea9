"""Lexical search: log-tf times idf over tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .recall import visible


def postings(memories: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(sk, term, tf); of the given terms only, if any are given."""
    rows = memories.select("sk", F.explode(S.tokens(F.col("text"))).alias("term"))
    if terms is not None:
        rows = rows.filter(F.col("term").isin(terms))
    return rows.groupBy("sk", "term").agg(F.count(F.lit(1)).alias("tf"))


def index_stats(memories: DataFrame) -> DataFrame:
    """(term, df, total) of the inverted index."""
    return postings(memories).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def search(memories: DataFrame, terms: list[str], k: int) -> DataFrame:
    """(sk, score, matched) of the k best; score is the sum of (1 + ln tf) * (ln((N+1)/(df+1)) + 1)."""
    terms = sorted(set(terms))
    found = postings(memories, terms)
    n = memories.filter(F.size(S.tokens(F.col("text"))) > 0).agg(F.count(F.lit(1)).alias("n"))
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))  # a row per query term, one count
    idf: Column = F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1
    scores = found.join(F.broadcast(df), "term").groupBy("sk").agg(F.sum((1 + F.log("tf")) * idf).alias("score"), F.array_sort(F.collect_set("term")).alias("matched"))
    return scores.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "sk").limit(max(k, 1))


def recall_lexical(memories: DataFrame, terms: list[str], k: int, scope: str | None = None, historical: bool = False) -> DataFrame:
    """The k best, then those that may be seen; `dist` is relative to the best score before that filter."""
    best = search(memories, terms, k)
    top = best.agg(F.max("score").alias("top"))
    hits = best.crossJoin(F.broadcast(top)).join(memories.drop("score"), "sk")
    return visible(hits, scope, historical).withColumn("dist", S.clamp(1 - F.col("score") / F.col("top"))).orderBy(F.desc("score"), "sk")


def search_fast(memories: DataFrame, terms: list[str], k: int) -> DataFrame:
    """`search` without the matched terms."""
    return search(memories, terms, k).select("sk", "score")


def upsert(index: DataFrame, changed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Postings (sk, term, tf) after memories changed or went; a text without tokens leaves none."""
    gone = changed.select("sk") if removed is None else changed.select("sk").union(removed.select("sk"))
    return index.join(gone.distinct(), "sk", "left_anti").unionByName(postings(changed))


def with_primary(hits: DataFrame, memories: DataFrame) -> DataFrame:
    """Hits (sk, text) with `rel`, the L4, L5 or L3 memory that a companion (L2) belongs to, and `payload_type`, its type or else the hit's own."""
    place = F.when(F.col("layer") == 4, 0).when(F.col("layer") == 5, 1).otherwise(2)
    kind = S.content_type(F.col("text"), F.when(F.col("embedding").isNotNull(), F.size("embedding")))
    owners = memories.filter(F.col("layer").isin(3, 4, 5)).select("key", F.struct(place.alias("place"), F.col("sk").alias("rel"), kind.alias("kind")).alias("o"))
    owners = owners.groupBy("key").agg(F.min("o").alias("o"))
    joined = hits.withColumn("key", F.when(F.col("sk").startswith("md/L2/"), F.substring("sk", 7, 4096))).join(owners, "key", "left")
    return joined.withColumns({"rel": F.col("o.rel"), "payload_type": F.coalesce("o.kind", S.content_type(F.col("text")))}).drop("key", "o")
