"""The memory store as DataFrames, derived from the driver's tables by arithmetic on ids.

`memories` columns: id, sk, layer, key, text, embedding, importance, confidence, state,
scope, valid_from, valid_until, source, created_tick, entities.  Scopes, states, clocks
and edges are synthetic and the same in Spark and in the SQL beside each query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import padded, time_key


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _meta(i: Column, tag: Column) -> list[Column]:
    state = F.when(i % 11 == 0, 1).when(i % 13 == 0, 3).when(i % 17 == 0, 4).otherwise(0)
    return [
        ((i * 37 % 101) / 100.0).alias("importance"),
        ((i * 53 % 101) / 100.0).alias("confidence"),
        state.alias("state"),
        F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("tenant/"), tag)).alias("scope"),
        F.when(i % 5 == 0, i * 10).alias("valid_from"),
        F.when(i % 5 == 0, i * 10 + 500).alias("valid_until"),
        (i % 4).cast("int").alias("source"),
        (i + 1).alias("created_tick"),
    ]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4 embedding memories."""
    i = F.col("vec_id")
    tag = F.col("label").cast("string")
    key = F.concat(F.lit("vec/"), padded(i))
    entities = F.array(F.concat(F.lit("label/"), tag), F.concat(F.lit("bucket/"), (i % 7).cast("string")))
    return read(spark, sf_dir, "embeddings").select(
        i.alias("id"), F.concat(F.lit("md/L4/"), key).alias("sk"), F.lit(4).alias("layer"), key.alias("key"), F.concat(F.lit("label "), tag).alias("text"),
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), *_meta(i, tag), entities.alias("entities"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3 text memories."""
    i = F.col("doc_id")
    key = F.concat(F.lit("doc/"), padded(i))
    entities = F.array(F.concat(F.lit("lang/"), "lang"), F.concat(F.lit("src/"), "source"))
    return read(spark, sf_dir, "documents").select(
        i.alias("id"), F.concat(F.lit("md/L3/"), key).alias("sk"), F.lit(3).alias("layer"), key.alias("key"), "text",
        F.lit(None).cast("array<double>").alias("embedding"), *_meta(i, F.col("lang")), entities.alias("entities"),
    )


def companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 texts of the L4 memories."""
    return vectors(spark, sf_dir).withColumns({"sk": F.concat(F.lit("md/L2/"), "key"), "layer": F.lit(2), "embedding": F.lit(None).cast("array<double>")})


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 turns of conversations, keyed by time."""
    ts = F.col("conv_id") * 100 + F.col("turn")
    role = F.when(F.col("role") == "user", "u").when(F.col("role") == "assistant", "a").otherwise("s")
    key = F.concat(time_key(ts), F.lit("/"), role)
    return read(spark, sf_dir, "conversations").select(
        ts.alias("id"), F.concat(F.lit("md/L2/"), key).alias("sk"), F.lit(2).alias("layer"), key.alias("key"), "text",
        F.lit(None).cast("array<double>").alias("embedding"), *_meta(ts, F.col("role")), F.array().cast("array<string>").alias("entities"),
    )


def recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 episodes made of document texts, some of which recur."""
    i = F.col("doc_id")
    key = F.concat(time_key(i), F.lit("/d"))
    return read(spark, sf_dir, "documents").select(
        i.alias("id"), F.concat(F.lit("md/L2/"), key).alias("sk"), F.lit(2).alias("layer"), key.alias("key"), "text",
        F.lit(None).cast("array<double>").alias("embedding"), *_meta(i, F.col("lang")), F.array().cast("array<string>").alias("entities"),
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors, facts, companions and conversation episodes."""
    return vectors(spark, sf_dir).unionByName(facts(spark, sf_dir)).unionByName(companions(spark, sf_dir)).unionByName(episodes(spark, sf_dir))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed directed edges (kind, a, b) between vector memories."""
    ids = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"))
    key = lambda x: F.concat(F.lit("md/L4/vec/"), padded(x))
    causes = ids.filter("i % 4 = 0").select(F.lit("causes").alias("kind"), key(F.col("i")).alias("a"), key(F.col("i") + 1).alias("b"))
    against = ids.filter("i % 9 = 0").select(F.lit("contradicts").alias("kind"), key(F.col("i")).alias("a"), key(F.col("i") + 7).alias("b"))
    return causes.union(against)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vid, parents): version i descends from version i - 10."""
    i = F.col("vec_id")
    name = lambda x: F.concat(F.lit("v"), padded(x))
    return read(spark, sf_dir, "embeddings").select(i.alias("id"), name(i).alias("vid"), F.when(i >= 10, F.array(name(i - 10))).otherwise(F.array().cast("array<string>")).alias("parents"))


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot, seq, op, d_importance, d_confidence) from events."""
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("slot"),
        F.col("event_id").alias("seq"),
        F.when(kind == "click", "reinforce").when(kind.isin("purchase", "error"), "feedback").when(kind == "view", "touch").otherwise("remember").alias("op"),
        F.when(kind == "click", 0.05).when(kind == "purchase", 0.1).when(kind == "error", -0.1).otherwise(0.0).alias("d_importance"),
        F.when(kind == "purchase", 0.1).when(kind == "error", -0.1).otherwise(0.0).alias("d_confidence"),
    )


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sk, layer, local_clock, remote_clock, local_text, remote_text, states) of vector memories held twice; every 23rd is remote only."""
    i, n = F.col("vec_id"), (F.col("vec_id") % 4).cast("int")
    mine = F.create_map(n, i + 10)
    theirs = F.when(i % 7 == 0, F.create_map(n, i + 10 + (i % 5 - 2), ((n + 1) % 4).cast("int"), F.lit(5).cast("long"))).otherwise(F.create_map(n, i + 10 + (i % 5 - 2)))
    layer = (i % 8).cast("int")
    return read(spark, sf_dir, "embeddings").select(
        i.alias("id"), F.concat(F.lit("md/L"), layer.cast("string"), F.lit("/rep/"), padded(i)).alias("sk"), layer.alias("layer"),
        F.when(i % 23 != 0, mine).alias("local_clock"), theirs.alias("remote_clock"),
        F.when(i % 23 != 0, F.concat(F.lit("label "), F.col("label").cast("string"))).alias("local_text"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("remote_text"),
        F.when(i % 23 != 0, F.when(i % 11 == 0, 1).otherwise(0)).alias("local_state"), F.when(i % 6 == 0, 1).otherwise(0).alias("remote_state"),
    )
