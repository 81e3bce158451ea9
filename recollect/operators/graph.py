"""Typed relations, version lineage and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["related_to", "causes", "supports", "contradicts", "derived_from", "supersedes"]


def outgoing(edges: DataFrame, key: str, kind: str) -> DataFrame:
    return edges.filter((F.col("a") == key) & (F.col("kind") == kind)).select("b").orderBy("b")


def related_to(edges: DataFrame, key: str) -> DataFrame:
    """All neighbours in both directions, by kind and target; duplicates stay."""
    out = edges.filter(F.col("a") == key).select("kind", F.col("b").alias("target"))
    back = edges.filter(F.col("b") == key).select("kind", F.col("a").alias("target"))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return out.unionByName(back).withColumn("place", place).orderBy("place", "target").select("kind", "target")


def associate(edges: DataFrame, new: DataFrame, memories: DataFrame | None = None) -> DataFrame:
    """Edges with new ones; with memories given, both ends must exist."""
    if memories is not None:
        keys = memories.select("sk")
        new = new.join(keys.withColumnRenamed("sk", "a"), "a", "left_semi").join(keys.withColumnRenamed("sk", "b"), "b", "left_semi")
    return edges.unionByName(new.select("kind", "a", "b")).dropDuplicates(["kind", "a", "b"])


def refused(new: DataFrame) -> DataFrame:
    """(kind, a, b, why) of edges that may not be written: an end with `#` or without a name, or an unknown kind."""
    k = F.when(~F.col("kind").isin(KINDS), "kind").when(F.col("a").contains("#") | F.col("b").contains("#"), "hash").when((F.col("a") == "") | (F.col("b") == ""), "empty")
    return new.select("kind", "a", "b", k.alias("why")).filter("why is not null")


def remove_key(edges: DataFrame, key: str) -> DataFrame:
    return edges.filter((F.col("a") != key) & (F.col("b") != key))


def lineage(versions: DataFrame, vid: str, most: int = 100_000) -> DataFrame:
    """(depth, vid): the chain of last parents, as a recursive query that stops where a version comes again."""
    last = versions.select("vid", F.when(F.size("parents") > 0, F.element_at("parents", -1)).alias("parent"))
    return versions.sparkSession.sql(
        f"""
        WITH RECURSIVE chain(depth, vid, parent, path) MAX RECURSION LEVEL {int(most)} AS (
          SELECT 0, vid, parent, array(vid) FROM {{versions}} WHERE vid = :start
          UNION ALL
          SELECT depth + 1, v.vid, v.parent, array_append(path, v.vid) FROM chain JOIN {{versions}} v ON v.vid = chain.parent WHERE NOT array_contains(path, v.vid))
        SELECT depth, vid FROM chain""",
        args={"start": vid},
        versions=last,
    )


def children(versions: DataFrame) -> DataFrame:
    """(vid, children sorted) of versions that have any."""
    edges = versions.select(F.explode("parents").alias("vid_"), F.col("vid").alias("child"))
    return edges.groupBy(F.col("vid_").alias("vid")).agg(F.array_sort(F.collect_list("child")).alias("children"))


def explain(memories: DataFrame, versions: DataFrame) -> DataFrame:
    """One structured row per memory: meta, validity, parents and children of its version."""
    joined = memories.join(versions, "id").join(children(versions), "vid", "left")
    none = F.array().cast("array<string>")
    return joined.select("sk", "vid", "importance", "state", "valid_from", "valid_until", "parents", F.coalesce("children", none).alias("children"))


def gather_evidence(hits: DataFrame, entity_hits: DataFrame, edges: DataFrame, least_importance: float = 0.5) -> DataFrame:
    """(sk, path): semantic hits, entity hits, and what contradicts the important entity hits."""
    strong = entity_hits.filter(F.col("importance") >= least_importance).select(F.col("sk").alias("a"))
    against = edges.filter("kind = 'contradicts'").join(strong, "a", "left_semi").select(F.col("b").alias("sk"), F.lit("contradicts").alias("path"))
    return hits.select("sk", F.lit("semantic").alias("path")).union(entity_hits.select("sk", F.lit("entities").alias("path"))).union(against)


def reflect(edges: DataFrame, lesson: str, evidence: DataFrame, opposing: DataFrame) -> DataFrame:
    """Edges that ground a lesson in its evidence and note what opposes it."""
    down = evidence.select(F.lit("derived_from").alias("kind"), F.lit(lesson).alias("a"), F.col("sk").alias("b"))
    up = evidence.select(F.lit("supports").alias("kind"), F.col("sk").alias("a"), F.lit(lesson).alias("b"))
    against = opposing.select(F.lit("contradicts").alias("kind"), F.col("sk").alias("a"), F.lit(lesson).alias("b"))
    return associate(edges, down.union(up).union(against))


def add_parents(versions: DataFrame, more: DataFrame) -> DataFrame:
    """Versions with further parents (vid, parents) behind those they have, each once."""
    joined = versions.join(more.select("vid", F.col("parents").alias("_more")), "vid", "left")
    return joined.withColumn("parents", F.array_distinct(F.concat("parents", F.coalesce("_more", F.array().cast("array<string>"))))).drop("_more")


def entity_index(memories: DataFrame) -> DataFrame:
    """(entity, sk) of all named entities; empty names are left out."""
    return memories.select(F.explode("entities").alias("entity"), "sk").filter("entity <> ''").distinct()
