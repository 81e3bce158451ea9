"""Decay, consolidation, expiry and the lifecycle tick."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.hashes import fnv1a_hex


def decay(memories: DataFrame, now: int, e_folding: float, floor: float = 0.05, decayed_at: float = 0.05, with_confidence: bool = False) -> DataFrame:
    """Active L3-L5 memories after decay towards `floor`, by the time since they were last reinforced, or made; `changed` tells which moved by more than 1e-7 or decayed.  A time of 0 changes nothing."""
    reinforced = F.col("last_reinforced") if "last_reinforced" in memories.columns else F.lit(0).cast("long")
    last = F.when(F.coalesce(reinforced, F.lit(0)) != 0, reinforced).otherwise(F.col("created_tick"))
    f = F.exp(-F.greatest(F.lit(now) - last, F.lit(0)) / float(e_folding)) if e_folding else F.lit(1.0)
    value = S.clamp(F.least(F.col("importance"), floor + (F.col("importance") - floor) * f)) if e_folding else F.col("importance")
    pool = memories.filter((F.col("state") == 0) & F.col("layer").between(3, 5)).withColumn("new_importance", value)
    pool = pool.withColumn("new_confidence", S.clamp(F.col("confidence") * f) if with_confidence else F.col("confidence"))
    gone = (F.col("new_importance") <= decayed_at) & F.lit(bool(e_folding))
    moved = (F.abs(F.col("new_importance") - F.col("importance")) > 1e-7) | (F.abs(F.col("new_confidence") - F.col("confidence")) > 1e-7)
    return pool.withColumns({"new_state": F.when(gone, 4).otherwise(0), "changed": moved | gone})


def consolidate(episodes: DataFrame, min_repeats: int = 3, min_bytes: int = 8, most_new: int = 100, known: DataFrame | None = None) -> DataFrame:
    """(norm, n, text, first_sk, parents, key, new) of recurring timed L2 texts, in the order of the normal form.

    The text is that of the first episode.  A group whose fact (key, text) is `known` already
    is not new; groups after the `most_new`-th new one wait for the next run.
    """
    timed = episodes.filter((F.col("layer") == 2) & F.col("sk").contains("/ts/")).withColumn("norm", S.normalized(F.col("text"))).filter("norm <> ''")
    groups = timed.groupBy("norm").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("text", "sk").alias("text"), F.min("sk").alias("first_sk"), F.array_sort(F.collect_set("created_tick")).alias("parents")
    )
    groups = consolidated_keys(groups.filter((F.col("n") >= min_repeats) & (F.octet_length("text") >= min_bytes)))
    if known is None:
        groups = groups.withColumn("new", F.lit(True))
    else:
        groups = groups.join(known.select("key", F.col("text").alias("_was")), "key", "left").withColumn("new", ~F.col("_was").eqNullSafe(F.col("text"))).drop("_was")
    last = groups.filter("new").select("norm").orderBy("norm").limit(most_new).agg(F.max("norm").alias("last"), F.count(F.lit(1)).alias("made"))
    ready = groups.join(F.broadcast(last)).filter((F.col("made") < most_new) | (F.col("norm") <= F.col("last")))  # one row
    return ready.select("norm", "n", "text", "first_sk", "parents", "key", "new").orderBy("norm")


def consolidated_keys(groups: DataFrame) -> DataFrame:
    return groups.withColumn("key", F.concat(F.lit("consolidated/"), fnv1a_hex(F.col("norm").cast("binary"))))


def consolidated_edges(groups: DataFrame) -> DataFrame:
    """(kind, a, b): each consolidated fact is derived from its first episode."""
    return groups.select(F.lit("derived_from").alias("kind"), F.concat(F.lit("md/L3/"), "key").alias("a"), F.col("first_sk").alias("b"))


def reembed(memories: DataFrame, embed, source: int = 2) -> DataFrame:
    """(sk, key, text, embedding, status) of L4 memories embedded anew from their companion texts; without a text they keep their vector and are `missing`."""
    texts = memories.filter((F.col("layer") == source) & (F.length("text") > 0)).select("key", F.col("text").alias("companion"))
    joined = memories.filter("layer = 4").select("sk", "key", F.col("embedding").alias("old")).join(texts, "key", "left")
    made = F.when(F.col("companion").isNotNull(), embed(F.col("companion")).cast("array<double>")).otherwise(F.col("old"))
    return joined.select("sk", "key", F.col("companion").alias("text"), made.alias("embedding"), F.when(F.col("companion").isNull(), "missing").otherwise("migrated").alias("status"))


def backfill(memories: DataFrame, embed) -> DataFrame:
    """(sk, layer, text, embedding): an L4 vector and its L2 companion for each L3 text that has no L4 memory of its key yet."""
    done = memories.filter("layer = 4").select("key")
    left = memories.filter("layer = 3 and length(text) > 0").select("key", "text").join(done, "key", "left_anti").withColumn("v", embed(F.col("text")).cast("array<double>"))
    none = F.lit(None).cast("array<double>")
    row = lambda layer, v: F.struct(F.concat(F.lit(f"md/L{layer}/"), "key").alias("sk"), F.lit(layer).alias("layer"), F.col("text").alias("text"), v.alias("embedding"))
    return left.select(F.explode(F.array(row(4, F.col("v")), row(2, none))).alias("r")).select("r.*")


def maintain(memories: DataFrame, now: int, e_folding: float, episodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The memories after one round of upkeep, and (step, n): what each step did, in the order expire, decay, consolidate, checkpoint."""
    ended = expire(memories, now).select("sk", "new_state")
    rows = memories.join(ended, "sk", "left").withColumn("state", F.coalesce("new_state", "state")).drop("new_state")
    faded = decay(rows, now, e_folding).filter("changed").select("sk", "new_importance", "new_state")
    rows = rows.join(faded, "sk", "left").withColumns({"importance": F.coalesce("new_importance", "importance"), "state": F.when(F.col("new_state") == 4, 4).otherwise(F.col("state"))}).drop("new_importance", "new_state")
    facts = consolidate(memories if episodes is None else episodes)
    count = lambda df, step: df.agg(F.lit(step).alias("step"), F.count(F.lit(1)).alias("n"))
    steps = [count(ended, "expire"), count(faded, "decay"), count(facts.filter("new"), "consolidate"), count(rows.filter("layer in (0, 1)"), "checkpoint")]
    out = steps[0]
    for s in steps[1:]:
        out = out.union(s)
    return rows, out


def expire(memories: DataFrame, now: int) -> DataFrame:
    """Memories whose window has ended and that become Invalidated."""
    return memories.filter((F.col("valid_until") <= now) & ~F.col("state").isin(2, 3, 4)).withColumn("new_state", F.lit(3))


# Source and target layer, least importance, least age, state of the source afterwards.
PROMOTIONS = [(1, 2, 0.0, 1, 2), (2, 3, 0.5, 2, 2), (3, 4, 0.8, 3, 1)]


def promote(memories: DataFrame, source: int, target: int, least: float, age: int, left_as: int, now: int) -> DataFrame:
    """Memories after one promotion stage: sources in their new state, copies with the target layer's importance."""
    ready = (F.col("layer") == source) & (F.col("state") == 0) & (F.col("importance") >= least) & (F.lit(now) - F.col("created_tick") >= age)
    copies = memories.filter(ready).withColumns({
        "layer": F.lit(target), "sk": F.concat(F.lit(f"md/L{target}/"), "key"), "importance": F.lit(S.LAYER_IMPORTANCE[target]), "created_tick": F.lit(now).cast("long"),
    })
    changed = memories.withColumn("state", F.when(ready, left_as).otherwise(F.col("state")))
    return changed.join(copies.select("sk"), "sk", "left_anti").unionByName(copies)


def lifecycle_tick(memories: DataFrame, now: int, rate: float = 0.01, archive_after: int = 1000) -> DataFrame:
    """Promotions in turn, each seeing what the one before made; then decay per tick; then old Superseded are archived."""
    rows = memories.select("sk", "key", "layer", "importance", "state", "created_tick")
    for source, target, least, age, left_as in PROMOTIONS:
        rows = promote(rows, source, target, least, age, left_as, now)
    rows = rows.withColumn("importance", F.when(F.col("state") == 0, F.col("importance") * (1 - rate)).otherwise(F.col("importance")))
    old = (F.col("state") == 1) & (F.lit(now) - F.col("created_tick") >= archive_after)
    return rows.withColumn("state", F.when(old, 2).otherwise(F.col("state")))
