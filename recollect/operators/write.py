"""Writes as functions from rows to rows; nothing here stores anything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.hashes import memory_id


def remember_episodic(turns: DataFrame) -> DataFrame:
    """(sk, text): two L2 texts for each (ts, user, reply)."""
    base = F.concat(F.lit("md/L2/"), S.time_key(F.col("ts")))
    rows = F.array(F.struct(F.concat(base, F.lit("/u")).alias("sk"), F.col("user").alias("text")), F.struct(F.concat(base, F.lit("/a")).alias("sk"), F.col("reply").alias("text")))
    return turns.select(F.explode(rows).alias("r")).select("r.sk", "r.text")


def remember_exchange(turns: DataFrame) -> DataFrame:
    """(sk, text): the last user turn (L1) and the last reply (L2)."""
    last = turns.agg(F.max_by("user", "ts").alias("user"), F.max_by("reply", "ts").alias("reply"))
    rows = F.array(F.struct(F.lit("md/L1/last_user").alias("sk"), F.col("user").alias("text")), F.struct(F.lit("md/L2/last_asst").alias("sk"), F.col("reply").alias("text")))
    return last.select(F.explode(rows).alias("r")).select("r.sk", "r.text")


def remember_exchange_full(turns: DataFrame) -> DataFrame:
    """(sk, layer, text, embedding) of all that (ts, user, reply, user_embedding, reply_embedding) turns leave: timed L2 texts, timed L4 vectors, and the last turn under its fixed keys."""
    none = F.lit(None).cast("array<double>")
    row = lambda layer, key, text, v: F.struct(F.concat(F.lit(f"md/L{layer}/"), key).alias("sk"), F.lit(layer).alias("layer"), F.col(text).alias("text"), (none if v is None else F.col(v).cast("array<double>")).alias("embedding"))
    base = S.time_key(F.col("ts"))
    sides = [("/u", "user", "user_embedding"), ("/a", "reply", "reply_embedding")]
    timed = F.array(*[row(layer, F.concat(base, F.lit(end)), text, v if layer == 4 else None) for end, text, v in sides for layer in (2, 4)])
    last = remember_exchange(turns).select("sk", F.substring("sk", 5, 1).cast("int").alias("layer"), "text", none.alias("embedding"))
    return turns.select(F.explode(timed).alias("r")).select("r.*").unionByName(last)


def remember_fact(rows: DataFrame) -> DataFrame:
    """(sk, text): an L3 text under the time it was learned, for each (ts, text)."""
    return rows.select(F.concat(F.lit("md/L3/"), S.time_key(F.col("ts"))).alias("sk"), "text")


def ensure_meta(docs: DataFrame, meta: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sk, importance, confidence, created_tick, made) of wanted memories, with a layer's own values where no metadata are kept; a key without a memory raises an error."""
    joined = wanted.select("sk").distinct().join(docs.select("sk", "layer"), "sk", "left").join(meta.select("sk", "importance", "confidence", "created_tick"), "sk", "left")
    by_layer = F.create_map(*[F.lit(x) for kv in S.LAYER_IMPORTANCE.items() for x in kv])[F.col("layer")]
    held = F.when(F.col("layer").isNull(), F.raise_error(F.concat(F.lit("no memory at "), "sk"))).otherwise(F.col("sk"))
    made = F.col("created_tick").isNull()
    return joined.select(held.alias("sk"), F.coalesce("importance", by_layer).alias("importance"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("created_tick", F.lit(0).cast("long")).alias("created_tick"), made.alias("made"))


def set_entities(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """Memories with the entity lists of (sk, entities) in place of their own; empty names go, each name stays once."""
    new = changes.select("sk", F.array_distinct(F.filter("entities", lambda e: e != "")).alias("_new"))
    return memories.join(new, "sk", "left").withColumn("entities", F.coalesce("_new", "entities")).drop("_new")


def set_content_type(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """Memories with the declared types of (sk, content_type), which their L2 companions share; an unknown label raises an error."""
    named = changes.select("sk", S.checked_label(F.col("content_type")).alias("_type"))
    companion = named.select(F.regexp_replace("sk", "^md/L[45]/", "md/L2/").alias("sk"), "_type").join(named.select("sk"), "sk", "left_anti")
    joined = memories.join(named.union(companion), "sk", "left")
    old = F.col("content_type") if "content_type" in memories.columns else F.lit(None).cast("string")
    return joined.withColumn("content_type", F.coalesce("_type", old)).drop("_type")


def guard_keys(writes: DataFrame, present: DataFrame) -> DataFrame:
    """Writes (sk, ...) that no other key forbids: a new key that begins a present or new key, or is begun by one, raises an error; overwriting is no conflict."""
    from .access import prefix_conflicts

    new = writes.select("sk").distinct().withColumn("_new", F.lit(True))
    pairs = prefix_conflicts(present.select("sk").union(writes.select("sk")))
    struck = pairs.select("sk").union(pairs.select("other")).distinct().join(new, "sk", "left_semi").withColumn("_struck", F.lit(True))
    joined = writes.join(struck, "sk", "left")
    return joined.withColumn("sk", F.when(F.col("_struck"), F.raise_error(F.concat(F.lit("another key begins like "), "sk"))).otherwise(F.col("sk"))).drop("_struck")


def remember_semantic(rows: DataFrame, default_scope: str = "") -> DataFrame:
    """(sk, layer, text, embedding, scope): the vector and its companion text for each (key, text, embedding, scope)."""
    scope = F.coalesce(F.nullif(F.col("scope"), F.lit("")), F.lit(default_scope))
    none = F.lit(None).cast("array<double>")
    made = F.array(
        F.struct(F.concat(F.lit("md/L4/"), "key").alias("sk"), F.lit(4).alias("layer"), "text", F.col("embedding").cast("array<double>").alias("embedding"), scope.alias("scope")),
        F.struct(F.concat(F.lit("md/L2/"), "key").alias("sk"), F.lit(2).alias("layer"), "text", none.alias("embedding"), scope.alias("scope")),
    )
    return rows.select(F.explode(made).alias("r")).select("r.*")


def remember_text(rows: DataFrame, layer: int = 3) -> DataFrame:
    return rows.select(F.concat(F.lit(f"md/L{layer}/"), "key").alias("sk"), "text")


def ensure_doctrine(memories: DataFrame, key: str, text: str) -> DataFrame:
    """The seed row if it isn't there yet."""
    seed = memories.sparkSession.createDataFrame([(f"md/L7/{key}", text)], "sk string, text string")
    return seed.join(memories.select("sk"), "sk", "left_anti")


def put(writes: DataFrame, node: int, watermark: int) -> DataFrame:
    """Slots after writes (sk, layer, key, seq, text): identity, version and parents follow the order of writes.

    A slot keeps the identity of its first write; each overwrite is a version whose parent is the one before.
    """
    own = Window.partitionBy("sk").orderBy("seq")
    ticked = writes.withColumn("tick", F.col("seq") + watermark + 1)
    ticked = ticked.withColumn("version_id", memory_id(F.lit(node), F.col("tick"), F.col("layer"), F.col("key")))
    ticked = ticked.withColumns({"memory_id": F.first("version_id").over(own), "parent": F.lag("version_id").over(own), "created_tick": F.first("tick").over(own)})
    return ticked


def supersede(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sk, state, new_parent) of the rows that (old, new) pairs change."""
    old = pairs.distinct().join(memories.select(F.col("sk").alias("old"), "created_tick"), "old")
    return old.select(F.col("old").alias("sk"), F.lit(1).alias("state"), F.lit(None).cast("long").alias("new_parent")).union(old.select(F.col("new").alias("sk"), F.lit(0), F.col("created_tick")))


def transfer(memories: DataFrame, layer: int) -> DataFrame:
    """(sk, text, state, parent): a copy in another layer, and the archived source."""
    copy = memories.select(F.concat(F.lit(f"md/L{layer}/"), "key").alias("sk"), "text", F.lit(0).alias("state"), F.col("sk").alias("parent"))
    return copy.union(memories.select("sk", "text", F.lit(2), F.lit(None).cast("string")))


def transfer_edges(memories: DataFrame, layer: int) -> DataFrame:
    """(kind, a, b): each copy in another layer is derived from its source."""
    return memories.select(F.lit("derived_from").alias("kind"), F.concat(F.lit(f"md/L{layer}/"), "key").alias("a"), F.col("sk").alias("b"))


def merge_memories(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sk, text, importance, confidence, parents): two memories as one, in the higher layer, for each (a, b, target)."""
    side = lambda p: memories.select(*[F.col(c).alias(f"{p}_{c}") for c in ("sk", "layer", "text", "importance", "confidence")])
    both = pairs.join(side("a"), F.col("a") == F.col("a_sk")).join(side("b"), F.col("b") == F.col("b_sk"))
    return both.select(
        F.concat(F.lit("md/L"), F.greatest("a_layer", "b_layer").cast("string"), F.lit("/"), "target").alias("sk"),
        F.concat("a_text", F.lit("\x1f"), "b_text").alias("text"),
        F.greatest("a_importance", "b_importance").alias("importance"),
        F.greatest("a_confidence", "b_confidence").alias("confidence"),
        F.array("a_sk", "b_sk").alias("parents"),
    )


SIGNALS_PER_RUN = 1000


def fold_signals(log: DataFrame, importance: float = 0.5, confidence: float = 0.5) -> DataFrame:
    """(slot, importance, confidence, last): signals applied in order, clamped at every step.

    Clamping each step is not clamping the sum, but a run of signals acts as the map
    x -> min(hi, max(lo, x + sum)), and such maps compose.  So each run of a slot's signals
    becomes one map first, and the slot's maps are composed in order: a hot slot's array
    holds runs, not signals.
    """
    names = ("importance", "confidence")
    none = F.struct(F.lit(0.0).alias("s"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    step = lambda m, d: F.struct((m["s"] + d).alias("s"), S.clamp(m["lo"] + d).alias("lo"), S.clamp(m["hi"] + d).alias("hi"))

    def after(a, b):
        held = lambda x: F.least(b["hi"], F.greatest(b["lo"], x + b["s"]))
        return F.struct((a["s"] + b["s"]).alias("s"), held(a["lo"]).alias("lo"), held(a["hi"]).alias("hi"))

    acts = log.filter(F.col("op").isin("reinforce", "feedback")).withColumn("run", F.floor(F.col("seq") / SIGNALS_PER_RUN))
    runs = acts.groupBy("slot", "run").agg(F.array_sort(F.collect_list(F.struct("seq", *[f"d_{n}" for n in names]))).alias("acts"))
    whole = lambda n: F.aggregate("acts", none, lambda m, a: step(m, a[f"d_{n}"]))
    maps = runs.select("slot", "run", *[whole(n).alias(n) for n in names], F.element_at("acts", -1)["seq"].alias("last"))
    slots = maps.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("run", *names))).alias("maps"), F.max("last").alias("last"))
    start = {"importance": importance, "confidence": confidence}

    def value(n):
        m = F.aggregate("maps", none, lambda a, b: after(a, b[n]))
        return F.least(m["hi"], F.greatest(m["lo"], F.lit(start[n]) + m["s"])).alias(n)

    return slots.select("slot", *[value(n) for n in names], "last")


def delete(memories: DataFrame, keys: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories and edges without the given keys."""
    gone = keys.select("sk")
    left = edges.join(gone.withColumnRenamed("sk", "a"), "a", "left_anti").join(gone.withColumnRenamed("sk", "b"), "b", "left_anti")
    return memories.join(gone, "sk", "left_anti"), left.select("kind", "a", "b")


def delete_everywhere(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """Tables of a store without all that hangs on the given keys: memories, state, validity, meta, versions, clock, postings and entity rows by `sk`, relations at either end."""
    gone = keys.select("sk").distinct()
    ends = lambda t: t.join(gone.withColumnRenamed("sk", "a"), "a", "left_anti").join(gone.withColumnRenamed("sk", "b"), "b", "left_anti")
    return {name: ends(t) if name == "relations" else t.join(gone, "sk", "left_anti") for name, t in tables.items()}


def set_fields(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """State, scope, importance and confidence from (sk, ...) changes where given; fractions are clamped."""
    names = [c for c in ("state", "scope", "importance", "confidence") if c in changes.columns]
    new = changes.select("sk", *[F.col(c).alias(f"_{c}") for c in names])
    given = lambda c: F.when(F.col(f"_{c}").isNotNull(), S.clamp(F.col(f"_{c}")))
    value = lambda c: given(c) if c in ("importance", "confidence") else F.col(f"_{c}")
    return memories.join(new, "sk", "left").withColumns({c: F.coalesce(value(c), F.col(c)) for c in names}).drop(*[f"_{c}" for c in names])


def set_validity(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """Validity windows from (sk, a, b); an end not after the start removes the window."""
    joined = memories.join(changes.select("sk", "a", "b"), "sk", "left")
    keep, good = F.col("a").isNull(), F.col("b") > F.col("a")
    start = F.when(keep, F.col("valid_from")).when(good, F.col("a"))
    end = F.when(keep, F.col("valid_until")).when(good, F.col("b"))
    return joined.withColumns({"valid_from": start, "valid_until": end}).drop("a", "b")


def invalidate(memories: DataFrame, now: int) -> DataFrame:
    """Windows end now; with `now` at or before the start, the window is removed and the memory is always valid."""
    ends = memories.select("sk", F.coalesce("valid_from", F.lit(0)).alias("a"), F.lit(now).cast("long").alias("b"))
    return set_validity(memories, ends)


def dedup_statements(known: DataFrame, new: DataFrame) -> DataFrame:
    """(subject, predicate, object, action): insert, overwrite or skip for each new statement."""
    old = known.select("subject", "predicate", F.col("object").alias("was"))
    action = F.when(F.col("was").isNull(), "insert").when(F.col("was") == F.col("object"), "skip").otherwise("overwrite")
    return new.join(old, ["subject", "predicate"], "left").select("subject", "predicate", "object", action.alias("action"))
