"""A hash-chained ledger over states of the store, verification and rollback."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import OFFSET, fnv1a, fnv1a_hex


def state_digest(rows: DataFrame) -> DataFrame:
    """(digest): the FNV-1a fold over all (key, value) in key order.  The fold is sequential by definition: one task streams the sorted rows."""

    def fold(batches):
        h = OFFSET
        for batch in batches:
            for k, v in zip(batch["k"], batch["v"], strict=True):
                for part in (k.encode(), v.encode()):
                    h = fnv1a(part, fnv1a(len(part).to_bytes(8, "little"), h))
        yield pd.DataFrame({"digest": [f"{h:016x}"]})

    return rows.select("k", "v").repartition(1).sortWithinPartitions("k").mapInPandas(fold, "digest string")


def fast_digest(rows: DataFrame) -> DataFrame:
    """(digest): an order-independent digest that scales; not the ledger's digest."""
    return rows.agg(F.concat(F.lower(F.hex(F.bit_xor(F.xxhash64("k", "v")))), F.lit(":"), F.count(F.lit(1)).cast("string")).alias("digest"))


def chain(entries: DataFrame) -> DataFrame:
    """Ledger entries (seq, op, digest) with `prev_hash`, the hash of the entry before."""
    own = fnv1a_hex(F.encode(F.concat_ws("|", F.col("seq").cast("string"), "op", "digest"), "UTF-8"))
    return entries.withColumn("own_hash", own).withColumn("prev_hash", F.coalesce(F.lag("own_hash").over(Window.orderBy("seq")), F.lit("0" * 16)))  # a ledger has few entries


def verify(ledger: DataFrame, digest: str) -> DataFrame:
    """(entries, gapless, linked, current): whether the ledger holds and its last checkpoint is the present state."""
    w = Window.orderBy("seq")
    own = fnv1a_hex(F.encode(F.concat_ws("|", F.col("seq").cast("string"), "op", "digest"), "UTF-8"))
    rows = ledger.withColumn("h", own).withColumns({"gap": F.col("seq") - F.coalesce(F.lag("seq").over(w), F.lit(0)), "want": F.coalesce(F.lag("h").over(w), F.lit("0" * 16))})
    last = F.max_by("digest", F.when(F.col("op") == "checkpoint", F.col("seq")))
    return rows.agg(F.count(F.lit(1)).alias("entries"), F.bool_and(F.col("gap") == 1).alias("gapless"), F.bool_and(F.col("want") == F.col("prev_hash")).alias("linked"), (last == digest).alias("current"))


def snapshot(memories: DataFrame) -> DataFrame:
    return memories.select("sk", "state", "valid_from", "valid_until", "importance")


def rollback(memories: DataFrame, saved: DataFrame) -> DataFrame:
    """Memories with state, validity and importance of a snapshot; rows made later lose what they gained, payloads stay."""
    old = saved.select("sk", *[F.col(c).alias(f"_{c}") for c in ("state", "valid_from", "valid_until", "importance")], F.lit(True).alias("_known"))
    joined = memories.join(old, "sk", "left")
    known = F.col("_known").isNotNull()
    back = {"state": F.when(known, F.col("_state")).otherwise(0), "valid_from": F.col("_valid_from"), "valid_until": F.col("_valid_until"), "importance": F.when(known, F.col("_importance")).otherwise(F.col("importance"))}
    return joined.withColumns(back).drop(*[c for c in old.columns if c.startswith("_")])
