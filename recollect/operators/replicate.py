"""Vector-clock merging, conflicts, arbitration, anti-entropy and trust."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def policy(layer):
    """How a layer merges: rejected, many values, causal or controlled last writer."""
    return F.when(layer.isin(0, 1, 6), "reject").when(layer.isin(2, 3), "multi_value").when(layer == 4, "causal_lww").otherwise("controlled_lww")


def merge_verdicts(records: DataFrame) -> DataFrame:
    """Each remote record's verdict against the local one, in the fixed order of tests."""
    order = S.clock_order(F.col("remote_clock"), F.col("local_clock"))
    same = (order == "equal") & F.col("remote_text").eqNullSafe(F.col("local_text"))
    verdict = (
        F.when(policy(F.col("layer")) == "reject", "rejected")
        .when(F.col("local_clock").isNull(), "applied")
        .when(same & F.col("local_state").eqNullSafe(F.col("remote_state")), "duplicate")
        .when(same, "applied")
        .when(order == "before", "stale")
        .when(order == "after", "applied")
        .otherwise("conflict")
    )
    return records.withColumn("verdict", verdict)


def conflicts_of(records: DataFrame) -> DataFrame:
    """(subject, candidates, status) of the records in conflict."""
    name = lambda p: F.concat(F.lit(f"{p}:"), "sk")
    return merge_verdicts(records).filter("verdict = 'conflict'").select(F.col("sk").alias("subject"), F.array_sort(F.array(name("local"), name("remote"))).alias("candidates"), F.lit(0).alias("status"))


def author(clock):
    """The node of the largest counter, the lowest of equals."""
    entries = F.transform(F.map_entries(clock), lambda e: F.struct((-e["value"]).alias("c"), e["key"].alias("node")))
    return F.get(F.array_sort(entries), 0)["node"]


def arbitrate(candidates: DataFrame, now: int) -> DataFrame:
    """(conflict, decision, winner) from (conflict, candidate, importance, confidence, created_tick, n_parents)."""
    age = F.greatest(F.lit(now) - F.col("created_tick"), F.lit(0))
    score = F.col("importance") + F.col("confidence") + 0.1 / (1.0 + age) + 0.05 * F.col("n_parents")
    scored = candidates.withColumn("score", score)
    groups = scored.groupBy("conflict").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("score") > 1.5).cast("int")).alias("strong"), F.min(F.least("importance", "confidence")).alias("least"),
        F.min(F.struct((-F.col("score")).alias("s"), "candidate")).alias("best"),
    )
    decision = F.when(F.col("n") < 2, "escalate").when((F.col("strong") >= 2) & (F.col("least") >= 1), "merge").when(F.col("strong") >= 2, "escalate").otherwise("prefer")
    return groups.select("conflict", decision.alias("decision"), F.when(decision == "prefer", F.col("best.candidate")).alias("winner"))


def resolve(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Conflicts with those that have a winner resolved: (subject, winner, losers, status)."""
    joined = conflicts.join(decisions.select(F.col("conflict").alias("subject"), "winner"), "subject", "left")
    losers = F.when(F.col("winner").isNotNull(), F.array_except("candidates", F.array("winner")))
    return joined.select("subject", "winner", losers.alias("losers"), F.when(F.col("winner").isNotNull(), 1).otherwise(F.col("status")).alias("status"))


def missing_after(mine: DataFrame, known: DataFrame) -> DataFrame:
    """(node, counter, have): watermarks of mine that a peer with (node, have) lacks."""
    joined = mine.join(known, "node", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long")))
    return joined.filter(F.col("have") < F.col("counter")).orderBy("node")


def trusted_peers(peers: DataFrame, least: float, most: int = 64) -> DataFrame:
    return peers.filter((F.col("trust") >= least) & ~F.col("revoked")).orderBy(F.desc("trust"), "node").limit(most)


def pair_replicas(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Both stores' records (sk, layer, clock, text, state) side by side, as `merge_verdicts` reads them; records of one store only are there too."""
    side = lambda df, p: df.select("sk", F.col("layer").alias(f"_{p}"), *[F.col(c).alias(f"{p}_{c}") for c in ("clock", "text", "state")])
    return side(local, "local").join(side(remote, "remote"), "sk", "full_outer").withColumn("layer", F.coalesce("_local", "_remote")).drop("_local", "_remote")


def merge(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(sk, layer, clock, text, state) after remote records were merged in: applied ones replace, clocks join, conflicts and what the remote lacks stay local; a policy's rejects never enter."""
    rows = merge_verdicts(pair_replicas(local, remote))
    only_local = F.col("remote_clock").isNull()
    verdict = F.when(only_local, "kept").otherwise(F.col("verdict"))
    none = F.lit(None).cast("map<int,bigint>")
    both = F.when(F.col("local_clock").isNull(), F.col("remote_clock")).otherwise(S.clock_merge(F.col("local_clock"), F.col("remote_clock")))
    take = verdict == "applied"
    kept = rows.filter(F.col("local_clock").isNotNull() | take)
    pick = lambda c: F.when(take, F.col(f"remote_{c}")).otherwise(F.col(f"local_{c}")).alias(c)
    return kept.select("sk", "layer", F.when(take, both).otherwise(F.coalesce("local_clock", none)).alias("clock"), pick("text"), pick("state"))


def export_records(memories: DataFrame, keys: DataFrame) -> DataFrame:
    """Whole records of the given keys: document, state, validity, metadata."""
    return memories.join(keys.select("sk").distinct(), "sk", "left_semi")


def import_records(memories: DataFrame, records: DataFrame) -> DataFrame:
    """Memories with the records in place of their own, as they are: nothing ticks, and a record without a validity window clears it."""
    return memories.join(records.select("sk"), "sk", "left_anti").unionByName(records, allowMissingColumns=True)


def evidence(conflicts: DataFrame, current: DataFrame, kept: DataFrame) -> DataFrame:
    """(conflict, candidate, importance, confidence, created_tick, n_parents) of every candidate: from its present metadata, else from the copy kept with the conflict."""
    cols = ("importance", "confidence", "created_tick", "n_parents")
    each = conflicts.select("conflict", F.explode("candidates").alias("candidate"))
    now = current.select("candidate", *[F.col(c).alias(f"_{c}") for c in cols])
    old = kept.select("conflict", "candidate", *cols)
    joined = each.join(now, "candidate", "left").join(old, ["conflict", "candidate"], "left")
    known = F.col("_importance").isNotNull()
    return joined.select("conflict", "candidate", *[F.when(known, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in cols]).filter("importance is not null")


def apply_decisions(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """(subject, status, winner, losers, merged) after decisions (subject, decision, winner, loser).

    `prefer` takes the winner; `invalidate` the first candidate but the loser; `merge` the
    first two candidates as one; `escalate` leaves the conflict open.  Resolving again changes nothing.
    """
    joined = conflicts.join(decisions.select("subject", "decision", F.col("winner").alias("_w"), F.col("loser").alias("_l")), "subject", "left")
    other = F.get(F.filter("candidates", lambda c: c != F.col("_l")), 0)
    winner = F.when(F.col("decision") == "prefer", F.col("_w")).when(F.col("decision") == "invalidate", other).when(F.col("decision") == "merge", F.get("candidates", 0))
    winner = F.when(F.col("status") == 0, winner)
    merged = F.when((F.col("status") == 0) & (F.col("decision") == "merge") & (F.size("candidates") > 1), F.slice("candidates", 1, 2))
    return joined.select("subject", F.when(winner.isNotNull(), 1).otherwise(F.col("status")).alias("status"), winner.alias("winner"), F.when(winner.isNotNull(), F.array_except("candidates", F.array(winner))).alias("losers"), merged.alias("merged"))


def dismiss(conflicts: DataFrame, subjects: DataFrame) -> DataFrame:
    return conflicts.join(subjects.select("subject"), "subject", "left_anti")


def upsert_peers(peers: DataFrame, new: DataFrame, most: int = 64) -> DataFrame:
    """Peers (node, trust, revoked) with new or changed ones; beyond `most` the lowest nodes stay."""
    return peers.join(new.select("node"), "node", "left_anti").unionByName(new).orderBy("node").limit(most)


def revoke(peers: DataFrame, nodes: DataFrame) -> DataFrame:
    gone = nodes.select("node", F.lit(True).alias("_gone"))
    return peers.join(gone, "node", "left").withColumns({"revoked": F.coalesce("_gone", "revoked"), "trust": F.when(F.col("_gone"), 0.0).otherwise(F.col("trust"))}).drop("_gone")


def gossip_round(known: DataFrame, links: DataFrame) -> DataFrame:
    """(node, peer, version) after every node told its neighbours (a, b) what it knows."""
    told = links.join(known.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "peer", "version")
    return known.unionByName(told).groupBy("node", "peer").agg(F.max("version").alias("version"))


def gossip(known: DataFrame, links: DataFrame, rounds: int) -> DataFrame:
    """A mesh after some rounds; as many as its longest shortest path make all nodes agree."""
    for _ in range(rounds):
        known = gossip_round(known, links)
    return known
