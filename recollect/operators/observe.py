"""Health, validation, era and distribution reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def scope_distribution(memories: DataFrame) -> DataFrame:
    label = F.when(F.col("scope") == "", "(global)").otherwise(F.col("scope"))
    return memories.filter(F.col("layer").between(3, 5)).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy("label")


def empty_hint(memories: DataFrame, scope: str = "", mode: str = "semantic") -> DataFrame:
    """(hint): what to try after a recall without hits; no row for an empty store."""
    n = memories.agg(F.count(F.lit(1)).alias("docs"))
    scoped = scope_distribution(memories)
    own = scoped.agg(
        F.coalesce(F.sum(F.when(F.col("label") == "(global)", F.col("n"))), F.lit(0)).alias("globals"),
        F.coalesce(F.sum(F.when(F.col("label") != "(global)", F.col("n"))), F.lit(0)).alias("scoped"),
        F.coalesce(F.sum(F.when(F.col("label") == scope, F.col("n"))), F.lit(0)).alias("here"),
    )
    named = F.array_join(F.transform(F.col("top"), lambda t: F.concat(t["label"], F.lit("("), t["n"].cast("string"), F.lit(")"))), ", ")
    top = scoped.filter("label <> '(global)'").orderBy("label").limit(4).agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("top"))
    whole = n.join(own).join(top).filter("docs > 0")  # one row each
    text = lambda c: c.cast("string")
    if scope == "":
        hint = F.when(F.col("scoped") == 0, F.concat(F.lit(f"no hits (mode {mode}); "), text(F.col("globals")), F.lit(" global memories: use the words they were written in, or lexical mode"))).otherwise(
            F.concat(F.lit("no hits in the global scope, which sees no scoped memories; "), text(F.col("scoped")), F.lit(" are scoped: "), named)
        )
    else:
        hint = F.when((F.col("here") == 0) & (F.col("scoped") > 0), F.concat(F.lit(f"no hits in scope {scope}; known scopes: "), named)).otherwise(F.lit(f"no hits (scope {scope}, mode {mode}): change the query, the mode, or ask for history"))
    return whole.select(hint.alias("hint"))


class Metrics:
    """Named counters of rows that pass through observed frames; read after the frames' jobs ran."""

    def __init__(self):
        self.parts: list[tuple[str, Observation]] = []

    def watch(self, name: str, df: DataFrame) -> DataFrame:
        seen = Observation()
        self.parts.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("n"))

    def read(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for name, seen in self.parts:
            out[name] = out.get(name, 0) + seen.get["n"]
        return out

    def reset(self) -> None:
        self.parts = []


def success(results: DataFrame) -> DataFrame:
    """(agent, success_rate, soft_progress) of (agent, task, met, wanted): the share of tasks with every constraint met, and the mean share met."""
    share = F.col("met") / F.col("wanted")
    return results.groupBy("agent").agg(F.avg((F.col("met") == F.col("wanted")).cast("double")).alias("success_rate"), F.avg(share).alias("soft_progress"))


def health(memories: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row: documents, vectors, open and all conflicts, dimensions, the eight largest scopes."""
    counts = memories.agg(F.count(F.lit(1)).alias("docs"), F.count("embedding").alias("vectors"), F.array_sort(F.collect_set(F.size("embedding"))).alias("dims_"))
    top = scope_distribution(memories).orderBy(F.desc("n"), "label").limit(8).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "label"))).alias("top"))
    open_ = conflicts.agg(F.count(F.lit(1)).alias("conflicts"), F.coalesce(F.sum((F.col("status") == 0).cast("long")), F.lit(0)).alias("open_conflicts"))
    joined = counts.crossJoin(top).crossJoin(open_)  # one row each
    return joined.select("docs", "vectors", "conflicts", "open_conflicts", F.array_join(F.filter("dims_", lambda d: d > 0), ",").alias("dims"), F.array_join(F.transform("top", lambda t: t["label"]), ",").alias("top_scopes"))


def validate(memories: DataFrame, side: DataFrame, indexed: DataFrame) -> DataFrame:
    """(issue, sk): side rows without a document, vectors missing from the index, index rows without a document."""
    keys = memories.select("sk")
    a = side.join(keys, "sk", "left_anti").select(F.lit("orphan_side_row").alias("issue"), "sk")
    b = memories.filter("embedding is not null").select("sk").join(indexed.select("sk"), "sk", "left_anti").select(F.lit("not_indexed").alias("issue"), "sk")
    c = indexed.select("sk").distinct().join(keys, "sk", "left_anti").select(F.lit("index_orphan").alias("issue"), "sk")
    return a.union(b).union(c)


def era_report(memories: DataFrame) -> DataFrame:
    """(dim, docs, covered, text_bytes): L4 and L5 vectors per dimension and their companion texts."""
    own = memories.filter("layer in (4, 5) and embedding is not null").select("key", F.size("embedding").alias("dim"))
    texts = memories.filter("layer = 2").select("key", F.octet_length("text").alias("bytes"))
    return own.join(texts, "key", "left").groupBy("dim").agg(F.count(F.lit(1)).alias("docs"), F.count("bytes").alias("covered"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("text_bytes"))


def era_estimate(report: DataFrame) -> DataFrame:
    """Nanoseconds to migrate, by the published cost per document (scan, rewrite, rebuild)."""
    return report.agg((F.sum("docs") * (1100 + 72000 + 12900)).alias("nanoseconds"), F.when(F.count(F.lit(1)) == 0, "empty").when(F.count(F.lit(1)) > 1, "mixed_dims").otherwise("ok").alias("verdict"))


def diary(memories: DataFrame, node: int, limit: int) -> DataFrame:
    return memories.filter((F.col("layer") == 2) & (F.col("source") == node)).orderBy(F.desc("sk")).limit(limit)


def profile(memories: DataFrame, node: int, limit: int) -> DataFrame:
    """Important L3-L5 memories of a node with their texts; vectors take the text of their companion."""
    own = memories.filter(F.col("layer").between(3, 5) & (F.col("source") == node)).orderBy(F.desc("importance"), "sk").limit(limit)
    texts = memories.filter("layer = 2").select("key", F.col("text").alias("companion"))
    return own.join(texts, "key", "left").select("sk", "importance", F.coalesce("companion", "text").alias("text"))


def tensions(conflicts: DataFrame, memories: DataFrame, limit: int = 20, seen: list[str] | None = None) -> DataFrame:
    """(kind, name): open conflicts, some superseded keys, and scopes that aren't among the seen ones if those are given."""
    a = conflicts.filter("status = 0").select(F.lit("conflict").alias("kind"), F.col("subject").alias("name"))
    b = memories.filter("state = 1").orderBy("sk").limit(limit).select(F.lit("superseded").alias("kind"), F.col("sk").alias("name"))
    if seen is None:
        return a.union(b)
    unseen = memories.filter(F.col("layer").between(3, 5) & (F.col("scope") != "") & ~F.col("scope").isin(seen))
    return a.union(b).union(unseen.select(F.lit("unseen_scope").alias("kind"), F.col("scope").alias("name")).distinct())


def percentiles(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(share, value): the element at floor(n * share) of the sorted values, found by ranges of ranks."""
    n = rows.filter(F.col(column).isNotNull()).count()
    if not n:
        return rows.sparkSession.createDataFrame([], "share double, value double")
    wanted = [(s, min(int(n * s), n - 1)) for s in shares]
    counted = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    # Each value's place is its count below; a share's value is the first whose place reaches the wanted one.
    bounds = counted.select(F.percentile_approx("value", [x / 64 for x in range(1, 64)]).alias("b")).first()["b"]
    part = sum(((F.col("value") > b).cast("int") for b in bounds), F.lit(0))  # by value, so that it is the same whenever it is computed
    ranged = counted.withColumn("part", part)
    offsets, total = {}, 0
    for r in ranged.groupBy("part").agg(F.sum("c").alias("c")).orderBy("part").collect():  # at most 64 rows
        offsets[r["part"]] = total
        total += r["c"]
    start = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])[F.col("part")]
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("value")) + start
    placed = ranged.select("value", upto.alias("upto"), (upto - F.col("c")).alias("below"))
    out = None
    for s, at in wanted:
        row = placed.filter((F.col("below") <= at) & (F.col("upto") > at)).select(F.lit(s).alias("share"), "value")
        out = row if out is None else out.union(row)
    return out
