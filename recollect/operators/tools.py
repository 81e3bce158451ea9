"""The tool surface: four tools and their aliases as calls on a store of DataFrames, and the seams a host fills."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import govern, graph, lexical, observe, rag, recall, replicate, write

Embedder = Callable[[Column], Column]
Arbitration = Callable[[DataFrame, int], DataFrame]


@dataclass
class Store:
    """What the tools read; `embed` makes vectors of texts, `judge` decides conflicts."""

    memories: DataFrame
    relations: DataFrame
    conflicts: DataFrame
    embed: Embedder | None = None
    judge: Arbitration = replicate.arbitrate


def expand(tool: str, args: dict) -> str:
    """The operation that a tool's arguments ask for."""
    if tool == "remember" and args.get("user") and args.get("response"):
        return "remember_episodic"
    if tool == "recall":
        chosen = [name for name, asked in (("recall_entities", args.get("entities")), ("recall_temporal", (args.get("at") or 0) > 0), ("rag_context", args.get("rag"))) if asked]
        return chosen[0] if chosen else "recall"
    if tool == "health":
        return {"validate": "validate", "era": "era_report", "era_report": "era_report"}.get(args.get("view", "status"), "health")
    if tool == "curate":
        return args.get("op", "curate")
    return tool


def _mode(args: dict) -> str:
    """Lexical without a vector, semantic with one, unless a mode is given."""
    return args.get("mode") or ("semantic" if args.get("vector") else "lexical")


def _recall(store: Store, args: dict) -> DataFrame:
    k = min(max(int(args.get("k", 5)), 1), 20)
    scope, old = args.get("scope"), bool(args.get("historical"))
    mode = _mode(args)
    if mode == "lexical":
        texts = store.memories.filter(F.col("text").isNotNull())
        return lexical.recall_lexical(texts, _terms(args["query"]), k, scope, old).select("sk", "score", "dist")
    found = recall.recall(store.memories, args["vector"], k, scope, old)
    if mode == "semantic":
        return found.select("sk", F.col("score").cast("double").alias("score"), "dist")
    words = lexical.recall_lexical(store.memories.filter(F.col("text").isNotNull()), _terms(args["query"]), 4 * k, scope, old)
    return recall.hybrid(found, words, k).select("sk", F.col("by").alias("score"), F.lit(None).cast("double").alias("dist"))


def _terms(query: str) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in query)
    return sorted(set("".join(c if c.isalnum() else " " for c in lowered).split()))


def call(store: Store, tool: str, args: dict) -> DataFrame:
    """The result of a tool: rows to read, or rows to write; an unknown operation raises an error."""
    spark, rows = store.memories.sparkSession, store.memories
    one = lambda **x: spark.createDataFrame([tuple(x.values())], ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in x.items()))
    pick = lambda: rows.filter(F.col("sk") == args["key"])
    operations: dict[str, Callable[[], DataFrame]] = {
        "remember": lambda: write.remember_text(one(key=args["key"], text=args["text"])),
        "remember_fact": lambda: write.remember_fact(one(ts=args["now"], text=args["text"])),
        "remember_episodic": lambda: write.remember_episodic(one(ts=args["now"], user=args["user"], reply=args["response"])),
        "remember_semantic": lambda: write.remember_semantic(one(key=args["key"], text=args["text"], scope=args.get("scope", "")).withColumn("embedding", store.embed(F.col("text")) if store.embed else F.array(*[F.lit(float(x)) for x in args["vector"]]))),
        "recall": lambda: _recall(store, args),
        "recall_entities": lambda: recall.entities(rows, args["entities"], args.get("k", 5), args.get("scope")).select("sk", "overlap", "dist"),
        "recall_temporal": lambda: recall.temporal(recall.recall(rows, args["vector"], 16 * args.get("k", 5)), args["at"], 0.7, 0.3).orderBy("total", "sk").limit(args.get("k", 5)).select("sk", "total"),
        "rag_context": lambda: rag.context(_ranked(recall.recall(rows, args["vector"], args.get("k", 5))), args.get("k", 5)),
        "health": lambda: observe.health(rows, store.conflicts),
        "validate": lambda: observe.validate(rows, store.relations.select(F.col("b").alias("sk")).distinct(), rows.filter("embedding is not null")),
        "era_report": lambda: observe.era_report(rows),
        "scopes": lambda: observe.scope_distribution(rows),
        "tensions": lambda: observe.tensions(store.conflicts, rows),
        "diary": lambda: observe.diary(rows, args["node"], args.get("limit", 10)).select("sk", "text"),
        "profile": lambda: observe.profile(rows, args["node"], args.get("limit", 10)),
        "get": lambda: pick().select("sk", "text"),
        "forget": lambda: write.set_fields(rows, pick().select("sk", F.lit(2).alias("state"))).select("sk", "state"),
        "delete": lambda: write.delete_everywhere({"memories": rows}, pick())["memories"].select("sk"),
        "reinforce": lambda: pick().select("sk", S.clamp(F.col("importance") + float(args["amount"])).alias("importance")),
        "set_scope": lambda: write.set_fields(rows, pick().select("sk", F.lit(args["scope"]).alias("scope"))).select("sk", "scope"),
        "associate": lambda: graph.associate(store.relations, one(kind=args["kind"], a=args["a"], b=args["b"]), rows),
        "related_to": lambda: graph.related_to(store.relations, args["key"]),
        "expire": lambda: govern.expire(rows, args["now"]).select("sk", "new_state"),
        "decay": lambda: govern.decay(rows, args["now"], args.get("half_life", 1000)).select("sk", "new_importance", "new_state"),
        "conflicts": lambda: store.conflicts,
        "consolidate": lambda: govern.consolidate(rows),
    }
    name = expand(tool, args)
    if name not in operations:
        raise ValueError(f"no operation {name}")
    return operations[name]()


def _ranked(hits: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return hits.withColumn("rank", F.row_number().over(Window.orderBy("score", "sk")))  # k rows


def open_session(memories: DataFrame, q: list[float], scope: str, now: int, k: int = 8) -> DataFrame:
    """(sk, text) that a session starts with: scoped recall once ended memories are invalid."""
    ended = govern.expire(memories, now).select("sk", "new_state")
    rows = memories.join(ended, "sk", "left").withColumn("state", F.coalesce("new_state", "state")).drop("new_state")
    return recall.recall(rows, q, k, scope).select("sk", "text", "score")
