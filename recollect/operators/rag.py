"""Context assembly for prompts, reranking and hit rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def context_lines(hits: DataFrame, budget: int = 8192, cut: int = 200) -> DataFrame:
    """(rank, line) of ranked hits (rank, text, dist) up to the first line that would pass the byte budget; empty texts keep their rank number."""
    line = F.concat(F.lit("  #"), F.col("rank").cast("string"), F.lit(") d="), F.format_string("%.4f", "dist"), F.lit(" "), S.cut_bytes(F.col("text"), cut))
    rows = hits.filter(F.coalesce(F.length("text"), F.lit(0)) > 0).select("rank", line.alias("line"))
    used = F.sum(F.octet_length("line") + 1).over(Window.orderBy("rank"))  # k rows
    return rows.withColumn("used", used).filter((F.col("used") <= budget) | F.lit(budget == 0)).drop("used")


def context(hits: DataFrame, k: int, budget: int = 8192, note: str | None = None) -> DataFrame:
    """One row with the assembled context; a note, if given, follows where hits with a text did not fit."""
    shown = context_lines(hits, budget).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    text = F.concat_ws("\n", F.lit(f"[RAG top-{k}]"), F.transform("l", lambda x: x["line"]))
    if note is None:
        return shown.select(text.alias("context"))
    wanted = hits.agg(F.count_if(F.coalesce(F.length("text"), F.lit(0)) > 0).alias("n"))
    cut = F.col("n") > F.size("l")
    return shown.join(wanted).select(F.when(cut, F.concat(text, F.lit("\n" + note))).otherwise(text).alias("context"))  # one row each


def rerank(hits: DataFrame, anchors: list[str], fixed: bool = False) -> DataFrame:
    """Hits by how many anchors their text contains, then by score descending (ascending if fixed), then distance."""
    n = sum((F.contains(S.ascii_lower(F.col("text")), F.lit(a)).cast("int") for a in anchors), F.lit(0))
    by = F.asc("score") if fixed else F.desc("score")
    return hits.withColumn("anchors", F.coalesce(n, F.lit(0))).orderBy(F.desc("anchors"), by, "dist", "sk")


def rerank_gate(semantic: DataFrame, lexical: DataFrame, query: list[str], k: int) -> DataFrame:
    """The union of both paths by grounding, distance, importance and key."""
    cols = ["sk", "text", "dist", "importance"]
    both = semantic.select(*cols).unionByName(lexical.join(semantic.select("sk"), "sk", "left_anti").select(*cols))
    scored = both.withColumn("grounding", S.grounding(query, S.tokens(F.col("text"))))
    return scored.orderBy(F.desc("grounding"), "dist", F.desc("importance"), "sk").limit(k)


def render(hits: DataFrame) -> DataFrame:
    """(sk, prose, json) of hits."""
    prose = F.format_string("%s d=%.4f %s", F.col("sk"), F.col("dist"), F.col("text"))
    return hits.select("sk", prose.alias("prose"), F.to_json(F.struct("sk", "score", "text")).alias("json"))


def connector_policy(hits: DataFrame, most: int, least_score: float, budget: int) -> DataFrame:
    """Hits a connector passes on: good enough, few enough, within a character budget."""
    ranked = hits.filter(F.col("score") >= least_score).orderBy(F.desc("score"), "sk").limit(most)
    w = Window.orderBy(F.desc("score"), "sk")  # at most `most` rows
    return ranked.withColumn("used", F.sum(F.length("text")).over(w)).filter(F.col("used") <= budget).drop("used")
