"""Semantic, weighted, temporal, hybrid and entity recall over memory DataFrames.

Coarse candidates by Hamming distance of sign bits are cut first; state and scope are
filtered inside that pool, and exact cosine scores order what is left.  Every order ends
in the storage key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def with_words(memories: DataFrame, dims: int) -> DataFrame:
    return memories.withColumns({f"w{k}": w for k, w in enumerate(S.sign_words(F.col("embedding"), dims))})


def coarse(memories: DataFrame, q: list[float], n: int, centered: bool = False) -> DataFrame:
    """The n nearest by (Hamming distance, key)."""
    checked_query(q)
    words = S.sign_words(F.col("embedding"), len(q))
    found = memories.filter(F.size("embedding") == len(q)).withColumn("ham", S.hamming(words, S.query_words(q, centered)))
    return found.orderBy("ham", "sk").limit(n)


def checked_query(q: list[float]) -> None:
    if len(q) > 4096 or any(x != x or x in (float("inf"), float("-inf")) for x in q):
        raise ValueError("a query vector has at most 4096 finite components")


def scored(pool: DataFrame, q: list[float]) -> DataFrame:
    """`dist` (1 - cosine, in steps of 1/10000) and the integer `score` it stands for."""
    score = F.floor(S.cosine_distance(F.col("embedding"), S.literal_vector(q)) * 10000).cast("long")
    return pool.withColumn("score", score).withColumn("dist", F.col("score") / 10000.0)


def guard_dimension(memories: DataFrame, dims: int) -> None:
    """An error unless vectors of this size are there (an empty store accepts any)."""
    known = indexed_dims(memories)
    if known and dims not in known:
        raise ValueError(f"no vectors of {dims} components, only of {known}")


def indexed_dims(memories: DataFrame) -> list[int]:
    """The distinct sizes of the stored vectors, sorted (4096 at most)."""
    rows = memories.filter("embedding is not null").select(F.size("embedding").alias("n")).distinct().limit(4096).collect()
    return sorted(r["n"] for r in rows)


def guard_written(rows: DataFrame, dims: list[int]) -> DataFrame:
    """Rows whose vectors may be written: finite, of 1 to 4096 components, and of a known size where sizes are known; others raise an error."""
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    bad = (F.size(v) < 1) | (F.size(v) > 4096) | odd
    wrong = ~F.size(v).isin(dims) if dims else F.lit(False)
    fine = F.when(v.isNull(), v).when(bad, F.raise_error(F.lit("a vector has 1 to 4096 finite components"))).when(wrong, F.raise_error(F.lit("a vector of another size"))).otherwise(v)
    return rows.withColumn("embedding", fine)


def with_effective_scope(memories: DataFrame) -> DataFrame:
    """Memories with `scope` as it takes effect: a companion (L2) without one of its own has that of its L4, L5 or L3 memory, the first that has any."""
    place = F.when(F.col("layer") == 4, 0).when(F.col("layer") == 5, 1).otherwise(2)
    owners = memories.filter(F.col("layer").isin(3, 4, 5) & (F.col("scope") != "")).groupBy(F.col("key").alias("_key")).agg(F.min_by("scope", place).alias("_owner"))
    joined = memories.join(owners, (F.col("layer") == 2) & (F.col("key") == F.col("_key")), "left")
    own = F.when(F.coalesce("scope", F.lit("")) != "", F.col("scope"))
    return joined.withColumn("scope", F.coalesce(own, "_owner", F.lit(""))).drop("_key", "_owner")


def rescored(pool: DataFrame, q: list[float]) -> DataFrame:
    """`scored`, where a payload without a vector of the query's size falls back on its Hamming distance."""
    words = -(-len(q) // 64)
    exact = F.size("embedding") == len(q)
    score = F.when(exact, F.floor(S.cosine_distance(F.col("embedding"), S.literal_vector(q)) * 10000)).otherwise(F.col("ham")).cast("long")
    dist = F.when(exact, score / 10000.0).otherwise(F.least(F.col("ham") / float(64 * words), F.lit(1.0)))
    return pool.withColumns({"score": score, "dist": dist})


def fit_width(words: Column, width: int) -> Column:
    """A bit vector at an index's width: cut, or filled up with zeros."""
    return F.concat(F.slice(words, 1, width), F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(width) - F.size(words), F.lit(0))))


def reclaim(index: DataFrame, live: DataFrame, threshold: int = 64) -> DataFrame:
    """Index rows without those whose memory is gone, once there are `threshold` of them (0: always)."""
    keys = live.select("sk")
    if threshold and index.join(keys, "sk", "left_anti").limit(threshold).count() < threshold:
        return index
    return index.join(keys, "sk", "left_semi")


def visible(pool: DataFrame, scope: str | None = None, historical: bool = False) -> DataFrame:
    """Active memories (all if historical) of one scope; no scope means the global one only."""
    pool = pool if historical else pool.filter("state = 0")
    return pool.filter(F.col("scope") == (scope or ""))


def recall(memories: DataFrame, q: list[float], k: int, scope: str | None = None, historical: bool = False, oversample: int | None = None) -> DataFrame:
    """The k nearest; may be fewer, as filters come after the candidate cut."""
    k = max(k, 1)
    if q:
        guard_dimension(memories, len(q))
    else:
        return scored(memories.limit(0).withColumn("ham", F.lit(0)), [0.0])
    pool = visible(coarse(memories, q, k * (oversample or S.oversample(len(q)))), scope, historical)
    best = Window.partitionBy("sk").orderBy("score", "ham")
    found = scored(pool, q).withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")
    return found.orderBy("score", "sk").limit(k)


def weighted(pool: DataFrame, now: int, w_sem: float, w_rec: float, w_imp: float, w_conf: float = 0.0, w_src: float = 0.0, trust: DataFrame | None = None) -> DataFrame:
    """A pool with its penalty parts and their weighted sum `total`; lower is better."""
    ts = S.time_of_key(F.col("sk"))
    recency = F.when(ts.isNull(), 0.5).otherwise(S.clamp((F.lit(now) - ts) / 1000.0))
    if trust is None:
        pool = pool.withColumn("trust", F.lit(0.5))
    else:
        pool = pool.join(trust, pool["source"] == trust["node"], "left").drop("node").withColumn("trust", F.coalesce("trust", F.lit(0.5)))
    parts = {"sem": F.col("dist"), "rec": recency, "imp": 1 - F.col("importance"), "conf": 1 - F.col("confidence"), "src": 1 - F.col("trust")}
    pool = pool.withColumns(parts)
    total = w_sem * F.col("sem") + w_rec * F.col("rec") + w_imp * F.col("imp") + w_conf * F.col("conf") + w_src * F.col("src")
    return pool.withColumn("total", total)


def temporal(pool: DataFrame, at: int, w_sem: float, w_time: float) -> DataFrame:
    """A pool with the time penalty of each hit at a moment."""
    window = F.col("valid_from").isNotNull()
    inside = (F.col("valid_from") <= at) & (F.lit(at) < F.col("valid_until"))
    ts = F.coalesce(S.time_of_key(F.col("sk")), F.col("created_tick"))
    t = F.when(window & inside, 0.0).when(window, 1.0).when(ts.isNull(), 0.5).otherwise(S.clamp(F.abs(F.lit(at) - ts) / 1000.0))
    return pool.withColumn("tpen", t).withColumn("total", w_sem * F.col("dist") + w_time * F.col("tpen"))


def valid_at(hits: DataFrame, now: int) -> DataFrame:
    """Hits whose validity window covers a moment, or that have none."""
    return hits.filter(F.col("valid_from").isNull() | ((F.col("valid_from") <= now) & (F.lit(now) < F.col("valid_until"))))


def hybrid(semantic: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Semantic hits first, then lexical ones that aren't among them."""
    a = semantic.select("sk", F.lit(0).alias("part"), F.col("score").cast("double").alias("by"))
    b = lexical.join(a.select("sk"), "sk", "left_anti").select("sk", F.lit(1).alias("part"), (-F.col("score")).alias("by"))
    return a.union(b).orderBy("part", "by", "sk").limit(max(k, 1))


def entities(memories: DataFrame, wanted: list[str], k: int, scope: str | None = None, historical: bool = False) -> DataFrame:
    """Memories by how many of the wanted entities they name; a wanted entity given twice counts twice."""
    weights = {e: wanted.count(e) for e in wanted if e}
    count = F.aggregate("entities", F.lit(0), lambda a, e: a + sum((F.when(e == w, n).otherwise(0) for w, n in weights.items()), F.lit(0)))
    hits = visible(memories, scope, historical).filter(F.arrays_overlap("entities", F.array(*[F.lit(w) for w in weights] or [F.lit("")])))
    hits = hits.withColumn("overlap", count).withColumn("dist", 1 - F.col("overlap") / float(max(len(wanted), 1)))
    return hits.orderBy(F.desc("overlap"), F.desc("importance"), "sk").limit(max(k, 1))


def _blocks(words: list[Column], blocks: int) -> list[Column]:
    """A vector's bits in `blocks` parts of equal size, each as an array of words: whole words, or parts of one."""
    per = max(1, len(words) // blocks)
    if len(words) >= blocks:
        return [F.array(*words[b * per : (b + 1) * per if b < blocks - 1 else len(words)]) for b in range(blocks)]
    cuts = max(1, blocks // len(words))
    size = 64 // cuts
    return [F.array(F.shiftrightunsigned(w, c * size).bitwiseAND(F.lit((1 << size) - 1)) if cuts > 1 else w) for w in words for c in range(cuts)]


def multi_index_candidates(memories: DataFrame, q: list[float], blocks: int = 4, probes: int = 4) -> DataFrame:
    """(sk, w0, w1, ...) of memories that agree with the query in a block of bits, the low bits of the block's first word flipped one at a time too."""
    words = [F.col(f"w{k}") for k in range(-(-len(q) // 64))]
    names = [f"w{k}" for k in range(len(words))]
    own = _blocks(words, blocks)
    one = memories.sparkSession.createDataFrame([tuple(S.query_words(q))], ", ".join(f"{n} long" for n in names))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << p).cast("long") for p in range(probes)])
    keys = F.array(*[F.struct(F.lit(b).alias("block"), bits.alias("bits")) for b, bits in enumerate(own)])
    wanted = one.select(F.explode(keys).alias("k"), flips.alias("flips")).select("k.block", "k.bits", F.explode("flips").alias("flip"))
    first = F.col("bits")[0].bitwiseXOR(F.col("flip"))
    wanted = wanted.select("block", F.transform("bits", lambda x, i: F.when(i == 0, first).otherwise(x)).alias("bits")).distinct()  # blocks * (probes + 1) rows
    bucketed = with_words(memories.filter(F.size("embedding") == len(q)), len(q)).withColumn("p", F.explode(keys)).select("sk", *names, "p.block", "p.bits")
    return bucketed.join(F.broadcast(wanted), ["block", "bits"]).groupBy("sk").agg(*[F.first(n).alias(n) for n in names])


QUERY_TILE = 64


def coarse_many(memories: DataFrame, queries: DataFrame, n: int, most_queries: int = 10_000) -> DataFrame:
    """(qid, sk, ham, r): the n nearest of each query by (Hamming distance, key), in one job.

    The queries (at most `most_queries`) are sent to the tasks; a task keeps the n nearest rows
    of each Arrow batch, and only those are ranked.
    """
    names = [c for c in memories.columns if c[0] == "w" and c[1:].isdigit()]
    few = queries.select("id", *names).limit(most_queries + 1).toArrow()
    if len(few) > most_queries:
        raise ValueError(f"at most {most_queries} queries at a time")
    words = lambda table: np.stack([np.asarray(table.column(c)).view(np.uint64) for c in range(1, 1 + len(names))])
    sent = memories.sparkSession.sparkContext.broadcast((few["id"].to_numpy(), words(few)))

    def nearest(batches):
        ids, asked = sent.value
        for batch in batches:
            own, many = words(batch), batch.num_rows
            place = np.empty(many, np.int64)
            place[np.argsort(np.array(batch.column(0).to_pylist(), dtype=object), kind="stable")] = np.arange(many)
            for lo in range(0, len(ids), QUERY_TILE):
                tile = asked[:, lo : lo + QUERY_TILE]
                ham = np.zeros((tile.shape[1], many), np.int64)
                for a, b in zip(tile, own, strict=True):
                    ham += np.bitwise_count(a[:, None] ^ b[None, :])
                order = ham * many + place
                at = np.argpartition(order, n - 1, axis=1)[:, :n] if many > n else np.broadcast_to(np.arange(many), order.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo : lo + QUERY_TILE], at.shape[1])), batch.column(0).take(pa.array(at.ravel())), pa.array(np.take_along_axis(ham, at, 1).ravel().astype(np.int32))], ["qid", "sk", "ham"])

    near = memories.select("sk", *names).mapInArrow(nearest, "qid long, sk string, ham int")
    return near.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("ham", "sk"))).filter(F.col("r") <= n).select("qid", "sk", "ham", "r")


def coarse_recall_quality(memories: DataFrame, queries: DataFrame, k: int, factors: list[int], most_queries: int = 10_000) -> DataFrame:
    """Share of the exact cosine top-k among the k * factor coarse candidates, over all queries (broadcast, at most `most_queries`)."""
    near = coarse_many(memories, queries, k * max(factors), most_queries).select("qid", "sk", F.col("r").alias("rh"))
    q = F.broadcast(queries.select(F.col("id").alias("qid"), F.col("embedding").alias("qv")))
    pairs = memories.select("sk", "embedding").join(q).select("qid", "sk", S.cosine_distance(F.col("embedding"), F.col("qv")).alias("d"))
    exact = pairs.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("d", "sk"))).filter(F.col("r") <= k).select("qid", "sk")
    hits = [F.count_if(F.col("rh") <= k * f).alias(str(f)) for f in factors]
    total = exact.join(near, ["qid", "sk"], "left").agg(F.count(F.lit(1)).alias("n"), *hits)
    rows = F.array(*[F.struct(F.lit(f).alias("factor"), (F.col(str(f)) / F.col("n")).alias("share")) for f in factors])
    return total.select(F.explode(rows).alias("r")).select("r.factor", "r.share")


def many_recalls(memories: DataFrame, queries: DataFrame, k: int, oversample: int, most_queries: int = 10_000) -> DataFrame:
    """(qid, sk, score): the k nearest of each query in one job, cut by Hamming distance first; `queries` has (id, embedding, w0...)."""
    pool = coarse_many(memories, queries, k * oversample, most_queries).select("qid", "sk")
    vectors = queries.select(F.col("id").alias("qid"), F.col("embedding").alias("qv"))
    both = pool.join(memories.select("sk", "embedding"), "sk").join(F.broadcast(vectors), "qid")
    scores = both.select("qid", "sk", F.floor(S.cosine_distance(F.col("embedding"), F.col("qv")) * 10000).cast("long").alias("score"))
    return scores.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("score", "sk"))).filter(F.col("r") <= k).select("qid", "sk", "score")
