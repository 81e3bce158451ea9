"""Exact top-k inner-product search pruned by multi-resolution segment statistics.

Vectors are quantised to integers floor(scale * x).  At each resolution a vector is
cut into segments; with a segment's mean m, deviation s and length L, the squared
distance of two vectors is at least sum L * ((m1 - m2)^2 + (s1 - s2)^2).  With the
squared norms this lower bound on the distance is an upper bound on the inner
product, q.c = (|q|^2 + |c|^2 - d^2) / 2.  Bounds go from coarse to fine; a candidate
survives a level if its bound reaches the query's mark, the k-th best score known so
far, and exact integer scores are computed for the survivors of all levels only.

Queries are sent in blocks of at most `block` components; tasks read the candidates where
they lie, so neither side is copied or collected.  Marks start from the `SEEDS` longest
vectors and rise while a task reads on.  Each task returns its best rows that reach the
mark; the k best of those are the answer.  Ties go to the smaller id.

Rows that are null, empty, or hold null or non-finite components take no part.  Only
vectors of one length have a product, so each length is searched by itself.  Rows repeated
under one id are candidates one by one.  An empty table gives an empty result; extra
columns are ignored.  Scores are exact at any size of the components; a component or a
result past BIGINT raises an error.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import map_texts, materialize

RESOLUTIONS = (1, 4, 16, 32)
BLOCK = 1 << 20
SEEDS = 2048
QUERY_TILE, ROW_TILE = 1024, 1024
DENSE = 8  # above this share of a tile's pairs, one matrix product is cheaper than picked rows
SLACK = 1e-9  # of the product of the norms: far above the rounding of a bound
MOST, LEAST = (1 << 63) - 1, -(1 << 63)


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(L)-weighted means and deviations, so that plain distances of rows bound those of `x`."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    size = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    rest = x - np.repeat(mean, size, axis=1)
    dev = np.sqrt(np.add.reduceat(rest * rest, edges[:-1], axis=1) / size)
    return np.concatenate((mean * np.sqrt(size), dev * np.sqrt(size)), 1)


class Side:
    """Vectors of one length with their norms and statistics."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.wide = x.astype(np.float64)
        self.norm = np.sqrt((self.wide * self.wide).sum(1))
        self.levels = [segment_statistics(self.wide, s) for s in RESOLUTIONS if s < x.shape[1]]


def products(q: np.ndarray, c: np.ndarray, largest: float) -> np.ndarray:
    """Row by row integer inner products; `largest` bounds the product of the norms."""
    if largest < 2**52:  # every partial sum is an integer that a double holds
        return np.einsum("ij,ij->i", q.astype(np.float64), c.astype(np.float64)).astype(np.int64)
    if largest < 2**62:
        return np.einsum("ij,ij->i", q, c)
    wide = (q.astype(object) * c.astype(object)).sum(1)
    if any(not LEAST <= s <= MOST for s in wide):
        raise OverflowError("an inner product is past BIGINT")
    return wide.astype(np.int64)


class Search:
    """The k best rows of each query among those seen so far."""

    def __init__(self, queries: Side, k: int, marks: np.ndarray | None = None):
        self.q, self.k = queries, k
        self.marks = np.full(len(queries.ids), LEAST, np.int64) if marks is None else marks.copy()
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_held = 0
        self.tested = np.zeros(len(queries.levels) + 1, np.int64)  # pairs that reach each level, and scored ones

    def see(self, rows: Side) -> None:
        for at in range(0, len(self.q.ids), QUERY_TILE):
            tile = slice(at, min(at + QUERY_TILE, len(self.q.ids)))
            for lo in range(0, len(rows.ids), ROW_TILE):
                self._tile(tile, rows, slice(lo, min(lo + ROW_TILE, len(rows.ids))))
                if self.n_held > 4 * self.k * len(self.q.ids) + (1 << 20):
                    self.cut()

    def _tile(self, tile: slice, rows: Side, part: slice) -> None:
        q, marks = self.q, self.marks[tile]
        mark = (marks.astype(np.float64) - SLACK * q.norm[tile] * rows.norm[part].max())[:, None]
        alive = q.ids[tile, None] != rows.ids[None, part]
        for level, (own, other) in enumerate(zip(q.levels, rows.levels, strict=True)):
            # 2 q.c <= |q|^2 + |c|^2 - bound is own . other, as norms split over segments
            n = int(alive.sum())
            self.tested[level] += n
            if n * DENSE > alive.size:
                alive &= own[tile] @ other[part].T >= mark
            else:
                i, j = np.nonzero(alive)
                alive[i, j] = np.einsum("ij,ij->i", own[tile][i], other[part][j]) >= mark[i, 0]
        n = int(alive.sum())
        self.tested[-1] += n
        largest = float(q.norm[tile].max() * rows.norm[part].max())
        if n * DENSE > alive.size and largest < 2**52:  # many survivors: one product of doubles that hold every partial sum
            score = q.wide[tile] @ rows.wide[part].T
            i, j = np.nonzero(alive & (score >= marks[:, None]))
            score = score[i, j].astype(np.int64)
        else:
            i, j = np.nonzero(alive)
            step = max(1, (1 << 22) // q.x.shape[1])
            score = [products(q.x[tile][i[a : a + step]], rows.x[part][j[a : a + step]], largest) for a in range(0, len(i), step)]
            score = np.concatenate(score or [np.zeros(0, np.int64)])
            good = score >= marks[i]
            i, j, score = i[good], j[good], score[good]
        self.held.append((i + tile.start, rows.ids[part][j], score))
        self.n_held += len(i)

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row id, score) of the k best of each query; marks rise to the k-th."""
        i, ids, score = (np.concatenate([h[c] for h in self.held] or [np.zeros(0, np.int64)]) for c in range(3))
        order = np.lexsort((ids, -score.astype(np.float64), i)) if not len(score) or np.abs(score).max() < 2**53 else np.array(sorted(range(len(i)), key=lambda r: (i[r], -int(score[r]), ids[r])), np.int64)
        i, ids, score = i[order], ids[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        last = rank == self.k - 1
        self.marks[i[last]] = np.maximum(self.marks[i[last]], score[last])
        best = rank < self.k
        self.held = [(i[best], ids[best], score[best])]
        self.n_held = int(best.sum())
        return self.held[0]


def sides(ids: np.ndarray, column: pa.Array) -> dict[int, Side]:
    """The rows of a list column, by length."""
    ends = column.offsets.to_numpy()
    flat, length = column.values.to_numpy(), np.diff(ends)
    out = {}
    for n in np.unique(length).tolist():
        own = np.flatnonzero(length == n)
        out[n] = Side(ids[own], flat[ends[:-1][own][:, None] + np.arange(n)])
    return out


def _usable(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    x = F.col("v")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda e: e.cast("double")).alias("v"))
    kept = kept.filter(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad)
    return kept.select("id", F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _collected(rows: DataFrame) -> dict[int, Side]:
    found = rows.toArrow()
    column = found["v"].combine_chunks()
    return sides(found["id"].to_numpy(), column) if len(found) else {}


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score); `is_query` is a condition on the id column `id`."""
    spark = vectors.sparkSession
    rows = materialize(_usable(vectors, id_col, vec_col, scale))
    queries = rows.filter(is_query)
    size = queries.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0]
    norm = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)
    seeds = _collected(rows.orderBy(F.desc(norm), "id").limit(SEEDS))
    blocks = max(1, -(-size // block))
    parts = []
    for b in range(blocks):
        own = _collected(queries.filter(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b))
        marks = {}
        for n, q in own.items():
            first = Search(q, k)
            if n in seeds:
                first.see(seeds[n])
            first.cut()
            marks[n] = first.marks
        sent = spark.sparkContext.broadcast({n: (q.ids, q.x, marks[n]) for n, q in own.items()})
        found = map_texts(rows, _searcher(sent, k), "query_id long, vec_id long, score long")
        if blocks > 1:
            found = materialize(found)
            sent.unpersist()
        parts.append(found)
    found = reduce(DataFrame.union, parts)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _searcher(sent, k: int):
    def run(batches):
        state = {n: Search(Side(ids, x), k, marks) for n, (ids, x, marks) in sent.value.items()}
        for batch in batches:
            for n, own in sides(batch.column(0).to_numpy(), batch.column(1)).items():
                if n in state:
                    state[n].see(own)
        for search in state.values():
            i, ids, score = search.cut()
            yield pa.RecordBatch.from_arrays([pa.array(search.q.ids[i]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    return run
