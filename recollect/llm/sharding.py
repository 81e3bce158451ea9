"""Longest-processing-time sharding of documents whose equal texts stay together.

Law `bytes`: shard sizes are near equal.  A group is the set of rows with equal texts.
All groups are scheduled in order of falling size, each to the least loaded shard.  Groups
of one size are interchangeable, so the heap needs only how many groups each size has: few
of one size are taken from the heap one by one, many at once by the level to which they
fill the shards, with the same result.  That table comes to the driver; D different sizes
need at least D * D / 2 bytes of text, so it has at most sqrt(2 * bytes) rows, whatever the
number of documents.  A group's place among those of its size then says its shard.

Null texts count as empty ones.  Repeated rows are rows of the same group and get
a slot each.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import join_hot, materialize

OVERHEAD = 8
ONE_BY_ONE = 256
SENT = 200_000
ROWS_PER_RUN = 50_000
LEAST_RUNS = 64


def schedule(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Longest-processing-time rule: (key, size) items to shards, least loaded first."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def _filled(loads: np.ndarray, size: int, many: int) -> np.ndarray:
    """How many of `many` items of one size each shard gets: the least of the loads at which items would be put, loads[j] + m * size."""
    put = lambda level: np.maximum((level - loads) // size + 1, 0)  # noqa: E731  items put at loads up to this level
    lo, hi = int(loads.min()) - 1, int(loads.min()) + size * many
    while lo + 1 < hi:  # put(lo) holds at most `many` items, put(hi) more
        middle = (lo + hi) // 2
        lo, hi = (middle, hi) if put(middle).sum() <= many else (lo, middle)
    out = put(lo)
    next_ = np.flatnonzero(put(lo + 1) > out)[: many - int(out.sum())]
    out[next_] += 1
    return out


def schedule_sizes(sizes: np.ndarray, counts: np.ndarray, shards: int) -> np.ndarray:
    """How many groups of each size (falling) go to each shard, by the same rule."""
    out = np.zeros((len(sizes), shards), np.int64)
    heap = [(0, s) for s in range(shards)]
    for row, (size, many) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
        if many <= ONE_BY_ONE:
            for _ in range(many):
                load, shard = heap[0]
                out[row, shard] += 1
                heapq.heapreplace(heap, (load + size, shard))
        else:
            loads = np.array([load for load, _ in sorted(heap, key=lambda x: x[1])], np.int64)
            out[row] = _filled(loads, size, many)
            heap = [(int(load), s) for s, load in enumerate(loads + size * out[row])]
            heapq.heapify(heap)
    return out


def _placed_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(group, n, shard) of all groups (group, bytes, n)."""
    found = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("c")).toArrow().sort_by([("bytes", "descending")])
    sizes, counts = found["bytes"].to_numpy(), found["c"].to_numpy()
    ends = np.cumsum(schedule_sizes(sizes, counts, shards), axis=1)
    by_size = groups.sparkSession.createDataFrame(
        [(int(s), int(c), e.tolist()) for s, c, e in zip(sizes, counts, ends, strict=True)], "bytes long, c long, ends array<long>"
    )
    # The place of a group among those of its size, without sorting a size in one task.
    runs = max(LEAST_RUNS, int(counts.sum()) // 1_000_000) if len(counts) else 1
    rows = groups.withColumn("run", F.pmod(F.xxhash64(F.lit(1), "group"), F.lit(runs)))
    before = Window.partitionBy("bytes").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("bytes", "run").agg(F.count(F.lit(1)).alias("m")).select("bytes", "run", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bytes", "run").orderBy("group")
    ranked = rows.withColumn("r", F.row_number().over(inside)).join(offsets, ["bytes", "run"]).select("group", "n", "bytes", (F.col("offset") + F.col("r") - 1).alias("place"))
    placed = join_hot(ranked, materialize(by_size), ["bytes"], "c", SENT)
    return placed.select("group", "n", F.size(F.filter("ends", lambda e: e <= F.col("place"))).alias("shard"))


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    )
    rows = materialize(rows)
    groups = materialize(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    n_rows = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    runs = max(LEAST_RUNS, -(-n_rows // (shards * ROWS_PER_RUN)))
    found = join_hot(rows, materialize(_placed_groups(groups, shards)), ["group"], "n", SENT)
    placed = materialize(found.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(runs)).alias("run")))
    # Gapless slots without sorting a shard in one task: number inside short runs, add the runs' offsets.
    counts = placed.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    return placed.join(offsets, ["shard", "run"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
