"""Near-duplicate classes by a size-aware heavy-light Jaccard join of word shingles.

A document's set holds its distinct shingles of `size` words (words are runs without
white space, A-Z lower-cased); a text of fewer words has its whole sequence as the one
shingle; a text without words has the empty set and links with nothing.  Two documents
link when 100 * intersection >= percent * union.  A class is a connected component of
the links; it is named by its smallest document id.

1. Documents with equal sets become one node, so copies are never paired.
2. Sure links first: nodes that agree in a band of one-permutation minima are compared
   with the band's head, drawn anew in each of `TURNS` turns, and those that truly link
   are contracted.  This only saves work in groups of near copies; a pair it misses is
   found in step 3 or 4.
3. Light nodes (at most `boundary` shingles): all subsets of the fixed size that two
   linked sets of given sizes must share are enumerated; an equal subset is a link.
4. Heavy nodes: inverted lists over the necessary prefix of each set, rarest shingles
   first, are scanned with length, positional, class and sketch filters, and the
   surviving pairs of different classes of step 2 are verified on their whole sets.
   Lists within one class are dropped before.  A sketch holds the parity of a set's
   shingles by hash bucket; two sketches differ in no more bits than there are shingles
   that only one set has, so a list with many near misses makes few pairs.

Before texts are fetched for a pair of step 2 or 4, its outlines are compared: the counts
of a set's shingles by hash bucket.  Their distance never exceeds the number of shingles
that only one set has, so a pair whose outlines are too far apart can't link.

The boundary is the size with the lowest estimated cost of 3 and 4: subsets to write
against list entries to scan, by the lists' lengths.  Nodes just below it also enter the
lists, as a heavy partner may be that small.

"Rarest first" is a total order by a count and then by hash.  The count is that of all
shingles of different sets (within a task) that share one of `COUNTERS` counters; it
covers every document in a table of fixed size.  Any total order gives the same links.

Nulls have no words.  Rows repeated under one id are rows of that id, answered alike.
Rows with null ids take part but never name a class unless all ids are null.  Empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import map_texts, materialize, release
from .components import components

BINS = 16
COUNTERS, COUNTER_SLICE = 1 << 22, 1 << 16
BITMAP_BITS = 1 << 23
SKETCH_WORDS = 8
MOST_LIGHT = 12
SCAN_COST = 2.0  # of reading a list entry, against writing a subset
RARITY_STEPS = 1500  # per doubling
PAIR_BATCH = 64
TURNS = 5


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int):
    """The sorted distinct shingle hashes of each text."""
    raw = T.LOWER[raw]
    starts, lengths, first = T.words(raw, offsets, T.SPACE_WORD)
    hashes = T.word_hashes(raw, starts, lengths)
    runs = T.shingles(hashes, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            yield T.sequence_hash(hashes[a:b])
        else:
            yield np.zeros(0, np.uint64)


def set_name(s: np.ndarray) -> int:
    """A 64-bit name of a set; 0 for the empty one."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        total = T.mix(s).sum(dtype=np.uint64) * T._SHINGLE[7] + np.uint64(len(s))
    return int(T.mix(np.array([total], np.uint64)).view(np.int64)[0]) or 1


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact condition on two sorted sets."""
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return bool(len(a) and len(b)) and 100 * inter >= percent * (len(a) + len(b) - inter)


def overlap(n: int, m: int, percent: int) -> int:
    """The least intersection with which sets of n and m elements link."""
    return -(-percent * (n + m) // (100 + percent))


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def subset_keys(s: np.ndarray, boundary: int, percent: int) -> list[tuple[int, int]]:
    """(key, kind) of the shared subsets of a light set; kind 1 for the smaller side, 2 for the larger, 3 for equal sizes."""
    out = []
    value = T.mix(s)
    with np.errstate(over="ignore"):
        for m in partner_sizes(len(s), percent):
            if m < 1 or m > boundary:
                continue
            kind = 3 if m == len(s) else 1 if m > len(s) else 2
            tag = np.uint64(min(m, len(s)) * 1000 + max(m, len(s)))
            picks = np.array(list(combinations(range(len(s)), overlap(len(s), m, percent))), np.int64)
            sums = value[picks].sum(1, dtype=np.uint64) if len(picks) else np.zeros(0, np.uint64)
            out += [(k, kind) for k in T.mix(sums ^ T.mix(np.array([tag]))[0]).view(np.int64).tolist()]
    return out


def choose_boundary(sizes: dict[int, tuple[int, float]], percent: int) -> int:
    """The light-heavy boundary of least cost.  sizes: for each small set size, how many sets have it and the total length of the inverted lists of their prefixes."""

    def cost(limit: int) -> float:
        total = 0.0
        for n, (count, scanned) in sizes.items():
            if n <= limit:
                total += count * sum(comb(n, overlap(n, m, percent)) for m in partner_sizes(n, percent) if 1 <= m <= limit)
            if 100 * n > percent * limit:
                total += scanned * SCAN_COST
        return total

    return min(range(MOST_LIGHT + 1), key=lambda b: (cost(b), b))


def _small_sizes(nodes: DataFrame, rarity: np.ndarray, percent: int) -> dict[int, tuple[int, float]]:
    """What `choose_boundary` asks for; a list is as long as its shingle's counter says."""
    sent = nodes.sparkSession.sparkContext.broadcast(rarity)

    def measure(batches):
        order = sent.value
        for batch in batches:
            n, scanned = [], []
            for packed in batch.column(0).to_pylist():
                s = np.frombuffer(packed, np.uint64)
                places = (_prefix(s, order, prefix_length(len(s), percent)) & np.uint64(COUNTERS - 1)).astype(np.int64)
                n.append(len(s))
                scanned.append(float((np.exp2(order[places] / RARITY_STEPS) - 1).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(scanned, pa.float64())], ["n", "scanned"])

    small = map_texts(nodes.filter("small is not null").select("small"), measure, "n long, scanned double")
    return {r["n"]: (r["c"], r["s"]) for r in small.groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.sum("scanned").alias("s")).collect()}  # a row for each small size


def outline(s: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall into each bucket; the number of buckets, a power of two, grows until a byte holds every count."""
    buckets = max(64, 1 << (len(s) // 4).bit_length())
    while True:
        counts = np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        buckets *= 2


def outline_distance(x: np.ndarray, y: np.ndarray) -> int:
    """At most the number of shingles that only one of the two sets has."""
    buckets = min(len(x), len(y))
    x, y = (v.reshape(-1, buckets).sum(0, dtype=np.int64) for v in (x, y))
    return int(np.abs(x - y).sum())


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity of a set's shingles in each of 64 * SKETCH_WORDS buckets, as 64-bit words."""
    place = (s >> np.uint64(20)) & np.uint64(64 * SKETCH_WORDS - 1)
    odd = np.bincount(place.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """One row (kind 0) for each document: its set's name, size, minima and outline; and rows (kind 1) of a task's counters."""
    names = ["kind", "doc_id", "text_key", "node", "n", *[f"m{j}" for j in range(BINS)], "packed", "small"]

    def run(batches):
        edges = np.arange(BINS, dtype=np.uint64) << np.uint64(60)
        counts, seen = np.zeros(COUNTERS, np.int64), {0}
        held, held_n = [], 0

        def add() -> None:
            place, n = np.unique(np.concatenate(held), return_counts=True)
            counts[place.astype(np.int64)] += n

        for batch in batches:
            column = T.text_column(batch, "text")
            for lo, hi in T.slices(column):
                node, n, packed, small = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64), [], []
                minima = np.zeros((BINS, hi - lo), np.int64)
                for k, s in enumerate(shingle_sets(*T.flat(column, lo, hi), size)):
                    node[k], n[k] = set_name(s), len(s)
                    at = np.searchsorted(s, edges)
                    end = np.append(at[1:], len(s))
                    some = at < end
                    minima[some, k] = s[at[some]].view(np.int64)
                    packed.append(outline(s).tobytes())
                    small.append(s.tobytes() if 0 < len(s) <= 2 * MOST_LIGHT else None)
                    if node[k] not in seen:
                        seen.add(int(node[k]))
                        held.append(s & np.uint64(COUNTERS - 1))
                        held_n += len(s)
                if held_n > 1_000_000:
                    add()
                    held.clear()
                    held_n = 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(hi - lo, np.int32)), batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(node), pa.array(n), *[pa.array(m) for m in minima], pa.array(packed, pa.binary()), pa.array(small, pa.binary())],
                    names,
                )
        if held:
            add()
        keys, values = _pack(counts)
        zero = pa.array(np.zeros(len(keys), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int32)), zero, zero, pa.array(keys, pa.int64()), zero, *[zero] * BINS, pa.array(values, pa.binary()), pa.nulls(len(keys), pa.binary())], names)

    schema = "kind int, doc_id long, text_key long, node long, n long, " + "".join(f"m{j} long, " for j in range(BINS)) + "packed binary, small binary"
    return map_texts(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), run, schema)


def _pack(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The slices of a counter table that aren't all zero."""
    rows = counts.reshape(-1, COUNTER_SLICE)
    keys = np.flatnonzero(rows.any(1)).tolist()
    return keys, [zlib.compress(rows[k].astype("<i8").tobytes(), 1) for k in keys]


def _add_counters(parts: DataFrame) -> DataFrame:
    """Sums of counter slices (node, packed); a partition holds one table, however many parts it reads."""

    def run(batches):
        counts = np.zeros((COUNTERS // COUNTER_SLICE, COUNTER_SLICE), np.int64)
        for batch in batches:
            for key, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[key] += np.frombuffer(zlib.decompress(packed), "<i8")
        keys, values = _pack(counts)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.binary())], ["node", "packed"])

    return map_texts(parts.select("node", "packed"), run, "node long, packed binary")


def _rarity(scanned: DataFrame) -> np.ndarray:
    """The counters of all tasks on a fine logarithmic scale, in 16 bits each."""
    parts = scanned.filter("kind = 1").select("node", "packed")
    some = _add_counters(parts.repartition("node", F.pmod(F.xxhash64("packed"), F.lit(16))))
    counts = np.zeros((COUNTERS // COUNTER_SLICE, COUNTER_SLICE), np.int64)
    for r in _add_counters(some.repartition("node")).collect():  # one row for each slice
        counts[r["node"]] = np.frombuffer(zlib.decompress(r["packed"]), "<i8")
    return np.minimum(np.log2(1 + counts.ravel()) * RARITY_STEPS, 65535).astype(np.uint16)


def _prefix(s: np.ndarray, rarity: np.ndarray, length: int) -> np.ndarray:
    """The first shingles of a sorted set in the total order."""
    order = np.argsort(rarity[(s & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
    return s[order[:length]]


def _prefixes(docs: DataFrame, rarity: np.ndarray, size: int, percent: int, boundary: int) -> DataFrame:
    """(doc_id, node, n, tokens of the prefix, subset keys and kinds, sketch)."""
    sent = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches):
        order = sent.value
        for batch in batches:
            column = T.text_column(batch, "text")
            for lo, hi in T.slices(column):
                node, n, tokens, keys, kinds, sketches = [], [], [], [], [], []
                for s in shingle_sets(*T.flat(column, lo, hi), size):
                    node.append(set_name(s))
                    n.append(len(s))
                    scan = len(s) > 0 and 100 * len(s) > percent * boundary
                    tokens.append(_prefix(s, order, prefix_length(len(s), percent)).view(np.int64) if scan else None)
                    own = subset_keys(s, boundary, percent) if 0 < len(s) <= boundary else []
                    keys.append([k for k, _ in own])
                    kinds.append([k for _, k in own])
                    sketches.append(sketch(s) if scan else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int32())), pa.array(sketches, pa.list_(pa.int64()))],
                    ["doc_id", "node", "n", "tokens", "keys", "kinds", "sketch"],
                )

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, node long, n long, tokens array<long>, keys array<long>, kinds array<int>, sketch array<long>")


def _plausible(nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) of nodes whose sizes and outlines allow a link."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    ends = nodes.select("node", "n", "packed")
    both = pairs.join(ends.toDF("a", "_n", "_x"), "a").join(ends.toDF("b", "_m", "_y"), "b").select(*kinds, "_n", "_m", "_x", "_y")

    def test(batches):
        for batch in batches:
            n, m, x, y = (batch.column(k).to_pylist() for k in range(len(kinds), len(kinds) + 4))
            good = [outline_distance(np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)) <= i + j - 2 * overlap(i, j, percent) for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield batch.select(list(range(len(kinds)))).filter(pa.array(good, pa.bool_()))

    return materialize(map_texts(both, test, ", ".join(f"{c} {t}" for c, t in kinds.items())))


def _verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes that link, tested on their whole sets."""
    pairs = materialize(pairs)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(ends.join(nodes.select("node", "least_doc", "least_key"), "node"))
    # A bitmap of fixed size keeps most texts that no pair needs out of the shuffle; the join below is exact.
    slot = F.pmod(F.xxhash64(F.coalesce("doc_id", "text_key")), F.lit(BITMAP_BITS))
    bits = np.zeros(BITMAP_BITS, np.uint8)
    place = F.col("slot") + 1  # buckets count from 1
    filled = wanted.select(F.col("least_doc").alias("doc_id"), F.col("least_key").alias("text_key")).select(slot.alias("slot")).groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    for r in filled.collect():  # BITMAP_BITS / 8 bytes at most
        bits[np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")) + 32768 * (r["k"] - 1)] = 1
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def select(batches):
        packed = sent.value
        for batch in batches:
            slots = batch.column(3).to_numpy(zero_copy_only=False)
            mask = (packed[slots >> 3] >> (7 - (slots & 7))) & 1
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(mask.astype(bool))) for c in batch.columns[:3]], ["doc_id", "text_key", "text"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").withColumn("slot", slot)
    found = map_texts(keyed, select, "doc_id long, text_key long, text string")
    texts = found.join(wanted.select("node", F.col("least_doc").alias("doc_id")), "doc_id").select("node", "text")
    nameless = wanted.filter("least_doc is null").select("node", F.col("least_key").alias("text_key"))
    if not nameless.isEmpty():  # sets that only rows with null ids hold: one of the rows with the text
        more = found.filter("doc_id is null").join(nameless, "text_key").dropDuplicates(["node", "text_key"])
        texts = texts.unionByName(more.select("node", "text"))
    texts = materialize(texts)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def test(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            good = np.zeros(len(a), bool)
            for lo in range(0, len(a), PAIR_BATCH):
                hi = min(lo + PAIR_BATCH, len(a))
                x = shingle_sets(*T.flat(T.text_column(batch, "x"), lo, hi), size)
                y = shingle_sets(*T.flat(T.text_column(batch, "y"), lo, hi), size)
                for k, (s, t) in enumerate(zip(x, y, strict=True), lo):
                    good[k] = links(s, t, percent) and set_name(s) == a[k] and set_name(t) == b[k]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], ["a", "b"])

    found = materialize(map_texts(both.select("a", "b", "x", "y"), test, "a long, b long"))
    release(pairs, wanted, texts)
    return found


def _head_pairs(banded: DataFrame, classed: DataFrame, turn: int) -> DataFrame:
    """For each node that agrees in a band with a head of another class: the head it agrees with most.

    A band's head is drawn anew each turn, so a node that doesn't link with one member of a group meets another.
    """
    order = F.xxhash64(F.lit(turn), "node")
    rows = banded.join(classed.select("node", "class"), "node")
    heads = rows.groupBy("band").agg(F.min_by("node", order).alias("head"), F.min_by("class", order).alias("head_class"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    heads = materialize(heads.filter("lo <> hi").select("band", "head", "head_class"))
    agree = rows.join(heads, "band").filter("class <> head_class").groupBy("node", "head").agg(F.count(F.lit(1)).alias("c"))
    best = agree.groupBy("node").agg(F.max_by("head", "c").alias("head"))
    return best.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def _between(pairs: DataFrame, classed: DataFrame) -> DataFrame:
    """Pairs whose nodes are in different classes x, y now."""
    a = classed.select(F.col("node").alias("a"), F.col("class").alias("x"))
    b = classed.select(F.col("node").alias("b"), F.col("class").alias("y"))
    return pairs.join(a, "a").join(b, "b").filter("x <> y")


def _contract(classed: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after uniting those that linked nodes (a, b) belong to."""
    a = classed.select(F.col("node").alias("a"), F.col("class").alias("x"))
    b = classed.select(F.col("node").alias("b"), F.col("class").alias("y"))
    roots = components(links.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    if roots is None:
        return classed
    roots = materialize(roots.withColumnRenamed("node", "class"))
    joined = classed.join(roots, "class", "left").select("node", "n", "least_doc", F.coalesce("root", "class").alias("class"))
    return materialize(joined)


def jaccard_classes(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key = xxhash64(text), n_shingles, component_id, class), one row for each input row; `class` tells classes apart even where no row has an id, and is null for texts without words."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scanned = materialize(_scan(docs, size))
    rows = scanned.filter("kind = 0").select("doc_id", "text_key", "node", "n")
    minima = [F.min(f"m{j}").alias(f"m{j}") for j in range(BINS)]
    nodes = materialize(scanned.filter("kind = 0 and n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("least_doc"), F.min("text_key").alias("least_key"), F.first("packed").alias("packed"), F.first("small").alias("small"), *minima))
    rarity = _rarity(scanned)
    boundary = choose_boundary(_small_sizes(nodes, rarity, percent), percent)

    bands = F.array(*[F.when((F.col(f"m{j}") != 0) & (F.col(f"m{j + 1}") != 0), F.xxhash64(F.lit(j), f"m{j}", f"m{j + 1}")) for j in range(0, BINS, 2)])
    banded = nodes.select("node", F.explode(bands).alias("band")).filter("band is not null")
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("band")
    banded = materialize(banded.join(shared, "band"))
    classed = materialize(nodes.select("node", "n", "least_doc", F.col("node").alias("class")))
    for turn in range(TURNS):
        drawn = _plausible(nodes, _head_pairs(banded, classed, turn), percent)
        if drawn.isEmpty():
            break
        classed = _contract(classed, _verify(docs, nodes, drawn, size, percent))

    coded = _prefixes(docs, rarity, size, percent, boundary).filter("n > 0").join(classed.drop("n"), "node").filter(F.col("doc_id").eqNullSafe(F.col("least_doc")))
    coded = materialize(coded.dropDuplicates(["node"]).select("node", "n", "class", "tokens", "keys", "kinds", "sketch"))
    light = coded.select("node", F.explode(F.arrays_zip("keys", "kinds")).alias("k")).select("node", "k.keys", "k.kinds")
    heads = light.groupBy("keys").agg(F.min("node").alias("head"), F.bit_or("kinds").alias("sides"), F.count(F.lit(1)).alias("c"))
    heads = materialize(heads.filter("sides = 3 and c > 1").select("keys", "head"))
    subset_links = light.join(heads, "keys").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()

    posted = coded.filter("tokens is not null").select("node", "n", "class", F.posexplode("tokens").alias("pos", "token"))
    lists = posted.groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    lists = materialize(lists.filter("lo <> hi").select("token"))
    words = [f"w{k}" for k in range(SKETCH_WORDS)]
    sketches = coded.filter("tokens is not null").select("node", *[F.col("sketch")[k].alias(w) for k, w in enumerate(words)])
    posted = materialize(posted.join(lists, "token").join(sketches, "node"))
    fields = ("node", "n", "class", "pos", *words)
    a = posted.select("token", *[F.col(c).alias(f"a_{c}") for c in fields])
    b = posted.select("token", *[F.col(c).alias(f"b_{c}") for c in fields])
    total = F.col("a_n") + F.col("b_n")
    spare = total - 2 * F.ceil(total * percent / F.lit(100.0 + percent))  # the most shingles that only one of two linked sets has
    apart = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in words), F.lit(0))
    near = (
        (a["token"] == b["token"])
        & (F.col("a_node") < F.col("b_node"))
        & (F.col("a_class") != F.col("b_class"))
        & (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
        & (F.col("a_pos") + F.col("b_pos") <= spare)
        & (apart <= spare)
    )
    pairs = a.join(b, near).groupBy(F.col("a_node").alias("a"), F.col("b_node").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    pairs = _plausible(nodes, pairs, percent)
    classed = _contract(classed, subset_links)
    # Of a node's pairs with one class, first the likeliest: where it links, the others are settled.
    likely = _between(pairs, classed).groupBy("a", "y").agg(F.max_by("b", "shared").alias("b")).select("a", "b")
    classed = _contract(classed, _verify(docs, nodes, likely, size, percent))
    classed = _contract(classed, _verify(docs, nodes, _between(pairs, classed).select("a", "b"), size, percent))

    release(banded, coded, heads, lists, posted, pairs)
    least = materialize(classed.groupBy("class").agg(F.min("least_doc").alias("component_id")))
    named = materialize(classed.join(least, "class").select("node", "component_id", "class"))
    return rows.join(named, "node", "left").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "class")
