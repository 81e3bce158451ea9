"""Perplexity under an interpolated modified Kneser-Ney model of byte n-grams.

A text is preceded by line ends and its digits are one symbol; the model predicts each
UTF-8 byte from the `ORDER - 1` bytes before it.  All n-grams of all trusted documents are
counted and none is dropped, so the tables grow with the trusted text.  Orders below the
highest use continuation counts, and every order has its own three discounts.

The trusted documents are halved by a hash of their text and each half makes a model.  A
trusted document is scored by the half it is not in, any other one by the mean
log-probability of both; so trusted perplexities are those of texts not seen, and serve as limits.

In back-off form log p(w | context) is the floor plus a sum of values of single n-grams:
for each order the gain of the n-gram and the weight of its context, where an n-gram that
the model lacks adds nothing.  So a document's log-probability is the sum of its n-grams'
values: an inner join of n-grams with the sharded table of values.  The `HEAD` most
frequent n-grams, the hot keys of that join, are sent to the tasks instead; that bounds
what is sent, not the model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import map_texts, materialize, release

ORDER = 6  # an n-gram and its order fit a BIGINT
HEAD = 1 << 21
SLICE = 1 << 21
HELD = 1 << 20
HALVES = ("a", "b")
OWN = ("row", "doc_id", "lang", "trusted", "half")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x30:0x3A] = 0x30


def _mask(n: int) -> int:
    return (1 << 8 * n) - 1


def _tag(n: int, context: bool = False) -> int:
    """Told apart in one key space: n-grams of each order, and the contexts of each order."""
    return (n + 8 * context) << 56


def grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ORDER-gram that ends at each byte, its last byte lowest."""
    b = _FOLD[raw].astype(np.int64)
    out = b.copy()
    for back in range(1, ORDER):
        before = np.full(len(b), 0x0A, np.int64)
        before[back:] = b[: max(len(b) - back, 0)]
        for k in range(back):  # the first bytes of each text look back at line ends
            at = offsets[:-1] + k
            before[at[at < offsets[1:]]] = 0x0A
        out |= before << (8 * back)
    return out


def parts_of(g: np.ndarray) -> list[np.ndarray]:
    """The keys whose values add up to the log-probability of each ORDER-gram."""
    own = [(g & _mask(n)) | _tag(n) for n in range(1, ORDER + 1)]
    return own + [((g >> 8) & _mask(n - 1)) | _tag(n, True) for n in range(2, ORDER + 1)]


def discounts(n: list[float]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, at index 1 to 3; n[k]: how many n-grams have count k."""
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] > 0 else 0.5
    d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] > 0 else y for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(v, 0.1), k - 0.1) for k, v in enumerate(d, 1))])  # some mass always goes to unseen n-grams


def _merged(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    return g, *(np.bincount(back, np.concatenate([h[k] for h in held]), len(g)).astype(np.int64) for k in (1, 2))


def count_grams(trusted: DataFrame, both: bool) -> DataFrame:
    """(g, a, b, f): each ORDER-gram's count in either half (in both, if there is one half only) and in all; tasks add up what they read first."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            column, half = T.text_column(batch), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in T.slices(column, SLICE):
                raw, offsets = T.flat(column, lo, hi)
                in_b = np.repeat(half[lo:hi] == 1, np.diff(offsets))
                code = grams(raw, offsets)
                held.append(_merged([(code, both | ~in_b, both | in_b)]))
                n += len(held[-1][0])
                if n > HELD:
                    held = [_merged(held)]
                    n = len(held[0][0])
                    if n > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["g", "a", "b"])
                        held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(held)], ["g", "a", "b"])

    found = map_texts(trusted.select("text", "half"), run, "g long, a long, b long")
    return found.groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("f", F.col("a") + F.col("b"))


def _tally(counts: DataFrame) -> dict:
    """Counts of counts, sums and discounted sums of both halves."""
    wanted = [F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in HALVES for k in range(1, 5)]
    more = [F.count_if(F.col(c) > 2).alias(f"{c}m") for c in HALVES] + [F.sum(c).alias(f"{c}t") for c in HALVES]
    return counts.agg(*wanted, *more).first().asDict()


def _off(count: Column, d: np.ndarray) -> Column:
    return F.when(count >= 3, float(d[3])).when(count == 2, float(d[2])).when(count == 1, float(d[1])).otherwise(0.0)


class ByteModel:
    """values: (key, f, a, b), the log-domain value of every n-gram and context in each half's model; floor: log-probability of an unknown byte."""

    def __init__(self, trusted: DataFrame):
        """trusted: (text, half) with half 0 or 1."""
        halves = {r["half"] for r in trusted.select("half").distinct().collect()}
        self.empty = not halves
        if self.empty:
            return
        counts = {ORDER: materialize(count_grams(trusted, len(halves) == 1))}
        for n in range(ORDER - 1, 0, -1):
            kinds = [F.count_if(F.col(c) > 0).alias(c) for c in HALVES]
            counts[n] = materialize(counts[n + 1].groupBy(F.col("g").bitwiseAND(F.lit(_mask(n))).alias("g")).agg(*kinds, F.sum("f").alias("f")))
        self.empty = counts[1].isEmpty()  # trusted texts without a byte
        if self.empty:
            return
        tally = {n: _tally(t) for n, t in counts.items()}
        d = {n: {c: discounts([0.0, *(float(tally[n][f"{c}{k}"]) for k in range(1, 5))]) for c in HALVES} for n in counts}
        self.floor, parts, lower, used = [], [], None, list(counts.values())
        for n in range(1, ORDER + 1):
            t = counts[n]
            if n == 1:
                p, low = {}, {}
                for c in HALVES:
                    total = tally[1][f"{c}t"] or 1
                    z = sum(float(d[1][c][k]) * tally[1][f"{c}{k}"] for k in (1, 2)) + float(d[1][c][3]) * tally[1][f"{c}m"]
                    low[c] = (z if tally[1][f"{c}t"] else 1.0) / total / 256
                    p[c] = (F.col(c) - _off(F.col(c), d[1][c])) / total + low[c]
                self.floor = [float(np.log(low[c])) for c in HALVES]
                made = t.select("g", "f", *(p[c].alias(f"p{c}") for c in HALVES), *((F.ln(p[c]) - f).alias(c) for c, f in zip(HALVES, self.floor, strict=True)))
            else:
                context = F.shiftright("g", 8)
                sums = [e for c in HALVES for e in (F.sum(_off(F.col(c), d[n][c])).alias(f"z{c}"), F.sum(c).alias(f"t{c}"))]
                weights = t.groupBy(context.alias("c")).agg(*sums, F.sum("f").alias("f"))
                weight = {c: F.when(F.col(f"t{c}") > 0, F.col(f"z{c}") / F.col(f"t{c}")).otherwise(1.0) for c in HALVES}
                weights = materialize(weights.select("c", "f", *(f"t{c}" for c in HALVES), *(weight[c].alias(f"w{c}") for c in HALVES)))
                used.append(weights)
                parts.append(weights.select(F.col("c").bitwiseOR(F.lit(_tag(n, True))).alias("key"), "f", *(F.ln(f"w{c}").alias(c) for c in HALVES)))
                suffix = F.col("g").bitwiseAND(F.lit(_mask(n - 1)))
                joined = t.withColumn("c", context).join(weights.drop("f"), "c").withColumn("s", suffix).join(lower.select(F.col("g").alias("s"), *(F.col(f"p{c}").alias(f"l{c}") for c in HALVES)), "s")
                known = {c: F.when(F.col(c) > 0, (F.col(c) - _off(F.col(c), d[n][c])) / F.col(f"t{c}")).otherwise(0.0) for c in HALVES}
                base = {c: F.col(f"w{c}") * F.col(f"l{c}") for c in HALVES}
                made = joined.select("g", "f", *((base[c] + known[c]).alias(f"p{c}") for c in HALVES), *(F.log1p(known[c] / base[c]).alias(c) for c in HALVES))
            lower = materialize(made)
            used.append(lower)
            parts.append(lower.select(F.col("g").bitwiseOR(F.lit(_tag(n))).alias("key"), "f", *HALVES))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        self.values = materialize(every.select("key", "f", *(F.col(c).cast("float").alias(c) for c in HALVES)))
        release(*used)

    def threshold(self, head: int) -> int:
        """The least frequency from which on at most `head` n-grams are left; 0 if that is all of them."""
        held = self.values.groupBy(F.least("f", F.lit(100_000)).alias("f")).count().collect()
        left = 0
        for r in sorted(held, key=lambda r: -r["f"]):
            left += r["count"]
            if left > head:
                return r["f"] + 1
        return 0


def _find(known: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is known, and where."""
    if not len(known):
        return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return known[at] == key, at


def score(docs: DataFrame, model: ByteModel, head: int = HEAD) -> DataFrame:
    """(doc_id, lang, trusted, n_bytes, perplexity), one row for each row of docs (doc_id, lang, text, trusted, half); empty texts have no perplexity."""
    if model.empty:
        return docs.select("doc_id", "lang", "trusted", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(None).cast("double").alias("perplexity"))
    least = model.threshold(head)
    top = model.values.filter(F.col("f") >= least).select("key", *HALVES).toArrow().sort_by("key")
    sent = docs.sparkSession.sparkContext.broadcast((top["key"].to_numpy(), *(top[c].to_numpy() for c in HALVES)))
    low = model.floor
    source = docs.withColumn("row", F.xxhash64("doc_id", "lang", "text"))

    def near(batches):
        known, *value = sent.value
        for batch in batches:
            column = T.text_column(batch)
            for lo, hi in T.slices(column, SLICE):
                raw, offsets = T.flat(column, lo, hi)
                g, back = np.unique(grams(raw, offsets), return_inverse=True)
                total = [np.full(len(g), f) for f in low]
                for key in parts_of(g):
                    hit, at = _find(known, key)
                    for s, v in zip(total, value, strict=True):
                        s += np.where(hit, v[at], 0.0) if len(v) else 0.0
                sums = []
                for s in total:
                    upto = np.concatenate(([0.0], np.cumsum(s[back])))
                    sums.append(pa.array(upto[offsets[1:]] - upto[offsets[:-1]]))
                own = [batch.column(c).slice(lo, hi - lo) for c in range(5)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(offsets)), *sums], [*OWN, "n_bytes", *HALVES])

    def far(batches):
        known = sent.value[0]
        for batch in batches:
            column, ids = T.text_column(batch), batch.column(0).to_numpy()
            for lo, hi in T.slices(column, SLICE):
                raw, offsets = T.flat(column, lo, hi)
                order = np.lexsort((code := grams(raw, offsets), row := np.repeat(np.arange(hi - lo), np.diff(offsets))))
                code, row = code[order], row[order]
                first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))) if len(code) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(code))).astype(np.int32)
                for key in parts_of(code[first]):
                    other = ~_find(known, key)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(key[other]), pa.array(ids[lo:hi][row[first[other]]]), pa.array(n[other])], ["key", "row", "n"])

    whole = map_texts(source.select(*OWN, "text"), near, "row long, doc_id long, lang string, trusted boolean, half int, n_bytes long, a double, b double")
    if least:  # some n-grams were not sent: join them, dealt by key
        tail = model.values.filter(F.col("f") < least).select("key", *HALVES)
        sums = [F.sum(F.col("n") * F.col(c).cast("double")).alias(f"s{c}") for c in HALVES]
        added = map_texts(source.select("row", "text"), far, "key long, row long, n int").join(tail, "key").groupBy("row").agg(*sums)
        same = whole.groupBy(*OWN).agg(F.count(F.lit(1)).cast("int").alias("copies"), *(F.first(c).alias(c) for c in ("n_bytes", *HALVES)))
        same = same.join(added, "row", "left")  # copies of a row add to one sum
        full = [(F.col(c) + F.coalesce(F.col(f"s{c}"), F.lit(0.0)) / F.col("copies")).alias(c) for c in HALVES]
        whole = same.select(*OWN, "n_bytes", *full, F.explode(F.sequence(F.lit(1), "copies"))).drop("col")
    log_p = F.when(~F.col("trusted"), (F.col("a") + F.col("b")) / 2).when(F.col("half") == 0, F.col("b")).otherwise(F.col("a"))
    perplexity = F.when(F.col("n_bytes") > 0, F.exp(-log_p / F.col("n_bytes"))).alias("perplexity")
    return whole.select("doc_id", "lang", "trusted", "n_bytes", perplexity)
