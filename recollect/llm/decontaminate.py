"""Benchmark decontamination by a prefix-filtered containment join.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  A window is
`size` consecutive words of an item; an item of fewer words, but not none, is one
window.  A window occurs where all its words stand in a row in a document; those
document words are hit.

Method: a window's shingles are its runs of `shingle` words (fewer for a shorter
window).  Shingles are ordered by rarity, counted over all documents.  As a window
must be contained as a whole, one shingle, its rarest, is the necessary prefix; a
document position joins a window only through it.  The length bound (the document
has as many words as the window) and the positional bound (the window, laid out
around the matched shingle, stays inside the document) come before the exact
comparison of all words.

The item side is held in blocks of at most `block_words` words, each small enough
to broadcast; a larger benchmark takes more blocks and their hits are united per
document.  Nulls have no words.  Repeated rows are answered row by row.  Rows with
null item ids take no part; items without words neither.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import map_texts

BLOCK_WORDS = 2_000_000
FILTER_BITS = 20


def _item_windows(items: list[tuple[str, str]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all windows (padded with 0), their lengths, and their items' numbers."""
    column = pa.array([t or "" for _, t in items], pa.string())
    raw, offsets = T.flat(column, 0, len(items))
    raw = T.LOWER[raw]
    starts, lengths, first = T.words(raw, offsets, T.ALNUM_WORD)
    hashes = T.word_hashes(raw, starts, lengths)
    rows, sizes, owner = [], [], []
    for k in range(len(items)):
        own = hashes[first[k] : first[k + 1]]
        if not len(own):
            continue
        width = min(size, len(own))
        for at in range(len(own) - width + 1):
            row = np.zeros(size, np.uint64)
            row[:width] = own[at : at + width]
            rows.append(row)
            sizes.append(width)
            owner.append(k)
    if not rows:
        return np.zeros((0, size), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.array(rows), np.array(sizes, np.int64), np.array(owner, np.int64)


class _Tokens:
    """Sorted shingle hashes of one width with a bit table in front."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = np.unique(tokens)
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[self.tokens & np.uint64((1 << FILTER_BITS) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of hashes that are tokens, and the tokens' numbers."""
        at = np.flatnonzero(self.bits[hashes & np.uint64((1 << FILTER_BITS) - 1)])
        if not len(at) or not len(self.tokens):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.searchsorted(self.tokens, hashes[at])
        k[k == len(self.tokens)] = 0
        good = self.tokens[k] == hashes[at]
        return at[good], k[good]


def _window_shingles(windows: np.ndarray, sizes: np.ndarray, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(width, offset, window numbers, hashes) of every shingle of every window."""
    for length in np.unique(sizes):
        width = min(shingle, int(length))
        own = np.flatnonzero(sizes == length)
        for at in range(int(length) - width + 1):
            part = windows[own, at : at + width]
            with np.errstate(over="ignore"):
                value = sum((part[:, k] * T._SHINGLE[k] for k in range(1, width)), part[:, 0] * T._SHINGLE[0])
            yield width, at, own, T.mix(value)


class _Index:
    """Windows of one block behind their necessary shingles."""

    def __init__(self, windows: np.ndarray, sizes: np.ndarray, owner: np.ndarray, shingle: int, counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.windows, self.sizes, self.owner = windows, sizes, owner
        rarest = np.full(len(sizes), np.iinfo(np.int64).max)
        token, offset, width_of = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for width, at, own, value in _window_shingles(windows, sizes, shingle):
            known, n = counts[width]
            seen = n[np.searchsorted(known, value)]
            better = seen < rarest[own]
            hit = own[better]
            rarest[hit], token[hit], offset[hit], width_of[hit] = seen[better], value[better], at, width
        self.by_width = {}
        for width in np.unique(width_of):
            own = np.flatnonzero(width_of == width)
            order = own[np.argsort(token[own], kind="stable")]
            table = _Tokens(token[own])
            begin = np.searchsorted(token[order], table.tokens)
            end = np.searchsorted(token[order], table.tokens, side="right")
            self.by_width[int(width)] = (table, order, begin, end - begin)
        self.offset = offset

    def occurrences(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start word, window number) of all windows that occur; rows start at words `first`."""
        starts, found = [], []
        for width, (table, order, begin, n) in self.by_width.items():
            at, k = table.find(T.shingles(hashes, width))
            if not len(at):
                continue
            copies = n[k]
            inner = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            window = order[np.repeat(begin[k], copies) + inner]
            start = np.repeat(at, copies) - self.offset[window]
            row = np.searchsorted(first, np.repeat(at, copies), side="right") - 1
            low, high = first[row], first[row + 1]
            size = self.sizes[window]
            good = (high - low >= size) & (start >= low) & (start + size <= high)  # length and positional bounds
            window, start, size = window[good], start[good], size[good]
            same = np.ones(len(window), bool)
            for j in range(self.windows.shape[1]):
                inside = j < size
                same &= ~inside | (hashes[np.where(inside, start + j, 0)] == self.windows[window, j])
            starts.append(start[same])
            found.append(window[same])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(found)


def _rows(batches, text_col):
    for batch in batches:
        column = T.text_column(batch, text_col)
        for lo, hi in T.slices(column):
            raw, offsets = T.flat(column, lo, hi)
            raw = T.LOWER[raw]
            starts, lengths, first = T.words(raw, offsets, T.ALNUM_WORD)
            yield batch, lo, hi, T.word_hashes(raw, starts, lengths), first


def _count_shingles(docs: DataFrame, tokens: dict[int, np.ndarray], text_col: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """How often each benchmark shingle stands in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast({w: _Tokens(t) for w, t in tokens.items()})

    def count(batches):
        tables = sent.value
        sums = {w: np.zeros(len(t.tokens), np.int64) for w, t in tables.items()}
        for _, _, _, hashes, _ in _rows(batches, text_col):
            for w, t in tables.items():
                k = t.find(T.shingles(hashes, w))[1]
                if len(k):
                    sums[w] += np.bincount(k, minlength=len(t.tokens))
        for w, s in sums.items():
            k = np.flatnonzero(s)
            yield pa.RecordBatch.from_pydict({"w": pa.array(np.full(len(k), w, np.int32)), "k": pa.array(k), "n": pa.array(s[k])})

    out = {w: (t.tokens, np.zeros(len(t.tokens), np.int64)) for w, t in sent.value.items()}
    summed = map_texts(docs.select(text_col), count, "w int, k long, n long").groupBy("w", "k").agg(F.sum("n").alias("n"))
    for r in summed.collect():  # as many rows as the block has shingles, at most
        out[r["w"]][1][r["k"]] = r["n"]
    return out


def _mark(docs: DataFrame, index: _Index, ids: list[str], id_col: str, text_col: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((index, ids))

    def mark(batches):
        index, ids = sent.value
        for batch, lo, hi, hashes, first in _rows(batches, text_col):
            start, window = index.occurrences(hashes, first)
            edge = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + index.sizes[window], -1)
            hit = np.cumsum(edge[:-1]) > 0
            row = np.searchsorted(first, start, side="right") - 1
            items = [set() for _ in range(hi - lo)]
            for r, o in set(zip(row.tolist(), index.owner[window].tolist(), strict=True)):
                items[r].add(ids[o])
            spans = [[] for _ in range(hi - lo)]
            turn = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
            for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
                while a < b:  # a run of hits may cross rows
                    r = int(np.searchsorted(first, a, side="right")) - 1
                    end = min(b, int(first[r + 1]))
                    spans[r].append((int(a - first[r]), int(end - first[r])))
                    a = end
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index(id_col)).slice(lo, hi - lo),
                    batch.column(batch.schema.get_field_index("text_key")).slice(lo, hi - lo),
                    pa.array(np.diff(first)),
                    pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([sorted(s) for s in items], pa.list_(pa.string())),
                ],
                ["doc_id", "text_key", "n_words", "spans", "items"],
            )

    schema = "doc_id long, text_key long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    return map_texts(docs.select(id_col, text_col, F.xxhash64(text_col).alias("text_key")), mark, schema)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(doc_id, text_key, n_words, spans of hit words, sorted items), one row for each input row."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null and text is not null").distinct()
    weight = F.length("text") + 1  # at least the number of words
    total = items.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    parts = []
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = sorted((r["item"], r["text"]) for r in own.collect())
        windows, sizes, owner = _item_windows(rows, size)
        tokens: dict[int, list[np.ndarray]] = {}
        for width, _, _, value in _window_shingles(windows, sizes, shingle):
            tokens.setdefault(width, []).append(value)
        counts = _count_shingles(docs, {w: np.concatenate(v) for w, v in tokens.items()}, text_col) if tokens else {}
        parts.append(_mark(docs, _Index(windows, sizes, owner, shingle, counts), [i for i, _ in rows], id_col, text_col))
    if blocks == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # Equal rows (same id and text) answer alike in each block: unite per distinct row, then give each copy its answer.
    united = every.groupBy("doc_id", "text_key", "n_words").agg(
        (F.count(F.lit(1)) / blocks).cast("int").alias("copies"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    return united.withColumn("spans", _merge_spans("spans")).withColumn("_", F.explode(F.sequence(F.lit(1), "copies"))).drop("_", "copies")


def _merge_spans(name: str):
    """Union of overlapping or touching spans."""
    empty = F.expr("cast(array() as array<struct<start:long,end:long>>)")

    def add(done, x):
        last = F.get(done, F.size(done) - 1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(F.size(done) == 0, F.array(x)).when(x["start"] <= last["end"], joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(name), empty, add)


def digest(found: DataFrame) -> DataFrame:
    """The counts and hashes of a contamination result."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
