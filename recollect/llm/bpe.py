"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece (one match of the split pattern) starts as one token per byte.  Leaf i of
the tree holds the rank of the merge of the live token at i with its live right
neighbour (`NONE` if there is no such merge); inner nodes hold the minimum of their
children, so the leftmost position of the lowest rank is found from the root.  A
merge changes two leaves, the merged position and its left neighbour, and each
update walks one path to the root.  Short pieces are merged many at a time: the
same trees side by side as the rows of one array.

Nulls encode as empty texts, empty texts give no ids, pieces may be of any length,
ranks are never copied: the path is a parameter and is read where it is used.  A worker
keeps at most `CACHE` learned pieces and forgets them when its task ends.
Repeated rows and extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import _text as T
from ._spark import map_texts

NONE = np.iinfo(np.int32).max
BATCHED = 64  # longer pieces are merged one by one
CACHE = 140_000  # pieces kept by a worker; a slice of text with more distinct pieces holds only its own


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BytePairCodec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        keys, merged = [], []
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.pair = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.rank = np.append(np.array(merged, np.int64)[order], NONE)
        self.lookup = dict(zip(keys, merged, strict=True))
        self.number = list(range(len(self.token)))  # shared integers and their texts
        self.name = [str(r) for r in self.number]
        self.cache: dict[str, tuple[int, ...]] = {}

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        k = np.searchsorted(self.pair, key)
        return np.where(self.pair[k] == key, self.rank[k], NONE)

    def _encode_long(self, piece: bytes) -> list[int]:
        n = len(piece)
        width = 1 << max(n - 1, 1).bit_length()
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        tree = [NONE] * (2 * width)
        get = self.lookup.get
        for i in range(n - 1):
            tree[width + i] = get(ids[i] << 32 | ids[i + 1], NONE)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def update(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low

        while (best := tree[1]) != NONE:
            k = 1
            while k < width:
                k = 2 * k if tree[2 * k] == best else 2 * k + 1
            i = k - width
            gone = right[i]
            ids[i] = best
            ids[gone] = -1
            after = right[i] = right[gone]
            if after < n:
                left[after] = i
            update(gone, NONE)
            update(i, get(best << 32 | ids[after], NONE) if after < n else NONE)
            if (before := left[i]) >= 0:
                update(before, get(ids[before] << 32 | best, NONE))
        return [t for t in ids if t >= 0]

    def _encode_batch(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Pieces of at most `width` bytes (a power of two), each tree a row."""
        rows = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, rows)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        ids = self.single[raw]
        place = np.arange(width)
        ids[place >= size[:, None]] = -1
        left = np.tile(place - 1, (rows, 1))
        right = np.tile(place + 1, (rows, 1))
        tree = np.full((rows, 2 * width), NONE, np.int64)
        has_next = place[:-1] + 1 < size[:, None]
        tree[:, width : 2 * width - 1] = np.where(has_next, self._pair_rank(ids[:, :-1], ids[:, 1:]), NONE)
        k = width
        while k > 1:
            k >>= 1
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])

        def update(r, i, value):
            k = width + i
            tree[r, k] = value
            step = width
            while step > 1:
                step >>= 1
                k = k >> 1
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            best = tree[live, 1]
            k = np.ones(len(live), np.int64)
            for _ in range(width.bit_length() - 1):
                k = np.where(tree[live, 2 * k] == best, 2 * k, 2 * k + 1)
            i = k - width
            gone = right[live, i]
            after = right[live, gone]
            ids[live, i] = best
            ids[live, gone] = -1
            right[live, i] = after
            inside = after < size[live]
            left[live[inside], after[inside]] = i[inside]
            update(live, gone, NONE)
            update(live, i, np.where(inside, self._pair_rank(best, ids[live, np.minimum(after, width - 1)]), NONE))
            before = left[live, i]
            some = before >= 0
            r, b = live[some], before[some]
            update(r, b, self._pair_rank(ids[r, b], best[some]))
            live = live[tree[live, 1] != NONE]
        keep = ids >= 0
        flat = ids[keep].tolist()
        cut = np.concatenate(([0], np.cumsum(keep.sum(1)))).tolist()
        return [tuple(flat[a:b]) for a, b in zip(cut, cut[1:], strict=False)]

    def _learn(self, pieces: set[str]) -> None:
        """Encode pieces that aren't known yet."""
        shared = self.number.__getitem__
        by_width: dict[int, list[str]] = {}
        for p in pieces:
            data = p.encode()
            if (r := self.ranks.get(data)) is not None:
                self.cache[p] = (r,)
            elif len(data) > BATCHED:
                self.cache[p] = tuple(map(shared, self._encode_long(data)))
            else:
                by_width.setdefault(1 << (len(data) - 1).bit_length(), []).append(p)
        for width, own in by_width.items():
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                for p, ids in zip(part, self._encode_batch([p.encode() for p in part], width), strict=True):
                    self.cache[p] = tuple(map(shared, ids))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text; new pieces of all texts are encoded side by side."""
        found = [self.split(t) for t in texts]
        distinct = set().union(*found)
        new = distinct.difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache = {p: self.cache[p] for p in distinct.intersection(self.cache)}  # what is in use stays
        self._learn(new)
        for own in found:
            yield list(chain.from_iterable(map(self.cache.__getitem__, own)))
        if len(self.cache) > CACHE:
            self.cache = {}

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def written(self, ids: list[int]) -> str:
        """The ids as decimal numbers with commas."""
        return ",".join(map(self.name.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=1)
def _codec(path: str, pattern: str) -> BytePairCodec:
    return BytePairCodec(load_ranks(path), pattern)


@contextmanager
def codec(path: str, pattern: str) -> Iterator[BytePairCodec]:
    """A worker process's codec, without the pieces it learned when the task ends."""
    own = _codec(path, pattern)
    try:
        yield own
    finally:
        own.cache = {}


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids), one row for each input row."""

    def encode(batches):
        with codec(path, pattern) as own:
            for batch in batches:
                column = T.text_column(batch, text_col)
                for lo, hi in T.slices(column):
                    ids = [np.array(x, np.int32) for x in own.encode_all(column.slice(lo, hi - lo).to_pylist())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_texts(docs.select(id_col, text_col), encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text bytes) of (doc_id, ids)."""

    def decode(batches):
        with codec(path, pattern) as own:
            for batch in batches:
                texts = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return map_texts(encoded.select("doc_id", "ids"), decode, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and the ids if asked for."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def both(batches):
        with codec(path, pattern) as own:
            for batch in batches:
                column = T.text_column(batch, text_col)
                for lo, hi in T.slices(column):
                    n, coded, decoded, every = [], [], [], []
                    for ids in own.encode_all(column.slice(lo, hi - lo).to_pylist()):
                        n.append(len(ids))
                        coded.append(hashlib.sha256(own.written(ids).encode()).hexdigest())
                        decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
                        if with_ids:
                            every.append(np.array(ids, np.int32))
                    more = [pa.array(every, pa.list_(pa.int32()))] * with_ids
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string()), *more], names
                    )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_texts(docs.select(id_col, text_col), both, schema)
