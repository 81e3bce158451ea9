"""FNV-1a hashes and identities: unsigned wrap-around needs Arrow batches.

All folds run over the bytes of a whole batch side by side: one numpy step per byte
position, over the values that are that long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OFFSET, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1  # fixed values of FNV-1a
SECOND_LANE = 0x9E3779B97F4A7C15  # fixed value: what the second lane of a memory identity starts with, against OFFSET


def fnv1a(data: bytes, start: int = OFFSET) -> int:
    h = start
    for b in data:
        h = ((h ^ b) * PRIME) & MASK
    return h


def _columns(values: list[bytes]):
    """For each byte position: the numbers of the values that long, longest first, and their bytes there."""
    size = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(-size, kind="stable")
    flat = np.frombuffer(b"".join(values), np.uint8).astype(np.uint64)
    begin = (np.cumsum(size) - size)[order]
    longest = -size[order]
    for p in range(int(size.max(initial=0))):
        n = int(np.searchsorted(longest, -p, side="left"))
        yield order[:n], flat[begin[:n] + p]


def fold(values: list[bytes], start: int = OFFSET) -> np.ndarray:
    """FNV-1a of every value."""
    h = np.full(len(values), start, np.uint64)
    with np.errstate(over="ignore"):
        for rows, byte in _columns(values):
            h[rows] = (h[rows] ^ byte) * np.uint64(PRIME)
    return h


def _little_endian(*lanes: np.ndarray) -> list[str]:
    both = np.stack([x.astype("<u8") for x in lanes], 1).tobytes().hex()
    width = 16 * len(lanes)
    return [both[k : k + width] for k in range(0, len(both), width)]


@F.pandas_udf(T.StringType())
def fnv1a_hex(data: pd.Series) -> pd.Series:
    """16 hexadecimal digits for each binary value."""
    known = data.notna().to_numpy()
    found = iter(fold([bytes(x) for x in data[known]]).tolist())
    return pd.Series([f"{next(found):016x}" if k else None for k in known], dtype=object)


@F.pandas_udf(T.StringType())
def _memory_ids(node: pd.Series, tick: pd.Series, layer: pd.Series, key: pd.Series) -> pd.Series:
    rows = [bytes([int(n)]) + int(t).to_bytes(8, "little") + bytes([int(y)]) + k.encode() for n, t, y, k in zip(node, tick, layer, key, strict=True)]
    return pd.Series(_little_endian(fold(rows), fold(rows, OFFSET ^ SECOND_LANE)), dtype=object)


def memory_id(node: Column, tick: Column, layer: Column, key: Column) -> Column:
    """A slot's identity: 32 hexadecimal digits, two lanes over node, tick, layer and key."""
    return _memory_ids(node, tick, layer, key)


@F.pandas_udf(T.StringType())
def _conflict_ids(subject: pd.Series, candidates: pd.Series) -> pd.Series:
    rows = [b"\xff".join([s.encode(), *(c.encode() for c in sorted(set(own)))]) for s, own in zip(subject, candidates, strict=True)]
    a, b = np.full(len(rows), OFFSET, np.uint64), np.full(len(rows), OFFSET, np.uint64)
    with np.errstate(over="ignore"):
        for at, byte in _columns(rows):
            a[at] = (a[at] ^ byte) * np.uint64(PRIME)
            b[at] = (b[at] ^ byte) * np.uint64(PRIME) + a[at]
    return pd.Series(_little_endian(a, b), dtype=object)


def conflict_id(subject: Column, candidates: Column) -> Column:
    """The identity of a conflict does not depend on the order of its candidates."""
    return _conflict_ids(subject, candidates)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def demo_embedding(text: pd.Series) -> pd.Series:
    """256 signed, hashed byte-trigram counts of unit length (single bytes below three bytes)."""
    out = np.zeros((len(text), 256))
    for row, t in enumerate(text):
        b = np.frombuffer((t or "").encode(), np.uint8).astype(np.uint64)
        size = 3 if len(b) >= 3 else 1
        h = np.full(max(len(b) - size + 1, 0), OFFSET, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                h = (h ^ b[k : k + len(h)]) * np.uint64(PRIME)
        np.add.at(out[row], (h & np.uint64(255)).astype(np.int64), np.where(h >> np.uint64(63) == 0, 1.0, -1.0))
    return pd.Series(list(_unit(out).astype(np.float32)))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def local_embedding(text: pd.Series) -> pd.Series:
    """A deterministic stand-in for a local 384-component model: per component a seeded fold of the bytes and their places; null and empty texts have none."""
    part = np.arange(384, dtype=np.uint64)

    def one(t):
        if not t:
            return None
        with np.errstate(over="ignore"):
            h, out = np.uint64(OFFSET) ^ part * np.uint64(SECOND_LANE), np.zeros(384)
            for j, b in enumerate(t.encode()):
                h = (h ^ (np.uint64(b + 31 * j) + part)) * np.uint64(PRIME)
                if j % 3 == 0:
                    out += (h >> np.uint64(32)) / 4294967295.0 * 0.1
            out += ((h ^ (h >> np.uint64(33))) & np.uint64(0xFFFFFFFF)) / 4294967295.0 * 2 - 1
        return _unit(out[None])[0].astype(np.float32)

    return text.map(one)


def keyed_signature(payload: list[bytes], key: int) -> np.ndarray:
    """FNV-1a of each payload followed by the key: shows the flow of signing, protects nothing."""
    return fold([p + key.to_bytes(8, "little") for p in payload])
