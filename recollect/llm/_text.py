"""Vectorised word access over Arrow string columns.

Words are maximal runs of "word bytes" in UTF-8.  Every separator class used by
the operators is ASCII only, so working on bytes gives the same words as working
on code points.  Word identity is a 64-bit polynomial hash with a final mix;
rows never influence one another (a row start always starts a new word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
HASHED_BYTES = 1 << 17
CHUNK_BYTES = 1 << 20  # working-set bound: rows are handled in slices of about this size

_seed = np.random.default_rng(20240607)
_VALUE = _seed.integers(1, 2**64, 256, dtype=U64)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_SHINGLE = _seed.integers(1, 2**64, 64, dtype=U64) | U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators `[\x20\x09-\x0D]`: words are everything else.
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes are 0-9, a-z (after lower-casing) and every byte from 0x80.
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` text bytes; a longer row is a range of its own."""
    offsets = _offsets(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column with nulls as empty texts."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.fill_null("") if column.null_count else column


def flat(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of rows lo..hi as one array, and the rows' offsets in it."""
    offsets = _offsets(column)[lo : hi + 1]
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    raw = np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    return raw, offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all words, and how many words come before each row."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = np.empty(len(raw) + 1, bool)
    inside[:-1] = word_byte[raw]
    inside[-1] = False
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    cut = offsets[:-1][offsets[:-1] < len(raw)]
    first[cut] = inside[cut]
    last = inside[:-1] & ~inside[1:]
    cut = offsets[1:][offsets[1:] > 0] - 1
    last[cut] = inside[cut]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    return starts, lengths, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes; words are taken some at a time, which bounds the working set."""
    out = np.empty(len(starts), U64)
    upto = np.cumsum(lengths)
    lo = 0
    while lo < len(starts):
        hi = int(np.searchsorted(upto, upto[lo] - lengths[lo] + HASHED_BYTES, side="right"))
        hi = max(hi, lo + 1)
        out[lo:hi] = _hashes(raw, starts[lo:hi], lengths[lo:hi])
        lo = hi
    return out


def _hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.cumsum(lengths) - lengths
    inner = np.arange(int(before[-1] + lengths[-1]), dtype=np.int64)
    at = inner + np.repeat(starts - before, lengths)
    inner -= np.repeat(before, lengths)
    with np.errstate(over="ignore"):
        power = np.full(int(lengths.max()) + 1, _BASE, U64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        return mix(np.add.reduceat(_VALUE[raw[at]] * power[inner], before))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; fewer words than that give none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = hashes[:n] * _SHINGLE[0]
        for k in range(1, size):
            out += hashes[k : k + n] * _SHINGLE[k]
    return mix(out)


def sequence_hash(hashes: np.ndarray) -> np.ndarray:
    """One hash for a whole short word sequence (of under 64 words), by its length too."""
    with np.errstate(over="ignore"):
        value = (hashes * _SHINGLE[: len(hashes)]).sum(dtype=U64) + U64(len(hashes)) * _SHINGLE[63]
    return mix(np.array([value], U64))
