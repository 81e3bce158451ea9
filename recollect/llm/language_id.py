"""Language identification by nearest clustered centroids of TF-IDF n-grams.

Features are hashed byte bigrams and trigrams of the text with A-Z lower-cased and
every other non-letter ASCII byte taken as a space; grams without a letter are left
out.  A document's vector is (1 + ln tf) * idf, of unit length.  Each language has
up to `clusters` centroids from spherical k-means.  The prediction is the language
of the centroid with the largest cosine; `score` is that cosine.

Rejection is by distance: a document is rejected if its cosine distance to the
nearest centroid exceeds that centroid's radius, the largest distance among its own
training documents plus `slack`, where short texts (few grams) are allowed more
distance in proportion to 1/sqrt(grams), the way chance spreads them.  Texts that are
null or have no letter are rejected as `und` with score 0.

The model is fitted on a sample of labelled rows: about `per_language` of each
language, chosen by a hash of the id (`PER_LANGUAGE` is the documented bound).  Rows
without a language teach nothing.  Ties go to the first language in alphabetic order.
With no labelled row at all everything is `und`.  Repeated rows are answered alike;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import map_texts

DIM = 4096
DENSE = 128  # rows whose counts are held dense at once
PER_LANGUAGE = 1000
CLUSTERS = 3
SLACK = 0.1
ROOM = 2.5

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def gram_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of hashed gram counts for each text."""
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros((n, DIM), np.float32)
    b = _FOLD[raw].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * DIM, np.diff(offsets))
    out = np.zeros(n * DIM, np.int64)
    for size in (2, 3):
        m = len(b) - size + 1
        if m <= 0:
            break
        code = b[:m] | b[1 : m + 1] << np.uint32(8)
        letter = (b[:m] != 0x20) | (b[1 : m + 1] != 0x20)
        if size == 3:
            code |= b[2:] << np.uint32(16)
            letter |= b[2:] != 0x20
        good = letter & (row[:m] == row[size - 1 :])
        bucket = (code * np.uint32(2654435761) + np.uint32(size * 40503)) >> np.uint32(32 - 12)
        out += np.bincount(row[:m][good] + bucket[good], minlength=n * DIM)
    return out.reshape(n, DIM).astype(np.float32)


def has_letter(column: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    seen = np.concatenate(([0], np.cumsum(_ASCII_LETTER[raw])))
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    for k in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[k] = any(ch.isalpha() for ch in column[int(k)].as_py())
    return found


def _slices(column: pa.Array):
    for lo, hi in T.slices(column):
        for at in range(lo, hi, DENSE):
            yield at, min(at + DENSE, hi)


class Centroids:
    """A fitted model; small and of fixed size per language."""

    def __init__(self, langs: list[str], idf: np.ndarray, centers: np.ndarray, owner: np.ndarray, radius: np.ndarray, spread: np.ndarray):
        self.langs, self.idf, self.centers, self.owner, self.radius, self.spread = langs, idf, centers, owner, radius, spread

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * self.idf)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, cosine, rejected) of each row of counts."""
        cosine = self.vectors(counts) @ self.centers.T
        best = cosine.argmax(1)
        top = np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(np.float64)
        grams = np.maximum(counts.sum(1), 1)
        return self.owner[best], top, 1 - top > self.radius[best] + self.spread[best] / np.sqrt(grams)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def fit(counts: np.ndarray, langs: np.ndarray, clusters: int = CLUSTERS, slack: float = SLACK, rounds: int = 12) -> Centroids | None:
    """Centroids from counted training texts and their languages."""
    some = counts.sum(1) > 0
    if not some.all():
        counts, langs = counts[some], langs[some]
    if not len(counts):
        return None
    idf = (np.log((len(counts) + 1) / (np.count_nonzero(counts, axis=0) + 1)) + 1).astype(np.float32)
    model = Centroids(sorted(set(langs.tolist())), idf, *[np.zeros(0)] * 4)
    x, grams = np.empty_like(counts), counts.sum(1)
    for lo in range(0, len(x), DENSE):
        x[lo : lo + DENSE] = model.vectors(counts[lo : lo + DENSE])
    del counts
    centers, owner, radius, spread = [], [], [], []
    for k, lang in enumerate(model.langs):
        own = np.flatnonzero(langs == lang)
        c = x[own[[0]]]
        while len(c) < min(clusters, len(own)):  # farthest-first seeds
            far = (x[own] @ c.T).max(1).argmin()
            c = np.concatenate((c, x[own[[far]]]))
        for _ in range(rounds):
            near = (x[own] @ c.T).argmax(1)
            c = _unit(np.stack([x[own[near == j]].sum(0) if (near == j).any() else c[j] for j in range(len(c))]))
        cosine = x[own] @ c.T
        near, dist = cosine.argmax(1), 1 - cosine.max(1)
        root = np.sqrt(grams[own])
        for j in range(len(c)):
            mine = near == j
            if not mine.any():
                continue
            centers.append(c[j])
            owner.append(k)
            long = mine & (grams[own] >= np.median(grams[own]))
            radius.append((dist[long].max() if long.any() else dist[mine].max()) + slack)
            spread.append(max(0.0, float(((dist[mine] - radius[-1]) * root[mine]).max())) + ROOM)
    model.centers, model.owner = np.stack(centers), np.array(owner)
    model.radius, model.spread = np.array(radius), np.array(spread)
    return model


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, clusters: int = CLUSTERS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Centroids | None:
    """Fit on about `per_language` rows of each language, chosen by a hash of the id."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(lang_col).count().collect()
    if not sizes:
        return None
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col(lang_col) == r[lang_col], min(1.0, per_language / r["count"])).otherwise(share)
    unit = F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) / float(1 << 20)

    def count(batches):
        for batch in batches:
            column = T.text_column(batch, text_col)
            for lo, hi in _slices(column):
                packed = []
                for row in gram_counts(*T.flat(column, lo, hi)):
                    at = np.flatnonzero(row)
                    packed.append(np.concatenate((at.astype(np.int32), row[at].astype(np.int32))).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(packed, pa.binary())], ["id", "lang", "grams"])

    sample = rows.filter(unit < share).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), text_col)
    got = sorted(map_texts(sample, count, "id string, lang string, grams binary").collect(), key=lambda r: (r["id"] or "", r["lang"], bytes(r["grams"])))
    counts = np.zeros((len(got), DIM), np.float32)
    for k, r in enumerate(got):
        both = np.frombuffer(r["grams"], np.int32)
        counts[k, both[: len(both) // 2]] = both[len(both) // 2 :]
    return fit(counts, np.array([r["lang"] for r in got]), clusters)


def predict(docs: DataFrame, model: Centroids | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, rejected, kept columns), one row for each input row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *keep)
    schema = docs.select(F.col(id_col), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), *keep).schema

    def run(batches):
        model = sent.value
        for batch in batches:
            column = T.text_column(batch, "_text")
            for lo, hi in _slices(column):
                raw, offsets = T.flat(column, lo, hi)
                known = has_letter(column.slice(lo, hi - lo), raw, offsets)
                lang, score, far = ["und"] * (hi - lo), np.zeros(hi - lo), np.ones(hi - lo, bool)
                if model is not None:
                    best, cosine, out = model.nearest(gram_counts(raw, offsets))
                    lang = [model.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
                    score, far = np.where(known, cosine, 0.0), out | ~known
                part = [batch.column(k).slice(lo, hi - lo) for k in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score), pa.array(far), *part], schema.names)

    return map_texts(source, run, schema)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
