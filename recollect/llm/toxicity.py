"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Input: every word (letters, digits and non-ASCII bytes, A-Z lower-cased) is a vector of
a learned word part (a hashed embedding and the smoothed log-odds of its bucket in the
training rows) and a character part (the mean of hashed embeddings of its byte trigrams,
and the highest smoothed log-odds of its runs of 5 to 8 bytes, word ends being bytes too).
Two gated recurrent units read a window of `WINDOW` words from both sides; attention pools
their states and a logistic unit scores the window.  All overlapping windows are scored,
one from every word that has a whole window behind it (a shorter text is one window); they
share the inputs' products and move through the units side by side.  A document's score is
that of its worst window, shifted so that 0.5 separates best on the training rows.

The network is written in numpy, trained with Adam on a sample of labelled rows: about
`PER_LABEL` of each label and `TRAIN_BYTES` of text, chosen by a hash of the id (the
documented bounds).  In each epoch the window that scores highest stands for its document.

Null, empty and wordless texts score 0.  Without both labels among the training rows
the score is 0 for all.  Rows repeated or with clashing extra columns don't matter;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import map_texts

WINDOW = 8
SIDE_BY_SIDE = 2048
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 4, 4, 8
WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 12
GRAM_BUCKETS, GRAM_SIZES = 1 << 20, (5, 6, 7, 8)
PER_LABEL = 2000
TRAIN_BYTES = 32 << 20
EPOCHS, BATCH, RATE, DECAY = 6, 128, 0.01, 0.02
LEAST_TEXTS = 8  # a word of fewer training texts teaches only its characters
INPUT = 2 + WORD_DIM + CHAR_DIM


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Words:
    """Distinct words of some texts with their buckets, and the texts as word numbers."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        raw = T.LOWER[raw]
        starts, lengths, self.first = T.words(raw, offsets, T.ALNUM_WORD)
        distinct, at, self.number = np.unique(T.word_hashes(raw, starts, lengths), return_index=True, return_inverse=True)
        self.bucket = (distinct % np.uint64(WORD_BUCKETS)).astype(np.int64)
        starts, self.size = starts[at], lengths[at]
        before = np.cumsum(self.size) - self.size
        inner = np.arange(int(self.size.sum())) - np.repeat(before, self.size)
        place = inner + np.repeat(starts, self.size)
        self.begin = before
        self.long_gram, self.long_owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(place):
            self.gram = np.zeros(0, np.int64)
            return
        owner = np.repeat(np.arange(len(self.size)), self.size)
        flat = np.zeros(len(place) + len(self.size) + 1 + max(GRAM_SIZES), np.uint64)  # a zero between words
        flat[np.arange(len(place)) + owner + 1] = raw[place]
        owner_at = np.zeros(len(flat), np.int64)
        owner_at[np.arange(len(place)) + owner + 1] = owner
        ends = self.begin + np.arange(len(self.size))  # the zero before each word
        owner_at[ends] = np.arange(len(self.size))
        zeros = np.concatenate(([0], np.cumsum(flat == 0)))
        m = len(place) + len(self.size) + 1
        grams, owners, code = [], [], np.zeros(m, np.uint64)
        for n in range(max(GRAM_SIZES)):
            code |= flat[n : n + m] << np.uint64(8 * n)
            if n + 1 in GRAM_SIZES:
                at = np.arange(max(m - n, 0))
                at = at[zeros[at + n] == zeros[at + 1]]  # no word ends inside
                with np.errstate(over="ignore"):
                    grams.append(((code[at] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n * 0xD1B54A32D192ED03 & (1 << 64) - 1)) >> np.uint64(44)).astype(np.int64))
                owners.append(owner_at[at])
        self.long_gram, self.long_owner = np.concatenate(grams), np.concatenate(owners)
        body = raw[place].astype(np.uint32)
        left = np.where(inner > 0, raw[place - 1], 0).astype(np.uint32)
        after = raw[np.minimum(place + 1, len(raw) - 1)]
        right = np.where(inner + 1 < np.repeat(self.size, self.size), after, 0).astype(np.uint32)
        code = left | body << np.uint32(8) | right << np.uint32(16)
        self.gram = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)

    def sequence(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' word numbers one after another, texts shorter than a window padded with the number of words; starts of all windows in it, and their texts."""
        n = np.diff(self.first)
        room = np.where(n > 0, np.maximum(n, WINDOW), 0)
        begin = np.cumsum(room) - room
        out = np.full(int(room.sum()), len(self.bucket), np.int64)
        out[np.arange(len(self.number)) + np.repeat(begin - self.first[:-1], n)] = self.number
        per = np.where(n > 0, room - WINDOW + 1, 0)
        text = np.repeat(np.arange(len(n)), per)
        return out, np.arange(int(per.sum())) + np.repeat(begin - (np.cumsum(per) - per), per), text


class BiGru:
    """Parameters, forward pass and gradients."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) * np.sqrt(1 / shape[0])).astype(np.float32)
        self.p = {"word": init(WORD_BUCKETS, WORD_DIM) * 10, "char": init(CHAR_BUCKETS, CHAR_DIM) * 3}
        for d in "lr":
            self.p |= {f"W{d}": init(INPUT, 3 * HIDDEN), f"U{d}": init(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": init(2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": init(ATTENTION), "o": init(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        self.odds, self.gram_odds = np.zeros(WORD_BUCKETS, np.float32), np.zeros(GRAM_BUCKETS, np.float32)
        self.shift = 0.0

    def inputs(self, w: Words) -> np.ndarray:
        """The input vector of every distinct word."""
        if not len(w.bucket):
            return np.zeros((0, INPUT), np.float32)
        chars = np.add.reduceat(self.p["char"][w.gram], w.begin) / w.size[:, None]
        grams = np.full(len(w.bucket), -4, np.float32)
        np.maximum.at(grams, w.long_owner, self.gram_odds[w.long_gram])
        grams[grams == -4] = 0
        return np.concatenate((self.odds[w.bucket, None], grams[:, None], self.p["word"][w.bucket], chars), 1).astype(np.float32)

    def forward(self, x: np.ndarray, index: np.ndarray, tape: list | None = None) -> np.ndarray:
        """Logits of windows of rows of `x`; index len(x) is padding."""
        n, p = len(index), self.p
        mask = (index < len(x)).astype(np.float32)
        full = bool(mask.all())
        states = np.zeros((WINDOW, n, 2 * HIDDEN), np.float32)
        for d, side in (("l", 0), ("r", HIDDEN)):
            feed = np.concatenate((x @ p[f"W{d}"] + p[f"b{d}"], np.zeros((1, 3 * HIDDEN), np.float32)))
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(WINDOW) if d == "l" else reversed(range(WINDOW)):
                f, u = feed[index[:, t]], h @ p[f"U{d}"]
                zr = _sigmoid(f[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(f[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if not full:
                    new = np.where(mask[:, t, None] > 0, new, h)
                if tape is not None:
                    tape.append((d, t, h, z, r, c, u[:, 2 * HIDDEN :]))
                h = new
                states[t, :, side : side + HIDDEN] = h
        g = np.tanh(states @ p["A"] + p["a"])
        score = g @ p["v"] + (mask.T - 1) * 1e9
        weight = np.exp(score - score.max(0))
        weight *= mask.T
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = (states * weight[:, :, None]).sum(0)
        if tape is not None:
            tape.append((states, g, weight, pooled, mask))
        return pooled @ p["o"] + p["c"][0]

    def gradients(self, w: Words, index: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean weighted log-loss."""
        p, tape, x = self.p, [], self.inputs(w)
        logit = self.forward(x, index, tape)
        states, g, alpha, pooled, mask = tape.pop()
        d_logit = ((_sigmoid(logit) - label) * weight / len(label)).astype(np.float32)
        out = {"o": pooled.T @ d_logit, "c": np.array([d_logit.sum()])}
        d_pooled = d_logit[:, None] * p["o"]
        d_alpha = (states * d_pooled).sum(2)
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        d_g = d_score[:, :, None] * p["v"] * (1 - g * g)
        out |= {"v": np.einsum("tn,tna->a", d_score, g), "A": np.einsum("tnh,tna->ha", states, d_g), "a": d_g.sum((0, 1))}
        d_states = alpha[:, :, None] * d_pooled + d_g @ p["A"].T
        padded = np.concatenate((x, np.zeros((1, INPUT), np.float32)))
        d_x = np.zeros_like(padded)
        for d, side in (("l", 0), ("r", HIDDEN)):
            d_w, d_u, d_b = np.zeros_like(p[f"W{d}"]), np.zeros_like(p[f"U{d}"]), np.zeros_like(p[f"b{d}"])
            d_h = np.zeros((len(index), HIDDEN), np.float32)
            for _, t, h, z, r, c, u in reversed([s for s in tape if s[0] == d]):
                d_h = d_h + d_states[t, :, side : side + HIDDEN]
                on = mask[:, t, None]
                d_new = d_h * on
                d_c = d_new * (1 - z) * (1 - c * c)
                d_z = d_new * (h - c) * z * (1 - z)
                d_r = d_c * u * r * (1 - r)
                d_in = np.concatenate((d_z, d_r, d_c), 1)
                d_rec = np.concatenate((d_z, d_r, d_c * r), 1)
                d_w += padded[index[:, t]].T @ d_in
                d_u += h.T @ d_rec
                d_b += d_in.sum(0)
                np.add.at(d_x, index[:, t], d_in @ p[f"W{d}"].T)
                d_h = d_h * (1 - on) + d_new * z + d_rec @ p[f"U{d}"].T
            out |= {f"W{d}": d_w, f"U{d}": d_u, f"b{d}": d_b}
        d_x = d_x[:-1]
        out["word"] = np.zeros_like(p["word"])
        np.add.at(out["word"], w.bucket, d_x[:, 2 : 2 + WORD_DIM])
        out["char"] = np.zeros_like(p["char"])
        np.add.at(out["char"], w.gram, np.repeat(d_x[:, 2 + WORD_DIM :] / w.size[:, None], w.size, axis=0))
        return out

    def window_logits(self, w: Words, sequence: np.ndarray) -> np.ndarray:
        """Logits of the windows that start at every place of a sequence; those across texts mean nothing."""
        p, x, many = self.p, self.inputs(w), max(len(sequence) - WINDOW + 1, 0)
        feeds = {d: np.concatenate((x @ p[f"W{d}"] + p[f"b{d}"], np.zeros((1, 3 * HIDDEN), np.float32))) for d in "lr"}
        out = np.empty(many, np.float32)
        for lo in range(0, many, SIDE_BY_SIDE):
            n = min(SIDE_BY_SIDE, many - lo)
            own = sequence[lo : lo + n + WINDOW - 1]
            here = own < len(x)
            full = bool(here.all())
            states = np.empty((WINDOW, n, 2 * HIDDEN), np.float32)
            for d, side in (("l", 0), ("r", HIDDEN)):
                feed = feeds[d][own]
                h = np.zeros((n, HIDDEN), np.float32)
                for t in range(WINDOW) if d == "l" else reversed(range(WINDOW)):
                    f, u = feed[t : t + n], h @ p[f"U{d}"]
                    zr = _sigmoid(f[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                    c = np.tanh(f[:, 2 * HIDDEN :] + zr[:, HIDDEN:] * u[:, 2 * HIDDEN :])
                    new = c + zr[:, :HIDDEN] * (h - c)
                    h = new if full else np.where(here[t : t + n, None], new, h)
                    states[t, :, side : side + HIDDEN] = h
            score = np.tanh(states @ p["A"] + p["a"]) @ p["v"]
            if not full:
                score += np.stack([here[t : t + n] for t in range(WINDOW)]) * np.float32(1e9) - np.float32(1e9)
            weight = np.exp(score - score.max(0))
            weight /= weight.sum(0)
            out[lo : lo + n] = ((states @ p["o"]) * weight).sum(0) + p["c"][0]
        return out

    def worst(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, logit) of the highest window of each text with words."""
        sequence, start, text = w.sequence()
        if not len(start):
            return text, start, np.zeros(0, np.float32)
        logits = self.window_logits(w, sequence)[start]
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        top = np.maximum.reduceat(logits, first)
        at = np.flatnonzero(logits == np.repeat(top, np.diff(np.append(first, len(text)))))
        at = at[np.searchsorted(at, first)]
        return text[first], start[at], top

    def document_scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, _, top = self.worst(Words(raw, offsets))
        best = np.full(len(offsets) - 1, -np.inf)
        best[text] = top
        return _sigmoid(best - self.shift)


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> BiGru | None:
    """Train on texts and 0/1 labels; None unless both labels occur."""
    labels = np.asarray(labels, np.float32)
    if len(set(labels.tolist())) < 2:
        return None
    column = pa.array(texts, pa.string())
    raw, offsets = T.flat(column, 0, len(texts))
    w = Words(raw, offsets)
    sequence, start, row = w.sequence()
    net, rng = BiGru(seed), np.random.default_rng(seed)
    seen = np.unique(np.repeat(np.arange(len(texts)), np.diff(w.first)) * WORD_BUCKETS + w.bucket[w.number])
    bad = labels[seen // WORD_BUCKETS] > 0
    with_bad = np.bincount(seen[bad] % WORD_BUCKETS, minlength=WORD_BUCKETS)
    with_good = np.bincount(seen[~bad] % WORD_BUCKETS, minlength=WORD_BUCKETS)
    n_bad, n_good = labels.sum(), len(labels) - labels.sum()
    net.odds = np.clip(np.log((with_bad + 1) / (n_bad + 2)) - np.log((with_good + 1) / (n_good + 2)), -4, 4).astype(np.float32)
    known = (with_bad + with_good) >= LEAST_TEXTS
    net.odds *= known
    net.p["word"] *= known[:, None]
    per_word = _texts_per_word(w, labels)
    grams = [np.bincount(w.long_gram, c[w.long_owner], GRAM_BUCKETS) for c in per_word]
    net.gram_odds = np.clip(np.log((grams[0] + 1) / (n_bad + 2)) - np.log((grams[1] + 1) / (n_good + 2)), -4, 4).astype(np.float32)
    net.gram_odds *= grams[0] + grams[1] >= LEAST_TEXTS
    inputs = np.append(np.maximum(*net.inputs(w)[:, :2].T), np.float32(-9))[sequence]
    first_look = np.max([inputs[start + t] for t in range(WINDOW)], axis=0)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    docs = np.unique(row)
    for epoch in range(epochs):
        if epoch:
            _, last, _ = net.worst(w)  # each document's highest window
        else:
            order = np.lexsort((first_look, row))
            last = start[order[np.append(np.flatnonzero(np.diff(row[order])), len(order) - 1)]]
        own_label = labels[docs]
        other = rng.integers(0, len(start), len(docs))
        other = other[labels[row[other]] == 0]  # any window of a clean document
        last, truth = np.concatenate((last, start[other])), np.concatenate((own_label, labels[row[other]]))
        pick = rng.permutation(len(last))
        for k in range(0, len(pick), BATCH):
            own = pick[k : k + BATCH]
            # only the words of these windows take part
            index = sequence[last[own][:, None] + np.arange(WINDOW)]
            used, inverse = np.unique(np.append(index.ravel(), len(w.bucket)), return_inverse=True)
            sub = _subset(w, used[:-1])
            grads = net.gradients(sub, inverse[:-1].reshape(len(own), WINDOW), truth[own], np.ones(len(own), np.float32))
            grads["word"] *= known[:, None]
            step += 1
            for name, g in grads.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                if name in ("char", "word"):
                    net.p[name] *= 1 - RATE * DECAY
                net.p[name] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    best = np.full(len(texts), -30.0)
    text, _, top = net.worst(w)
    best[text] = top
    order = np.argsort(best)
    right = np.concatenate(([labels.sum()], labels.sum() + np.cumsum(1 - 2 * labels[order])))  # cut below the k-th
    cuts = np.concatenate(([best[order[0]] - 1], (best[order[1:]] + best[order[:-1]]) / 2, [best[order[-1]] + 1]))
    good = np.flatnonzero(right == right.max())
    net.shift = float(np.median(cuts[good]))
    return net


def _texts_per_word(w: Words, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts of label 1 and of label 0 each distinct word stands."""
    many = max(len(w.bucket), 1)
    seen = np.unique(np.repeat(np.arange(len(labels)), np.diff(w.first)) * many + w.number)
    bad = labels[seen // many] > 0
    return tuple(np.bincount(seen[side] % many, minlength=len(w.bucket)) for side in (bad, ~bad))


def _subset(w: Words, used: np.ndarray) -> Words:
    """The given distinct words alone, renumbered."""
    out = object.__new__(Words)
    out.bucket, out.size = w.bucket[used], w.size[used]
    out.begin = np.cumsum(out.size) - out.size
    inner = np.arange(int(out.size.sum())) - np.repeat(out.begin, out.size)
    out.gram = w.gram[np.repeat(w.begin[used], out.size) + inner]
    place = np.full(len(w.bucket), -1)
    place[used] = np.arange(len(used))
    kept = place[w.long_owner] >= 0
    out.long_gram, out.long_owner = w.long_gram[kept], place[w.long_owner[kept]]
    return out


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> BiGru | None:
    """Fit on about `per_label` labelled rows of each label; `labels` has (id, label)."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_text is not null")
    sizes = texts.select("_id", F.octet_length("_text").alias("_n")).join(known, "_id").groupBy("_label").agg(F.count(F.lit(1)).alias("c"), F.sum("_n").alias("n")).collect()
    share = {r["_label"]: min(1.0, per_label / r["c"], TRAIN_BYTES / 2 / max(r["n"], 1)) for r in sizes}
    unit = F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("_label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    # About 2 * per_label rows, whatever the size of the table: small enough to broadcast.
    sample = known.filter(unit < share)
    rows = texts.join(F.broadcast(sample), "_id").collect()
    rows = sorted((r["_id"], r["_label"], r["_text"]) for r in rows)
    return fit([t for _, _, t in rows], np.array([y for _, y, _ in rows]), epochs)


def score(docs: DataFrame, model: BiGru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score), one row for each input row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = sent.value
        for batch in batches:
            column = T.text_column(batch, text_col)
            for lo, hi in T.slices(column):
                value = np.zeros(hi - lo) if net is None else net.document_scores(*T.flat(column, lo, hi)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(value)], ["doc_id", "score"])

    return map_texts(docs.select(id_col, text_col), run, "doc_id long, score double")
