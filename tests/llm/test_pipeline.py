"""Every stage of the pipeline against a plain version in Python, on odd rows too."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from recollect.llm import bpe, language_id, queries

from .test_operators import ODD, roots_by_force, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STEMS = {"en": "the of and with that have from this".split(), "de": "der und nicht für über schön durch wird".split()}
BENCHMARK = [(1, "what is the name of the very old river that runs through"), (2, "short item"), (3, None), (4, "")]


def corpus():
    rng, rows = random.Random(21), []
    text = lambda lang, n: " ".join(rng.choices(STEMS[lang], k=n))
    boiler = "The and of with that have from this the and of with that have."
    for i in range(120):
        lang = ("en", "de")[i % 2]
        lines = [text(lang, rng.randrange(5, 30)) + f" {lang}{i}x{k}" for k in range(rng.randrange(1, 4))]
        if i % 7 == 0:
            lines.insert(1, boiler if i % 2 else "  " + boiler.upper())
        if i % 11 == 0:
            lines.append("the " + BENCHMARK[0][1] + " and")
        if i % 13 == 0:
            lines.append("this is a Short ITEM of the")
        rows.append((i, "\n".join(lines), lang))
    for i in (4, 5, 9):
        w = rows[i][1].split(" ")
        rows.append((200 + i, " ".join([*w, "the"]), rows[i][2]))  # nearly the same
        rows.append((300 + i, rows[i][1], rows[i][2]))  # the same
    rows += [(None, rows[20][1], "en"), (None, rows[20][1] + " the", "en"), (None, "the of and with that have " * 9, "en"), (7, text("de", 40), None), (400, text("en", 30_000), "en"), (401, "### 123 ???", "en")]
    rows += [(500 + k if i is None else 600 + i, t, None) for k, (i, t) in enumerate(ODD)]
    rows += [rows[3], rows[3]]
    return [(i, t, lang, "web", None if t is None else len(t)) for i, t, lang in rows]


def bag(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


# --- plain versions ----------------------------------------------------------------------


def gram_buckets(text):
    """Counts of hashed bigrams and trigrams, byte by byte."""
    data = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    out = Counter()
    for size in (2, 3):
        for k in range(len(data) - size + 1):
            gram = data[k : k + size]
            if gram != b" " * size:
                code = int.from_bytes(gram, "little")
                out[(code * 2654435761 + size * 40503) % 2**32 >> 20] += 1
    return out


def nearest(model, text):
    """(language, cosine, rejected) of a text, straight from the definition."""
    if not text or not any(ch.isalpha() for ch in text):
        return "und", 0.0, True
    tf = gram_buckets(text)
    vector = {b: (1 + math.log(n)) * float(model.idf[b]) for b, n in tf.items()}
    norm = math.sqrt(sum(v * v for v in vector.values()))
    cosine = [sum(v / norm * float(c[b]) for b, v in vector.items()) for c in model.centers]
    best = int(np.argmax(cosine))
    far = 1 - min(max(cosine[best], 0), 1) > model.radius[best] + model.spread[best] / math.sqrt(sum(tf.values()))
    return model.langs[model.owner[best]], cosine[best], bool(far)


def without_shared_lines(rows):
    keyed, holders = [], defaultdict(set)
    for i, t in rows:
        lines = (t or "").split("\n")
        keys = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r")) for x in lines]
        keyed.append((i, lines, keys))
        for k in keys:
            if i is not None and len(k) >= 40:
                holders[k].add(i)
    common = {k: max(ids) for k, ids in holders.items() if len(ids) >= 5}
    return Counter((i, "\n".join(x for x, k in zip(lines, keys, strict=True) if i is None or k not in common or i >= common[k])) for i, lines, keys in keyed)


def leaks(text):
    own = words(text, r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for _, item in BENCHMARK:
        w = words(item, r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
        size = min(10, len(w))
        if size and {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} & {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}:
            return True
    return False


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after every stage, with extra columns whose names clash."""
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(corpus(), SCHEMA).selectExpr("*", "'x' AS node", "1 AS _id", "2 AS text_key", "'k' AS class", "0 AS rejected")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    held = [spark.read.parquet(f"{folder}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], folder).write.parquet(f"{folder}/out{k}")
        held.append(spark.read.parquet(f"{folder}/out{k}"))
    return folder, held


def test_language_stage(stages):
    _, held = stages
    model = language_id.train(held[0])
    want, langs = Counter(), {}
    for (i, t), n in bag(held[0]).items():
        lang, _, rejected = nearest(model, t)
        if not rejected:
            want[i, t] += n
            langs[t] = lang
    assert bag(held[1]) == want and held[1].columns == list(corpus_pipeline.COLUMNS)
    assert {r.text: r.lang for r in held[1].collect()} == langs
    clean = [(i, t) for i, t, lang, *_ in corpus() if i is not None and i < 120]
    assert all(want[x] for x in clean) and not any(t in (None, "", "### 123 ???") for _, t in want)


def test_language_predictions_are_the_nearest_centroid(spark, stages):
    _, held = stages
    model = language_id.train(held[0])
    for r in language_id.predict(held[0], model, keep=("text",)).collect():
        lang, cosine, rejected = nearest(model, r.text)
        assert (r.lang_pred, r.rejected) == (lang, rejected) and r.score == pytest.approx(max(cosine, 0), abs=1e-4)
    none = held[0].limit(0)
    assert language_id.train(none) is None and language_id.predict(none, None).count() == 0


def test_line_stage(stages):
    _, held = stages
    want = without_shared_lines([x for x, n in bag(held[1]).items() for _ in range(n)])
    assert bag(held[2]) == want != bag(held[1])
    assert all(r.n_chars == len(r.text) for r in held[2].collect())


def test_near_duplicate_stage(stages):
    _, held = stages
    rows = [x for x, n in bag(held[2]).items() for _ in range(n)]
    kept, classes, alone = bag(held[3]), defaultdict(set), set()
    for row, (n, root) in zip(rows, roots_by_force(rows), strict=True):
        (classes[root] if n else alone).add(row)
    assert set(kept.values()) == {1} and len(kept) == len(classes) + len(alone) < len(rows)
    for members in classes.values():
        left = [x for x in members if x in kept]
        assert len(left) == 1 and left[0][0] == min((i for i, _ in members if i is not None), default=None)
    assert sum(i is None for i, _ in kept) == 1  # of the texts that only rows without an id hold


def test_decontamination_stage(stages):
    _, held = stages
    before, after = bag(held[3]), bag(held[4])
    assert after == Counter({x: n for x, n in before.items() if not leaks(x[1])}) != before


def test_encoding_stage_and_run(spark, stages):
    folder, held = stages
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    coded = lambda t: (len(ids := library.encode_ordinary(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    want = Counter((i, *coded(t)) for (i, t), n in bag(held[4]).items() for _ in range(n))
    found = lambda df: Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())
    assert found(held[5]) == want == found(corpus_pipeline.run(spark, folder))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries(spark, data):
    assert set(queries.oracle_sql()) <= set(queries.queries())
    got = queries.op6_language_id(spark, data)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
