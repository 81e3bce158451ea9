import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from recollect.llm import _text as T
from recollect.llm import bpe, components, decontaminate, exact_topk, jaccard_join, language_id, line_dedup, ngram_model, quality, sharding, surrogates, toxicity

DOCS = "doc_id long, text string"
ODD = [(None, "a lone null id"), (7, None), (8, ""), (9, " \n\t\n "), (10, "twice the same row"), (10, "twice the same row"), (11, "x" * 200_000), (12, "é" * 3), (13, "1234 %%%")]


def frame(spark, rows):
    """With extra columns whose names clash with names used inside."""
    return spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "'z' AS id", "1 AS node", "'q' AS text_key", "0 AS n", "'k' AS key", "'en' AS lang", "true AS rejected")


def empty(spark):
    return frame(spark, []) if False else spark.createDataFrame([], DOCS).selectExpr("doc_id", "text", "'z' AS id", "1 AS node", "'en' AS lang")


def words(text, pattern):
    return re.findall(pattern, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# --- words -----------------------------------------------------------------------------


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = ["The cat  sat", "", "cat", "THE\x0bcat é", "thecat"]
    raw, offsets = T.flat(pa.array(texts), 0, len(texts))
    starts, lengths, first = T.words(T.LOWER[raw], offsets, T.SPACE_WORD)
    hashes = T.word_hashes(T.LOWER[raw], starts, lengths)
    flat = [w for t in texts for w in words(t, r"[^\x20\x09-\x0d]+")]
    assert len(flat) == len(hashes) == len(set(zip(flat, hashes.tolist(), strict=True))) + (len(flat) - len(set(flat)))
    assert np.diff(first).tolist() == [3, 0, 1, 3, 1]


# --- 1 quality -------------------------------------------------------------------------


def plain_byte_model(texts, order):
    """log-probability of a byte string's last byte after the others, straight from the definition."""
    counts = {order: Counter()}
    for t in texts:
        b = re.sub(rb"[0-9]", b"0", b"\n" * (order - 1) + t.encode())
        counts[order].update(b[k : k + order] for k in range(len(b) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d = {n: ngram_model.discounts([0, *(list(c.values()).count(k) for k in range(1, 5))]) for n, c in counts.items()}
    by_context = {n: defaultdict(list) for n in counts}
    for n, c in counts.items():
        for g, x in c.items():
            by_context[n][g[:-1]].append(x)

    def p(g):
        if not g:
            return 1 / 256
        n = len(g)
        same = by_context[n][g[:-1]]
        if not same:
            return p(g[1:])
        x, total = counts[n][g], sum(same)
        return (x - d[n][min(x, 3)]) / total + sum(d[n][min(y, 3)] for y in same) / total * p(g[1:])

    return p


@pytest.mark.parametrize("head", [ngram_model.HEAD, 150, 0])
def test_byte_model_is_kneser_ney(spark, head):
    order, rng = ngram_model.ORDER, random.Random(4)
    texts = [" ".join(rng.choices("the cat sat on a mat; 12 und über die Katze".split(), k=rng.randrange(1, 25))) for _ in range(24)]
    texts += ["", texts[0], texts[0], "zz ## 99"]
    trusted = [i < 16 for i in range(len(texts))]
    rows = [(i, "en", t, ok, i % 2) for i, (t, ok) in enumerate(zip(texts, trusted, strict=True))] + [(3, "en", texts[3], True, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, trusted boolean, half int")
    model = ngram_model.ByteModel(docs.filter("trusted").select("text", "half"))
    got = ngram_model.score(docs, model, head).collect()
    assert len(got) == len(rows)
    own = [[t for _, _, t, ok, h in rows if ok and h == half] for half in (0, 1)]
    halves = [plain_byte_model(t, order) for t in own]
    for r in got:
        t = texts[r.doc_id].encode()
        if not t:
            assert r.perplexity is None
            continue
        b = b"\n" * (order - 1) + re.sub(rb"[0-9]", b"0", t)
        logs = [sum(math.log(p(b[k : k + order])) for k in range(len(t))) for p in halves]
        log_p = logs[1 - r.doc_id % 2] if r.trusted else sum(logs) / 2
        assert r.perplexity == pytest.approx(math.exp(-log_p / len(t)), rel=1e-5)


def test_quality_without_trust(spark):
    got = quality.classify(frame(spark, ODD), spark.createDataFrame([], "doc_id long"))
    assert {r.keep for r in got.collect()} == {False}
    assert quality.classify(empty(spark), spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_quality_limit_is_the_quantile(spark):
    docs = frame(spark, [(i, " ".join(random.Random(i).choices("alpha beta gamma delta".split(), k=30))) for i in range(30)] + [(40, "beta " * 30), *ODD])
    trusted = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    got = quality.classify(docs, trusted).collect()
    assert len(got) == 31 + len(ODD) and {r.limit for r in got} == {max(r.perplexity for r in got if r.doc_id is not None and r.doc_id < 30 and r.perplexity)}
    assert all(r.keep == (r.perplexity is not None and r.perplexity <= r.limit) for r in got)


def test_quality_sees_the_order_of_words(spark):
    def sentences(seed):
        r = random.Random(seed)
        return [w for _ in range(12) for w in ("the", r.choice(["cat", "dog", "bird"]), "sat", "on", "a", r.choice(["mat", "roof", "tree"]), "and", "saw", "my", "old", "house")]

    mixed, turned = [sentences(i) for i in range(70, 80)], [sentences(i) for i in range(80, 90)]
    for i, t in enumerate(mixed):
        random.Random(i).shuffle(t)
    rows = [(i, " ".join(sentences(i))) for i in range(70)] + [(100 + i, " ".join(t)) for i, t in enumerate(mixed)] + [(200 + i, "".join(reversed(" ".join(t)))) for i, t in enumerate(turned)]
    got = quality.classify(frame(spark, rows), spark.createDataFrame([(i,) for i in range(60)], "doc_id long")).collect()
    assert not any(r.keep for r in got if r.doc_id >= 100) and sum(r.keep for r in got if 60 <= r.doc_id < 70) >= 8


# --- 2 surrogates ----------------------------------------------------------------------


def test_surrogates_keep_type_and_coreference(spark):
    rows = [(1, "Mr. John Smith and Mrs. Anna Smith; Mr. Smith. Write JOE@EX.COM or joe@ex.com"), (2, "call +49 (030) 123-4567, pay 4111 1111 1111 1111 or 4111111111111111 from 10.0.0.7"), (3, "Mr. John Smith 10.0.0.7")]
    got = {r.doc_id: r for r in surrogates.replace_entities(frame(spark, [*rows, *ODD]), "key").collect() if r.doc_id in (1, 2, 3)}
    one, three = got[1].text, got[3].text
    man = re.match(r"Mr\. (\S+) (\S+) and Mrs\. (\S+) (\S+); Mr\. (\S+)\. Write (\S+) or (\S+)", one)
    assert man[2] == man[4] == man[5] and man[1] != man[3] and man[6].lower() == man[7] and man[6].isupper()
    assert three.startswith(f"Mr. {man[1]} {man[2]} ") and "Smith" not in one
    two = re.match(r"call \+49 \((\d{3})\) (\d{3}-\d{4}), pay (\d{4} \d{4} \d{4} \d{4}) or (\d{16}) from (\d+\.\d+\.\d+\.\d+)", got[2].text)
    assert two[3].replace(" ", "") == two[4] != "4111111111111111" and three.endswith(two[5])
    digits = [int(c) for c in two[4]][::-1]
    assert sum(digits[0::2] + [sum(divmod(2 * x, 10)) for x in digits[1::2]]) % 10 == 0
    assert got[1].n_entities == 5


def test_surrogates_of_every_mention_of_a_person(spark):
    rows = [
        (1, "Mr. John Smith wrote. Later John Smith called. John is nice, says JOHN; a john is not."),
        (2, "Dr. Anna Kern came. Mrs. Anna Kern sat. Mrs. ANNA KERN left with Annabel, Kernel and Anna."),
        (3, "Dr. Γιώργος Παπαδόπουλος και ο Παπαδόπουλος"),
        (4, "Prof. Ivo Rau and Herr Rau"),
        (5, "John Smith has no title here."),
    ]
    got = {r.doc_id: r.text for r in surrogates.replace_entities(frame(spark, rows), "key").collect()}
    m = re.fullmatch(r"Mr\. (\S+) (\S+) wrote\. Later (\S+) (\S+) called\. (\S+) is nice, says (\S+); a john is not\.", got[1])
    assert m[1] == m[3] == m[5] and m[6] == m[1].upper() and m[2] == m[4] and not {"John", "Smith"} & set(m.groups())
    m = re.fullmatch(r"Dr\. (\S+) (\S+) came\. Mrs\. (\S+) (\S+) sat\. Mrs\. (\S+) (\S+) left with Annabel, Kernel and (\S+)\.", got[2])
    assert m[1] == m[3] == m[7] and m[5] == m[1].upper() and m[2] == m[4] and m[6] == m[2].upper()
    assert m[1].endswith(tuple(surrogates.LATIN[2]["f"])) and got[4].split()[1].endswith(tuple(surrogates.LATIN[2]["m"]))
    m = re.fullmatch(r"Dr\. (\S+) (\S+) και ο (\S+)", got[3])
    assert m[2] == m[3] != "Παπαδόπουλος" and all("\u0370" <= c <= "\u03ff" for c in m[1] + m[2])
    assert got[5] == rows[4][1]


def iban_ok(text):
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_surrogates_of_numbers_and_keys(spark):
    found = ["123-45-6789", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "2001:db8::ff00:42", "AKIA" + "ABCD1234" * 2, "ghp_" + "aB3" * 12, "0123abcdef" * 20, "jörg.müller@post.de", "221 Baker Street", "Hauptstraße 12", "12 rue de Rivoli"]
    left = ["DE89 3704 0044 0532 0130 01", "12:30:45", "2020-01-02", "ABCD", "10 Downing"]
    rows = [(k, f"see {x} now") for k, x in enumerate(found + left)] + [(99, "SSN 123456789 or 123-45-6789 and " + found[1].replace(" ", ""))]
    got = {r.doc_id: r.text for r in surrogates.replace_entities(frame(spark, rows), "key").collect()}
    for k, x in enumerate(found):
        new = got[k][4:-4]
        assert new != x and re.sub(r"\w", "w", new) == re.sub(r"\w", "w", x), x
        assert [c.isdigit() for c in new if x[:4] == "221 "] == [c.isdigit() for c in x if x[:4] == "221 "]
    assert iban_ok(found[1]) and iban_ok(got[1][4:-4]) and iban_ok(got[2][4:-4]) and got[1][4:6] == "DE"
    assert got[4].startswith("see AKIA") and got[5].startswith("see ghp_") and got[8].endswith("Street now") and "straße" in got[9] and "rue de" in got[10]
    assert [got[len(found) + k] for k in range(len(left))] == [f"see {x} now" for x in left]
    assert got[0][4:-4] in got[99] and got[1][4:-4].replace(" ", "") in got[99]


def test_surrogates_in_a_crowded_format(spark):
    """Every telephone number of a small format is a real one: surrogates grow by a digit."""
    rows = [(k, f"({k:02d}) 000-0000") for k in range(100)] + [(1000, "Mr. Bo")]
    values = spark.createDataFrame([("phone", f"{k:02d}") for k in range(100)], "kind string, value string")
    made = {r.value: r.made for r in surrogates.assign(values, "key").collect()}
    assert len(set(made.values())) == 100 and not set(made) & set(made.values())
    assert len({r.text for r in surrogates.replace_entities(frame(spark, rows), "key").collect()}) == 101


def test_surrogates_stay_distinct_in_a_small_space(spark):
    docs = frame(spark, [(i, f"{c}@{d}.co") for i, (c, d) in enumerate((c, d) for c in "abcdef" for d in "xyzw")])
    got = [r.text for r in surrogates.replace_entities(docs, "key").collect()]
    assert len(set(got)) == 24 and not set(got) & {f"{c}@{d}.co" for c in "abcdef" for d in "xyzw"}
    assert surrogates.replace_entities(empty(spark), "key").count() == 0
    odd = surrogates.replace_entities(frame(spark, ODD), "key").select("doc_id", "text").collect()
    assert sorted(map(str, odd)) == sorted(map(str, frame(spark, ODD).select("doc_id", "text").collect()))


# --- 3 toxicity ------------------------------------------------------------------------


def test_gradients_match_differences():
    import pyarrow as pa

    raw, offsets = T.flat(pa.array(["bad good words here", "some other text"]), 0, 2)
    w, net, label = toxicity.Words(raw, offsets), toxicity.BiGru(1), np.array([1.0, 0.0], np.float32)
    sequence, start, _ = w.sequence()
    index = sequence[start[[0, -1]][:, None] + np.arange(toxicity.WINDOW)]

    def loss():
        logit = net.forward(net.inputs(w), index).astype(float)
        return float(np.mean(np.log1p(np.exp(-np.where(label > 0, logit, -logit)))))

    grads = net.gradients(w, index, label, np.ones(2, np.float32))
    for name in ("Wl", "Ur", "A", "v", "o", "bl"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(grads[name][at]), rel=0.1, abs=1e-4)


def plain_logit(net, w, window):
    """One window of word numbers through the network, word by word."""
    p, x = net.p, net.inputs(w)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    states = {}
    for d, order in (("l", range(len(window))), ("r", reversed(range(len(window))))):
        h = np.zeros(toxicity.HIDDEN)
        for t in order:
            f, u = x[window[t]] @ p[f"W{d}"] + p[f"b{d}"], h @ p[f"U{d}"]
            z, r, c = (slice(k * toxicity.HIDDEN, (k + 1) * toxicity.HIDDEN) for k in range(3))
            new = np.tanh(f[c] + sigmoid(f[r] + u[r]) * u[c])
            h = new + sigmoid(f[z] + u[z]) * (h - new)
            states[d, t] = h
    both = [np.concatenate((states["l", t], states["r", t])) for t in range(len(window))]
    weight = np.exp([np.tanh(s @ p["A"] + p["a"]) @ p["v"] for s in both])
    return sum(a * s for a, s in zip(weight / weight.sum(), both, strict=True)) @ p["o"] + p["c"][0]


def test_every_overlapping_window_is_scored(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(toxicity, "SIDE_BY_SIDE", 7)
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["sun", "moon", "vile", "é", "12", "road"], k=k)) for k in (30, 0, 1, 3, 8, 9, 0, 25)]
    w, net = toxicity.Words(*T.flat(pa.array(texts), 0, len(texts))), toxicity.BiGru(3)
    got = {int(t): float(v) for t, _, v in zip(*net.worst(w), strict=True)}
    want = {}
    for k, t in enumerate(texts):
        own = w.number[w.first[k] : w.first[k + 1]]
        if len(own):
            want[k] = max(plain_logit(net, w, own[a : a + toxicity.WINDOW]) for a in range(max(1, len(own) - toxicity.WINDOW + 1)))
        assert len(own) == len(t.split())
    assert got == pytest.approx(want, abs=1e-4)


def test_byte_runs_of_words():
    import pyarrow as pa

    w = toxicity.Words(*T.flat(pa.array(["abc worthless", "worthy abc"]), 0, 2))
    runs = defaultdict(set)
    for g, o in zip(w.long_gram.tolist(), w.long_owner.tolist(), strict=True):
        runs[o].add(g)
    by_word = {n: runs[k] for n, k in zip(("abc", "worthless"), w.number[w.first[0] : w.first[1]], strict=True)} | {"worthy": runs[w.number[w.first[1]]]}
    assert {n: len(r) for n, r in by_word.items()} == {"abc": 1, "worthless": 7 + 6 + 5 + 4, "worthy": 4 + 3 + 2 + 1}
    assert len(by_word["worthless"] & by_word["worthy"]) == 2 + 1  # worth with and without the start


def test_toxicity_of_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.train(empty(spark), labels) is None and toxicity.score(empty(spark), None).count() == 0


def test_toxicity_learns_and_reads_whole_texts(spark):
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choices(["sun", "moon", "tree", "lake", "road", "hill", "bird"], k=rng.randrange(20, 60)))
    rows = [(1000 + i, plain() + (" you vile fool " if i % 2 else " ") + plain()) for i in range(300)]
    docs = frame(spark, [*rows, *ODD])
    labels = spark.createDataFrame([(1000 + i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    right = [(r.score >= 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id is not None and 1200 <= r.doc_id < 1300]
    assert sum(right) >= 95 and len(got) == 300 + len(ODD)
    assert {r.score for r in got if r.doc_id in (7, 8, 9)} == {0.0}
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.filter("toxic = 0"))).collect()} == {0.0}


# --- 4 line dedup ----------------------------------------------------------------------


def test_line_dedup(spark):
    long = "This line is long enough to be counted as a key, "
    rows = [(i, f"own {i}\n  {long.upper() if i % 2 else long}\t\nshort") for i in range(6)] + [(20, f"{long}a\n{long}a"), *ODD]
    got = line_dedup.drop_shared_lines(frame(spark, rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[i].n_dropped for i in range(6)] == [1] * 5 + [0] and by[0].text == "own 0\nshort" and by[20].n_dropped == 0
    assert (by[7].n_lines, by[7].text, by[9].n_lines) == (1, "", 3)
    assert line_dedup.drop_shared_lines(empty(spark)).count() == 0


def test_line_dedup_is_the_same_when_keys_are_not_sent(spark, monkeypatch):
    lines = [f"line number {k} that is long enough to count here" for k in range(6)]
    rows = [(i, "\n".join(lines[k] for k in range(6) if i % (k + 1) == 0)) for i in range(40)]
    collect = lambda: Counter(map(tuple, line_dedup.drop_shared_lines(frame(spark, rows)).collect()))
    sent = collect()
    monkeypatch.setattr(line_dedup, "COMMON_SENT", 2)
    assert collect() == sent and sum(r[2] > 0 for r in sent) > 30


def test_line_dedup_counts_documents_not_rows(spark):
    line = "x" * 45
    rows = [(1, line)] * 9 + [(2, line + "\n" + line), (3, line), (4, line)]
    assert {r.n_dropped for r in line_dedup.drop_shared_lines(frame(spark, rows)).collect()} == {0}


# --- 5 byte-level BPE ------------------------------------------------------------------


def test_bpe_holds_few_pieces(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    monkeypatch.setattr(bpe, "CACHE", 50)
    own = bpe.BytePairCodec(bpe.load_ranks(path), public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(8)
    for _ in range(20):
        texts = [" ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(rng.randrange(0, 30))) for _ in range(4)]
        assert list(own.encode_all(texts)) == [other.encode_ordinary(t) for t in texts]
        assert len(own.cache) <= 50
    assert bpe.round_trip(empty(spark), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_is_the_library(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.BytePairCodec(bpe.load_ranks(path), public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["", "a", "aaaa" * 500, "<|endoftext|> 'Tis 　 x", "ÄÖ ß — 日本語のテキスト 🙂🙂", "".join(map(chr, range(1, 2000)))]
    texts += ["".join(rng.choice("abcdefgh xyzéü\n 0123,.!") for _ in range(rng.randrange(200))) for _ in range(200)]
    for t in texts:
        assert own.encode(t) == other.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t.encode()
    word = "qwzxjkvb" * 30
    assert own._encode_long(word.encode()) == other.encode_ordinary(word)
    docs = frame(spark, ODD)
    coded = bpe.encode_documents(docs, path, public_tokenizers.PATTERN)
    back = Counter((r.doc_id, bytes(r.bytes)) for r in bpe.decode_documents(coded, path, public_tokenizers.PATTERN).collect())
    assert back == Counter((i, (t or "").encode()) for i, t in ODD)
    for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN, with_ids=True).filter("doc_id = 10").collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()


# --- 6 language ------------------------------------------------------------------------


def test_language_id(spark):
    stems = {"en": "the of and with that have".split(), "de": "der und nicht für über schön".split()}
    rows = [(i, lang, " ".join(random.Random(i).choices(stems[lang], k=30))) for i in range(200) for lang in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.train(docs.filter("doc_id < 100"))
    got = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang_pred == r.lang and not r.rejected and 0 <= r.score <= 1.000001 for r in got)
    odd = {r.doc_id: r for r in language_id.predict(frame(spark, ODD), model).collect()}
    assert {odd[i].lang_pred for i in (7, 8, 9, 13)} == {"und"} and odd[12].lang_pred != "und" and odd[11].rejected
    assert language_id.train(docs.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


# --- 7 sharding ------------------------------------------------------------------------


def test_longest_processing_time():
    assert sorted(Counter(sharding.schedule([(k, s) for k, s in enumerate([7, 6, 5, 4, 3, 3])], 2).values()).values()) == [3, 3]


def test_many_groups_of_one_size_go_where_the_heap_puts_them():
    rng = random.Random(11)
    for _ in range(200):
        loads = np.array([rng.randrange(200) for _ in range(5)])
        size, many = rng.randrange(1, 60), rng.randrange(1, 90)
        want, heap = Counter(), [(int(load), s) for s, load in enumerate(loads)]
        for _ in range(many):
            load, shard = min(heap)
            want[shard] += 1
            heap[heap.index((load, shard))] = (load + size, shard)
        assert sharding._filled(loads, size, many).tolist() == [want[s] for s in range(5)]


@pytest.mark.parametrize("one_by_one, sent", [(256, 200_000), (1, 5)])
def test_sharding_law(spark, monkeypatch, one_by_one, sent):
    monkeypatch.setattr(sharding, "ONE_BY_ONE", one_by_one)
    monkeypatch.setattr(sharding, "SENT", sent)
    rng = random.Random(5)
    rows = [(i, "w" * rng.randrange(400) + str(i)) for i in range(3000)] + [(5000 + i, "the same text") for i in range(300)] + ODD
    got = sharding.assign_shards(frame(spark, rows), 8).collect()
    every = Counter()
    for _, t in rows:
        every[t or ""] += len((t or "").encode()) + 8
    plain = Counter()
    for key, shard in sharding.schedule(list(every.items()), 8).items():
        plain[shard] += every[key]
    own = Counter()
    for r in got:
        own[r["shard"]] += r["size"]
    assert own == plain  # all groups in the order of their size
    loads, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    texts = Counter(zlib.crc32((t or "").encode()) for _, t in rows)
    for r in got:
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert Counter(r["text_crc32"] for r in got) == texts and len(loads) == 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in groups.values())
    assert sharding.assign_shards(empty(spark)).count() == 0


# --- 8 Jaccard join --------------------------------------------------------------------


def roots_by_force(rows):
    """The number of shingles of each row and the number of a row of its class."""
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = words(t, r"[^\x20\x09-\x0d]+")
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
                parent[find(a)] = find(b)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def classes_by_force(rows):
    found, least = roots_by_force(rows), {}
    for (i, _), (_, root) in zip(rows, found, strict=True):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    return Counter((i, n, least.get(root, i)) for (i, _), (n, root) in zip(rows, found, strict=True))


@pytest.mark.parametrize("boundary", [0, 5])
def test_jaccard_classes(spark, monkeypatch, boundary):
    monkeypatch.setattr(jaccard_join, "choose_boundary", lambda sizes, percent: boundary)
    rng, rows = random.Random(3), []
    for k in range(250):
        base = random.Random(k % 40)
        w = [base.choice("abcdefghijklmnop") + str(base.randrange(9)) for _ in range(base.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            if w:
                w[rng.randrange(len(w))] = f"z{rng.randrange(4)}"
        rows.append((100 + k, " ".join(w)))
    rows += ODD
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(frame(spark, rows)).collect())
    assert got == classes_by_force(rows)


@pytest.mark.parametrize("turns", [0, 5])
def test_jaccard_rows_without_id(spark, monkeypatch, turns):
    """A row with a null id bridges two documents, copies of it don't multiply, and null ids alone make classes too."""
    monkeypatch.setattr(jaccard_join, "TURNS", turns)
    base = [f"w{k}" for k in range(64)]
    near = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(base))
    other = [f"v{k}" for k in range(50)]
    rows = [(5, near()), (None, near(3)), (None, near(3)), (1, near(3, 60)), (None, " ".join(other)), (None, " ".join([*other[:-1], "y"])), (9, "a b"), (None, "a b"), (9, "other text of the same id"), *ODD]
    got = jaccard_join.jaccard_classes(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == classes_by_force(rows)
    alone = [r["class"] for r in got if r.doc_id is None and r.n_shingles == 46]
    assert len(alone) == 2 and len(set(alone)) == 1


def test_jaccard_hot_passage(spark):
    """One passage in most documents, whose lists are long, makes no link by itself."""
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(k, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([1, 2, 8, 60])))) for k in range(300)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(frame(spark, rows)).collect())
    assert got == classes_by_force(rows)


def test_boundary_weighs_lists_against_subsets():
    cheap, dear = {n: (100, 100.0) for n in range(1, 10)}, {n: (100, 1e7) for n in range(1, 10)}
    assert jaccard_join.choose_boundary(cheap, 80) < jaccard_join.choose_boundary(dear, 80)


def test_jaccard_lists_alone(spark, monkeypatch):
    """Without the sure links of step 2, the lists find every link, at similarities on both sides of the bound."""
    monkeypatch.setattr(jaccard_join, "TURNS", 0)
    rng, rows = random.Random(17), []
    for k in range(200):
        base = random.Random(k % 8)
        w = [f"w{base.randrange(5000)}" for _ in range(base.randrange(60, 700))]
        for _ in range(rng.randrange(0, 1 + len(w) // 30)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(3000)}"
        rows.append((k, " ".join(w)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(frame(spark, rows)).collect())
    assert got == classes_by_force(rows)
    assert 8 < len({c for _, _, c in got}) < 200


def test_sketch_bound():
    rng = np.random.default_rng(8)
    for n in (1, 40, 900):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.r_[a[rng.random(len(a)) < 0.8], rng.integers(0, 2**64, rng.integers(0, n), dtype=np.uint64)])
            apart = sum(int(v).bit_count() for v in (jaccard_join.sketch(a) ^ jaccard_join.sketch(b)).view(np.uint64))
            assert apart <= len(np.setxor1d(a, b))


def test_jaccard_bounds(spark):
    assert jaccard_join.overlap(5, 5, 80) == 5 and jaccard_join.overlap(9, 9, 80) == 8
    assert list(jaccard_join.partner_sizes(5, 80)) == [4, 5, 6]
    assert jaccard_join.jaccard_classes(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    nodes = list(got)
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a in nodes[:60] for b in nodes)


# --- 9 top-k ---------------------------------------------------------------------------


def test_exact_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(500)]
    rows += [(500 + i, rows[3][1]) for i in range(30)] + [(900, None), (901, [float("nan")] * 16), (902, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS v", "3 AS q")
    got = defaultdict(list)
    for r in exact_topk.top_k(df, F.col("id") % 20 == 0, k=7, block=64).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.floor(64 * np.array(v, np.float32).astype(float)) for i, v in rows[:530]}
    for i in [i for i in good if i % 20 == 0]:
        want = sorted(((-int(good[i] @ v), j) for j, v in good.items() if j != i))[:7]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]
    assert exact_topk.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_exact_topk_searches_each_length(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(1 if i == 0 else 5 if i % 3 else 8).astype(np.float32).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk.top_k(df, F.col("id") % 20 == 0, k=4, block=16).collect()}
    good = {i: np.floor(64 * np.array(v, np.float32).astype(float)) for i, v in rows}
    want = set()
    for i in range(0, 90, 20):
        ranked = sorted((-int(good[i] @ v), j) for j, v in good.items() if j != i and len(v) == len(good[i]))[:4]
        want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(ranked)}
    assert got == want and len(want) == 16


@pytest.mark.parametrize("size", [1.0, 1e6, 3e6])
def test_exact_topk_against_big_integers(spark, size):
    rng = np.random.default_rng(2)
    close = rng.standard_normal(64)
    rows = [(i, ((close + 1e-3 * rng.standard_normal(64) if i % 2 else rng.standard_normal(64)) * size).tolist()) for i in range(500)] + [(None, [1.0] * 64), (40, [1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in exact_topk.top_k(df, F.col("id") % 20 == 0, k=20, block=640).collect()}
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None]
    for i in range(0, 500, 20):
        own = [v for j, v in good if j == i]
        want = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for q in own for j, v in good if j != i)[:20]
        assert [got[i, r + 1] for r in range(20)] == [(j, -s) for s, j in want]


def test_exact_topk_past_bigint(spark):
    df = spark.createDataFrame([(i, [1e8 + i] * 64) for i in range(21)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="BIGINT"):
        exact_topk.top_k(df, F.col("id") % 20 == 0).collect()


def test_segment_bounds_prune():
    rng = np.random.default_rng(3)
    q, c = (exact_topk.Side(np.arange(n) + 1000 * n, rng.integers(-200, 200, (n, 64))) for n in (30, 400))
    true = q.x @ c.x.T
    for own, other in zip(q.levels, c.levels, strict=True):
        assert (own @ other.T + 1e-6 >= true).all()
    search = exact_topk.Search(q, 5, np.sort(true, axis=1)[:, -5])
    search.see(c)
    i, ids, score = search.cut()
    assert (np.bincount(i) == 5).all() and (score.reshape(30, 5) == -np.sort(-true, axis=1)[:, :5]).all()
    assert search.tested[-1] < 0.75 * true.size and (np.diff(search.tested) <= 0).all()


# --- 10 decontamination ----------------------------------------------------------------


def hits_by_force(rows, items, size=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    out = Counter()
    for i, t in rows:
        w, hit, own = words(t, pattern), set(), set()
        for item, text in items:
            b = words(text, pattern)
            n = min(size, len(b))
            for s in range(len(b) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[s : s + n]:
                        hit |= set(range(p, p + n))
                        own.add(str(item))
        out[i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_contamination(spark, block_words):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 8, 11, 14])))) for k in range(12)] + [(50, ""), (51, None), (3, "w1 w2 unseen")]
    rows = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) + " " + (rng.choice(items)[1] or "").upper()) for k in range(60)] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.find_contamination(frame(spark, rows), bench, block_words=block_words))
    assert Counter(tuple(r) for r in got.collect()) == hits_by_force(rows, items)
    assert decontaminate.find_contamination(empty(spark), bench).count() == 0
    assert {r.contaminated for r in decontaminate.digest(decontaminate.find_contamination(frame(spark, rows), bench.limit(0))).collect()} == {False}
