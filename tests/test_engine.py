import glob
import importlib
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from recollect import catalog
from recollect.functions import hashes
from recollect.functions import scalars as S
from recollect.operators import access, audit, govern, graph, lexical, rag, recall, replicate, write
from recollect.sources import log
from recollect.streaming import sync

MEMORY = "id long, sk string, layer int, key string, text string, embedding array<double>, importance double, confidence double, state int, scope string, valid_from long, valid_until long, source int, created_tick long, entities array<string>"


def memory(i, key, embedding=None, text="", layer=4, state=0, scope="", importance=0.5, window=(None, None), entities=()):
    return (i, f"md/L{layer}/{key}", layer, key, text, embedding, importance, 0.5, state, scope, *window, 0, i, list(entities))


def plain(rows):
    return sorted(tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_agree_with_sql(spark, data, duck, name):
    got = catalog.queries()[name](spark, data)
    names = sorted(got.columns)
    want = duck.execute(f"select {', '.join(names)} from ({catalog.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    rows = lambda found: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in found), key=key)
    assert rows(tuple(r) for r in got.select(*names).collect()) == rows(want)


def test_entry_and_registration(spark, data):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).columns == ["sk", "ham", "score", "dist"]
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_hamming_counts_longer_tails(spark):
    row = spark.createDataFrame([([1.0, -1.0] * 40,)], "embedding array<double>")
    words = S.sign_words(F.col("embedding"), 80)
    assert row.select(S.hamming(words, S.query_words([1.0] * 64))).first()[0] == 32 + 8


def test_recall_filters_inside_the_pool(spark):
    rows = [memory(i, f"k{i:03}", [1.0, i / 100.0, 0.0, 0.0], state=int(i < 15)) for i in range(40)]
    df = spark.createDataFrame(rows, MEMORY)
    assert recall.recall(df, [1.0, 0.0, 0.0, 0.0], 1).count() == 1
    assert recall.recall(df, [1.0, 0.0, 0.0, 0.0], 1, oversample=1).count() == 0  # nothing is refilled after the cut
    assert recall.recall(df, [], 5).count() == 0
    with pytest.raises(ValueError):
        recall.recall(df, [float("nan")], 1)


def test_global_recall_never_sees_scopes(spark):
    df = spark.createDataFrame([memory(1, "a", [1.0, 0.0], scope="user/ana"), memory(2, "b", [1.0, 0.1])], MEMORY)
    assert [r.sk for r in recall.recall(df, [1.0, 0.0], 5).collect()] == ["md/L4/b"]
    assert [r.sk for r in recall.recall(df, [1.0, 0.0], 5, scope="user/ana").collect()] == ["md/L4/a"]


def test_temporal_penalty(spark):
    df = spark.createDataFrame([memory(1, "a", [1.0], window=(1000, 2000)), memory(2, "b", [1.0], window=(3000, 4000)), memory(3, "c", [1.0])], MEMORY)
    got = {r.key: r.tpen for r in recall.temporal(df.withColumn("dist", F.lit(0.0)), 1500, 0.5, 0.5).collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 1.0}
    assert [r.key for r in recall.valid_at(df, 1500).collect()] == ["a", "c"]


def test_entities_count_repeats(spark):
    df = spark.createDataFrame([memory(1, "a", entities=["p/x"]), memory(2, "b", entities=["p/x", "q/y"])], MEMORY)
    got = recall.entities(df, ["p/x", "p/x", "q/y"], 5).collect()
    assert [(r.key, r.overlap) for r in got] == [("b", 3), ("a", 2)]
    assert recall.entities(df, [], 5).count() == 0


def test_lexical_score(spark):
    df = spark.createDataFrame([memory(1, "a", text="Red red fox"), memory(2, "b", text="fox"), memory(3, "c", text="")], MEMORY)
    got = {r.sk: (r.score, r.matched) for r in lexical.search(df, ["red", "fox"], 5).collect()}
    idf = lambda n: math.log(3 / (n + 1)) + 1
    assert got["md/L4/a"][0] == pytest.approx((1 + math.log(2)) * idf(1) + idf(2))
    assert got["md/L4/a"][1] == ["fox", "red"]


def test_prefix_conflicts(spark):
    rng = random.Random(1)
    keys = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(60)})
    got = {(r.sk, r.other) for r in access.prefix_conflicts(spark.createDataFrame([(k,) for k in keys], "sk string")).collect()}
    assert got == {(a, b) for a in keys for b in keys if a != b and b.startswith(a)}


def test_resolution_order_and_bad_keys(spark):
    df = spark.createDataFrame([memory(1, "x", layer=2), memory(2, "x", layer=5), memory(3, "x", layer=3)], MEMORY)
    assert access.resolve(df.select("key"), df).first().sk == "md/L5/x"
    bad = access.bad_keys(spark.createDataFrame([("",), ("a#b",), ("a/../b",), ("a\x01",), ("fine",)], "key string"))
    assert {r.why for r in bad.collect()} == {"empty", "hash", "dots", "control"}


CLOCKS = [{}, {0: 1}, {0: 2}, {1: 1}, {0: 1, 1: 1}, {0: 2, 1: 1}, {2: 5, 300: 1}]


def test_clock_lattice(spark):
    rows = [(a, b) for a in CLOCKS for b in CLOCKS]
    df = spark.createDataFrame(rows, "a map<int,long>, b map<int,long>")
    ab, ba = S.clock_merge(F.col("a"), F.col("b")), S.clock_merge(F.col("b"), F.col("a"))
    got = df.select("a", "b", ab.alias("ab"), ba.alias("ba"), S.clock_order(F.col("a"), F.col("b")).alias("o"), S.clock_order(F.col("b"), F.col("a")).alias("p")).collect()
    swap = {"before": "after", "after": "before", "equal": "equal", "concurrent": "concurrent"}
    for r in got:
        want = {k: max(r.a.get(k, 0), r.b.get(k, 0)) for k in r.a | r.b}
        assert r.ab == want == r.ba
        assert r.p == swap[r.o]


def test_clamped_fold_is_not_a_clamped_sum(spark):
    log_ = spark.createDataFrame([(1, 1, "feedback", 0.9, 0.0), (1, 2, "feedback", -0.3, 0.0), (1, 0, "reinforce", 0.0, 0.0)], "slot long, seq long, op string, d_importance double, d_confidence double")
    assert write.fold_signals(log_).first().importance == pytest.approx(0.7)


def test_fold_in_runs_is_the_fold_in_steps(spark, monkeypatch):
    monkeypatch.setattr(write, "SIGNALS_PER_RUN", 7)
    rng = random.Random(3)
    rows = [(rng.randrange(3), k, rng.choice(["reinforce", "feedback", "touch"]), rng.uniform(-0.6, 0.6), rng.uniform(-0.2, 0.2)) for k in range(300)]
    got = {r.slot: r for r in write.fold_signals(spark.createDataFrame(rows, "slot long, seq long, op string, d_importance double, d_confidence double").repartition(5)).collect()}
    for slot in range(3):
        x = y = 0.5
        for own, k, op, a, b in rows:
            if own == slot and op != "touch":
                x, y, last = min(max(x + a, 0), 1), min(max(y + b, 0), 1), k
        assert (got[slot].importance, got[slot].confidence, got[slot]["last"]) == (pytest.approx(x), pytest.approx(y), last)


def test_windows_and_invalidation(spark):
    df = spark.createDataFrame([memory(1, "a", window=(10, 20)), memory(2, "b", window=(50, 60))], MEMORY)
    got = {r.key: (r.valid_from, r.valid_until) for r in write.invalidate(df, 30).collect()}
    assert got == {"a": (10, 30), "b": (None, None)}


def test_lifecycle_sees_its_own_promotions(spark):
    df = spark.createDataFrame([memory(0, "k", layer=1, importance=0.9)], MEMORY)
    got = {(r.layer, r.state) for r in govern.lifecycle_tick(df, 100).collect()}
    assert got == {(1, 2), (2, 0)}  # the copy takes its layer's importance and stays there
    assert govern.decay(df.withColumn("layer", F.lit(3)), 2000, 1000, decayed_at=0.3).first().new_state == 4


def test_merge_policy_and_author(spark):
    df = spark.createDataFrame([(4, "s", {0: 1}, {1: 1}, "a", "b", 0, 0), (0, "t", {0: 1}, {0: 1}, "a", "a", 0, 0), (3, "u", None, {0: 1}, None, "a", None, 0)], "layer int, sk string, local_clock map<int,long>, remote_clock map<int,long>, local_text string, remote_text string, local_state int, remote_state int")
    assert {r.sk: r.verdict for r in replicate.merge_verdicts(df).collect()} == {"s": "conflict", "t": "rejected", "u": "applied"}
    assert spark.createDataFrame([({3: 5, 1: 5, 2: 4},)], "c map<int,long>").select(replicate.author(F.col("c"))).first()[0] == 1


def test_fnv_golden(spark):
    assert f"{hashes.fnv1a(b'a'):016x}" == "af63dc4c8601ec8c"
    df = spark.createDataFrame([("s", ["a", "b"]), ("s", ["b", "a", "a"])], "s string, c array<string>")
    assert len({r[0] for r in df.select(hashes.conflict_id(F.col("s"), F.col("c"))).collect()}) == 1


def test_audit_finds_tampering(spark):
    rows = spark.createDataFrame([(i, "checkpoint", f"d{i}") for i in range(1, 5)], "seq long, op string, digest string")
    ledger = audit.chain(rows)
    assert tuple(audit.verify(ledger, "d4").first()) == (4, True, True, True)
    forged = ledger.withColumn("digest", F.when(F.col("seq") == 2, "x").otherwise(F.col("digest")))
    assert not audit.verify(forged, "d4").first().linked
    a = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    assert audit.state_digest(a).first() == audit.state_digest(a.orderBy(F.desc("k"))).first()


def test_context_budget_stops_at_first_overflow(spark):
    hits = spark.createDataFrame([(1, "short", 0.1), (2, "x" * 150, 0.2), (3, "y", 0.3), (4, None, 0.4)], "rank int, text string, dist double")
    assert [r.rank for r in rag.context_lines(hits, budget=60).collect()] == [1]
    assert rag.context_lines(hits, budget=0).count() == 3
    cut = spark.createDataFrame([("é" * 150,)], "t string").select(S.cut_bytes(F.col("t"), 5)).first()[0]
    assert cut == "éé…"


def test_lineage_guard_and_reflection(spark):
    v = spark.createDataFrame([("c", ["b"]), ("b", ["x", "a"]), ("a", [])], "vid string, parents array<string>")
    assert [r.vid for r in graph.lineage(v, "c").orderBy("depth").collect()] == ["c", "b", "a"]
    edges = spark.createDataFrame([], "kind string, a string, b string")
    one = spark.createDataFrame([("e1",)], "sk string")
    assert graph.reflect(edges, "lesson", one, one).count() == 3


def test_log_replay_and_volumes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", b"1"), (2, "b", b"2"), (3, "a", b""), (4, "b", b"3")], "seq long, key string, value binary")
    path = f"file://{tmp_path}/log"
    log.append(rows, path)
    assert [(r.key, bytes(r.value)) for r in log.replay(spark.read.parquet(path)).collect()] == [("b", b"3")]
    assert log.corrupt(spark.read.parquet(path)).count() == 0
    assert log.compact(spark, path, f"file://{tmp_path}/live").count() == 1
    data = log.encode_record(b"k", b"v") + log.encode_record(b"l", b"w") + log.encode_record(b"m", b"x")
    broken = data[:520] + b"\xff" + data[521:]
    for cut in range(0, len(data), 97):
        assert len(log.scan_volume(data[:cut])[0]) <= 3
    (tmp_path / "vol").write_bytes(data)
    assert log.read_volumes(spark, f"file://{tmp_path}/vol").count() == 3
    assert log.scan_volume(broken)[1] >= 1


def test_stream_equals_batch(spark, data, tmp_path):
    from recollect.plans import store

    source = store.oplog(spark, data).filter("op <> 'touch' and op <> 'remember'")
    source.repartition(1).sortWithinPartitions("seq").write.parquet(f"{tmp_path}/ops")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/ops")
    q = sync.fold_signals(stream).writeStream.format("memory").queryName("folded").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    got = {r.slot: round(r.importance, 9) for r in spark.sql("select * from folded").collect()}
    assert got == {r.slot: round(r.importance, 9) for r in write.fold_signals(source).collect()}


def test_content_types_and_scopes(spark):
    df = spark.createDataFrame([("{\"a\":1}",), ("fn main() { return x; }",), ("plain words; and more",), ("[x]",)], "t string")
    assert [r[0] for r in df.select(S.content_type(F.col("t"))).collect()] == ["json", "code", "text", "json"]
    assert S.opaque_scope("a b", "c/d") == "tenant/a%20b/agent/c%2Fd"
