import random
import time

import pytest
from pyspark.sql import functions as F

from recollect import catalog
from recollect.functions import hashes
from recollect.functions import scalars as S
from recollect.operators import govern, graph, lexical, observe, recall, replicate, tools, write
from recollect.sources import backend, documents, log
from recollect.streaming import envelope, sync

from .test_engine import MEMORY, memory


def vectors(spark, n=6, dims=4):
    return spark.createDataFrame([memory(i, f"k{i}", [1.0 + i] * dims, text=f"text {i}") for i in range(n)], MEMORY)


# --- guards ------------------------------------------------------------------------------


def test_reading_another_size_is_an_error(spark):
    with pytest.raises(ValueError, match="components"):
        recall.recall(vectors(spark), [1.0] * 5, 3)
    assert recall.recall(vectors(spark).limit(0), [1.0] * 5, 3).count() == 0


@pytest.mark.parametrize("bad", [[1.0] * 5, [], [float("nan")] * 4, [float("inf")] * 4, [1.0] * 4097])
def test_writing_a_bad_vector_is_an_error(spark, bad):
    rows = spark.createDataFrame([memory(1, "a", bad)], MEMORY)
    with pytest.raises(Exception, match="vector"):
        recall.guard_written(rows, [4]).collect()


def test_writing_good_vectors(spark):
    assert recall.guard_written(vectors(spark), [4]).count() == 6
    assert recall.guard_written(vectors(spark).withColumn("embedding", F.lit(None).cast("array<double>")), [4]).count() == 6


def test_a_key_that_begins_another_is_refused(spark):
    present = spark.createDataFrame([("turn:1",), ("other",)], "sk string")
    ok = spark.createDataFrame([("turn:1",), ("x:2",)], "sk string")
    assert {r.sk for r in write.guard_keys(ok, present).collect()} == {"turn:1", "x:2"}
    for key in ("turn:10", "turn", "oth"):
        with pytest.raises(Exception, match="begins"):
            write.guard_keys(spark.createDataFrame([(key,)], "sk string"), present).collect()


def test_unknown_labels_and_ghosts_are_refused(spark):
    rows = vectors(spark)
    with pytest.raises(Exception, match="content type"):
        write.set_content_type(rows, spark.createDataFrame([("md/L4/k1", "poem")], "sk string, content_type string")).collect()
    with pytest.raises(Exception, match="no memory"):
        write.ensure_meta(rows, rows, spark.createDataFrame([("md/L4/nobody",)], "sk string")).collect()


# --- scopes, companions ------------------------------------------------------------------


def test_effective_scope_prefers_its_own_then_l4_l5_l3(spark):
    rows = [memory(1, "a", layer=2), memory(2, "a", layer=3, scope="three"), memory(3, "a", layer=5, scope="five"), memory(4, "b", layer=2, scope="own"), memory(5, "b", layer=4, scope="four"), memory(6, "c", layer=2), memory(7, "c", layer=3), memory(8, "d", layer=7)]
    got = {r.sk: r.scope for r in recall.with_effective_scope(spark.createDataFrame(rows, MEMORY)).collect()}
    assert got["md/L2/a"] == "five" and got["md/L2/b"] == "own" and got["md/L2/c"] == "" and got["md/L7/d"] == "" and len(got) == len(rows)


def test_primary_of_a_companion(spark):
    rows = [memory(1, "a", layer=2, text="x"), memory(2, "a", layer=3, text='{"k": 1}'), memory(3, "b", layer=2, text="y"), memory(4, "b", [1.0], layer=4)]
    mem = spark.createDataFrame(rows, MEMORY)
    got = {r.sk: (r.rel, r.payload_type) for r in lexical.with_primary(mem.select("sk", "text"), mem).collect()}
    assert got == {"md/L2/a": ("md/L3/a", "json"), "md/L3/a": (None, "json"), "md/L2/b": ("md/L4/b", "embedding"), "md/L4/b": (None, "text")}


def test_lineage_of_a_cycle_and_of_odd_names(spark):
    rows = spark.createDataFrame([("d", ["c"]), ("c", ["b"]), ("b", ["c"]), ("it's", ["d"])], "vid string, parents array<string>")
    assert [r.vid for r in graph.lineage(rows, "d").orderBy("depth").collect()] == ["d", "c", "b"]
    assert [r.vid for r in graph.lineage(rows, "it's").orderBy("depth").collect()] == ["it's", "d", "c", "b"]
    assert graph.lineage(rows, "x' OR '1'='1").count() == 0


# --- upkeep ------------------------------------------------------------------------------


def test_decay_counts_from_the_last_reinforcement(spark):
    rows = spark.createDataFrame([memory(i, f"k{i}", layer=3, importance=0.9) for i in range(2)], MEMORY).withColumn("last_reinforced", F.when(F.col("id") == 1, 2000).otherwise(0).cast("long"))
    old, fresh = govern.decay(rows, 2000, 1000, decayed_at=0.3).orderBy("id").collect()
    assert old.new_state == 4 and old.changed and fresh.new_importance == 0.9 and not fresh.changed
    assert {r.changed for r in govern.decay(rows, 2000, 0).collect()} == {False}


def test_consolidation_is_idempotent(spark):
    rows = [memory(i, f"ts/{i:016x}/u", layer=2, text=t) for i, t in enumerate(["Hello World again!", "hello, world AGAIN", "hello world again", "once only", "b b b b", "B b b b", "b b b b", "x", "x", "x"])]
    episodes = spark.createDataFrame(rows, MEMORY)
    first = govern.consolidate(episodes, min_repeats=3, min_bytes=4)
    got = first.collect()
    assert [(r.text, r.n, r.new) for r in got] == [("b b b b", 3, True), ("Hello World again!", 3, True)]
    again = govern.consolidate(episodes, min_repeats=3, min_bytes=4, known=first.select("key", "text")).collect()
    assert [r.new for r in again] == [False, False]
    assert [r.norm for r in govern.consolidate(episodes, min_repeats=3, min_bytes=4, most_new=1).collect()] == ["b b b b"]
    later = govern.consolidate(episodes, min_repeats=3, min_bytes=4, most_new=1, known=first.filter("n > 0").limit(1).select("key", "text")).collect()
    assert [r.new for r in later] == [False, True]


def test_supersede_changes_each_memory_once(spark):
    pairs = spark.createDataFrame([("md/L4/k1", "md/L4/k2")] * 3, "old string, new string")
    assert write.supersede(vectors(spark), pairs).count() == 2


def test_empty_store_has_no_hint(spark):
    assert observe.empty_hint(vectors(spark).limit(0)).count() == 0
    assert "scope a" in observe.empty_hint(vectors(spark), "a").first().hint


def test_percentiles_pick_sorted_elements(spark):
    rng = random.Random(2)
    values = [rng.randrange(50) / 2 for _ in range(333)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = {r.share: r.value for r in observe.percentiles(rows, "x", [0.0, 0.5, 0.99, 1.0]).collect()}
    assert got == {s: sorted(values)[min(int(333 * s), 332)] for s in (0.0, 0.5, 0.99, 1.0)}


# --- peers -------------------------------------------------------------------------------


class Wire:
    def __init__(self, incoming=()):
        self.incoming, self.deltas, self.versions = list(incoming), [], []

    def receive(self):
        return self.incoming

    def send_delta(self, node, version):
        self.deltas.append((node, version))

    def send_version(self, node, version):
        self.versions.append((node, version))


def test_verdicts_of_peer_versions():
    own = sync.PeerVersions(1)
    assert [own.verdict(*p) for p in [(1, 5), (2, 0), (2, 3), (2, 3), (2, 1), (2, 4)]] == ["self_packet", "duplicate", "applied", "duplicate", "stale", "applied"]
    assert own.verdict(3, 1) == "conflict" and own.conflicts == [(3, 1)] and own.version == 0
    own.record_change()
    assert own.verdict(2, 9) == "conflict" and own.announce() == [(1, 1), (2, 9), (3, 1)]
    assert own.missing_after({2: 9}) == [(1, 1), (3, 1)]
    other = sync.PeerVersions(1)
    assert other.restore(own.state()) and other.announce() == own.announce() and not sync.PeerVersions(2).restore(own.state())


def test_sync_sends_what_a_peer_lacks_and_not_too_often():
    own = sync.PeerVersions(1)
    own.record_change()
    own.record_change()
    wire = Wire([(2, 1)])
    assert own.sync(0, wire) == ["conflict"] and wire.deltas == [(1, 2)] and wire.versions == [(1, 2)]
    own.record_change()
    assert own.sync(199, Wire()) == [] and own.unsent == [3]
    wire = Wire()
    own.sync(200, wire)
    assert wire.deltas == [(1, 3)] and wire.versions == [(1, 3)]


def test_versions_in_a_stream_are_judged_as_in_a_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(3), rng.choice([0, 1, 2, 7, 8]), k, rng.randrange(6)) for k in range(200)]
    df = spark.createDataFrame(rows, "local long, node long, seq long, value long")
    want = {tuple(r) for r in sync.judge_versions(df).collect()}
    assert {r[3] for r in want} == {"written", "self_packet", "duplicate", "stale", "applied", "conflict"}
    for part in range(4):
        df.filter(f"seq div 50 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    run = sync.apply_versions(files).writeStream.format("memory").queryName("judged").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {tuple(r) for r in spark.table("judged").select("local", "node", "seq", "verdict").collect()} == want


def test_envelopes_of_any_length(spark):
    signer = envelope.demo_signer(3)
    packets = spark.createDataFrame([(n, b) for n, b in [(0, b""), (255, b"x" * 70_000), (7, bytes(range(256)))]], "node int, payload binary")
    sealed = envelope.seal(packets, signer).collect()
    assert {(r.node, len(r.envelope)) for r in sealed} == {(0, 17), (255, 70_017), (7, 273)}
    cut = [(bytes(r.envelope)[:k],) for r in sealed for k in (0, 5, 9, len(r.envelope) - 1)]
    turned = [(bytes(r.envelope)[:-1] + bytes([r.envelope[-1] ^ 1]),) for r in sealed]
    odd = envelope.open_envelopes(spark.createDataFrame(cut + turned, "envelope binary"), signer).collect()
    assert not any(r.valid for r in odd) and all(r.payload is None for r in odd)
    opened = {r.node: bytes(r.payload) for r in envelope.open_envelopes(envelope.seal(packets, signer).select("envelope"), signer).collect() if r.valid}
    assert opened == {0: b"", 255: b"x" * 70_000, 7: bytes(range(256))}


def test_deciding_twice_changes_nothing(spark):
    conflicts = spark.createDataFrame([("s", ["a", "b"], 0), ("t", ["a", "b"], 1)], "subject string, candidates array<string>, status int")
    decided = spark.createDataFrame([("s", "prefer", "b", None), ("t", "prefer", "a", None)], "subject string, decision string, winner string, loser string")
    got = {r.subject: (r.status, r.winner, r.losers) for r in replicate.apply_decisions(conflicts, decided).collect()}
    assert got == {"s": (1, "b", ["a"]), "t": (1, None, None)}


# --- identities --------------------------------------------------------------------------


def test_folds_of_a_batch_are_folds_of_each():
    rng = random.Random(1)
    values = [rng.randbytes(rng.choice([0, 1, 7, 300])) for _ in range(50)]
    assert hashes.fold(values).tolist() == [hashes.fnv1a(v) for v in values] and hashes.fold([]).tolist() == []


def test_identities_follow_their_definition(spark):
    row = spark.createDataFrame([(3, 258, 4, "é/k", "s", ["b", "a", "b"])], "n int, t long, l int, k string, s string, c array<string>")
    got = row.select(hashes.memory_id(F.col("n"), F.col("t"), F.col("l"), F.col("k")).alias("m"), hashes.conflict_id(F.col("s"), F.col("c")).alias("c")).first()
    data = bytes([3]) + (258).to_bytes(8, "little") + bytes([4]) + "é/k".encode()
    lanes = hashes.fnv1a(data), hashes.fnv1a(data, hashes.OFFSET ^ hashes.SECOND_LANE)
    assert got.m == "".join(x.to_bytes(8, "little").hex() for x in lanes)
    a = b = hashes.OFFSET
    for x in b"s\xffa\xffb":
        a, b = (a ^ x) * hashes.PRIME & hashes.MASK, (b ^ x) * hashes.PRIME & hashes.MASK
        b = (b + a) & hashes.MASK
    assert got.c == "".join(x.to_bytes(8, "little").hex() for x in (a, b))


def test_embeddings_have_unit_length(spark):
    rows = spark.createDataFrame([("some text",), ("ab",), ("",), (None,)], "t string")
    for f, dims in ((hashes.demo_embedding, 256), (hashes.local_embedding, 384)):
        got = [r.v for r in rows.select(f(F.col("t")).alias("v")).collect()]
        assert len(got[0]) == dims and sum(x * x for x in got[0]) == pytest.approx(1, abs=1e-5)


def test_scalar_labels(spark):
    row = spark.createDataFrame([(b"\xff\xfe\x00", "hello there", "", "def f(): return {}")], "raw binary, text string, none string, code string")
    got = row.select(S.payload_type(F.col("raw")), S.resolved_type(F.lit(None).cast("string"), F.col("code"), F.lit("binary")), S.resolved_type(F.lit("json"), F.col("text"), F.lit("x")), S.resolved_type(F.lit(None).cast("string"), F.col("none"), F.lit("binary")), S.embedding_dim(F.col("raw"), F.lit(True)), S.renders_prose(F.lit("embedding"))).first()
    assert tuple(got) == ("binary", "code", "json", "binary", None, False)
    said = spark.createDataFrame([(" OK ", True, None), ("/run it now", True, None), ("We decided to stay here", False, "decision"), ("i prefer x", False, None), ("restrição: nunca aos domingos", False, "constraint")], "s string, trivial boolean, kind string")
    for r in said.select("*", S.is_trivial(F.col("s")).alias("t"), S.capture_class(F.col("s")).alias("k")).collect():
        assert (r.t, r.k) == (r.trivial, r.kind)


# --- stored records ----------------------------------------------------------------------


def test_log_snapshots(spark, tmp_path):
    path, saved = str(tmp_path / "log"), str(tmp_path / "saved")
    log.put_many(spark, [(1, "a/1", b"x"), (2, "a/2", b"y"), (3, "b", b"z"), (4, "a/1", b"x2")], path)
    log.snapshot(spark.read.parquet(path), saved)
    log.delete_key(spark, 5, "a/2", path)
    log.put_many(spark, [(6, "c", b"w")], path)
    rows = spark.read.parquet(path)
    want = {("a/1", b"x2"), ("b", b"z"), ("c", b"w")}
    live = lambda df: {(r.key, bytes(r.value)) for r in df.collect()}
    kept = spark.read.parquet(saved)
    assert live(log.mount(rows, kept)) == live(log.mount(rows, None)) == live(log.replay(rows)) == want
    damaged = kept.withColumn("value", F.when(F.col("key") == "b", F.lit(b"!")).otherwise(F.col("value")))
    assert live(log.mount(rows, damaged)) == want and live(log.mount(rows, kept.limit(0))) == want
    assert live(log.get(rows, "a/1")) == {("a/1", b"x2")} and [r.key for r in log.scan_prefix(rows, "a/").collect()] == ["a/1"]
    assert live(log.mount(rows.filter("seq <> 1"), kept)) == want  # the tail alone is read


def test_working_layers_are_saved_or_dropped(spark, tmp_path):
    rows = spark.createDataFrame([memory(i, f"k{i}", layer=i) for i in range(4)], MEMORY)
    assert log.checkpoint_working(rows, str(tmp_path / "w")) == 2
    assert {r.layer for r in spark.read.parquet(str(tmp_path / "w")).collect()} == {0, 1}
    assert {r.layer for r in log.prune_working(rows).collect()} == {2, 3}


def test_volumes_as_a_data_source(spark, tmp_path):
    (tmp_path / "one").write_bytes(log.encode_record(b"a", b"1") + b"junk" * 128 + log.encode_record(b"b", b"2") + log.encode_record(b"a", b"3"))
    (tmp_path / "two").write_bytes(log.encode_record(b"c", b"4") + log.encode_record(b"c", b""))
    backend.register(spark)
    got = spark.read.format("recollect_volume").load(str(tmp_path)).collect()
    assert {(r.key, bytes(r.value), r.volume) for r in got} == {("a", b"3", "one"), ("b", b"2", "one")}


def test_volumes_hold_all_writes_of_their_keys():
    writes = [(f"k{i // 3}".encode(), b"" if i % 9 == 2 else b"%d" % i) for i in range(90)]
    made = list(log.pack_volumes(writes, 4 * log.ALIGN))
    held = [log.scan_volume(v)[0] for v in made]
    assert [r for records in held for r in records] == [(k.decode(), v) for k, v in writes]
    assert len(made) == 15 and len({k for records in held for k, _ in records}) == sum(len({k for k, _ in records}) for records in held) == 30
    assert list(log.pack_volumes([])) == []


def test_writes_pass_through_volumes_in_their_order(spark):
    rows = [(s, f"k{i}", None if s == 2 and i % 6 == 0 else f"{i}/{s}".encode()) for s in (2, 0, 1) for i in range(200)]
    writes = spark.createDataFrame(rows, "seq long, key string, value binary").repartition(7)
    read = log.through_volumes(writes, 10 * log.ALIGN).collect()
    assert len(read) == len(rows) and len({r.path for r in read}) > 10
    live = {r.key: bytes(r.value).decode() for r in log.live_records(log.through_volumes(writes, 10 * log.ALIGN)).collect()}
    assert live == {f"k{i}": f"{i}/2" for i in range(200) if i % 6}


def test_volume_records_of_many_vectors(spark, tmp_path):
    """Linear in the records: one volume that was copied for each record took minutes."""
    spark.range(40_000).select(F.col("id").alias("vec_id"), (F.col("id") % 10).alias("label"), F.array(F.lit(1.0)).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    began = time.monotonic()
    got = {r.key: r.value for r in catalog.queries()["volume_records"](spark, str(tmp_path)).collect()}
    assert got == {f"vec/{i:08}": f"v{i}" for i in range(40_000) if i % 6} and time.monotonic() - began < 60


def test_document_records_cut_anywhere():
    whole = documents.encode(4, "é/k", {1: 5, 200: 2**40}, b"payload", [1, -1])
    assert documents.decode(whole) == (4, "é/k", {1: 5, 200: 2**40}, b"payload", [1, -1], None)
    assert documents.decode(documents.encode(0, "", {}, b"", None)) == (0, "", {}, b"", None, None)
    assert all(documents.decode(whole[:k])[5] for k in range(len(whole)))
    assert documents.decode(b"XMD1" + whole[4:])[5] == "no document" and documents.decode(whole[:4] + b"\x09" + whole[5:])[5] == "no layer"
    with pytest.raises(ValueError):
        documents.encode(4, "k", {n: 1 for n in range(9)}, b"", None)


# --- tools -------------------------------------------------------------------------------


def test_tools_and_their_aliases(spark):
    assert tools.expand("recall", {"at": 5}) == "recall_temporal" and tools.expand("recall", {"entities": ["a"], "at": 5}) == "recall_entities" and tools.expand("recall", {"rag": True}) == "rag_context"
    assert tools.expand("remember", {"user": "a", "response": "b"}) == "remember_episodic" and tools.expand("health", {"view": "era"}) == "era_report" and tools.expand("curate", {"op": "forget"}) == "forget"
    rows = vectors(spark)
    s = tools.Store(rows, spark.createDataFrame([("causes", "md/L4/k1", "md/L4/k2")], "kind string, a string, b string"), spark.createDataFrame([], "subject string, status int"), embed=lambda t: F.array(F.lit(1.0), F.lit(2.0)))
    asked = {
        "remember": {"key": "n", "text": "x"}, "remember_fact": {"now": 3, "text": "x"}, "remember_episodic": {"now": 3, "user": "u", "response": "r"}, "remember_semantic": {"key": "n", "text": "x"},
        "recall": {"query": "TEXT 3"}, "recall_temporal": {"vector": [1.0] * 4, "at": 3}, "rag_context": {"vector": [1.0] * 4}, "health": {}, "validate": {}, "era_report": {}, "scopes": {}, "tensions": {}, "diary": {"node": 0}, "profile": {"node": 0}, "get": {"key": "md/L4/k1"},
        "forget": {"key": "md/L4/k1"}, "delete": {"key": "md/L4/k1"}, "reinforce": {"key": "md/L4/k1", "amount": 0.7}, "set_scope": {"key": "md/L4/k1", "scope": "a"}, "associate": {"kind": "supports", "a": "md/L4/k1", "b": "md/L4/k3"}, "related_to": {"key": "md/L4/k1"}, "expire": {"now": 9}, "decay": {"now": 9}, "conflicts": {}, "consolidate": {}, "recall_entities": {"entities": ["e"]},
    }
    counts = {name: tools.call(s, name, args).count() for name, args in asked.items()}
    assert counts["remember_semantic"] == counts["remember_episodic"] == 2 and counts["recall"] == 5 and counts["get"] == 1 and counts["delete"] == 5 and counts["associate"] == 2
    assert tools.call(s, "reinforce", asked["reinforce"]).first().importance == 1.0
    assert tools.call(s, "recall", {"vector": [1.0] * 4, "k": 2}).count() == 2
    with pytest.raises(ValueError):
        tools.call(s, "curate", {"op": "dance"})
