"""Further registered queries: guards, scopes, companions, whole writes and deletes, peers, records, upkeep, tools."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .catalog import _ARB, _LEDGER_SQL, K, TERMS, _batches, _lower_sql, _pad_sql, _pool, _q, _sem, _ts_sql, query
from .functions import hashes
from .functions import scalars as S
from .operators import audit, govern, graph, lexical, observe, rag, recall, replicate, tools, write
from .plans import store
from .sources import documents, log
from .streaming import envelope, sync

# --- recall -----------------------------------------------------------------------------


@query("""
, own AS (SELECT 'md/L2/'||key AS sk, scope FROM vec), plain AS (SELECT sk, scope FROM mem WHERE sk NOT IN (SELECT sk FROM own))
SELECT sk, scope FROM own UNION ALL SELECT sk, scope FROM plain""")
def effective_scopes(spark, d):
    """Companions, kept here without a scope, have that of their memory."""
    bare = F.when((F.col("layer") == 2) & F.col("key").startswith("vec/"), "").otherwise(F.col("scope"))
    return recall.with_effective_scope(store.memories(spark, d).withColumn("scope", bare)).select("sk", "scope")


@query("""
, c AS (SELECT 'md/L2/'||key AS sk, text, scope, state FROM vec),
t AS (SELECT sk, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM c),
f AS (SELECT sk, term, count(*) AS tf FROM t WHERE term IN ('3', 'label') GROUP BY ALL),
i AS (SELECT term, ln(((SELECT count(*) FROM c)+1)::DOUBLE/(count(*)+1))+1 AS idf FROM f GROUP BY term),
s AS (SELECT sk, round(sum((1+ln(tf))*idf), 9) AS score FROM f JOIN i USING (term) GROUP BY sk ORDER BY score DESC, sk LIMIT 20)
SELECT s.sk, round(score, 6) AS score FROM s JOIN c USING (sk) WHERE state=0 AND scope='tenant/3'""")
def recall_lexical_companions(spark, d):
    """Scoped lexical recall over companions, which carry no scope of their own."""
    mem = recall.with_effective_scope(store.vectors(spark, d).unionByName(store.companions(spark, d).withColumn("scope", F.lit(""))))
    found = lexical.recall_lexical(mem.filter("layer = 2"), ["label", "3"], 20, "tenant/3")
    return found.select("sk", F.round("score", 6).alias("score"))


@query("SELECT mem.sk, CASE WHEN mem.layer=2 THEN vec.sk END AS rel, CASE WHEN mem.layer=2 AND vec.sk IS NOT NULL THEN 'embedding' ELSE 'text' END AS payload_type FROM mem LEFT JOIN vec ON mem.sk='md/L2/'||vec.key WHERE mem.layer IN (2, 4) AND starts_with(mem.key, 'vec/')")
def primary_memories(spark, d):
    mem = store.memories(spark, d)
    return lexical.with_primary(mem.filter("layer in (2, 4) and startswith(key, 'vec/')").select("sk", "text"), mem).select("sk", "rel", "payload_type")


@query("SELECT DISTINCT 'no vectors of 63 components, only of ['||len(v)||']' AS error FROM vec")
def dimension_guard(spark, d):
    try:
        recall.recall(store.vectors(spark, d), [1.0] * 63, K)
    except ValueError as e:
        return spark.createDataFrame([(str(e),)], "error string")


@query("SELECT sk, ham::BIGINT AS score, round(ham/64.0::DOUBLE, 6) AS dist FROM (SELECT * FROM ham ORDER BY ham, sk LIMIT 40) WHERE id%2=1 UNION ALL SELECT sk, floor(d*10000)::BIGINT, round(floor(d*10000)/10000, 6) FROM (SELECT * FROM ham ORDER BY ham, sk LIMIT 40) WHERE id%2=0")
def rescore_fallback(spark, d):
    """Every other candidate's payload is no vector of the query's size."""
    q = _q(spark, d)
    pool = recall.coarse(store.vectors(spark, d), q, 40)
    pool = pool.withColumn("embedding", F.when(F.col("id") % 2 == 1, F.array(F.lit(1.0))).otherwise(F.col("embedding")))
    return recall.rescored(pool, q).select("sk", "score", F.round("dist", 6).alias("dist"))


_WIDE = """
, wide AS (SELECT a.sk, list_concat(a.v, b.v) AS v FROM vec a JOIN vec b ON b.id=(a.id+1)%(SELECT count(*) FROM vec)),
wq AS (SELECT v AS qv FROM wide WHERE sk='md/L4/vec/00000000'),
wb AS (SELECT sk, b, list_transform(range(b*8+1, b*8+9), lambda i: CASE WHEN v[i]>0 THEN 1 ELSE 0 END) AS bits, list_transform(range(b*8+1, b*8+9), lambda i: CASE WHEN wq.qv[i]>0 THEN 1 ELSE 0 END) AS qb FROM wide, wq, unnest(range(16)) AS t(b)),
wn AS (SELECT sk, b, len(list_filter(range(1,9), lambda i: bits[i]<>qb[i])) AS diff, len(list_filter(range(1,4), lambda i: bits[i]<>qb[i])) AS low FROM wb)"""


def _wide(spark, d):
    vec = store.vectors(spark, d).select("id", "sk", "embedding")
    n = vec.count()
    after = vec.select(((F.col("id") + n - 1) % n).alias("id"), F.col("embedding").alias("more"))
    return vec.join(after, "id").select("id", "sk", F.concat("embedding", "more").alias("embedding"))


@query(_WIDE + " SELECT DISTINCT sk FROM wn WHERE diff=0 OR (diff=1 AND low=1)")
def mih_candidates_wide(spark, d):
    """Vectors of two words, found by bytes of them."""
    wide = _wide(spark, d)
    q = list(wide.filter("id = 0").first()["embedding"])
    return recall.multi_index_candidates(wide, q, 16, 3).select("sk")


@query("""
, qs AS (SELECT id AS qid, v AS qv FROM vec WHERE id%25=0),
p AS (SELECT qid, sk, len(list_filter(range(1, len(v)+1), lambda i: (v[i]>0) <> (qs.qv[i]>0))) AS h,
   1-greatest(-1, least(1, list_inner_product(v, qs.qv)/(sqrt(list_inner_product(v, v)*list_inner_product(qs.qv, qs.qv))+1e-8))) AS d FROM vec, qs),
c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY h, sk) AS r FROM p),
s AS (SELECT qid, sk, floor(d*10000)::BIGINT AS score, row_number() OVER (PARTITION BY qid ORDER BY floor(d*10000), sk) AS r FROM c WHERE r<=80)
SELECT qid, sk, score FROM s WHERE r<=5""")
def recall_many(spark, d):
    """All queries in one job."""
    words = recall.with_words(store.vectors(spark, d), 64)
    return recall.many_recalls(words, words.filter("id % 25 = 0"), 5, 16)


@query("""
, two AS (SELECT sk, d FROM ham UNION ALL SELECT h.sk, g.d FROM ham h JOIN ham g ON g.id=h.id+1),
b AS (SELECT sk, min(floor(d*10000))::BIGINT AS score FROM two GROUP BY sk)
SELECT sk, score FROM b ORDER BY score, sk LIMIT 10""")
def recall_overwritten(spark, d):
    """A key that was written again has two vectors in the index; the better one counts, once."""
    vec = store.vectors(spark, d)
    again = vec.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("_v"))
    twice = vec.unionByName(vec.join(again, "id").withColumn("embedding", F.col("_v")).drop("_v")).withColumns({"state": F.lit(0), "scope": F.lit("")})
    return recall.recall(twice, _q(spark, d), K, oversample=100_000).select("sk", "score")


@query(f"""
, t AS (SELECT *, 'md/L4/'||{_ts_sql("id*7")}||'/e' AS tk FROM ham WHERE state=0 AND scope=''),
w AS (SELECT tk AS sk, floor(d*10000)/10000+0.6*greatest(0, least(1, (2000-id*7)/1000.0::DOUBLE))+0.1*(1-importance) AS total, greatest(0, least(1, (2000-id*7)/1000.0::DOUBLE)) AS rec FROM t)
SELECT sk, round(rec, 6) AS rec, round(total, 6) AS total FROM w ORDER BY total, sk LIMIT 10""")
def recall_weighted_timed(spark, d):
    """Keys that hold a time, so that recency differs."""
    vec = store.vectors(spark, d).withColumn("sk", F.concat(F.lit("md/L4/"), S.time_key(F.col("id") * 7), F.lit("/e")))
    q = _q(spark, d)
    pool = recall.scored(recall.visible(vec), q)
    found = recall.weighted(pool, 2000, 1.0, 0.6, 0.1).orderBy("total", "sk").limit(K)
    return found.select("sk", F.round("rec", 6).alias("rec"), F.round("total", 6).alias("total"))


@query("""
, e AS (SELECT sk, importance, scope, len(list_filter(entities, lambda e: e='label/1'))+len(list_filter(entities, lambda e: e='bucket/3')) AS n FROM vec)
SELECT sk, n::INT AS overlap FROM e WHERE n>0 AND scope='tenant/1' ORDER BY n DESC, importance DESC, sk LIMIT 10""")
def recall_entities_scoped_historical(spark, d):
    return recall.entities(store.vectors(spark, d), ["label/1", "bucket/3"], K, "tenant/1", True).select("sk", "overlap")


@query("""
, t AS (SELECT sk, dist, CASE WHEN valid_from IS NOT NULL THEN CASE WHEN valid_from<=700 AND 700<valid_until THEN 0 ELSE 1 END
   ELSE greatest(0, least(1, abs(700-created_tick)/1000.0::DOUBLE)) END::DOUBLE AS tpen FROM (SELECT *, floor(d*10000)/10000 AS dist FROM ham ORDER BY ham, sk LIMIT 2560) WHERE state=0 AND scope='tenant/1')
SELECT sk, round(0.7*dist+0.3*tpen, 6) AS total FROM t ORDER BY 0.7*dist+0.3*tpen, sk LIMIT 10""")
def recall_temporal_scoped(spark, d):
    q = _q(spark, d)
    pool = recall.scored(recall.visible(recall.coarse(store.vectors(spark, d), q, 16 * K * S.oversample(len(q))), "tenant/1"), q)
    return recall.temporal(pool, 700, 0.7, 0.3).orderBy("total", "sk").limit(K).select("sk", F.round("total", 6).alias("total"))


@query("""
, l AS (SELECT lex.sk, lex.score FROM lex JOIN fact USING (sk) WHERE state=0 AND scope='tenant/en'),
sc AS (SELECT sk, score FROM pool WHERE state=0 AND scope='tenant/1' ORDER BY score, sk LIMIT 4)
SELECT sk, part FROM (SELECT sk, 0 AS part, score::DOUBLE AS o FROM sc UNION ALL SELECT sk, 1, -score FROM l) ORDER BY part, o, sk LIMIT 12""")
def recall_hybrid_scoped(spark, d):
    semantic = _sem(spark, d, scope="tenant/1").orderBy("score", "sk").limit(4)
    return recall.hybrid(semantic, lexical.recall_lexical(store.facts(spark, d), TERMS, 40, "tenant/en"), 12).select("sk", "part")


@query("SELECT l.sk, round(l.score, 6) AS score FROM (SELECT * FROM lex ORDER BY score DESC, sk LIMIT 20) l JOIN fact USING (sk) WHERE scope='tenant/en'")
def recall_lexical_scoped_historical(spark, d):
    return lexical.recall_lexical(store.facts(spark, d), TERMS, 20, "tenant/en", True).select("sk", F.round("score", 6).alias("score"))


@query("SELECT sk, round(score, 6) AS score FROM lex ORDER BY score DESC, sk LIMIT 15")
def search_fast(spark, d):
    return lexical.search_fast(store.facts(spark, d), TERMS, 15).select("sk", F.round("score", 6).alias("score"))


@query(f"""
, n AS (SELECT sk, CASE WHEN id%10=0 THEN 'one new new word' ELSE text END AS text FROM fact WHERE id%10<>1),
k AS (SELECT sk, unnest(regexp_extract_all({_lower_sql("text")}, '[\\p{{L}}\\p{{N}}]+')) AS term FROM n)
SELECT sk, term, count(*) AS tf FROM k GROUP BY ALL""")
def lexical_upsert(spark, d):
    facts = store.facts(spark, d)
    changed = facts.filter("id % 10 = 0").withColumn("text", F.lit("one new new word"))
    return lexical.upsert(lexical.postings(facts), changed, facts.filter("id % 10 = 1"))


@query("SELECT sk FROM vec WHERE id%10<>0 UNION ALL SELECT sk FROM vec WHERE id<7 AND id%10=0")
def reclaim_orphans(spark, d):
    """Enough orphans are dropped at once; below the threshold they stay."""
    vec = store.vectors(spark, d).select("sk", "id")
    many = recall.reclaim(vec, vec.filter("id % 10 <> 0"), 4)
    few = recall.reclaim(vec.filter("id < 7"), vec.filter("id > 0"), 4).filter("id % 10 = 0")
    return many.select("sk").union(few.select("sk"))


@query("SELECT sk, 3 AS width, 0::BIGINT AS last FROM vec")
def index_width(spark, d):
    """Bit vectors at an index's width of three words."""
    words = recall.fit_width(F.array(F.col("w0")), 3)
    return recall.with_words(store.vectors(spark, d), 64).select("sk", F.size(words).alias("width"), F.element_at(words, -1).alias("last"))


# --- relations ---------------------------------------------------------------------------


@query("SELECT id, vid, CASE WHEN parent IS NULL THEN 'extra' WHEN id%2=0 THEN parent||',extra' ELSE parent END AS parents FROM ver WHERE id%2=0 OR parent IS NOT NULL")
def add_parents(spark, d):
    ver = store.versions(spark, d)
    more = ver.filter("id % 2 = 0").select("vid", F.concat(F.slice("parents", 1, 1), F.array(F.lit("extra"))).alias("parents"))
    return graph.add_parents(ver, more).filter(F.size("parents") > 0).select("id", "vid", F.array_join("parents", ",").alias("parents"))


@query("SELECT 0 AS depth, 'v00000003' AS vid UNION ALL SELECT 1, 'v00000002' UNION ALL SELECT 2, 'v00000001' UNION ALL SELECT 3, 'v00000000'")
def lineage_of_a_cycle(spark, d):
    """Versions 0 to 2 descend from one another; the walk ends."""
    ver = store.versions(spark, d)
    before = F.concat(F.lit("v"), S.padded(F.when(F.col("id") == 0, 2).otherwise(F.col("id") - 1)))
    return graph.lineage(ver.withColumn("parents", F.array(before)), "v00000003")


@query("SELECT DISTINCT unnest(entities) AS entity, sk FROM vec WHERE id%5<>0 UNION ALL SELECT 'new', sk FROM vec WHERE id%5=0")
def set_entities(spark, d):
    """Every fifth memory's names are replaced; the index is what is left."""
    vec = store.vectors(spark, d)
    changes = vec.filter("id % 5 = 0").select("sk", F.array(F.lit("new"), F.lit(""), F.lit("new")).alias("entities"))
    return graph.entity_index(write.set_entities(vec, changes))


@query("SELECT kind, a, b, 'hash' AS why FROM (SELECT kind, a||'#' AS a, b FROM edge WHERE kind='causes') UNION ALL SELECT 'likes', a, b, 'kind' FROM edge WHERE kind='contradicts'")
def refused_relations(spark, d):
    edges = store.relations(spark, d)
    marked = edges.withColumns({"a": F.when(F.col("kind") == "causes", F.concat("a", F.lit("#"))).otherwise(F.col("a")), "kind": F.when(F.col("kind") == "contradicts", "likes").otherwise(F.col("kind"))})
    return graph.refused(marked)


@query("""
, ev AS (SELECT sk FROM sem), lesson AS (SELECT 'md/L3/lesson' AS k)
SELECT 'derived_from' AS kind, k AS a, sk AS b FROM ev, lesson UNION SELECT 'supports', sk, k FROM ev, lesson UNION SELECT 'contradicts', sk, k FROM (SELECT sk FROM lex ORDER BY score DESC, sk LIMIT 8), lesson""")
def reflect(spark, d):
    none = store.relations(spark, d).limit(0)
    return graph.reflect(none, "md/L3/lesson", _sem(spark, d).select("sk"), lexical.search(store.facts(spark, d), TERMS, 8).select("sk"))


# --- writes ------------------------------------------------------------------------------


@query(f"""
, t AS (SELECT conv_id*100+turn AS ts, role, text FROM conversations), e AS (SELECT {_ts_sql("ts")} AS k, * FROM t)
SELECT 'md/L2/'||k||'/u' AS sk, 2 AS layer, role AS text, NULL::INT AS dim FROM e UNION ALL SELECT 'md/L2/'||k||'/a', 2, text, NULL FROM e
UNION ALL SELECT 'md/L4/'||k||'/u', 4, role, 2 FROM e UNION ALL SELECT 'md/L4/'||k||'/a', 4, text, 3 FROM e
UNION ALL SELECT 'md/L1/last_user', 1, arg_max(role, ts), NULL FROM t UNION ALL SELECT 'md/L2/last_asst', 2, arg_max(text, ts), NULL FROM t""")
def remember_exchange_full(spark, d):
    turns = store.read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("ts"), F.col("role").alias("user"), F.col("text").alias("reply"))
    turns = turns.withColumns({"user_embedding": F.array(F.lit(1.0), F.lit(0.0)), "reply_embedding": F.array(F.lit(1.0), F.lit(0.0), F.lit(2.0))})
    return write.remember_exchange_full(turns).select("sk", "layer", "text", F.size("embedding").alias("dim"))


@query(f"SELECT 'md/L3/'||{_ts_sql('event_id')} AS sk, props AS text FROM events")
def remember_fact(spark, d):
    return write.remember_fact(store.read(spark, d, "events").select(F.col("event_id").alias("ts"), F.col("props").alias("text")))


@query("SELECT sk, round(CASE WHEN id%4=0 THEN 1.0 ELSE importance END, 6) AS importance, round(CASE WHEN id%4=0 THEN 1.0 ELSE confidence END, 6) AS confidence, CASE WHEN id%4=0 THEN 0 ELSE created_tick END AS created_tick, id%4=0 AS made FROM vec WHERE id<200")
def ensure_meta(spark, d):
    vec = store.vectors(spark, d)
    found = write.ensure_meta(vec, vec.filter("id % 4 <> 0"), vec.filter("id < 200"))
    return found.select("sk", F.round("importance", 6).alias("importance"), F.round("confidence", 6).alias("confidence"), "created_tick", "made")


@query("SELECT sk, CASE WHEN id%3=0 THEN 'json' END AS content_type FROM vec UNION ALL SELECT 'md/L2/'||key, CASE WHEN id%3=0 THEN 'json' END FROM vec")
def set_content_type(spark, d):
    vec = store.vectors(spark, d)
    both = vec.unionByName(store.companions(spark, d))
    return write.set_content_type(both, vec.filter("id % 3 = 0").select("sk", F.lit("json").alias("content_type"))).select("sk", "content_type")


@query("""
, gone AS (SELECT sk FROM mem WHERE id%9=0)
SELECT 'memories' AS part, count(*) AS n FROM mem WHERE sk NOT IN (FROM gone) UNION ALL SELECT 'state', count(*) FROM mem WHERE state<>0 AND sk NOT IN (FROM gone)
UNION ALL SELECT 'validity', count(*) FROM mem WHERE valid_from IS NOT NULL AND sk NOT IN (FROM gone) UNION ALL SELECT 'relations', count(*) FROM edge WHERE a NOT IN (FROM gone) AND b NOT IN (FROM gone)
UNION ALL SELECT 'entities', count(*) FROM (SELECT DISTINCT unnest(entities), sk FROM vec WHERE sk NOT IN (FROM gone)) UNION ALL SELECT 'clock', count(*) FROM rep WHERE sk NOT IN (FROM gone)""")
def delete_everywhere(spark, d):
    mem = store.memories(spark, d)
    parts = {
        "memories": mem.select("sk"), "state": mem.filter("state <> 0").select("sk"), "validity": mem.filter("valid_from is not null").select("sk"),
        "relations": store.relations(spark, d), "entities": graph.entity_index(store.vectors(spark, d)), "clock": store.replicas(spark, d).select("sk"),
    }
    out = None
    for name, left in write.delete_everywhere(parts, mem.filter("id % 9 = 0")).items():
        row = left.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.union(row)
    return out


@query("SELECT 'derived_from' AS kind, 'md/L5/'||key AS a, sk AS b FROM fact")
def transfer_edges(spark, d):
    return write.transfer_edges(store.facts(spark, d), 5)


@query("SELECT sk FROM vec UNION ALL SELECT 'md/L4/new/'||lpad(id::VARCHAR, 8, '0') FROM vec WHERE id<20")
def guard_keys(spark, d):
    """Overwrites and new keys that no other key forbids pass whole."""
    vec = store.vectors(spark, d).select("sk", "id")
    new = vec.filter("id < 20").select(F.concat(F.lit("md/L4/new/"), S.padded(F.col("id"))).alias("sk"))
    return write.guard_keys(vec.select("sk").union(new), vec)


@query("SELECT sk, scope, CASE WHEN id%7=0 THEN 'tenant/moved' ELSE scope END AS new_scope FROM vec")
def set_scope(spark, d):
    vec = store.vectors(spark, d)
    moved = write.set_fields(vec, vec.filter("id % 7 = 0").select("sk", F.lit("tenant/moved").alias("scope"))).select("sk", F.col("scope").alias("new_scope"))
    return vec.select("sk", "scope").join(moved, "sk")


# --- scalars -----------------------------------------------------------------------------


@query("""
SELECT doc_id, octet_length(encode(text)) AS size, CASE WHEN octet_length(encode(text))%4=0 AND octet_length(encode(text))>=4 THEN octet_length(encode(text))//4 END::INT AS dim,
  CASE WHEN doc_id%3=0 THEN 'binary' WHEN doc_id%3=1 THEN 'json' ELSE 'embedding' END AS declared, doc_id%3=1 AS prose FROM documents WHERE text IS NOT NULL""")
def payload_types(spark, d):
    docs = store.read(spark, d, "documents").filter("text is not null").withColumn("payload", F.col("text").cast("binary"))
    declared = F.when(F.col("doc_id") % 3 == 1, "json").when(F.col("doc_id") % 3 == 2, "embedding")
    found = S.resolved_type(declared, F.lit(""), S.payload_type(F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FFFE00"))).otherwise(F.col("payload"))))
    return docs.select("doc_id", F.octet_length("payload").cast("long").alias("size"), S.embedding_dim(F.col("payload"), F.lit(False)).alias("dim"), found.alias("declared"), S.renders_prose(found).alias("prose"))


@query("""
, t AS (SELECT conv_id, turn, CASE turn%5 WHEN 0 THEN '  Thanks ' WHEN 1 THEN '/help me' WHEN 2 THEN 'I prefer '||text WHEN 3 THEN 'Constraint: '||text ELSE text END AS s FROM conversations)
SELECT conv_id, turn, turn%5 IN (0, 1) AS trivial, CASE turn%5 WHEN 2 THEN 'preference' WHEN 3 THEN 'constraint' END AS kind FROM t""")
def capture(spark, d):
    r = F.col("turn") % 5
    said = F.when(r == 0, "  Thanks ").when(r == 1, "/help me").when(r == 2, F.concat(F.lit("I prefer "), "text")).when(r == 3, F.concat(F.lit("Constraint: "), "text")).otherwise(F.col("text"))
    return store.read(spark, d, "conversations").select("conv_id", "turn", S.is_trivial(said).alias("trivial"), S.capture_class(said).alias("kind"))


@query()
def local_embeddings(spark, d):
    """Of the labels' texts: the stand-in for a model folds every byte 384 times."""
    return store.vectors(spark, d).select("sk", hashes.local_embedding(F.col("text")).alias("embedding"))


# --- upkeep ------------------------------------------------------------------------------


@query("""
, x AS (SELECT id, importance, state, CASE WHEN valid_until<=2000 AND state NOT IN (2,3,4) THEN 3 ELSE state END AS s, layer, created_tick FROM mem),
y AS (SELECT *, least(importance, 0.05+(importance-0.05)*exp(-greatest(2000-created_tick, 0)/3000.0::DOUBLE)) AS i FROM x WHERE s=0 AND layer BETWEEN 3 AND 5)
SELECT 'expire' AS step, count(*) AS n FROM x WHERE s<>state UNION ALL SELECT 'decay', count(*) FROM y WHERE abs(i-importance)>1e-7 OR i<=0.05 UNION ALL SELECT 'consolidate', 0 UNION ALL SELECT 'checkpoint', 0""")
def maintain(spark, d):
    return govern.maintain(store.memories(spark, d), 2000, 3000)[1]


@query("SELECT sk, 2 AS dim, CASE WHEN id%4=0 THEN 'missing' ELSE 'migrated' END AS status FROM vec WHERE id%4<>0 UNION ALL SELECT sk, len(v)::INT, 'missing' FROM vec WHERE id%4=0")
def era_migration(spark, d):
    mem = store.vectors(spark, d).unionByName(store.companions(spark, d).filter("id % 4 <> 0"))
    found = govern.reembed(mem, lambda text: F.array(F.length(text).cast("double"), F.lit(1.0)))
    return found.select("sk", F.size("embedding").alias("dim"), "status")


@query("SELECT 'md/L4/'||key AS sk, 4 AS layer, text, 1 AS dim FROM fact WHERE id%3<>0 AND length(text)>0 UNION ALL SELECT 'md/L2/'||key, 2, text, NULL FROM fact WHERE id%3<>0 AND length(text)>0")
def backfill(spark, d):
    """Every third fact has its L4 memory already."""
    facts = store.facts(spark, d)
    mem = facts.unionByName(facts.filter("id % 3 = 0").withColumn("layer", F.lit(4)))
    found = govern.backfill(mem, lambda text: F.array(F.length(text).cast("double")))
    return found.select("sk", "layer", "text", F.size("embedding").alias("dim"))


@query(f"""
, n AS (SELECT *, array_to_string(regexp_extract_all({_lower_sql("text")}, '[\\p{{L}}\\p{{N}}]+'), ' ') AS norm FROM rec),
g AS (SELECT min(sk) AS b FROM n WHERE norm<>'' GROUP BY norm HAVING count(*)>=2 AND strlen(arg_min(text, sk))>=8)
SELECT 'derived_from' AS kind, true AS named, b FROM g""")
def consolidated_edges(spark, d):
    edges = govern.consolidated_edges(govern.consolidate(store.recurring(spark, d), min_repeats=2, most_new=1_000_000))
    return edges.select("kind", F.col("a").rlike("^md/L3/consolidated/[0-9a-f]{16}$").alias("named"), "b")


# --- reports -----------------------------------------------------------------------------


@query("""
, s AS (SELECT scope, count(*) AS n FROM mem WHERE layer BETWEEN 3 AND 5 AND scope<>'' GROUP BY scope), top AS (SELECT * FROM s ORDER BY scope LIMIT 4)
SELECT 'no hits in the global scope, which sees no scoped memories; '||(SELECT sum(n) FROM s)||' are scoped: '||(SELECT string_agg(scope||'('||n||')', ', ' ORDER BY scope) FROM top) AS hint
UNION ALL SELECT 'no hits in scope nowhere; known scopes: '||(SELECT string_agg(scope||'('||n||')', ', ' ORDER BY scope) FROM top)""")
def empty_hint(spark, d):
    mem = store.memories(spark, d)
    return observe.empty_hint(mem).union(observe.empty_hint(mem, "nowhere"))


@query("SELECT 'recalls' AS name, 10::BIGINT AS n FROM region WHERE r_regionkey=0 UNION ALL SELECT 'vectors', count(*) FROM vec UNION ALL SELECT 'writes', 2*(SELECT count(*) FROM conversations)")
def metrics(spark, d):
    """Counted as the rows pass by."""
    seen = observe.Metrics()
    seen.watch("vectors", store.vectors(spark, d)).write.format("noop").mode("overwrite").save()
    seen.watch("recalls", recall.coarse(store.vectors(spark, d), _q(spark, d), K)).write.format("noop").mode("overwrite").save()
    turns = store.read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("ts"), F.col("role").alias("user"), F.col("text").alias("reply"))
    seen.watch("writes", write.remember_episodic(turns)).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(sorted(seen.read().items()), "name string, n long")


@query("SELECT 'unseen_scope' AS kind, scope AS name FROM (SELECT DISTINCT scope FROM mem WHERE layer BETWEEN 3 AND 5 AND scope NOT IN ('', 'tenant/1', 'tenant/en'))")
def unseen_scopes(spark, d):
    none = store.read(spark, d, "region").limit(0).select(F.lit("").alias("subject"), F.lit(0).alias("status"))
    return observe.tensions(none, store.memories(spark, d), seen=["tenant/1", "tenant/en"]).filter("kind = 'unseen_scope'")


@query("SELECT o_orderpriority AS agent, avg((met=wanted)::INT::DOUBLE) AS success_rate, round(avg(met/wanted::DOUBLE), 9) AS soft_progress FROM (SELECT o_orderpriority, o_orderkey%4 AS met, 3 AS wanted FROM orders WHERE o_orderkey%4<=3) GROUP BY ALL")
def evaluation(spark, d):
    """Orders as tasks: how often all constraints were met, and what share of them."""
    tasks = store.read(spark, d, "orders").select(F.col("o_orderpriority").alias("agent"), F.col("o_orderkey").alias("task"), (F.col("o_orderkey") % 4).alias("met"), F.lit(3).alias("wanted"))
    return observe.success(tasks).withColumn("soft_progress", F.round("soft_progress", 9))


@query("""
, e AS (SELECT id, sk, text, d, ham, scope, CASE WHEN valid_until<=2000 AND state NOT IN (2,3,4) THEN 3 ELSE state END AS s FROM ham)
SELECT sk, text, floor(d*10000)::BIGINT AS score FROM (SELECT * FROM e ORDER BY ham, sk LIMIT 128) WHERE s=0 AND scope='tenant/1' ORDER BY score, sk LIMIT 8""")
def session_open(spark, d):
    return tools.open_session(store.vectors(spark, d), _q(spark, d), "tenant/1", 2000)


# --- peers and records -------------------------------------------------------------------


@query("""
SELECT sk, CASE WHEN verdict='applied' AND NOT (held AND rc=lc AND NOT more) THEN 'remote' WHEN held THEN 'local' END AS side FROM verdict WHERE held OR verdict='applied'""")
def merged_store(spark, d):
    """Whose text a merged store holds; a remote-only record of a rejecting layer stays out."""
    rows = store.replicas(spark, d)
    side = lambda p: rows.filter(F.col(f"{p}_clock").isNotNull()).select("sk", "layer", F.col(f"{p}_clock").alias("clock"), F.col(f"{p}_text").alias("same"), F.lit(p).alias("p"), F.col(f"{p}_state").alias("state"))
    local, remote = (side(p).withColumn("text", F.col("same")) for p in ("local", "remote"))
    kept = replicate.merge(local, remote)
    judged = replicate.merge_verdicts(replicate.pair_replicas(local, remote)).select("sk", "verdict", "local_clock", "remote_clock")
    order = S.clock_order(F.col("remote_clock"), F.col("local_clock"))
    took = (F.col("verdict") == "applied") & (F.col("local_clock").isNull() | (order != "equal"))
    return kept.join(judged, "sk").select("sk", F.when(took, "remote").otherwise("local").alias("side"))


@query("SELECT sk, text, valid_from FROM (SELECT sk, CASE WHEN id%10=0 THEN 'imported' ELSE text END AS text, CASE WHEN id%10=0 THEN NULL ELSE valid_from END AS valid_from FROM vec)")
def import_records(spark, d):
    """Records come as they are: these have no validity window, which clears the local one."""
    vec = store.vectors(spark, d)
    records = replicate.export_records(vec, vec.filter("id % 10 = 0")).withColumns({"text": F.lit("imported"), "valid_from": F.lit(None).cast("long"), "valid_until": F.lit(None).cast("long")})
    return replicate.import_records(vec, records).select("sk", "text", "valid_from")


@query("""
, c AS (SELECT id, sk AS candidate, id//3 AS conflict, importance, confidence FROM vec)
SELECT conflict, candidate, round(CASE WHEN id%4=0 THEN 0.25 ELSE importance END, 6) AS importance FROM c""")
def conflict_evidence(spark, d):
    """Every fourth candidate's present metadata are gone; the copy kept with the conflict serves."""
    vec = store.vectors(spark, d).withColumn("conflict", F.floor(F.col("id") / 3))
    meta = vec.select("conflict", F.col("sk").alias("candidate"), "id", "importance", "confidence", "created_tick", F.lit(1).alias("n_parents"))
    conflicts = vec.groupBy("conflict").agg(F.collect_set("sk").alias("candidates"))
    found = replicate.evidence(conflicts, meta.filter("id % 4 <> 0"), meta.withColumn("importance", F.lit(0.25)))
    return found.select("conflict", "candidate", F.round("importance", 6).alias("importance"))


@query("""
, c AS (SELECT sk, 'local:'||sk AS l, 'remote:'||sk AS r, id%4 AS k FROM verdict WHERE verdict='conflict')
SELECT sk AS subject, CASE WHEN k=3 THEN 0 ELSE 1 END AS status, CASE k WHEN 0 THEN r WHEN 1 THEN r WHEN 2 THEN l END AS winner, CASE WHEN k=2 THEN l||','||r END AS merged FROM c""")
def apply_decisions(spark, d):
    rows = replicate.merge_verdicts(store.replicas(spark, d)).filter("verdict = 'conflict'").select("id", F.col("sk").alias("subject"))
    k = F.col("id") % 4
    name = lambda p: F.concat(F.lit(f"{p}:"), "subject")
    decided = rows.select("subject", F.when(k == 0, "prefer").when(k == 1, "invalidate").when(k == 2, "merge").otherwise("escalate").alias("decision"), F.when(k == 0, name("remote")).alias("winner"), F.when(k == 1, name("local")).alias("loser"))
    found = replicate.apply_decisions(replicate.conflicts_of(store.replicas(spark, d)), decided)
    return found.select("subject", "status", "winner", F.array_join("merged", ",").alias("merged"))


@query("SELECT sk AS subject FROM verdict WHERE verdict='conflict' AND id%2=1")
def dismiss_conflicts(spark, d):
    rows = replicate.merge_verdicts(store.replicas(spark, d)).filter("verdict = 'conflict'").select("id", F.col("sk").alias("subject"))
    return replicate.dismiss(rows, rows.filter("id % 2 = 0")).select("subject")


#: Packets (local, node, seq, value): each user's store hears of three peers; store 0 mod 3 wrote first.
_PACKETS = """
, p AS (SELECT user_id AS local, CASE WHEN user_id%3=0 AND event_id%11=0 THEN user_id ELSE 1000000+event_id%3 END AS node, event_id AS seq, CASE WHEN user_id%3=0 AND event_id%11=0 THEN event_id+1 ELSE event_id//7 END AS value FROM events),
m AS (SELECT *, max(value) OVER (PARTITION BY local, node ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS have, count(*) FILTER (node=local) OVER (PARTITION BY local ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS writes,
  count(*) FILTER (value>0 AND node<>local) OVER (PARTITION BY local ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, count(*) FILTER (value>0 AND node<>local) OVER (PARTITION BY local, node ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen_here FROM p)
SELECT local, node, seq, CASE WHEN node=local THEN 'written' WHEN value=0 OR value=have THEN 'duplicate' WHEN value<have THEN 'stale' WHEN coalesce(writes, 0)>0 OR coalesce(seen, 0)>coalesce(seen_here, 0) THEN 'conflict' ELSE 'applied' END AS verdict FROM m"""


def _packets(spark, d):
    own = (F.col("user_id") % 3 == 0) & (F.col("event_id") % 11 == 0)
    return store.read(spark, d, "events").select(
        F.col("user_id").alias("local"), F.when(own, F.col("user_id")).otherwise(F.col("event_id") % 3 + 1_000_000).alias("node"), F.col("event_id").alias("seq"), F.when(own, F.col("event_id") + 1).otherwise(F.floor(F.col("event_id") / 7)).alias("value")
    )


@query(_PACKETS)
def peer_verdicts(spark, d):
    return sync.judge_versions(_packets(spark, d))


@query("SELECT x.r_regionkey::BIGINT AS node, y.r_regionkey::BIGINT AS peer, y.r_regionkey*10+1::BIGINT AS version FROM region x, region y")
def mesh_gossip(spark, d):
    """Regions in a ring tell their neighbours what they know; after as many rounds as the ring is long all know all."""
    r = store.read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("a"))
    known = r.select(F.col("a").alias("node"), F.col("a").alias("peer"), (F.col("a") * 10 + 1).alias("version"))
    ring = r.select("a", ((F.col("a") + 1) % 5).alias("b"))
    return replicate.gossip(known, ring.union(ring.select("b", "a")), 3)


@query("SELECT event_id, CASE WHEN event_id%10<>0 THEN event_id%4 END::INT AS node, event_id%10<>0 AND event_id%7<>0 AS valid FROM events")
def signed_envelopes(spark, d):
    """Sealed, every tenth cut short on its way, and opened; one signed with another key is not valid."""
    packets = store.read(spark, d, "events").select((F.col("event_id") % 4).cast("int").alias("node"), F.concat_ws("|", F.col("event_id").cast("string"), "props").alias("payload"))
    other = F.regexp_extract("payload", "^([0-9]+)", 1).cast("long") % 7 == 0
    sealed = envelope.seal(packets.filter(~other), envelope.demo_signer(7)).union(envelope.seal(packets.filter(other), envelope.demo_signer(8)))
    arrived = sealed.withColumn("event_id", F.regexp_extract(F.decode(F.substring("envelope", 10, 30), "ISO-8859-1"), r"^([0-9]+)", 1).cast("long"))
    changed = F.when(F.col("event_id") % 10 == 0, F.expr("substring(envelope, 1, octet_length(envelope) - 1)")).otherwise(F.col("envelope"))
    arrived = arrived.select("event_id", changed.alias("envelope"))
    opened = envelope.open_envelopes(arrived, envelope.demo_signer(7))
    return opened.join(arrived, "envelope").select("event_id", "node", "valid")


@query("SELECT c_custkey AS node, round(CASE WHEN c_custkey%5=0 THEN 0 WHEN c_custkey%2=0 THEN 0.5 ELSE c_acctbal END, 2) AS trust, c_custkey%5=0 AS revoked FROM customer ORDER BY c_custkey LIMIT 64")
def trust_changes(spark, d):
    peers = store.read(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("trust"), F.lit(False).alias("revoked"))
    raised = replicate.upsert_peers(peers, peers.filter("node % 2 = 0").withColumn("trust", F.lit(0.5)))
    return replicate.revoke(raised, raised.filter("node % 5 = 0")).select("node", F.round("trust", 2).alias("trust"), "revoked")


# --- stored records ----------------------------------------------------------------------


@query("SELECT 'slot/'||user_id AS key, arg_max(props, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id)<>'error'")
def log_replay(spark, d):
    """Events as writes of their user's slot; an error deletes it."""
    rows = store.read(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("slot/"), F.col("user_id").cast("string")).alias("key"), F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("props")).cast("binary").alias("value"))
    return log.replay(rows).select("key", F.col("value").cast("string").alias("value"))


@query("""
, torn AS (SELECT (max(event_id)*2)//3 AS t FROM events)
SELECT 'slot/'||user_id AS key, arg_max(props, event_id) AS value FROM events, torn WHERE event_id<t GROUP BY user_id""")
def log_torn(spark, d):
    """A write two thirds in is damaged: what stands before it is served."""
    rows = store.read(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("slot/"), F.col("user_id").cast("string")).alias("key"), F.col("props").cast("binary").alias("value"))
    t = F.broadcast(rows.agg(F.floor(F.max("seq") * 2 / 3).alias("t")))  # one row
    crc = F.crc32(F.concat(F.col("key").cast("binary"), "value"))
    written = rows.join(t).withColumn("crc", F.when(F.col("seq") == F.col("t"), 0).otherwise(crc)).drop("t")
    return log.replay_whole(written).select("key", F.col("value").cast("string").alias("value"))


@query("SELECT layer, key, text, n, error FROM (SELECT 4 AS layer, key, text, id+1 AS n, NULL AS error, id FROM vec) WHERE id%10<>0 UNION ALL SELECT NULL, NULL, NULL, NULL, 'cut short' FROM vec WHERE id%10=0")
def document_records(spark, d):
    """Memories encoded and read back; every tenth is cut short."""
    @F.pandas_udf("binary")
    def encoded(key: pd.Series, text: pd.Series, tick: pd.Series) -> pd.Series:
        return pd.Series([documents.encode(4, k, {1: int(t)}, x.encode(), [5, -1]) for k, x, t in zip(key, text, tick, strict=True)], dtype=object)

    whole = encoded(F.col("key"), F.col("text"), F.col("created_tick"))
    rows = store.vectors(spark, d).withColumn("value", whole)
    rows = rows.select(F.when(F.col("id") % 10 == 0, F.expr("substring(value, 1, octet_length(value) - 5)")).otherwise(F.col("value")).alias("value"))
    return documents.decode_documents(rows).select("layer", "key", F.col("payload").cast("string").alias("text"), F.try_element_at("clock", F.lit(1)).alias("n"), "error")


@query("SELECT key, 'v'||id AS value FROM vec WHERE id%6<>0")
def volume_records(spark, d):
    """Volumes of records, in which every sixth key is deleted later, read by their bytes."""
    vec = store.vectors(spark, d)
    puts = vec.select((F.col("id") * 2).alias("seq"), "key", F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"))
    deletes = vec.filter("id % 6 = 0").select((F.col("id") * 2 + 1).alias("seq"), "key", F.lit("").alias("value"))
    made = log.through_volumes(puts.union(deletes))
    return log.live_records(made).select("key", F.col("value").cast("string").alias("value"))


@query("SELECT sk FROM mem WHERE layer NOT IN (0, 1)")
def prune_working(spark, d):
    mem = store.memories(spark, d).select("sk", "layer")
    working = mem.limit(3).withColumns({"layer": F.lit(1), "sk": F.concat(F.lit("tmp/"), "sk")})
    return log.prune_working(mem.union(working.select("sk", "layer"))).select("sk")


# --- tools -------------------------------------------------------------------------------


@query("""SELECT 'recall' AS tool, l.sk FROM (SELECT * FROM lex ORDER BY score DESC, sk LIMIT 10) l JOIN fact USING (sk) WHERE state=0 AND scope=''
   UNION ALL SELECT 'remember', 'md/L3/note' FROM region WHERE r_regionkey=0 UNION ALL SELECT 'expire', sk FROM fact WHERE valid_until<=2000 AND state NOT IN (2,3,4)""")
def tool_calls(spark, d):
    facts = store.facts(spark, d)
    none = spark.createDataFrame([], "subject string, status int")
    s = tools.Store(facts, store.relations(spark, d), none)
    asked = [("recall", {"query": "Apache idiot, license thing version", "k": 10}), ("remember", {"key": "note", "text": "x"}), ("curate", {"op": "expire", "now": 2000})]
    out = None
    for tool, args in asked:
        part = tools.call(s, tool, args).select(F.lit(args.get("op", tool)).alias("tool"), "sk")
        out = part if out is None else out.union(part)
    return out


@query(_LEDGER_SQL + " SELECT seq, digest, '0000000000000000' AS first FROM e")
def ledger(spark, d):
    """Checkpoints over all events, chained; the first has no entry before it."""
    first = F.first("prev_hash").alias("first")
    chained = audit.chain(_batches(spark, d))
    return chained.select("seq", "digest").join(chained.filter("seq = 1").agg(first))
