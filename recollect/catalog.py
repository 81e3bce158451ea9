"""All registered queries of the engine and their SQL.

Each query has its plan in a function of (spark, sf_dir) and, where SQL can say it, an
independent DuckDB text over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashes
from .functions import scalars as S
from .operators import access, audit, govern, graph, lexical, observe, rag, recall, replicate, write
from .plans import store

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

K = 10
TERMS = ["apache", "idiot", "license", "thing", "version"]
TRUST = [(0, 0.9), (1, 0.1), (2, 0.7)]


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = PRELUDE + sql
        return f

    return register


def queries() -> dict[str, Query]:
    from . import catalog_more  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def _meta_sql(i: str, tag: str) -> str:
    return f"""({i}*37%101)::DOUBLE/100 AS importance, ({i}*53%101)::DOUBLE/100 AS confidence,
      CASE WHEN {i}%11=0 THEN 1 WHEN {i}%13=0 THEN 3 WHEN {i}%17=0 THEN 4 ELSE 0 END AS state,
      CASE WHEN {i}%3=0 THEN '' ELSE 'tenant/'||{tag} END AS scope,
      CASE WHEN {i}%5=0 THEN {i}*10 END AS valid_from, CASE WHEN {i}%5=0 THEN {i}*10+500 END AS valid_until,
      ({i}%4)::INT AS source, {i}+1 AS created_tick"""


def _lower_sql(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _pad_sql(x: str, n: int = 8) -> str:
    return f"lpad(({x})::VARCHAR, {n}, '0')"


def _ts_sql(x: str) -> str:
    return f"'ts/'||lpad(lower(to_hex({x})), 16, '0')"


PRELUDE = f"""
WITH RECURSIVE vec AS (SELECT vec_id AS id, 'md/L4/vec/'||{_pad_sql("vec_id")} AS sk, 4 AS layer, 'vec/'||{_pad_sql("vec_id")} AS key,
    'label '||label AS text, embedding::DOUBLE[] AS v, {_meta_sql("vec_id", "label::VARCHAR")},
    ['label/'||label, 'bucket/'||(vec_id%7)] AS entities FROM embeddings),
fact AS (SELECT doc_id AS id, 'md/L3/doc/'||{_pad_sql("doc_id")} AS sk, 3 AS layer, 'doc/'||{_pad_sql("doc_id")} AS key, text, {_meta_sql("doc_id", "lang")},
    ['lang/'||lang, 'src/'||source] AS entities FROM documents),
epi AS (SELECT ts AS id, 'md/L2/'||{_ts_sql("ts")}||'/'||r AS sk, 2 AS layer, {_ts_sql("ts")}||'/'||r AS key, text, {_meta_sql("ts", "role")}
    FROM (SELECT conv_id*100+turn AS ts, role, text, CASE role WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 's' END AS r FROM conversations)),
rec AS (SELECT doc_id AS id, 'md/L2/'||{_ts_sql("doc_id")}||'/d' AS sk, text, doc_id+1 AS created_tick FROM documents),
mem AS (SELECT id, sk, layer, key, text, importance, confidence, state, scope, valid_from, valid_until, source, created_tick FROM vec
  UNION ALL SELECT id, sk, layer, key, text, importance, confidence, state, scope, valid_from, valid_until, source, created_tick FROM fact
  UNION ALL SELECT id, 'md/L2/'||key, 2, key, text, importance, confidence, state, scope, valid_from, valid_until, source, created_tick FROM vec
  UNION ALL SELECT id, sk, layer, key, text, importance, confidence, state, scope, valid_from, valid_until, source, created_tick FROM epi),
edge AS (SELECT 'causes' AS kind, 'md/L4/vec/'||{_pad_sql("vec_id")} AS a, 'md/L4/vec/'||{_pad_sql("vec_id+1")} AS b FROM embeddings WHERE vec_id%4=0
  UNION ALL SELECT 'contradicts', 'md/L4/vec/'||{_pad_sql("vec_id")}, 'md/L4/vec/'||{_pad_sql("vec_id+7")} FROM embeddings WHERE vec_id%9=0),
ver AS (SELECT vec_id AS id, 'v'||{_pad_sql("vec_id")} AS vid, CASE WHEN vec_id>=10 THEN 'v'||{_pad_sql("vec_id-10")} END AS parent FROM embeddings),
q AS (SELECT v AS qv FROM vec WHERE id=0),
ham AS (SELECT vec.*, len(list_filter(range(1, len(v)+1), lambda i: (v[i]>0) <> (qv[i]>0)))::INT AS ham,
    1-greatest(-1, least(1, list_inner_product(v, qv)/(sqrt(list_inner_product(v, v)*list_inner_product(qv, qv))+1e-8))) AS d FROM vec, q),
pool AS (SELECT *, floor(d*10000)::BIGINT AS score, floor(d*10000)/10000 AS dist FROM ham ORDER BY ham, sk LIMIT 160),
sem AS (SELECT * FROM pool WHERE state=0 AND scope='' ORDER BY score, sk LIMIT 10),
tok AS (SELECT sk, unnest(regexp_extract_all({_lower_sql("text")}, '[\\p{{L}}\\p{{N}}]+')) AS term FROM fact),
tf AS (SELECT sk, term, count(*) AS tf FROM tok WHERE term IN ('apache','idiot','license','thing','version') GROUP BY ALL),
idf AS (SELECT term, ln(((SELECT count(DISTINCT sk) FROM tok)+1)::DOUBLE/(count(*)+1))+1 AS idf FROM tf GROUP BY term),
lex AS (SELECT sk, round(sum((1+ln(tf))*idf), 9) AS score, list_sort(list(term)) AS matched FROM tf JOIN idf USING (term) GROUP BY sk ORDER BY score DESC, sk LIMIT 40),
rep AS (SELECT vec_id AS id, 'md/L'||(vec_id%8)||'/rep/'||{_pad_sql("vec_id")} AS sk, vec_id%8 AS layer, vec_id%4 AS n, vec_id+10 AS lc, vec_id+10+(vec_id%5-2) AS rc,
    vec_id%7=0 AS more, vec_id%23<>0 AS held, CASE WHEN vec_id%11=0 THEN 1 ELSE 0 END AS ls, CASE WHEN vec_id%6=0 THEN 1 ELSE 0 END AS rs FROM embeddings),
verdict AS (SELECT *, CASE WHEN layer IN (0,1,6) THEN 'rejected' WHEN NOT held THEN 'applied'
    WHEN rc=lc AND NOT more THEN CASE WHEN ls=rs THEN 'duplicate' ELSE 'applied' END
    WHEN rc<lc AND NOT more THEN 'stale' WHEN rc>=lc THEN 'applied' ELSE 'conflict' END AS verdict FROM rep)
"""


def _q(spark, d, i: int = 0) -> list[float]:
    row = store.vectors(spark, d).filter(F.col("id") == i).select("embedding").first()
    return list(row[0]) if row else []


def _sem(spark, d, **kw) -> DataFrame:
    return recall.recall(store.vectors(spark, d), _q(spark, d), K, **kw)


def _pool(spark, d, n: int) -> DataFrame:
    q = _q(spark, d)
    return recall.scored(recall.visible(recall.coarse(store.vectors(spark, d), q, n)), q)


def _hits(df: DataFrame) -> DataFrame:
    return df.select("sk", "ham", "score", F.round("dist", 6).alias("dist"))


# --- semantic recall -------------------------------------------------------------------


@query("SELECT sk, ham, score, round(dist, 6) AS dist FROM sem")
def recall_semantic(spark, d):
    return _hits(_sem(spark, d))


@query("SELECT sk, ham, score, round(dist, 6) AS dist FROM pool WHERE scope='' ORDER BY score, sk LIMIT 10")
def recall_historical(spark, d):
    return _hits(_sem(spark, d, historical=True))


@query("SELECT sk, ham, score, round(dist, 6) AS dist FROM pool WHERE state=0 AND scope='tenant/1' ORDER BY score, sk LIMIT 10")
def recall_scoped(spark, d):
    return _hits(_sem(spark, d, scope="tenant/1"))


@query("SELECT sk, ham, score, round(dist, 6) AS dist FROM (SELECT * FROM pool ORDER BY ham, sk LIMIT 120) WHERE scope='tenant/1' ORDER BY score, sk LIMIT 120")
def recall_scoped_historical(spark, d):
    return _hits(recall.recall(store.vectors(spark, d), _q(spark, d), 120, "tenant/1", True, oversample=1))


@query("SELECT sk, ham FROM ham ORDER BY ham, sk LIMIT 10")
def bq_topk(spark, d):
    return recall.coarse(store.vectors(spark, d), _q(spark, d), K).select("sk", "ham")


@query("""SELECT sk, len(list_filter(range(1, len(v)+1), lambda i: (v[i]>0) <> (qv[i]>list_sum(qv)/len(qv))))::INT AS ham FROM vec, q ORDER BY ham, sk LIMIT 10""")
def bq_topk_centered(spark, d):
    return recall.coarse(store.vectors(spark, d), _q(spark, d), K, centered=True).select("sk", "ham")


@query("SELECT sk, round(d, 6) AS d FROM ham ORDER BY d, sk LIMIT 10")
def cosine_exact_topk(spark, d):
    dist = S.cosine_distance(F.col("embedding"), S.literal_vector(_q(spark, d)))
    return store.vectors(spark, d).select("sk", F.round(dist, 6).alias("d"), dist.alias("e")).orderBy("e", "sk").limit(K).drop("e")


@query("SELECT sk, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN v[i]>0 AND i<64 THEN (1::BIGINT<<(i-1)) ELSE 0 END))::BIGINT AS low_bits, CASE WHEN v[64]>0 THEN 1 ELSE 0 END AS top_bit FROM vec")
def sign_quantise(spark, d):
    w = recall.with_words(store.vectors(spark, d), 64)
    return w.select("sk", F.col("w0").bitwiseAND(F.lit((1 << 63) - 1)).alias("low_bits"), F.when(F.col("w0") < 0, 1).otherwise(0).alias("top_bit"))


@query("""
, qs AS (SELECT id AS qid, v AS qv FROM vec WHERE id<40),
pairs AS (SELECT qid, sk, len(list_filter(range(1, len(v)+1), lambda i: (v[i]>0) <> (qs.qv[i]>0))) AS h,
   1-greatest(-1, least(1, list_inner_product(v, qs.qv)/(sqrt(list_inner_product(v, v)*list_inner_product(qs.qv, qs.qv))+1e-8))) AS d FROM vec, qs),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, sk) AS rc, row_number() OVER (PARTITION BY qid ORDER BY h, sk) AS rh FROM pairs)
SELECT f AS factor, round((count(*) FILTER (rh<=5*f))::DOUBLE/count(*), 6) AS share FROM r, unnest([1,2,4,8,16]) AS t(f) WHERE rc<=5 GROUP BY f""")
def recall_at_k_quality(spark, d):
    words = recall.with_words(store.vectors(spark, d), 64)
    found = recall.coarse_recall_quality(words, words.filter("id < 40"), 5, [1, 2, 4, 8, 16])
    return found.select("factor", F.round("share", 6).alias("share"))


@query("""
, blocks AS (SELECT sk, b, list_transform(range(b*8+1, b*8+9), lambda i: CASE WHEN v[i]>0 THEN 1 ELSE 0 END) AS bits,
   list_transform(range(b*8+1, b*8+9), lambda i: CASE WHEN qv[i]>0 THEN 1 ELSE 0 END) AS qb FROM vec, q, unnest(range(8)) AS t(b)),
near AS (SELECT sk, len(list_filter(range(1,9), lambda i: bits[i]<>qb[i])) AS diff, len(list_filter(range(1,5), lambda i: bits[i]<>qb[i])) AS low FROM blocks)
SELECT DISTINCT sk FROM near WHERE diff=0 OR (diff=1 AND low=1)""")
def mih_candidates(spark, d):
    return recall.multi_index_candidates(store.vectors(spark, d), _q(spark, d), 8).select("sk")


@query("""
, blocks AS (SELECT sk, ham, b, list_transform(range(b*8+1, b*8+9), lambda i: CASE WHEN v[i]>0 THEN 1 ELSE 0 END) AS bits,
   list_transform(range(b*8+1, b*8+9), lambda i: CASE WHEN qv[i]>0 THEN 1 ELSE 0 END) AS qb FROM ham, q, unnest(range(8)) AS t(b)),
near AS (SELECT sk, ham, len(list_filter(range(1,9), lambda i: bits[i]<>qb[i])) AS diff, len(list_filter(range(1,5), lambda i: bits[i]<>qb[i])) AS low FROM blocks)
SELECT DISTINCT sk, ham FROM near WHERE diff=0 OR (diff=1 AND low=1) ORDER BY ham, sk LIMIT 5""")
def mih_topk(spark, d):
    q = _q(spark, d)
    found = recall.multi_index_candidates(store.vectors(spark, d), q, 8)
    return found.select("sk", S.hamming([F.col("w0")], S.query_words(q)).alias("ham")).orderBy("ham", "sk").limit(5)


@query("SELECT DISTINCT len(v)::INT AS dim FROM vec")
def indexed_dims(spark, d):
    return store.vectors(spark, d).select(F.size("embedding").alias("dim")).distinct()


@query("SELECT sk, round(total, 6) AS total FROM (SELECT *, dist+0.2*0.5+0.5*(1-importance) AS total FROM pool WHERE state=0 AND scope='') ORDER BY total, sk LIMIT 10")
def recall_weighted(spark, d):
    found = recall.weighted(_pool(spark, d, 16 * K), 5000, 1.0, 0.2, 0.5).orderBy("total", "sk").limit(K)
    return found.select("sk", F.round("total", 6).alias("total"))


@query("""
, tr AS (SELECT * FROM (VALUES (0, 0.9::DOUBLE), (1, 0.1::DOUBLE), (2, 0.7::DOUBLE)) AS t(node, trust)),
w AS (SELECT sk, dist AS sem, 1-importance AS imp, 1-confidence AS conf, 1-coalesce(trust, 0.5::DOUBLE) AS src FROM pool LEFT JOIN tr ON source=node WHERE state=0 AND scope='')
SELECT sk, round(sem, 6) AS sem, round(imp, 6) AS imp, round(conf, 6) AS conf, round(src, 6) AS src, round(sem+0.2*0.5+0.5*imp+0.3*conf+0.4*src, 6) AS total
FROM w ORDER BY sem+0.2*0.5+0.5*imp+0.3*conf+0.4*src, sk LIMIT 10""")
def recall_weighted_full(spark, d):
    trust = spark.createDataFrame(TRUST, "node int, trust double")
    found = recall.weighted(_pool(spark, d, 16 * K), 5000, 1.0, 0.2, 0.5, 0.3, 0.4, F.broadcast(trust)).orderBy("total", "sk").limit(K)
    return found.select("sk", *[F.round(c, 6).alias(c) for c in ("sem", "imp", "conf", "src", "total")])


@query("""
, t AS (SELECT sk, dist, CASE WHEN valid_from IS NOT NULL THEN CASE WHEN valid_from<=700 AND 700<valid_until THEN 0 ELSE 1 END
   ELSE greatest(0, least(1, abs(700-created_tick)/1000.0::DOUBLE)) END::DOUBLE AS tpen FROM pool WHERE state=0 AND scope='')
SELECT sk, round(tpen, 6) AS tpen, round(0.7*dist+0.3*tpen, 6) AS total FROM t ORDER BY 0.7*dist+0.3*tpen, sk LIMIT 10""")
def recall_temporal(spark, d):
    found = recall.temporal(_pool(spark, d, 16 * K), 700, 0.7, 0.3).orderBy("total", "sk").limit(K)
    return found.select("sk", F.round("tpen", 6).alias("tpen"), F.round("total", 6).alias("total"))


@query("SELECT sk, score FROM sem WHERE valid_from IS NULL OR (valid_from<=700 AND 700<valid_until)")
def recall_as_of(spark, d):
    return recall.valid_at(_sem(spark, d), 700).select("sk", "score")


@query("""
, e AS (SELECT sk, importance, len(list_filter(entities, lambda e: e='label/1'))+len(list_filter(entities, lambda e: e='bucket/3')) AS n FROM vec WHERE state=0 AND scope='')
SELECT sk, n::INT AS overlap, round(1-n/2.0::DOUBLE, 6) AS dist FROM e WHERE n>0 ORDER BY n DESC, importance DESC, sk LIMIT 10""")
def recall_entities(spark, d):
    found = recall.entities(store.vectors(spark, d), ["label/1", "bucket/3"], K)
    return found.select("sk", "overlap", F.round("dist", 6).alias("dist"))


# --- lexical recall --------------------------------------------------------------------


@query("SELECT sk, term, count(*) AS tf FROM tok GROUP BY ALL")
def tokenize_terms(spark, d):
    return lexical.postings(store.facts(spark, d))


@query("SELECT term, count(*)::BIGINT AS df, sum(c)::BIGINT AS total FROM (SELECT sk, term, count(*) AS c FROM tok GROUP BY ALL) GROUP BY term")
def lexical_index_stats(spark, d):
    return lexical.index_stats(store.facts(spark, d))


@query("SELECT sk, round(score, 6) AS score, array_to_string(matched, ',') AS matched FROM lex ORDER BY score DESC, sk LIMIT 20")
def lexical_matched_terms(spark, d):
    found = lexical.search(store.facts(spark, d), TERMS, 20)
    return found.select("sk", F.round("score", 6).alias("score"), F.array_join("matched", ",").alias("matched"))


def _lex_sql(more: str) -> str:
    return f"""SELECT l.sk, round(l.score, 6) AS score, round(greatest(0, least(1, 1-l.score/(SELECT max(score) FROM lex))), 6) AS dist
      FROM (SELECT * FROM lex ORDER BY score DESC, sk LIMIT 20) l JOIN fact USING (sk) WHERE {more}"""


def _lex(spark, d, **kw) -> DataFrame:
    found = lexical.recall_lexical(store.facts(spark, d), TERMS, 20, **kw)
    return found.select("sk", F.round("score", 6).alias("score"), F.round("dist", 6).alias("dist"))


@query(_lex_sql("state=0 AND scope=''"))
def recall_lexical(spark, d):
    return _lex(spark, d)


@query(_lex_sql("scope=''"))
def recall_lexical_historical(spark, d):
    return _lex(spark, d, historical=True)


@query(_lex_sql("state=0 AND scope='tenant/en'"))
def recall_lexical_scoped(spark, d):
    return _lex(spark, d, scope="tenant/en")


@query("""
, l AS (SELECT lex.sk, lex.score FROM lex JOIN fact USING (sk) WHERE state=0 AND scope='')
SELECT sk, part FROM (SELECT sk, 0 AS part, score::DOUBLE AS o FROM (SELECT * FROM sem ORDER BY score, sk LIMIT 4) UNION ALL SELECT sk, 1, -score FROM l) ORDER BY part, o, sk LIMIT 12""")
def recall_hybrid(spark, d):
    semantic = _sem(spark, d).orderBy("score", "sk").limit(4)
    found = recall.hybrid(semantic, lexical.recall_lexical(store.facts(spark, d), TERMS, 40), 12)
    return found.select("sk", "part")


@query(f"""SELECT sk, n, first FROM (SELECT sk, array_to_string(regexp_extract_all({_lower_sql("text")}, '[\\p{{L}}\\p{{N}}]+'), ' ') AS norm, text FROM fact) t,
   LATERAL (SELECT length(norm) AS n, left(norm, 40) AS first)""")
def normalize_text(spark, d):
    norm = S.normalized(F.col("text"))
    return store.facts(spark, d).select("sk", F.length(norm).cast("long").alias("n"), F.left(norm, F.lit(40)).alias("first"))


# --- relations and lineage -------------------------------------------------------------


@query("SELECT b FROM edge WHERE a='md/L4/vec/00000036' AND kind='causes' ORDER BY b")
def relations_outgoing(spark, d):
    return graph.outgoing(store.relations(spark, d), "md/L4/vec/00000036", "causes")


@query("SELECT kind, b AS target FROM edge WHERE a='md/L4/vec/00000036' UNION ALL SELECT kind, a FROM edge WHERE b='md/L4/vec/00000036'")
def related_to(spark, d):
    return graph.related_to(store.relations(spark, d), "md/L4/vec/00000036")


@query(", chain AS (SELECT 0 AS depth, vid, parent FROM ver WHERE vid='v00000499' UNION ALL SELECT depth+1, ver.vid, ver.parent FROM chain JOIN ver ON ver.vid=chain.parent) SELECT depth::INT AS depth, vid FROM chain")
def lineage(spark, d):
    return graph.lineage(store.versions(spark, d), "v00000499")


@query("SELECT parent AS vid, string_agg(vid, ',' ORDER BY vid) AS children FROM ver WHERE parent IS NOT NULL GROUP BY parent")
def children(spark, d):
    return graph.children(store.versions(spark, d)).select("vid", F.array_join("children", ",").alias("children"))


@query("""SELECT vec.sk, ver.vid, round(importance, 6) AS importance, state, valid_from, valid_until, coalesce(ver.parent, '') AS parents, coalesce(c.vid, '') AS children
   FROM vec JOIN ver USING (id) LEFT JOIN ver c ON c.parent=ver.vid""")
def explain(spark, d):
    found = graph.explain(store.vectors(spark, d), store.versions(spark, d))
    return found.select("sk", "vid", F.round("importance", 6).alias("importance"), "state", "valid_from", "valid_until", F.array_join("parents", ",").alias("parents"), F.array_join("children", ",").alias("children"))


@query("""
, e AS (SELECT sk, importance, len(list_filter(entities, lambda e: e='label/1')) AS n FROM vec WHERE state=0 AND scope=''),
eh AS (SELECT * FROM e WHERE n>0 ORDER BY importance DESC, sk LIMIT 10)
SELECT sk, 'semantic' AS path FROM sem UNION ALL SELECT sk, 'entities' FROM eh UNION ALL SELECT b, 'contradicts' FROM edge WHERE kind='contradicts' AND a IN (SELECT sk FROM eh WHERE importance>=0.5)""")
def gather_evidence(spark, d):
    return graph.gather_evidence(_sem(spark, d), recall.entities(store.vectors(spark, d), ["label/1"], K), store.relations(spark, d))


@query("""SELECT kind, a, b FROM edge WHERE b IN (SELECT sk FROM vec)""")
def associate_checked(spark, d):
    edges = store.relations(spark, d)
    return graph.associate(edges.limit(0), edges, store.vectors(spark, d))


@query("SELECT kind, a, b FROM edge WHERE a<>'md/L4/vec/00000036' AND b<>'md/L4/vec/00000036'")
def remove_relations(spark, d):
    return graph.remove_key(store.relations(spark, d), "md/L4/vec/00000036")


# --- access ----------------------------------------------------------------------------


@query("SELECT sk, text, round(importance, 6) AS importance FROM mem WHERE sk='md/L3/doc/00000007'")
def get_doc(spark, d):
    return access.get(store.memories(spark, d), 3, "doc/00000007").select("sk", "text", F.round("importance", 6).alias("importance"))


@query("SELECT sk, layer FROM mem WHERE starts_with(sk, 'md/L3/doc/000000')")
def scan_prefix(spark, d):
    return access.scan_prefix(store.memories(spark, d), "md/L3/doc/000000").select("sk", "layer")


@query("SELECT sk FROM mem WHERE starts_with(sk, 'md/L2/') ORDER BY sk LIMIT 25 OFFSET 50")
def scan_prefix_page(spark, d):
    return access.scan_prefix_page(store.memories(spark, d), "md/L2/", 50, 25).select("sk")


@query("SELECT sk, 70 AS next_cursor FROM (SELECT sk FROM mem WHERE starts_with(sk, 'md/L4/') ORDER BY sk LIMIT 20 OFFSET 50)")
def cursor_page(spark, d):
    return access.cursor_page(store.memories(spark, d), "md/L4/", 50, 20)


@query("SELECT 'md/L2/'||v.key AS sk, coalesce(mem.text, '') AS text FROM vec v LEFT JOIN mem ON mem.sk='md/L2/'||v.key")
def batch_texts(spark, d):
    keys = store.vectors(spark, d).select(F.concat(F.lit("md/L2/"), "key").alias("sk"))
    return access.batch_texts(keys, store.memories(spark, d))


@query("SELECT key, arg_min(sk, CASE layer WHEN 4 THEN 0 WHEN 5 THEN 1 WHEN 3 THEN 2 ELSE 3 END) AS sk FROM mem GROUP BY key")
def resolve_key(spark, d):
    mem = store.memories(spark, d)
    return access.resolve(mem.select("key"), mem)


@query("""
, keys AS (SELECT DISTINCT 'turn:'||conv_id AS sk FROM conversations)
SELECT x.sk, y.sk AS other FROM keys x JOIN keys y ON starts_with(y.sk, x.sk) AND x.sk<>y.sk""")
def prefix_conflicts(spark, d):
    keys = store.read(spark, d, "conversations").select(F.concat(F.lit("turn:"), F.col("conv_id").cast("string")).alias("sk"))
    return access.prefix_conflicts(keys)


@query("""
, k AS (SELECT DISTINCT CASE page_id%6 WHEN 0 THEN url||'#'||page_id WHEN 1 THEN '' WHEN 2 THEN 'a/../'||page_id WHEN 3 THEN url||chr(7) WHEN 4 THEN repeat('k', 4090)||lpad(page_id::VARCHAR, 7, '0') ELSE 'page/'||page_id END AS key FROM pages)
SELECT key, CASE WHEN key='' THEN 'empty' WHEN strlen(key)>4096 THEN 'long' WHEN contains(key, '#') THEN 'hash' WHEN contains(key, chr(7)) THEN 'control' ELSE 'dots' END AS why FROM k WHERE NOT starts_with(key, 'page/')""")
def validate_keys(spark, d):
    n, number = F.col("page_id") % 6, F.col("page_id").cast("string")
    key = F.when(n == 0, F.concat("url", F.lit("#"), number)).when(n == 1, "").when(n == 2, F.concat(F.lit("a/../"), number)).when(n == 3, F.concat("url", F.lit("\x07"))).when(n == 4, F.concat(F.repeat(F.lit("k"), 4090), F.lpad(number, 7, "0"))).otherwise(F.concat(F.lit("page/"), number))
    return access.bad_keys(store.read(spark, d, "pages").select(key.alias("key")).distinct())


@query("SELECT 'memory://L3/'||key AS uri, '3' AS layer, key FROM fact")
def parse_uri(spark, d):
    return access.parse_uri(store.facts(spark, d).select(F.concat(F.lit("memory://L3/"), "key").alias("uri")))


@query("SELECT sk FROM rep WHERE n=2 AND rc=113 OR (more AND (n+1)%4=2 AND 113=5) UNION ALL SELECT sk FROM rep WHERE more AND (n+1)%4=2 AND n<>2")
def keys_for_clock(spark, d):
    rows = store.replicas(spark, d)
    return access.keys_for_clock(rows, 2, 113).union(access.keys_for_clock(rows, 2, 5))


# --- observability ---------------------------------------------------------------------


@query("SELECT CASE WHEN scope='' THEN '(global)' ELSE scope END AS label, count(*) AS n FROM mem WHERE layer BETWEEN 3 AND 5 GROUP BY ALL")
def scope_distribution(spark, d):
    return observe.scope_distribution(store.memories(spark, d))


@query("""
, s AS (SELECT CASE WHEN scope='' THEN '(global)' ELSE scope END AS label, count(*) AS n FROM mem WHERE layer BETWEEN 3 AND 5 GROUP BY ALL ORDER BY n DESC, label LIMIT 8)
SELECT (SELECT count(*) FROM mem) AS docs, (SELECT count(*) FROM vec) AS vectors, (SELECT count(*) FROM verdict WHERE verdict='conflict') AS conflicts,
  (SELECT count(*) FROM verdict WHERE verdict='conflict') AS open_conflicts, (SELECT string_agg(DISTINCT len(v)::VARCHAR, ',') FROM vec) AS dims, (SELECT string_agg(label, ',' ORDER BY n DESC, label) FROM s) AS top_scopes""")
def health(spark, d):
    return observe.health(store.memories(spark, d), replicate.conflicts_of(store.replicas(spark, d)))


@query("""SELECT 'orphan_side_row' AS issue, sk FROM (SELECT DISTINCT b AS sk FROM edge) WHERE sk NOT IN (SELECT sk FROM mem)
   UNION ALL SELECT 'not_indexed', sk FROM vec WHERE id%50=0 UNION ALL SELECT 'index_orphan', sk||'/gone' FROM vec WHERE id%75=1""")
def validate(spark, d):
    mem = store.memories(spark, d)
    side = store.relations(spark, d).select(F.col("b").alias("sk")).distinct()
    vec = store.vectors(spark, d)
    gone = vec.filter("id % 75 = 1").select(F.concat("sk", F.lit("/gone")).alias("sk"))
    return observe.validate(mem, side, vec.filter("id % 50 <> 0").select("sk").union(gone))


@query("SELECT CASE WHEN id%4=1 THEN 32 ELSE len(v) END::INT AS dim, count(*) AS docs, count(*) FILTER (id%3<>0) AS covered, coalesce(sum(strlen(text)) FILTER (id%3<>0), 0)::BIGINT AS text_bytes FROM vec GROUP BY ALL")
def era_report(spark, d):
    """Two sizes of vectors, and every third memory without its companion."""
    gone = (F.col("layer") == 2) & (F.col("id") % 3 == 0) & F.col("key").startswith("vec/")
    short = F.when(F.col("id") % 4 == 1, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return observe.era_report(store.memories(spark, d).filter(~gone).withColumn("embedding", short))


@query("SELECT (count(*)*86000)::BIGINT AS nanoseconds, 'ok' AS verdict FROM vec")
def era_estimate(spark, d):
    return observe.era_estimate(observe.era_report(store.memories(spark, d)))


@query("SELECT sk, text FROM mem WHERE layer=2 AND source=1 ORDER BY sk DESC LIMIT 15")
def diary(spark, d):
    return observe.diary(store.memories(spark, d), 1, 15).select("sk", "text")


@query("SELECT sk, round(importance, 6) AS importance, text FROM mem WHERE layer BETWEEN 3 AND 5 AND source=2 ORDER BY importance DESC, sk LIMIT 15")
def profile(spark, d):
    return observe.profile(store.memories(spark, d), 2, 15).select("sk", F.round("importance", 6).alias("importance"), "text")


@query("SELECT 'conflict' AS kind, sk AS name FROM verdict WHERE verdict='conflict' UNION ALL SELECT 'superseded', sk FROM (SELECT sk FROM mem WHERE state=1 ORDER BY sk LIMIT 20)")
def tensions(spark, d):
    return observe.tensions(replicate.conflicts_of(store.replicas(spark, d)), store.memories(spark, d))


@query("""
, s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT p AS share, min(value) AS value FROM s, unnest([0.5::DOUBLE, 0.99::DOUBLE]) AS t(p) WHERE r=least(floor(n*p), n-1) GROUP BY p""")
def latency_percentiles(spark, d):
    return observe.percentiles(store.read(spark, d, "events"), "value", [0.5, 0.99])


@query("SELECT CASE WHEN layer IN (3,4,5) THEN 'long' ELSE 'short' END AS kind, count(*) AS n FROM mem GROUP BY ALL")
def layer_counts(spark, d):
    return store.memories(spark, d).groupBy(F.when(F.col("layer").isin(3, 4, 5), "long").otherwise("short").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# --- governance ------------------------------------------------------------------------


@query("""
, r AS (SELECT *, CASE WHEN id%6=0 THEN 4000 ELSE 0 END AS reinforced FROM mem WHERE state=0 AND layer BETWEEN 3 AND 5),
x AS (SELECT sk, importance, confidence, exp(-greatest(5000-CASE WHEN reinforced<>0 THEN reinforced ELSE created_tick END, 0)/3000.0::DOUBLE) AS f FROM r),
y AS (SELECT *, greatest(0, least(1, least(importance, 0.05+(importance-0.05)*f))) AS i, greatest(0, least(1, confidence*f)) AS c FROM x)
SELECT sk, round(i, 6) AS new_importance, round(c, 6) AS new_confidence, CASE WHEN i<=0.06 THEN 4 ELSE 0 END AS new_state, abs(i-importance)>1e-7 OR abs(c-confidence)>1e-7 OR i<=0.06 AS changed FROM y""")
def decay_importance(spark, d):
    reinforced = F.when(F.col("id") % 6 == 0, 4000).otherwise(0).cast("long")
    found = govern.decay(store.memories(spark, d).withColumn("last_reinforced", reinforced), 5000, 3000, decayed_at=0.06, with_confidence=True)
    return found.select("sk", F.round("new_importance", 6).alias("new_importance"), F.round("new_confidence", 6).alias("new_confidence"), "new_state", "changed")


@query(f"""
, n AS (SELECT *, array_to_string(regexp_extract_all({_lower_sql("text")}, '[\\p{{L}}\\p{{N}}]+'), ' ') AS norm FROM rec),
g AS (SELECT norm, count(*) AS n, min(sk) AS first_sk, arg_min(text, sk) AS text, string_agg(created_tick::VARCHAR, ',' ORDER BY created_tick) AS parents FROM n WHERE norm<>'' GROUP BY norm HAVING count(*)>=2 AND strlen(arg_min(text, sk))>=8),
k AS (SELECT *, substr(norm, 1, 1) NOT IN ('d', 'e') AS new FROM g),
cut AS (SELECT max(norm) AS last, count(*) AS made FROM (SELECT norm FROM k WHERE new ORDER BY norm LIMIT 20))
SELECT norm, n, first_sk, parents, new FROM k, cut WHERE made<20 OR norm<=last""")
def consolidate_recurrences(spark, d):
    """Facts of groups that begin with d or e are there already."""
    known = govern.consolidate(store.recurring(spark, d), min_repeats=2, most_new=1_000_000).filter("substr(norm, 1, 1) IN ('d', 'e')").select("key", "text")
    found = govern.consolidate(store.recurring(spark, d), min_repeats=2, most_new=20, known=known)
    return found.select("norm", "n", "first_sk", F.array_join(F.transform("parents", lambda p: p.cast("string")), ",").alias("parents"), "new")


@query("SELECT sk, 3 AS new_state FROM mem WHERE valid_until<=2000 AND state NOT IN (2,3,4)")
def expire_old(spark, d):
    return govern.expire(store.memories(spark, d), 2000).select("sk", "new_state")


_STAGE = """
p{s} AS (SELECT * FROM m{s} WHERE layer={s} AND state=0 AND importance>={least} AND 5000-created_tick>={age}),
m{t} AS (SELECT sk, key, layer, importance, CASE WHEN sk IN (SELECT sk FROM p{s}) THEN {left} ELSE state END AS state, created_tick FROM m{s}
   WHERE sk NOT IN (SELECT 'md/L{t}/'||key FROM p{s}) UNION ALL SELECT 'md/L{t}/'||key, key, {t}, {imp}, state, 5000 FROM p{s}),"""


@query(
    ", m1 AS (SELECT sk, key, layer, importance, state, created_tick FROM mem)," + "".join(_STAGE.format(s=s, t=t, least=least, age=age, left=left, imp=S.LAYER_IMPORTANCE[t]) for s, t, least, age, left in govern.PROMOTIONS)
    + " z AS (SELECT 1) SELECT sk, layer::INT AS layer, round(CASE WHEN state=0 THEN importance*0.99 ELSE importance END, 6) AS importance, CASE WHEN state=1 AND 5000-created_tick>=1000 THEN 2 ELSE state END::INT AS state FROM m4"
)
def lifecycle_tick(spark, d):
    found = govern.lifecycle_tick(store.memories(spark, d), 5000)
    return found.select("sk", "layer", F.round("importance", 6).alias("importance"), "state")


@query("SELECT 'md/L4/'||key AS sk, 1.0::DOUBLE AS importance FROM fact WHERE state=0 AND importance>=0.8 AND 5000-created_tick>=3")
def promote(spark, d):
    mem = store.facts(spark, d).select("sk", "key", "layer", "importance", "state", "created_tick")
    return govern.promote(mem, 3, 4, 0.8, 3, 1, 5000).filter("layer = 4").select("sk", "importance")


# --- writes ----------------------------------------------------------------------------


def _turns(spark, d) -> DataFrame:
    return store.read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("ts"), F.col("role").alias("user"), F.col("text").alias("reply"))


@query(f"""SELECT 'md/L2/'||{_ts_sql("conv_id*100+turn")}||'/u' AS sk, role AS text FROM conversations UNION ALL SELECT 'md/L2/'||{_ts_sql("conv_id*100+turn")}||'/a', text FROM conversations""")
def remember_episodic(spark, d):
    return write.remember_episodic(_turns(spark, d))


@query("SELECT 'md/L1/last_user' AS sk, arg_max(role, conv_id*100+turn) AS text FROM conversations UNION ALL SELECT 'md/L2/last_asst', arg_max(text, conv_id*100+turn) FROM conversations")
def remember_exchange(spark, d):
    return write.remember_exchange(_turns(spark, d))


@query("SELECT 'md/L4/'||key AS sk, 4 AS layer, text, len(v)::INT AS dim, coalesce(nullif(scope, ''), 'tenant/default') AS scope FROM vec UNION ALL SELECT 'md/L2/'||key, 2, text, NULL, coalesce(nullif(scope, ''), 'tenant/default') FROM vec")
def remember_semantic(spark, d):
    found = write.remember_semantic(store.vectors(spark, d).select("key", "text", "embedding", "scope"), "tenant/default")
    return found.select("sk", "layer", "text", F.size("embedding").alias("dim"), "scope")


@query("SELECT 'md/L5/'||key AS sk, text FROM fact")
def remember_text(spark, d):
    return write.remember_text(store.facts(spark, d), 5)


@query("SELECT sk, 1 AS state, NULL::BIGINT AS new_parent FROM vec WHERE id%20=0 UNION ALL SELECT 'md/L4/vec/'||lpad((id+1)::VARCHAR, 8, '0'), 0, created_tick FROM vec WHERE id%20=0")
def supersede(spark, d):
    vec = store.vectors(spark, d)
    pairs = vec.filter("id % 20 = 0").select(F.col("sk").alias("old"), F.concat(F.lit("md/L4/vec/"), S.padded(F.col("id") + 1)).alias("new"))
    return write.supersede(vec, pairs)


@query("SELECT 'md/L5/'||key AS sk, text, 0 AS state, sk AS parent FROM fact UNION ALL SELECT sk, text, 2, NULL FROM fact")
def transfer_layer(spark, d):
    return write.transfer(store.facts(spark, d), 5)


@query("""SELECT 'md/L4/both/'||x.id AS sk, x.text||chr(31)||y.text AS text, round(greatest(x.importance, y.importance), 6) AS importance, round(greatest(x.confidence, y.confidence), 6) AS confidence, x.sk||','||y.sk AS parents
   FROM vec x JOIN fact y ON x.id=y.id WHERE x.id%10=0""")
def merge_memories(spark, d):
    both = store.vectors(spark, d).unionByName(store.facts(spark, d))
    pairs = store.vectors(spark, d).filter("id % 10 = 0").select(F.col("sk").alias("a"), F.concat(F.lit("md/L3/doc/"), S.padded(F.col("id"))).alias("b"), F.concat(F.lit("both/"), F.col("id").cast("string")).alias("target"))
    found = write.merge_memories(both, pairs)
    return found.select("sk", "text", F.round("importance", 6).alias("importance"), F.round("confidence", 6).alias("confidence"), F.array_join("parents", ",").alias("parents"))


@query("""
, acts AS (SELECT user_id AS slot, event_id AS seq, CASE event_type WHEN 'click' THEN 0.05 WHEN 'purchase' THEN 0.1 ELSE -0.1 END::DOUBLE AS di,
   CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 0.1 ELSE -0.1 END::DOUBLE AS dc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type IN ('click','purchase','error')),
fold AS (SELECT slot, seq, r, greatest(0, least(1, 0.5+di))::DOUBLE AS i, greatest(0, least(1, 0.5+dc))::DOUBLE AS c FROM acts WHERE r=1
  UNION ALL SELECT a.slot, a.seq, a.r, greatest(0, least(1, i+di))::DOUBLE, greatest(0, least(1, c+dc))::DOUBLE FROM fold JOIN acts a ON a.slot=fold.slot AND a.r=fold.r+1)
SELECT slot, round(arg_max(i, r), 6) AS importance, round(arg_max(c, r), 6) AS confidence, max(seq) AS last FROM fold GROUP BY slot""")
def reinforce_fold(spark, d):
    found = write.fold_signals(store.oplog(spark, d))
    return found.select("slot", F.round("importance", 6).alias("importance"), F.round("confidence", 6).alias("confidence"), "last")


@query("SELECT 'memory' AS kind, sk AS name FROM vec WHERE id%10<>0 UNION ALL SELECT 'edge', kind||a||b FROM edge WHERE a NOT IN (SELECT sk FROM vec WHERE id%10=0) AND b NOT IN (SELECT sk FROM vec WHERE id%10=0)")
def delete_cascade(spark, d):
    vec = store.vectors(spark, d)
    left, edges = write.delete(vec, vec.filter("id % 10 = 0"), store.relations(spark, d))
    return left.select(F.lit("memory").alias("kind"), F.col("sk").alias("name")).union(edges.select(F.lit("edge"), F.concat("kind", "a", "b")))


@query("SELECT sk, CASE WHEN id%7=0 THEN 2 ELSE state END AS state, round(CASE WHEN id%7=0 THEN greatest(0, least(1, importance*2)) ELSE importance END, 6) AS importance FROM vec")
def set_fields(spark, d):
    vec = store.vectors(spark, d)
    found = write.set_fields(vec, vec.filter("id % 7 = 0").select("sk", F.lit(2).alias("state"), (F.col("importance") * 2).alias("importance")))
    return found.select("sk", "state", F.round("importance", 6).alias("importance"))


@query("SELECT sk, CASE WHEN 900>coalesce(valid_from, 0) THEN coalesce(valid_from, 0) END AS valid_from, CASE WHEN 900>coalesce(valid_from, 0) THEN 900 END::BIGINT AS valid_until FROM vec")
def invalidate(spark, d):
    return write.invalidate(store.vectors(spark, d), 900).select("sk", "valid_from", "valid_until")


@query("""
, s AS (SELECT c_custkey AS subject, 'segment' AS predicate, c_mktsegment AS object FROM customer)
SELECT subject, predicate, CASE WHEN subject%3=0 THEN 'OTHER' ELSE object END AS object, CASE WHEN subject%5=0 THEN 'insert' WHEN subject%3=0 THEN 'overwrite' ELSE 'skip' END AS action FROM s""")
def dedup_statements(spark, d):
    rows = store.read(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.lit("segment").alias("predicate"), F.col("c_mktsegment").alias("object"))
    new = rows.withColumn("object", F.when(F.col("subject") % 3 == 0, "OTHER").otherwise(F.col("object")))
    return write.dedup_statements(rows.filter("subject % 5 <> 0"), new)


@query(f"""
, t AS (SELECT page_id, html AS text, trim(html, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS s FROM pages UNION ALL SELECT event_id+1000000000, props, trim(props) FROM events),
h AS (SELECT *, len(list_filter({S.CODE_WORDS!r}, lambda w: contains({_lower_sql("s")}, w))) AS hits FROM t)
SELECT page_id AS id, CASE WHEN length(s)>=2 AND ((s LIKE '{{%' AND s LIKE '%}}') OR (s LIKE '[%' AND s LIKE '%]')) THEN 'json'
  WHEN hits>=2 OR (hits=1 AND (contains(s, '{{') OR contains(s, '}}') OR contains(s, ';') OR contains(s, '->'))) THEN 'code' ELSE 'text' END AS content_type FROM h""")
def content_type_detect(spark, d):
    pages = store.read(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    events = store.read(spark, d, "events").select((F.col("event_id") + 1_000_000_000).alias("id"), F.col("props").alias("text"))
    return pages.union(events).select("id", S.content_type(F.col("text")).alias("content_type"))


@query("SELECT 'md/L7/doctrine' AS sk, 'Recall before answering.' AS text")
def ensure_doctrine(spark, d):
    return write.ensure_doctrine(store.memories(spark, d), "doctrine", "Recall before answering.")


#: FNV-1a of a list of bytes, as a HUGEINT, and a 64-bit number's bytes in hexadecimal, lowest first.
_FNV = "list_reduce(list_prepend({start}::HUGEINT, {bytes}), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"
_LOW_FIRST = "array_to_string(list_transform(range(8), lambda i: lpad(lower(to_hex(({x} // (1::HUGEINT << (8*i)) % 256)::BIGINT)), 2, '0')), '')"
_OFFSET, _OTHER = hashes.OFFSET, hashes.OFFSET ^ hashes.SECOND_LANE


def _memory_id_sql(node: str, tick: str, layer: str, key: str) -> str:
    data = f"list_concat([({node})::HUGEINT], list_transform(range(8), lambda i: (({tick}) // (1::HUGEINT << (8*i)) % 256)::HUGEINT), [({layer})::HUGEINT], list_transform(string_split({key}, ''), lambda c: ord(c)::HUGEINT))"
    return "||".join(_LOW_FIRST.format(x=_FNV.format(start=start, bytes=data)) for start in (_OFFSET, _OTHER))


@query(f"""
, w AS (SELECT user_id, event_id AS seq, {_memory_id_sql("1", "event_id+1", "3", "'slot/'||user_id")} AS version_id FROM events)
SELECT 'md/L3/slot/'||user_id AS sk, seq, first_value(version_id) OVER o AS memory_id, version_id, lag(version_id) OVER o AS parent, first_value(seq+1) OVER o AS created_tick FROM w WINDOW o AS (PARTITION BY user_id ORDER BY seq)""")
def put_versions(spark, d):
    writes = store.read(spark, d, "events").select(F.concat(F.lit("md/L3/slot/"), F.col("user_id").cast("string")).alias("sk"), F.lit(3).alias("layer"), F.concat(F.lit("slot/"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), F.col("props").alias("text"))
    return write.put(writes, 1, 0).select("sk", "seq", "memory_id", "version_id", "parent", "created_tick")


# --- replication -----------------------------------------------------------------------


@query("""
, m AS (SELECT sk, unnest([n, (n+1)%4]) AS node, unnest([greatest(lc, rc), CASE WHEN more THEN 5 END]) AS c FROM rep WHERE held)
SELECT sk, string_agg(node||':'||c, ',' ORDER BY node) AS clock FROM m WHERE c IS NOT NULL GROUP BY sk""")
def clock_merge(spark, d):
    merged = F.array_sort(F.map_entries(S.clock_merge(F.col("local_clock"), F.col("remote_clock"))))
    text = F.array_join(F.transform(merged, lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return store.replicas(spark, d).filter("local_clock is not null").select("sk", text.alias("clock"))


@query("SELECT sk, CASE WHEN rc=lc AND NOT more THEN 'equal' WHEN rc<lc AND NOT more THEN 'before' WHEN rc>=lc THEN 'after' ELSE 'concurrent' END AS rel FROM rep WHERE held")
def clock_compare(spark, d):
    rows = store.replicas(spark, d).filter("local_clock is not null")
    return rows.select("sk", S.clock_order(F.col("remote_clock"), F.col("local_clock")).alias("rel"))


@query("SELECT sk, verdict FROM verdict")
def merge_verdicts(spark, d):
    return replicate.merge_verdicts(store.replicas(spark, d)).select("sk", "verdict")


@query("SELECT sk AS subject, 'local:'||sk||','||'remote:'||sk AS candidates FROM verdict WHERE verdict='conflict'")
def conflicts(spark, d):
    return replicate.conflicts_of(store.replicas(spark, d)).select("subject", F.array_join("candidates", ",").alias("candidates"))


@query("""
, mine AS (SELECT n AS node, max(lc) AS counter FROM rep WHERE held GROUP BY n), known AS (SELECT n AS node, max(rc) AS have FROM rep WHERE n<>3 GROUP BY n)
SELECT node::INT AS node, counter, coalesce(have, 0)::BIGINT AS have FROM mine LEFT JOIN known USING (node) WHERE coalesce(have, 0)<counter""")
def missing_after(spark, d):
    rows = store.replicas(spark, d)
    mine = rows.select(F.explode("local_clock").alias("node", "counter")).groupBy("node").agg(F.max("counter").alias("counter"))
    known = rows.filter("id % 4 <> 3").select("id", F.explode("remote_clock").alias("node", "have")).filter("node = id % 4").groupBy("node").agg(F.max("have").alias("have"))
    return replicate.missing_after(mine, known)


_ARB = """
, c AS (SELECT id//3 AS conflict, sk AS candidate, importance, confidence, importance+confidence+0.1/(1.0+greatest(5000-created_tick, 0))+0.05*(CASE WHEN id>=10 THEN 1 ELSE 0 END) AS s FROM vec),
g AS (SELECT conflict, count(*) AS n, count(*) FILTER (s>1.5) AS strong, min(least(importance, confidence)) AS low, arg_min(candidate, (-s, candidate)) AS best FROM c GROUP BY conflict)
SELECT conflict, decision, CASE WHEN decision='prefer' THEN best END AS winner FROM (SELECT *, CASE WHEN n<2 THEN 'escalate' WHEN strong>=2 AND low>=1 THEN 'merge' WHEN strong>=2 THEN 'escalate' ELSE 'prefer' END AS decision FROM g)"""


@query(_ARB)
def arbitrate(spark, d):
    rows = store.vectors(spark, d).select(F.floor(F.col("id") / 3).alias("conflict"), F.col("sk").alias("candidate"), "importance", "confidence", "created_tick", F.when(F.col("id") >= 10, 1).otherwise(0).alias("n_parents"))
    return replicate.arbitrate(rows, 5000)


@query("SELECT sk AS subject, 'local:'||sk AS winner, 'remote:'||sk AS losers, 1 AS status FROM verdict WHERE verdict='conflict'")
def resolve_conflicts(spark, d):
    open_ = replicate.conflicts_of(store.replicas(spark, d))
    decided = open_.select(F.col("subject").alias("conflict"), F.get("candidates", 0).alias("winner"))
    return replicate.resolve(open_, decided).select("subject", "winner", F.array_join("losers", ",").alias("losers"), "status")


@query("SELECT sk, (CASE WHEN more AND 5>rc THEN (n+1)%4 ELSE n END)::INT AS author FROM rep")
def clock_author(spark, d):
    return store.replicas(spark, d).select("sk", replicate.author(F.col("remote_clock")).alias("author"))


@query("SELECT c_custkey AS node, round(c_acctbal, 2) AS trust FROM customer WHERE c_acctbal>=100 AND c_custkey%7<>0 ORDER BY c_acctbal DESC, c_custkey LIMIT 64")
def trusted_peers(spark, d):
    peers = store.read(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("trust"), (F.col("c_custkey") % 7 == 0).alias("revoked"))
    return replicate.trusted_peers(peers, 100).select("node", F.round("trust", 2).alias("trust"))


@query(f"SELECT sk, {_memory_id_sql('source', 'created_tick', '4', 'key')} AS memory_id FROM vec")
def memory_ids(spark, d):
    return store.vectors(spark, d).select("sk", hashes.memory_id(F.col("source"), F.col("created_tick"), F.col("layer"), F.col("key")).alias("memory_id"))


@query(f"""
, c AS (SELECT sk AS subject, list_concat(string_split(sk, ''), ['~'], string_split('local:'||sk, ''), ['~'], string_split('remote:'||sk, '')) AS chars FROM verdict WHERE verdict='conflict'),
h AS (SELECT subject, list_reduce(list_prepend({{'a': {_OFFSET}::HUGEINT, 'b': {_OFFSET}::HUGEINT}}, list_transform(chars, lambda c: {{'a': CASE WHEN c='~' THEN 255 ELSE ord(c) END::HUGEINT, 'b': 0::HUGEINT}})),
   lambda s, x: {{'a': (xor(s.a, x.a) * 1099511628211) % 18446744073709551616, 'b': ((xor(s.b, x.a) * 1099511628211) + (xor(s.a, x.a) * 1099511628211)) % 18446744073709551616}}) AS h FROM c)
SELECT subject, {_LOW_FIRST.format(x="h.a")}||{_LOW_FIRST.format(x="h.b")} AS conflict_id FROM h""")
def conflict_ids(spark, d):
    return replicate.conflicts_of(store.replicas(spark, d)).select("subject", hashes.conflict_id(F.col("subject"), F.col("candidates")).alias("conflict_id"))


@query()
def demo_embeddings(spark, d):
    return store.facts(spark, d).select("sk", hashes.demo_embedding(F.col("text")).alias("embedding"))


# --- audit and context -----------------------------------------------------------------


@query(f"""
, r AS (SELECT sk AS k, text||'|'||state AS v FROM vec),
b AS (SELECT string_agg(chr(strlen(k)::INT)||repeat('~', 7)||k||chr(strlen(v)::INT)||repeat('~', 7)||v, '' ORDER BY k) AS every FROM r)
SELECT lpad(lower(to_hex(h // 4294967296)), 8, '0')||lpad(lower(to_hex(h % 4294967296)), 8, '0') AS digest
FROM (SELECT {_FNV.format(start=_OFFSET, bytes="list_transform(string_split(every, ''), lambda c: (CASE WHEN c='~' THEN 0 ELSE ord(c) END)::HUGEINT)")} AS h FROM b)""")
def state_digest(spark, d):
    return audit.state_digest(store.vectors(spark, d).select(F.col("sk").alias("k"), F.concat_ws("|", "text", F.col("state").cast("string")).alias("v")))


def _batches(spark, d) -> DataFrame:
    """Ledger entries over all events: one checkpoint for each kind, whose digest is what its events add up to."""
    kinds = store.read(spark, d, "events").groupBy("event_type").agg(F.concat(F.sum(F.col("event_id")).cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string")).alias("digest"))
    numbered = kinds.withColumn("seq", F.array_position(F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")]), F.col("event_type")))
    return numbered.select("seq", F.lit("checkpoint").alias("op"), "digest")


_LEDGER_SQL = """
, e AS (SELECT row_number() OVER (ORDER BY event_type) AS seq, sum(event_id)||'/'||count(*) AS digest FROM events GROUP BY event_type)"""


@query(_LEDGER_SQL + """ SELECT 'whole' AS ledger, count(*) AS entries, bool_and(seq>0) AS gapless, true AS linked, arg_max(digest, seq)=(SELECT sum(event_id)||'/'||count(*) FROM events WHERE event_type='view') AS current FROM e
  UNION ALL SELECT 'stale', count(*), true, true, arg_max(digest, seq)='other' FROM e
  UNION ALL SELECT 'gap', count(*)-1, false, false, true FROM e
  UNION ALL SELECT 'changed', count(*), true, false, true FROM e""")
def audit_verify(spark, d):
    """A ledger over all events as it is, against another state, with an entry left out, and with a digest rewritten."""
    whole = audit.chain(_batches(spark, d))
    last = whole.filter("seq = 5").first()["digest"]
    cases = {"whole": (whole, last), "stale": (whole, "other"), "gap": (whole.filter("seq <> 3"), last), "changed": (whole.withColumn("digest", F.when(F.col("seq") == 2, "forged").otherwise(F.col("digest"))), last)}
    out = None
    for name, (ledger, digest) in cases.items():
        row = audit.verify(ledger, digest).select(F.lit(name).alias("ledger"), "entries", "gapless", "linked", "current")
        out = row if out is None else out.union(row)
    return out


@query("SELECT sk, CASE WHEN id%2=0 THEN state ELSE 0 END AS state, CASE WHEN id%2=0 THEN valid_from END AS valid_from FROM vec")
def rollback(spark, d):
    vec = store.vectors(spark, d)
    changed = vec.withColumn("state", F.lit(3)).withColumn("valid_from", F.lit(1).cast("long"))
    return audit.rollback(changed, audit.snapshot(vec.filter("id % 2 = 0"))).select("sk", "state", "valid_from")


@query("""
, r AS (SELECT row_number() OVER (ORDER BY score, sk) AS rank, text, dist FROM sem),
l AS (SELECT rank, '  #'||rank||') d='||printf('%.4f', dist)||' '||text AS line FROM r),
u AS (SELECT *, sum(strlen(line)+1) OVER (ORDER BY rank) AS used FROM l)
SELECT rank::INT AS rank, line FROM u WHERE used<=120""")
def rag_context(spark, d):
    from pyspark.sql import Window

    ranked = _sem(spark, d).withColumn("rank", F.row_number().over(Window.orderBy("score", "sk")))  # k rows
    return rag.context_lines(ranked, budget=120)


@query("""SELECT sk, anchors FROM (SELECT sk, text, dist, score, (CASE WHEN contains(text, '1') THEN 1 ELSE 0 END)+(CASE WHEN contains(text, 'label') THEN 1 ELSE 0 END) AS anchors FROM pool WHERE state=0 AND scope='')
   ORDER BY anchors DESC, score DESC, dist, sk LIMIT 10""")
def rag_context_reranked(spark, d):
    return rag.rerank(_pool(spark, d, 16 * K), ["1", "label"]).select("sk", "anchors").limit(K)


@query(f"""
, l AS (SELECT lex.sk, text, importance, greatest(0, least(1, 1-lex.score/(SELECT max(score) FROM lex))) AS dist FROM lex JOIN fact USING (sk) WHERE state=0 AND scope=''),
b AS (SELECT sk, text, floor(d*10000)/10000 AS dist, importance FROM (SELECT * FROM (SELECT * FROM ham ORDER BY ham, sk LIMIT 160) WHERE state=0 AND scope='' ORDER BY floor(d*10000), sk LIMIT 40) UNION ALL SELECT sk, text, dist, importance FROM l),
g AS (SELECT *, len(list_filter(['apache','license','label'], lambda t: list_contains(regexp_extract_all({_lower_sql("text")}, '[\\p{{L}}\\p{{N}}]+'), t)))::INT AS grounding FROM b)
SELECT sk, grounding FROM g ORDER BY grounding DESC, dist, importance DESC, sk LIMIT 10""")
def rerank_gate(spark, d):
    lex = lexical.recall_lexical(store.facts(spark, d), TERMS, 40)
    semantic = recall.recall(store.vectors(spark, d), _q(spark, d), 4 * K, oversample=4)
    return rag.rerank_gate(semantic, lex, ["apache", "license", "label"], K).select("sk", "grounding")


@query("""SELECT sk, sk||' d='||printf('%.4f', dist)||' '||text AS prose FROM sem""")
def render_hits(spark, d):
    return rag.render(_sem(spark, d)).select("sk", "prose")


@query("""
, x AS (SELECT sk, score, sum(length(text)) OVER (ORDER BY score DESC, sk) AS used FROM (SELECT lex.sk, lex.score, text FROM lex JOIN fact USING (sk) WHERE lex.score>=2 ORDER BY lex.score DESC, lex.sk LIMIT 8))
SELECT sk, round(score, 6) AS score FROM x WHERE used<=20000""")
def connector_recall(spark, d):
    best = lexical.search(store.facts(spark, d), TERMS, 40).join(store.facts(spark, d).select("sk", "text"), "sk")
    return rag.connector_policy(best, 8, 2, 20000).select("sk", F.round("score", 6).alias("score"))
