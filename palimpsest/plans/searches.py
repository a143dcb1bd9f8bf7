"""Vector search, full-text search, fusion and the hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import vectors as VF
from palimpsest.operators import fulltext as FT
from palimpsest.operators import retrieval as R
from palimpsest.operators import vector as V
from palimpsest.plans.base import NOW_SQL, now, query
from palimpsest.sources import tables as T
from palimpsest.storage import small, written

# searches of vectors take as queries every row whose id is divisible by 50, against all rows
_KNN = """SELECT q.id AS query_id, v.id AS id, round(list_distance(q.embedding, v.embedding), 6) AS distance, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.embedding, v.embedding), v.id) AS rank
 FROM (SELECT * FROM vectors WHERE id % 50 = 0) q, vectors v QUALIFY rank <= 10"""


def vector_queries(spark, d):
    return T.vectors(spark, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")


@query("v1_knn", _KNN)
def knn(spark, d):
    return V.knn(vector_queries(spark, d), T.vectors(spark, d), 10).withColumn("distance", F.round("distance", 6))


@query("v2_cosine", "SELECT q.id AS query_id, v.id AS id, round(greatest(0, list_cosine_similarity(q.embedding, v.embedding)), 6) AS cosine FROM (SELECT * FROM vectors WHERE id % 50 = 0) q, vectors v WHERE list_cosine_similarity(q.embedding, v.embedding) > 0.2")
def cosine(spark, d):
    return V.similar(vector_queries(spark, d), T.vectors(spark, d), 0.2).withColumn("cosine", F.round("cosine", 6))


@query("v5_new_vectors", """WITH near AS (SELECT i.id, b.id AS other, list_distance(i.embedding, b.embedding) AS d, i.label = b.label AS same FROM (SELECT * FROM near_vectors WHERE id >= 1000000) i, vectors b QUALIFY row_number() OVER (PARTITION BY i.id ORDER BY list_distance(i.embedding, b.embedding), b.id) <= 3),
 dup AS (SELECT id, arg_min(other, (d, other)) AS duplicate_of FROM near WHERE d < 0.06 AND same GROUP BY id) SELECT n.id, duplicate_of FROM near_vectors n LEFT JOIN dup USING (id) WHERE n.id >= 1000000""")
def new_vectors(spark, d):
    """The gate on insertion: incoming near copies that repeat a stored row."""
    kind = lambda df: df.select("id", F.col("label").alias("category"), "embedding")
    return V.new_vectors(kind(T.near_vectors(spark, d).where("id >= 1000000")), kind(T.vectors(spark, d)), 0.06)


@query("v6_truncate", "SELECT id, round(s[1] / sqrt(list_dot_product(s, s)), 6) AS first, round(s[16] / sqrt(list_dot_product(s, s)), 6) AS last FROM (SELECT id, embedding[1:16] AS s FROM vectors)")
def truncate(spark, d):
    short = T.vectors(spark, d).select("id", VF.truncate_unit(F.col("embedding"), 16).alias("s"))
    return short.select("id", F.round(F.element_at("s", 1), 6).alias("first"), F.round(F.element_at("s", 16), 6).alias("last"))


@query("j10_knn_self", "SELECT x.id AS a, y.id AS b, round(1 - list_distance(x.embedding, y.embedding) ** 2 / 2, 6) AS cosine FROM near_vectors x JOIN near_vectors y ON x.id < y.id WHERE 1 - list_distance(x.embedding, y.embedding) ** 2 / 2 > 0.95")
def knn_self(spark, d):
    return V.near_pairs(T.near_vectors(spark, d), 0.95).withColumn("cosine", F.round("cosine", 6))


@query("j14_nearest_label", f"SELECT id, CASE WHEN c >= 0.1 THEN label END AS label FROM (SELECT v.id, r.label, list_cosine_similarity(v.embedding, r.embedding) AS c FROM vectors v, (SELECT label, embedding FROM vectors QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) = 1) r QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY list_cosine_similarity(v.embedding, r.embedding) DESC, r.label) = 1)")
def nearest_label(spark, d):
    v = T.vectors(spark, d)
    reference = v.groupBy("label").agg(F.min_by("embedding", "id").alias("embedding"))
    return V.nearest_label(v, reference, 0.1).select("id", "label")


_TERMS = r"terms AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark)"
_BM25 = _TERMS + r""", tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
 size AS (SELECT doc_id AS id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS size FROM documents), stat AS (SELECT count(*) AS n, avg(size) AS avgdl FROM size),
 tf AS (SELECT id, term, count(*)::DOUBLE AS f FROM tok WHERE term IN (SELECT term FROM terms) GROUP BY ALL), nt AS (SELECT term, count(*) AS nt FROM tf GROUP BY term),
 scored AS (SELECT query_id, id, sum(greatest(1e-6, ln((n - nt + 0.5) / (nt + 0.5))) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * size / avgdl))) AS score FROM terms JOIN tf USING (term) JOIN nt USING (term) JOIN size USING (id), stat GROUP BY ALL)"""


def _terms(spark, d):
    """All words of all benchmark items."""
    return T.raw(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(FT.tokens(F.col("text"))).alias("term")).distinct()


def _item_vectors(spark, d):
    """The vector of the same id stands for an item's embedding."""
    items = T.raw(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return items.join(T.vectors(spark, d).select(F.col("id").alias("query_id"), "embedding"), "query_id")


@query("tx5_bm25", f"WITH {_BM25} SELECT query_id, id, round(score, 6) AS score FROM scored")
def bm25(spark, d):
    return FT.bm25(T.raw(spark, d, "documents"), _terms(spark, d), {"text": 1.0}, "doc_id").withColumn("score", F.round("score", 6))


@query("tx6_match_all", f"WITH {_BM25} SELECT query_id, id FROM (SELECT query_id, id, count(*) AS n FROM terms JOIN tf USING (term) GROUP BY ALL) JOIN (SELECT query_id, count(*) AS need FROM terms GROUP BY query_id) USING (query_id) WHERE n = need")
def match_all(spark, d):
    return FT.match_all(T.raw(spark, d, "documents"), _terms(spark, d), {"text": 1.0}, "doc_id")


@query("tx9_phrase", r"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ', ' of the ')")
def phrase(spark, d):
    return FT.match_phrase(T.raw(spark, d, "documents"), "of the", "text").select("doc_id")


@query("tx10_prefix", r"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM documents) WHERE starts_with(t, 'worth')")
def prefix(spark, d):
    return FT.match_prefix(T.raw(spark, d, "documents"), "worth", "text").select("doc_id")


@query("tx8_entity_tiers", "SELECT id, name, 2 AS tier FROM entities WHERE contains(lower(name), 'supplier') AND NOT EXISTS (SELECT 1 FROM entities WHERE list_contains(regexp_extract_all(lower(name), '[a-z0-9]+'), 'supplier')) UNION ALL SELECT id, name, 1 FROM entities WHERE list_contains(regexp_extract_all(lower(name), '[a-z0-9]+'), 'supplier') ORDER BY name, id LIMIT 20")
def entity_tiers(spark, d):
    return FT.tiered_name_search(T.entities(spark, d), "supplier", 20).select("id", "name", "tier")


def _signals(spark, d):
    near = V.knn(_item_vectors(spark, d), T.vectors(spark, d), 50).select("query_id", "id", "distance")
    near = written(near, "near")
    text = FT.bm25(T.raw(spark, d, "documents"), _terms(spark, d), {"text": 1.0}, "doc_id", most=50)
    words = R.ranked(text.withColumn("score", F.round("score", 6)), "bm25", [F.desc("score"), F.asc("id")], 50)
    vector = R.ranked(near.withColumn("distance", F.round("distance", 6)), "vector", [F.asc("distance"), F.asc("id")], 50)
    pool = written(vector.unionByName(words), "pool")
    made = T.memories(spark, d).select("id", "created_at")
    recent = R.ranked(pool.select("query_id", "id").distinct().join(made, "id"), "recency", [F.desc("created_at"), F.asc("id")])
    return pool.unionByName(recent), near


_FUSED = _BM25 + """, near AS (SELECT q.id AS query_id, v.id AS id, list_distance(q.embedding, v.embedding) AS distance FROM (SELECT * FROM vectors WHERE id IN (SELECT item_id FROM benchmark)) q, vectors v
   QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.embedding, v.embedding), v.id) <= 50),
 words AS (SELECT query_id, id, 60 AS k, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS r FROM scored QUALIFY r <= 50),
 vec AS (SELECT query_id, id, 60 AS k, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), id) AS r FROM near),
 pool AS (SELECT query_id, id FROM words UNION SELECT query_id, id FROM vec),
 rec AS (SELECT query_id, id, 20 AS k, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, id) AS r FROM pool JOIN memories USING (id)),
 fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (k + r)) AS rrf FROM (SELECT * FROM words UNION ALL SELECT * FROM vec UNION ALL SELECT * FROM rec) GROUP BY ALL)"""


@query("r1_fusion", f"WITH {_FUSED} SELECT query_id, id, round(rrf, 6) AS rrf FROM fused")
def fusion(spark, d):
    signals, _ = _signals(spark, d)
    return R.fuse(signals).withColumn("rrf", F.round("rrf", 6))


@query("so3_signal_overlap", f"WITH {_FUSED} SELECT w.query_id, count(*) AS shared FROM words w JOIN vec v USING (query_id, id) GROUP BY w.query_id")
def signal_overlap(spark, d):
    signals, _ = _signals(spark, d)
    both = signals.where("signal in ('vector', 'bm25')").groupBy("query_id", "id").agg(F.count("*").alias("n")).where("n = 2")
    return both.groupBy("query_id").agg(F.count("*").alias("shared"))


@query("t8_diversity")
def diversity(spark, d):
    signals, _ = _signals(spark, d)
    first = small(written(signals.where("signal = 'bm25'"), "first_texts"))  # texts stay where they are
    rows = T.raw(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")).join(first, "id")
    return R.diverse(rows, 0.8, 10)


@query("r9_decay", f"SELECT id, round(CASE WHEN category IN ('identity', 'family') THEN 1.0 ELSE power(0.5, greatest(0, epoch({NOW_SQL} - created_at) / 86400) / 30) END, 6) AS decay FROM memories")
def decay(spark, d):
    from palimpsest.functions import scalars as S

    aged = F.when(F.col("category").isin(*T.PROTECTED), 1.0).otherwise(S.decay(S.age_days(F.col("created_at"), now()), 30))
    return T.memories(spark, d).select("id", F.round(aged, 6).alias("decay"))
