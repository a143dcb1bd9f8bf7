"""The hybrid retrieval and its signals, over the graph of topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from palimpsest.functions import vectors as VF
from palimpsest.operators import fulltext as FT
from palimpsest.operators import retrieval as R
from palimpsest.plans.base import NOW_SQL, now, query
from palimpsest.plans.searches import _item_vectors
from palimpsest.sources import tables as T
from palimpsest.storage import written

_ENTITY_STOP = "string_split('the a an is of in on for and or to with what how why when where who does do did has have had was were be about from that this which would could should my his her its our your their me him it us them not no yes can will', ' ')"
_WORDS = r"(SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark)"
_LIVE = f"""gterms AS (SELECT DISTINCT * FROM {_WORDS} WHERE length(term) > 1 AND NOT list_contains({_ENTITY_STOP}, term)),
 sterms AS (SELECT * FROM gterms WHERE term NOT IN ('are', 'tell', 'describe', 'recently', 'currently')),
 ways AS (SELECT subject_id AS id, object_id AS other FROM topic_edges WHERE valid_to IS NULL UNION SELECT object_id, subject_id FROM topic_edges WHERE valid_to IS NULL),
 deg AS (SELECT id, count(*) AS degree FROM (SELECT subject_id AS id FROM topic_edges WHERE valid_to IS NULL UNION ALL SELECT object_id FROM topic_edges WHERE valid_to IS NULL) GROUP BY id)"""


def _matched(name: str, terms: str, most: int) -> str:
    return f"""{name} AS (SELECT query_id, id, name FROM (SELECT query_id, t.id, t.name, count(DISTINCT term) AS n FROM {terms} g JOIN topics t ON t.name = term OR length(term) >= 4 AND starts_with(t.name, term) GROUP BY 1, 2, 3)
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, name, id) <= {most})"""


def _related(name: str, direct: str, most: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, e.id, e.name, degree, links FROM (SELECT query_id, other AS id, count(DISTINCT d.id) AS links FROM {direct} d JOIN ways w ON w.id = d.id GROUP BY 1, 2) x JOIN topics e ON e.id = x.id JOIN deg ON deg.id = x.id
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY links DESC, e.name, e.id) <= {most}) r WHERE NOT EXISTS (SELECT 1 FROM {direct} d WHERE d.query_id = r.query_id AND d.name = r.name))"""


_NAMES = f"""{_LIVE}, {_matched("direct", "gterms", 10)}, {_related("nigh", "direct", 30)},
 middle AS (SELECT query_id, id, name FROM nigh WHERE query_id IN (SELECT query_id FROM nigh GROUP BY 1 HAVING count(*) FILTER (degree <= 50) < 3) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY name, id) <= 10),
 {_related("far", "middle", 20)},
 expanded AS (SELECT query_id, name FROM nigh WHERE degree <= 50 UNION SELECT query_id, name FROM far WHERE degree <= 50 AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.query_id = far.query_id AND d.name = far.name)),
 names AS (SELECT query_id, lower(name) AS name, min(kind) AS kind FROM (SELECT query_id, name, 'direct' AS kind FROM direct UNION ALL SELECT query_id, name, 'expanded' FROM expanded UNION ALL SELECT query_id, name, 'hub' FROM nigh WHERE degree > 50 AND links >= 2) GROUP BY 1, 2)"""
_GRAPH = _NAMES + r""", mem AS (SELECT id, created_at, importance, lower(coalesce(subject, '')) AS about, lower(coalesce(content, '') || ' ' || coalesce(subject, '')) AS txt, regexp_extract_all(lower(concat_ws(' ', content, category, subject)), '[\p{L}\p{N}]+') AS ws FROM memories WHERE superseded_by IS NULL),
 held AS (SELECT DISTINCT m.id, m.created_at, n.name FROM (SELECT DISTINCT name FROM names) n JOIN (SELECT id, created_at, unnest(ws) AS w FROM mem) m ON m.w = n.name),
 probed AS (SELECT a.*, (c.id IS NOT NULL)::INTEGER AS context FROM (SELECT * FROM held JOIN names USING (name)) a JOIN (SELECT query_id, bool_or(kind = 'expanded') AS ex FROM names GROUP BY 1) x USING (query_id)
  LEFT JOIN (SELECT DISTINCT query_id, id FROM held JOIN names USING (name) WHERE kind = 'direct') c ON c.query_id = a.query_id AND c.id = a.id WHERE a.kind = CASE WHEN ex THEN 'expanded' ELSE 'direct' END),
 five AS (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY created_at DESC, id) AS n FROM (SELECT * FROM probed QUALIFY context = max(context) OVER (PARTITION BY query_id, name)) QUALIFY n <= 5),
 firsts AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY name, n, id) AS place FROM (SELECT * FROM five QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY name, n) = 1) QUALIFY place <= 50),
 graph AS (SELECT query_id, f.id, CASE count(*) FILTER (contains(m.txt, n.name)) WHEN 0 THEN 0.4 WHEN 1 THEN 0.6 WHEN 2 THEN 0.8 ELSE 1.0 END::DOUBLE AS graph, place FROM firsts f JOIN mem m ON m.id = f.id JOIN names n USING (query_id) GROUP BY query_id, f.id, place),
 meant AS (SELECT DISTINCT query_id, about FROM (SELECT DISTINCT about FROM mem WHERE about <> '') JOIN names ON contains(about, name)),
 filled AS (SELECT query_id, id, 0.8::DOUBLE AS graph, 50 + n AS place FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY importance DESC, created_at DESC, id) AS n FROM meant JOIN mem USING (about)) x LEFT JOIN (SELECT query_id, count(*) AS taken FROM graph GROUP BY 1) y USING (query_id)
  WHERE n <= 50 - coalesce(taken, 0) AND NOT EXISTS (SELECT 1 FROM graph g WHERE g.query_id = x.query_id AND g.id = x.id)),
 linked AS (SELECT * FROM graph UNION ALL SELECT * FROM filled)"""


def _entity_terms(spark, d, stop=S.ENTITY_STOP):
    items = T.raw(spark, d, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), F.explode(S.query_terms(F.lower("text"), stop)).alias("term")).distinct()


@query("r17_graph_names", f"WITH {_NAMES} SELECT query_id, name, kind FROM names")
def graph_names(spark, d):
    return R.graph_names(_entity_terms(spark, d), T.topics(spark, d), T.topic_edges(spark, d))


@query("r16_graph_signal", f"WITH {_GRAPH} SELECT query_id, id, graph, place FROM linked")
def graph_signal(spark, d):
    return R.graph_signal(_entity_terms(spark, d), T.topics(spark, d), T.topic_edges(spark, d), T.memories(spark, d))


_EXPANDED = f"{_matched('five_named', 'sterms', 5)}, {_related('ten', 'five_named', 10)}, xterms AS (SELECT query_id, term FROM sterms UNION SELECT query_id, name FROM ten)"


@query("tx4_expanded_terms", f"WITH {_LIVE}, {_EXPANDED} SELECT query_id, term FROM xterms")
def expanded_terms(spark, d):
    return R.expanded_terms(_entity_terms(spark, d, S.STOP), T.topics(spark, d), T.topic_edges(spark, d))


_AGED = f"CASE WHEN category IN ('identity', 'family') THEN 1.0 ELSE power(0.5, greatest(0, epoch({NOW_SQL} - created_at) / 86400) / 90) END"
_UTILITY = "ln(2 + CASE WHEN surfacing_count > 0 THEN access_count / surfacing_count ELSE least(access_count, 5) END)"
_BONUS = "CASE WHEN access_count <= 0 THEN 0 ELSE least(0.01 * ln(1 + access_count) * least(access_count / greatest(surfacing_count, 1), 2), 0.04) END"
_SIGNALS = _GRAPH + f", {_EXPANDED}" + r""", toks AS (SELECT id, superseded_by, regexp_extract_all(lower(coalesce(content, '')), '[\p{L}\p{N}]+') AS c, regexp_extract_all(lower(coalesce(category, '')), '[\p{L}\p{N}]+') AS g, regexp_extract_all(lower(coalesce(subject, '')), '[\p{L}\p{N}]+') AS s FROM memories),
 sizes AS (SELECT id, superseded_by, len(c) + len(g) + len(s) AS size FROM toks), stat AS (SELECT count(*) AS n, avg(size) AS avgdl FROM sizes),
 tf AS (SELECT id, term, sum(w) AS f FROM (SELECT id, unnest(c) AS term, 10.0::DOUBLE AS w FROM toks UNION ALL SELECT id, unnest(g), 1.0 FROM toks UNION ALL SELECT id, unnest(s), 5.0 FROM toks) WHERE term IN (SELECT term FROM xterms) GROUP BY ALL),
 nt AS (SELECT term, count(*) AS nt FROM tf GROUP BY term),
 scored AS (SELECT query_id, id, round(sum(greatest(1e-6, ln((n - nt + 0.5) / (nt + 0.5))) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * size / avgdl))), 6) AS score FROM xterms JOIN tf USING (term) JOIN nt USING (term) JOIN sizes USING (id), stat WHERE superseded_by IS NULL GROUP BY ALL),
 words AS (SELECT query_id, id, score, 60 AS k, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scored QUALIFY r <= 50),
 nearest AS (SELECT q.id AS query_id, v.id AS id, round(list_distance(q.embedding, v.embedding), 6) AS distance FROM (SELECT * FROM vectors WHERE id IN (SELECT item_id FROM benchmark)) q, (SELECT v.* FROM vectors v JOIN memories m ON m.id = v.id WHERE superseded_by IS NULL) v
   QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.embedding, v.embedding), v.id) <= 50),
 vec AS (SELECT query_id, id, 60 AS k, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM nearest),
 asked AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id IN (SELECT id FROM vectors)),
 gra AS (SELECT query_id, id, 30 AS k, row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS r FROM linked),
 pool AS (SELECT query_id, id, created_at FROM (SELECT query_id, id FROM words UNION SELECT query_id, id FROM vec UNION SELECT query_id, id FROM gra) JOIN memories USING (id)),
 rec AS (SELECT query_id, id, 20 AS k, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, id) AS r FROM pool),
 fre AS (SELECT query_id, id, 15 AS k, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, id) AS r FROM nearest JOIN words USING (query_id, id) JOIN memories USING (id) JOIN asked USING (query_id)
  WHERE regexp_matches(text, '(?i)\b(?:currently|current|now|latest|recent|recently|today|right now|at the moment)\b') OR regexp_matches(text, '(?i)\bhow\s+(?:often|frequently)\s+does\b')
   OR regexp_matches(text, '(?i)\bwhat\s+(?:[\p{L}\p{N}_]+\s+){1,4}does\s+[\p{L}\p{N}_]+.*?\s+(?:use|run|have|produce|output|generate|store|serve|route|send)\b')),
 fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (k + r)) AS rrf FROM (SELECT query_id, id, k, r FROM words UNION ALL SELECT * FROM vec UNION ALL SELECT * FROM gra UNION ALL SELECT * FROM rec UNION ALL SELECT * FROM fre) GROUP BY ALL)"""
_RETRIEVED = _SIGNALS + f""", rows AS (SELECT f.query_id, f.id, rrf, distance, round(CASE WHEN distance IS NOT NULL THEN (1 - distance) * ((0.7 - 0.6 * alpha) + (0.3 + 0.6 * alpha) * {_AGED}) + 0.03 * coalesce(nullif(importance, 0), 0.5) * {_UTILITY}
   + 0.03 * coalesce(w.score / top, 0) + CASE WHEN alpha < 0.5 THEN 0.08 ELSE 0.03 END * coalesce(l.graph, 0) + {_BONUS} ELSE coalesce(nullif(importance, 0), 0.5) * {_AGED} * {_UTILITY} * 1e-4 + {_BONUS} END, 9) AS score, category, origin
  FROM fused f JOIN memories m ON m.id = f.id JOIN (SELECT query_id, CASE WHEN regexp_matches(text, '(?i)\\b(?:currently|current|now|latest|recent|recently|today|right now|at the moment)\\b') THEN 1.0 ELSE 0.0 END::DOUBLE AS alpha FROM asked) a ON a.query_id = f.query_id
  LEFT JOIN nearest n ON n.query_id = f.query_id AND n.id = f.id LEFT JOIN words w ON w.query_id = f.query_id AND w.id = f.id LEFT JOIN (SELECT query_id, max(score) AS top FROM words GROUP BY 1) t ON t.query_id = f.query_id LEFT JOIN linked l ON l.query_id = f.query_id AND l.id = f.id)"""
_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY distance IS NOT NULL DESC, score DESC, round(rrf, 9) DESC, id) AS rank"


def _retrieve(spark, d, search=R.retrieve, **options):
    return search(_item_vectors(spark, d), T.memories(spark, d), T.vectors(spark, d), T.topics(spark, d), T.topic_edges(spark, d), now(), R.Options(**options))


@query("r18_retrieve", f"WITH {_RETRIEVED} SELECT query_id, rank, id, round(1 - distance * distance / 2, 4) AS relevance, round(score, 6) AS score FROM (SELECT *, {_TOP} FROM rows QUALIFY rank <= 5)")
def retrieve(spark, d):
    return _retrieve(spark, d).select("query_id", "rank", "id", "relevance", F.round("score", 6).alias("score"))


@query("fp3_post_filter", f"WITH {_RETRIEVED} SELECT query_id, rank, id FROM (SELECT *, {_TOP} FROM rows WHERE category = 'project' AND origin = 'chat' QUALIFY rank <= 5)")
def post_filter(spark, d):
    """Category and origin are filtered after the fusion."""
    return _retrieve(spark, d, category="project", origin="chat").select("query_id", "rank", "id")


@query("fp4_min_relevance", f"WITH {_RETRIEVED} SELECT query_id, rank, id FROM (SELECT *, {_TOP} FROM rows WHERE coalesce(round(1 - distance * distance / 2, 4), 1) >= 0.2 QUALIFY rank <= 5)")
def min_relevance(spark, d):
    return _retrieve(spark, d, min_relevance=0.2).select("query_id", "rank", "id")


@query("x3_vector_only", "SELECT q.id AS query_id, v.id AS id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_distance(q.embedding, v.embedding), 6), v.id) AS place FROM (SELECT * FROM vectors WHERE id IN (SELECT item_id FROM benchmark)) q, (SELECT v.* FROM vectors v JOIN memories m ON m.id = v.id WHERE superseded_by IS NULL) v QUALIFY place <= 5")
def vector_only(spark, d):
    """Ablation: a sole signal keeps its own order in the fusion, whatever the rows' scores."""
    found = _retrieve(spark, d, R.candidates, signals=("vector",), limit=50)
    return R.best(found, [F.desc("rrf"), F.asc("id")], 5).select("query_id", "id", F.col("rank").alias("place"))


@query("w3_max_normalised", f"WITH {_SIGNALS} SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS bm25 FROM words")
def max_normalised(spark, d):
    asked = R.expanded_terms(_entity_terms(spark, d, S.STOP), T.topics(spark, d), T.topic_edges(spark, d))
    found = FT.bm25(T.memories(spark, d), written(asked, "asked_terms"), {"content": 10.0, "category": 1.0, "subject": 5.0}, active="superseded_by is null", most=50)
    top = written(R.best(found.withColumn("score", F.round("score", 6)), [F.desc("score"), F.asc("id")], 50), "best_text")
    most = top.groupBy("query_id").agg(F.max("score").alias("most"))
    return top.join(most, "query_id").select("query_id", "id", F.round(F.col("score") / F.col("most"), 6).alias("bm25"))


@query("v4_relevance", "SELECT q.id AS query_id, v.id AS id, round(1 - list_distance(q.embedding, v.embedding) ** 2 / 2, 4) AS relevance FROM (SELECT * FROM vectors WHERE id % 50 = 0) q, vectors v QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.embedding, v.embedding), v.id) <= 10")
def relevance(spark, d):
    from palimpsest.operators import vector as V
    from palimpsest.plans.searches import vector_queries

    return V.knn(vector_queries(spark, d), T.vectors(spark, d), 10).select("query_id", "id", F.round(VF.relevance(F.col("distance")), 4).alias("relevance"))
