"""Writes as set operations, maintenance, outcomes and the ranker's features."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from palimpsest.operators import lifecycle as L
from palimpsest.operators import vector as V
from palimpsest.plans.base import NOW_SQL, now, query
from palimpsest.sources import tables as T

# pairs closer than 0.95, among the vectors and their near copies
_PAIRS = "pair AS (SELECT x.id AS a, y.id AS b FROM near_vectors x JOIN near_vectors y ON x.id <> y.id WHERE 1 - list_distance(x.embedding, y.embedding) ** 2 / 2 > 0.95)"


@query("g8_duplicate_clusters", f"WITH RECURSIVE {_PAIRS}, reach AS (SELECT a AS id, a AS label FROM pair UNION SELECT b, label FROM reach JOIN pair ON a = id) SELECT id, min(label) AS label FROM reach GROUP BY id")
def duplicate_clusters(spark, d):
    return L.components(V.near_pairs(T.near_vectors(spark, d), 0.95).select("a", "b"))


# memories for the near copies too: each has the text of its original
_COPIES = """copies AS (SELECT v.id, content, category, subject, confidence, created_at, CASE WHEN v.id = m.id THEN access_count ELSE access_count + v.id % 11 END AS access_count, importance, superseded_by FROM near_vectors v JOIN memories m ON m.id = v.id % 1000000)"""


def _copies(spark, d):
    ids = T.near_vectors(spark, d).select("id", (F.col("id") % 1_000_000).alias("origin_id"))
    m = T.memories(spark, d).withColumnRenamed("id", "origin_id")
    joined = ids.join(m, "origin_id")
    more = F.when(F.col("id") == F.col("origin_id"), F.col("access_count")).otherwise(F.col("access_count") + F.col("id") % 11)
    return joined.withColumn("access_count", more).select("id", *(c for c in m.columns if c != "origin_id"))


_MERGED = f"""{_PAIRS}, {_COPIES}, allowed AS (SELECT a, b FROM pair JOIN copies x ON x.id = a JOIN copies y ON y.id = b WHERE x.superseded_by IS NULL AND y.superseded_by IS NULL AND x.category <> 'identity' AND y.category <> 'identity'),
 reach AS (SELECT a AS id, a AS label FROM allowed UNION SELECT b, label FROM reach JOIN allowed ON a = id), labelled AS (SELECT id, min(label) AS label FROM reach GROUP BY id),
 merged AS (SELECT l.id, first_value(l.id) OVER (PARTITION BY label ORDER BY length(content) DESC, importance DESC, created_at DESC, l.id) AS keeper, max(access_count) OVER (PARTITION BY label) AS access_count FROM labelled l JOIN copies c ON c.id = l.id)"""


@query("g8_merge_duplicates", f"WITH RECURSIVE {_MERGED} SELECT id, keeper, access_count FROM merged")
def merge_duplicates(spark, d):
    return L.merge_duplicates(_copies(spark, d), V.near_pairs(T.near_vectors(spark, d), 0.95))


@query("ag11_superseded_copies", f"WITH RECURSIVE {_MERGED} SELECT c.id, CASE WHEN m.keeper <> c.id THEN m.keeper ELSE c.superseded_by END AS superseded_by, CASE WHEN m.keeper = c.id THEN m.access_count ELSE c.access_count END AS access_count FROM copies c LEFT JOIN merged m ON m.id = c.id")
def superseded_copies(spark, d):
    """The memories after the merge: duplicates superseded, keepers with the greatest access count of their group."""
    rows = _copies(spark, d)
    merged = L.merge_duplicates(rows, V.near_pairs(T.near_vectors(spark, d), 0.95))
    return L.supersede_duplicates(rows, merged).select("id", "superseded_by", "access_count")


_NORMAL = r"regexp_replace(replace(regexp_replace(replace(lower(trim(name)), '-', '_'), '\s*\([^)]*\)\s*$', ''), ' ', '_'), '_(service|server|app|api|project|system|tool|library)$', '')"
_DOUBLES = f"""everyone AS (SELECT id, name, entity_type FROM entities UNION ALL SELECT id || ':copy', upper(name) || ' App', entity_type FROM entities WHERE n % 4 = 0),
 normal AS (SELECT e.*, CASE WHEN length(c) > 4 AND ends_with(c, 's') AND NOT ends_with(c, 'ss') THEN left(c, length(c) - 1) ELSE c END AS nn, coalesce(degree, 0) AS degree FROM (SELECT *, {_NORMAL} AS c FROM everyone) e
  LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT subject_id AS id FROM relationships UNION ALL SELECT object_id FROM relationships) GROUP BY id) g USING (id)),
 doubles AS (SELECT id AS dup_id, first_value(id) OVER (PARTITION BY entity_type, nn ORDER BY degree DESC, length(name), id) AS keeper_id FROM normal)"""


def _everyone(spark, d):
    """All entities, and copies of every fourth under another spelling."""
    e = T.entities(spark, d)
    copies = e.where("n % 4 = 0").select(F.concat("id", F.lit(":copy")).alias("id"), F.concat(F.upper("name"), F.lit(" App")).alias("name"), "entity_type")
    return e.select("id", "name", "entity_type").union(copies)


@query("g10_entity_groups", f"WITH {_DOUBLES} SELECT dup_id, keeper_id FROM doubles WHERE dup_id <> keeper_id")
def entity_groups(spark, d):
    return L.entity_groups(_everyone(spark, d), T.relationships(spark, d))


@query("sk10_merge_entities", f"""WITH {_DOUBLES}, moved AS (SELECT coalesce(s.keeper_id, r.subject_id) AS subject_id, predicate, coalesce(o.keeper_id, r.object_id) AS object_id, valid_from, valid_to, confidence
 FROM (SELECT * FROM relationships UNION ALL SELECT subject_id || ':copy', predicate, object_id, valid_from, valid_to, confidence FROM relationships WHERE predicate = 'lives_in') r LEFT JOIN doubles s ON s.dup_id = r.subject_id LEFT JOIN doubles o ON o.dup_id = r.object_id)
 SELECT subject_id, predicate, object_id, confidence FROM moved WHERE subject_id <> object_id QUALIFY row_number() OVER (PARTITION BY subject_id, predicate, object_id ORDER BY confidence DESC, valid_from, valid_to NULLS LAST) = 1""")
def merge_entities(spark, d):
    """Edges of copies move to their keepers; loops and repeats go."""
    from palimpsest.operators import graph as G

    edges = T.relationships(spark, d)
    copies = edges.where("predicate = 'lives_in'").withColumn("subject_id", F.concat("subject_id", F.lit(":copy")))
    mapping = L.entity_groups(_everyone(spark, d), edges)
    return G.merge_entities(edges.unionByName(copies), mapping).select("subject_id", "predicate", "object_id", "confidence")


@query("g13_prune", f"SELECT id, date_diff('day', created_at::DATE, {NOW_SQL}::DATE)::INTEGER AS age_days FROM memories WHERE confidence < 0.6 AND created_at < {NOW_SQL} - INTERVAL 14 DAY AND category NOT IN ('identity', 'family')")
def prune(spark, d):
    return L.prune(T.memories(spark, d), now(), 14, 0.6, T.PROTECTED).select("id", "age_days")


@query("g18_stale_facts", "SELECT subject_id, object_id, valid_from, round(confidence * power(0.5, epoch(TIMESTAMP '1999-01-01' - valid_from) / 86400 / 365), 6) AS effective FROM relationships WHERE predicate = 'supplies' AND valid_to IS NULL AND valid_from < TIMESTAMP '1998-12-01' AND confidence * power(0.5, epoch(TIMESTAMP '1999-01-01' - valid_from) / 86400 / 365) < 0.3")
def stale_facts(spark, d):
    at = F.expr("TIMESTAMP '1999-01-01'")
    edges = T.relationships(spark, d).where("predicate = 'supplies' and valid_to is null and valid_from < TIMESTAMP '1998-12-01'")
    effective = S.effective_confidence(F.col("confidence"), F.col("valid_from"), at, 365)
    return edges.withColumn("effective", effective).where("effective < 0.3").select("subject_id", "object_id", "valid_from", F.round("effective", 6).alias("effective"))


@query("sk1_store_new", "SELECT id, category FROM memories WHERE id % 2 = 0 UNION ALL SELECT id + 1000000, category FROM (SELECT min(id) AS id, content, any_value(category) AS category FROM memories WHERE id % 2 = 1 GROUP BY content, category) n WHERE NOT EXISTS (SELECT 1 FROM memories m WHERE m.id % 2 = 0 AND m.content = n.content AND m.category = n.category)")
def store_new(spark, d):
    m = T.memories(spark, d)
    incoming = m.where("id % 2 = 1").withColumn("id", F.col("id") + 1_000_000)
    return L.insert_new(m.where("id % 2 = 0"), incoming, ["content", "category"]).select("id", "category")


@query("sk2_supersede", "SELECT id, CASE WHEN id % 50 = 3 THEN id + 1000000 ELSE superseded_by END AS superseded_by, category FROM memories UNION ALL SELECT id + 1000000, NULL, category FROM memories WHERE id % 50 = 3")
def supersede(spark, d):
    m = T.memories(spark, d)
    changes = m.where("id % 50 = 3").select(F.col("id").alias("old_id"), (F.col("id") + 1_000_000).alias("new_id"), F.lit("new").alias("content"))
    return L.supersede(m, changes).select("id", "superseded_by", "category")


@query("sk3_delete", "SELECT id FROM memories WHERE id % 10 <> 4 OR category IN ('identity', 'family')")
def delete(spark, d):
    m = T.memories(spark, d)
    return L.delete(m, m.where("id % 10 = 4"), T.PROTECTED).select("id")


@query("sk7_upsert_edges", """WITH e AS (SELECT * FROM relationships), inc AS (SELECT subject_id, predicate, object_id, max(0.95::DOUBLE) AS c, min(valid_from) AS f FROM e WHERE predicate = 'located_in' GROUP BY ALL)
 SELECT coalesce(e.subject_id, i.subject_id) AS subject_id, coalesce(e.object_id, i.object_id) AS object_id, valid_to, greatest(e.confidence, i.c) AS confidence FROM (SELECT * FROM e WHERE valid_to IS NULL) e FULL JOIN inc i ON e.subject_id = i.subject_id AND e.predicate = i.predicate AND e.object_id = i.object_id
 UNION ALL SELECT subject_id, object_id, valid_to, confidence FROM e WHERE valid_to IS NOT NULL""")
def upsert_edges(spark, d):
    edges = T.relationships(spark, d)
    incoming = edges.where("predicate = 'located_in'").withColumn("confidence", F.lit(0.95))
    return L.upsert_edges(edges, incoming).select("subject_id", "object_id", "valid_to", "confidence")


@query("sk11_access_counts", "SELECT user_id, event_type, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id, event_type")
def access_counts(spark, d):
    return T.raw(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


_LOGS = "logs AS (SELECT event_id AS log_id, user_id, ts FROM events WHERE event_type = 'view'), hits AS (SELECT user_id, ts FROM events WHERE event_type IN ('click', 'purchase'))"


@query("l4_label_outcomes", f"WITH {_LOGS} SELECT log_id, CASE WHEN epoch(max(h.ts) - any_value(l.ts)) <= 1800 THEN 1.0 WHEN epoch(max(h.ts) - any_value(l.ts)) <= 7200 THEN 0.5 ELSE 0.0 END::DOUBLE AS outcome FROM logs l LEFT JOIN hits h ON h.user_id = l.user_id AND h.ts > l.ts AND h.ts <= l.ts + INTERVAL 120 MINUTE GROUP BY log_id")
def label_outcomes(spark, d):
    e = T.raw(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    logs = e.where("event_type = 'view'").select(F.col("event_id").alias("log_id"), F.col("user_id").alias("key"), F.col("ts").alias("at"))
    hits = e.where("event_type in ('click', 'purchase')").select(F.col("user_id").alias("access_key"), F.col("ts").alias("access_at"))
    return L.label_outcomes(logs, hits)


@query("l5_ips_weights", "SELECT id, CASE WHEN surfacing_count >= 10 THEN least(100.0::DOUBLE / surfacing_count, 50) ELSE 1.0 END::DOUBLE AS weight FROM memories")
def ips_weights(spark, d):
    weight = F.when(F.col("surfacing_count") >= 10, F.least(F.lit(100.0) / F.col("surfacing_count"), F.lit(50.0))).otherwise(1.0)
    return T.memories(spark, d).select("id", weight.alias("weight"))


@query("r8_static_scores", f"""SELECT id, round(coalesce(nullif(importance, 0), 0.5) * CASE WHEN category IN ('identity', 'family') THEN 1.0 ELSE power(0.5, greatest(0, epoch({NOW_SQL} - created_at) / 86400) / 90) END
   * ln(2 + CASE WHEN surfacing_count > 0 THEN access_count / surfacing_count ELSE least(access_count, 5) END) * 1e-4
   + CASE WHEN access_count <= 0 THEN 0 ELSE least(0.01 * ln(1 + access_count) * least(access_count / greatest(surfacing_count, 1), 2), 0.04) END, 6) AS score FROM memories""")
def static_scores(spark, d):
    from palimpsest.operators.retrieval import importance_score

    m = T.memories(spark, d).withColumn("distance", F.lit(None).cast("double")).withColumn("bm25", F.lit(0.0)).withColumn("graph", F.lit(0.0))
    _, score = importance_score(now(), F.lit(0.0))
    return m.select("id", F.round(score, 6).alias("score"))


# stars of near rows with one label: in a group of copies every two are near, so the least id is the center of all
_STARS = f"""RECURSIVE {_PAIRS}, own AS (SELECT a, b, v.label FROM pair JOIN near_vectors v ON v.id = a JOIN near_vectors w ON w.id = b WHERE v.label = w.label),
 nigh AS (SELECT a, count(*) + 1 AS n, least(a, min(b)) AS center FROM own GROUP BY a), stars AS (SELECT a AS id, center FROM nigh WHERE n >= 3)"""


def _stars(spark, d):
    return L.consolidate(T.near_vectors(spark, d).select("id", F.col("label").cast("string").alias("subject"), "embedding"), 0.95)


@query("g11_consolidate", f"WITH {_STARS} SELECT v.label::VARCHAR AS subject, center, s.id FROM stars s JOIN near_vectors v ON v.id = s.id")
def consolidate(spark, d):
    return _stars(spark, d)


@query("g12_summaries", f"WITH {_STARS} SELECT center, trim(any_value(content)) AS summary FROM stars s JOIN memories m ON m.id = s.id % 1000000 WHERE trim(content) <> '' GROUP BY center")
def summaries(spark, d):
    """One text of each group, that of its least id; in a group of copies all are alike."""
    texts = _copies(spark, d).select("id", F.trim("content").alias("t")).where("t <> ''")
    return _stars(spark, d).join(texts, "id").groupBy("center").agg(F.min_by("t", "id").alias("summary"))


@query("g14_hygiene", f"""WITH RECURSIVE {_MERGED}, {_DOUBLES}, rest AS (SELECT c.* FROM copies c LEFT JOIN merged m ON m.id = c.id WHERE c.superseded_by IS NULL AND coalesce(m.keeper, c.id) = c.id),
 pruned AS (SELECT id FROM rest WHERE confidence < 0.6 AND created_at < {NOW_SQL} - INTERVAL 14 DAY AND category NOT IN ('identity', 'family')),
 open_rows AS (SELECT id, lower(subject) AS subject FROM rest WHERE id NOT IN (SELECT id FROM pruned) AND category NOT IN ('identity', 'family')),
 star AS (SELECT a, count(*) AS n FROM pair JOIN open_rows x ON x.id = a JOIN open_rows y ON y.id = b WHERE x.subject = y.subject GROUP BY a)
 SELECT 'merged' AS step, count(*) AS n FROM merged WHERE id <> keeper UNION ALL SELECT 'pruned', count(*) FROM pruned UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT subject_id, predicate, object_id FROM relationships)
 UNION ALL SELECT 'entities', count(*) FROM doubles WHERE dup_id <> keeper_id UNION ALL SELECT 'consolidated', count(*) FROM star WHERE n >= 2""")
def hygiene(spark, d):
    """All five steps over the memories with their near copies."""
    steps = L.hygiene(_copies(spark, d), T.relationships(spark, d), _everyone(spark, d), T.near_vectors(spark, d), now(), 14, 0.6, T.PROTECTED, like=0.95)
    out = None
    for name, rows in steps.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n")
        out = part if out is None else out.unionByName(part)
    return out
