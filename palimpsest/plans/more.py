"""Further queries: sessions, tiers, gates, extraction rules, the ranker and history writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from palimpsest.operators import chunking as C
from palimpsest.operators import graph as G
from palimpsest.operators import lifecycle as L
from palimpsest.operators import ranker as K
from palimpsest.operators import retrieval as R
from palimpsest.plans.base import NOW_SQL, now, query
from palimpsest.plans.searches import _FUSED, _signals
from palimpsest.sources import tables as T


@query("r5_sufficiency_gate", f"WITH {_FUSED} SELECT v.query_id, max(n.distance) <= 1.3 AND count(w.id) >= 1 AS sufficient FROM vec v JOIN near n USING (query_id, id) LEFT JOIN words w USING (query_id, id) WHERE v.r <= 5 GROUP BY v.query_id")
def sufficiency_gate(spark, d):
    signals, near = _signals(spark, d)
    words = signals.where("signal = 'bm25'").select("query_id", "id", F.lit(1).alias("hit"))
    top = signals.where("signal = 'vector' and rank < 5").join(near, ["query_id", "id"]).join(words, ["query_id", "id"], "left")
    return top.groupBy("query_id").agg(((F.max("distance") <= 1.3) & (F.count("hit") >= 1)).alias("sufficient"))


@query("r4_freshness", f"WITH {_FUSED} SELECT w.query_id, w.id, round(CASE WHEN max(distance) OVER q > min(distance) OVER q THEN 1 - (distance - min(distance) OVER q) / (max(distance) OVER q - min(distance) OVER q) ELSE 0 END, 6) AS freshness FROM words w JOIN near n USING (query_id, id) WINDOW q AS (PARTITION BY w.query_id)")
def freshness(spark, d):
    signals, near = _signals(spark, d)
    both = signals.where("signal = 'bm25'").join(near, ["query_id", "id"]).select("query_id", "id", "distance")
    return both.select("query_id", "id", F.round(1.0 - R.minmax("distance"), 6).alias("freshness"))


@query("t7_tiered_context", f"""WITH {_FUSED}, parts AS (SELECT query_id, id, 0 AS tier, row_number() OVER (PARTITION BY query_id ORDER BY id) AS r FROM (SELECT DISTINCT query_id FROM vec), memories WHERE category = 'identity' AND superseded_by IS NULL QUALIFY r <= 3
  UNION ALL SELECT query_id, id, 1, r FROM words WHERE r <= 3 UNION ALL SELECT query_id, id, 2, r FROM vec WHERE r <= 10),
 firsts AS (SELECT query_id, id, min(tier) AS tier, arg_min(r, (tier, r)) AS r FROM parts GROUP BY query_id, id)
 SELECT query_id, id, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier, r, id) AS place FROM firsts QUALIFY place <= 8""")
def tiered_context(spark, d):
    signals, _ = _signals(spark, d)
    queries = signals.where("signal = 'vector'").select("query_id").distinct()
    core = T.memories(spark, d).where("category = 'identity' and superseded_by is null").orderBy("id").limit(3).select("id", (F.row_number().over(Window.orderBy("id"))).alias("tier_rank"))
    ranks = lambda name, most: signals.where(F.col("signal") == name).select("query_id", "id", (F.col("rank") + 1).alias("tier_rank")).where(F.col("tier_rank") <= most)
    return R.tiered([queries.crossJoin(F.broadcast(core)).select("query_id", "id", "tier_rank"), ranks("bm25", 3), ranks("vector", 10)], 8).select("query_id", "id", "tier", "place")


@query("sk17_keep_newest_snapshots", "SELECT run_id, started_at FROM runs QUALIFY row_number() OVER (PARTITION BY split_part(run_id, ':', 1) ORDER BY started_at DESC) <= 3")
def keep_newest_snapshots(spark, d):
    w = Window.partitionBy(F.split("run_id", ":")[0]).orderBy(F.desc("started_at"))
    return T.runs(spark, d).select("run_id", "started_at", F.row_number().over(w).alias("n")).where("n <= 3").drop("n")


@query("g15_orphans_by_type", "SELECT entity_type, count(*) AS n FROM entities e WHERE NOT EXISTS (SELECT 1 FROM relationships r WHERE r.subject_id = e.id OR r.object_id = e.id) GROUP BY entity_type")
def orphans_by_type(spark, d):
    return G.orphans(T.entities(spark, d), T.relationships(spark, d)).groupBy("entity_type").agg(F.count("*").alias("n"))


@query("g19_entity_state", "SELECT subject_id, round(avg(confidence * CASE WHEN valid_from > TIMESTAMP '1999-01-01' THEN 1.0 ELSE power(0.5, epoch(TIMESTAMP '1999-01-01' - valid_from) / 86400 / 365) END), 6) AS state, min(date_diff('day', valid_from::DATE, DATE '1999-01-01'))::INTEGER AS staleness FROM relationships WHERE predicate = 'supplies' GROUP BY subject_id")
def entity_state(spark, d):
    at = F.expr("TIMESTAMP '1999-01-01'")
    edges = T.relationships(spark, d).where("predicate = 'supplies'")
    return edges.groupBy("subject_id").agg(F.round(F.avg(S.effective_confidence(F.col("confidence"), F.col("valid_from"), at, 365)), 6).alias("state"), F.min(F.date_diff(at, "valid_from")).alias("staleness"))


@query("l6_self_normalised", "SELECT id, round(w * count(*) OVER p / sum(w) OVER p, 6) AS weight FROM (SELECT id, category, CASE WHEN surfacing_count >= 10 THEN least(100.0::DOUBLE / surfacing_count, 50) ELSE 1.0 END::DOUBLE AS w FROM memories) WINDOW p AS (PARTITION BY category)")
def self_normalised(spark, d):
    weight = F.when(F.col("surfacing_count") >= 10, F.least(F.lit(100.0) / F.col("surfacing_count"), F.lit(50.0))).otherwise(1.0)
    rows = T.memories(spark, d).select("id", "category", weight.alias("weight"))
    return K.self_normalised(rows, "category").select("id", F.round("weight", 6).alias("weight"))


@query("l9_graduation", "SELECT count(*) AS n, round(avg(tau), 6) AS mean_tau, round(stddev_pop(tau), 6) AS spread, CASE WHEN count(*) < 50 THEN 'too_few' WHEN avg(tau) < -0.3 THEN 'disagrees' WHEN stddev_pop(tau) > 0.3 THEN 'unstable' ELSE 'ready' END AS verdict FROM (SELECT (event_id % 10) / 20.0::DOUBLE AS tau FROM events)")
def graduation(spark, d):
    shadow = T.raw(spark, d, "events").select(((F.col("event_id") % 10) / 20.0).alias("tau"))
    return K.graduation(shadow, F.lit(0.6)).select("n", F.round("mean_tau", 6).alias("mean_tau"), F.round("spread", 6).alias("spread"), "verdict")


@query("l10_pairwise_samples", "WITH r AS (SELECT doc_id AS id, doc_id % 20 AS query_id, CASE WHEN doc_id % 7 = 0 THEN 1.0 ELSE 0.0 END AS rel FROM documents) SELECT p.query_id, p.id AS positive, n.id AS negative FROM r p JOIN (SELECT query_id, id FROM r WHERE rel <= 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 3) n USING (query_id) WHERE p.rel > 0")
def pairwise_samples(spark, d):
    rows = T.raw(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 20).alias("query_id"), F.when(F.col("doc_id") % 7 == 0, 1.0).otherwise(0.0).alias("rel"))
    return K.pairwise_samples(rows)


@query("c2_chunk_markdown")
def chunk_markdown(spark, d):
    return C.chunk_markdown(T.raw(spark, d, "documents"), "doc_id", "text")


@query("so4_uplift", f"WITH {_FUSED} SELECT query_id, count(*) AS only_words FROM words w WHERE NOT EXISTS (SELECT 1 FROM vec v WHERE v.query_id = w.query_id AND v.id = w.id) GROUP BY query_id")
def uplift(spark, d):
    signals, _ = _signals(spark, d)
    v = signals.where("signal = 'vector'").select("query_id", "id")
    return signals.where("signal = 'bm25'").join(v, ["query_id", "id"], "left_anti").groupBy("query_id").agg(F.count("*").alias("only_words"))


@query("ag19_profile_text", "SELECT subject_id, string_agg(predicate || '=' || n, ';' ORDER BY predicate) AS profile FROM (SELECT subject_id, predicate, count(*) AS n FROM relationships GROUP BY ALL) GROUP BY subject_id")
def profile_text(spark, d):
    g = T.relationships(spark, d).groupBy("subject_id", "predicate").agg(F.count("*").alias("n"))
    return g.groupBy("subject_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("predicate", "n"))), lambda s: F.concat_ws("=", s["predicate"], s["n"])), ";").alias("profile"))
