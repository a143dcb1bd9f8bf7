"""Scans, filters, sorts and set operations over the memory store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from palimpsest.plans.base import NOW_SQL, now, query
from palimpsest.sources import tables as T


@query("sc1_active_memories", "SELECT id, category, subject, created_at FROM memories WHERE superseded_by IS NULL")
def active_memories(spark, d):
    return T.memories(spark, d).where("superseded_by is null").select("id", "category", "subject", "created_at")


@query("sc2_recent_memories", f"SELECT id, category, created_at FROM memories WHERE created_at >= {NOW_SQL} - INTERVAL 96 HOUR AND category IN ('project', 'family') ORDER BY created_at DESC, id LIMIT 50")
def recent_memories(spark, d):
    recent = F.col("created_at") >= now() - F.expr("INTERVAL 96 HOURS")
    return T.memories(spark, d).where(recent & F.col("category").isin("project", "family")).orderBy(F.desc("created_at"), "id").limit(50).select("id", "category", "created_at")


@query("sc3_memory_by_id", "SELECT id, category, subject FROM memories WHERE id = 7")
def memory_by_id(spark, d):
    return T.memories(spark, d).where("id = 7").select("id", "category", "subject")


@query("sc5_entity_by_name", "SELECT id, name FROM entities WHERE replace(lower(trim(name)), ' ', '_') = replace(lower('EUROPE'), ' ', '_')")
def entity_by_name(spark, d):
    return T.entities(spark, d).where(S.canonical_name(F.col("name")) == S.canonical_name(F.lit("EUROPE"))).select("id", "name")


@query("sc6_entities_by_type", "SELECT id, name FROM entities WHERE entity_type = 'supplier' ORDER BY name, id LIMIT 50")
def entities_by_type(spark, d):
    return T.entities(spark, d).where("entity_type = 'supplier'").orderBy("name", "id").limit(50).select("id", "name")


@query("sc7_find_by_subject", "SELECT id, subject FROM memories WHERE contains(lower(subject), 'c1') AND superseded_by IS NULL")
def find_by_subject(spark, d):
    return T.memories(spark, d).where(F.lower("subject").contains("c1") & F.col("superseded_by").isNull()).select("id", "subject")


@query("sc8_core_memories", "SELECT id, category, CASE category WHEN 'identity' THEN 0 WHEN 'family' THEN 1 ELSE 2 END AS priority FROM memories WHERE category IN ('family', 'identity', 'preference') AND superseded_by IS NULL")
def core_memories(spark, d):
    priority = F.when(F.col("category") == "identity", 0).when(F.col("category") == "family", 1).otherwise(2)
    return T.memories(spark, d).where("category in ('family', 'identity', 'preference') and superseded_by is null").select("id", "category", priority.alias("priority"))


@query("sc9_format_of_path", "SELECT page_id, CASE WHEN u LIKE '%.md' THEN 'markdown' WHEN u LIKE '%.csv' THEN 'csv' WHEN u LIKE '%.json' THEN 'json' WHEN u LIKE '%.pdf' THEN 'pdf' WHEN u LIKE '%.txt' THEN 'text' ELSE 'unsupported' END AS format FROM (SELECT page_id, lower(regexp_replace(url, '[?#].*$', '')) AS u FROM pages)")
def format_of_path(spark, d):
    from palimpsest.sources.files import format_of

    return T.raw(spark, d, "pages").select("page_id", format_of(F.regexp_replace("url", "[?#].*$", "")).alias("format"))


@query("fp5_facts_filter", "SELECT id FROM memories WHERE category = 'project' AND contains(lower(subject), 'src1') AND origin = 'voice' AND superseded_by IS NULL")
def facts_filter(spark, d):
    return T.memories(spark, d).where((F.col("category") == "project") & F.lower("subject").contains("src1") & (F.col("origin") == "voice") & F.col("superseded_by").isNull()).select("id")


@query("fp6_protected", "SELECT category, count(*) AS n, count(*) FILTER (category IN ('identity', 'family')) AS protected FROM memories GROUP BY category")
def protected(spark, d):
    return T.memories(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("category").isin(*T.PROTECTED)).alias("protected"))


@query("fp7_stale_candidates", f"SELECT id, confidence FROM memories WHERE confidence < 0.6 AND created_at < {NOW_SQL} - INTERVAL 10 DAY")
def stale_candidates(spark, d):
    return T.memories(spark, d).where((F.col("confidence") < 0.6) & (F.col("created_at") < now() - F.expr("INTERVAL 10 DAYS"))).select("id", "confidence")


@query("fp13_clamp_confidence", "SELECT l_orderkey, l_linenumber, greatest(0, least(1, coalesce(try_cast(l_returnflag AS DOUBLE), 0.5)))::DOUBLE AS from_text, greatest(0, least(1, l_quantity / 30))::DOUBLE AS from_number FROM lineitem")
def clamp_confidence(spark, d):
    return T.raw(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.clamp_unit(F.col("l_returnflag")).alias("from_text"), S.clamp_unit(F.col("l_quantity") / 30).alias("from_number"))


@query("t3_commitment_urgency", "SELECT id, deadline, row_number() OVER (ORDER BY deadline IS NULL, deadline, created_at, id) AS place FROM commitments WHERE status IN ('open', 'in_progress', 'blocked') ORDER BY place LIMIT 100")
def commitment_urgency(spark, d):
    first = T.commitments(spark, d).where("status in ('open', 'in_progress', 'blocked')").orderBy(F.asc_nulls_last("deadline"), "created_at", "id").limit(100)
    w = Window.orderBy(F.asc_nulls_last("deadline"), "created_at", "id")  # over a hundred rows
    return first.select("id", "deadline", F.row_number().over(w).alias("place"))


_AT = "TIMESTAMP '1996-01-01 00:00:00'"


@query("t4_overdue", f"SELECT id, deadline, escalation_policy <> '' AS escalates FROM commitments WHERE status IN ('open', 'in_progress', 'blocked') AND deadline < {_AT}")
def overdue(spark, d):
    return T.commitments(spark, d).where(f"status in ('open', 'in_progress', 'blocked') and deadline < {_AT}").select("id", "deadline", (F.col("escalation_policy") != "").alias("escalates"))


@query("t4_upcoming", f"SELECT id, deadline FROM commitments WHERE status IN ('open', 'in_progress', 'blocked') AND deadline >= {_AT} AND deadline <= {_AT} + INTERVAL 720 HOUR")
def upcoming(spark, d):
    return T.commitments(spark, d).where(f"status in ('open', 'in_progress', 'blocked') and deadline >= {_AT} and deadline <= {_AT} + INTERVAL 720 HOURS").select("id", "deadline")


@query("t4_waiting_on", "SELECT id, owner FROM commitments WHERE commitment_type = 'waiting_on' AND status IN ('open', 'in_progress', 'blocked')")
def waiting_on(spark, d):
    return T.commitments(spark, d).where("commitment_type = 'waiting_on' and status in ('open', 'in_progress', 'blocked')").select("id", "owner")


@query("t5_failed_runs", "SELECT run_id, started_at FROM runs WHERE outcome = 'failure' ORDER BY started_at DESC, run_id LIMIT 50")
def failed_runs(spark, d):
    return T.runs(spark, d).where("outcome = 'failure'").orderBy(F.desc("started_at"), "run_id").limit(50).select("run_id", "started_at")


@query("t1_wisdom_rank", "SELECT id, row_number() OVER (PARTITION BY action_type ORDER BY CASE WHEN score IS NULL THEN 2 WHEN score <= 2 THEN 0 ELSE 1 END, score DESC NULLS LAST, ts DESC, id) AS place FROM wisdom QUALIFY place <= 10")
def wisdom_rank(spark, d):
    rank = F.when(F.col("score").isNull(), 2).when(F.col("score") <= 2, 0).otherwise(1)
    w = Window.partitionBy("action_type").orderBy(rank, F.desc_nulls_last("score"), F.desc("ts"), "id")
    return T.wisdom(spark, d).select("id", F.row_number().over(w).alias("place")).where("place <= 10")


@query("t6_pending_feedback", "SELECT id, ts FROM wisdom WHERE score IS NULL AND outcome <> 'pending' ORDER BY ts DESC, id LIMIT 100")
def pending_feedback(spark, d):
    return T.wisdom(spark, d).where("score is null and outcome <> 'pending'").orderBy(F.desc("ts"), "id").limit(100).select("id", "ts")


@query("so5_both_directions", "SELECT subject_id AS id, object_id AS other, predicate FROM relationships UNION ALL SELECT object_id, subject_id, predicate FROM relationships WHERE subject_id <> object_id")
def both_directions(spark, d):
    from palimpsest.operators.graph import both_ways

    return both_ways(T.relationships(spark, d))


@query("so6_distinct_pairs", "SELECT DISTINCT category, subject FROM memories")
def distinct_pairs(spark, d):
    return T.memories(spark, d).select("category", "subject").distinct()
