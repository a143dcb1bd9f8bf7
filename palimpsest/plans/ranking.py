"""The ranker's training set and scores, shadow comparison, simulated feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import retrieval as R
from palimpsest.plans.base import query
from palimpsest.plans.searches import _FUSED, _signals
from palimpsest.sources import tables as T


@query("r14_rerank_blend", "WITH s AS (SELECT category AS query_id, id, importance AS importance_score, (id % 11) / 5.0::DOUBLE - 1 AS pair_score FROM memories) SELECT query_id, id, round(0.75 * CASE WHEN max(importance_score) OVER q > min(importance_score) OVER q THEN (importance_score - min(importance_score) OVER q) / (max(importance_score) OVER q - min(importance_score) OVER q) ELSE 1 END + 0.25 / (1 + exp(-pair_score)), 6) AS blended FROM s WINDOW q AS (PARTITION BY query_id)")
def rerank_blend(spark, d):
    rows = T.memories(spark, d).select(F.col("category").alias("query_id"), "id", F.col("importance").alias("importance_score"), ((F.col("id") % 11) / 5.0 - 1).alias("pair_score"))
    return R.rerank_blend(rows, "pair_score").select("query_id", "id", F.round("blended", 6).alias("blended"))


@query("ag14_tau_window", "SELECT round(avg(tau), 6) AS mean_tau, round(stddev_pop(tau), 6) AS spread FROM (SELECT (event_id % 10) / 20.0::DOUBLE AS tau FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)")
def tau_window(spark, d):
    last = T.raw(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select(((F.col("event_id") % 10) / 20.0).alias("tau"))
    return last.agg(F.round(F.avg("tau"), 6).alias("mean_tau"), F.round(F.stddev_pop("tau"), 6).alias("spread"))


@query("sk14_run_steps", "SELECT run_id, string_agg(left(tool_name, 3), ',' ORDER BY ts, event_id) AS steps FROM steps GROUP BY run_id")
def run_steps(spark, d):
    return T.runs(spark, d).select("run_id", F.array_join(F.transform("steps", lambda s: F.substring(s["tool_name"], 1, 3)), ",").alias("steps"))
