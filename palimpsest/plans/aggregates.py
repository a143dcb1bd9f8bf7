"""Aggregations, windows and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import metrics as M
from palimpsest.operators.vector import knn
from palimpsest.plans.base import query
from palimpsest.sources import tables as T
from palimpsest.storage import written


@query("ag1_counts", "SELECT category, count(*) AS n FROM memories WHERE superseded_by IS NULL GROUP BY category")
def counts(spark, d):
    return T.memories(spark, d).where("superseded_by is null").groupBy("category").agg(F.count("*").alias("n"))


@query("ag1_entity_counts", "SELECT entity_type, count(*) AS n FROM entities GROUP BY entity_type")
def entity_counts(spark, d):
    return T.entities(spark, d).groupBy("entity_type").agg(F.count("*").alias("n"))


@query("ag3_wisdom_stats", "SELECT coalesce(action_type, 'all') AS action_type, count(*) AS total, count(score) AS rated, round(avg(score), 2) AS avg_score FROM wisdom GROUP BY GROUPING SETS ((), (action_type))")
def wisdom_stats(spark, d):
    stats = T.wisdom(spark, d).groupingSets([[], ["action_type"]], "action_type").agg(F.count("*").alias("total"), F.count("score").alias("rated"), F.round(F.avg("score"), 2).alias("avg_score"))
    return stats.select(F.coalesce("action_type", F.lit("all")).alias("action_type"), "total", "rated", "avg_score")


@query("ag4_should_consult", "SELECT action_type, CASE WHEN n < 10 THEN 'too_few' WHEN failed / n > 0.1 THEN 'failing' WHEN low > 0 THEN 'rated_low' ELSE 'fine' END AS advice FROM (SELECT action_type, count(*) AS n, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (score <= 2) AS low FROM wisdom GROUP BY action_type)")
def should_consult(spark, d):
    g = T.wisdom(spark, d).groupBy("action_type").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("score") <= 2).alias("low"))
    return g.select("action_type", F.when(F.col("n") < 10, "too_few").when(F.col("failed") / F.col("n") > 0.1, "failing").when(F.col("low") > 0, "rated_low").otherwise("fine").alias("advice"))


@query("ag5_commitment_stats", "SELECT commitment_type, count(*) AS total, count(*) FILTER (status IN ('open', 'in_progress', 'blocked')) AS active, count(*) FILTER (status IN ('open', 'in_progress', 'blocked') AND deadline < TIMESTAMP '1996-01-01') AS overdue FROM commitments GROUP BY commitment_type")
def commitment_stats(spark, d):
    live = F.col("status").isin("open", "in_progress", "blocked")
    return T.commitments(spark, d).groupBy("commitment_type").agg(F.count("*").alias("total"), F.count_if(live).alias("active"), F.count_if(live & (F.col("deadline") < F.lit("1996-01-01").cast("timestamp"))).alias("overdue"))


@query("ag6_run_stats", "SELECT outcome, source, count(*) AS runs, round(avg(n_steps), 1) AS avg_steps FROM runs GROUP BY outcome, source")
def run_stats(spark, d):
    return T.runs(spark, d).groupBy("outcome", "source").agg(F.count("*").alias("runs"), F.round(F.avg(F.size("steps")), 1).alias("avg_steps"))


@query("ag7_tool_success", "SELECT tool_name, count(*) AS total, count(*) FILTER (success) AS ok, round(count(*) FILTER (success) / count(*), 4) AS rate FROM steps GROUP BY tool_name ORDER BY total DESC, tool_name LIMIT 20")
def tool_success(spark, d):
    g = T.steps(spark, d).groupBy("tool_name").agg(F.count("*").alias("total"), F.count_if("success").alias("ok"))
    return g.withColumn("rate", F.round(F.col("ok") / F.col("total"), 4)).orderBy(F.desc("total"), "tool_name").limit(20)


@query("ag8_failure_patterns", "SELECT run_id, string_agg(tool_name, ',' ORDER BY ts, event_id) FILTER (NOT success) AS failed FROM steps JOIN (SELECT run_id FROM runs WHERE outcome = 'failure' ORDER BY started_at DESC, run_id LIMIT 20) USING (run_id) GROUP BY run_id")
def failure_patterns(spark, d):
    latest = T.runs(spark, d).where("outcome = 'failure'").orderBy(F.desc("started_at"), "run_id").limit(20)
    return latest.select("run_id", F.array_join(F.transform(F.filter("steps", lambda s: ~s["success"]), lambda s: s["tool_name"]), ",").alias("failed"))


@query("ag9_degree", "SELECT id, count(*) AS degree FROM (SELECT subject_id AS id FROM relationships UNION ALL SELECT object_id FROM relationships) GROUP BY id")
def degree(spark, d):
    from palimpsest.operators import graph

    return graph.degree(T.relationships(spark, d))


@query("ag10_duplicate_groups", "SELECT subject_id, predicate, object_id, count(*) AS n FROM relationships GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return T.relationships(spark, d).groupBy("subject_id", "predicate", "object_id").agg(F.count("*").alias("n")).where("n > 1")


@query("ag12_direct_connections", "SELECT object_id AS id, count(DISTINCT subject_id) AS direct FROM relationships WHERE valid_to IS NULL GROUP BY object_id")
def direct_connections(spark, d):
    return T.relationships(spark, d).where("valid_to is null").groupBy(F.col("object_id").alias("id")).agg(F.count_distinct("subject_id").alias("direct"))


@query("ag17_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def percentiles(spark, d):
    return T.raw(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@query("w9_keep_best_edge", "SELECT subject_id, predicate, object_id, valid_from, confidence FROM relationships QUALIFY row_number() OVER (PARTITION BY subject_id, predicate, object_id ORDER BY confidence DESC, valid_from, valid_to NULLS LAST) = 1")
def keep_best_edge(spark, d):
    from palimpsest.operators import graph

    return graph.keep_best(T.relationships(spark, d)).select("subject_id", "predicate", "object_id", "valid_from", "confidence")


@query("w11_close_intervals", "SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders")
def close_intervals(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return T.raw(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_to"))


@query("w2_minmax", "SELECT id, CASE WHEN max(importance) OVER w > min(importance) OVER w THEN (importance - min(importance) OVER w) / (max(importance) OVER w - min(importance) OVER w) ELSE 1.0 END AS scaled FROM memories WINDOW w AS (PARTITION BY subject)")
def minmax(spark, d):
    from palimpsest.operators.retrieval import minmax as scaled

    return T.memories(spark, d).select("id", scaled("importance", "subject").alias("scaled"))


def _results(spark, d, k=10):
    v = T.vectors(spark, d)
    queries = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")  # a stated query set against all rows
    return written(knn(queries, v, k, exclude_self=True), "results"), v


def _judgments(v, results, most=0):
    """The judgments of these results, and the first ``most`` of each query."""
    labels = v.select("id", "label")
    return M.judged_alike(labels, labels.where("id % 50 = 0").withColumnRenamed("id", "query_id"), results, most)


_RESULTS_SQL = """WITH q AS (SELECT * FROM vectors WHERE id % 50 = 0),
 results AS (SELECT q.id AS query_id, v.id AS id, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.embedding, v.embedding), v.id) AS rank FROM q, vectors v WHERE q.id <> v.id QUALIFY rank <= 10),
 judged AS (SELECT q.id AS query_id, v.id AS id FROM q JOIN vectors v ON q.label = v.label WHERE q.id <> v.id) """


@query("m1_ndcg", _RESULTS_SQL + """, best AS (SELECT query_id, sum(1 / log2(n + 1)) AS idcg FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM judged) WHERE n <= 5 GROUP BY query_id)
 SELECT b.query_id, round(coalesce(sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) END) / min(idcg), 0), 6) AS ndcg FROM best b LEFT JOIN (SELECT r.* FROM results r JOIN judged USING (query_id, id)) x ON x.query_id = b.query_id GROUP BY b.query_id""")
def ndcg(spark, d):
    results, v = _results(spark, d)
    return M.ndcg(results, _judgments(v, results, 5), 5).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("m2_mrr", _RESULTS_SQL + "SELECT query_id, round(coalesce(1 / min(rank) FILTER (j.id IS NOT NULL), 0), 6) AS mrr FROM results LEFT JOIN judged j USING (query_id, id) GROUP BY query_id")
def mrr(spark, d):
    results, v = _results(spark, d)
    return M.mrr(results, _judgments(v, results)).select("query_id", F.round("mrr", 6).alias("mrr"))


@query("m3_precision", _RESULTS_SQL + "SELECT query_id, round(count(j.id) / 5.0, 6)::DOUBLE AS precision FROM results LEFT JOIN judged j USING (query_id, id) WHERE rank <= 5 GROUP BY query_id")
def precision(spark, d):
    results, v = _results(spark, d)
    return M.precision(results, _judgments(v, results), 5).select("query_id", F.round("precision", 6).alias("precision"))
