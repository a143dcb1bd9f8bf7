"""Metrics of retrieval and cognition, the ranker's samples, ablations, sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import vectors as VF
from palimpsest.operators import metrics as M
from palimpsest.operators import ranker as K
from palimpsest.operators import retrieval as R
from palimpsest.operators.vector import knn
from palimpsest.plans.base import NOW_SQL, now, query
from palimpsest.plans.searches import vector_queries
from palimpsest.sources import tables as T
from palimpsest.storage import written

# results: the ten nearest of every 50th vector; a second list leaves out every third of them
_RESULTS = """results AS (SELECT q.id AS query_id, v.id AS id, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.embedding, v.embedding), v.id) AS rank FROM (SELECT * FROM vectors WHERE id % 50 = 0) q, vectors v WHERE q.id <> v.id QUALIFY rank <= 10),
 other AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM results WHERE rank % 3 <> 1),
 judged AS (SELECT q.id AS query_id, v.id AS id, 1.0 AS rel FROM vectors q JOIN vectors v ON q.label = v.label WHERE q.id % 50 = 0 AND q.id <> v.id)"""


def results(spark, d):
    return knn(vector_queries(spark, d), T.vectors(spark, d), 10, exclude_self=True)


def _labels(spark, d):
    """The rows and the queries by label."""
    v = T.vectors(spark, d).select("id", "label")
    return v, v.where("id % 50 = 0").withColumnRenamed("id", "query_id")


def judgments(spark, d, asked, most=0):
    """The judgments of these results, and the first ``most`` of each query."""
    return M.judged_alike(*_labels(spark, d), asked, most)


def _other(rows):
    return rows.where("rank % 3 <> 1").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


_DATED = "dated AS (SELECT r.*, created_at FROM results r JOIN memories m ON m.id = r.id)"
_CONCORD = """concord AS (SELECT query_id, coalesce(sum((a.created_at > b.created_at)::INT) / nullif(sum((a.created_at <> b.created_at)::INT), 0), 0.5) AS c FROM dated a JOIN dated b USING (query_id) WHERE a.rank < b.rank GROUP BY query_id)"""


@query("w7_date_concordance", f"WITH {_RESULTS}, {_DATED}, {_CONCORD} SELECT query_id, round(c, 6) AS concordance FROM concord")
def date_concordance(spark, d):
    dated = results(spark, d).join(T.memories(spark, d).select("id", "created_at"), "id")
    return M.concordance(dated).select("query_id", F.round("concordance", 6).alias("concordance"))


@query("m4_temporal", f"WITH {_RESULTS}, {_DATED}, {_CONCORD}, span AS (SELECT min(epoch(created_at)) AS low, max(epoch(created_at)) AS high FROM memories WHERE superseded_by IS NULL) SELECT query_id, round(avg((epoch(created_at) - low) / (high - low)) * 0.6 + any_value(c) * 0.4, 6) AS score FROM dated JOIN concord USING (query_id), span GROUP BY query_id")
def temporal(spark, d):
    return M.temporal_score(results(spark, d), T.memories(spark, d)).select("query_id", F.round("score", 6).alias("score"))


@query("m5_session_coherence", f"WITH {_RESULTS}, share AS (SELECT 'with' AS kind, query_id, count(j.id) / count(*) AS s FROM results r LEFT JOIN judged j USING (query_id, id) WHERE rank <= 5 GROUP BY query_id UNION ALL SELECT 'alone', query_id, count(j.id) / count(*) FROM other r LEFT JOIN judged j USING (query_id, id) WHERE rank <= 5 GROUP BY query_id) SELECT a.query_id, CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM share a JOIN share b ON a.query_id = b.query_id AND a.kind = 'with' AND b.kind = 'alone'")
def session_coherence(spark, d):
    rows = written(results(spark, d), "results")
    return M.session_score(rows, _other(rows), judgments(spark, d, rows))


@query("m6_graph_uplift", f"""WITH {_RESULTS}, new AS (SELECT query_id, count(*) AS n FROM results r WHERE NOT EXISTS (SELECT 1 FROM other o WHERE o.query_id = r.query_id AND o.id = r.id) GROUP BY query_id),
 full_kinds AS (SELECT query_id, count(DISTINCT label) AS k FROM results JOIN vectors USING (id) GROUP BY query_id), base_kinds AS (SELECT query_id, count(DISTINCT label) AS k FROM other JOIN vectors USING (id) GROUP BY query_id)
 SELECT f.query_id, round(0.5 * least(coalesce(n, 0) / 3, 1) + 0.5 * greatest(0, least(1, coalesce(f.k / b.k - 1, 1))), 6) AS score FROM full_kinds f LEFT JOIN base_kinds b USING (query_id) LEFT JOIN new USING (query_id)""")
def graph_uplift(spark, d):
    rows = results(spark, d)
    subjects = T.vectors(spark, d).select("id", F.col("label").alias("subject"))
    return M.graph_score(rows, _other(rows), subjects).select("query_id", F.round("score", 6).alias("score"))


@query("m7_consolidation", f"WITH {_RESULTS} SELECT q.id AS query_id, CASE WHEN count(r.id) = 0 THEN 0.5 WHEN count(m.superseded_by) > 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM (SELECT id FROM vectors WHERE id % 50 = 0 UNION ALL SELECT -1) q LEFT JOIN results r ON r.query_id = q.id LEFT JOIN memories m ON m.id = r.id GROUP BY q.id")
def consolidation(spark, d):
    queries = vector_queries(spark, d).select("query_id").union(spark.range(-1, 0))
    return M.consolidation_score(queries, results(spark, d), T.memories(spark, d).where("superseded_by is not null"))


@query("m8_protection", f"WITH {_RESULTS} SELECT query_id, CASE WHEN min(rank) FILTER (category IN ('identity', 'family')) <= 3 THEN 1.0 WHEN min(rank) FILTER (category IN ('identity', 'family')) <= 5 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM results r JOIN memories m ON m.id = r.id GROUP BY query_id")
def protection(spark, d):
    m = T.memories(spark, d)
    known = results(spark, d).join(m.select("id"), "id", "left_semi")
    return M.protection_score(known, m.where(F.col("category").isin(*T.PROTECTED)))


@query("m8_decay", f"""WITH {_RESULTS}, t AS (SELECT r.*, created_at, lag(created_at) OVER (PARTITION BY query_id ORDER BY rank) < created_at AS up FROM results r JOIN memories m ON m.id = r.id WHERE category = 'preference')
 SELECT q.query_id, CASE WHEN count(t.id) = 0 THEN 0.8 WHEN count(*) FILTER (up) = 0 THEN 1.0 WHEN epoch(max(created_at) - min(created_at)) <= 172800 THEN 0.8 ELSE 0.3 END::DOUBLE AS score FROM (SELECT DISTINCT query_id FROM results) q LEFT JOIN t USING (query_id) GROUP BY q.query_id""")
def decay(spark, d):
    return M.decay_score(results(spark, d), T.memories(spark, d).where("category = 'preference'").select("id", "created_at"))


@query("m9_proactive", f"""WITH {_RESULTS}, grades AS (SELECT query_id, id, (id + query_id) % 4 AS grade FROM judged), f AS (SELECT query_id, count(*) FILTER (grade >= 2) / count(*) AS s FROM results JOIN grades USING (query_id, id) GROUP BY query_id), b AS (SELECT query_id, count(*) FILTER (grade >= 2) / count(*) AS s FROM other JOIN grades USING (query_id, id) GROUP BY query_id)
 SELECT q.query_id, round(CASE WHEN f.s IS NULL THEN -1 ELSE least(0.6 * f.s + 0.4 * greatest(0, f.s - coalesce(b.s, 0)), 1) END, 6) AS score FROM (SELECT DISTINCT query_id FROM results) q LEFT JOIN f USING (query_id) LEFT JOIN b USING (query_id)""")
def proactive(spark, d):
    rows = written(results(spark, d), "results")
    grades = judgments(spark, d, rows).select("query_id", "id", ((F.col("id") + F.col("query_id")) % 4).alias("grade"))
    return M.proactive_score(rows, _other(rows), grades).select("query_id", F.round("score", 6).alias("score"))


@query("m10_recall", f"WITH {_RESULTS} SELECT query_id, round(count(r.id) / count(*), 6) AS recall FROM judged LEFT JOIN results r USING (query_id, id) GROUP BY query_id")
def recall(spark, d):
    v, q = _labels(spark, d)
    totals = q.join(v.groupBy("label").agg((F.count("*") - 1).alias("all")), "label").where("all > 0").select("query_id", "all")
    rows = written(results(spark, d), "results")
    return M.recall(rows, judgments(spark, d, rows), 10, totals).select("query_id", F.round("recall", 6).alias("recall"))


@query("m10_tail_ndcg", f"""WITH {_RESULTS}, tail AS (SELECT DISTINCT query_id FROM judged j JOIN memories m ON m.id = j.id WHERE surfacing_count < 1), best AS (SELECT query_id, sum(1 / log2(n + 1)) AS idcg FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM judged) WHERE n <= 5 GROUP BY query_id)
 SELECT b.query_id, round(coalesce(sum(1 / log2(rank + 1)) / min(idcg), 0), 6) AS ndcg FROM best b JOIN tail USING (query_id) LEFT JOIN (SELECT r.* FROM results r JOIN judged USING (query_id, id) WHERE rank <= 5) x ON x.query_id = b.query_id GROUP BY b.query_id""")
def tail_ndcg(spark, d):
    v, q = _labels(spark, d)
    surfacing = T.memories(spark, d).select("id", "surfacing_count")
    rare = v.join(surfacing.where("surfacing_count < 1").select("id"), "id", "left_semi")
    tail = M.tail_queries(M.judged_alike(rare, q, most=1), surfacing, 1)
    rows = written(results(spark, d), "results")
    return M.ndcg(rows, judgments(spark, d, rows, 5), 5).join(tail, "query_id").select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("m10_random_ndcg", f"""WITH {_RESULTS}, shuffled AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY md5(query_id || ':' || id)) AS rank FROM results), best AS (SELECT query_id, sum(1 / log2(n + 1)) AS idcg FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM judged) WHERE n <= 5 GROUP BY query_id)
 SELECT b.query_id, round(coalesce(sum(1 / log2(rank + 1)) / min(idcg), 0), 6) AS ndcg FROM best b LEFT JOIN (SELECT r.* FROM shuffled r JOIN judged USING (query_id, id) WHERE rank <= 5) x ON x.query_id = b.query_id GROUP BY b.query_id""")
def random_ndcg(spark, d):
    """The baseline: the same results in an order that only hashes choose."""
    w = Window.partitionBy("query_id").orderBy(F.md5(F.concat_ws(":", "query_id", "id")))
    shuffled = written(results(spark, d).withColumn("rank", F.row_number().over(w)), "results")
    return M.ndcg(shuffled, judgments(spark, d, shuffled, 5), 5).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("ag16_means", f"WITH {_RESULTS} SELECT kind AS adapter, round(avg(p), 4) AS precision FROM (SELECT 'full' AS kind, query_id, count(j.id) / 5.0 AS p FROM results LEFT JOIN judged j USING (query_id, id) WHERE rank <= 5 GROUP BY query_id UNION ALL SELECT 'other', query_id, count(j.id) / 5.0 FROM other LEFT JOIN judged j USING (query_id, id) WHERE rank <= 5 GROUP BY query_id) GROUP BY kind")
def means(spark, d):
    rows = written(results(spark, d), "results")
    good = judgments(spark, d, rows)
    each = M.precision(rows, good, 5).withColumn("adapter", F.lit("full")).unionByName(M.precision(_other(rows), good, 5).withColumn("adapter", F.lit("other")))
    return each.groupBy("adapter").agg(F.round(F.avg("precision"), 4).alias("precision"))


@query("ag18_composite", "SELECT round(sum(w * s) / sum(w), 6) AS composite FROM (SELECT CASE event_type WHEN 'purchase' THEN 0.4 WHEN 'click' THEN 0.3 WHEN 'view' THEN 0.2 ELSE 0.1 END AS w, CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN -1 ELSE avg(value) END AS s FROM events GROUP BY event_type) WHERE s >= 0")
def composite(spark, d):
    """Errors have no score and signups were skipped, so their weights don't count."""
    g = T.raw(spark, d, "events").groupBy(F.col("event_type").alias("category")).agg(F.avg("value").alias("score"))
    scores = g.withColumn("score", F.when(F.col("category") == "signup", -1.0).when(F.col("category") != "error", F.col("score")))
    return M.composite(scores, {"purchase": 0.4, "click": 0.3, "view": 0.2, "signup": 0.1, "error": 0.1}).select(F.round("composite", 6).alias("composite"))


@query("x4_training_signals", f"WITH {_RESULTS} SELECT query_id, string_agg(id, ',' ORDER BY rank) AS candidates FROM results JOIN judged USING (query_id, id) GROUP BY query_id")
def training_signals(spark, d):
    """Candidates that were judged, in their order: what a ranker can be trained on."""
    rows = written(results(spark, d), "results")
    kept = rows.join(judgments(spark, d, rows), ["query_id", "id"], "left_semi")
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), ",").alias("candidates"))


@query("x5_pool_to_judge", f"WITH {_RESULTS} SELECT query_id, id FROM (SELECT query_id, id FROM results UNION SELECT query_id, id FROM other) p WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.query_id = p.query_id AND j.id = p.id)")
def pool_to_judge(spark, d):
    """The union of several searches' results without those that are judged already."""
    rows = written(results(spark, d), "results")
    pool = rows.select("query_id", "id").union(_other(rows).select("query_id", "id")).distinct()
    return pool.join(judgments(spark, d, pool), ["query_id", "id"], "left_anti")


@query("x8_paired_wins", "WITH trial AS (SELECT user_id AS seed, event_type AS method, round(avg(value), 6) AS score FROM events GROUP BY ALL) SELECT a.method AS method_a, b.method AS method_b, count(*) FILTER (a.score > b.score) AS wins, count(*) FILTER (a.score < b.score) AS losses, count(*) FILTER (a.score = b.score) AS ties, round(avg(a.score - b.score), 4) AS mean_gap FROM trial a JOIN trial b ON a.seed = b.seed AND a.method < b.method GROUP BY ALL")
def paired_wins(spark, d):
    runs = T.raw(spark, d, "events").groupBy(F.col("user_id").alias("seed"), F.col("event_type").alias("method")).agg(F.round(F.avg("value"), 6).alias("score"))
    return K.paired_wins(runs).withColumn("mean_gap", F.round("mean_gap", 4))


@query("x7_learning_curve")
def learning_curve(spark, d):
    rows = T.raw(spark, d, "events").select(F.col("event_id").alias("id"), "value")
    return K.learning_curve(rows, (0.1, 0.5, 1.0), 3, F.avg("value"))


# candidates of the features: the results with what a session has seen
_FEATURED = f"""{_RESULTS}, cand AS (SELECT r.*, list_distance(q.embedding, v.embedding) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, r.id) - 1 AS newest, m.* EXCLUDE (id) FROM results r JOIN vectors q ON q.id = r.query_id JOIN vectors v ON v.id = r.id JOIN memories m ON m.id = r.id)"""


def featured(spark, d):
    rows = results(spark, d).join(T.memories(spark, d), "id")
    newest = Window.partitionBy("query_id").orderBy(F.desc("created_at"), "id")
    more = {"bm25": 1.0 / F.col("rank"), "graph": (F.col("id") % 3) / 2.0, "coherence": (F.col("query_id") % 7) / 7.0, "depth": 1.0 / (1 + F.col("query_id") % 5), "seen_categories": F.array(F.lit("project")), "seen_tokens": F.array(F.lit("src1"), F.lit("src2")), "freshness": (F.col("id") % 5) / 5.0, "freshness_rank": F.row_number().over(newest) - 1}
    rows = rows.withColumns(more).withColumn("rank", F.col("rank") - 1)
    return K.features(rows, now(), T.PROTECTED)


@query("l1_features", f"""WITH {_FEATURED} SELECT query_id, id, round(1 - distance, 6) AS similarity, round(1 / rank, 6) AS bm25, (id % 3) / 2.0::DOUBLE AS graph, round(coalesce(nullif(importance, 0), 0.5), 6) AS importance,
 round(CASE WHEN category IN ('identity', 'family') THEN 1.0 ELSE power(0.5, greatest(0, epoch({NOW_SQL} - created_at) / 86400) / 90) END, 6) AS decay, round(CASE WHEN surfacing_count > 0 THEN least(access_count / surfacing_count, 2) / 2 ELSE ln(2 + least(access_count, 5)) / ln(7) END, 6) AS utility,
 CASE category WHEN 'family' THEN 0.25 WHEN 'identity' THEN 0.5 WHEN 'preference' THEN 0.75 ELSE 1.0 END::DOUBLE AS category, round(1 / rank, 6) AS reciprocal_rank, round((query_id % 7) / 7, 6) AS coherence, round(1 / (1 + query_id % 5), 6) AS depth,
 (category = 'project')::INT::DOUBLE AS category_seen, (subject IN ('src1', 'src2'))::INT::DOUBLE AS subject_seen, round((id % 5) / 5, 6) AS freshness, round(1 / (1 + newest), 6) AS freshness_rank FROM cand""")
def features(spark, d):
    x = featured(spark, d)
    return x.select("query_id", "id", *(F.round(F.col("features")[k], 6).alias(name) for k, name in enumerate(K.FEATURES)))


@query("w4_freshness_rank", f"WITH {_FEATURED} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id % 5 DESC, id) AS place FROM cand WHERE id % 5 > 0")
def freshness_rank(spark, d):
    """Ranks by freshness among the rows that have any."""
    w = Window.partitionBy("query_id").orderBy(F.desc("freshness"), "id")
    return featured(spark, d).where("freshness > 0").select("query_id", "id", F.row_number().over(w).alias("place"))


def _weights():
    import numpy as np

    k = np.arange(16 * 14).reshape(16, 14)
    return (k % 7 - 3) / 10.0, (np.arange(16) % 5 - 2) / 10.0, (np.arange(16) % 3 - 1) / 4.0


@query("l2_forward", f"""WITH {_FEATURED}, x AS (SELECT query_id, id, [1 - distance, 1 / rank, (id % 3) / 2, coalesce(nullif(importance, 0), 0.5), CASE WHEN category IN ('identity', 'family') THEN 1.0 ELSE power(0.5, greatest(0, epoch({NOW_SQL} - created_at) / 86400) / 90) END,
 CASE WHEN surfacing_count > 0 THEN least(access_count / surfacing_count, 2) / 2 ELSE ln(2 + least(access_count, 5)) / ln(7) END, CASE category WHEN 'family' THEN 0.25 WHEN 'identity' THEN 0.5 WHEN 'preference' THEN 0.75 ELSE 1.0 END, 1 / rank, (query_id % 7) / 7, 1 / (1 + query_id % 5),
 (category = 'project')::INT, (subject IN ('src1', 'src2'))::INT, (id % 5) / 5, 1 / (1 + newest)]::DOUBLE[] AS f FROM cand),
 hidden AS (SELECT query_id, id, h, greatest(0, (h % 5 - 2) / 10 + list_sum(list_transform(range(14), lambda i: f[i + 1] * ((h * 14 + i) % 7 - 3) / 10))) AS z FROM x, range(16) t(h))
 SELECT query_id, id, round(1 / (1 + exp(-sum(z * (h % 3 - 1) / 4))), 5) AS score FROM hidden GROUP BY query_id, id""")
def forward(spark, d):
    """The network of fourteen inputs and sixteen hidden units over all features, with fixed weights."""
    w1, b1, w2 = _weights()
    return featured(spark, d).select("query_id", "id", F.round(K.forward(F.col("features"), w1, b1, w2, 0.0), 5).alias("score"))


@query("l3_shadow_compare", f"""WITH {_RESULTS}, a AS (SELECT query_id, id, rank AS x FROM results WHERE rank <= 5), b AS (SELECT query_id, id, rank AS y FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id % 10, id) AS rank FROM results) WHERE rank <= 5),
 p AS (SELECT query_id, id, x, y FROM a JOIN b USING (query_id, id)) SELECT q.query_id, count(DISTINCT p.id) AS shared, round(coalesce(any_value(t.tau), 0), 6) AS tau FROM (SELECT DISTINCT query_id FROM results) q LEFT JOIN p USING (query_id)
 LEFT JOIN (SELECT m.query_id, sum(sign((m.x - n.x) * (m.y - n.y))) / count(*) AS tau FROM p m JOIN p n ON m.query_id = n.query_id AND m.id < n.id GROUP BY m.query_id) t ON t.query_id = q.query_id GROUP BY q.query_id""")
def shadow_compare(spark, d):
    """A model's order (here by the id's last digit) against the served one: the overlap of the first five and Kendall's tau of it."""
    rows = results(spark, d)
    model = rows.withColumn("y", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("id") % 10, "id"))).where("y <= 5").select("query_id", "id", "y")
    shared = rows.where("rank <= 5").select("query_id", "id", F.col("rank").alias("x")).join(model, ["query_id", "id"])
    counted = shared.groupBy("query_id").agg(F.count("*").alias("shared"))
    every = rows.select("query_id").distinct().join(counted, "query_id", "left").join(R.kendall_tau(shared), "query_id", "left")
    return every.select("query_id", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), F.round(F.coalesce("tau", F.lit(0.0)), 6).alias("tau"))


@query("w6_kendall", f"""WITH {_RESULTS}, a AS (SELECT query_id, id, rank AS x FROM results WHERE rank <= 5), b AS (SELECT query_id, id, rank AS y FROM other WHERE rank <= 5), p AS (SELECT query_id, id, x, y FROM a JOIN b USING (query_id, id))
 SELECT m.query_id, round(sum(sign((m.x - n.x) * (m.y - n.y))) / count(*), 6) AS tau FROM p m JOIN p n ON m.query_id = n.query_id AND m.id < n.id GROUP BY m.query_id""")
def kendall(spark, d):
    """Over the intersection of the first five of two lists."""
    rows = results(spark, d)
    side = lambda r, c: r.where("rank <= 5").select("query_id", "id", F.col("rank").alias(c))
    return R.kendall_tau(side(rows, "x").join(side(_other(rows), "y"), ["query_id", "id"])).withColumn("tau", F.round("tau", 6))


def _logs(spark, d):
    """Each list of results as a log, an hour apart, and outcomes by its number."""
    x = featured(spark, d)
    logs = x.groupBy(F.col("query_id").alias("log_id")).agg(F.map_from_entries(F.collect_list(F.struct("id", "features"))).alias("returned")).withColumn("at", F.timestamp_add("HOUR", F.col("log_id").cast("int"), F.expr("TIMESTAMP '2024-01-01'")))
    outcomes = logs.select("log_id", F.when(F.col("log_id") % 100 == 0, 1.0).otherwise(0.5).alias("outcome"))
    return logs.select("log_id", "at", "returned"), outcomes, T.memories(spark, d).select("id", "surfacing_count")


@query("l7_training_samples", f"WITH {_RESULTS} SELECT query_id AS log_id, r.id, CASE WHEN query_id % 100 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS label, round(CASE WHEN surfacing_count >= 10 THEN least((SELECT sum(surfacing_count) FROM memories) / surfacing_count, 50) ELSE 1 END, 6) AS weight FROM results r JOIN memories m ON m.id = r.id")
def training_samples(spark, d):
    return K.samples(*_logs(spark, d)).select("log_id", "id", "label", F.round("weight", 6).alias("weight"))


@query("l13_learn_job")
def learn_job(spark, d):
    """Label, train and graduate: the trained network's NDCG over its own logs, and the verdict."""
    net = K.fit(K.samples(*_logs(spark, d)), steps=50)
    x = K.scored(featured(spark, d), net)
    ranked = x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).select("query_id", "id", "rank")
    ranked = written(ranked, "ranked")
    ndcg = M.ndcg(ranked, judgments(spark, d, ranked, 5), 5).agg(F.avg("ndcg").alias("ndcg")).first().ndcg or 0.0
    taus = R.kendall_tau(x.select("query_id", "id", (-F.col("score")).alias("x"), F.col("rank").alias("y")))
    return K.graduation(taus.select("tau"), F.lit(ndcg)).withColumn("ndcg", F.lit(float(ndcg)))


@query("w10_sessions", """SELECT event_id, row_number() OVER w - 1 AS depth, lag(value) OVER w AS before, coalesce(len(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))), 0) AS seen FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def sessions(spark, d):
    """Each user's events in order: how many came before, the last value, and how many kinds were seen."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seen = F.collect_set("event_type").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return T.raw(spark, d, "events").select("event_id", (F.row_number().over(w) - 1).cast("long").alias("depth"), F.lag("value").over(w).alias("before"), F.size(seen).cast("long").alias("seen"))


@query("r13_session_features", "SELECT id, round(coalesce(greatest(0, list_cosine_similarity(embedding, lag(embedding) OVER w)), 0), 6) AS coherence, round(1 / (row_number() OVER w), 6) AS depth FROM vectors WINDOW w AS (PARTITION BY label ORDER BY id)")
def session_features(spark, d):
    """A label's vectors as the queries of a session: the cosine with the one before, and 1 / (1 + how many came before)."""
    w = Window.partitionBy("label").orderBy("id")
    before = T.vectors(spark, d).withColumns({"last": F.lag("embedding").over(w), "n": F.row_number().over(w)})
    return before.select("id", F.round(F.coalesce(VF.cosine(F.col("embedding"), F.col("last")), F.lit(0.0)), 6).alias("coherence"), F.round(1.0 / F.col("n"), 6).alias("depth"))


@query("r12_session_bonus", """WITH s AS (SELECT event_id, event_type, list_distinct(regexp_extract_all(lower(props), '[\\p{L}\\p{N}]+')) AS ws, list(event_type) OVER p AS kinds, flatten(list(regexp_extract_all(lower(props), '[\\p{L}\\p{N}]+')) OVER p) AS told FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT event_id, round(CASE WHEN list_contains(kinds, event_type) THEN 0.05 ELSE 0 END + 0.05 * CASE WHEN len(ws) > 0 THEN coalesce(len(list_intersect(ws, list_distinct(told))), 0) / len(ws) ELSE 0 END, 6) AS bonus FROM s""")
def session_bonus(spark, d):
    """Kinds of events as categories and their properties as subjects, against what the user's earlier events showed."""
    from palimpsest.operators.fulltext import tokens

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = T.raw(spark, d, "events").withColumns({"kinds": F.collect_set("event_type").over(w), "told": F.array_distinct(F.flatten(F.collect_list(tokens(F.col("props"))).over(w)))})
    return rows.select("event_id", F.round(R.session_bonus(F.col("props"), F.col("event_type"), F.col("kinds"), F.col("told")), 6).alias("bonus"))
