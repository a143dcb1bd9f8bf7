"""Writes: entities, edges, histories, logs, caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import lifecycle as L
from palimpsest.operators import writes as W
from palimpsest.plans.base import NOW_SQL, now, query
from palimpsest.sources import tables as T

_NORMAL = r"""CASE WHEN length(c) > 4 AND ends_with(c, 's') AND NOT ends_with(c, 'ss') THEN left(c, length(c) - 1) ELSE c END"""


def _normal(name: str) -> str:
    c = rf"regexp_replace(replace(regexp_replace(replace(lower(trim({name})), '-', '_'), '\s*\([^)]*\)\s*$', ''), ' ', '_'), '_(service|server|app|api|project|system|tool|library)$', '')"
    return f"CASE WHEN length({c}) > 4 AND ends_with({c}, 's') AND NOT ends_with({c}, 'ss') THEN left({c}, length({c}) - 1) ELSE {c} END"


_INCOMING = "incoming AS (SELECT DISTINCT upper(name) || CASE WHEN n % 3 = 0 THEN ' App' ELSE '' END AS name, CASE WHEN n % 5 = 0 THEN 'thing' ELSE entity_type END AS entity_type FROM entities UNION SELECT '!', 'thing')"


@query("sk6_find_or_create", rf"""WITH {_INCOMING}, keyed AS (SELECT *, CASE WHEN length(clean) >= 2 THEN clean END AS safe FROM (SELECT *, trim(regexp_replace(regexp_replace(name, '[^a-zA-Z0-9 _.''-]', '', 'g'), '\s+', ' ', 'g')) AS clean FROM incoming)),
 known AS (SELECT entity_type, id, replace(lower(trim(name)), ' ', '_') AS canonical, {_normal("name")} AS normal FROM entities)
 SELECT k.name, k.entity_type, coalesce(e.id, m.id, k.entity_type || ':new:' || replace(lower(trim(safe)), ' ', '_')) AS id, safe IS NOT NULL AND e.id IS NULL AND m.id IS NULL AS created FROM keyed k
 LEFT JOIN (SELECT entity_type, canonical, min(id) AS id FROM known GROUP BY ALL) e ON e.entity_type = k.entity_type AND e.canonical = replace(lower(trim(safe)), ' ', '_')
 LEFT JOIN (SELECT entity_type, normal, min(id) AS id FROM known GROUP BY ALL) m ON m.entity_type = k.entity_type AND m.normal = {_normal("safe")}""")
def find_or_create(spark, d):
    e = T.entities(spark, d)
    name = F.concat(F.upper("name"), F.when(F.col("n") % 3 == 0, " App").otherwise(""))
    incoming = e.select(name.alias("name"), F.when(F.col("n") % 5 == 0, "thing").otherwise(F.col("entity_type")).alias("entity_type"))
    return W.find_or_create(e, incoming.union(spark.sql("SELECT '!', 'thing'")))


@query("fp12_safe_inputs", "SELECT id, length(content[1:50000]) AS length, category[1:3] AS category FROM memories WHERE trim(content) <> '' AND length(content) <= 10000")
def safe_inputs(spark, d):
    """The text stands for the metadata too, so that long ones are rejected."""
    rows = T.memories(spark, d).select("id", "content", "category", F.col("content").alias("metadata"))
    accepted, _ = W.safe_inputs(rows)
    return accepted.select("id", F.length("content").cast("long").alias("length"), F.substring("category", 1, 3).alias("category"))


@query("sk4_merge_metadata", "SELECT event_id, event_type || ':' || event_id AS merged FROM events")
def merge_metadata(spark, d):
    old = F.create_map(F.lit("kind"), F.lit("old"), F.lit("n"), F.col("event_id").cast("string"))
    merged = L.merge_metadata(old, F.create_map(F.lit("kind"), F.col("event_type")))
    return T.raw(spark, d, "events").select("event_id", F.concat_ws(":", merged["kind"], merged["n"]).alias("merged"))


@query("sk5_entity_metadata", "SELECT e.id, CASE WHEN r.subject_id IS NOT NULL THEN 'state=active;type=' || entity_type ELSE 'state=idle;type=' || entity_type END AS metadata FROM entities e LEFT JOIN (SELECT DISTINCT subject_id FROM relationships WHERE valid_to IS NULL) r ON r.subject_id = e.id")
def entity_metadata(spark, d):
    """Entities with live edges become active: their stored metadata merged with the update, the update winning."""
    e = T.entities(spark, d).withColumn("metadata", F.create_map(F.lit("state"), F.lit("idle"), F.lit("type"), F.col("entity_type")))
    updates = T.relationships(spark, d).where("valid_to is null").select(F.col("subject_id").alias("id")).distinct().withColumn("new", F.create_map(F.lit("state"), F.lit("active")))
    merged = L.merge_metadata(F.col("metadata"), F.coalesce("new", F.create_map().cast("map<string,string>")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("merged")), lambda kv: F.concat_ws("=", kv["key"], kv["value"])), ";")
    return e.join(updates, "id", "left").withColumn("merged", merged).select("id", text.alias("metadata"))


@query("sk8_expire", f"SELECT subject_id, predicate, object_id, valid_from, CASE WHEN valid_to IS NULL AND subject_id IN (SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_acctbal < 0) THEN {NOW_SQL} ELSE valid_to END AS valid_to FROM relationships")
def expire(spark, d):
    """The open edges of suppliers in debt end now."""
    edges = T.relationships(spark, d)
    debtors = T.raw(spark, d, "supplier").where("s_acctbal < 0").select(F.concat_ws(":", F.lit("supplier"), "s_suppkey").alias("subject_id"))
    keys = edges.join(debtors, "subject_id", "left_semi").select("subject_id", "predicate", "object_id")
    return W.expire(edges, keys, now()).select("subject_id", "predicate", "object_id", "valid_from", "valid_to")


@query("sk9_update_values", f"""WITH change AS (SELECT 'customer:' || c_custkey AS subject_id, 'lives_in' AS predicate, 'nation:0' AS object_id FROM customer WHERE c_acctbal < 0),
 marked AS (SELECT r.*, c.subject_id IS NOT NULL AS changed, row_number() OVER (PARTITION BY r.subject_id, r.predicate ORDER BY valid_to IS NOT NULL, valid_from, r.object_id) AS n FROM relationships r LEFT JOIN change c ON c.subject_id = r.subject_id AND c.predicate = r.predicate)
 SELECT subject_id, predicate, object_id, valid_from, CASE WHEN changed AND valid_to IS NULL AND n = 1 THEN {NOW_SQL} ELSE valid_to END AS valid_to, confidence FROM marked UNION ALL SELECT subject_id, predicate, object_id, {NOW_SQL}, NULL, 1.0 FROM change""")
def update_values(spark, d):
    """Customers in debt move to the first nation."""
    moved = T.raw(spark, d, "customer").where("c_acctbal < 0").select(F.concat_ws(":", F.lit("customer"), "c_custkey").alias("subject_id"), F.lit("lives_in").alias("predicate"), F.lit("nation:0").alias("object_id"), now().alias("at"))
    return W.update_values(T.relationships(spark, d), moved)


@query("sk12_wisdom_events", """WITH base AS (SELECT user_id AS id, arg_min(event_type, (ts, event_id)) AS action, NULL::INTEGER AS score, 'pending' AS outcome FROM events GROUP BY user_id),
 told AS (SELECT user_id AS id, ts, event_id, event_type, CASE WHEN event_type = 'error' AND floor(value)::BIGINT % 7 BETWEEN 1 AND 5 THEN (floor(value)::BIGINT % 7)::INTEGER END AS score FROM events),
 state AS (SELECT id, arg_max(score, (ts, event_id)) FILTER (score IS NOT NULL) AS score, arg_max(event_id::VARCHAR, (ts, event_id)) FILTER (event_type = 'click') AS outcome, bool_or(event_type = 'signup' AND event_id % 40 = 0) AS gone FROM told GROUP BY id)
 SELECT b.id, b.action, s.score, coalesce(s.outcome, b.outcome) AS outcome FROM base b JOIN state s USING (id) WHERE NOT gone""")
def wisdom_events(spark, d):
    """A row for each user; clicks record an outcome, errors a rating from 1 to 5, some signups delete."""
    e = T.raw(spark, d, "events")
    base = e.groupBy(F.col("user_id").alias("id")).agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("action")).select("id", "action", F.lit(None).cast("int").alias("score"), F.lit("pending").alias("outcome"))
    rating = F.floor("value") % 7
    field = F.when(F.col("event_type") == "click", "outcome").when((F.col("event_type") == "error") & rating.between(1, 5), "score").when((F.col("event_type") == "signup") & (F.col("event_id") % 40 == 0), "delete").otherwise("unknown")
    events = e.select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), field.alias("field"), F.when(F.col("event_type") == "click", F.col("event_id").cast("string")).otherwise(rating.cast("string")).alias("value"))
    return W.apply_events(base, events, {"score": "int", "outcome": "string"}, "delete")


@query("sk13_commitment_states", """WITH told AS (SELECT o_custkey AS id, o_orderdate AS t, o_orderkey AS seq, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE 'completed' END AS status FROM orders),
 state AS (SELECT id, arg_max(status, (t, seq)) AS status, max(t) FILTER (status = 'completed') AS done, string_agg(status, ',' ORDER BY t, seq) AS context FROM told GROUP BY id) SELECT id, status, CASE WHEN status = 'completed' THEN done END AS completed_at, context FROM state""")
def commitment_states(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("completed")
    return W.advance(T.raw(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"), status.alias("status")))


@query("sk14_run_records", """WITH told AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS run_id, ts, event_id, CASE WHEN event_type IN ('purchase', 'error') THEN 'complete' ELSE 'step' END AS kind, event_type, repeat(props, 60) AS arguments FROM events),
 done AS (SELECT run_id, arg_min(CASE event_type WHEN 'purchase' THEN 'success' ELSE 'failure' END, (ts, event_id)) AS outcome, min(ts) AS completed_at FROM told WHERE kind = 'complete' GROUP BY run_id),
 counted AS (SELECT run_id, count(*) FILTER (kind = 'step') AS n_steps, coalesce(sum(length(left(arguments, 500))) FILTER (kind = 'step'), 0)::BIGINT AS characters FROM told GROUP BY run_id)
 SELECT run_id, coalesce(outcome, 'pending') AS outcome, completed_at, n_steps, characters FROM counted LEFT JOIN done USING (run_id)""")
def run_records(spark, d):
    """A user's day is a run: purchases and errors complete it, other events are steps."""
    e = T.raw(spark, d, "events")
    done = F.col("event_type").isin("purchase", "error")
    events = e.select(F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("run_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(done, "complete").otherwise("step").alias("kind"),
        F.repeat("props", F.lit(60)).alias("arguments"), F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("error"), F.when(F.col("event_type") == "purchase", "success").when(done, "failure").alias("outcome"))
    made = W.run_records(events)
    return made.select("run_id", "outcome", "completed_at", F.size("steps").cast("long").alias("n_steps"), F.aggregate("steps", F.lit(0).cast("long"), lambda n, s: n + F.length(s["arguments"])).alias("characters"))


_LOG = """results AS (SELECT q.id AS query_id, v.id AS id, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.embedding, v.embedding), v.id) AS rank FROM (SELECT * FROM vectors WHERE id IN (SELECT item_id FROM benchmark)) q, vectors v QUALIFY rank <= 10)"""


def _logged(spark, d):
    from palimpsest.operators import vector as V
    from palimpsest.plans.searches import _item_vectors

    queries = _item_vectors(spark, d)
    found = V.knn(queries, T.vectors(spark, d), 10).withColumn("features", F.array(F.round("distance", 6)))
    return W.retrieval_log(found, queries, now())


@query("sk15_log_retrieval", f"WITH {_LOG} SELECT query_id, left(sha256(text), 16) AS query_hash, count(*) AS candidates, string_agg(id, ',' ORDER BY rank) AS returned FROM results JOIN benchmark ON item_id = query_id GROUP BY query_id, text")
def log_retrieval(spark, d):
    return _logged(spark, d).select("query_id", "query_hash", "candidates", F.array_join(F.map_keys("returned"), ",").alias("returned"))


@query("ag15_surfacing_counts", f"WITH {_LOG} SELECT id, count(*) AS surfacing FROM results GROUP BY id")
def surfacing_counts(spark, d):
    """How often each row was returned, from the keys of the logs' maps."""
    return W.surfaced(_logged(spark, d))


@query("sk16_cached_paths", f"SELECT object_id AS source, string_agg(DISTINCT subject_id, ',' ORDER BY subject_id) AS members, {NOW_SQL} + INTERVAL 1 HOUR AS expires_at FROM relationships WHERE predicate = 'located_in' AND valid_to IS NULL GROUP BY object_id UNION ALL SELECT 'kept', 'x', {NOW_SQL} + INTERVAL 5 MINUTE UNION ALL SELECT 'nation:1', 'x', {NOW_SQL} + INTERVAL 5 MINUTE WHERE NOT EXISTS (SELECT 1 FROM relationships WHERE predicate = 'located_in' AND valid_to IS NULL AND object_id = 'nation:1')")
def cached_paths(spark, d):
    """Fresh paths replace the cached ones of their source; of the others the expired ones go."""
    fresh = W.cached_paths(T.relationships(spark, d), "located_in", now())
    old = [("nation:1", 5), ("gone", -5), ("kept", 5)]
    cache = spark.createDataFrame(old, "source string, m int").select("source", F.array(F.lit("x")).alias("members"), F.timestamp_add("MINUTE", F.col("m"), now()).alias("expires_at"))
    return W.upsert_cache(cache, fresh, now()).select("source", F.array_join("members", ",").alias("members"), "expires_at")


@query("sk18_audit_tail", "SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_tail(spark, d):
    log = T.raw(spark, d, "events").where("event_type = 'error'").select("event_id", "ts")
    return W.tail(log, [F.desc("ts"), F.desc("event_id")])


@query("x13_confirmed_delete", "SELECT id FROM memories WHERE NOT (id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND category NOT IN ('identity', 'family'))")
def confirmed_delete(spark, d):
    chosen = T.raw(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return W.confirmed_delete(T.memories(spark, d), chosen, T.PROTECTED, True)[1].select("id")


@query("x13_delete_preview", "SELECT id FROM memories WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND category NOT IN ('identity', 'family')")
def delete_preview(spark, d):
    chosen = T.raw(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return W.confirmed_delete(T.memories(spark, d), chosen, T.PROTECTED, False)[0].select("id")


@query("sc4_points", "SELECT 'entity' AS kind, name AS found FROM entities WHERE id = 'nation:3' UNION ALL SELECT 'wisdom', outcome FROM wisdom WHERE id = 5 UNION ALL SELECT 'commitment', status FROM commitments WHERE id = 7 UNION ALL SELECT 'run', outcome FROM runs WHERE run_id = (SELECT min(run_id) FROM runs)")
def points(spark, d):
    """One row of each table by its key."""
    runs = T.runs(spark, d)
    first = runs.agg(F.min("run_id").alias("run_id"))
    row = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("found"))
    entity, wise = T.entities(spark, d).where("id = 'nation:3'"), T.wisdom(spark, d).where("id = 5")
    return row("entity", entity, "name").union(row("wisdom", wise, "outcome")).union(row("commitment", T.commitments(spark, d).where("id = 7"), "status")).union(row("run", runs.join(F.broadcast(first), "run_id"), "outcome"))
