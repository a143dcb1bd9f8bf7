"""State of the world, extraction's rules and searches over the operational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from palimpsest.operators import extraction as X
from palimpsest.operators import fulltext as FT
from palimpsest.operators import graph as G
from palimpsest.operators import world as W
from palimpsest.plans.base import NOW_SQL, now, query
from palimpsest.sources import tables as T

_TOUCHED = "touched AS (SELECT e.*, a.at AS last_accessed_at, u.at AS updated_at FROM entities e LEFT JOIN (SELECT 'customer:' || o_custkey AS id, max(o_orderdate) AS at FROM orders GROUP BY 1) a ON a.id = e.id LEFT JOIN (SELECT object_id AS id, max(valid_from) AS at FROM relationships GROUP BY 1) u ON u.id = e.id)"


def _touched(spark, d):
    """Entities with the last order of a customer as access and the last edge to an entity as update."""
    accessed = T.raw(spark, d, "orders").groupBy(F.concat_ws(":", F.lit("customer"), "o_custkey").alias("id")).agg(F.max("o_orderdate").cast("timestamp").alias("last_accessed_at"))
    updated = T.relationships(spark, d).groupBy(F.col("object_id").alias("id")).agg(F.max("valid_from").alias("updated_at"))
    return T.entities(spark, d).join(accessed, "id", "left").join(updated, "id", "left")


@query("fp8_stale_entities", f"WITH {_TOUCHED} SELECT id FROM touched WHERE (last_accessed_at IS NULL OR last_accessed_at < TIMESTAMP '1998-01-01') AND (updated_at IS NULL OR updated_at < TIMESTAMP '1998-01-01')")
def stale_entities(spark, d):
    return W.stale_entities(_touched(spark, d), F.expr("TIMESTAMP '1998-01-01'"), None).select("id")


@query("fp8_longest_untouched", f"WITH {_TOUCHED} SELECT id FROM touched WHERE (last_accessed_at IS NULL OR last_accessed_at < TIMESTAMP '1998-01-01') AND (updated_at IS NULL OR updated_at < TIMESTAMP '1998-01-01') ORDER BY coalesce(last_accessed_at, updated_at) NULLS FIRST, id LIMIT 50")
def longest_untouched(spark, d):
    return W.stale_entities(_touched(spark, d), F.expr("TIMESTAMP '1998-01-01'")).select("id")


@query("fp9_active_projects", "SELECT 'part:' || p_partkey AS id FROM part WHERE p_size % 4 <> 3")
def active_projects(spark, d):
    """Parts as projects: the state in their metadata follows from their size; every fourth names none."""
    size = F.col("p_size") % 4
    metadata = F.when(size == 0, '{"state": "in_progress"}').when(size == 1, '{"state": "blocked"}').when(size == 2, '{"owner": "x"}').otherwise('{"state": "done"}')
    rows = T.raw(spark, d, "part").select(F.concat_ws(":", F.lit("part"), "p_partkey").alias("id"), F.lit("project").alias("entity_type"), metadata.alias("metadata"))
    return W.active_projects(rows).select("id")


@query("fp10_of_type", "SELECT id, name FROM entities WHERE entity_type = 'nation' ORDER BY name LIMIT 50")
def of_type(spark, d):
    return T.entities(spark, d).where("entity_type = 'nation'").orderBy("name").limit(50).select("id", "name")


_MOMENTS = "moments AS (SELECT event_id AS key, hour(ts) AS hour, isodow(ts) - 1 AS day FROM events), routines AS (SELECT * FROM (VALUES (1, 0, 6, 8, 'running'), (2, 0, 8, 9, 'breakfast'), (3, 5, 10, 12, 'market')) r(id, day, f, t, name))"


@query("g20_current_activity", f"""WITH {_MOMENTS}, based AS (SELECT *, CASE WHEN day >= 5 THEN CASE WHEN hour < 9 THEN 'resting' ELSE 'leisure' END WHEN hour BETWEEN 9 AND 17 THEN 'working' WHEN hour < 7 OR hour >= 22 THEN 'resting' ELSE 'home' END AS kind,
 CASE WHEN day >= 5 THEN 0.5 WHEN hour BETWEEN 9 AND 17 THEN 0.7 ELSE 0.6 END::DOUBLE AS sure FROM moments)
 SELECT key, coalesce(arg_min(r.name, r.id), kind) AS activity, CASE WHEN count(r.id) > 0 THEN least(sure + 0.1, 0.95) ELSE sure END AS confidence FROM based b LEFT JOIN routines r ON r.day = b.day AND b.hour BETWEEN f AND t GROUP BY key, kind, sure""")
def current_activity(spark, d):
    routines = spark.createDataFrame([(1, 0, 6, 8, "running"), (2, 0, 8, 9, "breakfast"), (3, 5, 10, 12, "market")], "id int, day int, from_hour int, to_hour int, name string")
    moments = T.raw(spark, d, "events").select(F.col("event_id").alias("key"), F.hour("ts").alias("hour"), F.weekday("ts").alias("day"))
    return W.with_routines(moments, F.broadcast(routines))  # three rows


@query("g22_set_state", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'active' WHEN p_size % 3 = 1 THEN 'blocked' ELSE 'idle' END AS state, p_brand AS brand FROM part")
def set_state(spark, d):
    """Changes by size: the newest of two counts, and a state that nobody allows changes nothing."""
    p = T.raw(spark, d, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("state"), F.lit("idle"), F.lit("brand"), F.col("p_brand")).alias("metadata"), "p_size")
    kind = F.col("p_size") % 3
    changes = p.select("id", F.lit(1).alias("at"), F.when(kind == 2, "broken").otherwise("active").alias("state")).union(p.where(kind == 1).select("id", F.lit(2), F.lit("blocked")))
    return W.set_state(p.select("id", "metadata"), changes, ("active", "blocked"))[0].select("id", F.col("metadata")["state"].alias("state"), F.col("metadata")["brand"].alias("brand"))


@query("g3_nested_profiles", "SELECT id, string_agg(predicate || '=' || vals, ';' ORDER BY predicate) AS facts, sum(n)::BIGINT AS related FROM (SELECT subject_id AS id, predicate, string_agg(DISTINCT coalesce(name, object_id), ',' ORDER BY coalesce(name, object_id)) AS vals, count(DISTINCT coalesce(name, object_id)) AS n FROM relationships LEFT JOIN (SELECT id AS object_id, name FROM entities) USING (object_id) WHERE valid_to IS NULL GROUP BY ALL) GROUP BY id")
def nested_profiles(spark, d):
    p = W.profiles(T.relationships(spark, d), T.entities(spark, d))
    return p.select("id", F.array_join(F.transform(F.map_entries("facts"), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ","))), ";").alias("facts"), "related")


@query("g21_world_summary", """SELECT 'projects' AS section, string_agg('- ' || line, chr(10) ORDER BY place) AS text FROM (SELECT p_name || ' (' || p_brand || ')' AS line, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part QUALIFY place <= 5)
 UNION ALL SELECT 'people', string_agg('- ' || line, chr(10) ORDER BY place) FROM (SELECT c_name AS line, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer QUALIFY place <= 5)""")
def world_summary(spark, d):
    projects = W.listed(T.raw(spark, d, "part"), "projects", [F.desc("p_retailprice"), F.asc("p_partkey")], F.format_string("%s (%s)", "p_name", "p_brand"), 5)
    people = W.listed(T.raw(spark, d, "customer"), "people", [F.desc("c_acctbal"), F.asc("c_custkey")], F.col("c_name"), 5)
    return W.report([projects, people])


@query("g16_common_paths", "SELECT CASE predicate WHEN 'located_in' THEN 'suppliers' ELSE 'customers' END AS path, string_agg(subject_id, ',' ORDER BY subject_id) AS members FROM relationships WHERE object_id = 'nation:3' AND predicate IN ('located_in', 'lives_in') AND valid_to IS NULL GROUP BY predicate")
def common_paths(spark, d):
    """The live neighbours of one node by two predicates, under the paths' names."""
    live = G.active(T.relationships(spark, d)).where("object_id = 'nation:3' and predicate in ('located_in', 'lives_in')")
    path = F.when(F.col("predicate") == "located_in", "suppliers").otherwise("customers")
    return live.groupBy(path.alias("path")).agg(F.array_join(F.array_sort(F.collect_list("subject_id")), ",").alias("members"))


@query("j5_degrees_joined", "SELECT e.id, name, coalesce(g.n, 0) AS degree FROM entities e LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT subject_id AS id FROM relationships WHERE valid_to IS NULL UNION ALL SELECT object_id FROM relationships WHERE valid_to IS NULL) GROUP BY id) g ON g.id = e.id")
def degrees_joined(spark, d):
    degrees = G.degree(G.active(T.relationships(spark, d)))
    return T.entities(spark, d).join(degrees, "id", "left").select("id", "name", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


FAMILIES = {"reading": ["view", "click"], "money": ["purchase", "signup", "click"]}


@query("j15_siblings", "SELECT DISTINCT action, sibling FROM (SELECT event_type AS action, unnest(CASE event_type WHEN 'view' THEN ['click'] WHEN 'click' THEN ['view', 'purchase', 'signup'] WHEN 'purchase' THEN ['signup', 'click'] WHEN 'signup' THEN ['purchase', 'click'] ELSE []::VARCHAR[] END) AS sibling FROM events)")
def siblings(spark, d):
    return W.siblings(T.raw(spark, d, "events").select(F.col("event_type").alias("action")), FAMILIES)


@query("t2_smart_wisdom", """WITH tiers AS (SELECT w.*, CASE WHEN action_type = 'purchase' THEN 0 WHEN action_type IN ('signup', 'click') THEN 1 WHEN contains(props, '7') THEN 2 END AS tier FROM wisdom w JOIN (SELECT event_id AS id, props FROM events) USING (id) WHERE outcome <> 'pending')
 SELECT id, tier, row_number() OVER (ORDER BY tier, CASE WHEN score IS NULL THEN 2 WHEN score <= 2 THEN 0 ELSE 1 END, score DESC NULLS LAST, ts DESC, id) AS place FROM tiers WHERE tier IS NOT NULL ORDER BY place LIMIT 30""")
def smart_wisdom(spark, d):
    """Rows of the action itself, then of its family, then those whose context holds a word, best first in each."""
    family = W.siblings(spark.createDataFrame([("purchase",)], "action string"), FAMILIES).select(F.col("sibling").alias("action_type"), F.lit(1).alias("family"))
    rows = T.wisdom(spark, d).where("outcome <> 'pending'").join(T.raw(spark, d, "events").select(F.col("event_id").alias("id"), "props"), "id").join(F.broadcast(family), "action_type", "left")
    tier = F.when(F.col("action_type") == "purchase", 0).when(F.col("family").isNotNull(), 1).when(F.col("props").contains("7"), 2)
    rank = F.when(F.col("score").isNull(), 2).when(F.col("score") <= 2, 0).otherwise(1)
    order = [F.asc("tier"), rank.asc(), F.desc_nulls_last("score"), F.desc("ts"), F.asc("id")]
    first = rows.withColumn("tier", tier).where("tier is not null").orderBy(*order).limit(30)
    return first.select("id", "tier", F.row_number().over(Window.orderBy(*order)).alias("place"))  # 30 rows


@query("tx7_search_tables", r"""WITH asked AS (SELECT * FROM (VALUES (0, 'customer'), (0, 'open'), (1, 'delegation'), (2, 'draft')) q(query_id, term)), rows AS (SELECT id, regexp_extract_all(lower(owner), '[\p{L}\p{N}]+') || regexp_extract_all(lower(commitment_type), '[\p{L}\p{N}]+') || regexp_extract_all(lower(status), '[\p{L}\p{N}]+') AS ws FROM commitments)
 SELECT query_id, count(*) AS n, min(id) AS first FROM (SELECT query_id, id FROM asked a JOIN rows ON list_contains(ws, a.term) GROUP BY query_id, id HAVING count(*) = CASE query_id WHEN 0 THEN 2 ELSE 1 END) GROUP BY query_id""")
def search_tables(spark, d):
    """All terms over three columns of the commitments: how many rows each query finds, and the first."""
    rows = T.commitments(spark, d)
    terms = spark.createDataFrame([(0, "customer"), (0, "open"), (1, "delegation"), (2, "draft")], "query_id int, term string")
    found = FT.search(rows, terms, ["owner", "commitment_type", "status"], 1_000_000_000)
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("tx11_boolean", r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents) SELECT doc_id FROM t WHERE (list_contains(w, 'the') OR len(list_filter(w, lambda x: starts_with(x, 'wor'))) > 0) AND contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') AND NOT list_contains(w, 'und') OR list_contains(w, 'license') AND list_contains(w, 'under')""")
def boolean(spark, d):
    words = FT.tokens(F.col("text"))
    return T.raw(spark, d, "documents").where(FT.boolean('(the OR wor*) "of the" NOT und OR license AND under', words)).select("doc_id")


_ANSWERS = """answers AS (SELECT conv_id * 1000 + turn AS id, length(text) AS n, turn, conv_id FROM conversations)"""


def _answers(spark, d):
    """Made-up model answers: each turn's first words as names, its length as confidence; some are fenced, some no JSON."""
    c = T.raw(spark, d, "conversations")
    name = F.regexp_replace(F.substring("text", 1, 12), r'["\\\n\r\t]', " ")
    sure = (F.length("text") % 11) / 10.0
    predicate = F.element_at(F.array(*map(F.lit, ["works on", "caused_by", "LIVES-IN", "knows"])), (F.col("turn") % 4 + 1).cast("int"))
    text = F.format_string('{"entities": [{"name": "%s", "type": "Topic"}, {"name": "it", "type": "x"}], "relationships": [{"subject": "%s", "predicate": "%s", "object": "Place %s", "confidence": %s}]}', name, name, predicate, F.col("conv_id") % 5, sure)
    answer = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), text, F.lit("\n```\nDone."))).when(F.col("turn") % 7 == 6, "no idea").otherwise(text)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("source"), answer.alias("answer"))


_TRIPLES = """cand AS (SELECT conv_id * 1000 + turn AS id, ['works_on', 'caused_by', 'lives_in', 'knows'][turn % 4 + 1] AS predicate, trim(regexp_replace(regexp_replace(regexp_replace(left(text, 12), '["\\\\\\n\\r\\t]', ' ', 'g'), '[^a-zA-Z0-9 _.''-]', '', 'g'), '\\s+', ' ', 'g')) AS subject, 'Place ' || conv_id % 5 AS object, (length(text) % 11) / 10.0::DOUBLE AS confidence FROM conversations WHERE length(text) >= 50 AND turn % 7 <> 6 OR length(text) >= 50 AND turn % 3 = 0),
 sound AS (SELECT * FROM cand WHERE length(subject) >= 2 AND NOT regexp_matches(lower(subject), '^(that|the|this|my|a|an|some) ') AND NOT list_contains(['i','me','my','mine','you','he','she','it','we','us','they','the','an','this','that'], lower(subject)) AND confidence >= CASE WHEN predicate = 'caused_by' THEN 0.8 ELSE 0.5 END)"""


@query("fp15_accept_triples", f"WITH {_TRIPLES} SELECT id, subject, predicate, object, confidence, CASE predicate WHEN 'works_on' THEN 'project' WHEN 'lives_in' THEN 'place' ELSE 'unknown' END AS object_type FROM sound")
def accept_triples(spark, d):
    _, triples = X.parse_answers(_answers(spark, d))
    return X.accept_triples(triples).select("id", "subject", "predicate", "object", "confidence", "object_type")


@query("fp15_accept_entities", f"WITH {_TRIPLES} SELECT id, subject AS name, 'topic' AS type FROM cand WHERE length(subject) >= 2 AND NOT regexp_matches(lower(subject), '^(that|the|this|my|a|an|some) ') AND NOT list_contains(['i','me','my','mine','you','he','she','it','we','us','they','the','an','this','that'], lower(subject))")
def accept_entities(spark, d):
    entities, _ = X.parse_answers(_answers(spark, d))
    return X.accept_entities(entities).select("id", "name", "type")


@query("v8_normalised_predicates", """WITH ref AS (SELECT label, embedding FROM vectors QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) = 1),
 best AS (SELECT v.id, r.label, list_cosine_similarity(v.embedding, r.embedding) AS c FROM vectors v, ref r WHERE r.label < 5 AND v.label >= 5 QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY list_cosine_similarity(v.embedding, r.embedding) DESC, 'p' || r.label) = 1)
 SELECT id, 'p' || label AS predicate FROM vectors WHERE label < 5 UNION ALL SELECT id, 'p' || label FROM best WHERE c >= 0.15""")
def normalised_predicates(spark, d):
    """Labels below five are allowed; every other vector is an unknown predicate that becomes the nearest allowed one or is rejected."""
    v = T.vectors(spark, d)
    name = F.when(F.col("label") < 5, F.concat(F.lit("p"), "label")).otherwise(F.concat(F.lit("u"), "id"))
    triples = v.select("id", name.alias("predicate"))
    first = v.where("label < 5").groupBy("label").agg(F.min_by("embedding", "id").alias("embedding")).select(F.concat(F.lit("p"), "label").alias("predicate"), "embedding")
    unknown = v.where("label >= 5").select(F.concat(F.lit("u"), "id").alias("predicate"), "embedding")
    accepted, _ = X.allowed_predicates(triples, [f"p{k}" for k in range(5)], first.union(unknown), 0.15)
    return accepted


@query("fp14_predicate_allow_list", "SELECT predicate, count(*) AS n, predicate IN ('located_in', 'part_of', 'supplies') AS allowed FROM relationships GROUP BY predicate")
def predicate_allow_list(spark, d):
    accepted, rejected = X.allowed_predicates(T.relationships(spark, d).select("predicate"), ["located_in", "part_of", "supplies"])
    count = lambda df, ok: df.groupBy("predicate").agg(F.count("*").alias("n")).withColumn("allowed", F.lit(ok))
    return count(accepted, True).unionByName(count(rejected, False))


@query("fp16_review_notes", """SELECT conv_id AS id, turn AS place, CASE role WHEN 'user' THEN 'project' WHEN 'assistant' THEN 'preference' ELSE 'learning' END AS category, round((length(text) % 11) / 10.0::DOUBLE * 0.9, 6) AS confidence FROM conversations WHERE trim(text) <> '' AND (length(text) % 11) / 10.0::DOUBLE >= 0.6 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 20""")
def review_notes(spark, d):
    kind = F.when(F.col("role") == "user", "Decision").when(F.col("role") == "assistant", "preference").otherwise("other")
    notes = T.raw(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("place"), kind.alias("type"), F.col("text").alias("content"), (F.length("text") % 11 / 10.0).alias("confidence"))
    return X.accept_notes(notes).select("id", "place", "category", F.round("confidence", 6).alias("confidence"))


@query("fp17_inferences", "SELECT conv_id AS id, turn AS place, role AS subject, round((length(text) % 11) / 10.0::DOUBLE * 0.8, 6) AS confidence FROM conversations WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 20")
def inferences(spark, d):
    """Every other subject comes as a list, of which the first counts."""
    subject = F.when(F.col("turn") % 2 == 0, F.to_json(F.array("role", F.lit("other")))).otherwise(F.col("role"))
    notes = T.raw(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("place"), subject.alias("subject"), F.col("text").alias("content"), (F.length("text") % 11 / 10.0).alias("confidence"))
    return X.accept_inferences(notes).select("id", "place", "subject", F.round("confidence", 6).alias("confidence"))


@query("x_reviewable", f"SELECT conv_id, string_agg(upper(left(role, 1)) || lower(substr(role, 2)) || ': ' || text, chr(10) ORDER BY turn, role, text) AS transcript FROM conversations WHERE conv_id % 4 <> 0 GROUP BY conv_id HAVING count(*) >= 4")
def reviewable(spark, d):
    """Conversations of four turns or more; those with an id divisible by four were extracted a minute ago."""
    turns = T.raw(spark, d, "conversations")
    done = turns.select("conv_id").distinct().select("conv_id", F.when(F.col("conv_id") % 4 == 0, now() - F.expr("INTERVAL 1 MINUTE")).otherwise(now() - F.expr("INTERVAL 1 DAY")).alias("at"))
    return X.reviewable(turns, done, now())


@query("s_type_inference", "SELECT predicate, CASE predicate WHEN 'lives_in' THEN 'place' WHEN 'located_in' THEN 'place' ELSE 'unknown' END AS object_type, CASE predicate WHEN 'located_in' THEN 'place' ELSE 'unknown' END AS subject_type, count(*) AS n FROM relationships GROUP BY predicate")
def type_inference(spark, d):
    g = T.relationships(spark, d).groupBy("predicate").agg(F.count("*").alias("n"))
    return g.select("predicate", S.inferred_type(F.col("predicate"), S.OBJECT_TYPES).alias("object_type"), S.inferred_type(F.col("predicate"), S.SUBJECT_TYPES).alias("subject_type"), "n")


@query("s_tolerant_json", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def tolerant_json(spark, d):
    """Bare and fenced JSON alike."""
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("So:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    return T.raw(spark, d, "events").select("event_id", S.tolerant_json(fenced, "k long")["k"].alias("k"))


@query("s_escalation", """WITH miss AS (SELECT event_id, ts, user_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20),
 hit AS (SELECT m.event_id, w.event_id AS rule, w.ts, CASE WHEN w.user_id = m.user_id THEN 0 WHEN w.k = json_extract(m.props, '$.k')::BIGINT THEN 1 WHEN contains(lower(m.props), '"k": ' || w.k // 10) AND w.k >= 10 THEN 2 END AS kind FROM (SELECT * FROM events WHERE event_type = 'purchase') m, miss w)
 SELECT event_id, arg_min(['sender', 'tag', 'keyword'][kind + 1], (-epoch_us(ts), rule, kind)) AS reason, arg_min(rule, (-epoch_us(ts), rule, kind)) AS rule FROM hit WHERE kind IS NOT NULL GROUP BY event_id""")
def escalation(spark, d):
    """Of the 20 newest misses the first that shares a message's sender, tag or keyword escalates it."""
    e = T.raw(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    misses = e.where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(20).select(F.col("event_id").alias("rule"), F.col("ts").alias("rule_at"), F.col("user_id").alias("sender"), F.col("k").alias("tag"))
    word = F.concat(F.lit('"k": '), F.expr("tag div 10").cast("string"))
    kind = F.when(F.col("sender") == F.col("user_id"), 0).when(F.col("tag") == F.col("k"), 1).when(F.lower("props").contains(word) & (F.col("tag") >= 10), 2)
    hit = e.where("event_type = 'purchase'").crossJoin(F.broadcast(misses)).withColumn("kind", kind).where("kind is not null")  # at most 20 rules
    first = hit.groupBy("event_id").agg(F.min_by(F.struct("kind", "rule"), F.struct(-F.unix_micros(F.col("rule_at").cast("timestamp")), "rule", "kind")).alias("f"))
    return first.select("event_id", F.element_at(F.array(F.lit("sender"), F.lit("tag"), F.lit("keyword")), F.col("f.kind") + 1).alias("reason"), F.col("f.rule").alias("rule"))
