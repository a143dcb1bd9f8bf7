"""Operational tables: further sorts, groupings, samples, chunks, codecs, validation, bootstrap."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import hashed
from palimpsest.operators import chunking as C
from palimpsest.operators import retrieval as R
from palimpsest.plans.base import NOW_SQL, now, query
from palimpsest.sources import tables as T

_LIVE = "status IN ('open', 'in_progress', 'blocked')"
_AT = "TIMESTAMP '1996-01-01 00:00:00'"


@query("t4_by_owner", f"SELECT id, owner, deadline, row_number() OVER (PARTITION BY owner ORDER BY deadline NULLS LAST, created_at, id) AS place FROM commitments WHERE {_LIVE} QUALIFY place <= 20")
def by_owner(spark, d):
    w = Window.partitionBy("owner").orderBy(F.asc_nulls_last("deadline"), "created_at", "id")
    return T.commitments(spark, d).where(_LIVE).withColumn("place", F.row_number().over(w)).where("place <= 20").select("id", "owner", "deadline", "place")


@query("t4_by_type", f"SELECT id, commitment_type, row_number() OVER (PARTITION BY commitment_type ORDER BY deadline NULLS FIRST, id) AS place FROM commitments WHERE {_LIVE} QUALIFY place <= 20")
def by_type(spark, d):
    """Commitments without a deadline come first here."""
    w = Window.partitionBy("commitment_type").orderBy(F.asc_nulls_first("deadline"), "id")
    return T.commitments(spark, d).where(_LIVE).withColumn("place", F.row_number().over(w)).where("place <= 20").select("id", "commitment_type", "place")


@query("t4_escalations", f"SELECT id, owner FROM commitments WHERE {_LIVE} AND deadline < {_AT} AND escalation_policy <> ''")
def escalations(spark, d):
    return T.commitments(spark, d).where(f"{_LIVE} and deadline < {_AT} and escalation_policy <> ''").select("id", "owner")


@query("t4_completed", "SELECT id, created_at FROM commitments WHERE status = 'completed' ORDER BY created_at DESC, id LIMIT 50")
def completed(spark, d):
    return T.commitments(spark, d).where("status = 'completed'").orderBy(F.desc("created_at"), "id").limit(50).select("id", "created_at")


@query("t5_recent_runs", "SELECT run_id, outcome FROM runs ORDER BY started_at DESC, run_id LIMIT 50")
def recent_runs(spark, d):
    return T.runs(spark, d).orderBy(F.desc("started_at"), "run_id").limit(50).select("run_id", "outcome")


@query("t5_runs_by_source", "SELECT run_id, source FROM runs WHERE source = 'manual' ORDER BY started_at DESC, run_id LIMIT 50")
def runs_by_source(spark, d):
    return T.runs(spark, d).where("source = 'manual'").orderBy(F.desc("started_at"), "run_id").limit(50).select("run_id", "source")


@query("t5_pending_runs", "SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS run_id, min(ts) AS started_at FROM events GROUP BY 1 HAVING count(*) FILTER (event_type IN ('purchase', 'error')) = 0")
def pending_runs(spark, d):
    """Runs that nothing has completed; all of them, oldest first where order counts."""
    e = T.steps(spark, d)
    g = e.groupBy("run_id").agg(F.min("ts").alias("started_at"), F.count_if(F.col("tool_name").isin("purchase", "error")).alias("done"))
    return g.where("done = 0").select("run_id", "started_at")


@query("t6_recent_wisdom", "SELECT id, ts FROM wisdom ORDER BY ts DESC, id LIMIT 100")
def recent_wisdom(spark, d):
    return T.wisdom(spark, d).orderBy(F.desc("ts"), "id").limit(100).select("id", "ts")


@query("sc1_newest_active", "SELECT id, created_at FROM memories WHERE superseded_by IS NULL AND category = 'project' ORDER BY created_at DESC, id LIMIT 100")
def newest_active(spark, d):
    return T.memories(spark, d).where("superseded_by is null and category = 'project'").orderBy(F.desc("created_at"), "id").limit(100).select("id", "created_at")


@query("sc5_entity_access", f"SELECT id, name, {NOW_SQL} AS last_accessed_at FROM entities WHERE replace(lower(trim(name)), ' ', '_') = 'nation_3' AND entity_type = 'nation'")
def entity_access(spark, d):
    """The entity of a name and type, and the access that finding it adds to the log."""
    from palimpsest.functions import scalars as S

    found = T.entities(spark, d).where((S.canonical_name(F.col("name")) == "nation_3") & (F.col("entity_type") == "nation"))
    return found.select("id", "name", now().alias("last_accessed_at"))


@query("t7_filled_context", f"""WITH core AS (SELECT id, 0 AS tier, row_number() OVER (ORDER BY created_at DESC, id) AS r FROM memories WHERE category = 'identity' AND superseded_by IS NULL QUALIFY r <= 5),
 filler AS (SELECT id, 1 AS tier, row_number() OVER (ORDER BY CASE category WHEN 'family' THEN 0 WHEN 'preference' THEN 1 ELSE 2 END, created_at DESC, id) AS r FROM memories WHERE superseded_by IS NULL QUALIFY r <= 45),
 firsts AS (SELECT id, min(tier) AS tier, arg_min(r, (tier, r)) AS r FROM (SELECT * FROM core UNION ALL SELECT * FROM filler) GROUP BY id), taken AS (SELECT *, row_number() OVER (ORDER BY tier, r, id) AS place FROM firsts QUALIFY place <= 15)
 SELECT string_agg('<' || category || '>' || subject || '</' || category || '>', chr(10) ORDER BY place) AS context FROM taken JOIN memories USING (id)""")
def filled_context(spark, d):
    """Core memories and a filler by priority under one budget, rendered as tagged text."""
    live = T.memories(spark, d).where("superseded_by is null")
    rank = F.when(F.col("category") == "family", 0).when(F.col("category") == "preference", 1).otherwise(2)
    core = live.where("category = 'identity'").orderBy(F.desc("created_at"), "id").limit(5)
    fill = live.withColumn("p", rank).orderBy("p", F.desc("created_at"), "id").limit(45)
    number = lambda rows, *order: rows.select(F.lit(0).alias("query_id"), "id", F.row_number().over(Window.orderBy(*order)).alias("tier_rank"))  # noqa: E731  (45 rows at most)
    first = R.tiered([number(core, F.desc("created_at"), "id"), number(fill, "p", F.desc("created_at"), "id")], 15)
    told = first.join(live.select("id", "category", "subject"), "id").select("place", F.format_string("<%s>%s</%s>", "category", "subject", "category").alias("line"))
    return told.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("context"))


@query("t12_newest_rows", "SELECT id FROM memories WHERE superseded_by IS NULL ORDER BY created_at DESC, id LIMIT 10000")
def newest_rows(spark, d):
    """The newest 10,000 rows, which is all that a maintenance run used to look at; ours takes all."""
    return T.memories(spark, d).where("superseded_by is null").orderBy(F.desc("created_at"), "id").limit(10_000).select("id")


@query("t13_category_samples", """WITH top AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY importance DESC, id) AS r FROM memories WHERE superseded_by IS NULL QUALIFY r <= 50)
 SELECT id, category FROM top WHERE r <= 5 UNION ALL SELECT id, category FROM (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || id), id) AS n FROM top WHERE r > 5 QUALIFY n <= 10)""")
def category_samples(spark, d):
    """Of each category the five most important of the top fifty, and ten of the others by seeded hash."""
    w = Window.partitionBy("category").orderBy(F.desc("importance"), "id")
    top = T.memories(spark, d).where("superseded_by is null").withColumn("r", F.row_number().over(w)).where("r <= 50")
    rest = top.where("r > 5").withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy(F.md5(F.concat(F.lit("42:"), "id")), "id"))).where("n <= 10")
    return top.where("r <= 5").select("id", "category").unionByName(rest.select("id", "category"))


@query("ag5_by_owner", f"SELECT coalesce(commitment_type, 'all') AS kind, coalesce(owner, 'all') AS owner, count(*) AS total, count(*) FILTER ({_LIVE}) AS active, count(*) FILTER ({_LIVE} AND deadline < {_AT}) AS overdue FROM commitments GROUP BY GROUPING SETS ((), (commitment_type), (owner))")
def stats_by_owner(spark, d):
    live = F.expr(_LIVE)
    g = T.commitments(spark, d).groupingSets([[], ["commitment_type"], ["owner"]], "commitment_type", "owner")
    counted = g.agg(F.count("*").alias("total"), F.count_if(live).alias("active"), F.count_if(live & F.expr(f"deadline < {_AT}")).alias("overdue"))
    return counted.select(F.coalesce("commitment_type", F.lit("all")).alias("kind"), F.coalesce("owner", F.lit("all")).alias("owner"), "total", "active", "overdue")


@query("ag6_run_totals", """WITH r AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS run_id, count(*) AS n, sum(length(props)) AS tokens, avg(value) FILTER (event_type = 'purchase') AS feedback, count(DISTINCT event_type) AS tier FROM events GROUP BY 1)
 SELECT tier, count(*) AS n_runs, round(avg(tokens), 0) AS tokens, round(avg(feedback), 2) AS feedback, round(avg(n), 1) AS n_steps FROM r GROUP BY tier""")
def run_totals(spark, d):
    """Runs by tier (here their kinds of steps): mean tokens, feedback and steps."""
    e = T.raw(spark, d, "events").withColumn("run_id", F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")))
    r = e.groupBy("run_id").agg(F.count("*").alias("n"), F.sum(F.length("props")).alias("tokens"), F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("feedback"), F.count_distinct("event_type").alias("tier"))
    return r.groupBy("tier").agg(F.count("*").alias("n_runs"), F.round(F.avg("tokens"), 0).alias("tokens"), F.round(F.avg("feedback"), 2).alias("feedback"), F.round(F.avg("n"), 1).alias("n_steps"))


@query("ag21_first_entities", "SELECT entity_type, lower(trim(name)) AS key, min(id) AS id FROM entities GROUP BY ALL")
def first_entities(spark, d):
    """Migration: of entities with one type and name the first stays."""
    return T.entities(spark, d).groupBy("entity_type", F.lower(F.trim("name")).alias("key")).agg(F.min("id").alias("id"))


@query("c3_chunk_rows", """SELECT o_custkey AS id, ((n - 1) // 20)::INTEGER AS chunk, string_agg('o_orderkey: ' || o_orderkey || CASE WHEN trim(o_orderstatus) <> '' THEN chr(10) || 'o_orderstatus: ' || o_orderstatus ELSE '' END, chr(10) || '---' || chr(10) ORDER BY n) AS content FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY 1, 2""")
def chunk_rows(spark, d):
    return C.chunk_rows(T.raw(spark, d, "orders"), "o_custkey", "o_orderkey", C.key_values(["o_orderkey", "o_orderstatus"]))


@query("c4_chunk_json", """SELECT event_id AS id, 0 AS chunk, 'object' AS kind, '{' || chr(10) || '  "k": ' || json_extract(props, '$.k')::VARCHAR || chr(10) || '}' AS content FROM events""")
def chunk_json(spark, d):
    """Each event's properties as one chunk, shown with two spaces of indentation."""
    return C.chunk_json(T.raw(spark, d, "events"), "event_id", "props", least=5)


@query("c4_chunk_lines", """SELECT user_id AS id, count(*) AS lines FROM events GROUP BY user_id HAVING count(*) * 12 >= 50""")
def chunk_lines(spark, d):
    """A user's properties as lines of JSON: packed, no line is lost."""
    docs = T.raw(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("props")), "\n").alias("content"))
    made = C.chunk_json(docs, "user_id", size=300, least=0)
    return made.groupBy("id").agg(F.sum(F.size(F.split("content", '"k"')) - 1).alias("lines"))


@query("c5_chunk_pages", "SELECT conv_id AS id, count(*) FILTER (trim(text) <> '') AS pages FROM conversations GROUP BY conv_id HAVING sum(length(trim(text))) > 0")
def chunk_pages(spark, d):
    """Turns as pages: with no least length every page is in one chunk."""
    pages = T.raw(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("page"), "text")
    held = C.chunk_pages(pages, 500, 0).select("id", F.explode(F.sequence("first_page", "last_page")).alias("page"))
    return held.join(pages.where("trim(text) <> ''").select("id", "page"), ["id", "page"]).groupBy("id").agg(F.count("*").alias("pages"))


@query("x10_reorganise", "SELECT 'orphans' AS step, count(*) AS n FROM entities e WHERE NOT EXISTS (SELECT 1 FROM (SELECT subject_id AS id FROM relationships UNION SELECT object_id FROM relationships) r WHERE r.id = e.id) UNION ALL SELECT 'paths', count(DISTINCT object_id) FROM relationships WHERE predicate = 'located_in' AND valid_to IS NULL")
def reorganise(spark, d):
    """The job in full mode: orphans that would go and paths that are cached."""
    from palimpsest.operators import graph as G
    from palimpsest.operators import writes as W

    edges = T.relationships(spark, d)
    count = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n")
    return count("orphans", G.orphans(T.entities(spark, d), edges)).unionByName(count("paths", W.cached_paths(edges, "located_in", now())))


@query("x11_steps_json", "SELECT run_id, count(*) AS n, count(*) FILTER (success) AS good FROM steps GROUP BY run_id")
def steps_json(spark, d):
    """Runs' steps to JSON and back."""
    told = T.runs(spark, d).select("run_id", F.to_json("steps").alias("j"))
    back = told.select("run_id", F.from_json("j", "array<struct<tool_name:string,success:boolean>>").alias("s"))
    return back.select("run_id", F.size("s").cast("long").alias("n"), F.size(F.filter("s", lambda x: x["success"])).cast("long").alias("good"))


@query("x12_rejected_requests", "SELECT doc_id, CASE WHEN length(text) = 0 OR text IS NULL THEN 'empty' WHEN length(text) > 5000 THEN 'too long' WHEN array_length(string_split(source, 'c')) > 20 THEN 'too many tags' WHEN length(lang) <> 2 THEN 'bad language' END AS reason FROM documents WHERE length(text) = 0 OR text IS NULL OR length(text) > 5000 OR array_length(string_split(source, 'c')) > 20 OR length(lang) <> 2")
def rejected_requests(spark, d):
    reason = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "empty").when(F.length("text") > 5000, "too long").when(F.size(F.split("source", "c")) > 20, "too many tags").when(F.length("lang") != 2, "bad language")
    return T.raw(spark, d, "documents").select("doc_id", reason.alias("reason")).where("reason is not null")


@query("x14_bootstrap", """SELECT 'category' AS part, category AS name, count(*) AS n FROM memories WHERE superseded_by IS NULL GROUP BY category UNION ALL SELECT 'core', id::VARCHAR, 1 FROM (SELECT id FROM memories WHERE superseded_by IS NULL AND category IN ('family', 'identity', 'preference') ORDER BY CASE category WHEN 'family' THEN 0 WHEN 'identity' THEN 1 ELSE 2 END, created_at DESC, id LIMIT 10)""")
def bootstrap(spark, d):
    """A session's beginning: the categories and the core memories."""
    live = T.memories(spark, d).where("superseded_by is null")
    rank = F.when(F.col("category") == "family", 0).when(F.col("category") == "identity", 1).otherwise(2)
    core = live.where("category in ('family', 'identity', 'preference')").withColumn("p", rank).orderBy("p", F.desc("created_at"), "id").limit(10)
    counts = live.groupBy("category").agg(F.count("*").alias("n")).select(F.lit("category").alias("part"), F.col("category").alias("name"), "n")
    return counts.unionByName(core.select(F.lit("core").alias("part"), F.col("id").cast("string").alias("name"), F.lit(1).cast("long").alias("n")))


@query("v10_mock_embeddings", "SELECT item_id, round((('0x' || substr(sha256(text), 1, 2))::INT) / 255, 6) AS first, round((('0x' || substr(sha256(text), 63, 2))::INT) / 255, 6) AS last FROM benchmark")
def mock_embeddings(spark, d):
    """The bytes of a text's SHA-256 over 255, repeated to 64 numbers."""
    x = T.raw(spark, d, "benchmark").select("item_id", hashed.mock_embedding(F.col("text")).alias("e"))
    return x.select("item_id", F.round(F.col("e")[0], 6).alias("first"), F.round(F.col("e")[63], 6).alias("last"))


@query("v9_cluster_embeddings", "SELECT item_id, CASE WHEN regexp_matches(lower(text), '(the|and|of)') THEN 1 ELSE 0 END AS keyed, 1.0::DOUBLE AS norm FROM benchmark")
def cluster_embeddings(spark, d):
    """Unit vectors that blend the centroids of the clusters whose keywords a text holds with noise from its hash."""
    clusters = {"a": ["the", "and"], "b": ["of"]}
    x = T.raw(spark, d, "benchmark").select("item_id", hashed.cluster_hits(F.col("text"), clusters).alias("hits"), hashed.cluster_embedding(F.col("text"), clusters).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v))
    return x.select("item_id", (F.aggregate("hits", F.lit(0), lambda s, v: s + v) > 0).cast("int").alias("keyed"), F.round(norm, 6).alias("norm"))
