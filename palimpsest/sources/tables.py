"""Sources: the star-schema tables and the logical tables of the memory store derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed "now" of registered queries: results never depend on the clock.
NOW = "2024-02-01 00:00:00"
PROTECTED = ("identity", "family")

_EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memory for each document: text, category, subject, counters, age and the row that supersedes it."""
    docs, labels = raw(spark, sf_dir, "documents"), raw(spark, sf_dir, "labels")
    joined = docs.join(labels.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", "left")
    hours = lambda n: F.expr(f"timestampadd(HOUR, cast({n} as int), {_EPOCH})")
    return joined.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.expr("CASE lang WHEN 'en' THEN 'project' WHEN 'fr' THEN 'family' WHEN 'de' THEN 'identity' ELSE 'preference' END").alias("category"),
        F.col("source").alias("subject"),
        F.coalesce(F.lit(0.3) + F.lit(0.6) * F.col("quality"), F.lit(0.5)).alias("confidence"),
        hours("doc_id % 700").alias("created_at"),
        F.expr("doc_id % 7").alias("access_count"),
        F.expr("doc_id % 13").alias("surfacing_count"),
        F.expr("(doc_id % 10) / 10.0D").cast("double").alias("importance"),
        F.expr("CASE WHEN doc_id % 20 = 19 THEN doc_id - 1 END").alias("superseded_by"),
        F.expr("CASE WHEN doc_id % 5 = 0 THEN 'voice' ELSE 'chat' END").alias("origin"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, suppliers, customers and parts as typed entities."""
    parts = []
    for table, kind, key, name in (("region", "region", "r_regionkey", "r_name"), ("nation", "nation", "n_nationkey", "n_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("customer", "customer", "c_custkey", "c_name"), ("part", "part", "p_partkey", "p_name")):
        parts.append(raw(spark, sf_dir, table).select(F.concat_ws(":", F.lit(kind), F.col(key)).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("entity_type"), F.col(key).cast("long").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as edges with validity intervals, [valid_from, valid_to), and confidences."""
    begin = F.expr(_EPOCH)
    nation, supplier, customer, line = (raw(spark, sf_dir, t) for t in ("nation", "supplier", "customer", "lineitem"))

    def edge(df: DataFrame, subject: str, predicate: str, obj: str, key: str, valid_from, confidence) -> DataFrame:
        kind_s, col_s = subject.split("=")
        kind_o, col_o = obj.split("=")
        return df.select(
            F.concat_ws(":", F.lit(kind_s), F.col(col_s)).alias("subject_id"),
            F.lit(predicate).alias("predicate"),
            F.concat_ws(":", F.lit(kind_o), F.col(col_o)).alias("object_id"),
            valid_from.alias("valid_from"),
            F.when(F.col(key) % 3 == 0, F.timestamp_add("DAY", F.lit(90), valid_from)).alias("valid_to"),
            confidence.cast("double").alias("confidence"),
        )

    return (
        edge(nation, "nation=n_nationkey", "part_of", "region=n_regionkey", "n_nationkey", begin, F.lit(1.0))
        .unionByName(edge(supplier, "supplier=s_suppkey", "located_in", "nation=s_nationkey", "s_suppkey", begin, F.lit(0.9)))
        .unionByName(edge(customer, "customer=c_custkey", "lives_in", "nation=c_nationkey", "c_custkey", begin, F.lit(0.8)))
        .unionByName(edge(line, "supplier=l_suppkey", "supplies", "part=l_partkey", "l_orderkey", F.col("l_shipdate").cast("timestamp"), F.lit(1.0) - F.col("l_discount")))
    )


def commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = raw(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat_ws(":", F.lit("customer"), F.col("o_custkey")).alias("owner"),
        F.expr("CASE o_orderkey % 6 WHEN 0 THEN 'promise' WHEN 1 THEN 'follow_up' WHEN 2 THEN 'waiting_on' WHEN 3 THEN 'delegation' WHEN 4 THEN 'draft_to_send' ELSE 'reminder' END").alias("commitment_type"),
        F.expr("CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'blocked' ELSE 'completed' END END").alias("status"),
        F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN timestampadd(DAY, 30, cast(o_orderdate as timestamp)) END").alias("deadline"),
        F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'notify' ELSE '' END").alias("escalation_policy"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of runs: a run is a user's day of events."""
    return raw(spark, sf_dir, "events").select(
        F.concat_ws(":", F.col("user_id"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"),
        F.col("event_type").alias("tool_name"),
        (F.col("event_type") != "error").alias("success"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, started_at, outcome, source, steps array): failure with an error last, partial with one before."""
    last = F.element_at("s", -1)
    own = steps(spark, sf_dir).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "tool_name", "success", "value"))).alias("s"))
    outcome = F.when(~last["success"], "failure").when(F.exists("s", lambda x: ~x["success"]), "partial").otherwise("success")
    source = F.when(F.size("s") % 2 == 0, "scheduled").otherwise("manual")
    return own.select("run_id", F.col("s")[0]["ts"].alias("started_at"), outcome.alias("outcome"), source.alias("source"), F.col("s").alias("steps"))


def wisdom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("action_type"),
        F.expr("CASE WHEN event_id % 4 = 0 THEN NULL ELSE cast(event_id % 5 + 1 as int) END").alias("score"),
        F.expr("CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 3 = 0 THEN 'success' ELSE 'pending' END").alias("outcome"),
        F.col("user_id").alias("user_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors, and near copies of every third and every ninth: the first number of each is a little larger."""
    own = vectors(spark, sf_dir)
    shifted = lambda by: F.transform("embedding", lambda x, k: F.when(k == 0, x + F.lit(by)).otherwise(x))
    out = own
    for every, by in ((3, 0.05), (9, 0.1)):
        out = out.unionByName(own.where(F.col("id") % every == 0).select((F.col("id") + every * 1_000_000).alias("id"), shifted(by).alias("embedding"), "label"))
    return out


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words of the benchmark items as entities."""
    words = raw(spark, sf_dir, "benchmark").select(F.explode(_long_words()).alias("name")).distinct()
    return words.select(F.concat(F.lit("topic:"), "name").alias("id"), "name", F.lit("topic").alias("entity_type"))


def topic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each long word of an item to the next one."""
    w = raw(spark, sf_dir, "benchmark").select(_long_words().alias("w"))
    pair = w.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))).alias("p")).where("p.b is not null and p.a <> p.b")
    topic = lambda c: F.concat(F.lit("topic:"), c)
    return pair.select(topic("p.a").alias("subject_id"), F.lit("next_to").alias("predicate"), topic("p.b").alias("object_id"), F.lit(None).cast("timestamp").alias("valid_to")).distinct()


def _long_words():
    return F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda x: F.length(x) >= 7)


#: The same tables for DuckDB, as a WITH prefix of oracle queries.
SQL_TABLES = {
    "memories": f"""SELECT d.doc_id AS id, text AS content,
      CASE lang WHEN 'en' THEN 'project' WHEN 'fr' THEN 'family' WHEN 'de' THEN 'identity' ELSE 'preference' END AS category,
      source AS subject, coalesce(0.3::DOUBLE + 0.6::DOUBLE * quality, 0.5::DOUBLE) AS confidence,
      {_EPOCH} + to_hours((d.doc_id % 700)::INTEGER) AS created_at, d.doc_id % 7 AS access_count, d.doc_id % 13 AS surfacing_count,
      (d.doc_id % 10) / 10.0::DOUBLE AS importance, CASE WHEN d.doc_id % 20 = 19 THEN d.doc_id - 1 END AS superseded_by,
      CASE WHEN d.doc_id % 5 = 0 THEN 'voice' ELSE 'chat' END AS origin
      FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) q ON q.doc_id = d.doc_id""",
    "entities": " UNION ALL ".join(f"SELECT '{k}:' || {key} AS id, {name} AS name, '{k}' AS entity_type, {key}::BIGINT AS n FROM {k}" for k, key, name in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"))),
    "relationships": " UNION ALL ".join(
        f"SELECT '{s}:' || {sk} AS subject_id, '{p}' AS predicate, '{o}:' || {ok} AS object_id, {f} AS valid_from, CASE WHEN {k} % 3 = 0 THEN {f} + INTERVAL 90 DAY END AS valid_to, {c}::DOUBLE AS confidence FROM {t}"
        for t, s, sk, p, o, ok, k, f, c in (
            ("nation", "nation", "n_nationkey", "part_of", "region", "n_regionkey", "n_nationkey", _EPOCH, "1.0"),
            ("supplier", "supplier", "s_suppkey", "located_in", "nation", "s_nationkey", "s_suppkey", _EPOCH, "0.9"),
            ("customer", "customer", "c_custkey", "lives_in", "nation", "c_nationkey", "c_custkey", _EPOCH, "0.8"),
            ("lineitem", "supplier", "l_suppkey", "supplies", "part", "l_partkey", "l_orderkey", "l_shipdate", "(1.0::DOUBLE - l_discount)"),
        )
    ),
    "commitments": """SELECT o_orderkey AS id, 'customer:' || o_custkey AS owner,
      CASE o_orderkey % 6 WHEN 0 THEN 'promise' WHEN 1 THEN 'follow_up' WHEN 2 THEN 'waiting_on' WHEN 3 THEN 'delegation' WHEN 4 THEN 'draft_to_send' ELSE 'reminder' END AS commitment_type,
      CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'blocked' ELSE 'completed' END END AS status,
      CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 30 DAY END AS deadline,
      CASE WHEN o_orderkey % 4 = 0 THEN 'notify' ELSE '' END AS escalation_policy, o_orderdate AS created_at FROM orders""",
    "steps": "SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS run_id, event_type AS tool_name, event_type <> 'error' AS success, event_id, ts, value FROM events",
    "runs": """SELECT run_id, min(ts) AS started_at,
      CASE WHEN NOT arg_max(success, (ts, event_id)) THEN 'failure' WHEN bool_or(NOT success) THEN 'partial' ELSE 'success' END AS outcome,
      CASE WHEN count(*) % 2 = 0 THEN 'scheduled' ELSE 'manual' END AS source, count(*) AS n_steps FROM steps GROUP BY run_id""",
    "wisdom": """SELECT event_id AS id, ts, event_type AS action_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 5 + 1)::INTEGER END AS score,
      CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 3 = 0 THEN 'success' ELSE 'pending' END AS outcome, user_id FROM events""",
    "near_vectors": "SELECT id, embedding, label FROM vectors UNION ALL SELECT id + 3000000, list_prepend(embedding[1] + 0.05::DOUBLE, embedding[2:]), label FROM vectors WHERE id % 3 = 0 UNION ALL SELECT id + 9000000, list_prepend(embedding[1] + 0.1::DOUBLE, embedding[2:]), label FROM vectors WHERE id % 9 = 0",
    "long_words": r"SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: length(x) >= 7) AS w FROM benchmark",
    "topics": "SELECT DISTINCT 'topic:' || name AS id, name, 'topic' AS entity_type FROM (SELECT unnest(w) AS name FROM long_words)",
    "topic_edges": "SELECT DISTINCT 'topic:' || p[1] AS subject_id, 'next_to' AS predicate, 'topic:' || p[2] AS object_id, NULL::TIMESTAMP AS valid_to FROM (SELECT unnest(list_zip(w, w[2:])) AS p FROM long_words) WHERE p[2] IS NOT NULL AND p[1] <> p[2]",
    "vectors": "SELECT vec_id AS id, embedding::DOUBLE[] AS embedding, label FROM embeddings",
}


def with_tables(sql: str) -> str:
    """Oracle SQL with the logical tables that it names put before it."""
    import re

    needed: list[str] = []

    def need(text: str) -> None:
        for name in SQL_TABLES:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(SQL_TABLES[name])
                needed.append(name)

    need(sql)
    if not needed:
        return sql
    head = ", ".join(f"{n} AS ({SQL_TABLES[n]})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
