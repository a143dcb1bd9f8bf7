"""Writes as set operations: each returns the next state of a table, or what it would change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalars as S

#: Most characters of a memory's content and category, of its metadata as JSON, and of an edge's literal value.
CONTENT, CATEGORY, METADATA, VALUE = 50_000, 50, 10_000, 2000


def find_or_create(entities: DataFrame, incoming: DataFrame) -> DataFrame:
    """(name, entity_type, id, created): each incoming name's entity, by canonical name, else by normalised name, within its type.

    Names are reduced to safe characters first; those too short have a null id.  Names that no entity has
    get one new entity for each type and canonical name.
    """
    clean = incoming.select("name", "entity_type", S.safe_name(F.col("name")).alias("safe")).distinct()
    keyed = clean.withColumn("canonical", S.canonical_name(F.col("safe"))).withColumn("normal", S.normalized_name(F.col("safe")))
    exact = entities.groupBy("entity_type", S.canonical_name(F.col("name")).alias("canonical")).agg(F.min("id").alias("exact"))
    near = entities.groupBy("entity_type", S.normalized_name(F.col("name")).alias("normal")).agg(F.min("id").alias("near"))
    joined = keyed.join(exact, ["entity_type", "canonical"], "left").join(near, ["entity_type", "normal"], "left")
    known = F.coalesce("exact", "near")
    made = F.when(F.col("safe").isNotNull(), F.concat_ws(":", "entity_type", F.lit("new"), "canonical"))
    return joined.select("name", "entity_type", F.coalesce(known, made).alias("id"), (known.isNull() & F.col("safe").isNotNull()).alias("created"))


def safe_inputs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of rows (id, content, category, metadata): cut to the most characters; null or blank content and too long metadata are rejected, with the reason."""
    reason = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "no content").when(F.length("metadata") > METADATA, "metadata too long")
    judged = rows.withColumn("reason", reason)
    cut = judged.where("reason is null").withColumns({"content": F.substring("content", 1, CONTENT), "category": F.substring("category", 1, CATEGORY)}).drop("reason")
    return cut, judged.where("reason is not null").select("id", "reason")


def expire(edges: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    """The edges, open ones of those (subject_id, predicate, object_id) closed at that time; closed ones stay as they are."""
    named = ["subject_id", "predicate", "object_id"]
    joined = edges.join(keys.select(*named, F.lit(True).alias("_gone")).distinct(), named, "left")
    return joined.withColumn("valid_to", F.when(F.col("valid_to").isNull() & F.col("_gone"), at).otherwise(F.col("valid_to"))).select(*edges.columns)


def update_values(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Slowly changing values: the oldest open edge of each changed (subject_id, predicate) ends at ``at``, and one to ``object_id`` begins there.

    The new edge has confidence 1.  Of several changes of one key the newest counts; a change without an
    open edge only begins one.
    """
    last = changes.groupBy("subject_id", "predicate").agg(F.max_by(F.struct("object_id", "at"), F.struct("at", "object_id")).alias("c"))
    last = last.select("subject_id", "predicate", F.col("c.object_id").alias("_new"), F.col("c.at").alias("_at"))
    open_first = Window.partitionBy("subject_id", "predicate").orderBy(F.col("valid_to").isNotNull(), "valid_from", "object_id")
    joined = edges.join(last, ["subject_id", "predicate"], "left").withColumn("_n", F.when(F.col("_at").isNotNull() & F.col("valid_to").isNull(), F.row_number().over(open_first)))
    old = joined.withColumn("valid_to", F.when(F.col("_n") == 1, F.col("_at")).otherwise(F.col("valid_to"))).select(*edges.columns)
    fresh = last.select("subject_id", "predicate", F.col("_new").alias("object_id"), F.col("_at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(1.0).alias("confidence"))
    return old.unionByName(fresh, allowMissingColumns=True)


def apply_events(rows: DataFrame, events: DataFrame, fields: dict[str, str], deleted: str) -> DataFrame:
    """Rows (id, …) after events (id, at, seq, field, value): the newest value of each allowed field wins; ``deleted`` events remove the row.

    ``fields`` gives the allowed fields and their types; events of other fields, and values that don't fit the type, change nothing.
    """
    order = F.struct("at", "seq")
    cast = {f: F.col("value").try_cast(t) for f, t in fields.items()}
    last = [F.max_by(cast[f], F.when((F.col("field") == f) & cast[f].isNotNull(), order)).alias(f"_{f}") for f in fields]
    state = events.groupBy("id").agg(*last, F.max(F.col("field") == deleted).alias("_deleted"))
    joined = rows.join(state, "id", "left").where(~F.coalesce("_deleted", F.lit(False)))
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns))


def advance(updates: DataFrame) -> DataFrame:
    """(id, status, completed_at, context): state after status updates (id, at, seq, status): the newest status, when it last became completed, and all statuses in order."""
    order = F.struct("at", "seq")
    done = F.max(F.when(F.col("status") == "completed", F.col("at")))
    told = F.array_sort(F.collect_list(F.struct("at", "seq", "status")))
    state = updates.groupBy("id").agg(F.max_by("status", order).alias("status"), done.alias("_done"), F.array_join(F.transform(told, lambda s: s["status"]), ",").alias("context"))
    return state.select("id", "status", F.when(F.col("status") == "completed", F.col("_done")).alias("completed_at"), "context")


def run_records(events: DataFrame) -> DataFrame:
    """(run_id, outcome, completed_at, steps): runs from their events (run_id, at, seq, kind, arguments, result, error, outcome).

    Steps are cut to 500, 500 and 200 characters of arguments, result and error.  A run is pending until its
    first completion; later ones change nothing.
    """
    order = F.struct("at", "seq")
    step = F.when(F.col("kind") == "step", F.struct("at", "seq", F.substring("arguments", 1, 500).alias("arguments"), F.substring("result", 1, 500).alias("result"), F.substring("error", 1, 200).alias("error")))
    first = F.min_by(F.struct("outcome", "at"), F.when(F.col("kind") == "complete", order))
    made = events.groupBy("run_id").agg(first.alias("c"), F.array_sort(F.collect_list(step)).alias("steps"))
    return made.select("run_id", F.coalesce("c.outcome", F.lit("pending")).alias("outcome"), F.when(F.col("c.outcome").isNotNull(), F.col("c.at")).alias("completed_at"), "steps")


def retrieval_log(results: DataFrame, queries: DataFrame, at: Column) -> DataFrame:
    """(query_id, query_hash, at, candidates, returned): what a batch of retrievals (query_id, id, rank, features) logs."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "id", "features")))
    grouped = results.groupBy("query_id").agg(F.count("*").alias("candidates"), listed.alias("l"))
    returned = F.map_from_entries(F.transform("l", lambda x: F.struct(x["id"], x["features"])))
    hashed = queries.select("query_id", F.substring(F.sha2("text", 256), 1, 16).alias("query_hash"))
    return grouped.join(hashed, "query_id").select("query_id", "query_hash", at.alias("at"), "candidates", returned.alias("returned"))


def surfaced(logs: DataFrame) -> DataFrame:
    """(id, surfacing): how often each row was returned, from the keys of the logs' maps."""
    return logs.select(F.explode(F.map_keys("returned")).alias("id")).groupBy("id").agg(F.count("*").alias("surfacing"))


def cached_paths(edges: DataFrame, predicate: str, now: Column, hours: int = 1) -> DataFrame:
    """(source, members, expires_at): the live neighbours by one predicate of each object, to be read until they expire."""
    live = edges.where((F.col("predicate") == predicate) & F.col("valid_to").isNull())
    listed = live.groupBy(F.col("object_id").alias("source")).agg(F.array_sort(F.collect_set("subject_id")).alias("members"))
    return listed.withColumn("expires_at", now + F.expr(f"INTERVAL {hours} HOURS"))


def upsert_cache(cache: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """The cache without expired rows, where fresh ones replace those of the same source."""
    kept = cache.where(F.col("expires_at") > now).join(fresh.select("source"), "source", "left_anti")
    return kept.unionByName(fresh)


def tail(log: DataFrame, order: list[Column], most: int = 100) -> DataFrame:
    """The newest rows of an audit log."""
    return log.orderBy(*order).limit(most)


def confirmed_delete(rows: DataFrame, chosen: DataFrame, protected: tuple[str, ...], confirm: bool) -> tuple[DataFrame, DataFrame]:
    """(preview, next state): what a deletion of those ids removes; without confirmation the state stays."""
    gone = rows.join(chosen.select("id").distinct(), "id", "left_semi").where(~F.col("category").isin(*protected))
    return gone, rows.join(gone.select("id"), "id", "left_anti") if confirm else rows
