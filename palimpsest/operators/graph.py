"""Temporal knowledge graph: patterns, neighbours, time travel, causal walks, degrees, state, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.storage import written


def active(edges: DataFrame) -> DataFrame:
    return edges.where("valid_to is null")


def as_of(edges: DataFrame, at: Column) -> DataFrame:
    """Edges whose half-open interval [valid_from, valid_to) holds the time."""
    return edges.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def labelled(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the subject's and, where the object is an entity, the object's name and type."""
    subject = entities.select(F.col("id").alias("subject_id"), F.col("name").alias("subject_name"), F.col("entity_type").alias("subject_type"))
    obj = entities.select(F.col("id").alias("object_id"), F.col("name").alias("object_name"), F.col("entity_type").alias("object_type"))
    return edges.join(subject, "subject_id").join(obj, "object_id", "left")


def pattern(edges: DataFrame, entities: DataFrame, subject_type: str | None = None, predicate: str | None = None, object_type: str | None = None, expired: bool = False) -> DataFrame:
    """Labelled edges of a pattern; the predicate filters before the joins."""
    if not expired:
        edges = active(edges)
    if predicate:
        edges = edges.where(F.col("predicate") == predicate)
    out = labelled(edges, entities)
    if subject_type:
        out = out.where(F.col("subject_type") == subject_type)
    return out.where(F.col("object_type") == object_type) if object_type else out


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, other, predicate): each edge from either end; one row for a loop."""
    out = edges.select(F.col("subject_id").alias("id"), F.col("object_id").alias("other"), "predicate")
    back = edges.where("subject_id <> object_id").select(F.col("object_id").alias("id"), F.col("subject_id").alias("other"), "predicate")
    return out.unionByName(back)


def degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("subject_id").alias("id")).unionAll(edges.select(F.col("object_id").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities on no edge: one anti join against both ends."""
    ends = edges.select(F.col("subject_id").alias("id")).unionAll(edges.select(F.col("object_id").alias("id")))
    return entities.join(ends.distinct(), "id", "left_anti")


def walk(edges: DataFrame, start: DataFrame, predicates: list[str], hops: int) -> DataFrame:
    """(id, hop): breadth-first from ``start`` (id) over those predicates in both directions.

    A bounded number of rounds; each is a join with the frontier and an anti join with what
    was seen, so work follows the frontier.  Frontiers are written, so that no round repeats those before it.
    """
    steps = written(both_ways(edges.where(F.col("predicate").isin(*predicates))).select("id", "other").distinct(), "steps")
    seen = start.select("id", F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, hops + 1):
        ahead = frontier.join(steps, "id").select(F.col("other").alias("id")).distinct()
        frontier = written(ahead.join(seen, "id", "left_anti").select("id", F.lit(hop).alias("hop")), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def keep_best(edges: DataFrame) -> DataFrame:
    """One edge of each (subject, predicate, object): most confident, then earliest."""
    w = Window.partitionBy("subject_id", "predicate", "object_id").orderBy(F.desc("confidence"), F.asc("valid_from"), F.col("valid_to").asc_nulls_last())
    return edges.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def close_intervals(history: DataFrame, keys: list[str]) -> DataFrame:
    """Slowly changing values: each row's validity ends where the next of its key begins."""
    w = Window.partitionBy(*keys).orderBy("valid_from")
    return history.withColumn("valid_to", F.lead("valid_from").over(w))


def merge_entities(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with duplicates' ids replaced by their keepers' ((dup_id, keeper_id)), loops and repeats removed."""
    left = mapping.select(F.col("dup_id").alias("subject_id"), F.col("keeper_id").alias("ks"))
    right = mapping.select(F.col("dup_id").alias("object_id"), F.col("keeper_id").alias("ko"))
    moved = edges.join(left, "subject_id", "left").join(right, "object_id", "left")
    moved = moved.withColumn("subject_id", F.coalesce("ks", "subject_id")).withColumn("object_id", F.coalesce("ko", "object_id"))
    return keep_best(moved.select(*edges.columns).where("subject_id <> object_id"))
