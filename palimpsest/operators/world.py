"""The state of the world that the graph describes: stale entities, projects, activity, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stale_entities(entities: DataFrame, cutoff: Column, most: int | None = 50) -> DataFrame:
    """Entities neither accessed nor updated since the cutoff (null counts as never), the longest untouched first."""
    old = lambda c: F.col(c).isNull() | (F.col(c) < cutoff)
    found = entities.where(old("last_accessed_at") & old("updated_at"))
    return found if most is None else found.orderBy(F.coalesce("last_accessed_at", "updated_at").asc_nulls_first(), "id").limit(most)


def active_projects(entities: DataFrame) -> DataFrame:
    """Projects whose metadata names an active state, or none."""
    state = F.coalesce(F.get_json_object("metadata", "$.state"), F.lit("active"))
    return entities.where((F.col("entity_type") == "project") & state.isin("active", "in_progress", "blocked"))


def activity(hour: Column, day: Column) -> tuple[Column, Column]:
    """(activity, confidence) by the hour and the day of the week from 0 for Monday."""
    weekend, rest = day >= 5, (hour < 7) | (hour >= 22)
    kind = F.when(weekend, F.when(hour < 9, "resting").otherwise("leisure")).when(hour.between(9, 17), "working").when(rest, "resting").otherwise("home")
    return kind, F.when(weekend, 0.5).when(hour.between(9, 17), 0.7).otherwise(0.6)


def with_routines(moments: DataFrame, routines: DataFrame) -> DataFrame:
    """(key, activity, confidence): each moment (key, hour, day) by the table, overridden by the first routine (id, day, from_hour, to_hour, name) that holds it.

    A routine adds 0.1 to the confidence, up to 0.95.
    """
    kind, sure = activity(F.col("hour"), F.col("day"))
    based = moments.withColumns({"kind": kind, "sure": sure})
    held = based.join(routines.withColumnRenamed("day", "on"), (F.col("day") == F.col("on")) & F.col("hour").between(F.col("from_hour"), F.col("to_hour")), "left")
    first = held.groupBy("key", "kind", "sure").agg(F.min_by("name", "id").alias("name"))
    return first.select("key", F.coalesce("name", "kind").alias("activity"), F.when(F.col("name").isNotNull(), F.least(F.col("sure") + 0.1, F.lit(0.95))).otherwise(F.col("sure")).alias("confidence"))


def set_state(entities: DataFrame, changes: DataFrame, allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(next state, rejected): each changed entity's metadata (a map) with its new state; the newest change counts, unknown states and ids are rejected."""
    good = changes.where(F.col("state").isin(*allowed)).join(entities.select("id"), "id", "left_semi")
    last = good.groupBy("id").agg(F.max_by("state", "at").alias("_state"))
    merged = F.map_concat(F.map_filter("metadata", lambda k, v: (k != "state") | F.col("_state").isNull()), F.when(F.col("_state").isNotNull(), F.create_map(F.lit("state"), F.col("_state"))).otherwise(F.create_map().cast("map<string,string>")))
    return entities.join(last, "id", "left").withColumn("metadata", merged).select(*entities.columns), changes.join(good.select("id", "at"), ["id", "at"], "left_anti")


def profiles(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, facts, related): each subject's live edges by predicate, as a map of sorted object names, and how many entities it is related to."""
    live = edges.where("valid_to is null").join(entities.select(F.col("id").alias("object_id"), "name"), "object_id", "left").withColumn("value", F.coalesce("name", "object_id"))
    by = live.groupBy(F.col("subject_id").alias("id"), "predicate").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return by.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "values")))).alias("facts"), F.sum(F.size("values")).alias("related"))


def listed(rows: DataFrame, title: str, order: list[Column], text: Column, most: int) -> DataFrame:
    """(section, place, line): the first rows as lines of a report's section."""
    first = rows.orderBy(*order).limit(most).withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # at most ``most`` rows
    return first.select(F.lit(title).alias("section"), F.col("_n").alias("place"), text.alias("line"))


def report(sections: list[DataFrame]) -> DataFrame:
    """(section, text): each section's lines in order."""
    every = sections[0]
    for s in sections[1:]:
        every = every.unionByName(s)
    lines = every.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"))
    return lines.select("section", F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["line"])), "\n").alias("text"))


def siblings(actions: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """(action, sibling): the other actions of each action's families."""
    rows = [(a, b) for own in families.values() for a in own for b in own if a != b]
    table = actions.sparkSession.createDataFrame(sorted(set(rows)) or [("", "")], "action string, sibling string")
    return actions.select("action").distinct().join(F.broadcast(table), "action")  # a handful of rows
