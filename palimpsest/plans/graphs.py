"""Knowledge-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from palimpsest.operators import graph as G
from palimpsest.plans.base import query
from palimpsest.sources import tables as T

_AT = "TIMESTAMP '1996-01-01 00:00:00'"


@query("j3_labelled_edges", "SELECT e.subject_id, s.name AS subject_name, e.predicate, o.name AS object_name FROM relationships e JOIN entities s ON s.id = e.subject_id LEFT JOIN entities o ON o.id = e.object_id")
def labelled_edges(spark, d):
    edges = T.relationships(spark, d)
    return G.labelled(edges, T.entities(spark, d)).select("subject_id", "subject_name", "predicate", "object_name")


@query("j4_other_endpoint", "SELECT DISTINCT CASE WHEN subject_id = 'nation:3' THEN object_id ELSE subject_id END AS other FROM relationships WHERE (subject_id = 'nation:3' OR object_id = 'nation:3') AND valid_to IS NULL")
def other_endpoint(spark, d):
    return G.both_ways(G.active(T.relationships(spark, d))).where("id = 'nation:3'").select("other").distinct()


@query("j6_orphans", "SELECT e.id, name FROM entities e ANTI JOIN (SELECT subject_id AS id FROM relationships UNION SELECT object_id FROM relationships) r ON r.id = e.id")
def orphans(spark, d):
    return G.orphans(T.entities(spark, d), T.relationships(spark, d)).select("id", "name")


@query("j7_semi_ids", "SELECT id, category FROM memories WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_ids(spark, d):
    toxic = T.raw(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return T.memories(spark, d).join(toxic, "id", "left_semi").select("id", "category")


@query("g1_pattern", "SELECT subject_id, object_id, confidence FROM relationships WHERE predicate = 'supplies' AND valid_to IS NULL AND confidence >= 0.95::DOUBLE")
def graph_pattern(spark, d):
    found = G.pattern(T.relationships(spark, d).where("confidence >= 0.95D"), T.entities(spark, d), "supplier", "supplies", "part")
    return found.select("subject_id", "object_id", "confidence")


@query("g2_relationships", "SELECT predicate, object_id AS other, 'out' AS direction FROM relationships WHERE subject_id = 'supplier:1' UNION ALL SELECT predicate, subject_id, 'in' FROM relationships WHERE object_id = 'supplier:1' AND subject_id <> object_id")
def entity_relationships(spark, d):
    edges = T.relationships(spark, d)
    out = edges.where("subject_id = 'supplier:1'").select("predicate", F.col("object_id").alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(edges.where("object_id = 'supplier:1' and subject_id <> object_id").select("predicate", F.col("subject_id").alias("other"), F.lit("in").alias("direction")))


@query("g3_profile", "SELECT subject_id, predicate, count(*) AS n, count(DISTINCT object_id) AS others, max(confidence) AS best FROM relationships GROUP BY subject_id, predicate")
def profile(spark, d):
    return T.relationships(spark, d).groupBy("subject_id", "predicate").agg(F.count("*").alias("n"), F.count_distinct("object_id").alias("others"), F.max("confidence").alias("best"))


@query("g4_causal_walk", """WITH RECURSIVE step AS (SELECT subject_id AS a, object_id AS b FROM relationships WHERE predicate IN ('located_in', 'part_of') UNION SELECT object_id, subject_id FROM relationships WHERE predicate IN ('located_in', 'part_of')),
 walk AS (SELECT 'region:1' AS id, 0 AS hop UNION SELECT b, hop + 1 FROM walk JOIN step ON a = id WHERE hop < 3) SELECT id, min(hop) AS hop FROM walk GROUP BY id""")
def causal_walk(spark, d):
    start = T.entities(spark, d).where("id = 'region:1'")
    return G.walk(T.relationships(spark, d), start, ["located_in", "part_of"], 3)


@query("g5_time_travel", f"SELECT subject_id, object_id, valid_from FROM relationships WHERE predicate = 'supplies' AND valid_from <= {_AT} AND (valid_to IS NULL OR valid_to > {_AT})")
def time_travel(spark, d):
    return G.as_of(T.relationships(spark, d).where("predicate = 'supplies'"), F.expr(_AT)).select("subject_id", "object_id", "valid_from")


@query("j12_as_of_join", "SELECT o_orderkey, count(*) AS live FROM orders JOIN (SELECT l_orderkey, l_shipdate AS f, l_shipdate + INTERVAL 30 DAY AS t FROM lineitem) ON l_orderkey = o_orderkey AND f <= o_orderdate + INTERVAL 60 DAY AND t > o_orderdate + INTERVAL 60 DAY GROUP BY o_orderkey")
def as_of_join(spark, d):
    line = T.raw(spark, d, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("f"))
    at = F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")
    live = (F.col("f") <= at) & (F.col("f") + F.expr("INTERVAL 30 DAYS") > at)
    return T.raw(spark, d, "orders").join(line, (F.col("l_orderkey") == F.col("o_orderkey")) & live).groupBy("o_orderkey").agg(F.count("*").alias("live"))


@query("g6_normalized_names", r"""SELECT id, CASE WHEN length(c) > 4 AND ends_with(c, 's') AND NOT ends_with(c, 'ss') THEN left(c, length(c) - 1) ELSE c END AS canonical FROM (
 SELECT id, regexp_replace(replace(regexp_replace(replace(lower(trim(name)), '-', '_'), '\s*\([^)]*\)\s*$', ''), ' ', '_'), '_(service|server|app|api|project|system|tool|library)$', '') AS c FROM entities)""")
def normalized_names(spark, d):
    return T.entities(spark, d).select("id", S.normalized_name(F.col("name")).alias("canonical"))
