"""Information-retrieval metrics over ranked rows and judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.storage import small


def judged_alike(rows: DataFrame, queries: DataFrame, asked: DataFrame | None = None, most: int = 0) -> DataFrame:
    """(query_id, id, rel): of the judgments that call every other row of a query's label relevant those that a metric needs.

    ``rows`` is (id, label), ``queries`` (query_id, label).  Taken are those of the results ``asked`` and, for the
    ideal order, the ``most`` of least id for each query; the others, which grow with queries times rows, are never listed.
    """
    parts = []
    if asked is not None:
        own = asked.select("query_id", "id").distinct().join(queries.withColumnRenamed("label", "wanted"), "query_id").join(rows.select("id", "label"), "id")
        parts.append(own.where("label = wanted and id <> query_id").select("query_id", "id"))
    if most:
        ids = F.slice(F.array_sort(F.collect_list("id")), 1, most + 1)  # a query's own row may be among them
        place = F.row_number().over(Window.partitionBy("label").orderBy("id"))
        first = rows.select("label", "id").withColumn("n", place).where(F.col("n") <= most + 1).groupBy("label").agg(ids.alias("ids"))
        listed = queries.join(small(first), "label").select("query_id", F.explode(F.slice(F.filter("ids", lambda x: x != F.col("query_id")), 1, most)).alias("id"))
        parts.append(listed)
    found = parts[0] if len(parts) == 1 else parts[0].union(parts[1]).distinct()
    return found.withColumn("rel", F.lit(1.0))


def ndcg(results: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg): gain 2^rel - 1, discount log2(rank + 1); 0 where nothing is relevant."""
    gain = lambda r: (F.pow(F.lit(2.0), r) - 1.0) / F.log2(F.col("rank") + 1.0)
    got = results.where(F.col("rank") <= k).join(judgments, ["query_id", "id"]).groupBy("query_id").agg(F.sum(gain(F.col("rel"))).alias("dcg"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rel"), "id")
    best = judgments.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain(F.col("rel"))).alias("idcg"))
    return best.join(got, "query_id", "left").select("query_id", F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)).alias("ndcg"))


def mrr(results: DataFrame, judgments: DataFrame) -> DataFrame:
    hits = results.join(judgments.where("rel > 0"), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    return results.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def precision(results: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    top = results.where(F.col("rank") <= k).join(judgments.where("rel > 0").select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return top.groupBy("query_id").agg((F.count("hit") / F.lit(float(k))).alias("precision"))


def concordance(results: DataFrame) -> DataFrame:
    """(query_id, concordance): of the pairs of results with different dates (query_id, id, rank, created_at) the share that has the newer first; 0.5 without any."""
    a = results.select("query_id", F.col("rank").alias("x"), F.col("created_at").alias("at"))
    b = results.select("query_id", F.col("rank").alias("y"), F.col("created_at").alias("later"))
    pairs = a.join(b, "query_id").where("x < y")
    counted = pairs.groupBy("query_id").agg(F.count_if(F.col("at") > F.col("later")).alias("c"), F.count_if(F.col("at") < F.col("later")).alias("d"))
    return results.select("query_id").distinct().join(counted, "query_id", "left").select("query_id", F.coalesce(F.try_divide("c", F.col("c") + F.col("d")), F.lit(0.5)).alias("concordance"))


def temporal_score(results: DataFrame, memories: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recency, concordance, score): 0.6 times the results' mean place in the span of all dates and 0.4 times their order by date; 0.5 for fewer than two."""
    dated = results.where(F.col("rank") <= k).join(memories.select("id", "created_at"), "id").where("created_at is not null")
    span = memories.where("superseded_by is null").agg(F.min(F.col("created_at").cast("double")).alias("low"), F.max(F.col("created_at").cast("double")).alias("high"))  # one row
    place = (F.col("created_at").cast("double") - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    recent = dated.crossJoin(F.broadcast(span)).groupBy("query_id").agg(F.avg(place).alias("recency"), F.count("*").alias("n"))
    joined = recent.join(concordance(dated), "query_id")
    return joined.select("query_id", "recency", "concordance", F.when(F.col("n") < 2, 0.5).otherwise(0.6 * F.col("recency") + 0.4 * F.col("concordance")).alias("score"))


def share_on_topic(results: DataFrame, judgments: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, share): relevant results among the first k, as a share of those returned."""
    hits = results.where(F.col("rank") <= k).join(judgments.where("rel > 0").select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("share"))


def session_score(with_session: DataFrame, without: DataFrame, judgments: DataFrame) -> DataFrame:
    """(query_id, score): 1 where the session brings more on-topic results, 0.5 where as many, 0 where fewer."""
    both = share_on_topic(with_session, judgments).join(share_on_topic(without, judgments).withColumnRenamed("share", "alone"), "query_id")
    return both.select("query_id", F.when(F.col("share") > F.col("alone"), 1.0).when(F.col("share") == F.col("alone"), 0.5).otherwise(0.0).alias("score"))


def graph_score(full: DataFrame, vector: DataFrame, subjects: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, uplift, coverage, score): results that vectors alone miss, up to three, and how many more subjects are covered."""
    top, alone = full.where(F.col("rank") <= k), vector.where(F.col("rank") <= k)
    new = top.join(alone, ["query_id", "id"], "left_anti").groupBy("query_id").agg(F.count("*").alias("new"))
    kinds = lambda rows, c: rows.join(subjects, "id").groupBy("query_id").agg(F.count_distinct("subject").alias(c))
    joined = kinds(top, "covered").join(kinds(alone, "base"), "query_id", "left").join(new, "query_id", "left")
    uplift = F.least(F.coalesce("new", F.lit(0)) / 3.0, F.lit(1.0))
    coverage = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("covered") / F.col("base") - 1.0, F.lit(1.0))))
    return joined.select("query_id", uplift.alias("uplift"), coverage.alias("coverage"), (0.5 * uplift + 0.5 * coverage).alias("score"))


def consolidation_score(queries: DataFrame, results: DataFrame, superseded: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, score): 0 where a superseded row is among the first k, else 1; 0.5 without results."""
    top = results.where(F.col("rank") <= k).join(superseded.select("id", F.lit(1).alias("old")), "id", "left")
    seen = top.groupBy("query_id").agg(F.count("old").alias("old"))
    return queries.select("query_id").join(seen, "query_id", "left").select("query_id", F.when(F.col("old").isNull(), 0.5).when(F.col("old") > 0, 0.0).otherwise(1.0).alias("score"))


def protection_score(results: DataFrame, protected: DataFrame) -> DataFrame:
    """(query_id, score): 1 with a protected row among the first three, 0.5 among the first five, else 0."""
    first = results.join(protected.select("id"), "id", "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    return results.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.when(F.col("first") <= 3, 1.0).when(F.col("first") <= 5, 0.5).otherwise(0.0).alias("score"))


def decay_score(results: DataFrame, transient: DataFrame, hours: int = 48) -> DataFrame:
    """(query_id, score): 1 where the transient results (id, created_at) come newest first, 0.8 where there are none or all lie within 48 hours, else 0.3."""
    dated = results.join(transient, "id")
    w = Window.partitionBy("query_id").orderBy("rank")
    stepped = dated.withColumn("up", F.lag("created_at").over(w) < F.col("created_at"))
    seen = stepped.groupBy("query_id").agg(F.count_if("up").alias("up"), (F.max(F.col("created_at").cast("double")) - F.min(F.col("created_at").cast("double"))).alias("span"))
    joined = results.select("query_id").distinct().join(seen, "query_id", "left")
    return joined.select("query_id", F.when(F.col("up").isNull(), 0.8).when(F.col("up") == 0, 1.0).when(F.col("span") <= hours * 3600, 0.8).otherwise(0.3).alias("score"))


def proactive_score(full: DataFrame, vector: DataFrame, grades: DataFrame) -> DataFrame:
    """(query_id, score): from the shares of results graded 2 or more, 0.6 times that of the full search and 0.4 times what it adds to vectors alone, at most 1; -1 without grades."""
    share = lambda rows, c: rows.join(grades, ["query_id", "id"]).groupBy("query_id").agg((F.count_if(F.col("grade") >= 2) / F.count("*")).alias(c))
    joined = full.select("query_id").distinct().join(share(full, "full"), "query_id", "left").join(share(vector, "alone"), "query_id", "left")
    score = 0.6 * F.col("full") + 0.4 * F.greatest(F.lit(0.0), F.col("full") - F.coalesce("alone", F.lit(0.0)))
    return joined.select("query_id", F.when(F.col("full").isNull(), -1.0).otherwise(F.least(score, F.lit(1.0))).alias("score"))


def recall(results: DataFrame, judgments: DataFrame, k: int, totals: DataFrame | None = None) -> DataFrame:
    """(query_id, recall): relevant rows among the first k, as a share of all relevant rows.

    With ``totals``, (query_id, all), judgments need hold those of the results only.
    """
    good = judgments.where("rel > 0").select("query_id", "id")
    hits = results.where(F.col("rank") <= k).join(good, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    totals = good.groupBy("query_id").agg(F.count("*").alias("all")) if totals is None else totals
    return totals.join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.col("all")).alias("recall"))


def tail_queries(judgments: DataFrame, surfacing: DataFrame, bound: int = 30) -> DataFrame:
    """(query_id) of queries with a relevant row that was surfaced fewer than ``bound`` times."""
    return judgments.where("rel > 0").join(surfacing.where(F.col("surfacing_count") < bound).select("id"), "id", "left_semi").select("query_id").distinct()


def composite(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(composite): the weighted mean of the categories (category, score) that were scored: null and -1 don't count."""
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("category") == name, w).otherwise(weight)
    return scores.where("score >= 0").withColumn("w", weight).agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("composite"))
