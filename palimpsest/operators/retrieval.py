"""Hybrid retrieval: signals, reciprocal rank fusion, scoring, diversity and the batched search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from palimpsest.operators.fulltext import has_phrase, held, lengths, places, tokens
from palimpsest.storage import small, written

#: Damping of each signal in the fusion.
SIGNAL_K = {"vector": 60, "bm25": 60, "graph": 30, "recency": 20, "freshness": 15}


def ranked(scored: DataFrame, signal: str, order: list[Column], most: int | None = None) -> DataFrame:
    """(query_id, id, signal, rank): ranks from 0 in that order."""
    w = Window.partitionBy("query_id").orderBy(*order)
    out = scored.withColumn("rank", F.row_number().over(w) - 1)
    if most is not None:
        out = out.where(F.col("rank") < most)
    return out.select("query_id", "id", F.lit(signal).alias("signal"), "rank")


def fuse(signals: DataFrame, k: dict[str, int] | None = None) -> DataFrame:
    """(query_id, id, rrf): the sum of 1 / (k + rank + 1) over the signals that hold the row."""
    k = k or SIGNAL_K
    damping = F.lit(60)
    for name, value in k.items():
        damping = F.when(F.col("signal") == name, value).otherwise(damping)
    return signals.groupBy("query_id", "id").agg(F.sum(1.0 / (damping + F.col("rank") + 1)).alias("rrf"))


def importance_score(now: Column, alpha: Column, half_life: float = 90.0, protected: tuple[str, ...] = ("identity", "family")) -> tuple[Column, Column]:
    """(is_primary, score) over distance, bm25, graph, importance, counters and age.

    Rows with a distance are primary and rank before the others.
    """
    aged = F.when(F.col("category").isin(*protected), 1.0).otherwise(S.decay(S.age_days(F.col("created_at"), now), half_life))
    importance = F.coalesce(F.nullif(F.col("importance"), F.lit(0.0)), F.lit(0.5))
    utility = S.propensity_utility(F.col("access_count"), F.col("surfacing_count"))
    bonus = S.frequency_bonus(F.col("access_count"), F.col("surfacing_count"))
    near = (1.0 - F.col("distance")) * ((0.7 - 0.6 * alpha) + (0.3 + 0.6 * alpha) * aged)
    graph = F.when(alpha < 0.5, 0.08).otherwise(0.03) * F.coalesce("graph", F.lit(0.0))
    primary = near + 0.03 * importance * utility + 0.03 * F.coalesce("bm25", F.lit(0.0)) + graph + bonus
    return F.col("distance").isNotNull(), F.when(F.col("distance").isNotNull(), primary).otherwise(importance * aged * utility * 1e-4 + bonus)


def minmax(c: str, by: str = "query_id") -> Column:
    """Scaled to [0, 1] within each query; 1 where all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(1.0)


def kendall_tau(pairs: DataFrame) -> DataFrame:
    """(query_id, tau) of the ranks ``x`` and ``y`` of each query's rows."""
    a, b = pairs.alias("a"), pairs.alias("b")
    both = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.id") < F.col("b.id")))
    agree = F.signum((F.col("a.x") - F.col("b.x")) * (F.col("a.y") - F.col("b.y")))
    return both.groupBy(F.col("a.query_id").alias("query_id")).agg((F.sum(agree) / F.count("*")).alias("tau"))


def diverse(results: DataFrame, threshold: float, most: int) -> DataFrame:
    """Greedy in rank order: a row too similar by word Jaccard to one already taken is skipped."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, words = [], []
        for row in pdf.sort_values(["rank", "id"]).itertuples(index=False):
            own = set((row.content or "").lower().split())
            if all(not (own or w) or len(own & w) / len(own | w) <= threshold for w in words):
                taken.append((row.query_id, row.id, row.rank))
                words.append(own)
                if len(taken) == most:
                    break
        return pd.DataFrame(taken, columns=["query_id", "id", "rank"])

    return results.select("query_id", "id", F.col("rank").cast("long").alias("rank"), "content").groupBy("query_id").applyInPandas(pick, "query_id long, id long, rank long")


def tiered(parts: list[DataFrame], budget: int) -> DataFrame:
    """One list under one budget: earlier tiers first, an id only in its first tier.

    Each part is (query_id, id, tier_rank).
    """
    every = parts[0].withColumn("tier", F.lit(0))
    for n, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("tier", F.lit(n)))
    first = every.groupBy("query_id", "id").agg(F.min(F.struct("tier", "tier_rank")).alias("t")).select("query_id", "id", "t.*")
    w = Window.partitionBy("query_id").orderBy("tier", "tier_rank", "id")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= budget)


def best(scored: DataFrame, order: list[Column], most: int, by: str = "query_id") -> DataFrame:
    """The first ``most`` rows of each query in that order, with ``rank`` from 1."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)


def matched_entities(terms: DataFrame, entities: DataFrame, most: int) -> DataFrame:
    """(query_id, id, name): entities whose name has a query term as a word, or one of four letters or more as a word's beginning.

    ``terms`` is (query_id, term), lower case.  At most ``most`` a query, those of most terms first, then by name and id.
    """
    words = entities.select("id", "name", F.explode(F.array_distinct(tokens(F.col("name")))).alias("word"))
    # a prefix is looked up under its first four letters, a whole word of fewer letters under itself
    key = lambda c: F.substring(c, 1, 4)
    asked = small(written(terms.select("query_id", "term", key("term").alias("key")).distinct(), "entity_terms"))
    fits = (F.col("word") == F.col("term")) | (F.length("term") >= 4) & F.col("word").startswith(F.col("term"))
    hit = words.withColumn("key", key("word")).join(asked, "key").where(fits)
    counted = hit.groupBy("query_id", "id", "name").agg(F.count_distinct("term").alias("n"))
    return best(counted, [F.desc("n"), F.asc("name"), F.asc("id")], most).select("query_id", "id", "name")


def related_names(direct: DataFrame, entities: DataFrame, ways: DataFrame, degrees: DataFrame, most: int) -> DataFrame:
    """(query_id, id, name, degree, links): neighbours of each query's entities by other names, those with most links first."""
    reached = direct.select("query_id", F.col("id").alias("from")).join(ways.withColumnRenamed("id", "from"), "from")
    counted = reached.groupBy("query_id", F.col("other").alias("id")).agg(F.count_distinct("from").alias("links"))
    named = counted.join(entities.select("id", "name"), "id").join(degrees, "id")
    named = best(named, [F.desc("links"), F.asc("name"), F.asc("id")], most)
    return named.join(direct.select("query_id", "name"), ["query_id", "name"], "left_anti").select("query_id", "id", "name", "degree", "links")


def expanded_terms(terms: DataFrame, entities: DataFrame, edges: DataFrame, matched: int = 5, most: int = 10) -> DataFrame:
    """(query_id, term) with the one-word names of the neighbours of the entities that a query names added."""
    from palimpsest.operators import graph as G

    live = G.active(edges)
    direct = written(matched_entities(terms, entities, matched), "named")
    ways = G.both_ways(live).select("id", "other").distinct()
    names = related_names(direct, entities, ways, G.degree(live), most).select("query_id", tokens(F.col("name")).alias("w")).where(F.size("w") == 1)
    return terms.select("query_id", "term").union(names.select("query_id", F.col("w")[0])).distinct()


def graph_names(terms: DataFrame, entities: DataFrame, edges: DataFrame, hub_degree: int = 50) -> DataFrame:
    """(query_id, name, kind): the names that a query reaches, lower case; kind is direct, expanded or hub.

    Direct names are those of at most 10 entities that the query names.  Of 30 neighbours, those of up to
    ``hub_degree`` live edges are expanded, others are hubs and count if two direct entities lead to them.
    A query with fewer than three expanded names takes those of up to 20 neighbours of ten neighbours too.
    """
    from palimpsest.operators import graph as G

    live = G.active(edges)
    ways, degrees = written(G.both_ways(live).select("id", "other").distinct(), "ways"), G.degree(live)
    direct = written(matched_entities(terms, entities, 10), "direct")
    near = written(related_names(direct, entities, ways, degrees, 30), "neighbours")
    few = near.groupBy("query_id").agg(F.count_if(F.col("degree") <= hub_degree).alias("n")).where("n < 3").select("query_id")
    middle = best(near.join(few, "query_id", "left_semi"), [F.asc("name"), F.asc("id")], 10).select("query_id", "id", "name")
    far = related_names(middle, entities, ways, degrees, 20).where(F.col("degree") <= hub_degree).select("query_id", "name")
    far = far.join(direct, ["query_id", "name"], "left_anti")
    expanded = near.where(F.col("degree") <= hub_degree).select("query_id", "name").union(far).distinct()
    hubs = near.where((F.col("degree") > hub_degree) & (F.col("links") >= 2)).select("query_id", "name")
    kinds = [direct.select("query_id", "name", F.lit("direct").alias("kind")), expanded.withColumn("kind", F.lit("expanded")), hubs.withColumn("kind", F.lit("hub"))]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return every.groupBy("query_id", F.lower("name").alias("name")).agg(F.min("kind").alias("kind"))


def _naming(names: list[str], phrases: list[list[str]]):
    words = pa.array(sorted({w for p in phrases for w in p}), pa.string())
    codes = np.full((len(phrases), max(map(len, phrases), default=0)), -1)
    for k, p in enumerate(phrases):
        codes[k, : len(p)] = places(pa.array(p, pa.string()), words)
    size = np.array([len(p) for p in phrases], np.int64)
    order = np.argsort(codes[:, 0], kind="stable") if len(phrases) else np.zeros(0, np.int64)
    start = np.searchsorted(codes[order, 0] if len(phrases) else order, np.arange(len(words) + 1))
    named = pa.array(names, pa.string())

    def naming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed = b.column("words")
            own = lengths(listed)
            said = places(listed.flatten(), words)
            row, end = np.repeat(np.arange(b.num_rows), own), np.repeat(np.cumsum(own), own)
            at = np.flatnonzero(said >= 0)
            n = start[said[at] + 1] - start[said[at]]
            name = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start[said[at]], n)]
            at = np.repeat(at, n)
            fits = at + size[name] <= end[at]
            at, name = at[fits], name[fits]
            for k in range(1, codes.shape[1]):
                fits = (size[name] <= k) | (said[np.minimum(at + k, len(said) - 1)] == codes[name, k])
                at, name = at[fits], name[fits]
            rows, name = np.divmod(np.unique(row[at] * max(1, len(names)) + name), max(1, len(names)))
            yield pa.record_batch([*(b.column(c).take(pa.array(rows)) for c in ("id", "created_at")), named.take(pa.array(name))], ["id", "created_at", "name"])

    return naming


def naming(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, created_at, name): the names (name, phrase, head), a written table, whose phrase a row's words hold one after another.

    A name's first word finds the rows and the whole phrase decides.  Names of checked size are held by every
    worker and each word of a text is looked up once; more of them are joined.
    """
    if held(wanted):
        names = wanted.toArrow()  # of checked size
        schema = f"id {rows.schema['id'].dataType.simpleString()}, created_at {rows.schema['created_at'].dataType.simpleString()}, name string"
        return rows.mapInArrow(_naming(names["name"].to_pylist(), [p.split(" ") for p in names["phrase"].to_pylist()]), schema)
    found = rows.select("id", "created_at", "words", F.explode(F.array_distinct("words")).alias("head")).join(wanted, "head")
    return found.where(has_phrase(F.col("words"), F.col("phrase"))).select("id", "created_at", "name")


def graph_signal(terms: DataFrame, entities: DataFrame, edges: DataFrame, memories: DataFrame, most: int = 50, probe: int = 5) -> DataFrame:
    """(query_id, id, graph, place): active memories that hold the names which a query reaches in the graph, by place.

    Each expanded name (a direct one, where a query has no expanded) is looked up in the memories' content,
    category and subject: the ``probe`` newest rows that also hold a direct name, or where there are none, the
    newest that hold it alone.  Names go in order, an id counts at its first.  The score is 0.4, 0.6, 0.8 or
    1 by how many of the query's names the row's content and subject contain.  Rows whose subject contains
    a name fill up to ``most``, with 0.8, the most important and newest first.
    """
    names = written(graph_names(terms, entities, edges), "graph_names")
    rows = memories.where("superseded_by is null").select("id", "created_at", "importance", F.lower(F.coalesce("subject", F.lit(""))).alias("about"), tokens(F.concat_ws(" ", "content", "category", "subject")).alias("words"))
    wanted = names.select(F.col("name"), tokens(F.col("name")).alias("w")).where(F.size("w") > 0).distinct().select("name", F.array_join("w", " ").alias("phrase"), F.col("w")[0].alias("head"))
    found = naming(rows.select("id", "created_at", "words"), written(wanted, "wanted_names"))
    found = written(found.distinct(), "held_names")
    asked = written(found.join(small(names), "name"), "asked_names")
    expands = names.groupBy("query_id").agg(F.max(F.col("kind") == "expanded").alias("expands"))
    context = asked.where("kind = 'direct'").select("query_id", "id").distinct().withColumn("context", F.lit(1))
    probes = asked.join(expands, "query_id").where(F.when(F.col("expands"), F.col("kind") == "expanded").otherwise(F.col("kind") == "direct"))
    probes = probes.join(context, ["query_id", "id"], "left").withColumn("context", F.coalesce("context", F.lit(0)))
    by_name = Window.partitionBy("query_id", "name")
    probes = probes.withColumn("most", F.max("context").over(by_name)).where("context = most")
    probes = probes.withColumn("n", F.row_number().over(by_name.orderBy(F.desc("created_at"), F.asc("id")))).where(F.col("n") <= probe)
    firsts = probes.groupBy("query_id", "id").agg(F.min(F.struct("name", "n")).alias("at"))
    first = best(firsts, [F.asc("at"), F.asc("id")], most).select("query_id", "id", F.col("rank").alias("place"))
    first = written(first, "first_found")
    # texts are lowered once their rows are chosen
    texts = memories.join(small(first.select("id").distinct()), "id").select("id", F.lower(F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("subject", F.lit("")))).alias("text"))
    found = first.join(texts, "id").join(small(names), "query_id")
    density = F.count_if(F.col("text").contains(F.col("name")))
    found = found.groupBy("query_id", "id", "place").agg(density.alias("k")).select("query_id", "id", F.when(F.col("k") >= 3, 1.0).when(F.col("k") == 2, 0.8).when(F.col("k") == 1, 0.6).otherwise(0.4).alias("graph"), "place")
    found = written(found, "graph_found")
    # subjects are few against rows: their distinct values meet the names, then the rows by equality
    subjects = rows.where("about <> ''").select("about").distinct()
    meant = written(subjects.join(small(names), F.col("about").contains(F.col("name"))).select("query_id", "about").distinct(), "meant_subjects")
    room = meant.select("query_id").distinct().join(found.groupBy("query_id").agg(F.count("*").alias("taken")), "query_id", "left").select("query_id", F.coalesce("taken", F.lit(0)).alias("taken"))
    more = rows.where("about <> ''").select("id", "about", "importance", "created_at").join(small(meant), "about")
    more = more.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("importance"), F.desc("created_at"), F.asc("id")))).where(F.col("n") <= most).join(room, "query_id").where(F.col("n") <= most - F.col("taken"))
    more = more.join(found, ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(0.8).alias("graph"), (F.lit(most) + F.col("n")).alias("place"))
    return found.unionByName(more)


@dataclass(frozen=True)
class Options:
    """What a retrieval may be told; the defaults are those of the batched search."""

    limit: int = 5
    category: str | None = None
    subject: str | None = None
    origin: str | None = None
    signals: tuple[str, ...] = ("vector", "bm25", "graph", "recency", "freshness")
    sufficient_distance: float = 0.0
    sufficient_agreement: int = 1
    half_life: float = 90.0
    min_relevance: float | None = None


def retrieve(queries: DataFrame, memories: DataFrame, vectors: DataFrame, entities: DataFrame, edges: DataFrame, now: Column, options: Options = Options()) -> DataFrame:
    """(query_id, rank, id, relevance, score, rrf): the hybrid search for a batch of queries (query_id, text, embedding).

    The first ``limit`` of the :func:`candidates`, those with a distance first, then by score.
    """
    rows = candidates(queries, memories, vectors, entities, edges, now, options)
    taken = best(rows, [F.desc("primary"), F.desc("score"), F.desc(F.round("rrf", 9)), F.asc("id")], options.limit)
    return taken.select("query_id", "rank", "id", "relevance", "score", "rrf")


def candidates(queries: DataFrame, memories: DataFrame, vectors: DataFrame, entities: DataFrame, edges: DataFrame, now: Column, options: Options = Options()) -> DataFrame:
    """(query_id, id, rrf, relevance, primary, score): all rows that the signals find for a query, filtered and scored.

    Nearest vectors and full text give max(10 limit, 50) active memories each, the graph as many.  A query
    whose first results are all near and agree with full text needs no graph.  All of these by date are
    one more signal; for a query with temporal intent so are the rows that vectors and full text share.
    Signals are fused by reciprocal ranks, which keep a sole signal's order.  ``primary`` are rows with a
    distance; ``relevance`` is null for the others.
    """
    from palimpsest.functions import vectors as V
    from palimpsest.operators.fulltext import bm25
    from palimpsest.operators.vector import knn

    depth = max(10 * options.limit, 50)
    live = memories.where("superseded_by is null")
    terms = written(queries.select("query_id", F.explode(S.query_terms(F.lower("text"))).alias("term")).distinct(), "search_terms")
    empty = terms.sparkSession.createDataFrame([], "query_id long, id long, distance double, score double, graph double, place int")
    near, text, graph = empty.select("query_id", "id", "distance"), empty.select("query_id", "id", "score"), empty.select("query_id", "id", "graph", "place")
    if "vector" in options.signals:
        near = knn(queries, live.select("id").join(vectors, "id"), depth).select("query_id", "id", F.round("distance", 6).alias("distance"))
    if "bm25" in options.signals:
        asked = written(expanded_terms(terms, entities, edges), "expanded_terms")
        found = bm25(memories, asked, {"content": 10.0, "category": 1.0, "subject": 5.0}, active="superseded_by is null", most=depth)
        text = best(found.withColumn("score", F.round("score", 6)), [F.desc("score"), F.asc("id")], depth).select("query_id", "id", "score")
    near, text = written(near, "near"), written(text, "text_hits")
    enough = sufficient(near, text, options)
    if "graph" in options.signals:
        asked = queries.join(enough, "query_id", "left_anti")
        words = written(asked.select("query_id", F.explode(S.query_terms(F.lower("text"), S.ENTITY_STOP)).alias("term")).distinct(), "graph_terms")
        graph = graph_signal(words, entities, edges, memories, depth)
    graph = written(graph, "graph_hits")
    lists = [ranked(near, "vector", [F.asc("distance"), F.asc("id")]), ranked(text, "bm25", [F.desc("score"), F.asc("id")]), ranked(graph, "graph", [F.asc("place"), F.asc("id")])]
    made = live.select("id", "created_at")
    pool = near.select("query_id", "id").union(text.select("query_id", "id")).union(graph.select("query_id", "id")).distinct().join(made, "id")
    if "recency" in options.signals:
        lists.append(ranked(pool, "recency", [F.desc("created_at"), F.asc("id")]))
    if "freshness" in options.signals:
        temporal = queries.where(S.temporal_intent(F.col("text"))).select("query_id").join(enough, "query_id", "left_anti")
        lists.append(ranked(freshness(near, text, made).join(temporal, "query_id", "left_semi"), "freshness", [F.desc("created_at"), F.asc("id")]))
    signals = reduce(DataFrame.unionByName, lists)
    signals = written(signals, "signals")
    # a sole signal keeps its own order: its reciprocal ranks have that order too
    fused = fuse(signals).join(live, "id")
    for column, value in (("category", options.category), ("origin", options.origin)):
        fused = fused.where(F.col(column) == value) if value else fused
    if options.subject:
        fused = fused.where(F.lower("subject").contains(options.subject.lower()))
    top = text.groupBy("query_id").agg(F.max("score").alias("top"))
    scaled = text.join(top, "query_id").select("query_id", "id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias("bm25"))
    rows = fused.join(near, ["query_id", "id"], "left").join(scaled, ["query_id", "id"], "left").join(graph.select("query_id", "id", "graph"), ["query_id", "id"], "left")
    rows = rows.join(queries.select("query_id", S.freshness_alpha(F.col("text")).alias("alpha")), "query_id")
    primary, score = importance_score(now, F.col("alpha"), options.half_life)
    rows = rows.select("query_id", "id", "rrf", F.round(V.relevance(F.col("distance")), 4).alias("relevance"), primary.alias("primary"), F.round(score, 9).alias("score"))
    if options.min_relevance is not None:
        rows = rows.where(F.coalesce("relevance", F.lit(1.0)) >= options.min_relevance)
    return rows


def sufficient(near: DataFrame, text: DataFrame, options: Options) -> DataFrame:
    """(query_id) of queries whose first ``limit`` rows are all near enough and shared with full text often enough."""
    if options.sufficient_distance <= 0:
        return near.select("query_id").limit(0)
    first = best(near, [F.asc("distance"), F.asc("id")], options.limit).join(text.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    counted = first.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far"), F.count("hit").alias("agree"))
    return counted.where((F.col("n") >= options.limit) & (F.col("far") <= options.sufficient_distance) & (F.col("agree") >= options.sufficient_agreement)).select("query_id")


def freshness(near: DataFrame, text: DataFrame, made: DataFrame) -> DataFrame:
    """(query_id, id, created_at, freshness): rows of both lists; the nearest scores 1 and the farthest 0."""
    both = near.join(text.select("query_id", "id"), ["query_id", "id"], "left_semi").join(made, "id")
    w = Window.partitionBy("query_id")
    low, high = F.min("distance").over(w), F.max("distance").over(w)
    score = 1.0 - (F.col("distance") - low) / F.when(high > low, high - low).otherwise(1.0)
    return both.select("query_id", "id", "created_at", score.alias("freshness"))


def session_bonus(subject: Column, category: Column, seen_categories: Column, seen_tokens: Column) -> Column:
    """0.05 for a category that the session has seen, and 0.05 times the share of the subject's words that it has."""
    words = F.array_distinct(tokens(F.coalesce(subject, F.lit(""))))
    share = F.when(F.size(words) > 0, F.size(F.array_intersect(words, seen_tokens)) / F.size(words)).otherwise(0.0)
    return F.when(F.array_contains(seen_categories, category), 0.05).otherwise(0.0) + 0.05 * share


def rerank_blend(results: DataFrame, score: str, weight: float = 0.75) -> DataFrame:
    """Blends the scaled importance with the sigmoid of a pair model's score, given as a column."""
    blended = weight * minmax("importance_score") + (1 - weight) / (1.0 + F.exp(-F.col(score)))
    w = Window.partitionBy("query_id").orderBy(F.desc("blended"), "id")
    return results.withColumn("blended", blended).withColumn("rank", F.row_number().over(w))


def apply_picks(results: DataFrame, picks: DataFrame) -> DataFrame:
    """Rows that a listwise model picked first, in its order, then the others in theirs.

    ``picks`` is (query_id, answer): text that holds a JSON array of ranks from 0.
    """
    parsed = picks.select("query_id", F.posexplode(F.from_json(F.regexp_extract("answer", r"\[[\d,\s]*\]", 0), "array<int>")).alias("pick", "rank"))
    first = parsed.groupBy("query_id", "rank").agg(F.min("pick").alias("pick"))
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("pick"), "rank", "id")
    return results.join(first, ["query_id", "rank"], "left").withColumn("place", F.row_number().over(w)).drop("pick")


def inject_graph_slot(top: DataFrame, extra: DataFrame, k: int) -> DataFrame:
    """The last of k places goes to the best graph-only row ((query_id, id, novel, terms)), where there is one."""
    chosen = extra.join(top.select("query_id", "id"), ["query_id", "id"], "left_anti").groupBy("query_id").agg(F.max_by("id", F.struct("novel", "terms", -F.col("id"))).alias("extra_id"))
    joined = top.join(chosen, "query_id", "left")
    swapped = F.when((F.col("rank") == k) & F.col("extra_id").isNotNull(), F.col("extra_id")).otherwise(F.col("id"))
    return joined.select("query_id", swapped.alias("id"), "rank")
