"""Learned ranking: features, forward pass, sampling weights, training, graduation, shadow comparison."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalars as S

FEATURES = ("similarity", "bm25", "graph", "importance", "decay", "utility", "category", "reciprocal_rank", "coherence", "depth", "category_seen", "subject_seen", "freshness", "freshness_rank")
#: Order of the categories, from the most important; any other comes last.
PRIORITY = {"family": 1, "identity": 2, "preference": 3, "project": 4}


def features(rows: DataFrame, now: Column, protected: tuple[str, ...], half_life: float = 90.0, priority: dict[str, int] = PRIORITY) -> DataFrame:
    """Adds ``features``: fourteen numbers of each candidate.

    Beside the memory's columns a candidate has distance, bm25, graph, rank (from 0), coherence, depth,
    seen_categories, seen_tokens, freshness and freshness_rank (from 0, null for none).
    """
    days = S.age_days(F.col("created_at"), now)
    last = max(priority.values())
    place = F.lit(last)
    for name, n in priority.items():
        place = F.when(F.col("category") == name, n).otherwise(place)
    surfaced, accessed = F.col("surfacing_count"), F.coalesce("access_count", F.lit(0))
    utility = F.when(surfaced > 0, F.least(accessed / surfaced, F.lit(2.0)) / 2.0).otherwise(F.log(2.0 + F.least(accessed, F.lit(5))) / math.log(7))
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("subject", F.lit(""))), r"\s+"), lambda w: w != ""))
    share = F.when(F.size(words) > 0, F.size(F.array_intersect(words, F.col("seen_tokens"))) / F.size(words)).otherwise(0.0)
    values = [
        F.coalesce(1.0 - F.col("distance"), F.lit(0.0)),
        F.coalesce("bm25", F.lit(0.0)),
        F.coalesce("graph", F.lit(0.0)),
        F.coalesce(F.nullif(F.col("importance"), F.lit(0.0)), F.lit(0.5)),
        F.when(F.col("category").isin(*protected), 1.0).otherwise(S.decay(days, half_life)),
        utility,
        place / float(last),
        1.0 / (1.0 + F.col("rank")),
        F.coalesce("coherence", F.lit(0.0)),
        F.coalesce("depth", F.lit(0.0)),
        F.coalesce(F.array_contains("seen_categories", F.col("category")), F.lit(False)).cast("double"),
        F.coalesce(share, F.lit(0.0)),
        F.coalesce("freshness", F.lit(0.0)),
        F.coalesce(1.0 / (1.0 + F.col("freshness_rank")), F.lit(0.0)),
    ]
    return rows.withColumn("features", F.array(*(v.cast("double") for v in values)))


def forward(x: Column, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float) -> Column:
    """The network's output as one column expression: ReLU hidden layer, sigmoid output."""
    hidden = []
    for row, bias in zip(w1.tolist(), b1.tolist()):
        weighted = F.aggregate(F.zip_with(x, F.array(*map(F.lit, row)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        hidden.append(F.greatest(F.lit(0.0), weighted + F.lit(bias)))
    total = F.lit(float(b2))
    for h, w in zip(hidden, w2.tolist()):
        total = total + h * F.lit(w)
    return 1.0 / (1.0 + F.exp(-total))


def self_normalised(rows: DataFrame, batch: str) -> DataFrame:
    """Weights scaled so that they sum to the number of rows of their batch."""
    w = Window.partitionBy(batch)
    return rows.withColumn("weight", F.col("weight") * F.count("*").over(w) / F.sum("weight").over(w))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 16, steps: int = 50, batch: int = 32, rate: float = 0.05, seed: int = 42) -> dict:
    """Stochastic gradient descent on the weighted logistic loss, with closed-form gradients."""
    rng = np.random.default_rng(seed)
    w1, b1 = rng.normal(0, 0.3, (hidden, x.shape[1])), np.zeros(hidden)
    w2, b2, losses = rng.normal(0, 0.3, hidden), 0.0, []
    y = (y > 0.5).astype(float)
    for _ in range(steps):
        rows = rng.choice(len(x), min(batch, len(x)), replace=False)
        a, t, g = x[rows], y[rows], weight[rows] * len(rows) / weight[rows].sum()
        z = a @ w1.T + b1
        h = np.maximum(z, 0)
        p = 1 / (1 + np.exp(-(h @ w2 + b2)))
        q = p * 0.998 + 0.001
        losses.append(float(-(g * (t * np.log(q) + (1 - t) * np.log(1 - q))).mean()))
        d = g * (q - t) / (q * (1 - q)) * 0.998 * p * (1 - p) / len(rows)
        dz = np.outer(d, w2) * (z > 0)
        w2, b2 = w2 - rate * (h.T @ d), b2 - rate * d.sum()
        w1, b1 = w1 - rate * (dz.T @ a), b1 - rate * dz.sum(0)
    return {"w1": w1, "b1": b1, "w2": w2, "b2": b2, "losses": losses}


def graduation(shadow: DataFrame, ndcg: Column) -> DataFrame:
    """(n, mean_tau, spread, verdict) over shadow comparisons (tau)."""
    g = shadow.agg(F.count("*").alias("n"), F.avg("tau").alias("mean_tau"), F.stddev_pop("tau").alias("spread"))
    verdict = F.when(F.col("n") < 50, "too_few").when(ndcg < 0.5, "low_ndcg").when(F.col("mean_tau") < -0.3, "disagrees").when(F.col("spread") > 0.3, "unstable").otherwise("ready")
    return g.withColumn("verdict", verdict)


def pairwise_samples(rows: DataFrame, negatives: int = 3) -> DataFrame:
    """(query_id, positive, negative): each positive with the first few negatives of its query."""
    bad = rows.where("rel <= 0").select("query_id", F.col("id").alias("negative"))
    w = Window.partitionBy("query_id").orderBy("negative")
    bad = bad.withColumn("n", F.row_number().over(w)).where(F.col("n") <= negatives).drop("n")
    return rows.where("rel > 0").select("query_id", F.col("id").alias("positive")).join(bad, "query_id")


#: What a graded judgment counts as an outcome.
GRADES = {0: 0.0, 1: 0.1, 2: 0.75, 3: 1.0}


def samples(logs: DataFrame, outcomes: DataFrame, surfacing: DataFrame, newest: int | None = 1000) -> DataFrame:
    """(log_id, id, features, label, weight): a training row for each returned id of a labelled log, weighted against its exposure.

    ``logs`` is (log_id, at, returned map<id, features>), ``outcomes`` (log_id, outcome), ``surfacing``
    (id, surfacing_count).  The newest labelled logs train; None takes all.
    """
    labelled = logs.join(outcomes, "log_id")
    if newest is not None:
        labelled = labelled.orderBy(F.desc("at"), F.desc("log_id")).limit(newest)
    each = labelled.select("log_id", "outcome", F.explode("returned").alias("id", "features"))
    total = surfacing.agg(F.sum("surfacing_count").alias("total"))  # one row
    joined = each.join(surfacing, "id").crossJoin(F.broadcast(total))
    weight = F.when(F.col("surfacing_count") >= 10, F.least(F.col("total") / F.col("surfacing_count"), F.lit(50.0))).otherwise(1.0)
    return joined.select("log_id", "id", "features", (F.col("outcome") > 0.5).cast("double").alias("label"), weight.alias("weight"))


def fit(rows: DataFrame, least: int = 10, most: int = 20_000, **options) -> dict | None:
    """The network trained on at most ``most`` samples by hash of their keys, or None for fewer than ``least``."""
    taken = rows.orderBy(F.xxhash64("log_id", "id"), "log_id", "id").limit(most).collect()  # bounded by a parameter
    if len(taken) < least:
        return None
    return train(np.array([r.features for r in taken]), np.array([r.label for r in taken]), np.array([r.weight for r in taken]), **options)


def scored(rows: DataFrame, net: dict) -> DataFrame:
    """Rows with the network's score of their features."""
    return rows.withColumn("score", forward(F.col("features"), net["w1"], net["b1"], net["w2"], net["b2"]))


def train_pairwise(good: np.ndarray, bad: np.ndarray, hidden: int = 16, steps: int = 200, batch: int = 64, rate: float = 0.1, seed: int = 42) -> dict:
    """Gradient descent on -log sigmoid(score(good) - score(bad)) over pairs of feature rows, scores before the sigmoid."""
    rng = np.random.default_rng(seed)
    w1, b1, w2, losses = rng.normal(0, 0.3, (hidden, good.shape[1])), np.zeros(hidden), rng.normal(0, 0.3, hidden), []
    for _ in range(steps):
        rows = rng.choice(len(good), min(batch, len(good)), replace=False)
        sides = [(x[rows], x[rows] @ w1.T + b1) for x in (good, bad)]
        gap = sum(sign * np.maximum(z, 0) @ w2 for sign, (_, z) in zip((1, -1), sides))
        losses.append(float(np.logaddexp(0, -gap).mean()))
        d = -1 / (1 + np.exp(gap)) / len(rows)
        step1, stepb, step2 = np.zeros_like(w1), np.zeros_like(b1), np.zeros_like(w2)
        for sign, (x, z) in zip((1, -1), sides):
            dz = np.outer(sign * d, w2) * (z > 0)
            step1, stepb, step2 = step1 + dz.T @ x, stepb + dz.sum(0), step2 + np.maximum(z, 0).T @ (sign * d)
        w1, b1, w2 = w1 - rate * step1, b1 - rate * stepb, w2 - rate * step2
    return {"w1": w1, "b1": b1, "w2": w2, "b2": 0.0, "losses": losses}


def simulated_feedback(spark: SparkSession, queries: int, items: int = 200, candidates: int = 15, seed: int = 42) -> DataFrame:
    """(query_id, item_id, tier, relevant, label): items in three tiers of popularity, candidates by popularity, clicks seen more often where relevant.

    All chances are hashes of the keys and the seed, so that any cluster makes the same rows.
    """
    chance = lambda salt, *keys: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *keys), F.lit(1_000_000)) / 1e6
    tier = F.when(F.col("item_id") < items // 10, 0).when(F.col("item_id") < items // 2, 1).otherwise(2)
    grid = spark.range(queries).withColumnRenamed("id", "query_id").select("query_id", F.explode(F.sequence(F.lit(0), F.lit(items - 1))).alias("item_id")).withColumn("tier", tier)
    weight = F.when(F.col("tier") == 0, 10.0).when(F.col("tier") == 1, 3.0).otherwise(1.0)
    key = -F.log(chance("pick", "query_id", "item_id") + 1e-9) / weight
    w = Window.partitionBy("query_id").orderBy("key", "item_id")
    shown = grid.withColumn("key", key).withColumn("n", F.row_number().over(w)).where(F.col("n") <= candidates)
    rows = shown.withColumn("relevant", chance("relevant", "query_id", "item_id") < 0.2)
    return rows.select("query_id", "item_id", "tier", "relevant", (chance("label", "query_id", "item_id") < F.when(F.col("relevant"), 0.55).otherwise(0.05)).cast("int").alias("label"))


def learning_curve(rows: DataFrame, fractions: tuple[float, ...], trials: int, metric: Column, key: str = "id") -> DataFrame:
    """(fraction, mean, spread): the metric over nested samples by hash of the key, repeated with other hashes."""
    place = F.pmod(F.xxhash64(F.lit("curve"), F.col("trial"), F.col(key)), F.lit(1_000_000)) / 1e6
    each = rows.withColumn("trial", F.explode(F.array(*map(F.lit, range(trials))))).withColumn("place", place)
    cut = each.withColumn("fraction", F.explode(F.array(*(F.lit(float(f)) for f in fractions)))).where("place < fraction")
    return cut.groupBy("fraction", "trial").agg(metric.alias("m")).groupBy("fraction").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("spread"))


def paired_wins(runs: DataFrame) -> DataFrame:
    """(method_a, method_b, wins, losses, ties, mean_gap) over runs (seed, method, score) of every two methods."""
    other = runs.select("seed", F.col("method").alias("method_b"), F.col("score").alias("other"))
    both = runs.withColumnRenamed("method", "method_a").join(other, "seed").where("method_a < method_b")
    count = lambda c: F.count_if(c)
    return both.groupBy("method_a", "method_b").agg(count(F.col("score") > F.col("other")).alias("wins"), count(F.col("score") < F.col("other")).alias("losses"), count(F.col("score") == F.col("other")).alias("ties"), F.avg(F.col("score") - F.col("other")).alias("mean_gap"))
