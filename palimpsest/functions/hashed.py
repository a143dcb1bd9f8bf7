"""Embeddings without a model, for tests and benchmarks: hashes of the text, alone or around keyword clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = 64


def _bytes(c: Column, salt: str = "") -> Column:
    """The 32 bytes of SHA-256 as numbers from 0 to 255."""
    digest = F.sha2(F.concat(F.lit(salt), c), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.conv(F.substring(digest, k * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def mock_embedding(c: Column) -> Column:
    """64 numbers in [0, 1]: the hash's bytes twice, not of unit length."""
    half = F.transform(_bytes(c), lambda b: b / 255.0)
    return F.concat(half, half)


def cluster_hits(c: Column, clusters: dict[str, list[str]]) -> Column:
    """How many of each cluster's keywords the text contains, clusters by name."""
    low = F.lower(c)
    return F.array(*(sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) for _, words in sorted(clusters.items())))


def _scaled(weight: Column):
    return lambda v: v * weight


def cluster_embedding(c: Column, clusters: dict[str, list[str]], share: float = 0.9) -> Column:
    """A unit vector: the centroids of the clusters weighted by hits, blended with noise from the text's hash; noise alone without a hit."""
    centroids = []
    for k in range(len(clusters)):
        x = np.random.default_rng(1000 + k).standard_normal(DIMS)
        centroids.append(F.array(*(F.lit(float(v)) for v in x / np.linalg.norm(x))))
    hits = cluster_hits(c, clusters)
    total = F.aggregate(hits, F.lit(0), lambda s, v: s + v)
    noise = F.transform(F.concat(_bytes(c), _bytes(c, "second")), lambda b: b / 127.5 - 1.0)
    mixed = noise
    for k, centroid in enumerate(centroids):
        weight = F.when(total > 0, hits[k] / total * (share / (1 - share) * 8)).otherwise(0.0)
        mixed = F.zip_with(mixed, F.transform(centroid, _scaled(weight)), lambda a, b: a + b)
    norm = F.sqrt(F.aggregate(mixed, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(mixed, lambda v: v / norm)
