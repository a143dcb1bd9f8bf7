import duckdb
import numpy as np
import pandas as pd

from palimpsest.llm import mixing as M
from tests.llm.helpers import docs


def run(spark, rows, labels=(), **options):
    table = spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")
    found = M.mix(docs(spark, rows), M.quality_weights(table), **options)
    return sorted((tuple(r) for r in found.collect()), key=str)


def oracle(rows, labels=(), **options):
    con = duckdb.connect()
    d = pd.DataFrame([(r[0], r[1], r[3]) for r in rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    x = pd.DataFrame(list(labels), columns=["doc_id", "quality", "toxic"]).astype("Int64")
    con.register("documents", d)
    con.register("labels", x)
    return sorted(con.execute(M.sql(**options)).fetchall(), key=str)


def test_against_sql_and_budgets(spark):
    rows = [(i, "w " * (i % 17 + 1), "en", "big" if i % 4 else ("small" if i % 8 else "tiny")) for i in range(400)]
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 400, 3)]
    labels = [(a, b, int(c)) for a, b, c in labels]
    for options in ({}, {"targets": {"tiny": 4.0, "big": 0.5}, "budget_ratio": 0.7}):
        found = run(spark, rows, labels, bucket_docs=13, **options)
        assert found == oracle(rows, labels, **options)
        total = sum(len(r[1].split()) for r in rows)
        weights = {s: options.get("targets", {}).get(s, 1.0) for s in ("big", "small", "tiny")}
        for s, w in weights.items():
            budget = total * options.get("budget_ratio", 1.0) * w / sum(weights.values())
            got = sum(n * c for _, k, n, c in found if k == s)
            assert budget - 18 < got <= budget
    epochs = {c for _, s, _, c in run(spark, rows, labels, targets={"tiny": 4.0}) if s == "tiny"}
    assert len(epochs) <= 2 and min(epochs) >= 1  # complete epochs come before any fraction


def test_edge_cases(spark):
    rows = [(1, "a b", "en", None), (2, None, "en", "s"), (3, "", "en", "s"), (4, " \n ", "en", "s"), (None, "c d", "en", "t"), (5, "e f", "en", "t"), (5, "e f", "en", "t"), (6, "word " * 100_000, "en", "u")]
    found = run(spark, rows)
    assert {r[0] for r in found} <= {1, None, 5, 6} and found == oracle(rows)
    assert run(spark, []) == []


def test_buckets_stay_small_at_any_weights(spark):
    """No bucket of keys holds much more than its share, however uneven the weights are."""
    rng = np.random.default_rng(5)
    for weights in ([1.0], [0.02, 1.0], [1e-3, 0.2, 5.0, 1e4], rng.exponential(1, 50)):
        key = rng.exponential(1, 200_000) / rng.choice(weights, 200_000)
        buckets = 200
        size = np.unique(np.floor(np.log(key) * buckets), return_counts=True)[1]
        assert size.max() < 0.5 * len(key) / buckets + 100
