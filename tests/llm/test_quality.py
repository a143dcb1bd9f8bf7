import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.llm import quality as Q
from tests.llm.helpers import docs


def brute(net, text):
    """One document, chunk by chunk."""
    raw = list(text.encode()) + [256] * (Q.WIDTH + len(text.encode()) % Q.STRIDE)
    best = np.full(Q.FILTERS, -np.inf)
    for at in range(0, len(raw) - Q.WIDTH + 1, Q.STRIDE):
        best = np.maximum(best, net.embed[raw[at : at + Q.WIDTH]].reshape(-1) @ net.filters)
    return 1 / (1 + np.exp(-(np.maximum(best + net.bias, 0) @ net.out + net.offset)))


def _net():
    rng = np.random.default_rng(1)
    return Q.Network(np.vstack([rng.normal(size=(256, Q.EMBED)), np.zeros((1, Q.EMBED))]).astype(np.float32), rng.normal(size=(Q.WIDTH * Q.EMBED, Q.FILTERS)).astype(np.float32), rng.normal(size=Q.FILTERS).astype(np.float32), rng.normal(size=Q.FILTERS).astype(np.float32) / 9, 0.1)


def test_against_brute_force():
    net = _net()
    texts = ["", "a", "hello world", "zwölf Boxkämpfer", "x" * 5000 + "end", "odd length tail!"]
    got = net.probabilities(pa.array(texts, pa.large_string()))
    assert np.allclose(got, [brute(net, t) for t in texts], atol=1e-4)
    assert np.allclose(net.probabilities(pa.array(texts[::-1], pa.large_string())), got[::-1], atol=1e-5)


def test_held_out_accuracy(spark):
    source, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    net = Q.train(source, labels.where(third != 0), most=1500)
    held = labels.where(third == 0).join(source, "doc_id").collect()  # no row of them was trained on
    assert len(held) > 1000
    good = np.array([r.quality == 1 and r.toxic != 1 for r in held])
    p = net.probabilities(pa.array([r.text for r in held], pa.large_string()))
    assert ((p >= 0.5) == good).mean() > 0.85 and (p[good] >= Q.KEEP).mean() > 0.93


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "text"), (3, "long " * 100_000), (3, "long " * 100_000)]
    labels = spark.createDataFrame([(2, None, 1), (None, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    net = Q.train(docs(spark, rows), labels)  # one class only
    found = Q.score(docs(spark, rows), net).collect()
    assert len(found) == 5 and all(abs(r.probability - 0.999) < 1e-6 for r in found)
    assert Q.score(docs(spark, []), _net()).count() == 0
    assert Q.train(docs(spark, []), labels.limit(0)).offset == 0
