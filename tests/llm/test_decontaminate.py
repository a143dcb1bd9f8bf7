import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import decontaminate as D
from palimpsest.llm.text import word_hashes
from tests.llm.helpers import docs, edited, words


def distance(item, text):
    """Least word edit distance of the item to any part of the text (Sellers)."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def split(text):
    return re.findall("[a-z0-9\u0080-\U0010ffff]+", text.lower())


def test_recall_and_exactness(spark):
    rng = random.Random(6)
    items = [(k, " ".join(words(rng, rng.randint(6, 60)))) for k in range(25)]
    rows = []
    for i in range(300):
        text = words(rng, rng.randint(0, 120))
        if i % 3:
            own = items[i % 25][1].split()
            text += edited(rng, own, rng.randint(0, max(1, int(0.2 * len(own))))) + words(rng, 40)
        rows.append((i, " ".join(text)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.edits for r in D.contaminated(docs(spark, rows), benchmark).collect()}
    exact = {}
    for i, text in rows:
        for k, item in items:
            d = distance(split(item), split(text))
            if d <= int(D.MAX_EDITS * len(split(item))):
                exact[i, k] = d
    assert set(found) <= set(exact) and len(found) >= D.TARGET_RECALL * len(exact) and len(exact) > 150
    assert np.mean([found[k] == exact[k] for k in found]) > 0.95 and all(found[k] >= exact[k] for k in found)


def test_embedding_keeps_small_distances():
    rng = random.Random(8)
    items = [" ".join(words(rng, 40)) for _ in range(20)]
    index = D.Index(list(range(20)), items)
    for item, code in zip(index.items, index.embedded):
        own = index.walk(item.words, np.zeros(1, np.int64), np.full(1, 40), 40)[0]
        assert np.array_equal(own, code)  # the same window has the same embedding
        changed = item.words.copy()
        changed[20] = np.uint64(1)
        near = (index.walk(changed, np.zeros(1, np.int64), np.full(1, 40), 40)[0] != code).mean()
        other = (index.walk(index.items[0].words, np.zeros(1, np.int64), np.full(1, 40), 40)[0] != code).mean()
        assert near < 0.6 and (other > near or item is index.items[0])


def test_edge_cases(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "!!"), (5, "single")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "xx " + item.upper() + "!"), (3, "xx " + item.upper() + "!"), (None, item), (4, "y " * 200_000 + item), (5, item[:30]), (6, "a single word"), (7, "alpha beta NEW delta epsilon zeta eta theta")]
    found = sorted(((r.doc_id, r.item_id, r.edits) for r in D.contaminated(docs(spark, rows), benchmark).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert found == [(3, 1, 0), (3, 1, 0), (4, 1, 0), (6, 5, 0), (7, 1, 1), (None, 1, 0)]
    assert D.contaminated(docs(spark, []), benchmark).count() == 0 and D.contaminated(docs(spark, rows), benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("size", [20, 60, 200, 400])
def test_recall_at_the_allowed_distance(size):
    """Windows with all the edits that are allowed: the target recall is reached at every length."""
    rng = random.Random(size)
    items = [" ".join(words(rng, size)) for _ in range(60)]
    index = D.Index(list(range(60)), items)
    found = 0
    for k, item in enumerate(items):
        text = words(rng, 30) + edited(rng, item.split(), int(0.2 * size)) + words(rng, 30)
        hashed, at = word_hashes(pa.array([" ".join(text)], pa.large_string()))
        found += any(i == k for _, i, _ in index.matches(hashed, at))
    assert found >= 60 * D.TARGET_RECALL - 2  # two standard deviations below the target


def test_a_very_long_item():
    """Memory and time stay bounded for an item of many words, in a text that repeats a part of it."""
    rng = random.Random(1)
    item = words(rng, 6000)
    text = words(rng, 500) + edited(rng, item, 400) + item[:3] * 2000
    index = D.Index([7], [" ".join(item)])
    hashed, at = word_hashes(pa.array([" ".join(text)], pa.large_string()))
    tracemalloc.start()
    found = list(index.matches(hashed, at))
    assert tracemalloc.get_traced_memory()[1] < 500_000_000
    tracemalloc.stop()
    assert len(found) == 1 and found[0][:2] == (0, 7) and 0 < found[0][2] <= 400


def test_more_recall_takes_more_tables():
    text = [" ".join(words(random.Random(2), 400))]
    assert len(D.Index([1], text, recall=0.9999).tables[400]) > 64 > len(D.Index([1], text).tables[400])


def test_least_edits():
    rng = np.random.default_rng(4)
    for _ in range(200):
        item, text = rng.integers(0, 5, rng.integers(1, 90)).astype(np.uint64), rng.integers(0, 5, rng.integers(0, 150)).astype(np.uint64)
        assert D.least_edits(item, text) == distance(item.tolist(), text.tolist())
