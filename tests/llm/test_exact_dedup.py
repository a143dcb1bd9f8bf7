import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup
from palimpsest.llm.exact_dedup import CountingQuotientFilter as Filter
from palimpsest.llm.exact_dedup import exact_duplicates, repeated_fingerprints
from tests.llm.helpers import docs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**64 - 1)), max_size=40), max_size=5))
def test_merge_is_lossless(parts):
    filters = [Filter.from_bytes(Filter.of(np.array(p, np.uint64)).to_bytes()) for p in parts]
    value, count = Filter.merged(filters).entries()
    expected = {}
    for p in parts:
        for x in p:
            expected[x] = expected.get(x, 0) + 1
    assert dict(zip(value.tolist(), count.tolist())) == expected
    assert value.tolist() == sorted(value.tolist())


def test_repeated_fingerprints(spark):
    rows = [-5, 7, 7, 2**62, 9, 9, 9, -5, 1]
    found = repeated_fingerprints(spark.createDataFrame([(x,) for x in rows], "fingerprint long"))
    assert sorted(r[0] for r in found.collect()) == [-5, 7, 9]


def test_edge_cases(spark):
    rows = [(3, "a"), (1, "a"), (2, "b"), (4, ""), (5, ""), (6, None), (7, None), (None, "a"), (8, "x" * 300_000), (9, "x" * 300_000), (2, "b"), (10, "A")]
    for limit in (64_000_000, 0):  # broadcast and shuffled
        found = exact_duplicates(docs(spark, rows), broadcast_bytes=limit)
        assert sorted(map(tuple, found.collect())) == [(2, 2), (3, 1), (5, 4), (9, 8)]
    assert exact_duplicates(docs(spark, [])).count() == 0


def brute(rows):
    first, out, seen = {}, [], set()
    for i, text in rows:
        if i is not None and text is not None:
            first[text] = min(first.get(text, i), i)
    for i, text in rows:
        if i is not None and text is not None:
            if i != first[text] or (i, text) in seen:
                out.append((i, first[text]))
            seen.add((i, text))
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    """Also where different texts share a fingerprint, an id has several texts, and a row is repeated more often than one array lists."""
    rng = random.Random(4)
    rows = [(rng.randrange(60), rng.choice(["", "a", "b", "ab", "ba", "abc", "cab", "x" * 50])) for _ in range(300)]
    rows += [(1, "many")] * 250 + [(0, "once")]
    monkeypatch.setattr(exact_dedup, "LISTED", 100)
    for make in (exact_dedup.fingerprint, lambda: F.length("text").cast("long")):
        monkeypatch.setattr(exact_dedup, "fingerprint", make)
        for limit in (64_000_000, 0):
            assert sorted(map(tuple, exact_duplicates(docs(spark, rows), broadcast_bytes=limit).collect())) == brute(rows)
