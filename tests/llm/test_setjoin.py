import random
import re

import numpy as np
import pytest

from palimpsest.llm import setjoin as S
from tests.llm.helpers import docs, edited, words


def classes(rows, n):
    """Ids of each set of word n-grams."""
    bag = {}
    for i, text in rows:
        w = [] if i is None or text is None else re.findall("[a-z0-9\u0080-\U0010ffff]+", text.lower())
        if w:
            n_ = min(n, len(w))
            bag.setdefault(frozenset(tuple(w[k : k + n_]) for k in range(len(w) - n_ + 1)), set()).add(i)
    return bag


def brute(rows, n, threshold):
    """(pairs of class representatives and membership, one row a document), from all pairs of sets."""
    bag = classes(rows, n)
    sets = list(bag)
    pairs, links, best, group = [], {}, {}, {s: {s} for s in sets}
    for x, a in enumerate(sets):
        pairs += [(min(bag[a]), i, 1.0) for i in bag[a] - {min(bag[a])}]
        for b in sets[x + 1 :]:
            j = len(a & b) / len(a | b)
            if j >= threshold - 1e-9:
                pairs.append((*sorted((min(bag[a]), min(bag[b]))), round(j, 6)))
                for p, q in ((a, b), (b, a)):
                    links[p] = links.get(p, 0) + len(bag[q])
                    best[p] = max(best.get(p, 0), j)
                if group[a] is not group[b]:
                    group[a] |= group[b]
                    for m in group[a]:
                        group[m] = group[a]
    out = []
    for s in sets:
        if s in links or len(bag[s]) > 1:
            least = min(min(bag[m]) for m in group[s])
            out += [(i, least, links.get(s, 0) + len(bag[s]) - 1, 1.0 if len(bag[s]) > 1 else round(best[s], 6)) for i in bag[s]]
    return sorted(pairs), sorted(out)


def corpus(seed, sizes, copies):
    rng = random.Random(seed)
    rows = []
    for size in sizes:
        base = words(rng, size)
        for k in range(copies):
            rows.append(" ".join(edited(rng, base, rng.randint(0, max(1, size // 6))) if k else base))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("n,threshold", [(1, 0.8), (2, 0.8), (1, 0.9), (3, 0.7)])
def test_against_brute_force(spark, n, threshold):
    rows = corpus(n, [1, 2, 3, 5, 8, 12, 20, 33, 60, 61, 64, 90, 150, 400], 7)
    pairs, documents = brute(rows, n, threshold)
    found = S.jaccard_pairs(docs(spark, rows), n, threshold).collect()
    assert sorted((r.doc_a, r.doc_b, round(r.jaccard, 6)) for r in found) == pairs
    found = S.jaccard_join(docs(spark, rows), n, threshold).collect()
    assert sorted((r.doc_id, r.class_id, r.links, round(r.jaccard, 6)) for r in found) == documents


@pytest.mark.parametrize("tokens,sets", [(50, 1000), (10**6, 3), (1, 1)])
def test_blocks_lose_no_link(spark, monkeypatch, tokens, sets):
    """Groups that are cut into many blocks give what they give in one."""
    monkeypatch.setattr(S, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(S, "BLOCK_SETS", sets)
    rows = corpus(5, [12, 40, 41], 12)
    rows += [(1000 + i, text) for i, text in rows[:5]]
    pairs, documents = brute(rows, 1, 0.8)
    found = S.jaccard_pairs(docs(spark, rows)).collect()
    assert sorted((r.doc_a, r.doc_b, round(r.jaccard, 6)) for r in found) == pairs
    found = S.jaccard_join(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id, r.links, round(r.jaccard, 6)) for r in found) == documents
    gone = sorted(map(tuple, S.near_duplicates(docs(spark, rows)).collect()))
    assert gone == sorted((i, c) for i, c, _, _ in documents if i != c)


def test_every_similar_pair_hits_often_enough():
    """The pigeonhole on random sets: no pair may be missed, whatever the costs are."""
    rng = np.random.default_rng(3)
    bands = S.Bands(0.8)
    routes = S.Routes(np.ones(S.MOST_BANDS, np.int64), 50)
    for _ in range(300):
        size = int(rng.integers(1, 120))
        both = rng.integers(1, 2**63, size, dtype=np.uint64)
        a = np.unique(np.concatenate((both, rng.integers(1, 2**63, int(rng.integers(0, size // 8 + 1)), dtype=np.uint64))))
        b = np.unique(np.concatenate((both, rng.integers(1, 2**63, int(rng.integers(0, size // 8 + 1)), dtype=np.uint64))))
        if len(a) < len(b):
            a, b = b, a
        if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.8 or np.array_equal(a, b):
            continue
        cost = np.log(rng.random(len(a)))
        probe = S.probe_signatures(a, S.mix64(a), cost, bands, routes)
        index = S.index_signatures(b, S.mix64(b), bands, routes)
        assert np.isin(probe, index).sum() >= S.HITS


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 6), (6, 7), (7, 8), (8, 9), (9, 3), (20, 21), (21, 20)]
    table = spark.createDataFrame(edges, "a long, b long")
    expected = {1: 1, 2: 1, 3: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 10, 11: 10, 20: 20, 21: 20}
    for limit in (1000, 0):  # one task, and the distributed rounds
        found = {r.member: r.component for r in S.components(table, limit).collect()}
        assert found == expected
    assert S.components(table.limit(0)).count() == 0


def test_edge_cases(spark):
    long = " ".join(words(random.Random(9), 30_000))
    rows = [(1, None), (2, ""), (3, "!!! ..."), (4, "Ein Wort"), (5, "ein wort!"), (6, "wort"), (7, long), (8, long + " tail"), (None, "ein wort"), (4, "Ein Wort"), (9, "solo")]
    found = sorted((r.doc_id, r.class_id, r.links) for r in S.jaccard_join(docs(spark, rows)).collect())
    assert found == [(4, 4, 1), (5, 4, 1), (7, 7, 1), (8, 7, 1)]
    assert sorted(map(tuple, S.near_duplicates(docs(spark, rows)).collect())) == [(5, 4), (8, 7)]
    assert S.jaccard_join(docs(spark, [])).count() == 0 and S.near_duplicates(docs(spark, [])).count() == 0 and S.jaccard_pairs(docs(spark, [])).count() == 0


def test_an_id_with_two_texts(spark):
    """Its sets are connected by it; each has a row."""
    one, two = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(7, one), (7, two), (5, one + " z"), (9, two + " y")]
    found = sorted((r.doc_id, r.class_id, r.links) for r in S.jaccard_join(docs(spark, rows)).collect())
    assert found == [(5, 5, 1), (7, 5, 1), (7, 5, 1), (9, 5, 1)]
    assert sorted(map(tuple, S.near_duplicates(docs(spark, rows)).collect())) == [(7, 5), (9, 5)]
