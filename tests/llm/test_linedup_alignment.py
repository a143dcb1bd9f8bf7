import random

from palimpsest.llm.linedup import _increasing, common_subsequence, deduplicate_lines, patience
from tests.llm.helpers import docs


def longest(old, new):
    size = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i, x in enumerate(old):
        for j, y in enumerate(new):
            size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
    return size[-1][-1]


def valid(found, old, new):
    return all(old[i] == new[j] for i, j in found) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:]))


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(500):
        old, new = ([rng.randrange(4) for _ in range(rng.randrange(30))] for _ in range(2))
        found = common_subsequence(old, new)
        assert len(found) == longest(old, new) and valid(found, old, new)


def test_lines_repeated_in_both():
    assert patience(list("abab"), list("abab")) == [(k, k) for k in range(4)]  # no anchor at all
    assert patience(list("aXbaYb"), list("aZbaYb"))[-3:] == [(3, 3), (4, 4), (5, 5)]
    assert len(patience(list("xapaqy"), list("xaraqy"))) == 5  # unique only within the gap, or not even there
    rng = random.Random(3)
    for _ in range(500):
        old, new = ([rng.randrange(4) for _ in range(rng.randrange(20))] for _ in range(2))
        assert valid(patience(old, new), old, new)
        if not any(old.count(x) == 1 == new.count(x) for x in old):
            assert len(patience(old, new)) == longest(old, new)


def test_copy_of_repeated_lines_is_cut(spark):
    a, b = "the first line of this text", "the second line of this text"
    text = "\n".join([a, b, a, b])
    found = {r.doc_id: r.text for r in deduplicate_lines(docs(spark, [(1, text), (2, text)])).collect()}
    assert found == {1: text, 2: ""}


def test_anchors_are_the_longest_chain():
    """The chain of unique common lines is as long as the longest found by trying all ends, and patience keeps all of it."""
    rng = random.Random(6)
    for _ in range(300):
        old, new = rng.sample(range(40), rng.randrange(25)), rng.sample(range(40), rng.randrange(25))  # every line once
        anchors = [(old.index(x), j) for j, x in enumerate(new) if x in old]
        best = []
        for k, (i, _) in enumerate(anchors):
            best.append(1 + max((best[m] for m in range(k) if anchors[m][0] < i), default=0))
        chain = _increasing(anchors)
        assert len(chain) == max(best, default=0) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(chain, chain[1:]))
        assert len(patience(old, new)) == len(chain)
