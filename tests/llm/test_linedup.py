import random

from palimpsest.llm.linedup import deduplicate_lines, deleted_places, patience
from tests.llm.helpers import docs, words


def brute(rows, rare, min_line, min_block):
    """Every rule as stated, over all pairs in memory."""
    held = {}
    split = {i: [(k, x.strip(" ")) for k, x in enumerate(t.split("\n")) if x.strip(" ")] for i, t in rows}
    for i, lines in split.items():
        for _, x in lines:
            held.setdefault(x, []).append(i)
    shared = {x for x, own in held.items() if len(set(own)) > 1}
    pairs = set()
    for x in shared:
        if len(x) >= min_line:
            own = sorted(set(held[x]))
            pairs |= {(a, b) for a in own for b in own if a < b} if len(held[x]) <= rare else {(own[0], b) for b in own[1:]}
    out = {}
    for a, b in pairs:
        new = [(k, x) for k, x in split[b] if x in shared]
        cut = deleted_places([x for _, x in split[a] if x in shared], [x for _, x in new], [k for k, _ in new], [len(x) for _, x in new], min_block)
        out.setdefault(b, set()).update(cut)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in out.get(i, ())) for i, t in rows}


def test_patience():
    assert patience(list("abcd"), list("xabyd")) == [(0, 1), (1, 2), (3, 4)]
    assert patience(list("aab"), list("aab")) == [(0, 0), (1, 1), (2, 2)]  # repeats are reached from the anchor
    assert patience(list("ab"), list("ba")) in ([(0, 1)], [(1, 0)])
    assert patience([], list("a")) == []
    rng = random.Random(1)
    for _ in range(200):
        old, new = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        found = patience(old, new)
        assert all(old[i] == new[j] for i, j in found) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:]))


def test_against_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join(words(rng, 6)) for _ in range(25)] + ["short"]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.5 else " ".join(words(rng, 5)) for _ in range(rng.randint(1, 9))]
        rows.append((i, "\n".join(lines)))
    rows += [(100 + k, rows[3][1]) for k in range(12)]
    found = {r.doc_id: r.text for r in deduplicate_lines(docs(spark, rows)).collect()}
    assert found == brute(rows, 4, 20, 20)


def test_edge_cases(spark):
    line = "a line that is long enough to count"
    rows = [(1, line + "\nfirst own"), (2, "x\n" + line), (2, "x\n" + line), (3, None), (4, ""), (None, line), (5, line), (6, "\n".join([line] + ["own %d" % k for k in range(20_000)]))]
    out = deduplicate_lines(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    assert {r.row_key for r in out.collect()} == {"r"}  # a column with an inner name keeps its values
    found = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert found[0] == (1, line + "\nfirst own", len(line) + 10)
    assert found[1] == found[2] == (2, "x", 1) and found[3] == (3, None, None) and found[4] == (4, "", 0) and found[5] == (5, "", 0)
    assert found[6][1].startswith("own 0\nown 1\n") and found[7][:2] == (None, "")
    assert deduplicate_lines(docs(spark, [])).count() == 0
