import random
import time
from itertools import product

from palimpsest.llm.html import _prefix, common_subsequence, extract, text_lines

SCHEMA = "page_id long, url string, html string, host string, path string, row long, lines string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "p", 1, "l", "t") for r in rows], SCHEMA)


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(10))] for _ in range(2))
        found = common_subsequence(a, b)
        assert len(found) == longest(a, b) and all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))


def test_text_lines():
    page = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- <p>no</p> --><p title="a>b">One <b>two</b> &amp; three<br>four<li>five<p>un"closed <a href=x>six'
    assert text_lines(page) == ["One two & three", "four", "five", 'un"closed six']
    assert text_lines(None) == text_lines("") == [] and text_lines("<script>never closed") == []
    assert text_lines('<p class="open>text</p>') == ["text"]
    assert text_lines("a\n b\r\nc") == ["a b c"]


def brute(rows):
    """The stated rules over all pages of a host in memory."""
    import re

    def parts(url):
        m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", url or "")
        path = m[2] if m else re.match(r"^([^?#]*)", url or "")[1]
        return (m[1].lower() if m else ""), re.sub(r"/+$", "", re.sub(r"\.html?$", "", path))

    def prefix(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    out = []
    for page_id, url, page in rows:
        host, path = parts(url)
        paths = sorted({parts(u)[1] for _, u, _ in rows if parts(u)[0] == host})
        at = paths.index(path)
        near = [p for p in (paths[at - 1] if at else None, paths[at + 1] if at + 1 < len(paths) else None) if p is not None]
        best = max(near, key=lambda p: prefix(path, p), default=None)
        other = min((r for r in rows if parts(r[1]) == (host, best)), default=None, key=lambda r: r[0]) if best is not None else None
        own = text_lines(page)
        gone = {i for i, _ in common_subsequence(own, text_lines(other[2]) if other else [])}
        out.append((page_id, url, other[0] if other else None, "\n".join(x for i, x in enumerate(own) if i not in gone), len(gone)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        lines = ["Menu", f"body {i}", *(rng.choice(["ad one", "ad two", "note"]) for _ in range(3)), "Footer"]
        rows.append((i, f"https://{rng.choice('AB')}.org/{rng.choice(['x', 'y'])}/{rng.randrange(40)}{rng.choice(['', '/', '.html', '?q=1', '#a'])}", "".join(f"<p>{x}</p>" for x in lines)))
    for limit in (32_000_000, 0):
        import palimpsest.llm.html as H

        H.BROADCAST_PAIRS, kept = limit, H.BROADCAST_PAIRS
        found = extract(pages(spark, rows)).collect()
        H.BROADCAST_PAIRS = kept
        assert sorted(map(tuple, found)) == sorted(brute(rows))


def test_edge_cases(spark):
    rows = [(1, "http://a.org/p/1", "<p>menu<p>one"), (1, "http://a.org/p/1", "<p>menu<p>one"), (2, "http://a.org/p/2", None), (3, None, "<p>x"), (None, "http://b.org", ""), (4, "http://c.org/1", "<p>same"), (5, "http://c.org/1?v=2", "<p>same"), (6, "http://d.org/1", "<p>menu" + "<p>line" * 3000), (7, "http://d.org/2", "<p>menu<p>z")]
    found = {}
    for r in extract(pages(spark, rows)).collect():
        found.setdefault(r.page_id, []).append((r.neighbour_id, r.text, r.removed))
    assert found[1] == [(2, "menu\none", 0)] * 2 and found[2] == [(1, "", 0)] and found[3] == [(None, "x", 0)]
    assert found[None] == [(None, "", 0)] and found[4] == found[5] == [(None, "same", 0)]
    assert found[6] == [(7, "\n".join(["line"] * 3000), 1)] and found[7] == [(6, "z", 1)]
    assert extract(pages(spark, [])).count() == 0


def test_repeated_lines_take_little_time():
    rng = random.Random(3)
    began = time.process_time()
    assert len(common_subsequence(["x"] * 20_000, ["x"] * 15_000)) == 15_000
    a, b = ["s", *rng.choices("ab", k=4000), "t"], ["u", *rng.choices("ab", k=4000), "v"]
    found = common_subsequence(a, b)
    assert len(found) > 3000 and all(a[i] == b[j] for i, j in found)
    assert time.process_time() - began < 10


def test_neighbours_across_slices(spark):
    """A host whose paths lie in several slices: neighbours are those of the whole host."""
    rows = [(i, f"http://{'a' if i % 3 else 'b'}.org/{i:04d}{'x' * (i % 7)}", f"<p>menu<p>page {i}") for i in range(400)]
    found = sorted(map(tuple, extract(pages(spark, rows)).collect()))
    assert found == sorted(brute(rows)) and all(n == 1 for *_, n in found)


def test_prefix(spark):
    pairs = [("", ""), ("a", ""), ("abc", "abd"), ("abc", "abc"), ("abc", "abcd"), ("x" * 3000 + "a", "x" * 3000 + "b"), ("üéa", "üéb"), ("q", "r")]
    table = spark.createDataFrame(pairs, "a string, b string")
    for row in table.select("a", "b", _prefix("a", "b").alias("n")).collect():
        assert row.n == next((k for k, (x, y) in enumerate(zip(row.a, row.b)) if x != y), min(len(row.a), len(row.b)))
