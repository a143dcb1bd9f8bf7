import random

import pytest

from palimpsest.llm import linedup, queries
from palimpsest.llm.linedup import deduplicate_lines, deleted_places
from tests.llm.helpers import docs, words


def all_pairs(rows, min_line, min_block):
    """Every pair of documents that share a line of ``min_line`` characters, in memory."""
    split = {i: [(k, x.strip(" ")) for k, x in enumerate(t.split("\n")) if x.strip(" ")] for i, t in rows}
    holders = {}
    for i, lines in split.items():
        for _, x in lines:
            holders.setdefault(x, set()).add(i)
    shared = {i: [(k, x) for k, x in lines if len(holders[x]) > 1] for i, lines in split.items()}
    out = {}
    for b, new in shared.items():
        gone = set()
        for a, old in shared.items():
            if a < b and any(len(x) >= min_line for x in {x for _, x in old} & {x for _, x in new}):
                gone.update(deleted_places([x for _, x in old], [x for _, x in new], [k for k, _ in new], [len(x) for _, x in new], min_block))
        out[b] = "\n".join(x for k, x in enumerate(dict(rows)[b].split("\n")) if k not in gone)
    return out


@pytest.mark.parametrize("min_line, min_block, hot", [(20, 20, 50_000), (30, 14, 3)])
def test_against_all_pairs(spark, monkeypatch, min_line, min_block, hot):
    monkeypatch.setattr(linedup, "HOT_PAIRS", hot)  # a few pairs: most earlier documents are given to several tasks
    rng = random.Random(9)
    pool = [" ".join(words(rng, rng.randint(4, 7))) for _ in range(12)] + ["short", "brief line", "tiny"]
    rows = []
    for i in range(90):
        lines = [rng.choice(pool) if rng.random() < 0.7 else " ".join(words(rng, 5)) for _ in range(rng.randint(1, 9))]
        rows.append((i, "\n".join(lines)))
    rows += [(200 + k, rows[3][1]) for k in range(12)]
    got = {r.doc_id: r.text for r in deduplicate_lines(docs(spark, rows), 4, min_line, min_block, every_holder=True).collect()}
    capped = {r.doc_id: r.text for r in deduplicate_lines(docs(spark, rows), 4, min_line, min_block).collect()}
    assert got == all_pairs(rows, min_line, min_block) != capped


def test_query_cuts_what_a_further_holder_aligns(spark, tmp_path):
    """Six documents hold a line; the last has it before an anchor that the first has after it."""
    a, b = "the line that many documents hold", "another line, in a few of them"
    rows = [(1, b + "\n" + a), *((k, a) for k in range(2, 6)), (6, a + "\n" + b)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.text for r in queries.QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()}
    assert found == {1: rows[0][1]} | {k: "" for k in range(2, 7)}
