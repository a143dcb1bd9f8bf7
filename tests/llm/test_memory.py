import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa

from palimpsest.llm import language as L
from palimpsest.llm import setjoin as S
from palimpsest.llm.text import frugal


def _peak_mb(work, batches):
    """MB of Python and numpy at most while the batches are worked on."""
    tracemalloc.start()
    try:
        for _ in work(iter(batches)):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_hashing_and_signatures_of_a_batch_take_little_at_once():
    """Twelve MB of text, in documents of 3 KB: slices of 2 MB took 82 MB here."""
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(5000)]
    texts = [" ".join(words[k] for k in rng.integers(0, len(words), 500)) for _ in range(4000)]
    batch = pa.record_batch([pa.array(range(4000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    assert _peak_mb(lambda bs: (n for _, n in S._sets(bs, 1)), [batch]) < 60


def test_the_trigram_table_is_packed_and_bundles_as_by_hand():
    table = L.trigram_vectors()
    assert table.nbytes < 10_000_000
    L.bundle("a")
    text = "abc bca cab " * 3
    want = np.zeros(L.DIMENSIONS)
    for x, y, z in zip(text, text[1:], text[2:]):
        if y != " ":
            a, b, c = (L.letter_vector(0 if s == " " else ord(s)).astype(int) for s in (x, y, z))
            want += np.roll(a, 2) * np.roll(b, 1) * c
    assert np.array_equal(L.bundle(text)[0], want)


def _anon_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_freed_memory_goes_back():
    def work(batches):
        for b in batches:
            pieces = [np.ones(12_000) for _ in range(1500)]  # 96 KB each, too small to be mapped one by one
            pins.extend(pieces[::100])
            del pieces
            held.append(_anon_mb())
            yield b

    pins, held = [], []
    assert len(list(frugal(work)(iter([1, 2])))) == 2
    assert _anon_mb() < held[-1] - 60
