import time

import numpy as np

from palimpsest.llm import quality as Q
from tests.llm.test_quality import _net


def test_scoring_costs_less_than_pooling_every_chunk_and_finds_the_same():
    net, rng = _net(), np.random.default_rng(4)
    length = np.concatenate((np.arange(40), [0, 0, 1], rng.integers(1, 4000, 190)))
    offsets = np.concatenate(([0], np.cumsum(length)))
    raw = rng.integers(0, 256, offsets[-1]).astype(np.uint8)
    assert np.allclose(net.maxima(raw, offsets), net.pooled(raw, offsets)[0], atol=1e-4)

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f(raw, offsets)
            took.append(time.process_time() - began)
        return min(took)

    assert least(net.probability) < 0.6 * least(net.pooled)
