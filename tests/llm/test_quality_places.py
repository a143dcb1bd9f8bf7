import numpy as np
import pyarrow as pa

from palimpsest.llm import quality as Q


def test_a_pattern_is_seen_at_every_byte():
    """One filter, a pattern of six bytes: it must answer alike wherever the pattern begins."""
    rng = np.random.default_rng(5)
    embed = rng.normal(size=(257, Q.EMBED)).astype(np.float32)
    embed /= np.linalg.norm(embed, axis=1, keepdims=True)
    embed[256] = 0
    filters = np.zeros((Q.WIDTH, Q.EMBED, Q.FILTERS), np.float32)
    filters[:6, :, 0] = embed[np.frombuffer(b"poison", np.uint8)]
    net = Q.Network(embed, filters.reshape(-1, Q.FILTERS), np.full(Q.FILTERS, -5.5, np.float32), np.full(Q.FILTERS, -9, np.float32), 2.0)
    found = net.probabilities(pa.array(["." * k + "poison" + "." * 9 for k in range(8)], pa.large_string()))
    assert np.allclose(found, found[0]) and found[0] < 0.5
