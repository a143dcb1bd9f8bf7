"""Operator 5: document quality by a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over overlapping chunks of eight bytes that cover
the whole document, each filter is max-pooled over all chunks, and a logistic layer
combines the maxima into the probability that the document is good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.text import slices, utf8

EMBED, WIDTH, STRIDE, FILTERS = 8, 8, 1, 40
#: How much more a bad document counts in training than a good one, of which there are more.
BAD_WEIGHT = 2.5
#: Filters that begin as byte patterns; the others begin at random.
PATTERNS = 32
#: Labelled documents that train the network, chosen by hash of the id: a bound at every size of corpus.
TRAIN_DOCS = 2500
#: Least probability with which a filter keeps a document: low, so that good ones stay.
KEEP = 0.3
#: Bytes that are convolved at once.
CHUNK = 400_000
#: Groups of WIDTH places that are convolved in one product: its operands stay in the cache.
GROUPS = 2048


class Network:
    def __init__(self, embed: np.ndarray, filters: np.ndarray, bias: np.ndarray, out: np.ndarray, offset: float):
        self.embed, self.filters, self.bias, self.out, self.offset = embed, filters, bias, out, offset

    @classmethod
    def constant(cls, probability: float) -> Network:
        p = min(max(probability, 1e-3), 1 - 1e-3)
        zero = np.zeros(FILTERS, np.float32)
        return cls(np.zeros((257, EMBED), np.float32), np.zeros((WIDTH * EMBED, FILTERS), np.float32), zero, zero, float(np.log(p / (1 - p))))

    def pooled(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, FILTERS) maxima over the rows' chunks, and all chunks of padded()."""
        data, begin = padded(raw, offsets)
        windows = (len(data) - WIDTH) // STRIDE + 1
        pieces = self.embed[data].reshape(-1, STRIDE * EMBED)
        parts = self.filters.reshape(WIDTH // STRIDE, STRIDE * EMBED, FILTERS)
        h = pieces[:windows] @ parts[0]
        for k in range(1, WIDTH // STRIDE):
            h += pieces[k : k + windows] @ parts[k]
        # a row's last chunk is the one of padding alone; those that would reach the next row's bytes don't count
        spans = np.stack((begin[:-1] // STRIDE, (begin[1:] - WIDTH) // STRIDE + 1), 1).ravel()
        top = np.maximum.reduceat(h, spans, axis=0)[::2]
        return top, h

    def maxima(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The maxima of pooled(): rows begin at multiples of WIDTH, so the chunks of one remainder lie side by side and are one product."""
        data, begin = padded(raw, offsets, WIDTH, WIDTH + 1)
        groups, wide = begin[-1] // WIDTH, WIDTH * EMBED
        top = np.empty((groups, FILTERS), np.float32)
        for at in range(0, groups, GROUPS):
            h = top[at : at + GROUPS]
            x = self.embed[data[at * WIDTH : (at + len(h) + 1) * WIDTH]].ravel()
            np.matmul(x[: h.shape[0] * wide].reshape(-1, wide), self.filters, out=h)
            for k in range(STRIDE * EMBED, wide, STRIDE * EMBED):
                np.maximum(h, x[k : k + h.shape[0] * wide].reshape(-1, wide) @ self.filters, out=h)
        # a row's last group is of padding, and only its chunks would reach the next row's bytes: it doesn't count
        spans = np.stack((begin[:-1] // WIDTH, begin[1:] // WIDTH - 1), 1).ravel()
        return np.maximum.reduceat(top, spans, axis=0)[::2]

    def probability(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        top = self.maxima(raw, offsets)
        return sigmoid(np.maximum(top + self.bias, 0) @ self.out + self.offset)

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """One probability for each text; nulls count as empty texts."""
        out = np.zeros(len(texts))
        for first, part in slices(texts, CHUNK):
            out[first : first + len(part)] = self.probability(*utf8(part))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def padded(raw: np.ndarray, offsets: np.ndarray, step: int = STRIDE, least: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with each row followed by ``least`` or more places of padding (256), and the rows' beginnings, multiples of ``step``."""
    length = np.diff(offsets)
    room = -(-(length + least) // step) * step
    begin = np.concatenate(([0], np.cumsum(room)))
    data = np.full(begin[-1] + WIDTH, 256, np.int16)
    data[np.arange(len(raw)) + np.repeat(begin[:-1] - offsets[:-1], length)] = raw
    return data, begin


def _patterns(raws: list[np.ndarray], good: np.ndarray, n: int = 6, cells: int = 1 << 18) -> list[np.ndarray]:
    """Byte n-grams whose presence tells bad documents from good ones best, for the filters' beginnings: greedily, so that each adds documents."""
    count = np.zeros((2, cells))
    codes = []
    for raw in raws:
        x = raw.astype(np.uint64)
        code = np.zeros(max(len(x) - n + 1, 0), np.uint64)
        for k in range(n):
            code = code * np.uint64(1099511628211) + x[k : len(x) - n + 1 + k] + np.uint64(17)
        codes.append(((code ^ (code >> np.uint64(29))) % np.uint64(cells)).astype(np.int64))
    for code, g in zip(codes, good):
        count[int(g), np.unique(code)] += 1
    size = np.bincount(good.astype(int), minlength=2)[:, None] + 1
    bad = [(raw, np.unique(code), code) for raw, code, g in zip(raws, codes, good) if not g]
    weight = np.ones(len(bad))
    chosen: list[np.ndarray] = []
    while len(chosen) < PATTERNS:
        share = (np.maximum(count, 0) + 0.5) / size
        cell = int(np.argmax((share[0] - 4 * share[1]) / np.sqrt(share.sum(0) + 0.01)))
        gram = None
        for k, (raw, own, code) in enumerate(bad):
            if cell in own:
                gram = raw[np.flatnonzero(code == cell)[0] :][:n] if gram is None else gram
                # documents that hold it count half from here on: the next pattern tells others
                count[0, own] -= weight[k] / 2
                weight[k] /= 2
        count[0, cell] = 0
        if gram is None:
            break
        if all(not np.array_equal(gram, c) for c in chosen):
            chosen.append(gram)
    return chosen


def fit(texts: list[str], good: list[bool], epochs: int = 10, batch: int = 32, rate: float = 0.015, seed: int = 3) -> Network:
    """Trains on labelled texts with Adam; deterministic.  One class alone gives a constant."""
    target = np.array(good, np.float32)
    if not len(target) or target.min() == target.max():
        return Network.constant(float(target.mean()) if len(target) else 0.5)
    rng = np.random.default_rng(seed)
    raws = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    embed = rng.normal(0, 1, (257, EMBED)).astype(np.float32)
    embed /= np.linalg.norm(embed, axis=1, keepdims=True)
    embed[256] = 0
    filters = rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)).astype(np.float32)
    for f, gram in enumerate(_patterns(raws, target > 0.5)):
        shift = f % (WIDTH - len(gram) + 1)
        filters[:, :, f] = 0
        filters[shift : shift + len(gram), :, f] = embed[gram]
    out = np.concatenate([np.full(PATTERNS, -0.5), rng.normal(0, 0.1, FILTERS - PATTERNS)]).astype(np.float32)
    net = Network(embed, filters.reshape(-1, FILTERS), np.full(FILTERS, -3.0, np.float32), out, float(np.log(target.mean() / (1 - target.mean()))))
    params = [net.embed, net.filters, net.bias, net.out]
    moment, second, b, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], np.zeros(2), 0
    for _ in range(epochs):
        order = rng.permutation(len(raws))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            raw = np.concatenate([raws[r] for r in rows])
            offsets = np.concatenate(([0], np.cumsum([len(raws[r]) for r in rows])))
            top, h = net.pooled(raw, offsets)
            data, begin = padded(raw, offsets)
            active = np.maximum(top + net.bias, 0)
            p = sigmoid(active @ net.out + net.offset)
            error = ((p - target[rows]) * np.where(target[rows] > 0.5, 1.0, BAD_WEIGHT) / len(rows)).astype(np.float32)
            d_out = active.T @ error + 1e-4 * net.out
            d_top = np.outer(error, net.out) * (active > 0)
            d_bias = d_top.sum(0)
            d_filters, d_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
            first, last = begin[:-1] // STRIDE, (begin[1:] - WIDTH) // STRIDE + 1
            for r in range(len(rows)):
                used = np.flatnonzero(d_top[r])
                if len(used):
                    place = (first[r] + np.argmax(h[first[r] : last[r]][:, used], 0)) * STRIDE
                    chunk = data[place[:, None] + np.arange(WIDTH)]
                    d_filters[:, used] += (net.embed[chunk].reshape(len(used), -1) * d_top[r, used][:, None]).T
                    np.add.at(d_embed, chunk, (net.filters[:, used].T * d_top[r, used][:, None]).reshape(len(used), WIDTH, EMBED))
            d_embed[256] = 0
            step += 1
            pace = rate * (1 - (step - 1) / (epochs * -(-len(raws) // batch)))  # falls to zero
            for k, g in enumerate((d_embed, d_filters, d_bias, d_out)):
                moment[k] = 0.9 * moment[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= (pace * moment[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            g = float(error.sum())
            b[0], b[1] = 0.9 * b[0] + 0.1 * g, 0.999 * b[1] + 0.001 * g * g
            net.offset -= pace * b[0] / (1 - 0.9**step) / (np.sqrt(b[1] / (1 - 0.999**step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, **options) -> Network:
    """Fits on at most ``most`` labelled documents: good is quality 1 and not toxic.

    Of several labels of a document the worst counts; a null quality or id, or a null text,
    is no label, a null toxic is not toxic.
    """
    worst = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("x"))
    chosen = worst.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows
    rows = sorted(sample.collect(), key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in rows], [r.q == 1 and r.x != 1 for r in rows], **options)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, probability): every row's probability of being good, over its whole text.

    Null and empty texts get the probability of an empty document; null ids and repeated
    rows come out as they went in; other columns are not read.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(net.probabilities(b.column(1)), pa.float64())], ["doc_id", "probability"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, probability double")
