"""Operator 3: language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A trigram is bound as the product of its
letters' vectors, rotated by their distance from the end; a text is the bundle (sum) of
all its trigrams.  Texts are compared with the languages' prototypes by cosine.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.text import frugal

DIMENSIONS = 1024
#: Labelled documents of each language that train its prototype, chosen by hash of the id.
TRAIN_PER_LANGUAGE = 200
#: Below this cosine with its best prototype a text is in no known language.
MIN_COSINE = 0.25

#: Trigrams from which on MIN_COSINE holds in full; the cosine of a shorter text is small whatever its language.
FULL_TRIGRAMS, LEAST_COSINE = 60, 0.1

#: Letters whose trigrams are bound once and kept in a table; any other letter's are bound where they occur.
_COMMON = "\0abcdefghijklmnopqrstuvwxyzäöüßéèêàçñóíá"
SYMBOLS = len(_COMMON)


def _letter(c: str) -> int:
    """The code point of the lower-case letter or mark, 0 for any other character."""
    low = c.lower()
    return ord(low if len(low) == 1 else c) if c.isalpha() or unicodedata.category(c)[0] == "M" else 0


_LETTER = np.array([0 if 0xD800 <= c < 0xE000 else _letter(chr(c)) for c in range(0x10000)], np.uint32)
_INDEX = np.full(0x10000, -1, np.int32)
for _i, _c in enumerate(_COMMON):
    _INDEX[ord(_c)] = _i


@lru_cache(maxsize=20_000)
def letter_vector(point: int) -> np.ndarray:
    """The random vector of a letter, drawn from its code point; that of 0 stands for what is no letter."""
    return np.random.default_rng([7, point]).choice(np.array([-1, 1], np.int8), DIMENSIONS)


def trigram_vectors() -> np.ndarray:
    """The bound vector of every trigram of common letters, as a table of (SYMBOLS**3, DIMENSIONS / 8): a bit set for 1, clear for -1."""
    letters = np.stack([letter_vector(ord(c)) for c in _COMMON])
    a, b = np.roll(letters, 2, 1), np.roll(letters, 1, 1)
    pairs = (a[:, None, :] * b[None, :, :]).reshape(-1, DIMENSIONS)
    out = np.empty((SYMBOLS**3, DIMENSIONS // 8), np.uint8)
    for c in range(SYMBOLS):
        out[c::SYMBOLS] = np.packbits(pairs * letters[c] > 0, axis=1)
    return out


_table: list[np.ndarray] = []


def _rare(letters: np.ndarray) -> np.ndarray:
    """The bundle of the trigrams (rows of three code points), bound here; equal ones once."""
    wide = letters.astype(np.uint64)
    code, count = np.unique(wide[:, 0] << np.uint64(42) | wide[:, 1] << np.uint64(21) | wide[:, 2], return_counts=True)
    total = np.zeros(DIMENSIONS, np.float32)
    for at in range(0, len(code), 4096):
        part = code[at : at + 4096]
        parts = []
        for shift, turn in ((42, 2), (21, 1), (0, 0)):
            point, place = np.unique(part >> np.uint64(shift) & np.uint64(0x1FFFFF), return_inverse=True)
            parts.append(np.roll(np.stack([letter_vector(int(x)) for x in point]), turn, 1)[place])
        total += count[at : at + 4096].astype(np.float32) @ (parts[0] * parts[1] * parts[2]).astype(np.float32)
    return total


def bundle(text: str) -> tuple[np.ndarray, int]:
    """The text's vector and its number of trigrams with a letter in the middle."""
    if not _table:
        _table.append(trigram_vectors())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = _LETTER[np.minimum(points, 0xFFFF)]
    if len(points) and points.max() > 0xFFFF:
        high, place = np.unique(points[points > 0xFFFF], return_inverse=True)
        symbol[points > 0xFFFF] = np.array([_letter(chr(x)) for x in high], np.uint32)[place]
    if len(symbol) < 3:
        return np.zeros(DIMENSIONS, np.float32), 0
    # runs of other characters count once: spacing and decoration don't drown the letters
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] > 0) | (symbol[:-1] > 0)
    symbol = symbol[keep]
    index = np.where(symbol < 0x10000, _INDEX[np.minimum(symbol, 0xFFFF)], -1)
    middle = symbol[1:-1] > 0
    common = (index[:-2] >= 0) & (index[1:-1] >= 0) & (index[2:] >= 0)
    code = ((index[:-2] * SYMBOLS + index[1:-1]) * SYMBOLS + index[2:])[middle & common]
    total = np.zeros(DIMENSIONS, np.float32)
    if len(code):
        count = np.bincount(code, minlength=1)
        used = np.flatnonzero(count)
        for at in range(0, len(used), 4096):
            part = used[at : at + 4096]
            n = count[part].astype(np.float32)
            total += 2 * (n @ np.unpackbits(_table[0][part], axis=1).astype(np.float32)) - n.sum()
    other = np.flatnonzero(middle & ~common)
    if len(other):
        total += _rare(np.stack([symbol[other], symbol[other + 1], symbol[other + 2]], 1))
    return total, int(middle.sum())


def unit(x: np.ndarray) -> np.ndarray:
    return x / max(float(np.linalg.norm(x)), 1e-12)


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> dict[str, np.ndarray]:
    """A prototype for each non-null value of ``lang``: the bundle of its sample's unit vectors.

    The sample is the ``per_language`` documents with the smallest hashes of their ids, a
    bound that holds at every size of corpus.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    ids = F.broadcast(chosen.select("doc_id").distinct())  # at most per_language ids for each language
    sample = docs.join(ids, "doc_id", "left_semi").select("doc_id", "lang", "text").where("lang is not null and text is not null")
    total: dict[str, np.ndarray] = {}
    for row in sorted(sample.collect(), key=lambda r: (r.lang, r.doc_id, r.text)):
        vector, n = bundle(row.text)
        if n:
            total[row.lang] = total.get(row.lang, np.zeros(DIMENSIONS, np.float32)) + unit(vector)
    return {k: unit(v) for k, v in sorted(total.items())}


def scores(text: str, names: list[str], matrix: np.ndarray) -> tuple[str | None, float, int]:
    """The best language, its cosine and the number of trigrams; None and 0 for a text without trigrams or without prototypes."""
    vector, n = bundle(text)
    if not n or not names:
        return None, 0.0, 0
    cosine = matrix @ unit(vector)
    best = int(np.argmax(cosine))
    return names[best], float(cosine[best]), n


def bound(n: int, min_cosine: float = MIN_COSINE) -> float:
    """Least cosine that a text of n trigrams must have."""
    return min(min_cosine, max(LEAST_COSINE, min_cosine * math.sqrt(n / FULL_TRIGRAMS)))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], min_cosine: float = MIN_COSINE) -> DataFrame:
    """All rows and columns of ``docs`` with ``hd_lang``, ``hd_cosine`` and ``hd_accepted``.

    Null, empty and letterless texts have a null language, cosine 0 and are rejected; of
    languages that tie the first by name wins.  A text is accepted from ``min_cosine`` on, a
    short one from less on (:func:`bound`).  Columns of ``docs`` with these names are
    replaced.  Repeated rows and null ids come out as they went in.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), DIMENSIONS)
    kept = [c for c in docs.columns if c not in ("hd_lang", "hd_cosine", "hd_accepted")]
    at = kept.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(None, 0.0, 0) if t is None else scores(t, names, matrix) for t in b.column(at).to_pylist()]
            extra = [pa.array([k for k, _, _ in found], pa.string()), pa.array([c for _, c, _ in found], pa.float64()), pa.array([k is not None and c >= bound(n, min_cosine) for k, c, n in found], pa.bool_())]
            yield pa.record_batch([*b.columns, *extra], [*kept, "hd_lang", "hd_cosine", "hd_accepted"])

    base = docs.select(*kept)
    schema = T.StructType(list(base.schema.fields)).add("hd_lang", "string").add("hd_cosine", "double").add("hd_accepted", "boolean")
    return base.mapInArrow(frugal(apply), schema)
