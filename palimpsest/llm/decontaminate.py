"""Operator 10: benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are sequences of word hashes.  The CGK random walk maps a window to a
string over the same alphabet in which edit distance has become Hamming distance: at each
step the current word is copied out, and a random bit of that word and step decides
whether the walk moves on.  Windows of an item's own size whose embeddings agree with the
item's on randomly sampled steps are candidates; an exact edit distance decides.

A walk over every window of the corpus is only needed where a match is possible: an item
of w words within d edits of a window is cut into d + 1 pieces, of which one must occur
unchanged (pigeonhole), so a window without any piece-long run of the item is skipped.
That filter loses nothing, and the sampled search starts from the runs that remain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.text import frugal, mix64, ngram_hashes, slices, word_hashes

#: Edits (words inserted, deleted or replaced) allowed, as a share of the item's words.
MAX_EDITS = 0.2
#: Probability with which a window at the allowed distance must become a candidate.
TARGET_RECALL = 0.97
#: Steps sampled by each hash.
SAMPLED = 2
#: Embedded steps that are held at once, 8 bytes each.
HELD = 2_000_000
#: Longest run of words that serves as a piece.
LONGEST_PIECE = 3


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    edits: int
    piece: int


class Index:
    """The embedded benchmark: bounded by the benchmark, not by the corpus."""

    def __init__(self, ids: list[int], texts: list[str | None], max_edits: float = MAX_EDITS, recall: float = TARGET_RECALL, seed: int = 11):
        self.items: list[Item] = []
        self.max_edits = max_edits
        words, at = word_hashes(pa.array([t or "" for t in texts], pa.large_string()))
        for k, item_id in enumerate(ids):
            own = words[at[k] : at[k + 1]]
            if len(own):
                edits = int(max_edits * len(own))
                self.items.append(Item(item_id, own, edits, max(1, min(LONGEST_PIECE, len(own) // (edits + 1)))))
        rng = np.random.default_rng(seed)
        longest = max((len(i.words) for i in self.items), default=1)
        self.steps = 3 * longest
        self.step_keys = rng.integers(1, 1 << 63, self.steps, dtype=np.uint64)
        # Of windows d edits apart, CGK embeddings of 3w steps differ in about 3d + d*d/2 steps
        # or fewer with constant probability; each table is a fresh sample of steps.
        self.tables = {}
        for w in sorted({len(i.words) for i in self.items}):
            d = int(max_edits * w)
            agree = max(0.25, 1 - (3 * d + d * d / 2) / (3 * w))
            need = math.ceil(math.log(1 - recall) / math.log(1 - agree**SAMPLED)) if agree < 1 else 1
            # early steps are the ones two similar windows are most likely to share
            self.tables[w] = [np.sort(rng.choice(3 * w, min(SAMPLED, 3 * w), replace=False)) for _ in range(max(4, need))]
        # only sampled steps are compared, so only they are kept of an embedding
        self.kept = {w: np.unique(np.concatenate(t)) for w, t in self.tables.items()}
        self.tables = {w: [np.searchsorted(self.kept[w], x) for x in t] for w, t in self.tables.items()}
        self.embedded = [self.walk(i.words, np.zeros(1, np.int64), np.full(1, len(i.words)), len(i.words))[0] for i in self.items]
        pieces, owner, place = [], [], []
        for k, item in enumerate(self.items):
            runs = ngram_hashes(item.words, item.piece) + np.uint64(item.piece)
            pieces.append(runs)
            owner.append(np.full(len(runs), k))
            place.append(np.arange(len(runs)))
        self.piece = np.concatenate(pieces) if pieces else np.zeros(0, np.uint64)
        order = np.argsort(self.piece, kind="stable")
        self.piece = self.piece[order]
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)
        self.sizes = sorted({i.piece for i in self.items})
        self.filter = {p: self._bitmap(p) for p in self.sizes}

    def _bitmap(self, size: int) -> np.ndarray:
        """A 16-bit prefilter of the pieces of one size."""
        bits = np.zeros(1 << 20, bool)
        for k, item in enumerate(self.items):
            if item.piece == size:
                bits[(ngram_hashes(item.words, size) + np.uint64(size)) >> np.uint64(44)] = True
        return bits

    def walk(self, words: np.ndarray, start: np.ndarray, end: np.ndarray, w: int) -> np.ndarray:
        """Embeddings of the windows [start, end) of ``words`` at the steps sampled for w: word hashes, 0 past the end."""
        kept = self.kept[w]
        out = np.zeros((len(start), len(kept)), np.uint64)
        at, column = start.copy(), 0
        for j in range(int(kept[-1]) + 1):
            inside = at < end
            word = words[np.minimum(at, len(words) - 1)]
            if kept[column] == j:
                out[:, column] = np.where(inside, word, 0)
                column += 1
            at = at + (inside & ((mix64(word ^ self.step_keys[j]) & np.uint64(1)) > 0))
        return out

    def runs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in words, item, place in item) of every common run of piece length."""
        found = []
        for size in self.sizes:
            grams = ngram_hashes(words, size) + np.uint64(size)
            near = np.flatnonzero(self.filter[size][grams >> np.uint64(44)])
            lo, hi = np.searchsorted(self.piece, grams[near], "left"), np.searchsorted(self.piece, grams[near], "right")
            count = hi - lo
            at = np.repeat(near, count)
            entry = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(count) else np.zeros(0, np.int64)
            found.append((at, self.owner[entry], self.place[entry]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def matches(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, edits) of the rows' best window for each item within its edits."""
        place, item, within = self.runs(words)
        row = np.searchsorted(at, place, "right") - 1
        # a run may not cross a row's end
        size = np.array([i.piece for i in self.items] or [1])[item] if len(item) else np.zeros(0, np.int64)
        ok = place + size <= at[row + 1] if len(row) else np.zeros(0, bool)
        place, item, within, row = place[ok], item[ok], within[ok], row[ok]
        if not len(place):
            return
        # the window that aligns the run; windows that begin up to ``edits`` words away
        start = place - within
        key = np.unique(np.stack([row, item, start], 1), axis=0)
        best: dict[tuple[int, int], int] = {}
        cuts = np.flatnonzero(np.concatenate(([True], (key[1:, 0] != key[:-1, 0]) | (key[1:, 1] != key[:-1, 1]), [True])))
        for a, b in zip(cuts[:-1], cuts[1:]):
            r, k = int(key[a, 0]), int(key[a, 1])
            found = self._search(words[at[r] : at[r + 1]], key[a:b, 2] - at[r], k)
            if found is not None:
                best[r, k] = found
        for (r, k), edits in sorted(best.items()):
            yield r, self.items[k].item_id, edits

    def _search(self, words: np.ndarray, starts: np.ndarray, k: int) -> int | None:
        item = self.items[k]
        w, d = len(item.words), item.edits
        # cheap necessary condition: an interval around the alignment shares w - d words with the item
        shared = np.isin(words, item.words)
        total = np.concatenate(([0], np.cumsum(shared)))
        lo, hi = np.clip(starts - d, 0, len(words)), np.clip(starts + w + d, 0, len(words))
        starts = starts[total[hi] - total[lo] >= w - d]
        if not len(starts):
            return None
        near = np.zeros(len(words) + 1, np.int64)  # all places within d of a start, in time linear in the text
        np.add.at(near, np.clip(starts - d, 0, len(words)), 1)
        np.add.at(near, np.clip(starts + d + 1, 0, len(words)), -1)
        begin = np.flatnonzero(np.cumsum(near)[:-1] > 0)
        if not len(begin):
            return None
        candidate = np.zeros(len(begin), bool)
        held = max(1, HELD // len(self.kept[w]))
        for first in range(0, len(begin), held):  # a block of windows at a time bounds memory
            part = begin[first : first + held]
            same = self.walk(words, part, np.minimum(part + w, len(words)), w) == self.embedded[k][None, :]
            for steps in self.tables[w]:
                candidate[first : first + held] |= same[:, steps].all(1)
        least = None
        found = begin[candidate]
        cuts = np.flatnonzero(np.concatenate(([True], found[1:] > found[:-1] + w + d, [True]))) if len(found) else [0]
        for x, y in zip(cuts[:-1], cuts[1:]):  # candidates whose windows touch are verified in one pass
            reach = min(len(words), int(found[y - 1]) + w + d)
            edits = least_edits(item.words, words[int(found[x]) : reach])
            least = edits if least is None else min(least, edits)
        return least if least is not None and least <= d else None


def least_edits(item: np.ndarray, words: np.ndarray) -> int:
    """The least word edit distance of the item to any window of the words, by Myers' bit vectors.

    A bit of the integers stands for a word of the item: time is the number of words times a 64th of the item's.
    """
    where: dict[int, int] = {}
    for i, h in enumerate(item.tolist()):
        where[h] = where.get(h, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score = full, 0, len(item)
    least = score
    for h in words.tolist():
        equal = where.get(h, 0)
        x = equal | down
        y = ((equal & up) + up ^ up) | equal
        plus, minus = down | ~(y | up), up & y
        score += (plus & top > 0) - (minus & top > 0)
        least = min(least, score)
        plus, minus = plus << 1, minus << 1  # nothing comes in: a window may begin anywhere
        up, down = (minus | ~(x | plus)) & full, plus & x & full
    return least


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, recall: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, item_id, edits): documents that hold a passage within ``max_edits`` of an item.

    ``edits`` is the least number of word edits over the document's windows.  Null and empty
    texts, items without a word, and items with a null id match nothing; an item given twice
    under one id counts once.  Rows with null doc_id are reported with a null id, repeated
    rows once each.  Only doc_id, text, item_id and text are read.  The benchmark is held by
    every worker: it must fit there, at about 1 KB an item.
    """
    rows = sorted({(r.item_id, r.text) for r in benchmark.select("item_id", "text").where("item_id is not null and text is not null").collect()})
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    made: list[Index] = []

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Index(ids, texts, max_edits, recall))
        for b in batches:
            out: list[tuple[int | None, int, int]] = []
            for first, part in slices(b.column(1)):
                words, at = word_hashes(part)
                out += [(b.column(0)[first + row].as_py(), item, edits) for row, item, edits in made[0].matches(words, at)]
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32())], ["doc_id", "item_id", "edits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(find), "doc_id long, item_id long, edits int")
