"""Operator 9: exact n-gram Jaccard join by universe partition and the pigeonhole principle.

A document is the set of hashes of its word n-grams.  Two sets with Jaccard similarity of
at least t differ in at most (1 - t) / (1 + t) * (|r| + |s|) tokens.  The universe of token
hashes is cut into segments, their number fixed by the size band of the smaller set.  If the
segments' allowances, each counted with one more, exceed that number, at least one segment
differs by no more than its allowance.  A probe gives every segment one of three
allowances: none (skipped), 0 (the segment's subset is equal) or 1 (equal up to a
one-deletion neighbourhood).  Costs from corpus-wide token counts choose them: segments
whose subset is empty or common are skipped, and rare ones pay for them.  Candidates are
verified exactly on their token sets.  Nothing is capped.  The allowances sum to HITS more
than one less than that, so that a pair must hit as many times (an equal subset under
allowance 1 counts twice), which rids the candidates of single coincidences.

Sets are named by a 64-bit hash of their tokens, so any number of documents with equal
sets costs as much as one.  Signatures travel as packed 32-bit arrays, not as rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import parts, small, written
from palimpsest.llm.text import frugal, mix64, ngram_hashes, slices, word_hashes

#: Words in a token.  One-word tokens: a single edited word costs one token, not n.
N = 1
THRESHOLD = 0.8
#: Hashed cells of the corpus-wide token counts.
CELLS = 1 << 14
#: Shares of segments beyond the pigeonhole's need, and indexed with one-deletion neighbourhoods.
SPARE, DELETIONS = 0.06, 0.12
#: Hits that a pair must have: allowances that sum to HITS more than the differences grant as many.
HITS = 3
_EPS = 1e-9
_U32, _U64 = np.uint32, np.uint64
_ZERO = np.zeros(1, _U64)


def token_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct token hashes; a text shorter than n words is one token of all its words."""
    if len(words) == 0:
        return np.zeros(0, _U64)
    return np.unique(words if n == 1 else ngram_hashes(words, min(n, len(words))))


def set_name(hashed: np.ndarray) -> int:
    """The 64-bit name of the set whose mixed tokens these are."""
    return int(np.array([hashed.sum(dtype=_U64) + _U64(len(hashed))], _U64).view(np.int64)[0])


class Bands:
    """Size bands [edge, edge / t) and the segments of each."""

    def __init__(self, threshold: float):
        self.t, self.c = threshold, (1 - threshold) / (1 + threshold)
        self.edges = [1]
        self.shapes: dict[int, tuple[int, int]] = {}
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] / threshold + _EPS)))

    def of(self, size: int) -> int:
        return bisect_right(self.edges, size) - 1

    def differences(self, r: int, s: int) -> int:
        """Most tokens in which sets of these sizes may differ."""
        return int(self.c * (r + s) + _EPS)

    def shape(self, band: int) -> tuple[int, int]:
        """(segments, of which with deletion neighbourhoods): enough for the largest probe of the band."""
        if band not in self.shapes:
            most = self.edges[band + 1] - 1
            need = self.differences(int(most / self.t + _EPS), most) + HITS
            self.shapes[band] = need + int(SPARE * need) + (need > 3), 1 + int(DELETIONS * need)
        return self.shapes[band]

    def probed(self, size: int) -> list[tuple[int, int]]:
        """(band, most differences) for every band that may hold a partner no larger than ``size``."""
        out, least = [], max(1, math.ceil(self.t * size - _EPS))
        for band in range(self.of(least), self.of(size) + 1):
            out.append((band, self.differences(size, min(size, self.edges[band + 1] - 1))))
        return out


def _segments(tokens: np.ndarray, m: int) -> np.ndarray:
    """Segment of each token; as tokens are sorted, segments come in runs."""
    return ((tokens >> _U64(32)) * _U64(m) >> _U64(32)).astype(np.int64)


class Routes:
    """Which bucket a signature goes to: every populated band has buckets of its own, by its share of tokens.

    A pair meets in the buckets of one band only, so that it is reported few times and a
    set's name is repeated in few blobs.
    """

    def __init__(self, weight: np.ndarray, buckets: int):
        self.count = np.where(weight > 0, np.maximum(1, np.round(buckets * weight / max(1, weight.sum()))), 0).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.buckets = int(self.count.sum())

    def place(self, band: int, signatures: np.ndarray) -> np.ndarray:
        """The bucket in the high and 32 other bits of the signature in the low half."""
        bucket = _U64(self.first[band]) + ((signatures >> _U64(32)) * _U64(self.count[band]) >> _U64(32))
        return bucket << _U64(32) | signatures & _U64(0xFFFFFFFF)


_salts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _salt(band: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a band's m segments: 0..m, and the salts of equal subsets and of deletions."""
    if (band, m) not in _salts:
        at = np.arange(m + 1)
        salt = (at[:m].astype(_U64) << _U64(20)) | _U64(band << 1)
        _salts[band, m] = at, mix64(salt + _U64(0x5851F42D4C957F2D)), mix64((salt | _U64(1)) + _U64(0x5851F42D4C957F2D))
    return _salts[band, m]


def index_signatures(tokens: np.ndarray, hashed: np.ndarray, bands: Bands, routes: Routes) -> np.ndarray:
    """What a set leaves in the index: all segments, and deletions of the first few."""
    band = bands.of(len(tokens))
    m, d = bands.shape(band)
    at, equal, deletion = _salt(band, m)
    segment = _segments(tokens, m)
    edge = np.searchsorted(segment, at)
    total = np.concatenate((_ZERO, np.cumsum(hashed, dtype=_U64)))
    subset = total[edge[1:]] - total[edge[:-1]]
    few = segment[: edge[d]]
    return routes.place(band, mix64(np.concatenate((subset ^ equal, (subset[few] - hashed[: edge[d]]) ^ deletion[few]))))


def probe_signatures(tokens: np.ndarray, hashed: np.ndarray, rarity: np.ndarray, bands: Bands, routes: Routes) -> np.ndarray:
    """Signatures that meet every partner no larger than the set, at least HITS times.

    ``rarity`` is the log of each token's document frequency as a share of all sets: the
    expected share of sets with an equal segment is the exponential of its sum.
    """
    out = []
    total = np.concatenate((_ZERO, np.cumsum(hashed, dtype=_U64)))
    rare = np.concatenate(([0.0], np.cumsum(rarity)))
    for band, most in bands.probed(len(tokens)):
        if not routes.count[band]:
            continue  # no set has a size of this band
        m, d = bands.shape(band)
        at, equal, deletion = _salt(band, m)
        segment = _segments(tokens, m)
        edge = np.searchsorted(segment, at)
        subset, cost = total[edge[1:]] - total[edge[:-1]], np.exp(rare[edge[1:]] - rare[edge[:-1]])
        # allowance 0 everywhere grants m hits; drop the dearest segments down to most + HITS
        dear = np.argsort(-cost, kind="stable")
        spare = max(0, m - (most + HITS))
        chosen = np.ones(m, bool)
        chosen[dear[:spare]] = False
        dear = dear[spare:]
        # allowance 1 on a cheap segment pays for skipping one more dear segment; as it costs at
        # least twice what allowance 0 does, no segment is on both sides of such a trade
        few = segment[: edge[d]]
        widened = 2 * cost[:d] + np.bincount(few, cost[few] * np.exp(-rarity[: edge[d]]), d) + (edge[1 : d + 1] == edge[:d])
        cheap = np.argsort(np.where(chosen[:d], widened, np.inf), kind="stable")
        n = min(len(cheap), len(dear))
        trade = np.flatnonzero(~(np.where(chosen[:d], widened, np.inf)[cheap[:n]] < cost[dear[:n]]))
        n = int(trade[0]) if len(trade) else n
        chosen[dear[:n]] = False
        found = [subset[chosen] ^ equal[chosen]]
        if n:
            wide = np.zeros(d, bool)
            wide[cheap[:n]] = True
            own = np.flatnonzero(wide)
            use = wide[few]
            seg = few[use]
            # an equal subset counts twice: it leaves two of the allowed differences unused
            found += [subset[own] ^ equal[own], subset[own] ^ deletion[own], (subset[seg] - hashed[: edge[d]][use]) ^ equal[seg]]
        out.append(routes.place(band, mix64(np.concatenate(found))))
    return np.concatenate(out)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[object, np.ndarray]]:
    for b in batches:
        for first, part in slices(b.column(1)):
            words, at = word_hashes(part)
            for row in range(len(part)):
                yield b.column(0)[first + row], token_set(words[at[row] : at[row + 1]], n)


#: More bands than sizes up to 2**40 have at any threshold from 0.7 on.
MOST_BANDS = 256


def token_counts(docs: DataFrame, n: int, threshold: float) -> tuple[np.ndarray, int, np.ndarray]:
    """Over all documents: tokens of each hashed cell, how many have any, and tokens in each size band."""
    bands = Bands(threshold)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, rows, weight = np.zeros(CELLS, np.int64), 0, np.zeros(MOST_BANDS, np.int64)
        for _, tokens in _sets(batches, n):
            if len(tokens):
                rows += 1
                weight[bands.of(len(tokens))] += len(tokens)
                cells += np.bincount((tokens & _U64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        used, sizes = np.flatnonzero(cells), np.flatnonzero(weight)
        yield pa.record_batch([pa.array(np.concatenate((used, [-1], -2 - sizes)), pa.int32()), pa.array(np.concatenate((cells[used], [rows], weight[sizes])), pa.int64())], ["cell", "n"])

    found = docs.mapInArrow(frugal(count), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # CELLS + MOST_BANDS + 1 rows at most
    cells, weight, rows = np.zeros(CELLS, np.int64), np.zeros(MOST_BANDS, np.int64), 0
    for r in found:
        if r.cell == -1:
            rows = r.n
        elif r.cell < 0:
            weight[-2 - r.cell] = r.n
        else:
            cells[r.cell] = r.n
    return cells, rows, weight


def _pack(names: list, sizes: list, signatures: list, buckets: int, kind: int) -> Iterator[tuple]:
    """(bucket, kind, set names, sizes, signatures of each, signatures) for one flush."""
    counts = np.array([len(s) for s in signatures])
    if not counts.sum():
        return
    flat = np.concatenate(signatures)
    owner = np.repeat(np.arange(len(counts)), counts)
    bucket = (flat >> _U64(32)).astype(np.int64)
    order = np.argsort(bucket * len(counts) + owner, kind="stable")
    bucket, owner, low = bucket[order], owner[order], flat[order].astype(_U32)
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    names, sizes = np.array(names, np.int64), np.array(sizes, np.int32)
    for b in range(buckets):
        x, y = edge[b], edge[b + 1]
        if x < y:
            own, n = np.unique(owner[x:y], return_counts=True)
            yield b, kind, names[own].tobytes(), sizes[own].tobytes(), n.astype(np.int32).tobytes(), low[x:y].tobytes()


#: Signatures held before a flush, about 60 bytes each while they are packed.
FLUSH = 1_000_000
#: Signatures that are looked up, and pairs that are held, at once.
ASKED, MET = 250_000, 500_000


def _emit(n: int, threshold: float, routes: Routes, cells: np.ndarray, rows: int):
    bands = Bands(threshold)
    share = np.log(np.minimum(1.0, np.maximum(cells, 1) / max(rows, 1)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[list] = [[], [], [], []]
        ids: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            packed = [*_pack(held[0], held[1], held[2], routes.buckets, 0), *_pack(held[0], held[1], held[3], routes.buckets, 1)]
            columns = list(zip(*packed)) if packed else [()] * 6
            types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            blank = [pa.nulls(len(ids), t) for t in types]
            members = [pa.array([i for i, _, _ in ids], pa.int64()), pa.array([s for _, s, _ in ids], pa.int64()), pa.array([k for _, _, k in ids], pa.int32())]
            if packed:
                yield pa.record_batch([*(pa.array(c, t) for c, t in zip(columns, types)), *(pa.nulls(len(packed), t) for t in (pa.int64(), pa.int64(), pa.int32()))], _NAMES)
            if ids:
                yield pa.record_batch([*blank, *members], _NAMES)
            ids.clear()
            for h in held:
                h.clear()

        for doc_id, tokens in _sets(batches, n):
            if not len(tokens):
                continue
            hashed = mix64(tokens)
            name = set_name(hashed)
            ids.append((doc_id.as_py(), name, len(tokens)))
            if name in seen:
                continue
            seen.add(name)
            held[0].append(name)
            held[1].append(len(tokens))
            held[2].append(index_signatures(tokens, hashed, bands, routes))
            held[3].append(probe_signatures(tokens, hashed, share[(tokens & _U64(CELLS - 1)).astype(np.int64)], bands, routes))
            size += len(held[2][-1]) + len(held[3][-1])
            if size > FLUSH:
                yield from flush()
                size = 0
        yield from flush()

    return emit


_NAMES = ["bucket", "kind", "names", "sizes", "counts", "signatures", "doc_id", "set_name", "n_tokens"]
_SCHEMA = "bucket int, kind int, names binary, sizes binary, counts binary, signatures binary, doc_id long, set_name long, n_tokens int"


def _unpack(blobs: list[tuple]) -> tuple[np.ndarray, ...]:
    """Distinct sets (names, sizes) and (signature, set) entries of a bucket's blobs of one kind."""
    names = np.concatenate([np.frombuffer(b[0], np.int64) for b in blobs])
    sizes = np.concatenate([np.frombuffer(b[1], np.int32) for b in blobs])
    counts = np.concatenate([np.frombuffer(b[2], np.int32) for b in blobs])
    flat = np.concatenate([np.frombuffer(b[3], _U32) for b in blobs])
    first = np.zeros(len(names), bool)
    first[np.unique(names, return_index=True)[1]] = True  # the same set from another partition
    owner = np.repeat(np.arange(len(names), dtype=np.int32), counts)
    if first.all():
        return names, sizes, flat, owner
    keep = first[owner]
    return names, sizes, flat[keep], owner[keep]


def _probe(threshold: float):
    bands = Bands(threshold)

    def pairs_of(index: list[tuple], probe: list[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
        if not index or not probe:
            return
        sn, ss, signature, owner = _unpack(index)
        index.clear()
        order = np.argsort(signature, kind="stable")
        signature, owner = signature[order], owner[order]
        del order
        rn, rs, wanted, asker = _unpack(probe)
        probe.clear()
        for first in range(0, len(wanted), ASKED):  # a slice of probes, and of their pairs, at a time bounds memory
            part, ask = wanted[first : first + ASKED], asker[first : first + ASKED]
            lo, hi = np.searchsorted(signature, part, "left"), np.searchsorted(signature, part, "right")
            ahead = np.cumsum(hi - lo)
            begin = 0
            while begin < len(part):
                end = max(begin + 1, int(np.searchsorted(ahead, (ahead[begin - 1] if begin else 0) + MET, "right")))
                n = (hi - lo)[begin:end]
                r = np.repeat(ask[begin:end], n)
                s = owner[np.repeat(lo[begin:end] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
                ok = (sn[s] != rn[r]) & ((ss[s] < rs[r]) | (ss[s] == rs[r]) & (sn[s] < rn[r])) & (ss[s] >= bands.t * rs[r] - _EPS)
                code, hits = np.unique(s[ok].astype(np.int64) * len(rn) + r[ok], return_counts=True)
                yield sn[code // len(rn)], rn[code % len(rn)], hits
                begin = end

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, tuple[list, list]] = {}
        for b in batches:
            rows = b.to_pydict()
            for k in range(b.num_rows):
                blobs.setdefault(rows["bucket"][k], ([], []))[rows["kind"][k]].append((rows["names"][k], rows["sizes"][k], rows["counts"][k], rows["signatures"][k]))
        while blobs:  # each bucket is let go once it is done
            index, probes = blobs.popitem()[1]
            for s, r, hits in pairs_of(index, probes):
                yield pa.record_batch([pa.array(s), pa.array(r), pa.array(hits.astype(np.int32))], ["a", "b", "hits"])

    return probe


class Forest:
    """Union-find over integers: the smallest member names its tree."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (up := self.parent.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.parent[p] = x
        return x

    def add(self, a: int, b: int) -> bool:
        """Joins the trees of both; whether they were two."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for b in batches:
        for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            forest.add(a, c)
    members = list(forest.parent)
    yield pa.record_batch([pa.array([forest.root(m) for m in members], pa.int64()), pa.array(members, pa.int64())], ["a", "b"])


#: Edges that one task may join into components; beyond it rounds of distributed star joins run.
ONE_TASK_EDGES = 3_000_000


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(component, member) of an undirected graph of long columns a, b; the component is its least member.

    Every partition first thins its edges to a spanning forest.  Few remaining edges are
    joined in one task; more by alternating large-star and small-star steps, each written
    to the shared folder, until nothing changes.
    """
    thin = written(edges.select("a", "b").mapInArrow(frugal(_spanning), "a long, b long").where("a <> b"), "forest")
    if thin.limit(one_task + 1).count() <= one_task:
        return thin.coalesce(1).mapInArrow(frugal(_spanning), "component long, member long")
    current = thin
    while True:
        both = current.select("a", "b").union(current.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        up = large.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
        least = up.groupBy("x").agg(F.min("y").alias("m"))
        star = up.join(least, "x").select(F.col("m").alias("a"), F.explode(F.array("x", "y")).alias("b")).where("a <> b").distinct()
        new = written(star, "star")
        if new.exceptAll(current).isEmpty() and current.exceptAll(new).isEmpty():
            break
        current = new
    roots = current.select(F.col("a").alias("component"), F.col("a").alias("member")).distinct()
    return current.select(F.col("a").alias("component"), F.col("b").alias("member")).union(roots)


#: What one block of a component may hold on either side: tokens, and sets.
BLOCK_TOKENS, BLOCK_SETS = 4_000_000, 2000
_FOUND = "a long, b long, links long, jaccard double"


def _similarities(flat: np.ndarray, edge: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the sets left[k] and right[k]; set i is flat[edge[i] : edge[i + 1]], ``left`` is sorted."""
    code = np.unique(flat, return_inverse=True)[1].astype(np.int32)
    mark = np.zeros(int(code.max(initial=-1)) + 1, bool)
    size = np.diff(edge)
    both = np.zeros(len(left), np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1], [True])))
    for x, y in zip(cuts[:-1], cuts[1:]):
        own, others = code[edge[left[x]] : edge[left[x] + 1]], right[x:y]
        ahead = np.concatenate(([0], np.cumsum(size[others])))
        mark[own] = True
        at = np.repeat(edge[others] - ahead[:-1], size[others]) + np.arange(ahead[-1])
        both[x:y] = np.add.reduceat(mark[code[at]].astype(np.int64), ahead[:-1])
        mark[own] = False
    return both / (size[left] + size[right] - both)


def _verify(threshold: float, pairs_too: bool):
    """Of one block: what each set is linked with, a spanning forest of the links, and all links if asked for."""

    def verify(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        names = sets["set_name"].to_numpy()
        known, first = np.unique(names, return_index=True)
        left, right = (first[np.searchsorted(known, pairs[c].to_numpy())] for c in ("a", "b"))
        order = np.argsort(left, kind="stable")
        left, right = left[order], right[order]
        out: list[tuple] = []
        if len(left):
            blob = sets["tokens"].combine_chunks()  # read in place: all sets' tokens one after another
            at = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1].astype(np.int64) // 8
            jaccard = _similarities(np.frombuffer(blob.buffers()[2], _U64, int(at[-1])), at, left, right)
            ok = jaccard >= threshold - _EPS
            left, right, jaccard = left[ok], right[ok], jaccard[ok]
            copies = sets["copies"].to_numpy()
            links, best = np.zeros(len(names), np.int64), np.zeros(len(names))
            for p, q in ((left, right), (right, left)):
                np.add.at(links, p, copies[q])
                np.maximum.at(best, p, jaccard)
            forest, tree = Forest(), []
            for p, q in zip(left.tolist(), right.tolist()):
                if forest.add(p, q):
                    tree.append((p, q))
            used = np.flatnonzero(links)
            out.append((names[used], None, links[used], best[used]))
            if pairs_too:
                out.append((names[left], names[right], None, jaccard))
            elif tree:
                p, q = np.array(tree).T
                out.append((names[p], names[q], None, None))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        columns = ("a", "b", "links", "jaccard")
        tables = [pa.table([pa.nulls(len(rows[0]), t) if x is None else pa.array(x, t) for x, t in zip(rows, types)], columns) for rows in out]
        return pa.concat_tables(tables) if tables else pa.table([pa.array([], t) for t in types], columns)

    return verify


def _tokens_of(n: int):
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [(name, k, tokens.tobytes()) for k, ((_, tokens), name) in enumerate(zip(_sets([b], n), b.column(2).to_pylist())) if set_name(mix64(tokens)) == name]
            # an id that carries two texts has two sets: each row counts for its own alone
            rows = pa.array([k for _, k, _ in held], pa.int64())
            tokens = pa.array([t for _, _, t in held], pa.binary())
            yield pa.record_batch([*(b.column(c).take(rows) for c in range(2, b.num_columns)), tokens], [*_PLACED, "tokens"])

    return sets_of


_PLACED = ["set_name", "component", "copies", "blocks"]


def _block(component: str, place, other, blocks: str, shared: int):
    """The key under which two places of a component meet; components of one block share ``shared`` keys."""
    alone = F.col(blocks) > 1
    return F.struct(
        F.when(alone, F.col(component)).otherwise(F.pmod(F.xxhash64(component), F.lit(shared))).alias("x"),
        F.when(alone, F.least(place, other)).otherwise(F.lit(-1)).cast("int").alias("i"),
        F.when(alone, F.greatest(place, other)).otherwise(F.lit(-1)).cast("int").alias("j"),
    )


def similar_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, pairs_too: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, sets, members) of the documents' token sets.

    ``members`` is (doc_id, set_name), ``sets`` (set_name, first, copies) with the least id and the number
    of documents of each set.  ``found`` is (a, b, links, jaccard): where b is null, the documents of
    other sets that are similar to set a and the greatest similarity, in parts to be summed; else two
    similar sets: with ``pairs_too`` all such pairs, otherwise enough of them to connect what is connected.

    Pairs are verified in blocks: a connected component of the candidates with many sets or tokens is
    cut by hashes of its sets, and each two parts of it meet in a task of their own.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    cells, rows, weight = token_counts(texts, n, threshold)
    # fewer, larger buckets report a pair fewer times; a bucket of half a partition count still fits a worker
    routes = Routes(weight, max(4, parts(spark) // 2))
    emitted = written(texts.mapInArrow(frugal(_emit(n, threshold, routes, cells, rows)), _SCHEMA), "signatures")
    blobs = emitted.where("bucket is not null").select(*_NAMES[:6]).repartition(parts(spark), "bucket")
    # partitioned by a alone: its reports lie together, which halves their compressed size
    hits = blobs.mapInArrow(frugal(_probe(threshold)), "a long, b long, hits int").repartition("a").groupBy("a", "b").agg(F.sum("hits").alias("hits"))
    candidates = written(hits.where(F.col("hits") >= HITS).select("a", "b"), "candidates")
    # distinct by both columns first: a set that a third of the documents share is counted in many tasks
    members = written(emitted.where("set_name is not null").select("doc_id", "set_name", "n_tokens").distinct(), "members")
    sets = written(members.groupBy("set_name").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n_tokens").alias("n_tokens")), "sets")
    groups = components(candidates).withColumnRenamed("member", "set_name").join(sets, "set_name")
    groups = written(groups, "components")
    size = groups.groupBy("component").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("s"))
    blocks = F.greatest(F.ceil(F.col("t") / BLOCK_TOKENS), F.ceil(F.col("s") / BLOCK_SETS)).cast("int")
    wanted = written(groups.join(size.select("component", blocks.alias("blocks")), "component").select(F.col("first").alias("doc_id"), *_PLACED), "wanted")
    chosen = texts.join(small(wanted), "doc_id").select("doc_id", "text", *_PLACED)
    held = chosen.mapInArrow(frugal(_tokens_of(n)), "set_name long, component long, copies long, blocks int, tokens binary")
    shared = 2 * parts(spark)
    place = lambda name: F.pmod(F.xxhash64(name), F.col("blocks"))
    meeting = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: _block("component", place("set_name"), other, "blocks", shared))
    left = held.select("set_name", "copies", "tokens", F.explode(meeting).alias("block")).select("block.*", "set_name", "copies", "tokens")
    pairs = candidates.join(wanted.select(F.col("set_name").alias("a"), "component", "blocks"), "a")
    right = pairs.select(_block("component", place("a"), place("b"), "blocks", shared).alias("block"), "a", "b").select("block.*", "a", "b")
    found = left.groupBy("x", "i", "j").cogroup(right.groupBy("x", "i", "j")).applyInArrow(_verify(threshold, pairs_too), _FOUND)
    return written(found, "verified"), sets, members


def _classes(found: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """(set_name, class_id): the least id of each connected group of sets, of those that are linked with another."""
    # an id with two texts is one document, so its sets are connected by it
    several = members.groupBy("doc_id").agg(F.min("set_name").alias("a"), F.max("set_name").alias("z")).where("a <> z")
    within = members.join(several, "doc_id").select("a", F.col("set_name").alias("b")).where("a <> b")
    joined = written(components(found.where("b is not null").select("a", "b").union(within)), "classes")
    least = joined.join(sets, joined.member == sets.set_name).groupBy("component").agg(F.min("first").alias("class_id"))
    return joined.join(least, "component").select(F.col("member").alias("set_name"), "class_id")


def jaccard_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard): the similar pairs of different sets, each by its least id, and the membership of equal sets.

    Documents with equal sets are a class.  Every two similar classes give one row of their least ids,
    the smaller first; every further document of a class gives one row with the least and jaccard 1.  The
    documents that take part are those of :func:`jaccard_join`.  Rows grow with the similar pairs.
    """
    found, sets, members = similar_sets(docs, n, threshold, pairs_too=True)
    first = sets.select("set_name", "first")
    both = found.where("b is not null").join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b")
    linked = both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    return linked.union(members.join(first, "set_name").where("doc_id <> first").select("first", "doc_id", F.lit(1.0)))


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links, jaccard): every document whose n-gram set is similar to that of another.

    ``links`` is the number of other documents with a Jaccard similarity of at least the threshold,
    equal sets among them, ``jaccard`` the greatest of these similarities, and ``class_id`` the least id
    of the connected group.  One row a document, so that groups of thousands of copies cost no more;
    :func:`jaccard_pairs` lists the links.  Null texts, null ids and texts without a word take
    no part; a repeated row counts once, an id with two texts has a row for each of its sets; columns
    besides doc_id and text are not read.  The similarity is exact up to collisions of 64-bit hashes.
    """
    found, sets, members = similar_sets(docs, n, threshold)
    counted = found.where("b is null").groupBy(F.col("a").alias("set_name")).agg(F.sum("links").alias("links"), F.max("jaccard").alias("jaccard"))
    joined = sets.join(counted, "set_name", "left").join(_classes(found, sets, members), "set_name", "left").where("copies > 1 or links is not null")
    jaccard = F.when(F.col("copies") > 1, F.lit(1.0)).otherwise(F.col("jaccard"))
    joined = joined.select("set_name", F.coalesce("class_id", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), jaccard.alias("jaccard"))
    return members.join(joined, "set_name").select("doc_id", "class_id", "links", "jaccard")


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept_id): every document to drop, and the least id of its group, which stays.

    A group is a connected component of the similarity graph; equal sets are connected.
    """
    found, sets, members = similar_sets(docs, n, threshold)
    named = sets.join(_classes(found, sets, members), "set_name", "left").where("copies > 1 or class_id is not null").select("set_name", F.coalesce("class_id", "first").alias("kept_id"))
    return members.join(named, "set_name").where("doc_id <> kept_id").select("doc_id", "kept_id").distinct()


SQL = r"""
WITH RECURSIVE word AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+')) AS w
              FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
     bag AS (SELECT doc_id, list_sort(list(w)) AS ws FROM word GROUP BY doc_id),
     named AS (SELECT ws, min(doc_id) AS s, len(ws) AS n, count(*) AS copies FROM bag GROUP BY ws),
     token AS (SELECT s, unnest(ws) AS w FROM named),
     pair AS (SELECT x.s AS a, y.s AS b, count(*) AS c FROM token x JOIN token y ON x.w = y.w AND x.s <> y.s GROUP BY 1, 2),
     near AS (SELECT a, b, q.copies, c / (p.n + q.n - c) AS j FROM pair JOIN named p ON p.s = a JOIN named q ON q.s = b WHERE c / (p.n + q.n - c) >= 0.8 - 1e-9),
     reach AS (SELECT s, s AS t FROM named UNION SELECT r.s, near.b FROM reach r JOIN near ON near.a = r.t),
     class AS (SELECT s, min(t) AS class_id FROM reach GROUP BY s),
     linked AS (SELECT a, sum(copies) AS links, max(j) AS j FROM near GROUP BY a)
SELECT doc_id, class_id, (coalesce(links, 0) + copies - 1)::BIGINT AS links, round(CASE WHEN copies > 1 THEN 1.0 ELSE j END, 6) AS jaccard
FROM bag JOIN named USING (ws) JOIN class USING (s) LEFT JOIN linked ON a = s WHERE copies > 1 OR links IS NOT NULL
"""
