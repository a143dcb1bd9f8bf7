"""Operator 4: line deduplication by pairwise patience alignment.

Documents that share a line are found by line hashes.  A rare line, held by few documents,
pairs all of them; a line that many hold pairs each with the first holder alone, so that
work stays linear in its copies and no document is left out.  With ``every_holder`` what such
a line's first holder doesn't cut is carried on to its further earlier holders, which gives
the cuts of all pairs.  Each pair is aligned with
patience diff over the lines they might share, recursively between anchors and by a longest
common subsequence where there are none, and the aligned common blocks are deleted from the
later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import parts, small, unused, written
from palimpsest.llm.text import frugal

#: Least characters of a line that makes documents a pair, and of a block that is deleted.
MIN_LINE, MIN_BLOCK = 20, 20
#: Holders of a line up to which it is rare: all of them pair with each other.
RARE = 4
#: Pairs of one earlier document that a task takes.
HOT_PAIRS = 50_000
#: Bytes of cuts up to which they are broadcast; beyond it the texts are shuffled once.
BROADCAST_CUTS = 32_000_000


def _increasing(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of anchors, given by their second places, whose first places increase too."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(anchors)
    for k, (i, _) in enumerate(anchors):
        at = bisect_left(tails, i)
        back[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(i)
            ends.append(k)
        else:
            tails[at], ends[at] = i, k
    chain = []
    k = ends[-1] if ends else -1
    while k >= 0:
        chain.append(anchors[k])
        k = back[k]
    return chain[::-1]


def common_subsequence(old: list[int], new: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence, as places in both: bit-parallel, one integer for each line of ``new``.

    Every ``step``-th integer is kept and those between are made again on the way back, so that memory
    grows with the root of the number of lines.
    """
    where: dict[int, int] = {}
    for i, h in enumerate(old):
        where[h] = where.get(h, 0) | 1 << i
    full = (1 << len(old)) - 1
    step = isqrt(len(new)) + 1

    def rows(v: int, first: int) -> Iterator[int]:
        for h in new[first : first + step]:
            u = v & where.get(h, 0)
            v = (v + u | v - u) & full
            yield v

    starts, v = [], full  # a bit of v is 0 where one more line of old lengthens the subsequence
    for first in range(0, len(new), step):
        starts.append(v)
        for v in rows(v, first):
            pass
    out: list[tuple[int, int]] = []
    i = len(old) - 1
    for k in range(len(starts) - 1, -1, -1):
        made = [starts[k], *rows(starts[k], k * step)]
        j = len(made) - 1
        while j and i >= 0:
            if made[j] >> i & 1:
                i -= 1
            elif not made[j - 1] >> i & 1:
                j -= 1
            else:
                out.append((i, k * step + j - 1))
                i, j = i - 1, j - 1
    return out[::-1]


def patience(old: list[int], new: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in old, in new) of equal lines, increasing in both.

    Lines that occur once in both are anchors, and the longest increasing run of them is kept.  In each
    gap between them equal lines at its beginning and its end are aligned, and what remains is aligned in
    the same way, with occurrences counted within it; without an anchor by a longest common subsequence.
    """
    out: list[tuple[int, int]] = []
    gaps = [(0, len(old), 0, len(new))]
    while gaps:
        low, high, left, right = gaps.pop()
        if (low, high, left, right) != (0, len(old), 0, len(new)):
            while low < high and left < right and old[low] == new[left]:
                out.append((low, left))
                low, left = low + 1, left + 1
            while low < high and left < right and old[high - 1] == new[right - 1]:
                high, right = high - 1, right - 1
                out.append((high, right))
        if low == high or left == right:
            continue
        x, y = old[low:high], new[left:right]
        a, b = Counter(x), Counter(y)
        where = {h: i for i, h in enumerate(x) if a[h] == 1}
        chain = _increasing([(where[h], j) for j, h in enumerate(y) if b[h] == 1 and h in where])
        if not chain:
            out += [(low + i, left + j) for i, j in common_subsequence(x, y)]
            continue
        out += [(low + i, left + j) for i, j in chain]
        ends = [(-1, -1), *chain, (len(x), len(y))]
        gaps += [(low + p + 1, low + i, left + q + 1, left + j) for (p, q), (i, j) in zip(ends, ends[1:])]
    return sorted(out)


def deleted_places(old: list[int], new: list[int], places: list[int], sizes: list[int], min_block: int) -> list[int]:
    """Line numbers of the later document that aligned blocks of at least ``min_block`` characters delete.

    ``places`` and ``sizes`` are the line numbers and lengths of ``new``'s lines; a block is
    a run of aligned lines that are neighbours in both lists.
    """
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(old, new), (-9, -9)]:
        if block and (i != last[0] + 1 or j != last[1] + 1):
            if sum(sizes[x] for x in block) >= min_block:
                out += [places[x] for x in block]
            block = []
        block.append(j)
        last = (i, j)
    return out


def _align(min_block: int):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(b.num_columns)))
            out = [(row, deleted_places(old, new, places, sizes, min_block)) for row, old, new, places, sizes in rows]
            out = [x for x in out if x[1]]
            yield pa.record_batch([pa.array([r for r, _ in out], pa.int64()), pa.array([d for _, d in out], pa.list_(pa.int32()))], ["later", "places"])

    return align


def _keys(hashes: list[int]) -> list[int]:
    """Keys of a document's lines, then of its neighbouring lines."""
    return [*hashes, *(((x * 0x9E3779B97F4A7C15 + y + (1 << 63)) & (1 << 64) - 1) - (1 << 63) for x, y in zip(hashes, hashes[1:]))]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(k, s) for s, hashes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k in set(_keys(hashes))]
        yield pa.record_batch([pa.array([k for k, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.int64())], ["key", "sequence"])


def _wanted(min_block: int):
    """Keys that an earlier document must hold to cut one more line: the line, or a neighbour with it where it is too short for a block."""

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row, hashes, places, sizes, cut in zip(*(b.column(k).to_pylist() for k in range(5))):
                gone, keys, n = set(cut or ()), _keys(hashes), len(hashes)
                long = {keys[k] for k in range(n) if sizes[k] >= min_block and places[k] not in gone}
                short = [k for k in range(n) if sizes[k] < min_block and places[k] not in gone]
                rows += [(row, x) for x in long | {keys[n + j] for k in short for j in (k - 1, k) if 0 <= j < n - 1}]
            yield pa.record_batch([pa.array([r for r, _ in rows], pa.int64()), pa.array([k for _, k in rows], pa.int64())], ["later", "key"])

    return wanted


def _carried(min_line: int, min_block: int):
    """As _align, of those pairs that share a line of ``min_line`` characters; a row for each pair."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            later, out = [], []
            for row, old, new, places, sizes in zip(*(b.column(k).to_pylist() for k in range(5))):
                held = set(old)
                pair = any(n >= min_line and h in held for h, n in zip(new, sizes))
                later.append(row)
                out.append(deleted_places(old, new, places, sizes, min_block) if pair else [])
            yield pa.record_batch([pa.array(later, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["later", "places"])

    return align


def _carry_on(sequences: DataFrame, cut: DataFrame, min_line: int, min_block: int) -> DataFrame:
    """(later, _cut): ``cut`` with what all other pairs of documents cut as well.

    A line that stays is looked for in earlier documents, those of equal lines taken once, in the
    order of their ids and fourfold as far in each round, until one cuts it or none is left.
    """
    found = cut
    state = written(sequences.join(cut.withColumnRenamed("later", "_row"), "_row", "left").select(F.col("_row").alias("later"), "order", "hashes", "places", "sizes", "_cut"), "uncut")
    distinct = sequences.groupBy(F.xxhash64("hashes").alias("sequence")).agg(F.min("order").alias("first"), F.any_value("hashes").alias("old"))
    distinct = written(distinct, "distinct_sequences")
    held = distinct.select("sequence", "old").mapInArrow(frugal(_postings), "key long, sequence long").join(distinct.select("sequence", "first"), "sequence")
    held = written(_ranked(held), "postings")
    done, width = 0, 4
    while True:
        wanted = state.select("later", "hashes", "places", "sizes", "_cut").mapInArrow(frugal(_wanted(min_block)), "later long, key long").join(state.select("later", "order"), "later")
        near = held.where((F.col("rank") > done) & (F.col("rank") <= done + width))
        pairs = wanted.join(near, "key").where(F.col("first") < F.col("order")).select("later", "sequence").distinct()
        aligned = pairs.join(distinct.select("sequence", "old"), "sequence").join(state, "later").select("later", "old", F.col("hashes").alias("new"), "places", "sizes")
        more = aligned.mapInArrow(frugal(_carried(min_line, min_block)), "later long, places array<int>").groupBy("later").agg(F.flatten(F.collect_list("places")).alias("_more"))
        cuts = F.array_union(F.coalesce("_cut", F.expr("array()")), "_more").alias("_cut")
        state = written(state.join(more, "later").select("later", "order", "hashes", "places", "sizes", cuts), "uncut")
        if state.isEmpty():
            return found.groupBy("later").agg(F.array_distinct(F.flatten(F.collect_list("_cut"))).alias("_cut"))
        found = found.union(state.where(F.size("_cut") > 0).select("later", "_cut"))
        done, width = done + width, width * 4


def _ranked(held: DataFrame) -> DataFrame:
    """(key, sequence, first, rank): a key's sequences in order, the first at 1.

    Ordered by range over all keys, so that the holders of a hot key lie in several slices; each slice's
    ranks go on from the slices before it.
    """
    sliced = held.select("key", "first", "sequence").repartitionByRange(parts(held.sparkSession), "key", "first").withColumn("slice", F.spark_partition_id())
    sliced = written(sliced, "posting_slices")
    sizes = sliced.groupBy("key", "slice").agg(F.count("*").alias("own"))
    before = F.sum("own").over(Window.partitionBy("key").orderBy("slice")) - F.col("own")  # as many rows as slices
    ahead = small(written(sizes.select("key", "slice", before.alias("ahead")).where("ahead > 0"), "posting_ranks"))
    within = F.row_number().over(Window.partitionBy("slice", "key").orderBy("first"))
    ranked = sliced.withColumn("within", within).join(ahead, ["key", "slice"], "left")
    return ranked.select("key", "sequence", "first", (F.col("within") + F.coalesce("ahead", F.lit(0))).alias("rank"))


def deduplicate_lines(docs: DataFrame, rare: int = RARE, min_line: int = MIN_LINE, min_block: int = MIN_BLOCK, every_holder: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with the common blocks cut out of ``text``.

    A line is compared without spaces at its ends.  Of two documents the one with the
    smaller id is the earlier (null ids last, ties by a hash of the row); it keeps the block,
    so the first holder of a line always keeps it.  ``every_holder`` gives the cuts of all pairs
    that share a line of ``min_line`` characters, whatever ``rare`` is.  Rows repeated in id and text are one
    document: all get the same cuts.  ``n_chars`` becomes the new length where text was cut
    and the column is there.  A text of which every line goes becomes empty; null and empty
    texts stay.  No other column is looked at.
    """
    key = F.xxhash64("doc_id", "text")
    row_name, cut_name = unused(docs, "row_key"), unused(docs, "cut_places")
    base = docs.withColumn(row_name, key)
    lines = F.posexplode(F.split("text", "\n")).alias("place", "line")
    every = docs.where("text is not null").select(key.alias("_row"), F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), key.alias("r")).alias("order"), lines)
    every = every.select("_row", "order", "place", F.trim("line").alias("line")).where("line <> ''")
    every = every.select("_row", "order", "place", F.xxhash64("line").alias("hash"), F.length("line").alias("size"))
    holders = every.groupBy("hash").agg(F.count("*").alias("n"), F.min("order").alias("first"), F.max("_row").alias("top"), F.min("_row").alias("low")).where("top <> low")
    shared = written(every.join(holders.select("hash", "n", "first"), "hash"), "shared_lines")
    sequences = shared.groupBy("_row").agg(F.min("order").alias("order"), F.array_sort(F.collect_set(F.struct("place", "hash", "size"))).alias("s"))
    sequences = written(sequences.select("_row", "order", F.col("s.place").alias("places"), F.col("s.hash").alias("hashes"), F.col("s.size").alias("sizes")), "sequences")
    anchors = shared.where(F.col("size") >= min_line).select("_row", "order", "hash", "n", "first").distinct()
    many = anchors.where((F.col("n") > rare) & (F.col("first.r") != F.col("_row"))).select(F.col("first.r").alias("earlier"), F.col("_row").alias("later"))
    few = anchors.where(F.col("n") <= rare).groupBy("hash").agg(F.array_sort(F.collect_list("order")).alias("o"))
    few = few.select(F.posexplode("o").alias("k", "x"), "o").select(F.col("x.r").alias("earlier"), F.explode(F.slice("o", F.col("k") + 2, F.size("o"))).alias("y")).select("earlier", F.col("y.r").alias("later"))
    pairs = written(many.union(few).distinct(), "pairs")
    # an earlier document of very many pairs is given to several tasks: there are few of them, each a share of all pairs
    hot = pairs.groupBy("earlier").agg(F.count("*").alias("n")).where(F.col("n") > HOT_PAIRS).select("earlier", F.ceil(F.col("n") / HOT_PAIRS).cast("int").alias("salts"))
    hot = small(written(hot, "hot_holders"))
    pairs = pairs.join(hot, "earlier", "left").select("earlier", "later", F.coalesce(F.pmod(F.xxhash64("later"), F.col("salts")), F.lit(0)).cast("int").alias("salt"))
    old = sequences.select(F.col("_row").alias("earlier"), F.col("hashes").alias("old")).join(hot, "earlier", "left")
    old = old.select("earlier", "old", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)).alias("salt"))
    new = sequences.select(F.col("_row").alias("later"), F.col("hashes").alias("new"), "places", "sizes")
    aligned = pairs.join(old, ["earlier", "salt"]).join(new, "later").select("later", "old", "new", "places", "sizes")
    cut = aligned.mapInArrow(frugal(_align(min_block)), "later long, places array<int>").groupBy("later").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("_cut"))
    if every_holder:
        cut = _carry_on(sequences, written(cut, "first_cuts"), min_line, min_block)
    cut = written(cut.withColumnRenamed("later", "_row"), "cuts")
    joined = base.join(small(cut.toDF(row_name, cut_name), BROADCAST_CUTS), row_name, "left")
    gone = F.col(cut_name).isNotNull()
    kept = F.filter(F.split("text", "\n"), lambda line, k: ~F.array_contains(F.col(cut_name), k))
    joined = joined.withColumn("text", F.when(gone, F.array_join(kept, "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(gone, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return joined.select(*docs.columns)
