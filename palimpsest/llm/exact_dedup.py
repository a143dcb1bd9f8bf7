"""Operator 1: exact deduplication with counting quotient filters.

Every document has a 64-bit fingerprint of its bytes.  Each partition builds a counting
quotient filter of its fingerprints and cuts it into slices of the quotient range; the
slices of one range merge losslessly, by sorted remainders, into the corpus filter.
Fingerprints with a merged count above one route their documents to byte verification.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import BROADCAST_BYTES, parts, small, written


class CountingQuotientFilter:
    """A lossless counting quotient filter of ``bits``-wide fingerprints.

    A fingerprint is a quotient (its high ``quotient_bits``) and a remainder.  The
    remainders of one quotient form a sorted run; runs are placed in quotient order by
    linear probing.  ``occupied`` marks quotients that have a run, ``run_end`` the last
    slot of each run, and ``counter`` the slots that hold the count of the remainder
    before them (an explicit bit instead of an escape inside the remainders).
    """

    def __init__(self, quotient_bits: int, bits: int = 64):
        self.quotient_bits, self.bits = quotient_bits, bits
        self.occupied = np.zeros(1 << quotient_bits, bool)
        self.run_end = self.counter = np.zeros(0, bool)
        self.slots = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, bits: int = 64) -> CountingQuotientFilter:
        """The filter of fingerprints (each once, or ``counts`` times), at a load of at most one half."""
        order = np.argsort(fingerprints, kind="stable")
        value = fingerprints[order].astype(np.uint64)
        count = np.ones(len(value), np.int64) if counts is None else counts[order].astype(np.int64)
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        start = np.flatnonzero(new)
        value, count = value[start], np.add.reduceat(count, start) if len(start) else count
        out = cls(min(bits - 1, max(1, int(2 * len(value)).bit_length())), bits)
        if not len(value):
            return out
        low = np.uint64(bits - out.quotient_bits)
        quotient = (value >> low).astype(np.int64)
        width = 1 + (count > 1)
        first = np.concatenate(([0], np.cumsum(width)[:-1]))
        entry = np.repeat(np.arange(len(value)), width)
        place = np.arange(len(entry))
        at = np.maximum.accumulate(quotient[entry] - place) + place
        out.slots = np.zeros(at[-1] + 1, np.uint64)
        out.counter, out.run_end = np.zeros(at[-1] + 1, bool), np.zeros(at[-1] + 1, bool)
        is_counter = np.ones(len(entry), bool)
        is_counter[first] = False
        remainder = value & ((np.uint64(1) << low) - np.uint64(1))
        out.slots[at] = np.where(is_counter, count[entry].astype(np.uint64), remainder[entry])
        out.counter[at] = is_counter
        last = np.ones(len(entry), bool)
        last[:-1] = quotient[entry][1:] != quotient[entry][:-1]
        out.run_end[at[last]] = True
        out.occupied[quotient] = True
        return out

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts."""
        quotient, end = np.flatnonzero(self.occupied), np.flatnonzero(self.run_end)
        if not len(quotient):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        begin = np.maximum(quotient, np.concatenate(([0], end[:-1] + 1)))
        length = end - begin + 1
        slot = np.repeat(begin - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
        of = np.repeat(quotient, length).astype(np.uint64)
        counter = self.counter[slot]
        count = np.ones(len(slot), np.int64)
        follows = np.flatnonzero(counter)
        count[follows - 1] = self.slots[slot[follows]].astype(np.int64)
        value = (of << np.uint64(self.bits - self.quotient_bits)) | self.slots[slot]
        return value[~counter], count[~counter]

    def to_bytes(self) -> bytes:
        head = np.array([self.quotient_bits, self.bits, len(self.slots)], np.int64).tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.run_end, self.counter)) + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        quotient_bits, bits, n = np.frombuffer(data, np.int64, 3).tolist()
        out, at = cls(quotient_bits, bits), 24
        for name, size in (("occupied", 1 << quotient_bits), ("run_end", n), ("counter", n)):
            packed = np.frombuffer(data, np.uint8, -(-size // 8), at)
            setattr(out, name, np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        out.slots = np.frombuffer(data, np.uint64, n, at)
        return out

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Lossless merge: the filters' sorted entries are merged and equal remainders add their counts."""
        found = [f.entries() for f in filters]
        bits = max((f.bits for f in filters), default=64)
        return cls.of(np.concatenate([v for v, _ in found] or [np.zeros(0, np.uint64)]), np.concatenate([c for _, c in found] or [np.zeros(0, np.int64)]), bits)


def _filters(shard_bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        value = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        if not len(value):
            return
        shard = value >> np.uint64(64 - shard_bits)
        within = value & ((np.uint64(1) << np.uint64(64 - shard_bits)) - np.uint64(1))
        edges = np.concatenate((np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))), [len(shard)]))
        for a, b in zip(edges[:-1], edges[1:]):
            blob = CountingQuotientFilter.of(within[a:b], bits=64 - shard_bits).to_bytes()
            yield pa.record_batch([pa.array([int(shard[a])], pa.int32()), pa.array([blob], pa.binary())], ["shard", "filter"])

    return build


def _merge(shard_bits: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, list[CountingQuotientFilter]] = {}
        for b in batches:
            for shard, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                slices.setdefault(shard, []).append(CountingQuotientFilter.from_bytes(blob))
                if len(slices[shard]) >= 256:  # bounds what is held unmerged
                    slices[shard] = [CountingQuotientFilter.merged(slices[shard])]
        for shard, found in slices.items():
            value, count = CountingQuotientFilter.merged(found).entries()
            value = value[count > 1] | np.uint64(shard << (64 - shard_bits))
            yield pa.record_batch([pa.array(value.view(np.int64), pa.int64())], ["fingerprint"])

    return merge


def repeated_fingerprints(prints: DataFrame) -> DataFrame:
    """The values of the long column ``fingerprint`` that occur more than once, from merged filters."""
    spark = prints.sparkSession
    shard_bits = max(1, (parts(spark) - 1).bit_length())
    slices = prints.select("fingerprint").mapInArrow(_filters(shard_bits), "shard int, filter binary")
    return slices.repartition(1 << shard_bits, "shard").mapInArrow(_merge(shard_bits), "fingerprint long")


def fingerprint() -> Column:
    return F.xxhash64("text")


#: Copies of one row that a single array lists.
LISTED = 10_000


def _repetitions(rows: DataFrame) -> DataFrame:
    """(doc_id, duplicate_of): each row of (doc_id, n) n - 1 times, listed in arrays of bounded length."""
    parts_of = rows.where("n > 1").select("doc_id", (F.col("n") - 1).alias("n")).select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {LISTED}"))).alias("part"))
    length = F.least(F.lit(LISTED), F.col("n") - F.col("part") * LISTED).cast("int")
    return parts_of.select("doc_id", F.explode(F.array_repeat(F.col("doc_id"), length)).alias("duplicate_of"))


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, duplicate_of) for every row whose text is byte for byte that of a row with a smaller id.

    The smallest id of each group stays and has no row.  A repeated row (same id and text)
    is a duplicate of itself and gives one row (id, id) for each repetition.  Rows without
    an id or with a null text take no part; empty texts are equal to each other.  Other
    columns are not read.  An empty table gives an empty result.

    Texts are compared where their fingerprints recur, each distinct one once a partition; if all
    texts of a fingerprint are equal, rows are told by it.  No group of copies is ever held in one place.
    """
    pairs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null and text is not null")
    prints = written(pairs.select("doc_id", fingerprint().alias("fingerprint")), "fingerprints")
    again = small(written(repeated_fingerprints(prints), "repeated"), broadcast_bytes)
    routed = pairs.withColumn("fingerprint", fingerprint()).join(again, "fingerprint", "left_semi")
    texts = routed.groupBy("fingerprint", "text").agg(F.min("doc_id").alias("first"))
    verified = written(texts.groupBy("fingerprint").agg(F.count("*").alias("texts"), F.min("first").alias("first")), "verified_fingerprints")
    rows = prints.join(small(verified.where("texts = 1").select("fingerprint", "first"), broadcast_bytes), "fingerprint")
    rows = rows.select("doc_id", "first", "fingerprint", F.lit(None).cast("string").alias("text"))
    mixed = verified.where("texts > 1").select("fingerprint")
    if not mixed.isEmpty():  # different texts with one fingerprint: their rows are told by the texts
        own = routed.join(small(mixed, broadcast_bytes), "fingerprint", "left_semi")
        first = own.groupBy("text").agg(F.min("doc_id").alias("first"))
        rows = rows.union(own.join(first, "text").select("doc_id", "first", "fingerprint", "text"))
    further = rows.where("doc_id <> first").select("doc_id", F.col("first").alias("duplicate_of"))
    return further.union(_repetitions(rows.where("doc_id = first").groupBy("doc_id", "fingerprint", "text").agg(F.count("*").alias("n"))))


SQL = """
SELECT doc_id, duplicate_of FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS duplicate_of,
         row_number() OVER (PARTITION BY text ORDER BY doc_id) AS place
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
WHERE place > 1
"""
