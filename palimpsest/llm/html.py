"""Operator 7: main text of web pages by differencing with the page of the nearest URL.

Within each host every page is paired with the page whose URL path is nearest: its
neighbour in path order with the longer common prefix.  The text lines of the two are
aligned by a longest common subsequence, and the shared lines, which are the site's
template, are deleted.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import parts, small, written
from palimpsest.llm.linedup import common_subsequence as aligned

#: Bytes of neighbours' line hashes up to which they are broadcast; beyond it the text is shuffled once.
BROADCAST_PAIRS = 32_000_000

_BLOCKS = set("address article aside blockquote body br center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|textarea|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|</?(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|</?(?P<broken>[a-zA-Z][a-zA-Z0-9:-]*+)[^>]*+>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
_SPACE = re.compile(r"[^\S\n]+")


def text_lines(page: str | None) -> list[str]:
    """The visible lines: block tags end a line, other tags vanish, entities are decoded, spaces collapse."""
    if not page:
        return []

    def instead(m: re.Match) -> str:
        name = m["name"] or m["broken"]
        return "\n" if name and name.lower() in _BLOCKS else " " if m["raw"] else ""

    flat = _TAG.sub(instead, page.replace("\r", "\n").replace("\n", " "))
    lines = (_SPACE.sub(" ", html.unescape(line).replace("\n", " ")).strip() for line in flat.split("\n"))
    return [line for line in lines if line]


def common_subsequence(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence as places in a and b: equal ends first, bit vectors for what lies between."""
    low, end = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while end < min(len(a), len(b)) - low and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    middle = aligned(a[low : len(a) - end], b[low : len(b) - end])
    return [*((k, k) for k in range(low)), *((low + i, low + j) for i, j in middle), *((len(a) - k, len(b) - k) for k in range(end, 0, -1))]


def url_parts() -> tuple[Column, Column]:
    """Host and path of ``url``: case of the host, query, fragment, .html and a last slash don't count."""
    url = F.coalesce("url", F.lit(""))
    pattern = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)"
    host = F.lower(F.regexp_extract(url, pattern, 1))
    path = F.when(url.rlike(pattern), F.regexp_extract(url, pattern, 2)).otherwise(F.regexp_extract(url, r"^([^?#]*)", 1))
    return host, F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), r"/+$", "")


def _prefix(a: str, b: str) -> Column:
    """Length of the common prefix of two string columns, by bisection: one comparison for each power of two."""
    size = F.least(F.length(a), F.length(b))

    def step(n: Column, power: Column) -> Column:
        longer = n + power
        return F.when((longer <= size) & (F.substring(F.col(a), F.lit(1), longer) == F.substring(F.col(b), F.lit(1), longer)), longer).otherwise(n)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), F.lit(0), step)


def _neighbours(paths: DataFrame) -> DataFrame:
    """``paths`` with the path, id and rep of the one before and the one after it in its host, null at the ends.

    Hosts are cut into slices of neighbouring paths, so that no task sorts a host; only the first and
    last path of each slice are put in order over all of a host.
    """
    spark = paths.sparkSession
    own = F.struct("path", "id", "rep")
    sliced = written(paths.repartitionByRange(parts(spark), "host", "path").withColumn("slice", F.spark_partition_id()), "path_slices")
    within = Window.partitionBy("slice", "host").orderBy("path")
    near = sliced.select("host", "path", "slice", F.lag(own).over(within).alias("before"), F.lead(own).over(within).alias("after"))
    ends = sliced.groupBy("host", "slice").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    across = Window.partitionBy("host").orderBy("slice")  # as many rows as slices
    ends = ends.select("host", "slice", F.lag("last").over(across).alias("from"), F.lead("first").over(across).alias("to"))
    ends = written(ends.where(F.col("from").isNotNull() | F.col("to").isNotNull()), "slice_ends")
    joined = near.join(small(ends), ["host", "slice"], "left").select("host", "path", F.coalesce("before", "from").alias("b"), F.coalesce("after", "to").alias("a"))
    return joined.select("host", "path", *(F.col(f"{s[0]}.{c}").alias(f"{s}_{c}") for s in ("before", "after") for c in ("path", "id", "rep")))


def _signed(line: str) -> int:
    value = xxhash.xxh3_64_intdigest(line)
    return value - (1 << 64) if value >> 63 else value


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [[_signed(x) for x in text_lines(page)] for page in b.column(b.num_columns - 1).to_pylist()]
        yield pa.record_batch([*b.columns[:-1], pa.array(found, pa.list_(pa.int64()))], ["page_id", "host", "path", "row", "hashes"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = ["\n".join(text_lines(page)) for page in b.column(3).to_pylist()]
        yield pa.record_batch([*b.columns[:3], pa.array(text, pa.string())], ["page_id", "url", "row", "text"])


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, other in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
            own = text.split("\n") if text else []
            gone = {i for i, _ in common_subsequence([_signed(x) for x in own], other or [])}
            out.append(("\n".join(x for i, x in enumerate(own) if i not in gone), len(gone)))
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int32())], ["page_id", "url", "neighbour_id", "text", "removed"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, neighbour_id, text, removed): every page's text without the lines it shares with its neighbour.

    Pages of one host with equal paths are versions of one page: they are not neighbours of
    each other, and the one with the smallest id stands for the path.  A page without a
    neighbour (one path in its host) keeps all its lines.  Of two equally near neighbours
    the one before in path order is taken.  Null and empty pages have an empty text; a null
    URL is host '' and path ''; rows repeated in id, URL and page each give a row.  Other
    columns are not read.  Pages are handled whole.
    """
    host, path = url_parts()
    row = F.xxhash64("page_id", "url", "html")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    # lines are compared by 64-bit hashes, so a neighbour travels as about 200 bytes
    narrow = pages.select("page_id", host.alias("host"), path.alias("path"), row.alias("row"), "html")
    narrow = written(narrow.mapInArrow(_hashes, "page_id long, host string, path string, row long, hashes array<long>"), "page_lines")
    first = F.struct(F.col("page_id").isNull(), "page_id", "row")
    paths = narrow.groupBy("host", "path").agg(F.min(first).alias("f")).select("host", "path", F.col("f.page_id").alias("id"), F.col("f.row").alias("rep"))
    near = _neighbours(paths)
    take_after = F.col("before_rep").isNull() | F.coalesce(_prefix("path", "after_path") > _prefix("path", "before_path"), F.lit(False))
    pick = lambda c: F.when(take_after, F.col(f"after_{c}")).otherwise(F.col(f"before_{c}"))
    near = near.select("host", "path", pick("id").alias("neighbour_id"), pick("rep").alias("rep")).where("rep is not null")
    asked = narrow.select("host", "path", "row").distinct().join(near, ["host", "path"]).select("row", "neighbour_id", "rep")
    held = narrow.select(F.col("row").alias("rep"), F.col("hashes").alias("others")).dropDuplicates(["rep"])
    pairs = written(asked.join(held, "rep").select("row", "neighbour_id", "others"), "page_pairs")
    texts = pages.select("page_id", "url", row.alias("row"), "html").mapInArrow(_texts, "page_id long, url string, row long, text string")
    joined = texts.join(small(pairs, BROADCAST_PAIRS), "row", "left").select("page_id", "url", "neighbour_id", "text", "others")
    return joined.mapInArrow(_difference, "page_id long, url string, neighbour_id long, text string, removed int")
