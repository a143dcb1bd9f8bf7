"""Chunking of texts into retrieval units, as JVM folds over their pieces."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, LEAST = 3000, 50


def pack(pieces: Column, size: int, least: int, joiner: str) -> Column:
    """Greedy packing: a piece that would overflow starts a new chunk once the buffer is long enough."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buffer"))

    def step(acc, piece):
        buffer = acc["buffer"]
        joined = F.when(buffer == "", piece).otherwise(F.concat(buffer, F.lit(joiner), piece))
        full = (buffer != "") & (F.length(joined) > size) & (F.length(buffer) >= least)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(buffer))).otherwise(acc["done"]).alias("done"), F.when(full, piece).otherwise(joined).alias("buffer"))

    return F.aggregate(pieces, zero, step, lambda acc: F.when(F.length(acc["buffer"]) >= least, F.concat(acc["done"], F.array(acc["buffer"]))).otherwise(acc["done"]))


def chunk_text(docs: DataFrame, id_column: str = "id", text_column: str = "content", size: int = SIZE, least: int = LEAST, separator: str = r"\n\s*\n") -> DataFrame:
    """(id, chunk, content): paragraphs packed up to ``size`` characters; a short tail is dropped."""
    pieces = F.filter(F.transform(F.split(F.col(text_column), separator), F.trim), lambda p: p != "")
    return docs.select(F.col(id_column).alias("id"), F.posexplode(pack(pieces, size, least, "\n\n")).alias("chunk", "content"))


def chunk_markdown(docs: DataFrame, id_column: str = "id", text_column: str = "content", size: int = SIZE, least: int = LEAST) -> DataFrame:
    """As :func:`chunk_text` over sections that begin at heading lines, with the first heading."""
    pieces = F.filter(F.transform(F.split(F.col(text_column), r"(?m)\n(?=#)"), F.trim), lambda p: p != "")
    out = docs.select(F.col(id_column).alias("id"), F.posexplode(pack(pieces, size, least, "\n\n")).alias("chunk", "content"))
    return out.withColumn("heading", F.nullif(F.trim(F.regexp_extract("content", r"(?m)^#+\s*(.*)$", 1)), F.lit("")))


def chunk_rows(rows: DataFrame, group: str, order: str, line: Column, per_chunk: int = 20) -> DataFrame:
    """(group, chunk, content): so many rows to a chunk, each as text, with rules between."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order)
    numbered = rows.select(F.col(group).alias("id"), line.alias("line"), (F.row_number().over(w) - 1).alias("n"))
    packed = numbered.groupBy("id", F.floor(F.col("n") / per_chunk).cast("int").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    return packed.select("id", "chunk", F.array_join(F.col("l.line"), "\n---\n").alias("content"))


def key_values(columns: list[str]) -> Column:
    """A row as lines of ``name: value``, without null and blank values."""
    lines = F.array(*(F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(c).cast("string")))) for c in columns))
    return F.array_join(lines, "\n")


def _packed(pieces: list[str], size: int, least: int) -> list[str]:
    """Pieces joined by blank lines up to ``size`` characters; a buffer shorter than ``least`` is left out."""
    out, held, length = [], [], 0
    for piece in [*pieces, None]:
        if held and (piece is None or length + len(piece) > size):
            out.append("\n\n".join(held))
            held, length = [], 0
        if piece is not None:
            held.append(piece)
            length += len(piece)
    return [x for x in out if len(x) >= least]


def _shown(value: object) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def json_chunks(text: str | None, size: int = SIZE, least: int = LEAST) -> list[tuple[str, str]]:
    """(kind, content) of JSON text: an array by elements, an object by keys, anything else by lines."""
    text = (text or "").strip()
    try:
        value = json.loads(text) if text[:1] in ("{", "[") else None
    except (ValueError, RecursionError):
        value = None
    if isinstance(value, list):
        kind, pieces = "array", [_shown(x) for x in value]
    elif isinstance(value, dict):
        kind, pieces = "object", [_shown({k: v}) for k, v in value.items()]
    else:
        kind, pieces = "jsonl", []
        for line in filter(None, map(str.strip, text.split("\n"))):
            try:
                pieces.append(_shown(json.loads(line)))
            except (ValueError, RecursionError):
                pieces.append(line)
    return [(kind, c) for c in _packed(pieces, size, least)]


def chunk_json(docs: DataFrame, id_column: str = "id", text_column: str = "content", size: int = SIZE, least: int = LEAST) -> DataFrame:
    """(id, chunk, kind, content): JSON texts packed by elements, keys or lines, two spaces of indentation.  A null text has no chunk."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(at, n, kind, content) for at, text in enumerate(b.column(1).to_pylist()) for n, (kind, content) in enumerate(json_chunks(text, size, least))]
            columns = list(zip(*rows)) if rows else [()] * 4
            ids = b.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.record_batch([ids, *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), pa.string(), pa.string())))], ["id", "chunk", "kind", "content"])

    rows = docs.select(F.col(id_column).alias("id"), text_column)
    return rows.mapInArrow(chunks, f"id {rows.schema['id'].dataType.simpleString()}, chunk int, kind string, content string")


def chunk_pages(pages: DataFrame, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """(id, chunk, first_page, last_page, content) of page texts (id, page, text), as an extractor of PDF pages gives them.

    Pages are packed in order up to ``size`` characters; a displaced buffer shorter than ``least`` is dropped.
    """

    def pack_pages(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held, pages_of, length = [], [], [], 0
        rows = [(p, (t or "").strip()) for p, t in sorted(zip(pdf["page"].tolist(), pdf["text"].tolist()))]
        for page, text in [*(r for r in rows if r[1]), (None, None)]:
            if held and (text is None or length + 2 + len(text) > size):
                content = "\n\n".join(held)
                if len(content) >= least:
                    out.append((pdf["id"].iloc[0], len(out), pages_of[0], pages_of[-1], content))
                held, pages_of, length = [], [], 0
            if text:
                length += len(text) + (2 if held else 0)
                held.append(text)
                pages_of.append(page)
        return pd.DataFrame(out, columns=["id", "chunk", "first_page", "last_page", "content"])

    kind = pages.schema["id"].dataType.simpleString()
    return pages.select("id", F.col("page").cast("int").alias("page"), "text").groupBy("id").applyInPandas(pack_pages, f"id {kind}, chunk int, first_page int, last_page int, content string")


def chunk_files(files: DataFrame) -> DataFrame:
    """(path, format, chunk, content) of text files (path, content, format), each by the rules of its format.

    CSV and TSV files are packed 20 lines to a chunk under the header's names.  Unreadable and unsupported files have no chunk.
    """
    of = lambda *names: files.where(F.col("format").isin(*names) & F.col("content").isNotNull())
    text = chunk_text(of("text"), "path").select("id", F.lit("text").alias("format"), "chunk", "content")
    mark = chunk_markdown(of("markdown"), "path").select("id", F.lit("markdown").alias("format"), "chunk", "content")
    data = chunk_json(of("json"), "path").select("id", F.lit("json").alias("format"), "chunk", "content")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = list(csv.DictReader(io.StringIO(content), delimiter="\t" if path.endswith(".tsv") else ","))
                lines = ["\n".join(f"{k}: {v.strip()}" for k, v in row.items() if k and isinstance(v, str) and v.strip()) for row in rows]
                out += [(path, n, "\n---\n".join(lines[at : at + 20])) for n, at in enumerate(range(0, len(lines), 20))]
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()))], ["id", "chunk", "content"])

    rows = of("csv").select("path", "content").mapInArrow(tables, "id string, chunk int, content string").select("id", F.lit("csv").alias("format"), "chunk", "content")
    return text.unionByName(mark).unionByName(data).unionByName(rows).withColumnRenamed("id", "path")


def ingested(chunks: DataFrame, at: Column, known: DataFrame | None = None) -> DataFrame:
    """(id, content, category, metadata, created_at): chunks as new memories with their provenance; those whose content is known are left out."""
    made = chunks.select(F.sha2(F.concat_ws("\0", "path", "chunk", "content"), 256).alias("id"), "content", F.lit("document").alias("category"),
        F.create_map(F.lit("source"), F.col("path"), F.lit("format"), F.col("format"), F.lit("chunk"), F.col("chunk").cast("string")).alias("metadata"), at.alias("created_at"))
    return made if known is None else made.join(known.select("content").distinct(), "content", "left_anti").select("id", "content", "category", "metadata", "created_at")


def ingest_report(files: DataFrame, chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """(files, skipped, chunks, stored): one row of totals; reports of several runs add up by :func:`merged_reports`."""
    readable = F.col("content").isNotNull() & F.col("readable") & (F.col("format") != "unsupported")
    counts = files.agg(F.count("*").alias("files"), F.count_if(~F.coalesce(readable, F.lit(False))).alias("skipped"))
    return counts.crossJoin(chunks.agg(F.count("*").alias("chunks"))).crossJoin(stored.agg(F.count("*").alias("stored")))  # one row each


def merged_reports(reports: DataFrame) -> DataFrame:
    return reports.agg(*(F.sum(c).alias(c) for c in ("files", "skipped", "chunks", "stored")))
