"""Files, folders or text to memories: ``python -m palimpsest.ingest SOURCE OUT [--dry-run]``, or ``--text TEXT OUT``, or - for standard input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import chunking as C
from palimpsest.sources import files


def ingest_files(found: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(memories, report) of files (path, content, readable, format): chunks that are not stored yet, and the totals."""
    chunks = C.chunk_files(found.where("readable"))
    stored = C.ingested(chunks, F.current_timestamp(), known)
    return stored, C.ingest_report(found, chunks, stored)


def ingest_text(spark: SparkSession, text: str, name: str = "<text>") -> tuple[DataFrame, DataFrame]:
    rows = spark.createDataFrame([(name, text, True, "text")], "path string, content string, readable boolean, format string")
    return ingest_files(rows)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("source", nargs="?", help="a file, a folder, or - for standard input")
    parser.add_argument("out", help="the folder of the memories")
    parser.add_argument("--text", help="a text in place of a source")
    parser.add_argument("--dry-run", action="store_true", help="report alone, store nothing")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    if given.text is not None or given.source == "-":
        stored, report = ingest_text(spark, given.text if given.text is not None else sys.stdin.read(), "<text>" if given.text is not None else "<stdin>")
    else:
        stored, report = ingest_files(files.read_texts(spark, given.source))
    if not given.dry_run:
        stored.write.mode("append").parquet(given.out)
    print(report.first().asDict())
    return 0


if __name__ == "__main__":
    sys.exit(main())
