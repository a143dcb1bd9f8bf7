"""File sources: format detection, text, CSV and JSON readers, snapshot sink."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"text": ("txt", "text", "log"), "markdown": ("md", "markdown"), "csv": ("csv", "tsv"), "json": ("json", "jsonl"), "pdf": ("pdf",)}


def format_of(path: Column) -> Column:
    """The format by suffix, 'unsupported' for others."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("unsupported")
    for name, suffixes in FORMATS.items():
        out = F.when(suffix.isin(*suffixes), name).otherwise(out)
    return out


def read_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, format) of all files below a folder, each whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.expr("try_to_binary(cast(content as string), 'utf-8')").isNotNull().alias("readable"), F.col("content").cast("string").alias("content"), format_of(F.col("path")).alias("format"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, sep="\t" if path.endswith(".tsv") else ",")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array, object or lines of JSON, told apart by Spark's reader."""
    return spark.read.option("multiLine", not path.endswith(".jsonl")).json(path)


def write_snapshot(df: DataFrame, folder: str, version: int) -> str:
    """An immutable snapshot of a table; readers take the greatest version."""
    path = f"{folder}/v={version:08d}"
    df.write.parquet(path)
    return path


def keep_newest(spark: SparkSession, folder: str, most: int = 3) -> list[str]:
    """Deletes all but the newest snapshots of :func:`write_snapshot`; returns what went."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("v="))
    gone = found[: max(0, len(found) - most)]
    for name in gone:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, name), True)
    return gone


def newest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot of the greatest version."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
    return spark.read.parquet(f"{folder}/{max(found)}")


def check_manifest(spark: SparkSession, folder: str, model: str, dims: int) -> None:
    """Writes which embeddings a store holds, or raises ValueError where it holds others."""
    name = f"{folder}/manifest"
    try:
        held = spark.read.json(name).first()
    except AnalysisException:  # a new store
        spark.createDataFrame([(model, dims)], "model string, dims int").coalesce(1).write.json(name)
        return
    if (held.model, held.dims) != (model, dims):
        raise ValueError(f"the store holds {held.dims} numbers by {held.model}, not {dims} by {model}")
