"""Tables, shared storage and small helpers of the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes in memory that may be broadcast; above it the same join shuffles.
BROADCAST_BYTES = 64_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset a temporary one, on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows written once to the shared folder and read back: survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  (the session is gone; the folder's owner cleans up)
        pass


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory, from its columns' types and lengths."""

    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
                return F.aggregate(F.coalesce(c, F.array().cast(kind)), F.lit(16).cast("long"), lambda n, x: n + of(x, kind.elementType).cast("long"))
            return F.greatest(F.size(c), F.lit(0)) * 8 + 16
        if isinstance(kind, T.StructType):
            return sum((of(c[f.name], f.dataType) for f in kind), F.lit(8))
        return F.lit(8)

    return sum((of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16)).cast("long")


def small(keys: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows, to be broadcast if they take no more than ``limit`` bytes in memory.

    ``keys`` must be cheap to read (a written table).  Beyond the limit Spark's own
    choice, a shuffled join, stays.
    """
    taken = keys.select(row_bytes(keys).alias("n")).agg(F.sum("n")).first()[0] or 0
    return F.broadcast(keys) if taken <= limit else keys
