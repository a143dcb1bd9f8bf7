"""The corpus pipeline: stages over documents, each written and reread by :func:`run`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, language, linedup, mixing, setjoin
from palimpsest.llm.common import small, table, written


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose id is not among those ids; null ids stay."""
    return docs.join(small(written(gone.select("doc_id").distinct(), "gone")), "doc_id", "left_anti").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know; the others go."""
    return language.identify(docs, language.train(docs)).where("hd_accepted").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the line blocks that they share with earlier ones."""
    return linedup.deduplicate_lines(docs, every_holder=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates."""
    return _without(docs, setjoin.near_duplicates(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the mix of equal weights for all sources."""
    return mixing.mix(docs, mixing.quality_weights(table(spark, sf_dir, "labels")))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
]

#: The language and line stages have no SQL; the tests compare each stage and the whole with the operators, which have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
