"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.llm import chat, decontaminate, exact_dedup, html, language, linedup, mixing, pii, quality, setjoin
from palimpsest.llm.common import table

#: A deployment passes its own key; this one makes the registered query repeatable.
KEY = b"palimpsest: registered query"


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op2_pii(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents"), KEY)


def op3_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", "hd_lang", F.round("hd_cosine", 4).alias("hd_cosine"), "hd_accepted")


def op4_line_dedup(spark, sf_dir):
    return linedup.deduplicate_lines(table(spark, sf_dir, "documents"), every_holder=True)


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.round("probability", 4).alias("probability"), (F.col("probability") >= quality.KEEP).alias("keep"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.quality_weights(table(spark, sf_dir, "labels")))


def op7_html(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op8_chat(spark, sf_dir):
    return chat.link_calls(table(spark, sf_dir, "conversations"))


def op9_jaccard_join(spark, sf_dir):
    return setjoin.jaccard_join(table(spark, sf_dir, "documents")).withColumn("jaccard", F.round("jaccard", 6))


def op10_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_pii": op2_pii,
    "op3_language": op3_language,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_html": op7_html,
    "op8_chat": op8_chat,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_decontaminate": op10_decontaminate,
}
ORACLE_SQL = {"op1_exact_dedup": exact_dedup.SQL, "op6_mixing": mixing.sql(), "op8_chat": chat.SQL, "op9_jaccard_join": setjoin.SQL}
