"""What follows a model's answer: acceptance, caps, types and predicates of extracted entities, triples and notes.

The model itself is a column that the caller fills; everything here is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from palimpsest.operators.vector import nearest_label

#: A note's type and the category it is stored under.
NOTE_CATEGORIES = {"decision": "project", "preference": "preference", "fact": "learning", "event": "history"}
ANSWER = "entities array<struct<name:string,type:string>>, relationships array<struct<subject:string,predicate:string,object:string,confidence:double>>"


def parse_answers(answers: DataFrame, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """(entities, triples) of answers (id, source, answer): none where the source has fewer than ``least`` characters or the answer is no JSON."""
    parsed = answers.withColumn("o", F.when(F.length("source") >= least, S.tolerant_json(F.col("answer"), ANSWER)))
    entities = parsed.select("id", F.posexplode("o.entities").alias("place", "e")).select("id", "place", "e.*")
    triples = parsed.select("id", F.posexplode("o.relationships").alias("place", "r")).select("id", "place", "r.*")
    return entities, triples


def first_per(rows: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each group in that order: a cap on what one answer may add."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def accept_entities(entities: DataFrame, most: int = 20) -> DataFrame:
    """(id, place, name, type): names cleaned of injections and unsafe characters; garbage and repeats go; at most ``most`` an answer."""
    clean = entities.withColumn("name", S.safe_name(S.strip_injections(F.col("name")))).where(~S.is_garbage_name(F.col("name")))
    kind = F.coalesce(F.nullif(F.lower(F.trim("type")), F.lit("")), F.lit("unknown"))
    once = clean.groupBy("id", S.canonical_name(F.col("name")).alias("canonical")).agg(F.min_by(F.struct("place", "name", kind.alias("type")), "place").alias("e"))
    return first_per(once.select("id", "e.*"), "id", [F.asc("place")], most)


def accept_triples(triples: DataFrame, most: int = 30, least: float = 0.5, causal: float = 0.8) -> DataFrame:
    """(id, place, subject, subject_type, predicate, object, object_type, confidence): triples that may be stored.

    Both ends must be sound names, confidence reach ``least``, or ``causal`` for causal predicates; a missing one
    counts 0.5.  Ends get the type that the predicate implies.
    """
    predicate = F.regexp_replace(F.lower(F.trim("predicate")), r"[\s-]+", "_")
    clean = triples.withColumns({"subject": S.safe_name(S.strip_injections(F.col("subject"))), "object": S.safe_name(S.strip_injections(F.col("object"))), "predicate": predicate, "confidence": S.clamp_unit(F.col("confidence"))})
    needed = F.when(F.col("predicate").isin(*S.CAUSAL), causal).otherwise(least)
    sound = clean.where((F.col("predicate") != "") & ~S.is_garbage_name(F.col("subject")) & ~S.is_garbage_name(F.col("object")) & (F.col("confidence") >= needed))
    typed = sound.withColumns({"subject_type": S.inferred_type(F.col("predicate"), S.SUBJECT_TYPES), "object_type": S.inferred_type(F.col("predicate"), S.OBJECT_TYPES)})
    return first_per(typed, "id", [F.asc("place")], most).select("id", "place", "subject", "subject_type", "predicate", "object", "object_type", "confidence")


def allowed_predicates(triples: DataFrame, allowed: list[str], embeddings: DataFrame | None = None, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): allowed predicates stay, others become the allowed one of the nearest embedding, or are rejected.

    ``embeddings`` is (predicate, embedding) for allowed and unknown predicates alike; without it nothing is normalised.
    """
    known = triples.where(F.col("predicate").isin(*allowed))
    other = triples.where(~F.col("predicate").isin(*allowed) | F.col("predicate").isNull())
    if embeddings is None:
        return known, other
    labels = embeddings.where(F.col("predicate").isin(*allowed)).select(F.col("predicate").alias("label"), "embedding")
    items = embeddings.where(~F.col("predicate").isin(*allowed)).select(F.col("predicate").alias("id"), "embedding")
    near = nearest_label(items, labels, threshold).select(F.col("id").alias("predicate"), F.col("label").alias("canonical"))
    joined = other.join(near, "predicate", "left")
    moved = joined.where("canonical is not null").withColumn("predicate", F.col("canonical")).select(*triples.columns)
    return known.unionByName(moved), joined.where("canonical is null").select(*triples.columns)


def accept_notes(notes: DataFrame, least: float = 0.6, scale: float = 0.9, most: int = 20) -> DataFrame:
    """(id, place, content, category, confidence) of a review's notes (id, place, type, content, confidence): sure enough, confidence scaled down."""
    category = F.lit("learning")
    for kind, name in NOTE_CATEGORIES.items():
        category = F.when(F.lower("type") == kind, name).otherwise(category)
    sure = notes.where((F.trim(F.coalesce("content", F.lit(""))) != "") & (S.clamp_unit(F.col("confidence")) >= least))
    scaled = sure.select("id", "place", "content", category.alias("category"), (S.clamp_unit(F.col("confidence")) * scale).alias("confidence"))
    return first_per(scaled, "id", [F.asc("place")], most)


def accept_inferences(notes: DataFrame, scale: float = 0.8, most: int = 20) -> DataFrame:
    """(id, place, subject, content, confidence) of inferences whose subject and content may be lists: the first of a list counts."""
    first = lambda c: F.coalesce(F.get(F.from_json(c, "array<string>"), F.lit(0)), F.col(c))
    made = notes.select("id", "place", first("subject").alias("subject"), first("content").alias("content"), (S.clamp_unit(F.col("confidence")) * scale).alias("confidence"))
    return first_per(made.where(F.trim(F.coalesce("content", F.lit(""))) != ""), "id", [F.asc("place")], most)


def reviewable(turns: DataFrame, extracted: DataFrame, now: Column, least: int = 4, quiet: int = 300) -> DataFrame:
    """(conv_id, transcript): conversations of at least so many turns that were not extracted within the last seconds."""
    told = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    recent = extracted.where(F.col("at") > now - F.expr(f"INTERVAL {quiet} SECONDS")).select("conv_id")
    text = F.array_join(F.transform("t", lambda x: F.concat_ws(": ", F.initcap(x["role"]), x["text"])), "\n")
    return told.where(F.col("n") >= least).join(recent, "conv_id", "left_anti").select("conv_id", text.alias("transcript"))
