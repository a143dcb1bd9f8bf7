"""Operator 6: mixing sources to target weights with Efraimidis-Spirakis sampling.

A document's key is an exponential variate divided by its quality weight; the documents of
a source in order of their keys are a weighted sample without replacement.  Each source
gets a share of the token budget by its target weight.  Whole epochs of the source come
first; the rest of the budget is filled in key order, as far as the running sum of tokens
stays within it.

The running sum is found in two levels: totals of key buckets are summed over buckets,
then documents within their bucket, so that no task ever sorts a whole source.  Buckets are
equal steps of the key's logarithm: whatever the weights, a key is a mixture of exponential
variates, and the logarithm of none has a density above 1/e, so that no step of 1/n holds more than
a share of 0.37/n of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import small, written

#: Documents that a task sorts at once, on average.
BUCKET_DOCS = 50_000
SEED = "mix-1"


def uniform(seed: str = SEED) -> Column:
    """A number in (0, 1) from the id: 48 bits of an MD5, the same in any engine."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")
    return (bits + 0.5) / float(1 << 48)


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): 1 for good, 0.2 for bad, a tenth of it for toxic; of several labels the worst counts."""
    worst = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("x"))
    weight = F.when(F.col("q") == 0, 0.2).otherwise(F.when(F.col("q").isNull(), 0.6).otherwise(1.0)) * F.when(F.col("x") == 1, 0.1).otherwise(1.0)
    return worst.select("doc_id", weight.alias("weight"))


def mix(docs: DataFrame, weights: DataFrame, targets: dict[str, float] | None = None, budget_ratio: float = 1.0, default_weight: float = 0.6, bucket_docs: int = BUCKET_DOCS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the documents of the mix and how often each is taken.

    ``targets`` gives sources' weights, 1 for any not named (a null source is a source of
    its own); the budget is ``budget_ratio`` times all tokens.  Tokens are runs of
    characters other than white space.  Documents without tokens (null, empty, blank) are
    never taken.  ``weights`` is (doc_id, weight), one row an id; ``default_weight`` holds
    where it has none, and a weight must be positive.  Ties of keys are broken by id, then
    tokens; repeated rows are taken each for itself.  Empty tables give an empty mix.
    """
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.cast("long").alias("n_tokens")).where("n_tokens > 0")
    keyed = taken.join(weights.select("doc_id", "weight"), "doc_id", "left").withColumn("key", -F.log(uniform(seed)) / F.coalesce("weight", F.lit(default_weight)))
    keyed = written(keyed, "keys")  # narrow rows, used three times below: the texts are read once
    total = keyed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    target = F.lit(1.0)
    for name, value in sorted((targets or {}).items()):
        target = F.when(F.col("source") == name, float(value)).otherwise(target)
    everything = Window.partitionBy(F.lit(0))  # as many rows as there are sources
    plan = total.withColumn("target", target)
    plan = plan.withColumn("budget", F.floor(F.sum("tokens").over(everything) * F.lit(float(budget_ratio)) * F.col("target") / F.sum("target").over(everything)).cast("long"))
    plan = plan.select("source", (F.col("budget") / F.col("tokens")).cast("long").alias("epochs"), (F.col("budget") % F.col("tokens")).alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("n") / bucket_docs)).alias("buckets"))
    plan = small(written(plan.withColumnRenamed("source", "of"), "plan"))
    placed = keyed.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    placed = placed.withColumn("bucket", F.floor(F.log("key") * F.col("buckets")).cast("long"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("own"))
    before = F.sum("own").over(Window.partitionBy("source").orderBy("bucket")) - F.col("own")
    sums = sums.select(F.col("source").alias("of"), F.col("bucket").alias("at"), before.alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    summed = placed.withColumn("within", within).join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at")))
    copies = F.col("epochs") + F.when(F.col("before") + F.col("within") <= F.col("rest"), 1).otherwise(0)
    return summed.select("doc_id", "source", "n_tokens", copies.cast("long").alias("copies")).where("copies > 0")


def sql(table: str = "documents", targets: dict[str, float] | None = None, budget_ratio: float = 1.0, default_weight: float = 0.6, seed: str = SEED) -> str:
    """DuckDB SQL for the rows of :func:`mix` with :func:`quality_weights` of ``labels``."""
    cases = " ".join(f"WHEN source = '{k}' THEN {float(v)!r}" for k, v in sorted((targets or {}).items()))
    target = f"CASE {cases} ELSE 1.0 END" if cases else "1.0"
    return f"""
WITH quality AS (SELECT doc_id, CASE WHEN min(quality) = 0 THEN 0.2 WHEN min(quality) IS NULL THEN 0.6 ELSE 1.0 END::DOUBLE
                   * CASE WHEN max(toxic) = 1 THEN 0.1 ELSE 1.0 END::DOUBLE AS weight
                 FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
     taken AS (SELECT doc_id, source, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS n_tokens
               FROM {table}),
     keyed AS (SELECT t.*, -ln((('0x' || substr(md5('{seed}:' || coalesce(t.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / {float(1 << 48)!r}::DOUBLE)
                      / coalesce(weight, {default_weight}) AS key
               FROM taken t LEFT JOIN quality USING (doc_id) WHERE n_tokens > 0),
     total AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, {target}::DOUBLE AS target FROM keyed GROUP BY source),
     plan AS (SELECT *, floor(sum(tokens) OVER () * {float(budget_ratio)!r}::DOUBLE * target / sum(target) OVER ())::BIGINT AS budget FROM total),
     summed AS (SELECT doc_id, source, n_tokens, sum(n_tokens) OVER (PARTITION BY source ORDER BY key, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS ahead FROM keyed)
SELECT doc_id, s.source, n_tokens::BIGINT AS n_tokens, (budget // tokens + CASE WHEN ahead <= budget % tokens THEN 1 ELSE 0 END)::BIGINT AS copies
FROM summed s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
WHERE budget // tokens + CASE WHEN ahead <= budget % tokens THEN 1 ELSE 0 END > 0
"""
