from pyspark.sql import functions as F

from palimpsest.streaming import events as S

SF = "/root/testdata/sf0.001"


def stream(spark, table):
    path = f"{SF}/{table}.parquet"
    batch = spark.read.parquet(path)
    return spark.readStream.schema(batch.schema).parquet(SF + "/", pathGlobFilter=f"{table}.parquet"), batch


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windowed_counts(spark):
    s, b = stream(spark, "events")
    ts = F.col("ts").cast("timestamp")
    found = run(S.windowed_counts(s.withColumn("ts", ts)), "counts", "complete")
    expected = S.windowed_counts(b.withColumn("ts", ts))
    assert found.count() > 0 and found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()


def test_outcome_pairs(spark, tmp_path):
    """Views with and without accesses, in two batches; events in the far future push the watermark past all others."""
    b = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    late = b.limit(2).withColumns({"ts": F.expr("TIMESTAMP '2030-01-01'"), "event_type": F.element_at(F.array(F.lit("view"), F.lit("click")), (F.monotonically_increasing_id() + 1).cast("int")), "event_id": F.lit(-1).cast("long")})
    b.write.parquet(f"{tmp_path}/in")
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    split = lambda d: (d.where("event_type = 'view'"), d.where("event_type in ('click', 'purchase')"))
    found = run(S.outcome_pairs(*split(s)), "pairs", "append").where("log_id >= 0")
    expected = S.outcome_pairs(*split(b))
    assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()
    labels = {r.outcome: r.n for r in S.outcomes(found).groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert labels[0.0] > 0 and sum(labels.values()) == b.where("event_type = 'view'").count()


def test_session_counts(spark):
    s, b = stream(spark, "conversations")
    found = {r.conv_id: r.turns for r in run(S.session_counts(s), "sessions", "update").collect()}
    assert found == {r.conv_id: r["count"] for r in b.groupBy("conv_id").count().collect()}


def test_latest_and_deduplicated(spark):
    s, b = stream(spark, "events")
    latest = run(S.latest_state(s), "latest", "complete")
    assert latest.count() == b.select("user_id").distinct().count()
    ts = F.col("ts").cast("timestamp")
    assert run(S.deduplicated(s.withColumn("ts", ts)), "once", "append").count() == b.count()


def test_idle_periods(spark):
    s, b = stream(spark, "events")
    ts = F.col("ts").cast("timestamp")
    found = run(S.idle_periods(s.withColumn("ts", ts), "2 hours"), "idle", "complete")
    assert found.agg(F.sum("n")).first()[0] == b.count()
    expected = S.idle_periods(b.withColumn("ts", ts), "2 hours")
    assert found.exceptAll(expected).isEmpty() and found.count() == expected.count() > b.select("user_id").distinct().count()


def test_counters_and_cache(spark):
    s, b = stream(spark, "events")
    found = run(S.counters(s), "counters", "update")
    expected = S.counters(b)
    assert found.exceptAll(expected).isEmpty() and found.count() == expected.count()
    cached = lambda d: S.expiring(d.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "value"), "1 day")
    found = run(cached(s), "cache", "complete")
    assert found.exceptAll(cached(b)).isEmpty() and found.count() == cached(b).count()


def test_session_state_with_timeout(spark):
    s, b = stream(spark, "conversations")
    found = {r.conv_id: r.turns for r in run(S.session_counts(s.withColumn("ts", F.timestamp_add("MINUTE", F.col("turn").cast("int"), F.expr("TIMESTAMP '2024-01-01'"))), "10 minutes"), "timed", "update").collect()}
    assert found == {r.conv_id: r["count"] for r in b.groupBy("conv_id").count().collect()}


def test_poll_overdue(spark):
    s, b = stream(spark, "orders")
    kind = lambda d: d.select(F.col("o_orderkey").alias("id"), F.lit("o").alias("owner"), F.lit("open").alias("status"), F.col("o_orderdate").alias("deadline"))
    at = F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'")
    found = run(S.poll_overdue(kind(s), at), "overdue", "append")
    assert found.count() == b.where("o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00'").count() > 0


def test_near_duplicates_are_not_stored(spark, tmp_path):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "a", [1.0, 0.0])]
    more = [(4, "a", [1.0, 0.01]), (5, "b", [1.0, 0.01]), (6, "a", [-1.0, 0.0])]
    write = S.near_duplicate_writer(f"{tmp_path}/stored")
    for n, batch in enumerate((rows, more)):
        write(spark.createDataFrame(batch, "id long, category string, embedding array<double>"), n)
    stored = sorted(r.id for r in spark.read.parquet(f"{tmp_path}/stored").collect())
    assert len(stored) == 4 and stored[1:] == [2, 5, 6]
