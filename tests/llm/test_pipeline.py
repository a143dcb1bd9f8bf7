import corpus_pipeline as P
from palimpsest.llm import decontaminate, language, setjoin
from palimpsest.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    source = table(spark, SF, "documents")
    kept = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["language ID", "line dedup", "near duplicates", "benchmark decontamination", "source mixing"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    one = kept["language ID"](spark, source, SF)
    scored = language.identify(source, language.train(source))
    assert one.columns == source.columns and ids(one) == ids(scored.where("hd_accepted"))
    near = kept["near duplicates"](spark, source, SF)
    gone = {r.doc_id for r in setjoin.near_duplicates(source).collect()}
    assert near.columns == source.columns and ids(near) == [i for i in ids(source) if i not in gone] and gone
    clean = kept["benchmark decontamination"](spark, source, SF)
    leaks = {r.doc_id for r in decontaminate.contaminated(source, table(spark, SF, "benchmark")).collect()}
    assert clean.columns == source.columns and ids(clean) == [i for i in ids(source) if i not in leaks]
    assert ids(kept["line dedup"](spark, source, SF)) == ids(source)


def test_run(spark):
    source = table(spark, SF, "documents")
    step = source
    for name, stage in P.STAGES:
        rows = [tuple(r) for r in stage(spark, step, SF).collect()]
        step = spark.createDataFrame(rows, stage(spark, step, SF).schema)
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(rows)
