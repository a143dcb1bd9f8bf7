import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import language as L
from tests.llm.helpers import docs

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and then it runs through the whole forest with the other animals",
    "de": "der schnelle braune fuchs springt über den faulen hund und läuft dann durch den ganzen wald zu den anderen tieren",
    "fr": "le renard brun rapide saute par dessus le chien paresseux et puis il court dans toute la forêt avec les autres animaux",
}


def brute(text):
    """Binding and bundling by definition, one trigram at a time."""
    symbol = [ord(c.lower()) if c.isalpha() else 0 for c in text]
    symbol = [s for i, s in enumerate(symbol) if i == 0 or s > 0 or symbol[i - 1] > 0]
    total = np.zeros(L.DIMENSIONS, int)
    letter = lambda s: L.letter_vector(s).astype(int)
    for a, b, c in zip(symbol, symbol[1:], symbol[2:]):
        if b:
            total += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return total


def test_bundle_by_definition():
    for text in [*TEXTS.values(), "Ab  c!!d", "é", "日本語 text", "Привет, мир! привет", "ab 𐐨𐐩 cd", "ελληνικά και english"]:
        vector, n = L.bundle(text)
        assert np.array_equal(vector.astype(int), brute(text) if len(text) > 2 else np.zeros(L.DIMENSIONS, int))
        assert n == (sum(c.isalpha() for c in text[1:-1]) if len(text) > 2 else 0)


def test_letters_of_any_script_differ():
    """No two letters share a vector, so that languages of one script can be told apart."""
    seen = {L.letter_vector(ord(c)).tobytes() for c in "abcßéñабвгдежзийклмноαβγδ日本語한국ا"}
    assert len(seen) == len("abcßéñабвгдежзийклмноαβγδ日本語한국ا")
    russian, bulgarian = "съешь же ещё этих мягких французских булок да выпей чаю " * 5, "жълтата дюля беше щастлива че пухът който цъфна замръзна като гьон " * 5
    matrix = np.array([L.unit(L.bundle(t)[0]) for t in (bulgarian, russian)])
    assert L.scores("мягких булок выпей", ["bg", "ru"], matrix)[0] == "ru" and L.scores("дюля беше като", ["bg", "ru"], matrix)[0] == "bg"


def test_ties_and_short_texts(spark):
    one = L.unit(L.bundle(TEXTS["en"])[0])
    assert L.scores(TEXTS["en"], ["a", "b"], np.array([one, one]))[0] == "a"
    assert L.bound(4) == L.LEAST_COSINE < L.bound(30) < L.bound(60) == L.bound(10**6) == L.MIN_COSINE
    # two languages with one prototype: the first by name, whatever the order of the rows
    rows = [(1, TEXTS["de"], "zz"), (2, TEXTS["de"], "aa"), (3, TEXTS["de"], None)]
    table = docs(spark, rows)
    assert {r.hd_lang for r in L.identify(table, L.train(table)).collect()} == {"aa"}


def test_held_out_accuracy(spark):
    """Prototypes from four fifths of the documents, by hash of the id; accuracy on the others."""
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    train, test = source.where(~held), source.where(held)
    assert not {r.doc_id for r in train.select("doc_id").collect()} & {r.doc_id for r in test.select("doc_id").collect()}
    found = L.identify(test, L.train(train, 40)).where("n_chars >= 200").select("lang", "hd_lang", "hd_accepted").collect()
    assert len(found) > 100 and np.mean([r.lang == r.hd_lang for r in found]) > 0.98 and np.mean([r.hd_accepted for r in found]) > 0.97


def test_edge_cases(spark):
    rows = [(i, t, k) for i, (k, t) in enumerate(TEXTS.items())] + [(10, None, None), (11, "", "en"), (12, "!!! 123", "en"), (None, TEXTS["de"], None), (13, TEXTS["fr"] * 2000, "fr"), (13, TEXTS["fr"] * 2000, "fr")]
    table = docs(spark, rows).withColumnRenamed("hash", "hd_lang")
    out = L.identify(table, L.train(table))
    assert set(out.columns) == {*table.columns, "hd_cosine", "hd_accepted"}
    found = out.select("doc_id", "hd_lang", "hd_accepted").collect()
    assert len(found) == len(rows)
    by = {r.doc_id: (r.hd_lang, r.hd_accepted) for r in found}
    assert by[0] == ("en", True) and by[None] == ("de", True) and by[13] == ("fr", True)
    assert by[10] == by[11] == by[12] == (None, False)
    assert L.identify(docs(spark, []), {}).count() == 0
    assert [r.hd_accepted for r in L.identify(docs(spark, [(1, "words here")]), {}).collect()] == [False]
