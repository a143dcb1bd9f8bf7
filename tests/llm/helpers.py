import random

DOC = "doc_id long, text string, lang string, source string, n_chars long, hash string, key double, row_key string, extra array<int>"


def docs(spark, rows):
    """Documents from (doc_id, text[, lang[, source]]) with further columns whose names clash with inner ones."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1]), "h", 1.0, "r", [1]) for r in rows]
    return spark.createDataFrame(full, DOC)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(["ba", "de", "ki", "lo", "mu", "ra", "so", "ti", "ve", "zu"]) for _ in range(rng.randint(2, 4))) for _ in range(n)]


def edited(rng: random.Random, tokens: list[str], edits: int) -> list[str]:
    out = list(tokens)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = words(rng, 1)[0]
        elif kind == 1:
            out.insert(at, words(rng, 1)[0])
        elif len(out) > 1:
            out.pop(at)
    return out
