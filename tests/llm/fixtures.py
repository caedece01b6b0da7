"""Small tables with the awkward cases: nulls, empty and long texts, copies, near copies, clashing columns."""

import random

SYLLABLES = ["ka", "lo", "mi", "ren", "to", "su", "vel", "da", "pri", "non"]


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def documents(seed=3, n=60):
    """(doc_id, text, lang, source, n_chars)."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        lines = [" ".join(words(rng, rng.randint(4, 30))) for _ in range(rng.randint(1, 5))]
        texts.append("\n".join(lines))
    base = texts[0]
    for _ in range(4):
        texts.append(base)
    for _ in range(6):
        w = base.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    passage = " ".join(words(rng, 30))
    texts += [f"{' '.join(words(rng, 8))} {passage} {' '.join(words(rng, 5))}" for _ in range(5)]
    texts += ["", None, "   \n\t ", "one", "one two three", "One TWO three", "\x0b\x0c", "é\u3000ß 🙂", "x" * 3000, "for " * 400, passage + "\n" + passage]
    texts.append(" ".join(words(rng, 4000)))
    return [(i, t, "en" if i % 2 else "fr", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def clashing(spark, rows=None):
    """The table with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["bucket", "chunk", "hash", "pos", "node", "component", "score", "predicted", "key", "sim", "line", "first", "spans", "kept", "z", "h", "t", "n", "gone", "n_lines", "own", "terms", "base", "ids", "_doc", "_gone", "row", "of", "n_removed", "hi", "lo", "copies", "form", "trusted", "gram"]
    return frame(spark, rows).select("*", *(F.lit("x").alias(n) for n in names))


def odd(spark):
    """Nulls in every column, repeated rows, repeated ids."""
    rows = documents()[:6]
    rows += [(None, "a text without an id that is long enough", "en", None, None), (3, None, None, None, None), rows[1], rows[1], (2, "another text of the same id with some words", "en", "s", 1)]
    return frame(spark, rows)
