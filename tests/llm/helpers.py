"""Frames for the tests of this folder."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, parts=3):
    """A documents table, with extra columns whose names clash with those that operators make."""
    out = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    for name in ("ids", "part", "base", "n", "key", "anchor", "fingerprint", "start", "score", "block"):
        out = out.selectExpr("*", f"'x' AS {name}")
    return out.repartition(parts)


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))
