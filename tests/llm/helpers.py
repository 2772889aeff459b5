"""Small inputs with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def words(n, seed=0, least=3, most=9):
    dice = random.Random(seed)
    return ["".join(dice.choices("abcdefghijklmnop", k=dice.randint(least, most))) for _ in range(n)]


def docs(spark, *texts, extra=()):
    """Documents 0, 1, … of three sources; ``extra`` rows are taken as they are."""
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + list(extra), DOCS)


def awkward(spark):
    """Nulls in every column, empty and very long texts, equal and repeated rows."""
    long = " ".join(words(30_000, 5))
    rows = [(7, "same text of two rows here", "en", "a", 5)] * 2 + [(None, None, None, None, None)] * 2
    texts = ["", None, " \n\t ", long, long + " x", "one", "same text of two rows here", "Same TEXT of two rows here"]
    return docs(spark, *texts, extra=rows)
