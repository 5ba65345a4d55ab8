"""Small document tables for the tests."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have them as columns of its own.
CLASHES = ("node", "key", "sig", "uid", "row", "th", "hash", "members", "size", "taken", "runs", "shard", "label", "score", "kept", "component", "band", "a", "b", "n", "start", "ids", "v", "q", "with space")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], DOCS)


def sentences(seed, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))


def messy(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and clashing extra columns."""
    long_text = sentences(1, 30_000)
    rows = [(1, "one two three four five six. Seven\neight", "en", "s1"), (2, None, "en", "s1"), (3, "", None, "s2"), (4, " \n\t ", "fr", None), (5, "12 34 !!", "en", "s2"), (None, "text without an id, but words", None, None), (6, long_text, "fr", "s1"), (7, "one two three four five six. Seven\neight", "en", "s1"), (7, "one two three four five six. Seven\neight", "en", "s1"), (8, "the same id", "de", "s3"), (8, "and another text", "de", "s3")]
    return docs(spark, rows).withColumns({c: F.lit("x") for c in CLASHES})


def empty(spark):
    return docs(spark, [])
