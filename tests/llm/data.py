"""Hand-made tables for the edge cases that every operator must take."""

import random

SF0001 = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and
    extra columns whose names clash with those of the operators."""
    rnd = random.Random(3)
    words = ["the", "and", "was", "idiot", "river", "stone", "said", "licence", "über", "été"]
    long_text = " ".join(rnd.choice(words) for _ in range(30_000))
    plain = "a plain text about rivers and stones that nobody would mind reading twice today"
    rows = [
        (1, plain, "en", "s", 5), (1, plain, "en", "s", 5), (2, plain, "en", "t", 5),
        (None, plain, None, None, None), (3, None, "en", "s", None), (4, "", None, "s", 0),
        (5, " \n\t ", "en", None, 3), (6, "12345 !!", "de", "s", 8), (7, long_text, "en", "s", 1),
        (8, "x", "fr", "s", 1), (9, "x", "fr", "s", 1), (None, None, None, None, None),
        (10, "été " * 60, "fr", "s", 1), (11, "\u0000 a b \U0001f600", "en", "s", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = ["ids", "decoded", "license", "score", "lang_pred", "language", "features", "measures",
             "kept", "base_failed", "row", "stratum", "shard", "slot", "size", "item", "digest",
             "class_id", "node", "label", "key", "block", "sig", "words", "same_digest"]
    return df.selectExpr("*", *[f"'mine' AS {c}" for c in clash])


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
