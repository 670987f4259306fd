"""Small tables with every awkward row, and words as the contracts cut them."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def prose(seed, n):
    import random

    r = random.Random(seed)
    stems = ["ba", "ko", "ri", "ten", "sul", "mo", "fa", "lin", "der", "pot", "qua", "vex"]
    return " ".join("".join(r.choice(stems) for _ in range(r.randint(1, 3))) for _ in range(n))


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    a, b = prose(1, 120), prose(2, 90)
    near = a.split()
    near[60] = "CHANGED"
    rows = [
        (1, a, "en", "s1", 5), (2, a, "en", "s1", 5), (2, a, "en", "s1", 5), (3, " ".join(near), None, None, None), (4, b, "en", "s2", 1), (5, None, "en", "s2", 0),
        (6, "", "en", "", 0), (7, " \n\t ", None, "s1", 3), (None, a, "en", None, 5), (None, None, None, None, None), (8, "one two", "en", "s3", 7), (9, "one two", "en", "s3", 7),
        (10, prose(3, 20_000), "en", "s1", 9), (11, b + " " + a, "en", "s2", 1), (12, "é ü\x85x \x1c y", "fr", "s2", 1), (4, prose(5, 60), "en", "s2", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def wide(docs):
    """The same rows with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    for c in ("id", "size", "n", "k", "score", "base", "h", "label", "set_id", "b1", "root", "target", "set_", "keep_doc_", "score_", "bad_id", "bad_text", "added", "tokens", "uid", "fp", "starts"):
        docs = docs.withColumn(c, F.lit("x"))
    return docs
