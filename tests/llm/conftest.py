import random

import pytest

#: Names that operators use for themselves, or used to.
CLASHING = (
    "digest", "size", "h", "key", "block", "group", "rep", "set_id", "taken", "score", "scores", "salt", "copies", "copy", "s", "times", "threshold", "id", "text_digest", "kept", "row", "cls", "node", "root",
    "__id", "__digest", "__scores", "__copies", "__copy", "__size", "__times", "__key", "Digest_", "a.b",
)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=False):
    """documents of (doc_id, text, lang, source); extra adds columns with names that operators use for themselves."""
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], COLUMNS)
    if extra:
        from pyspark.sql import functions as F

        for name in CLASHING:
            df = df.withColumn(name, F.lit("x"))
    return df


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()) + str(draw.randrange(30)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies, near copies and shared passages."""
    base, passage = prose(1, 120), prose(2, 40)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    far = " ".join(w if k % 9 else "other" for k, w in enumerate(words))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (4, far, "en", None), (5, base.upper(), None, "b"), (6, None, "en", "a"), (7, "", None, None), (8, " \t\n", "fr", "c"),
        (9, "kurz", "de", "c"), (10, "kurz", "de", "c"), (10, "kurz", "de", "c"), (None, base, "en", "a"), (None, "ohne Nummer", None, "d"), (12, prose(3, 30) + " " + passage + " " + prose(4, 30), "en", "a"),
        (13, passage + " " + prose(5, 50), "en", "a"), (14, "é" * 70 + passage, "fr", "a"), (15, prose(6, 9000), "en", "a"), (16, "x" * 200_000, "en", "a"), (17, "<|startoftext|> It's 12 A.B. \x1c y　z", "en", "b"), (18, near + " end", "en", "b"),
    ]
    return rows
