"""Small tables with the awkward rows every operator must take."""

import random

from pyspark.sql import types as T

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
_WORDS = "alder birch cedar delta ember fjord grove heath inlet jetty knoll lagoon marsh nadir ocean".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(f"{draw.choice(_WORDS)}{draw.randrange(400)}" for _ in range(n))


def documents(spark, rows, extra=()):
    """Rows are texts, or tuples of the columns; ids count from 0. ``extra``: names of further columns."""
    full = []
    for i, row in enumerate(rows):
        row = row if isinstance(row, tuple) else (i, row, "en", f"s{i % 3}", None)
        full.append((*row, *["x"] * len(extra)))
    schema = T.StructType([*T._parse_datatype_string(DOCUMENT).fields, *[T.StructField(n, T.StringType()) for n in extra]])
    return spark.createDataFrame(full, schema)


#: Names that operators use inside.
CLASHING = ("_text", "_key", "_may", "_row", "_id", "_size", "hash", "body", "kept", "words", "epoch", "score", "set_id", "group", "token", "host")


def awkward(spark):
    """Nulls, empties, a long text, ties, repeated rows and extra columns with clashing names."""
    long = prose(1, 9000)
    rows = [
        (None, None, None, None, None),
        (1, "", "en", None, 0),
        (2, "", None, "s1", 0),
        (3, "one", "en", "s1", 3),
        (3, "one", "en", "s1", 3),
        (4, " \t\n ", "en", "", 4),
        (5, long, "en", "s2", 1),
        (6, long.upper(), "en", "s2", 1),
        (7, long + " tail", "en", "s2", 1),
        (8, prose(2, 40), "de", "s1", 1),
        (9, prose(2, 40), "de", "s1", 1),
        (None, prose(3, 40), "de", "s1", 1),
        (10, "É\u0000 ß\u2003x \U0001f600", "fr", "s3", 1),
    ]
    return documents(spark, rows, CLASHING)


def empty(spark):
    return documents(spark, [])
