"""Small document tables for the operator tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, parts=3):
    """A documents table from (doc_id, text[, source]) rows."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else f"s{(r[0] or 0) % 3}",
             None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def words(seed, n, vocabulary=4000):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


#: Nulls, empty, blank and very long texts, repeated rows, a null id, ids without order.
EDGES = [(7, None), (2, ""), (2, ""), (None, "lost words here"), (9, "  \n\t\n"), (5, "one"), (5, "one"),
         (5, "another text under one id"), (3, " ".join(words(1, 30_000))), (11, None), (1, "a\r\nb\n\nc")]


def edges(spark):
    return frame(spark, EDGES)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
