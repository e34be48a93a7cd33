import os

import pytest
from pyspark.sql import functions as F

from cachescope.operators import embed as emb
from cachescope.streaming import tables


def by_length(texts, task):
    """A vector of two numbers; none for 'bad', one of another length for 'short'."""
    return [None if t == "bad" else [1.0] if t == "short" else [float(len(t)), float(len(task))] for t in texts]


def never(texts, task):
    raise AssertionError(f"embedded again: {texts}")


def stored(spark, path, before=None):
    return sorted((r.text_key, r.task_type, tuple(r.embedding)) for r in tables.read(spark, path, emb.STORED, before).collect())


ROWS = [(1, "a"), (2, " a "), (3, "  "), (4, None), (5, "bb"), (6, "bad"), (7, "short"), (8, "")]


def test_only_new_texts_are_embedded(spark, scratch):
    path = os.path.join(scratch, "vectors")
    df = spark.createDataFrame(ROWS, "id long, text string").repartition(3)
    emb.embed_new(df, path, 0, by_length, dim=2)
    first = stored(spark, path)
    assert len(first) == 2 and {v for *_, v in first} == {(1.0, 19.0), (2.0, 19.0)}
    # the second run embeds nothing, and of the failed ones it tries again
    emb.embed_new(df.where("text not in ('bad', 'short') or text is null"), path, 1, never, dim=2)
    emb.embed_new(df, path, 2, lambda ts, task: [never(ts, task) if t in ("a", "bb") else [3.0, 3.0] for t in ts], dim=2)
    assert len(stored(spark, path)) == 4 and stored(spark, path, before=2) == first
    got = {r.id: r.embedding for r in emb.with_stored(df.withColumn("embedding", F.lit(0)), path).collect()}
    assert got == {1: [1.0, 19.0], 2: [1.0, 19.0], 3: None, 4: None, 5: [2.0, 19.0], 6: [3.0, 3.0], 7: [3.0, 3.0], 8: None}


def test_a_task_of_its_own_and_a_retried_batch(spark, scratch):
    path = os.path.join(scratch, "vectors")
    df = spark.createDataFrame([("x", "Q"), ("x", "DOC"), ("y", None), ("x", "Q")], "text string, kind string")
    emb.embed_new(df, path, 0, by_length, task_type=F.col("kind"))
    rows = stored(spark, path)
    assert {(t, v) for _, t, v in rows} == {("Q", (1.0, 1.0)), ("DOC", (1.0, 3.0)), (emb.TASK_TYPE, (1.0, 19.0))}
    emb.embed_new(df, path, 0, by_length, task_type=F.col("kind"))
    assert stored(spark, path) == rows
    with pytest.raises(Exception, match="embedded again"):
        emb.embed_new(df, path, 1, never, task_type="other")
    assert emb.with_stored(df, path, task_type=F.col("kind")).where("embedding is null").count() == 0


def test_empty_table(spark, scratch):
    path = os.path.join(scratch, "vectors")
    none = spark.createDataFrame([], "text string")
    emb.embed_new(none, path, 0, never)
    assert stored(spark, path) == [] and emb.with_stored(none, path).collect() == []
