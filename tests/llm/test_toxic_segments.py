import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from cachescope.llm import toxic_segments as ts

from .helpers import EDGES, edges, empty, frame, words


def brute_segments(x):
    """Maximal segments by their definition: the best one, then the same on both sides."""
    best, at = 0.0, None
    for i in range(len(x)):
        total = 0.0
        for j in range(i, len(x)):
            total += x[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    left = brute_segments(x[:i])
    right = [(a + j, b + j, s) for a, b, s in brute_segments(x[j:])]
    return left + [(i, j, best)] + right


def test_segments_equal_the_definition():
    rnd = random.Random(1)
    for _ in range(400):
        x = [rnd.choice([-3.1, -1.7, -0.6, 0.9, 2.3, 4.2]) + rnd.random() * 1e-3 for _ in range(rnd.randrange(14))]
        got = ts.segments(np.array(x))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(x)]


def brute_passages(w, x):
    """The best segment in which a positive word counts once, then the same on both sides."""
    best, at = 1e-12, None
    for i in range(len(x)):
        total, seen = 0.0, set()
        for j in range(i, len(x)):
            total += -ts.DRIFT if w[j] in seen else x[j]
            if x[j] > 0:
                seen.add(w[j])
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    right = [(a + j, b + j) for a, b in brute_passages(w[j:], x[j:])]
    return brute_passages(w[:i], x[:i]) + [at] + right


def test_passages_equal_the_definition():
    rnd = random.Random(3)
    for _ in range(1500):
        known = {f"w{k}": rnd.choice([-1.7, -0.6, -0.2, 0.9, 2.3, 4.2]) + rnd.random() * 1e-3 for k in range(7)}
        w = [rnd.choice(sorted(known)) for _ in range(rnd.randrange(25))]
        x = [known[k] for k in w]
        assert [(a, b) for a, b, _ in ts.passages(w, np.array(x))] == brute_passages(w, x)


def test_words_are_not_used_up_by_earlier_ones():
    score = lambda w: {"a": 3.0, "b": 3.1, "c": 2.9}.get(w, -0.4)
    rest = ["x"] * 40
    text = ["a"] + rest + ["b"] + rest + ["c"] + rest + ["a", "b", "c"] + rest + ["c", "a", "b"] + rest
    got = ts.passages(text, np.array([score(w) for w in text]))
    assert [round(s, 6) for *_, s in got] == [3.0, 3.1, 2.9, 9.0, 9.0]
    assert max(s for *_, s in ts.passages(["a"] * 50, np.full(50, 3.0))) == 3.0  # repetition adds nothing


def test_rate_solves_its_equation():
    hist = {-10: 900, 40: 30, 60: 2}
    lam = ts._rate_of(hist)
    p = {k: n / 932 for k, n in hist.items()}
    assert abs(sum(v * math.exp(lam * k * 0.05) for k, v in p.items()) - 1) < 1e-6


def corpus(n=900):
    bad = ["vilestuff", "grobmist", "hatespew", "nastyjunk"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        w = words(i, 60, 900)
        if toxic:
            for k in range(3):
                w.insert(10 + k, bad[(i + k) % 4] + random.Random(i + k).choice(["", "en", "er", "ung", "ation"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_passages(spark):
    rows, labels = corpus()
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = ts.score(docs, ts.fit(docs, lab)).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) / len(held) > 0.97
    assert all((r.predicted == 1) == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    spots = [r for r in held if r.predicted and r.passages]
    assert spots
    for r in spots:
        cut = " ".join(r.text[p.start:p.end] for p in r.passages)
        assert any(w in cut for w in ("vilestuff", "grobmist", "hatespew", "nastyjunk"))


def test_held_out_labels_are_never_read(spark):
    rows, labels = corpus(300)
    docs = frame(spark, rows)
    flip = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    scores = []
    for lab in (labels, flip):
        model = ts.fit(docs, spark.createDataFrame(lab, "doc_id long, quality int, toxic int"))
        scores.append(sorted((r.doc_id, r.score) for r in ts.score(docs, model).collect()))
    assert scores[0] == scores[1]


def test_edges(spark):
    rows, labels = corpus(300)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = ts.fit(frame(spark, rows), lab)
    got = ts.score(edges(spark).withColumn("score", F.lit("mine")), model).collect()
    assert len(got) == len(EDGES) and all(r.predicted == 0 for r in got if not (r.text or "").strip())
    assert ts.score(empty(spark), model).collect() == []
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in ts.score(edges(spark), ts.fit(edges(spark), none)).collect()} == {0.0}
    docs = frame(spark, rows).withColumn("_own", F.lit(1)).withColumn("evidence", F.lit("mine"))
    left = ts.without_toxic(docs, lab)
    assert left.columns == docs.columns and 0 < left.count() < docs.count()


def test_without_a_calibration_fold_the_learning_folds_calibrate(spark):
    import zlib

    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)]
    docs = spark.createDataFrame([(i, " ".join(words(i, 30, 200)) + (" vile slur here" if i % 2 else " calm river stone")) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    got = ts.score(docs, ts.fit(docs, labels)).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got) > 0.95 * len(got)
    assert min(r.score for r in got if r.doc_id % 2) > max(r.score for r in got if r.doc_id % 2 == 0)
