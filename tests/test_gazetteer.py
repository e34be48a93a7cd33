import random

import pytest
import regex
from pyspark.sql import functions as F

from cachescope.operators import gazetteer as gz
from cachescope.operators import pii


def brute(text, names):
    """From left to right: the longest name that begins at a word, then on behind it."""
    words = [(m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{M}\p{N}_]+", text)]
    out, i = [], 0
    while i < len(words):
        best, run = None, text[slice(*words[i])]
        for k in range(i, len(words)):
            if k > i:
                if not text[words[k - 1][1]:words[k][0]].isspace():
                    break
                run += " " + text[slice(*words[k])]
            if run in names:
                best = (k, words[i][0], words[k][1], run)
        if best:
            out.append(best[1:])
        i = best[0] + 1 if best else i + 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(gz, "OUT_ROWS", 7)
    rnd = random.Random(seed)
    vocabulary = ["Ana", "Bo", "Çe", "de", "la", "Ré", "O", "x_1", "e\u0301", "😀"]
    names = {" ".join(rnd.choices(vocabulary[:9], k=rnd.randint(1, 4))) for _ in range(14)}
    rows = [(i, "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", "  ", "\n", ", ", "\u00a0", "-"]) for _ in range(rnd.randrange(40))))
            for i in range(60)] + [(None, "Ana"), (90, None), (91, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    listed = [(n.replace(" ", rnd.choice([" ", ", "])),) for n in names] * 2 + [(None,), ("",), (" . ",)]
    got = gz.person_spans(df, spark.createDataFrame(listed, "name string")).collect()
    want = [(i, *s) for i, t in rows for s in brute(t or "", names)]
    assert sorted(((r.doc_id is None, r.doc_id, r.start, r.end, r.value) for r in got), key=repr) == \
        sorted(((i is None, i, s, e, v) for i, s, e, v in want), key=repr) and want
    assert {(r.entity, r.score) for r in got} == {("PERSON", gz.SCORE)}


def test_empty_list_and_table(spark):
    df = spark.createDataFrame([(1, "Ana Bo")], "doc_id long, text string")
    none = spark.createDataFrame([], "name string")
    assert gz.person_spans(df, none).collect() == []
    assert gz.person_spans(df.where("false"), spark.createDataFrame([("Ana",)], "name string")).collect() == []


def test_spans_of_a_recogniser(spark):
    def people(texts):
        return [[(m.start(), m.end(), "PERSON", 0.85) for m in regex.finditer(r"\b[A-Z][a-z]+( [A-Z][a-z]+)?", t, overlapped=True)] for t in texts]

    text = "Ann Lee <ann@Mail.example> met Bob 10.0.0.1"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Éva Ann")], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end, r.entity, r.score, r.value) for r in pii.spans(df, recogniser=people).collect())
    assert got == [(1, 0, 7, "PERSON", 0.85, "Ann Lee"), (1, 9, 25, "EMAIL_ADDRESS", 0.9, "ann@Mail.example"),
                   (1, 31, 34, "PERSON", 0.85, "Bob"), (1, 35, 43, "IP_ADDRESS", 0.6, "10.0.0.1"), (4, 4, 7, "PERSON", 0.85, "Ann")]
    assert pii.spans(df.withColumn("text", F.lit(None).cast("string")), recogniser=people).collect() == []
    with pytest.raises(Exception, match="argument 2 is shorter"):
        pii.spans(df, recogniser=lambda texts: []).collect()
