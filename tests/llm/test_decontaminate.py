import random

import numpy as np
from pyspark.sql import functions as F

from cachescope.llm import decontaminate as dc

from .helpers import EDGES, empty, frame, words


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = dc.MATCH if a[i - 1] == b[j - 1] else dc.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + dc.GAP, h[i, j - 1] + dc.GAP)
    return h.max()


def test_alignment_equals_the_recurrence():
    rnd = random.Random(2)
    for _ in range(200):
        item = np.array([rnd.randrange(1, 6) for _ in range(rnd.randrange(1, 12))], dtype="i4")
        parts = [np.array([rnd.randrange(0, 6) for _ in range(rnd.randrange(1, 20))], dtype="i4") for _ in range(4)]
        best, _ = dc.align(item, dc._padded(parts))
        assert best.tolist() == [smith_waterman(item.tolist(), p.tolist()) for p in parts]


def items(spark, n=30):
    rows = [(i, " ".join(words(5000 + i, 30)).capitalize() + ".") for i in range(n)] + [(900, None), (901, "too short"), (None, " ".join(words(70077, 25)))]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def edited(text, every):
    w = text.split()
    return " ".join("changed" if k % every == every - 1 else x for k, x in enumerate(w))


def test_finds_exact_and_edited_copies_and_no_others(spark):
    rows, bench = items(spark)
    clean = [(i, " ".join(words(i, 200, 3000))) for i in range(80)]
    leaks = [(1000 + i, " ".join(words(i, 50)) + " " + rows[i][1].upper() + "\n" + " ".join(words(i + 50, 50))) for i in range(10)]
    leaks += [(1100 + i, " ".join(words(i, 40)) + "\n" + edited(rows[i][1], 6) + " tail") for i in range(10)]
    # one item in very many documents
    leaks += [(2000 + i, f"d{i} " + rows[20][1] + " " + " ".join(words(i + 99, 20))) for i in range(60)]
    got = dc.contaminated(frame(spark, clean + leaks).withColumn("item_id", F.lit("mine")), bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    want = {(1000 + i, i) for i in range(10)} | {(1100 + i, i) for i in range(10)} | {(2000 + i, 20) for i in range(60)}
    assert found == want
    for r in got:
        if r.doc_id < 1100:
            assert r.similarity == 1.0 and (r.start_word, r.end_word) == (50, 80)


def test_frequency_drops_no_pair(spark):
    everywhere, short, thirds = words(61, 16, 10**6), words(62, 8, 10**6), words(63, 16, 10**6)
    rows = [(0, " ".join(everywhere)), (1, " ".join(short)), (1, " ".join(short)), (1, " ".join(short)), (2, " ".join(thirds))]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    docs = []
    for i in range(300):
        t = words(i, 20) + everywhere + words(i + 400, 20)
        if i % 3 == 0:
            t += short + words(i + 800, 20) + edited(" ".join(thirds), 6).split()
        docs.append((i, " ".join(t)))
    docs.append((300, " ".join(words(300, 20) + everywhere[:9])))  # an edited copy with the seeds of the hot ones
    got = dc.contaminated(frame(spark, docs), bench).collect()
    assert {r.doc_id for r in got if r.item_id == 0} == set(range(301))
    for item in (1, 2):
        assert {r.doc_id for r in got if r.item_id == item} == set(range(0, 300, 3))
    worth = {round(r.evidence / r.n_seeds, 6) for r in got if r.item_id == 1}
    assert worth == {round(float(np.log(301 / 100)), 6)}  # documents, however often the item is listed


def test_long_passages_of_longer_items(spark):
    long, longer = words(71, 59, 10**6), words(72, 500, 10**6)
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(longer))], "item_id long, text string")
    texts = [long[20:48], longer[100:300], edited(" ".join(longer[:60]), 6).split(), longer[480:493], longer[480:492]]
    docs = frame(spark, [(i, " ".join(words(i, 30) + t + words(i + 9, 30))) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in dc.contaminated(docs, bench).collect()}
    assert {i: r.item_id for i, r in got.items()} == {0: 1, 1: 2, 2: 2, 3: 2}  # twelve words are below the score
    assert (got[0].start_word, got[0].end_word) == (30, 58) and got[1].similarity == 0.4
    assert {r.doc_id for r in dc.without_contaminated(docs, bench).collect()} == {4}


def test_blocks_give_the_same_result(spark):
    rows, bench = items(spark)
    docs = frame(spark, [(i, "a b c d " + t) for i, t in rows if t])
    one = dc.contaminated(docs, bench).select("doc_id", "item_id", "similarity").collect()
    many = dc.contaminated(docs, bench, block_seeds=60).select("doc_id", "item_id", "similarity").collect()
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, many), key=repr) and len(one) == 31


def test_texts_of_many_hits_are_worked_off_in_parts(monkeypatch):
    item = words(1, 40)
    block = dc.make_block([(k, item[k:k + 12]) for k in range(20)])
    text = words(2, 30) + item * 6 + words(3, 30)
    whole = {i for i, *_ in dc.stretches(text, block)}
    monkeypatch.setattr(dc, "HITS", 7)
    parts = list(dc.stretches(text, block))
    assert {i for i, *_ in parts} == whole == set(range(20))
    for i, _, ids, _ in parts:
        assert dc.align(block.items[i], dc._padded([ids]))[0][0] > 0


def test_edges(spark):
    rows, bench = items(spark)
    docs = frame(spark, EDGES + [(None, rows[3][1]), (77, rows[3][1]), (77, rows[3][1]), (2**60 + 1, rows[4][1])])
    docs = docs.withColumn("similarity", F.lit("mine"))
    got = [r.doc_id for r in dc.contaminated(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([None, 77, 77, 2**60 + 1], key=str)
    left = dc.without_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(EDGES) - 1  # the null id goes with its leak
    assert dc.contaminated(empty(spark), bench).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(docs, none).collect() == [] and dc.without_contaminated(docs, none).count() == docs.count()


def test_items_of_few_words_are_found_word_for_word(spark):
    bench = spark.createDataFrame([(1, "aa bb cc"), (2, "Dd"), (3, "ee ff"), (4, " .. "), (5, None)], "item_id long, text string")
    docs = frame(spark, [(1, "xx aa, bb CC yy"), (2, "aa bb xx cc"), (3, "dd"), (4, "ee gg ff"), (5, "gg ee ff dd ee ff"), (6, ""), (7, None)])
    got = {(r.doc_id, r.item_id): (r.start_word, r.end_word, r.similarity) for r in dc.contaminated(docs, bench).collect()}
    assert got.keys() == {(1, 1), (3, 2), (5, 3), (5, 2)} and all(s == 1.0 for _, _, s in got.values())
    assert got[1, 1][:2] == (1, 4) and got[5, 2][:2] == (3, 4)
