import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cachescope.llm import phrases as ph
from cachescope.llm.common import FILTER_BITS

from .helpers import EDGES, empty

SCHEMA = "doc_id long, text string, lang string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(parts)


def brute(rows, min_count=30, top=2000):
    """By definition, one phrase at a time."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) >= 2 and a >= min_count}
        best = []
        for p, a in cand.items():
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            inside = any(100 * b >= 80 * a for q, b in cand.items() if len(q) > len(p)
                         and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not inside:
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


def corpus(seed, docs, vocabulary, length):
    rnd = random.Random(seed)
    marks = ["", "", "", "", ",", ".", "\n", ";\t", "  ", "!", "\x0b", "\x1c", " "]
    words = [rnd.choice(["w", "W", "É", "ü", "x "]) + str(k) for k in range(vocabulary)]
    fixed = [" ".join(rnd.choices(words, k=rnd.randint(2, 5))) for _ in range(12)]
    out = []
    for _ in range(docs):
        parts = []
        for _ in range(rnd.randint(0, length)):
            parts.append((rnd.choice(fixed) if rnd.random() < 0.2 else words[int(rnd.random() ** 3 * vocabulary)]) + rnd.choice(marks))
        out.append((" ".join(parts), rnd.choice(["en", "de", "de", None, "und"])))
    return out


@pytest.mark.parametrize("seed,top,run_bytes", [(1, 2000, 1 << 24), (2, 7, 500), (3, 2000, 3000)])
def test_equals_brute_force(spark, seed, top, run_bytes):
    rows = corpus(seed, 260, 60, 60) + [(t, None) for _, t in EDGES]
    df = frame(spark, rows).withColumn("n", F.lit("x")).withColumn("phrase", F.lit(0)).withColumn("k", F.lit(1))
    got = ph.collocations(df, top=top, run_bytes=run_bytes)
    assert sorted(map(tuple, got.collect())) == brute(rows, top=top)


@pytest.mark.parametrize("proposed,few,scans", [("nothing", 0, 4), ("words", 0, 3), ("everything", 0, 1),
                                                ("nothing", 99, 2), ("words", 99, 2)])
def test_closed_whatever_the_sample_proposes(spark, proposed, few, scans):
    rows = corpus(5, 200, 40, 50)
    texts = ph._texts(frame(spark, rows), "text", "lang")
    nothing = np.zeros(ph.filter_of(texts.where("false").select(F.lit(1).cast("long").alias("a")), "a").shape, "u4")
    have = {"nothing": nothing, "everything": ~nothing,
            "words": ph.filter_of(ph.counts(texts, range(1, 2), 1), "a")}[proposed]
    log = []
    got = ph.spelt(texts, ph.frequent(texts, have, passes_log=log, few=few))
    assert log[-1] == 0 and len(log) == scans
    f = Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            f[lang or "und", 0, ""] += len(w)
            f.update((lang or "und", k, " ".join(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    want = {p: n for p, n in f.items() if n >= 30 or p[1] == 0}
    rows = got.collect()
    assert {(r.lang, r.k, bytes(r.phrase).decode()): r.n for r in rows} == want and len(rows) == len(want)


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**18
    found = spark.createDataFrame([("en", 1, b"a", big), ("en", 1, b"b", big), ("en", 2, b"a b", big - 7)],
                                  "lang string, k int, phrase binary, n long")
    r = ph.scored(found).first()
    assert r.score == 2_000_000 * (big - 7) // (2 * big) and ph.absorbed(found).collect() == []


def test_parts_are_cut_between_pieces():
    text = b"aa bb\ncc dd\n" * 50 + b"x" * 100 + b"\n" + b"y " * 60
    for limit in (1, 10, 64, 10_000):
        assert b"\n".join(ph._parts(text, limit)) == text


def test_empty(spark):
    assert ph.collocations(empty(spark)).collect() == []
    assert ph.collocations(frame(spark, [(None, None), ("", "en"), (" .. ", "en")])).collect() == []


def test_ties_and_repeated_rows(spark):
    rows = [("b a. A b, c d", "en")] * 30 + [("c d", "en")] * 5
    got = [tuple(r) for r in ph.collocations(frame(spark, rows)).collect()]
    assert sorted(got) == brute(rows) and [r[2] for r in sorted(got)] == ["c d", "a b", "b a"]


def test_distinct_where_first_hashes_collide():
    a, b = np.array([5, 5, 7, 5, 7], dtype="u8"), np.array([1, 2, 3, 1, 3], dtype="u8")
    place, count = ph._distinct(a, b)
    assert sorted(zip(a[place].tolist(), b[place].tolist(), count.tolist())) == [(5, 1, 2), (5, 2, 1), (7, 3, 2)]


def test_blocks_carry_every_count():
    rnd = np.random.default_rng(5)
    a = rnd.integers(-2**63, 2**63 - 1, 4000)
    a[:50] = a[50:100]  # equal first hashes, other second ones
    b = rnd.integers(-2**31, 2**31 - 1, 4000).astype("i4")
    n = rnd.integers(1, 9, 4000)
    n[7] = 2**33
    for ranges in (1, 13, 1 << 14):
        block = ph._blocks([(a[:1500], b[:1500], n[:1500]), (a[1500:], b[1500:], n[1500:]), (a, b, n)], ranges)
        parts = block.column(0).to_pylist()
        assert parts == sorted(set(parts)) and 0 <= parts[0] and parts[-1] < ranges
        got = [r for out in ph._adder(6)(iter([block.slice(0, 1), block.slice(1)])) for r in zip(*(c.to_pylist() for c in out.columns))]
        assert sorted(got) == sorted((x, y, 2 * z) for x, y, z in zip(a.tolist(), b.tolist(), n.tolist()) if 2 * z >= 6)


def test_blocks_without_counts():
    none = np.empty(0, "i8")
    assert ph._blocks([(none, none.astype("i4"), none)], 4).num_rows == 0
    assert list(ph._adder(1)(iter([]))) == []


def spelling(texts, found, due):
    """Rows that the scan spells out, beside the counts of all words."""
    sc = texts.sparkSession.sparkContext
    filters = [sc.broadcast(ph.filter_of(x, "a")) for x in (found, found.select(due.alias("a")))]
    scan = ph._scanner(range(1, 5), filters[0], None, 2000, spell=True, due=filters[1])
    return texts.mapInArrow(scan, ph._NAMES).where("k > 0").count()


@pytest.mark.parametrize("parts", [2, 16])
def test_a_phrase_is_spelt_once_however_many_tasks_there_are(spark, parts):
    texts = ph._texts(frame(spark, corpus(9, 400, 40, 60), parts), "text", "lang")
    nothing = np.zeros(FILTER_BITS // 32, "u4")
    found = ph.written(ph.frequent(texts, ~nothing, run_bytes=2000), "found")
    n = found.count()
    assert n > 100 and n <= spelling(texts, found, ph._due()) < 1.02 * n


def test_phrases_are_spelt_whatever_the_order_of_the_texts(spark):
    rows = corpus(9, 400, 40, 60)
    texts = ph._texts(frame(spark, rows, 5), "text", "lang")
    found = ph.written(ph.frequent(texts, ~np.zeros(FILTER_BITS // 32, "u4"), run_bytes=2000), "found")
    as_counted = sorted(map(tuple, ph.spelt(texts, found, run_bytes=2000).collect()))
    again = ph._texts(frame(spark, rows[::-1], 3), "text", "lang")
    assert sorted(map(tuple, ph.spelt(again, found, run_bytes=2000).collect())) == as_counted
    assert len(as_counted) == found.count() + 3  # and all words of three languages
