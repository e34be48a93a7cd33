import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cachescope.llm import mixing

from .helpers import EDGES, empty, frame


def targets(sizes, weights=(1, 2, 3), epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, got = float(sum(sizes.values())), dict.fromkeys(names, 0.0)
    open_ = {s for s in names if sizes[s]}
    while open_ and left > 1e-9:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        left = 0.0
        for s in sorted(open_, key=str):
            take = min(share[s], epochs * sizes[s] - got[s])
            got[s] += take
            left += share[s] - take
        open_ = {s for s in open_ if got[s] < epochs * sizes[s] - 1e-9}
    return got


def test_targets_budgets_and_order(spark):
    rows = [(i, "word " * (1 + i * 7 % 50), "big") for i in range(300)]
    rows += [(1000 + i, "a b c", ["tiny", "Tiny", "été", None][i % 4]) for i in range(12)] + [(2000, None, "blank")]
    got = mixing.mix(frame(spark, rows).withColumn("taken", F.lit("mine"))).collect()
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(re.findall(r"\S+", t or ""))
    want = targets(sizes)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
    for s, docs in by.items():
        assert sum(r.taken for r in docs) == math.floor(docs[0].target + 1e-9)
        # in the order of the key, whole rounds first: the taken amounts never rise
        docs.sort(key=lambda r: hashlib.md5(f"{r.doc_id}|{r.text or ''}".encode()).hexdigest())
        rounds = [r.taken / r.size for r in docs if r.size]
        assert rounds == sorted(rounds, reverse=True)


def test_reruns_and_layouts_agree(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 4}") for i in range(200)]
    a, b = mixing.mix(frame(spark, rows, 1)), mixing.mix(frame(spark, rows[::-1], 5))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_mixture_repeats_and_cuts(spark):
    rows = [(i, f" d{i} a\tb\n c{i}  ", "big") for i in range(60)] + [(100 + i, "x y z", "small") for i in range(3)]
    docs = frame(spark, rows).withColumn("size", F.lit("own"))
    plan = {r.doc_id: r for r in mixing.mix(docs.drop("size")).collect()}
    out = mixing.mixture(docs)
    assert out.columns == docs.columns and {r["size"] for r in out.collect()} == {"own"}
    taken = defaultdict(int)
    for r in out.collect():
        taken[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert dict(taken) == {k: r.taken for k, r in plan.items() if r.taken}


def test_edges(spark):
    got = mixing.mix(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and all(r.taken == 0 for r in got if not r["size"])
    assert mixing.mix(empty(spark)).collect() == []
    assert {r.target for r in mixing.mix(frame(spark, [(1, None, "a"), (2, " ", None)])).collect()} == {0.0}
