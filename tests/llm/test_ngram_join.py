import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cachescope.llm import ngram_join as nj

from .helpers import EDGES, edges, empty, frame, words


def near(text, seed, share):
    """The words of a text, some of them replaced."""
    rnd = random.Random(seed)
    return " ".join(f"x{seed}q{k}" if rnd.random() < share else w for k, w in enumerate(text.split()))


def corpus():
    rows = [(i, " ".join(words(i, 120))) for i in range(60)]
    for base in range(12):
        rows += [(100 + base * 40 + k, near(rows[base][1], base * 40 + k, [0.0, 0.005, 0.02, 0.05][k % 4])) for k in range(14)]
    rows += [(2000 + k, near(rows[20][1], 9000 + k, 0.008)) for k in range(90)]
    return rows + EDGES + [(3000, "one two three"), (3001, "ONE  two three"), (3002, "one two"), (3003, "one two three")]


def brute(rows):
    """(text class, links, group) by text, over all pairs."""
    sets, first = {}, {}
    for i, t in rows:
        t = t or ""
        w = t.lower().split()
        sets[t] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        known = [x for x in (first.get(t), i) if x is not None]
        first[t] = min(known) if known else None
    texts = list(sets)
    links, root = defaultdict(int), {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, t in enumerate(texts):
        for u in texts[a + 1:]:
            both = len(sets[t] & sets[u])
            if both and both >= 0.8 * len(sets[t] | sets[u]):
                links[t] += 1
                links[u] += 1
                root[find(u)] = find(t)
    group = defaultdict(list)
    for t in texts:
        group[find(t)].append(first[t])
    lead = {t: min((x for x in group[find(t)] if x is not None), default=None) for t in texts}
    brute.groups = len(group)
    return {t: (first[t], links[t], lead[t]) for t in texts}


@pytest.mark.parametrize("block", [256, 16])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK", block)  # small blocks: one group over many pairs of blocks
    rows = corpus()
    want, copies = brute(rows), Counter(t or "" for _, t in rows)
    docs = frame(spark, rows)
    got = nj.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append((r.n_copies, r.text_class, r.n_links, r.class_id))
    expect = defaultdict(list)
    for i, t in rows:
        expect[i].append((copies[t or ""], *want[t or ""]))
    for i in expect:
        assert sorted(by_id[i], key=repr) == sorted(expect[i], key=repr)


def test_one_document_of_each_group_stays(spark):
    rows = corpus()
    docs = frame(spark, rows).withColumn("class_id", F.lit("mine"))
    kept = nj.one_per_group(docs)
    assert kept.columns == docs.columns
    brute(rows)
    # texts that share an id are groups of their own
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == brute.groups


def test_edges(spark):
    got = nj.near_duplicates(edges(spark)).collect()
    assert len(got) == len(EDGES) and all(r.n_links == 0 for r in got)
    assert nj.near_duplicates(empty(spark)).collect() == [] and nj.one_per_group(empty(spark)).collect() == []


def test_minhash_estimates_the_similarity():
    hashes = nj.WordHashes()
    a, b = " ".join(words(1, 3000)), near(" ".join(words(1, 3000)), 2, 0.02)
    x, y = nj.shingles(a, hashes), nj.shingles(b, hashes)
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((nj.minhash(x) == nj.minhash(y)).mean() - true) < 0.15


def test_pruning_keeps_the_tolerance():
    for n, m in nj.LEAST_MATCHES.items():  # posterior by numerical integration
        s = np.linspace(0, 1, 200_001)[1:-1]
        for k, ok in ((m, True), (m - 1, False)):
            p = s**k * (1 - s)**(n - k)
            assert (p[s >= 0.8].sum() / p.sum() >= nj.TOLERANCE) == ok
