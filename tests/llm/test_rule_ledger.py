import re
from collections import Counter

from pyspark.sql import functions as F

from cachescope.llm import rule_ledger as rl

from .helpers import EDGES, edges, empty, frame, words

LETTERS = str.maketrans("0123456789", "abcdefghij")
WS = re.compile(r"[^\x20\x09-\x0d]+")


def brute(text):
    w = WS.findall(text or "")
    windows = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    seen = Counter(windows)
    again = {q for k, x in enumerate(windows) if seen[x] > 1 for q in (k, k + 1, k + 2)}
    earlier, dup = set(), 0
    for x in (text or "").split("\n"):
        if WS.search(x):
            dup += x in earlier
            earlier.add(x)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(again))


def test_measurements_and_verdicts(spark):
    rows = [(i, t and t.translate(LETTERS)) for i, t in EDGES]
    rows += [(100, "a b c a b c"), (101, "x " * 60), (102, "#$ " * 55), (103, "\n".join(["same line"] * 40)),
                    (104, " ".join(words(3, 80)).translate(LETTERS)), (105, "a a a a"), (106, "CAPITAL WORDS " * 30 + " ".join(words(4, 400)))]
    docs = frame(spark, rows).withColumn("fail_bits", F.lit("mine"))
    got = rl.apply_policy(rl.ledger(docs)).collect()
    texts = Counter()
    for r in got:
        m = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        texts[r.doc_id, m] += 1
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
        assert r.fail_bits == sum(1 << k for k, (_, rule) in enumerate(rl.RULES) if eval(rule, {}, r.asDict()))
    assert texts == Counter((i, brute(t)) for i, t in rows)
    assert {r.doc_id for r in got if r.kept} >= {3, 104}


def test_window_ids_beyond_64_bits():
    import numpy as np

    ids = np.array([2**21, 5, 7, 1, 2**21, 5, 7, 0])
    assert rl.repeated_words(ids) == 6


def test_ablations(spark):
    rows = rl.ledger(frame(spark, EDGES + [(i, " ".join(words(i, 60))) for i in range(50, 60)] + [(200, "#$ " * 55)])).persist()
    bits = [r.fail_bits for r in rows.collect()]
    mask = rl.mask_of("web-1")
    for r in rl.ablations(rows, "web-1").collect():
        bit = 1 << [n for n, _ in rl.RULES].index(r.rule)
        assert r.kept == sum(not b & mask for b in bits)
        assert r.kept_without == sum(not b & mask & ~bit for b in bits)
        assert (r.n_docs, r.n_fail) == (len(bits), sum(bool(b & bit) for b in bits))
    assert {r.kept_without for r in rl.ablations(rl.ledger(empty(spark))).collect()} == {0}
    assert rl.ledger(empty(spark)).collect() == [] and rl.ledger(edges(spark)).count() == len(EDGES)
