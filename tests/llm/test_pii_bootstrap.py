import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cachescope.llm import pii_bootstrap as pb

from .helpers import EDGES, empty, frame, words

# the patterns as they are defined, without any short cut
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m.group())) <= 19 and pb.luhn(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out)


CASES = ["a@b.c d@e", "x@y@z.com,q@r.s.t.", "@a.b a.b@-.-", "..%+-@x.y-z.1 éa@b.co", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0255",
         "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111119999999999 0000-0000 0000", "+1 (076) 555-8046 +49.30.123456 +1+2 +12345678 +1 ) 2",
         "a@b.c@d.e a@b..c", "1.2.3 1..2.3.4 256.1.1.1.1", "12345678901234567890123 4 5-6--7", "+" * 30, "@" * 30, "9" * 3000, "1." * 500, ""]


@pytest.mark.parametrize("text", CASES)
def test_base_spans_equal_the_plain_patterns(text):
    assert pb.base_spans(text) == brute(text)


def test_base_spans_on_random_strings():
    import random

    rnd = random.Random(3)
    for _ in range(4000):
        text = "".join(rnd.choice("a1239.@ -+(%é\n") for _ in range(rnd.randrange(60)))
        assert pb.base_spans(text) == brute(text)


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"{' '.join(words(i, 20))} please write to user{i}@mail.example.com today {' '.join(words(i + 900, 20))}") for i in range(30)]
    hidden = "please write to user77(at)mail-example today thanks"
    rows += [(100, hidden), (101, "order number 77123456 shipped " + " ".join(words(8, 30)))]
    got = {r.doc_id: r for r in pb.find(frame(spark, rows).withColumn("spans", F.lit("mine"))).collect()}
    at = hidden.index("user77")
    assert got[100].spans == f"context:{at}:{at + len('user77(at)mail-example')}" and got[100].n_email == 0
    assert got[101].spans == "" and got[101].n_context == 0
    base = rows[4][1].index("user4@")
    assert got[4].spans == f"email:{base}:{base + len('user4@mail.example.com')}"
    assert got[4].base_sha256 == hashlib.sha256(got[4].spans.encode()).hexdigest()


def test_common_words_are_no_pattern(spark):
    # the words before the seeds mostly stand before other words
    rows = [(i, f"of the user{i}@mail.example.com " + "of the house " * 20) for i in range(30)] + [(50, "of the a1b2c3d4")]
    assert all(r.n_context == 0 for r in pb.find(frame(spark, rows)).collect())


def settled(edges, totals, trust):
    """Confidence of each pattern by the definition, in rounds until nothing changes."""
    inst = {i for _, i in edges}
    seed = {i for p, i in edges if edges[p, i][1]}
    belief, last = {i: 100 * (i in seed) for i in inst}, None
    while True:
        conf = {p: sum(n * belief[i] for (q, i), (n, _) in edges.items() if q == p) // totals[p] for p in totals}
        if conf == last:
            return conf
        last = conf
        for i in inst - seed:
            belief[i] = max([conf[p] * trust // 100 for p, j in edges if j == i and p in conf], default=0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scores_equal_the_definition(spark, seed):
    import random

    rnd = random.Random(seed)
    kind = {f"i{k}": 0 if k < 14 else -1 for k in range(40)}
    rows = [(f"i{int(rnd.random() ** 1.5 * 40)}", rnd.randrange(6)) for _ in range(250)]
    seen = spark.createDataFrame([(i, kind[i], "L", p) for i, p in rows], "inst string, kind int, side string, pair long").repartition(3)
    texted = [[f"a{c}", f"b{c}"] for c in "uvwxyz"]  # digits are all alike to a pattern
    hashes = pb.WordHashes()
    pair = {p: pb._pair(w, hashes) for p, w in enumerate(texted)}
    seen = seen.select("inst", "kind", "side", F.element_at(
        F.create_map(*[F.lit(x) for p in pair for x in (p, pair[p])]), F.col("pair")).alias("pair"))
    held = {}
    for i, p in rows:
        n, s = held.get((p, i), (0, kind[i] >= 0))
        held[p, i] = (n + 1, s)
    more = {p: rnd.randrange(0, 25) for p in pair}  # occurrences with no instance beside them
    times = {p: sum(n for (q, _), (n, _) in held.items() if q == p) + more[p] for p in pair}
    texts = spark.createDataFrame([(" ".join(texted[p]),) for p in pair for _ in range(times[p])], "t string")
    # by definition: generations of patterns, each with enough believed instances
    believed, totals = {i for i in kind if kind[i] >= 0 and any(j == i for _, j in held)}, {}
    while True:
        new = {p for p in pair if p not in totals and len({i for q, i in held if q == p and i in believed}) >= 5}
        if not new:
            break
        totals |= {p: times[p] for p in new}
        conf = settled({(p, i): v for (p, i), v in held.items() if p in totals}
                       | {("-", i): (0, True) for i in kind if kind[i] >= 0}, totals, 90)
        fresh = {i for p, i in held if p in totals and conf[p] >= 60} - believed
        if not fresh:
            break
        believed |= fresh
    got = pb.confident_patterns(seen, texts, min_confidence=60)
    assert {r.pair: r.confidence for r in got.collect()} == {pair[p]: c for p, c in conf.items() if c >= 60}


def chain(sizes=(32, 10, 2)):
    """Texts in which the instances found in one context stand in the next one as well."""
    rows, name = [], lambda g, k: f"user{k}@mail.example.com" if g == 0 else f"gen{g}-{k:04d}x"
    for g, context in enumerate(["leada before", "leadb before"]):  # digits are all alike to a pattern
        rows += [f"{context} {name(g, k)} {' '.join(words(g * 100 + k, 6))}" for k in range(sizes[g])]
        rows += [f"{' '.join(words(g * 100 + k + 50, 6))} {context} {name(g + 1, k)}" for k in range(sizes[g + 1])]
    return rows


def test_discovered_identifiers_induce_patterns(spark):
    rows = list(enumerate(chain()))
    got = {r.doc_id: r.spans for r in pb.find(frame(spark, rows)).collect()}
    for i, t in rows:
        for m in re.finditer(r"gen[12]-\d{4}x", t):
            assert got[i] == f"context:{m.start()}:{m.end()}", t


def test_trust_ends_long_chains(spark):
    rows = list(enumerate(chain()))
    got = {r.doc_id: r.n_context for r in pb.find(frame(spark, rows), trust=10).collect()}
    assert not any(n for i, n in got.items() if "gen2" in rows[i][1])
    with pytest.raises(ValueError):
        pb.find(frame(spark, rows), trust=101)


def test_neighbours_and_tokens_of_any_length():
    hashes = pb.WordHashes()
    text = "a " + "b" * 3000 + " " * 500 + "c" * 900 + " x1y2z3 " + "\n" * 700 + "d" * 5000 + "  e f"
    s = text.index("x1y2z3")
    assert pb.around(text, s, s + 6, hashes) == (pb._pair(["b" * 3000, "c" * 900], hashes), pb._pair(["d" * 5000, "e"], hashes))
    assert pb.around("x1y2z3 b", 0, 6, hashes) == (None, None)
    long = "q7" * 500
    assert pb.instances(f"see {long}.", []) == [(4, 4 + len(long), -1)]


def test_a_token_over_many_base_spans_is_no_instance():
    text = ",".join(f"a{k}@b.co" for k in range(12)) + ",tail99"
    spans = pb.base_spans(text)
    assert len(spans) == 12 and len(pb.instances(text, spans)) == 12
    # spans within a longer one do not hide it
    assert pb.instances("x" * 30, [(0, 0, 20), (2, 1, 4)]) == [(0, 20, 0), (2, 4, 1)]


def test_edges(spark):
    got = pb.find(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and {r.spans for r in got} == {""}
    assert {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert pb.find(empty(spark)).collect() == []


def test_counts_are_those_of_each_kind(spark):
    rows = [(1, "a@b.co c@d.eu 1.2.3.4"), (2, "1.2.3.4 4111111111111111"), (3, "+1 (415) 555-0100 +49 30 1234567 x@y.zz"),
            (4, "4111111111111111 1.2.3.4 5.6.7.8 9.9.9.9 a@b.co"), (5, None)]
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pb.find(frame(spark, rows)).collect()}
    assert got == {i: tuple(sum(k == n for _, k, _ in brute(t or "")) for n in range(4)) for i, t in rows}
    assert got[1] == (2, 1, 0, 0) and got[3][3] == 2
