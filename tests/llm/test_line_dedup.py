from collections import defaultdict

from pyspark.sql import functions as F

from cachescope.llm import line_dedup

from .helpers import EDGES, edges, empty, frame

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows):
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 3 or i == max(d for d in held[key(x)] if d is not None)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_equals_brute_force(spark):
    line = "The same long line, Été in all of them"
    rows = [(i, "\n".join([f"own {i} " + "x" * 20, ["  ", "\t"][i % 2] + (line.upper() if i % 3 else line), "short",
                           line if i % 5 == 0 else "", f"pair number {i // 2} of documents"])) for i in range(40)]
    rows += [(41, "É" + "a" * 25), (42, "é" + "a" * 25), (43, "É" + "A" * 25)] + EDGES + [(None, line), (8, line), (8, line)]
    got = line_dedup.dedup_lines(frame(spark, rows).withColumn("n_lines", F.lit(99)))
    pick = sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)
    assert pick == sorted(brute(rows), key=repr)


def test_empty(spark):
    assert line_dedup.dedup_lines(empty(spark)).collect() == []
    assert {r.text for r in line_dedup.dedup_lines(edges(spark).where("text is null")).collect()} == {""}
