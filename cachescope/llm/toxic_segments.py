"""Operator 8: toxic passages by maximum-scoring segments.

Learning (labelled rows of the folds 1 to 4 of ``crc32(doc_id as text) mod 5``; fold 0 is
held out and its labels are never read):

1. Folds 1 to 3 give the number of texts with each word by label. A word's log-odds come from a chain of
   Dirichlet priors: the class share of its first 4 letters is the prior mean for that of
   its first 5, then 6, then the whole word, so that an unseen form of a toxic stem is
   still scored. Counts live in a table of ``BUCKETS`` hashed cells, which bounds what
   tasks send, what the driver holds and what is broadcast, whatever the vocabulary.
2. Fold 4 calibrates. The clean documents' token scores give the Karlin-Altschul rate
   ``lambda`` (the root of ``E[exp(lambda s)] = 1``), their best segments the location
   ``ln K``; a segment of score S in a text of m tokens has the normalised score
   ``lambda S - ln(K m)``, an extreme-value variate. A logistic curve then maps a
   document's evidence to the probability of the label.

Scoring: a linear-time scan finds all disjoint maximal-scoring segments of a text. In a
segment a toxic word counts once, so that mere repetition adds up to nothing, but it counts
again in every other one: neither place nor length of the text uses words up (``passages``).
The evidence sums the normalised scores of the r best segments, for the best r.

Learning reads at most ``LEARN_ROWS`` and ``CALIBRATE_ROWS`` labelled rows, those with the
smallest hash of their id, one per distinct text and label; scoring reads every text whole.

Defined cases: null text is empty; a text without words has the least evidence; labels
that are null are not used, and a document labelled twice is toxic if either says so; a
null id belongs to the held-out fold; without usable labels of both kinds every score is
the share of toxic rows (0.0 without labels); without both kinds in the calibration fold
the learning folds calibrate; repeated rows score alike; input columns named like an output
column are replaced, all others kept, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_apart

#: Hashed cells of the count table.
BUCKETS = 1 << 20
#: Cells of the count table in one block on its way to the driver.
PACK = 1 << 14
#: Lengths of the word beginnings in the chain of priors.
STEMS = (4, 5, 6)
#: Strength of each Dirichlet prior, in texts.
PRIOR = 10.0
#: Subtracted from every token's log-odds, so that a clean text's sum drifts down.
DRIFT = 0.35
#: Most labelled rows that are read for the counts and for the calibration.
LEARN_ROWS, CALIBRATE_ROWS = 60_000, 20_000
#: A passage is reported if so many as good are expected by chance in a text at most.
PASSAGE_E = 0.01
#: Evidence is cut to this range and binned so finely for the logistic fit.
LEAST, MOST, BIN = -30.0, 300.0, 0.1
#: Words whose score a task remembers.
CACHE_WORDS = 400_000

_WORD = re.compile(r"[^\W\d_]+")


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def _cells(word: str) -> list[int]:
    """Cells of a word's chain of priors, shortest beginning first."""
    chain = [word[:n] + "*" for n in STEMS if len(word) > n] + [word]
    return [zlib.crc32(x.encode("utf-8", "replace")) & (BUCKETS - 1) for x in chain]


@dataclass
class Model:
    """Counts and calibration; ``a`` and ``b`` are the logistic curve's."""

    toxic: np.ndarray | None
    total: np.ndarray | None
    rate: float
    lam: float = 1.0
    ln_k: float = 0.0
    a: float = 0.0
    b: float = 1.0
    flat: bool = False

    def token_score(self, word: str) -> float:
        share = self.rate
        for c in _cells(word):
            share = (self.toxic[c] + PRIOR * share) / (self.total[c] + PRIOR)
        return math.log(share / (1 - share)) - math.log(self.rate / (1 - self.rate)) - DRIFT

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-min(50.0, max(-50.0, self.a + self.b * evidence))))


class Scorer(dict):
    """Token scores of one task, by word."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = s = self.model.token_score(word)
        return s

    def tokens(self, text: str) -> tuple[list[str], np.ndarray]:
        """The words and their scores."""
        words = _WORD.findall(text.lower())
        return words, np.fromiter(map(self.__getitem__, words), dtype="f8", count=len(words))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in linear time.

    Neighbours of one sign are first merged into runs. A new positive run joins the
    latest earlier segment that starts lower than it does and ends lower than it would:
    left-to-right cumulative sums decide both.
    """
    if not len(scores) or scores.max() <= 0:
        return []
    up = scores > 0
    starts = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
    sums = np.add.reduceat(scores, starts)
    ends = np.append(starts[1:], len(scores))
    found: list[list] = []  # start, end, sum before, sum after, link to an earlier segment
    total = 0.0
    for at, to, x in zip(starts.tolist(), ends.tolist(), sums.tolist()):
        if x <= 0:
            total += x
            continue
        new = [at, to, total, total + x, -1]
        total += x
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            # joins segment j and all after it; the joined one looks further left
            new[0], _, new[2], _, link = found[j]
            del found[j:]
            j = link
    return [(s, e, hi - lo) for s, e, lo, hi, _ in found]


def _best_once(words: list[str], scores: list[float], a: int, b: int) -> tuple[int, int, float] | None:
    """The best segment of words a to b if a word of positive score counts once in it, and as a
    neutral one (``-DRIFT``) after that.

    A start is given up when a later one does as well: it never gains on it again. The sums from
    the starts left fall from each to the next; ``over`` holds by how much (of the last, its sum).
    """
    starts: list[int] = []
    over: list[float] = []
    last: dict[str, int] = {}
    top, best, at = 0.0, 0.0, None

    def give_up(k: int) -> None:
        nonlocal top
        while k >= 0 and over[k] <= 0:
            less = over.pop(k)
            starts.pop(k)
            if k:
                over[k - 1] += less
            else:
                top -= less
            k -= 1

    for i in range(a, b):
        x = scores[i]
        if x <= 0:
            if starts:
                over[-1] += x
                top += x
            continue
        known = bisect_right(starts, last.get(words[i], -1))  # starts whose segment holds the word
        last[words[i]] = i
        if starts:
            top += -DRIFT if known else x
            over[-1] += x if known < len(starts) else -DRIFT
            if 0 < known < len(starts):
                over[known - 1] -= x + DRIFT
                give_up(known - 1)
            over[-1] -= x
        else:
            top = x
        starts.append(i)
        over.append(x)
        give_up(len(over) - 2)
        if len(starts) == 1:
            top = x
        if top > best + 1e-12:
            best, at = top, (starts[0], i + 1, top)
    return at


def passages(words: list[str], scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Disjoint segments (start, end, score) in which a word of positive score counts once: the
    best one, then the same on both sides of it.

    All beginnings and ends of such a segment have positive sums, also with every word counted
    each time, so that it lies inside one of ``segments``.
    """
    out = []
    plain: list[float] = []
    for i, j, x in segments(scores):
        up = [words[k] for k in (np.flatnonzero(scores[i:j] > 0) + i).tolist()]
        if len(set(up)) == len(up):
            out.append((i, j, x))
            continue
        plain = plain or scores.tolist()
        work = [(i, j)]
        while work:
            a, b = work.pop()
            if found := _best_once(words, plain, a, b):
                out.append(found)
                work += [r for r in ((a, found[0]), (found[1], b)) if r[0] < r[1]]
    return sorted(out)


def evidence(segs: list[tuple[int, int, float]], n: int, model: Model) -> float:
    """Sum of the normalised scores of the r best segments, for the best r; every segment
    after the first is charged ln 2 for the choice of r."""
    if not segs:
        return LEAST
    base = model.ln_k + math.log(max(n, 2))
    best, total = LEAST, 0.0
    for r, s in enumerate(sorted((s for *_, s in segs), reverse=True)):
        total += model.lam * s - base - (math.log(2) if r else 0.0)
        if total <= best:
            break
        best = total
    return min(max(best, LEAST), MOST)


def labelled(docs: DataFrame, labels: DataFrame, folds: tuple[int, ...], rows: int,
             key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _toxic): at most ``rows`` labelled documents of these folds, one per text and label."""
    sample = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & fold(F.col("doc_id")).isin(*folds))
              .groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("_toxic"))
              .orderBy(F.xxhash64("_id"), "_id").limit(rows))
    return (docs.select(F.col(key).alias("_k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h"))
            .join(F.broadcast(sample), F.col("_k") == F.col("_id"))  # at most ``rows`` rows
            .groupBy("_h", "_toxic").agg(F.min("_id").alias("_id")).select("_id", "_toxic"))


def _with_labels(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    return (docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
            .join(F.broadcast(chosen), F.col("_k") == F.col("_id")).select("text", "_toxic"))


def count_tokens(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and all texts that hold a word, by the word's cells, over ``sample`` (text, _toxic)."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        table = np.zeros((2, BUCKETS), dtype="i8")
        words: tuple[Counter, Counter] = (Counter(), Counter())

        def pour() -> None:
            for k in (0, 1):
                for w, n in words[k].items():
                    for c in _cells(w):
                        table[k, c] += n
                words[k].clear()

        for batch in batches:
            for t, y in zip(batch["text"], batch["_toxic"]):
                words[y].update(set(_WORD.findall(t.lower())))
                if len(words[0]) + len(words[1]) > CACHE_WORDS:
                    pour()
        pour()
        at = np.flatnonzero(table.any(axis=0))
        yield pd.DataFrame({"cell": at, "clean": table[0, at], "toxic": table[1, at]})

    cells = (sample.mapInPandas(count, "cell int, clean long, toxic long").groupBy("cell")
             .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((2, PACK), dtype="f4")
        at = rows["cell"].to_numpy() % PACK
        table[0, at], table[1, at] = rows["toxic"], rows["toxic"] + rows["clean"]
        return pd.DataFrame({"part": [int(rows["cell"].iat[0]) // PACK], "data": [table.tobytes()]})

    # The driver takes the table as BUCKETS / PACK blocks of bytes, not as a row per cell.
    parts = (cells.groupBy(F.floor(F.col("cell") / PACK).alias("part")).applyInPandas(pack, "part int, data binary")
             .collect())
    whole = np.zeros((2, BUCKETS), dtype="f4")
    for r in parts:
        whole[:, r.part * PACK:(r.part + 1) * PACK] = np.frombuffer(r.data, dtype="f4").reshape(2, PACK)
    return whole[0], whole[1]


def _rate_of(hist: dict[int, int]) -> float:
    """Root lambda > 0 of E[exp(lambda s)] = 1 for scores in bins of 0.05."""
    s = np.array(sorted(hist), dtype="f8") * 0.05
    p = np.array([hist[k] for k in sorted(hist)], dtype="f8")
    p /= p.sum()
    if not len(s) or s.max() <= 0 or (p * s).sum() >= 0:
        return 1.0
    low, high = 1e-3, 1.0
    value = lambda x: float((p * np.exp(np.minimum(x * s, 600))).sum())
    while value(high) < 1 and high < 50:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return high


def calibrate(model: Model, sample: DataFrame) -> Model:
    """Extreme-value parameters and logistic curve from ``sample`` (text, _toxic)."""
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast(vars(model).copy())  # plain values: executors may lack this package

    def null_scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hist: dict[int, int] = {}
        scorer = Scorer(Model(**shared.value))
        for batch in batches:
            for t in batch["text"]:
                _, s = scorer.tokens(t)
                for v, n in zip(*np.unique(np.round(s / 0.05).astype(int), return_counts=True)):
                    hist[int(v)] = hist.get(int(v), 0) + int(n)
        yield pd.DataFrame({"v": list(hist), "n": list(hist.values())}, dtype="i8")

    clean = sample.where("_toxic = 0").select("text")
    rows = clean.mapInPandas(null_scores, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).collect()
    model.lam = _rate_of({r.v: r.n for r in rows})  # as many rows as score bins

    rate = model.lam

    def best_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, lam = Scorer(Model(**shared.value)), rate
        n, total = 0, 0.0
        for batch in batches:
            for t in batch["text"]:
                words, s = scorer.tokens(t)
                if top := max((x for *_, x in passages(words, s)), default=0.0):
                    n += 1
                    total += lam * top - math.log(max(len(words), 2))
        yield pd.DataFrame({"n": [n], "x": [total]})

    got = clean.mapInPandas(best_segments, "n long, x double").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).first()
    model.ln_k = got.x / got.n - 0.5772156649 if got.n else 0.0  # mean of an extreme-value variate: location + 0.577

    again = spark.sparkContext.broadcast(vars(model).copy())

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(**again.value)
        scorer = Scorer(m)
        for batch in batches:
            e = [evidence(passages(w, s), len(w), m) for w, s in map(scorer.tokens, batch["text"])]
            yield pd.DataFrame({"bin": np.round(np.array(e) / BIN).astype("i8"), "y": batch["_toxic"].astype("i8")})

    points = (sample.mapInPandas(bins, "bin long, y long").groupBy("bin", "y").count().toPandas())  # bounded by the bins
    model.a, model.b = _logistic(points["bin"].to_numpy() * BIN, points["y"].to_numpy(), points["count"].to_numpy())
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression with a weak ridge; the slope stays positive."""
    x = np.clip(x, -10, 30).astype("f8")
    design = np.stack([np.ones_like(x), x], axis=1)
    w = np.array([0.0, 0.1])
    ridge = np.diag([1e-3, 1e-2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (n * (p - y)) + ridge @ w
        h = (design * (n * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        w[1] = max(w[1], 1e-3)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        learn_rows: int = LEARN_ROWS, calibrate_rows: int = CALIBRATE_ROWS) -> Model:
    """Learn the counts from folds 1 to 3 and the calibration from fold 4."""
    chosen = labelled(docs, labels, (1, 2, 3), learn_rows, key, text)
    stats = chosen.agg(F.count(F.lit(1)).alias("n"), F.sum("_toxic").alias("t")).first()
    n, t = stats.n or 0, stats.t or 0
    if not 0 < t < n:
        return Model(None, None, t / n if n else 0.0, flat=True)
    toxic, total = count_tokens(_with_labels(docs, chosen, key, text))
    rate = float(toxic.sum() / max(total.sum(), 1.0))
    model = Model(toxic, total, min(max(rate, 1e-6), 1 - 1e-6))
    other = labelled(docs, labels, (4,), calibrate_rows, key, text)
    if other.select("_toxic").distinct().count() < 2:  # at most ``calibrate_rows`` rows
        other = labelled(docs, labels, (1, 2, 3), calibrate_rows, key, text)
    return calibrate(model, _with_labels(docs, other, key, text))


def judge(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """(score, evidence, passages) of each text, as a struct.

    ``passages`` are the significant ones: start and end in code points of the text,
    score, and how many as good chance would give.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model).copy())

    @F.pandas_udf("struct<score: double, evidence: double, passages: array<struct<start: int, end: int, "
                  "score: double, expected: double>>>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Model(**shared.value)
        scorer = Scorer(m)
        for batch in batches:
            rows = []
            for t in batch:
                if m.flat:
                    rows.append((m.rate, LEAST, []))
                    continue
                words, s = scorer.tokens(t)
                segs = passages(words, s)
                e = evidence(segs, len(words), m)
                limit = (m.ln_k + math.log(max(len(words), 2)) - math.log(PASSAGE_E)) / m.lam
                good = [x for x in segs if x[2] >= limit]
                spans = []
                if good:
                    at = [f.span() for f in _WORD.finditer(t)]
                    if len(at) != len(words):  # lower-casing cut a word in two: the passage is the text
                        at = [(0, len(t))] * len(words)
                    for i, j, x in good:
                        spans.append({"start": at[i][0], "end": at[j - 1][1], "score": x,
                                      "expected": math.exp(min(50.0, m.ln_k + math.log(max(len(words), 2)) - m.lam * x))})
                rows.append((m.probability(e), e, spans))
            yield pd.DataFrame(rows, columns=["score", "evidence", "passages"])

    return judged(F.coalesce(docs[text], F.lit("")))


@columns_apart("key", "text")
def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``held_out, score, predicted, evidence, passages``."""
    out = ("held_out", "score", "predicted", "evidence", "passages")
    cols = [c for c in docs.columns if c not in out]
    return (docs.select(*cols).withColumn("_t", judge(docs, model, text))
            .withColumn("held_out", fold(F.col(key)) == 0)
            .withColumn("score", F.col("_t.score"))
            .withColumn("predicted", (F.col("_t.score") >= 0.5).cast("int"))
            .withColumn("evidence", F.col("_t.evidence"))
            .withColumn("passages", F.col("_t.passages"))
            .drop("_t"))


@columns_apart("key", "text")
def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not judged toxic, with all their columns."""
    return docs.where(judge(docs, fit(docs, labels, key, text), text)["score"] < 0.5)
