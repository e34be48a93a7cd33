import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cachescope.llm import whitening as wh
from cachescope.llm.queries import QUERIES

from ..conftest import SF_CHECK, SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, vectors, parts=3, start=0):
    rows = [(start + i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def brute(rows, components=32):
    """By definition, with Python integers and numpy's own eigenvectors."""
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    xs = [[math.floor(64 * x) + 1_000_000 for x in v] for _, v in good]
    n, sums = len(xs), [sum(c) for c in zip(*xs)]
    dev = [sum((n * x - s) ** 2 for x, s in zip(v, sums)) for v in xs]
    y = np.array([[(n * x - s) / n for x, s in zip(v, sums)] for v in xs])
    cov = y.T @ y / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1], vec[:, ::-1]
    return good, n, dev, y, cov, e, vec


def check(got, rows, components=32, gap=1e-6):
    good, n, dev, y, cov, e, vec = brute(rows)
    count = min(components, len(e))
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(by) == sorted(i for i, _ in good) and all(sorted(b) == list(range(1, count + 1)) for b in by.values())
    assert {i: by[i][1].deviation for i in by} == {i: d for (i, _), d in zip(good, dev)}
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    ids = [i for i, _ in good]
    for k in range(count):
        assert all(by[i][k + 1].explained == pytest.approx(e[k] / np.trace(cov), rel=1e-9) for i in ids[:3])
        lone = min([abs(e[k] - e[j]) for j in range(len(e)) if j != k] or [np.inf]) > gap * e[0]
        if lone:
            want = y @ vec[:, k] / math.sqrt(e[k])
            have = np.array([by[i][k + 1].whitened for i in ids])
            assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7 * np.abs(want).max()
    return got[0].identity_error


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_equals_brute_force(spark, d):
    rng = np.random.default_rng(d)
    rows = rng.normal(size=(300, d)) * rng.uniform(0.2, 3, d) + rng.normal(size=d)
    vectors = [*rows.astype("f4").tolist(), None, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [None] * d]
    df = frame(spark, vectors).withColumn("w", F.lit("x")).withColumn("deviation", F.lit("y"))
    got = wh.whiten(df).collect()
    assert check(got, list(enumerate(vectors))) < 1e-9


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").collect()]
    got = QUERIES["op12_whitening"](spark, SF_CHECK).collect()
    assert len(got) == 32 * len(rows) and check(got, rows) < 1e-9


def spectra():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(48, 48)))
    for e in (np.linspace(1, 2, 48), 2.0 ** -np.arange(48), 10.0 ** -np.arange(48), np.r_[[5.0] * 20, [2.0] * 20, [0.0] * 8],
              2 + 1e-13 * np.arange(48), np.zeros(48), np.r_[1e6, np.ones(47)], -np.linspace(-1, 1, 48)):
        yield (q * e) @ q.T
    yield np.diag(np.arange(9.0))
    yield np.ones((6, 6))
    yield np.array([[3.0]])
    yield np.empty((0, 0))


@pytest.mark.parametrize("k", range(12))
def test_spectrum(k):
    a = list(spectra())[k]
    e, v = wh.spectrum(a)
    scale = max(np.linalg.norm(a, 2), 1e-300) if len(a) else 1.0
    assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max(initial=0) < 1e-13 * scale
    assert np.abs(v.T @ v - np.eye(len(a))).max(initial=0) < 1e-13 and np.abs(a @ v - v * e).max(initial=0) < 1e-13 * scale


def test_polar_factor_is_the_projector():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    w, q = np.linalg.eigh(a)
    assert np.abs(wh.polar_unitary(a) - (q * np.sign(w)) @ q.T).max() < 1e-12


def test_defined_cases(spark):
    assert wh.whiten(frame(spark, [None]).where("false")).collect() == []
    assert wh.whiten(frame(spark, [None, [float("nan")]])).collect() == []
    assert wh.whiten(frame(spark, [[], []])).collect() == []
    one = wh.whiten(frame(spark, [[1.0, 2.0]])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    # the second dimension depends on the first; repeated rows stay; a null id is kept
    df = frame(spark, [[1.0, 2.0], [1.0, 2.0], [3.0, 6.0]]).withColumn("vec_id", F.expr("nullif(vec_id, 0)"))
    got = wh.whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(i, c) for i in range(3) for c in (1, 2)]
    assert {r.whitened for r in got if r.component == 2} == {None} and got[0].identity_error < 1e-9
    # lengths: the most common counts, the longer one on a tie; entries without an exact whole number go
    mixed = frame(spark, [[1.0], [2.0], [1.0, 2.0], [5.0, 1.0], [3.0, 1e30]])
    assert {r.vec_id for r in wh.whiten(mixed).collect()} == {2, 3}


def test_deviation_beyond_64_bits():
    x = np.array([[2**50, 0], [0, 0], [0, 3]], dtype="i8")
    sums = [int(s) for s in x.sum(axis=0)]
    whole, _ = wh._centre(3, sums)
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x]
    assert wh.deviations(x, 3, whole, sums) == [w if w < 2**63 else None for w in want]
    small = np.array([[1, 2], [5, 9]], dtype="i8")
    assert wh.deviations(small, 2, *[wh._centre(2, [6, 11])[0], [6, 11]]) == [16 + 49, 16 + 49]


def test_result_does_not_depend_on_files(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    pick = lambda n: {(r.vec_id, r.component): (r.deviation, abs(r.whitened)) for r in wh.whiten(df.repartition(n)).collect()}
    a, b = pick(1), pick(5)
    assert all(a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1], rel=1e-6, abs=1e-9) for k in a)
