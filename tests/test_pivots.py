"""The pivot index: same rows as the grid, fewer visited."""

import gc
import math
import weakref

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cachescope.operators import pivots as pv
from cachescope.operators import vectors as vec


def clustered(n, dim, groups, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    return centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim)) / math.sqrt(dim)


def frame(spark, rows, name="vec_id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"{name} long, embedding array<double>")


def odd(spark, df):
    """Vectors that never match: null, wrong dimension, zero; and repeated ones."""
    extra = [(9001, None), (9002, [1.0]), (9003, [0.0] * 16), (9004, []), (9005, [1.0] * 16), (9006, [2.0] * 16)]
    return df.unionByName(spark.createDataFrame(extra, df.schema)).repartition(3)


SAME = dict(query_id="vec_id", query_vec="embedding", cache_key="vec_id", cache_vec="embedding", dim=16)


@pytest.fixture(scope="module")
def cache(spark):
    df = odd(spark, frame(spark, clustered(1200, 16, 25, 0.25, 1))).cache()
    return df, pv.build(df, "vec_id", "embedding", 16, block_rows=40)


def rows(df):
    return sorted((r.vec_id, r.match_key, r.distance) for r in df.collect())


def test_blocks_hold_every_row_within_their_bounds(cache):
    df, index = cache
    got = index.rows.collect()
    assert sorted(r.vec_id for r in got) == sorted([*range(1200), 9005, 9006])
    a = pv.angles(pv.unit_rows(index.rows.toPandas()["embedding"], 16)[0], index.pivots)
    block = index.rows.toPandas()["cblock"].to_numpy()
    assert (a >= index.low[block] - 1e-12).all() and (a <= index.high[block] + 1e-12).all()
    assert index.sizes.sum() == len(got) and index.sizes.max() <= 120  # a split ring is cut by hash


@pytest.mark.parametrize("block_rows", [None, 300])
def test_knn1_equals_the_grid(spark, cache, block_rows):
    df, index = cache
    want = vec.knn1(df, df, exclude_self=True, **SAME)
    got = vec.knn1(df, index.rows, exclude_self=True, index=index, block_rows=block_rows, **SAME)
    key = lambda x: (x[0], str(x[1]), x[2])
    a, b = ([(r.vec_id, r.match_key, r.distance) for r in d.collect()] for d in (want, got))
    assert sorted(a, key=key) == sorted(b, key=key) and len(a) == 1206


@pytest.mark.parametrize("tau", [0.0, 0.02, 0.2, 1.0, 2.0])
def test_pairs_and_counts_equal_the_grid(spark, cache, tau):
    df, index = cache
    for order in (None, "vec_id"):
        assert rows(vec.pairs_within(df, index.rows, tau, index=index, order=order, **SAME)) == rows(
            vec.pairs_within(df, df, tau, order=order, **SAME))
    pick = lambda d: sorted((r.vec_id, r.n_within, r.match_key if r.n_within else None) for r in d.collect())
    assert pick(vec.neighbor_counts(df, index.rows, tau, index=index, order="vec_id", **SAME)) == pick(
        vec.neighbor_counts(df, df, tau, order="vec_id", **SAME))


def test_visited_share_falls_on_clustered_vectors(spark):
    shares = {}
    for name, spread in (("tight", 0.1), ("loose", 0.4), ("none", 50.0)):
        df = frame(spark, clustered(3000, 16, 40, spread, 2))
        index = pv.build(df, "vec_id", "embedding", 16, block_rows=50)
        shares[name] = index.visited_share(df, "embedding", 0.1)
    assert shares["tight"] < 0.1 and 2 * shares["tight"] < shares["none"] <= 1.0, shares


def test_empty_cache(spark, cache):
    df, _ = cache
    none = df.where("false")
    index = pv.build(none, "vec_id", "embedding", 16)
    got = vec.knn1(df, index.rows, index=index, **SAME).collect()
    assert len(got) == 1206 and {r.match_key for r in got} == {None}
    assert vec.pairs_within(df, index.rows, 2.0, index=index, **SAME).count() == 0


def test_ring_blocks():
    got = pv.ring_blocks({(0, 1): 10, (0, 2): 30, (0, 3): 25, (0, 5): 130, (0, 6): 5, (1, 0): 1}, 50)
    assert got == {(0, 1): (0, 1), (0, 2): (0, 1), (0, 3): (1, 1), (0, 5): (2, 3), (0, 6): (5, 1), (1, 0): (6, 1)}


def test_blocks_grow_with_the_table(spark):
    assert [pv.grown(128, n, 64) for n in (0, 8000, 102_400, 10**8, 10**9)] == [128, 128, 1600, 32768, 61036]
    index = pv.build(frame(spark, clustered(1500, 16, 25, 0.25, 1)), "vec_id", "embedding", 16, block_rows=4)
    assert index.sizes.sum() == 1500 and len(index.sizes) <= 3 * pv.FEW_BLOCKS  # 375 and more of four rows


@pytest.mark.parametrize("stack", [pv.unit_rows, vec._matrix])
def test_vectors_of_a_cell_are_freed_without_the_collector(stack):
    gc.collect()
    gc.disable()
    try:
        vectors = pd.Series([np.ones(4), None, np.ones(3), np.zeros(4), []], dtype=object)
        held = weakref.ref(vectors)
        assert stack(vectors, 4)[1].tolist() == [True, False, False, False, False]
        del vectors
        assert held() is None
    finally:
        gc.enable()


def test_cells_of_a_large_table_are_small(spark):
    qb, cb = vec._block_counts(spark, 600_000, 600_000, None, None, 64)
    assert max(600_000 / qb, 600_000 / cb) <= 32768
    assert vec._chunk_rows(32768) * 32768 * 8 <= 16 << 20
