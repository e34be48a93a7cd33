"""Banded hyperplanes against the exact join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cachescope.operators import lsh
from cachescope.operators import vectors as vec
from cachescope.plans.queries import DIM, TAU
from cachescope.sources import tables as src

from .conftest import SF_CHECK
from .test_pivots import SAME, clustered, frame, odd


def exact(df, tau, **names):
    got = vec.pairs_within(df, df, tau, order=names["query_id"], **names)
    return {(r.match_key, r[names["query_id"]]): r.distance for r in got.collect()}


def found(df, tau, **params):
    rows = lsh.pairs_within_lsh(df, tau, key="vec_id", **params).collect()
    out = {(r.src, r.dst): r.distance for r in rows}
    assert len(out) == len(rows)  # no pair comes twice
    return out


@pytest.mark.parametrize("tau,bits,block", [(0.05, 8, 512), (0.2, 6, 7), (0.2, 12, 512)])
def test_every_pair_is_right_and_few_are_missed(spark, monkeypatch, tau, bits, block):
    monkeypatch.setattr(lsh, "BLOCK", block)
    df = odd(spark, frame(spark, clustered(700, 16, 30, 0.3, 4)))
    want, got = exact(df, tau, **SAME), found(df, tau, dim=16, bits=bits)
    assert all(want.get(p) == d for p, d in got.items())
    assert len(want) > 500 and len(got) >= 0.97 * len(want)


def test_recall_on_the_test_vectors(spark):
    df = src.vec_log(spark, SF_CHECK)
    names = dict(query_id="vec_id", query_vec="embedding", cache_key="vec_id", cache_vec="embedding", dim=DIM)
    want, got = exact(df, TAU, **names), found(df, TAU, dim=DIM)
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)


def test_bands_follow_from_threshold_and_recall():
    for tau, bits, recall in ((0.1, 8, 0.9), (0.5, 4, 0.99), (1.0, 10, 0.95)):
        bands = lsh.bands_for(tau, bits, recall)
        agree = (1 - np.arccos(1 - tau) / np.pi) ** bits
        assert 1 - (1 - agree) ** bands >= recall > 1 - (1 - agree) ** (bands - 1)


def test_none(spark):
    df = frame(spark, clustered(3, 16, 2, 0.1, 1))
    assert lsh.pairs_within_lsh(df.where("false"), 0.5, key="vec_id", dim=16).collect() == []
    assert lsh.pairs_within_lsh(df, 0.5, key="vec_id", dim=5).collect() == []


def test_blocks_of_the_whole_table_give_the_same_pairs(spark, monkeypatch):
    monkeypatch.setattr(lsh, "MIN_WIDE", 3)
    monkeypatch.setattr(lsh, "WIDE_BLOCK", 100)
    df = odd(spark, frame(spark, clustered(700, 16, 30, 0.3, 4)))
    for tau, bits in ((0.05, 8), (0.3, 4), (0.2, 12)):
        want = found(df, tau, dim=16, bits=bits, wide=False)
        assert found(df, tau, dim=16, bits=bits, wide=True) == want and len(want) > 300


def test_many_bands_do_not_copy_a_row_to_every_bucket(spark):
    df = frame(spark, clustered(1500, DIM, 500, 3.0, 4))
    assert lsh.bands_for(TAU) > 100
    plan = lsh.pairs_within_lsh(df, TAU, key="vec_id", dim=DIM)._jdf.queryExecution().toString()
    assert "band" not in plan and "bi#" in plan
    near = lsh.pairs_within_lsh(df, 0.02, key="vec_id", dim=DIM, bits=12)._jdf.queryExecution().toString()
    assert "band" in near


def test_rows_that_come_twice_are_alike_in_buckets_and_blocks(spark):
    df = frame(spark, clustered(120, 16, 4, 0.2, 4))
    df = df.unionByName(df.where("vec_id % 7 = 0")).unionByName(df.limit(1).withColumn("vec_id", F.lit(None).cast("long")))
    got = [sorted(map(tuple, lsh.pairs_within_lsh(df, 0.2, key="vec_id", dim=16, wide=w).collect())) for w in (False, True)]
    assert got[0] == got[1] and len(got[0]) > len(set(got[0])) > 100
