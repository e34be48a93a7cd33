"""Pairs within a cosine distance by banded random hyperplanes: candidates by hashing, distances exact.

Opt-in, for tables whose exact search is too much: every reported pair is right, but a pair
at the threshold is found only with the chance asked for (``recall``), nearer ones with more.
The exact join (:func:`cachescope.operators.vectors.pairs_within`) is the default.

A band is ``bits`` signs of products with random hyperplanes; two vectors at angle ``a`` agree
on a band with the chance ``(1 - a / pi) ** bits``, so the number of bands follows from the
threshold. Vectors that agree on a band meet in a bucket; a bucket is dealt into blocks of
at most ``BLOCK`` rows, each pair of blocks being a group of its own, so that a bucket of very
many vectors is spread over many tasks. A pair is reported by the first band on which it
agrees, so no pair comes twice and none has to be made distinct.

A row is copied to each of its buckets. Where a distant threshold asks for so many bands that
the buckets compare about as many pairs as there are and move more rows than blocks of the
whole table would (of up to ``WIDE_BLOCK`` rows, each pair of blocks once), the rows meet in
those blocks and a pair within the threshold is reported if its signatures agree on a band.
These are the same pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .pivots import unit_rows
from .vectors import DIGITS

#: Signs of a band, chance of finding a pair at the threshold, rows of a block.
BITS, RECALL, BLOCK = 8, 0.99, 512
#: Rows of a block of the whole table at most, least number of such blocks, pairs compared at once.
WIDE_BLOCK, MIN_WIDE, COMPARED = 16384, 8, 1 << 21


def bands_for(threshold: float, bits: int = BITS, recall: float = RECALL) -> int:
    """Bands with which a pair at the threshold agrees on one with the chance ``recall``."""
    agree = (1.0 - math.acos(max(-1.0, 1.0 - threshold)) / math.pi) ** bits
    return 1 if agree >= recall else math.ceil(math.log(1.0 - recall) / math.log(1.0 - agree))


def pairs_within_lsh(rows: DataFrame, threshold: float, *, key: str = "key", vector: str = "embedding", dim: int,
                     bits: int = BITS, recall: float = RECALL, seed: int = 7, wide: bool | None = None) -> DataFrame:
    """``src, dst, distance``: pairs of a table (``src < dst`` by key; keys are unique) with cosine
    distance <= threshold. Vectors of another dimension or of norm zero have no pairs. ``wide``
    says whether rows meet in blocks of the whole table (default: by what is moved and compared)."""
    if not 1 <= bits <= 31:
        raise ValueError("bits must lie between 1 and 31")
    bands = bands_for(threshold, bits, recall)
    spark = rows.sparkSession
    planes = np.random.default_rng(seed).normal(size=(bands * bits, dim))
    shared = spark.sparkContext.broadcast(planes)  # bands x bits x dim numbers

    packed = np.dtype("u1" if bits <= 8 else "u2" if bits <= 16 else "<u4")
    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("distance", T.DoubleType())])

    @F.pandas_udf("binary")
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = 1 << np.arange(bits)
        for vectors in batches:
            unit, ok = unit_rows(vectors, dim)
            signs = (unit @ shared.value.T > 0).reshape(len(unit), bands, bits)
            values = (signs * weights).sum(axis=2).astype(packed)
            yield pd.Series([v.tobytes() if good else None for v, good in zip(values, ok)], dtype=object)

    def signatures(part: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(part), dtype=packed).reshape(len(part), bands)

    signed = materialise(rows.select(F.col(key).alias("id"), F.col(vector).alias("vec"),
                                     signature(F.col(vector)).alias("sig")).where("sig is not null"), "lsh-signed")

    @F.pandas_udf("array<int>")
    def values(part: pd.Series) -> pd.Series:
        return pd.Series(list(signatures(part).astype("i4")), dtype=object)

    met = signed.select("id", F.posexplode(values("sig")).alias("band", "value"))
    # written, so that the join can split a bucket of very many rows
    sizes = materialise(met.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lsh-buckets")
    if wide is None:
        n = signed.count()
        met_rows = sizes.agg(F.sum(F.col("n") * F.ceil(F.col("n") / F.lit(BLOCK))).alias("copies"),
                             F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs")).first()
        wide = ((met_rows.copies or 0) > n * wide_blocks(n)) and 2 * (met_rows.pairs or 0) >= float(n) * n
    if wide:
        return _met_in_blocks(signed, threshold, dim, wide_blocks(signed.count()), signatures, schema)
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = (met.join(sizes, ["band", "value"])
             .withColumn("b", mine).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("id", "band", "value", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"),
                     (F.col("b") > F.col("o")).alias("right"), (F.col("b") == F.col("o")).alias("both")))
    group = ["band", "value", "bi", "bj"]
    cells = (dealt.join(signed, "id").repartition(*group).sortWithinPartitions(*group, "id"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            names = held[group].to_numpy()
            cut = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            if len(cut):
                yield pairs_of(held.iloc[:cut[-1]], [0, *cut.tolist()])
                held = held.iloc[cut[-1]:]
        if held is not None and len(held):
            yield pairs_of(held, [0, len(held)])

    def pairs_of(part: pd.DataFrame, edges: list[int]) -> pd.DataFrame:
        unit, sig = unit_rows(part["vec"], dim)[0], signatures(part["sig"])
        ids, band, right, both = (part[c].to_numpy() for c in ("id", "band", "right", "both"))
        out = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            a = lo + np.flatnonzero(~right[lo:hi] | both[lo:hi])
            b = lo + np.flatnonzero(right[lo:hi] | both[lo:hi])
            dist = np.round(1.0 - unit[a] @ unit[b].T, DIGITS)
            i, j = np.nonzero(dist <= threshold)
            d, i, j = dist[i, j], a[i], b[j]
            # a block with itself gives each pair twice, and every row with itself
            keep = (ids[i] < ids[j]) if both[lo:hi].all() else np.ones(len(i), dtype=bool)
            keep &= ~(sig[i, :band[lo]] == sig[j, :band[lo]]).any(axis=1)
            i, j, d = i[keep], j[keep], d[keep]
            swap = ids[i] > ids[j]
            out.append(pd.DataFrame({"src": ids[np.where(swap, j, i)], "dst": ids[np.where(swap, i, j)], "distance": d}))
        return pd.concat(out, ignore_index=True)

    return cells.select("id", *group, "right", "both", "vec", "sig").mapInPandas(score, schema)


def wide_blocks(n: int) -> int:
    """Blocks of a whole table of ``n`` rows."""
    return max(MIN_WIDE, math.ceil(n / WIDE_BLOCK))


def _met_in_blocks(signed: DataFrame, threshold: float, dim: int, n_blocks: int, signatures, schema: T.StructType) -> DataFrame:
    """The pairs within the threshold whose signatures agree on a band: every two rows meet once,
    in the cell of their blocks."""
    b = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    # as in the buckets: rows without id have no pairs, an id that comes twice gives each pair for every row of it
    dealt = signed.join(signed.select("id"), "id").withColumn("b", b).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select(
        "id", "vec", "sig", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), (F.col("b") > F.col("o")).alias("right"))

    def score(cell: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, right = cell["id"].to_numpy(), cell["right"].to_numpy()
        unit, sig = unit_rows(cell["vec"], dim)[0], signatures(cell["sig"])
        one = bool(cell["bi"].iloc[0] == cell["bj"].iloc[0])
        rows, cols = (np.arange(len(ids)),) * 2 if one else (np.flatnonzero(~right), np.flatnonzero(right))
        of = unit[cols].T
        step = max(1, COMPARED // max(1, len(cols)))
        for lo in range(0, len(rows) if len(cols) else 0, step):
            a = rows[lo:lo + step]
            product = unit[a] @ of
            i, j = np.nonzero(product >= 1.0 - threshold - 1e-9)  # rounded are only those that may count
            dist = np.round(1.0 - product[i, j], DIGITS)
            i, j = a[i], cols[j]
            keep = dist <= threshold
            if one:  # each pair twice, and every row with itself
                keep &= ids[i] < ids[j]
            i, j, dist = i[keep], j[keep], dist[keep]
            agree = np.zeros(len(i), dtype=bool)
            for at in range(0, len(i), part):
                agree[at:at + part] = (sig[i[at:at + part]] == sig[j[at:at + part]]).any(axis=1)
            i, j, dist = i[agree], j[agree], dist[agree]
            swap = ids[i] > ids[j]
            yield pd.DataFrame({"src": ids[np.where(swap, j, i)], "dst": ids[np.where(swap, i, j)], "distance": dist})

    part = 1 << 14  # signatures compared at once
    return _by_cell(dealt, ["bi", "bj"], score, schema)


def _by_cell(dealt: DataFrame, group: list[str], score, schema: T.StructType) -> DataFrame:
    """``score`` of every group of rows, one group in memory at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            names = batch[group].to_numpy()
            cut = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for lo, hi in zip(cut[:-1], cut[1:]):
                if lo == hi:
                    continue
                if held and (held[-1][group].iloc[-1].to_numpy() != names[lo]).any():
                    yield from score(pd.concat(held, ignore_index=True))
                    held = []
                held.append(batch.iloc[lo:hi])
        if held:
            yield from score(pd.concat(held, ignore_index=True))

    cells = dealt.repartition(*group).sortWithinPartitions(*group)
    return cells.mapInPandas(run, schema)
