"""Pivot index: exact vector search that skips blocks which cannot hold a neighbour.

The angle between vectors is a metric, so with ``a`` the angle of a query to a pivot and
``[low, high]`` the angles of a block's vectors to it, no vector of the block is nearer to the
query than ``max(low - a, a - high)``. A block is shipped to a query only if that bound, the
largest over all pivots, is within the distance asked for.

* Pivots are spread over a bounded hash sample (each next one is the sample vector farthest
  from those before); they decide the speed, never the result.
* A vector belongs to its nearest pivot and, there, to a ring of angles. Rings are merged
  or split (by key hash) into blocks of about ``block_rows`` rows, from one table of counts per
  (pivot, ring). A query is copied to every block that may hold a neighbour, which among vectors
  without clusters are all: in a table of more than ``FEW_BLOCKS`` times ``block_rows`` rows the
  blocks grow with it, up to ``BLOCK_BYTES``, and only then does their number. There are at most ``MAX_BLOCKS``
  and as many again as there are rings: with more rows the blocks grow again, so what is
  broadcast - the angles of every block to every pivot - has a fixed bound, 16 MB, whatever
  the number of vectors.
* A nearest neighbour is searched in two steps: in the block that looks nearest, which
  bounds the distance, then in the blocks within that bound.

Vectors of another dimension, or of norm zero, are in no block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Pivots at most, and the sample they are chosen from.
MAX_PIVOTS, SAMPLE_ROWS = 64, 2048
#: Rows of a block wherever that gives no more than MAX_BLOCKS blocks.
BLOCK_ROWS, MAX_BLOCKS = 4096, 16384
#: Blocks from which on they grow with the table, and the float64 vectors up to which they do.
FEW_BLOCKS, BLOCK_BYTES = 64, 16 << 20
#: Rings of angles around a pivot.
RINGS = 64
#: Angles are compared with this much to spare, for rounding.
SPARE = 1e-6
#: Bounds that are worked out at once, in bytes.
BOUND_BYTES = 32 << 20


def lengths(vectors: pd.Series) -> np.ndarray:
    """Entries of each vector, -1 for none. (The ``str`` accessor would do, but it and the series
    hold each other, so that a task keeps the vectors of one cell after another.)"""
    return np.fromiter((len(v) if hasattr(v, "__len__") else -1 for v in vectors.to_numpy()), dtype="i8", count=len(vectors))


def unit_rows(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zeros where there is none of this dimension) and which rows have one."""
    n = len(vectors)
    mat = np.zeros((n, dim))
    ok = lengths(vectors) == dim
    if ok.any():
        mat[ok] = np.stack(vectors.to_numpy()[ok])
    norms = np.linalg.norm(mat, axis=1)
    ok &= (norms > 0) & np.isfinite(norms)
    mat[~ok] = 0
    mat[ok] /= norms[ok, None]
    return mat, ok


def angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` vectors of a sample, each the farthest from those chosen before it."""
    chosen = [0]
    nearest = angles(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)):
        far = int(nearest.argmax())
        if nearest[far] <= SPARE:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, angles(sample, sample[far:far + 1])[:, 0])
    return sample[chosen]


def ring_blocks(counts: dict[tuple[int, int], int], block_rows: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(first block, blocks) of every (pivot, ring): neighbouring rings of a pivot share a block
    while they fit, a larger ring is split."""
    out, block, held, last = {}, -1, 0, None
    for pivot, ring in sorted(counts):
        n = counts[pivot, ring]
        if n > block_rows:
            parts = math.ceil(n / block_rows)
            out[pivot, ring] = (block + 1, parts)
            block += parts
            held = block_rows  # nothing joins a part
        elif pivot == last and held + n <= block_rows:
            out[pivot, ring] = (block, 1)
            held += n
        else:
            block += 1
            out[pivot, ring] = (block, 1)
            held = n
        last = pivot
    return out


def grown(block_rows: int, n: int, dim: int) -> int:
    """Rows of a block in a table of ``n`` vectors."""
    largest = BLOCK_BYTES // (8 * max(dim, 1))
    return max(block_rows, min(math.ceil(n / FEW_BLOCKS), largest), math.ceil(n / MAX_BLOCKS))


@dataclass
class PivotIndex:
    """``rows`` are those of the cache with ``cblock``; ``low`` and ``high`` the angles of every block
    (row) to every pivot, ``sizes`` the rows of the blocks."""

    pivots: np.ndarray
    rows: DataFrame
    low: np.ndarray
    high: np.ndarray
    sizes: np.ndarray
    dim: int

    def _shared(self, spark):
        if not hasattr(self, "_broadcast"):
            self._broadcast = spark.sparkContext.broadcast((self.pivots, self.low, self.high, self.dim))
        return self._broadcast

    def blocks_near(self, spark, vector: Column, limit: Column) -> Column:
        """(home, near): the block that looks nearest to a vector, and all blocks that may
        hold a vector within the distance ``limit`` (null: any)."""
        shared = self._shared(spark)

        @F.pandas_udf("struct<home: int, near: array<int>>")
        def deal(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            pivots, low, high, dim = shared.value
            step = max(1, BOUND_BYTES // (8 * max(len(low), 1)))
            for vectors, limits in batches:
                unit, ok = unit_rows(vectors, dim)
                a = angles(unit, pivots) if len(pivots) else np.zeros((len(unit), 0))
                reach = np.arccos(np.clip(1.0 - limits.to_numpy("f8"), -1.0, 1.0))
                reach = np.where(np.isnan(reach), np.pi, reach) + SPARE
                home, near = np.zeros(len(unit), dtype="i4"), []
                for at in range(0, len(unit), step):
                    x = a[at:at + step]
                    bound, far = np.zeros((len(x), len(low))), np.zeros((len(x), len(low)))
                    for k in range(x.shape[1]):
                        np.maximum(bound, low[:, k] - x[:, k, None], out=bound)
                        np.maximum(bound, x[:, k, None] - high[:, k], out=bound)
                        far += np.abs(x[:, k, None] - (low[:, k] + high[:, k]) / 2)
                    if len(low):
                        home[at:at + step] = (bound + 1e-3 * far).argmin(axis=1)
                    hit = (bound <= reach[at:at + step, None]) & ok[at:at + step, None]
                    near += [np.flatnonzero(r).astype("i4") for r in hit]
                yield pd.DataFrame({"home": home, "near": near})

        return deal(vector, limit)

    def visited_share(self, queries: DataFrame, vector: str, limit: float) -> float:
        """Share of all (query, cache row) pairs that lie in blocks a search within ``limit`` visits."""
        near = queries.select(self.blocks_near(queries.sparkSession, F.col(vector), F.lit(limit))["near"].alias("n"))
        sizes = F.array(*[F.lit(int(s)) for s in self.sizes])
        got = near.select(F.aggregate("n", F.lit(0).cast("bigint"), lambda s, b: s + F.get(sizes, b)).alias("v")).agg(
            F.sum("v").alias("v"), F.count(F.lit(1)).alias("n")).first()
        return (got.v or 0) / max(1, got.n * int(self.sizes.sum()))


def build(cache: DataFrame, key: str, vector: str, dim: int, *, block_rows: int = BLOCK_ROWS,
          n_pivots: int | None = None) -> PivotIndex:
    """Index a cache table; ``rows`` keeps all its columns."""
    spark = cache.sparkSession
    usable = cache.where(F.size(vector) == dim)
    n = usable.count()
    block_rows = grown(block_rows, n, dim)
    count = n_pivots or min(MAX_PIVOTS, math.ceil(n / block_rows))
    sample = usable.select(F.xxhash64(key).alias("h"), F.col(vector).alias("v")).orderBy("h").limit(SAMPLE_ROWS).toPandas()
    unit, ok = unit_rows(sample["v"], dim)
    if not ok.any():
        none = np.zeros((0, 0))
        return PivotIndex(np.zeros((0, dim)), cache.limit(0).withColumn("cblock", F.lit(0)), none, none,
                          np.zeros(0, dtype="i8"), dim)
    pivots = spread_pivots(unit[ok], max(1, count))
    shared = spark.sparkContext.broadcast((pivots, dim))

    @F.pandas_udf("struct<pivot: int, ring: int>")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p, d = shared.value
        for vectors in batches:
            rows, good = unit_rows(vectors, d)
            a = angles(rows, p)
            nearest = a.argmin(axis=1)
            ring = np.minimum((a[np.arange(len(a)), nearest] * (RINGS / np.pi)).astype("i4"), RINGS - 1)
            yield pd.DataFrame({"pivot": np.where(good, nearest, -1).astype("i4"), "ring": ring})

    placed = materialise(usable.withColumn("_at", place(F.col(vector))).where("_at.pivot >= 0"), "pivot-places")
    counts = placed.groupBy("_at.pivot", "_at.ring").count().collect()  # at most MAX_PIVOTS x RINGS rows
    where = ring_blocks({(r.pivot, r.ring): r["count"] for r in counts}, block_rows)
    table = spark.createDataFrame([(p, r, b, m) for (p, r), (b, m) in where.items()], "_p int, _r int, _b int, _m int")
    rows = materialise(
        placed.join(F.broadcast(table), (F.col("_at.pivot") == F.col("_p")) & (F.col("_at.ring") == F.col("_r")))
        .withColumn("cblock", (F.col("_b") + F.pmod(F.xxhash64(key), F.col("_m"))).cast("int"))
        .select(*cache.columns, "cblock"), "pivot-blocks")
    low, high, sizes = _bounds(rows, vector, pivots, dim, 1 + max(b + m - 1 for b, m in where.values()))
    return PivotIndex(pivots, rows, low, high, sizes, dim)


def _bounds(rows: DataFrame, vector: str, pivots: np.ndarray, dim: int, n_blocks: int):
    """Least and greatest angle of every block's vectors to every pivot, and its rows."""
    shared = rows.sparkSession.sparkContext.broadcast((pivots, dim))

    def merged(held: dict, block: int, low, high, n: int) -> None:
        if block in held:
            old = held[block]
            low, high, n = np.minimum(low, old[0]), np.maximum(high, old[1]), n + old[2]
        held[block] = (low, high, n)

    def packed(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(b, lo.tobytes(), hi.tobytes(), n) for b, (lo, hi, n) in held.items()],
                            columns=["block", "low", "high", "n"])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, d = shared.value
        held: dict = {}
        for batch in batches:
            a = angles(unit_rows(batch["v"], d)[0], p)
            for block, at in batch.groupby("b").indices.items():
                merged(held, int(block), a[at].min(axis=0), a[at].max(axis=0), len(at))
        yield packed(held)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for r in batch.itertuples():
                merged(held, r.block, np.frombuffer(r.low), np.frombuffer(r.high), r.n)
        yield packed(held)

    schema = "block int, low binary, high binary, n long"
    parts = rows.select(F.col("cblock").alias("b"), F.col(vector).alias("v")).mapInPandas(measure, schema)
    low, high, sizes = (np.zeros((n_blocks, len(pivots))), np.zeros((n_blocks, len(pivots))), np.zeros(n_blocks, dtype="i8"))
    for r in parts.repartition("block").mapInPandas(merge, schema).collect():  # blocks x pivots angles
        low[r.block], high[r.block], sizes[r.block] = np.frombuffer(bytes(r.low)), np.frombuffer(bytes(r.high)), r.n
    return low, high, sizes
