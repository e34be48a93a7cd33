"""Exact cosine-distance search between a query set and a cache of vectors.

Nearest-cached-prompt lookup (KNN, k=1) and the all-pairs-within-tau join are
both answered by one distributed grid join:

* each side is hashed into blocks (``pmod(xxhash64(id), n_blocks)``) sized
  from a per-cell memory budget; query rows are replicated once per cache
  block and cache rows once per query block, so every (query block, cache
  block) cell is one co-group of bounded size, and equal memory-sized blocks
  move the least data (a cache that fits one cell moves the queries once);
* each cell is scored by a single matrix product in an Arrow-batched pandas
  function (``cogroup().applyInPandas``), which emits only the per-query winner
  (KNN) or only the pairs within tau — never the full pair matrix;
* KNN winners of the cells are reduced with ``min(struct(distance, key))``
  (partial aggregation before the shuffle), which also gives the tie-break:
  equal distances (rounded to 12 digits) go to the smallest key.

Nothing is collected to the driver; block sizes, not the data, bound the
memory of a task. With a pivot index (:mod:`cachescope.operators.pivots`) of the cache
the cells are its blocks, and a query is copied only to blocks that can hold what is
asked for; results are those of the grid. Vectors are compared in float64; rows whose vector has the
wrong dimension or zero norm never match (a query with no valid candidate is a
miss with no match).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, parallelism
from .pivots import PivotIndex, lengths

CELL_BYTES = 32 << 20          # float64 vectors of one grid cell (both sides together); a task holds several copies
DIST_BYTES = 16 << 20          # distance block scored at once inside a cell
DEFAULT_BLOCK_ROWS = None      # None: size blocks from CELL_BYTES and the dimension
MIN_BLOCK_ROWS = 64
DIGITS = 12                    # distances are rounded: ties and "<= tau" don't depend on the blocks
WORK_PER_CELL = 2e8            # multiply-adds that justify a task of their own


def _block_counts(spark, n_q: int, n_c: int, block_rows: int | None,
                  cache_block_rows: int | None = None, dim: int = 768) -> tuple[int, int]:
    """Grid shape. Every query row is copied once per cache block and every
    cache row once per query block, so the data moved is
    |Q|*|C|*(1/rows_c + 1/rows_q): smallest with equal, memory-sized blocks
    (CELL_BYTES of float64 vectors per cell). A cache that fits one cell is
    copied to each query block and the queries move once.
    Cells are added beyond what memory needs only while each still gets about
    WORK_PER_CELL multiply-adds: below that, task overhead beats the product."""
    side = max(MIN_BLOCK_ROWS, CELL_BYTES // (2 * 8 * max(dim, 1)))
    qb = max(1, math.ceil(n_q / (block_rows or side)))
    cb = max(1, math.ceil(n_c / (cache_block_rows or block_rows or side)))
    work_cells = math.ceil(n_q * n_c * max(dim, 1) / WORK_PER_CELL)
    target = min(parallelism(spark), max(1, work_cells))
    while qb * cb < target:
        grow_q = n_q / (qb + 1) >= MIN_BLOCK_ROWS
        grow_c = n_c / (cb + 1) >= MIN_BLOCK_ROWS
        if not (grow_q or grow_c):
            break
        if grow_q and (qb <= cb or not grow_c):
            qb += 1
        else:
            cb += 1
    return qb, cb


def _chunk_rows(n_cache: int) -> int:
    """Query rows per scoring step so the distance block stays near DIST_BYTES."""
    return max(1, DIST_BYTES // (8 * max(n_cache, 1)))


def _distances(queries: np.ndarray, cache: np.ndarray) -> np.ndarray:
    """Rounded cosine distances of unit rows, in one array."""
    dist = queries @ cache.T
    np.subtract(1.0, dist, out=dist)
    return np.round(dist, DIGITS, out=dist)


def _matrix(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Stack vectors into a unit-normalised float64 matrix; mask of valid rows."""
    n = len(vectors)
    mat = np.zeros((n, dim), dtype=np.float64)
    ok = lengths(vectors) == dim
    if ok.any():
        mat[ok] = np.stack(vectors.to_numpy()[ok])
    norms = np.linalg.norm(mat, axis=1)
    ok &= norms > 0
    mat[ok] /= norms[ok, None]
    return mat, ok


def _prepare(queries: DataFrame, cache: DataFrame, qid: str, qvec: str, key: str, cvec: str,
             q_extra: list[Column], c_extra: list[Column], block_rows: int | None,
             cache_block_rows: int | None = None, counts: tuple[int, int] | None = None,
             dim: int = 768):
    spark = queries.sparkSession
    if counts is not None:
        n_q, n_c = counts
    else:
        n_q = queries.count()
        n_c = n_q if cache is queries else cache.count()
    qb, cb = _block_counts(spark, n_q, n_c, block_rows, cache_block_rows, dim)
    q = queries.select(
        F.col(qid).alias("qid"), F.col(qvec).alias("qvec"), *q_extra,
        F.pmod(F.xxhash64(F.col(qid)), F.lit(qb)).alias("qblock"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cb - 1).cast("long"))).alias("cblock"))
    c = cache.select(
        F.col(key).alias("ckey"), F.col(cvec).alias("cvec"), *c_extra,
        F.pmod(F.xxhash64(F.col(key)), F.lit(cb)).alias("cblock"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qb - 1).cast("long"))).alias("qblock"))
    return q, c, qb, cb


def _dealt(index: PivotIndex, queries: DataFrame, rows: DataFrame, qid: str, qvec: str, key: str, cvec: str,
           q_extra: list[Column], c_extra: list[Column], limit: Column, blocks: str,
           block_rows: int | None, n_q: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries dealt to blocks of a pivot index, and the rows of these blocks. ``blocks`` says
    which: ``home``, ``near`` (the home block too, so that every query is in a cell), or ``rest``
    (near without home). Queries of a block are cut by hash, as in the grid, to bound a cell."""
    side = block_rows or max(MIN_BLOCK_ROWS, CELL_BYTES // (2 * 8 * max(index.dim, 1)))
    qb = max(1, math.ceil((queries.count() if n_q is None else n_q) / side))
    at = F.inline(F.array(index.blocks_near(queries.sparkSession, F.col("qvec"), F.col("_limit"))))
    home = F.array("home")
    chosen = {"home": home, "near": F.array_union("near", home), "rest": F.array_except("near", home)}[blocks]
    named = queries.select(F.col(qid).alias("qid"), F.col(qvec).alias("qvec"), *q_extra, limit.cast("double").alias("_limit"))
    q = named.select("*", at).drop("_limit").withColumn("cblock", F.explode(chosen)).drop("home", "near").withColumn(
        "qblock", F.pmod(F.xxhash64("qid"), F.lit(qb)))
    c = rows.select(F.col(key).alias("ckey"), F.col(cvec).alias("cvec"), *c_extra, "cblock",
                    F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qb - 1).cast("long"))).alias("qblock"))
    return q, c


class Stretches:
    """Queries with orders from ``first`` up to (not with) ``last``, cut into stretches of ``rows`` orders.

    A cache row meets the stretches between its ``order`` and its ``until`` only, in one of ``parts``
    cells chosen by its key. Stretches are as long as rows live on average, within what a cell
    holds and what justifies one, and a stretch with many living rows has them in several cells."""

    def __init__(self, cache: DataFrame, first: int, last: int, order: str, until: str, dim: int,
                 block_rows: int | None = None):
        self.first, self.last, self.order, self.until = first, last, order, until
        side = block_rows or max(MIN_BLOCK_ROWS, CELL_BYTES // (2 * 8 * max(dim, 1)))
        life = F.least(F.col(until), F.lit(last)) - F.greatest(F.col(order), F.lit(first))
        mean = (cache.agg(F.sum(F.greatest(life, F.lit(0)).cast("double"))).first()[0] or 0) / max(1, last - first)
        self.rows = block_rows or min(side, max(MIN_BLOCK_ROWS, math.ceil(mean), math.isqrt(int(WORK_PER_CELL) // max(dim, 1))))
        met = cache.select(self._met().alias("s")).groupBy("s").count().agg(F.max("count")).first()[0]
        self.parts = max(1, math.ceil((met or 0) / side))

    def _met(self) -> Column:
        at = lambda order: F.expr(f"({order} - {self.first}L) div {self.rows}")
        begin = at(f"greatest({self.order} + 1, {self.first}L)")
        end = at(f"least({self.until}, {self.last - 1}L)")
        return F.explode(F.when(begin <= end, F.sequence(begin, end)).otherwise(F.array().cast("array<bigint>")))

    def deal(self, queries: DataFrame, cache: DataFrame, qid: str, qvec: str, key: str, cvec: str,
             q_extra: list[Column], c_extra: list[Column]) -> tuple[DataFrame, DataFrame]:
        q = queries.select(F.col(qid).alias("qid"), F.col(qvec).alias("qvec"), *q_extra,
                           F.expr(f"({self.order} - {self.first}L) div {self.rows}").alias("qblock"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.parts - 1).cast("long"))).alias("cblock"))
        c = cache.select(F.col(key).alias("ckey"), F.col(cvec).alias("cvec"), *c_extra,
                         F.pmod(F.xxhash64(F.col(key)), F.lit(self.parts)).alias("cblock"), self._met().alias("qblock"))
        return q, c


def knn1(queries: DataFrame, cache: DataFrame, *, query_id: str = "query_id",
         query_vec: str = "embedding", cache_key: str = "key", cache_vec: str = "embedding",
         dim: int, exclude_self: bool = False, order: str | None = None,
         arrival: str | None = None, available: str | None = None, until: str | None = None,
         block_rows: int | None = DEFAULT_BLOCK_ROWS,
         cache_block_rows: int | None = None, counts: tuple[int, int] | None = None,
         index: PivotIndex | None = None, within: float | None = None,
         stretches: Stretches | None = None) -> DataFrame:
    """Nearest cache entry for every query row (query ids must be unique).

    Returns ``query_id, match_key, distance`` with one row per query; queries
    without any valid candidate get nulls. ``exclude_self`` skips candidates
    whose key equals the query id (leave-one-out search of a table against
    itself). With ``order`` (numeric, on both sides) only candidates strictly
    earlier than the query count, and with ``available`` (cache side) only
    those visible at the query's ``arrival`` (default: its order), with ``until``
    (cache side) only those whose ``until`` is not before the query's order; the columns
    are compared in their own types, so integers stay exact. With a pivot ``index`` of
    the cache (``cache`` is then some or all of its rows, with ``cblock``) blocks that
    cannot hold the nearest are skipped; ``within`` says that a neighbour farther than
    that need not be found, which saves the first of its two steps. With ``stretches`` (of
    ``order`` and ``until``) queries meet only rows that live in their stretch. ``dim`` is the
    dimension: vectors of another one never match. ``counts`` = (queries,
    cache) row counts when already known (saves two jobs).
    """
    qtype = queries.schema[query_id].dataType
    ktype = cache.schema[cache_key].dataType
    q_extra = [F.col(order).alias("qord"), F.col(arrival or order).alias("qat")] if order else []
    c_extra = [F.col(order).alias("cord"), F.col(available or order).alias("cavail"),
               *([F.col(until).alias("cuntil")] if until else [])] if order else []
    schema = T.StructType([T.StructField("qid", qtype), T.StructField("match_key", ktype),
                           T.StructField("distance", T.DoubleType())])

    def score(qdf: pd.DataFrame, cdf: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty:
            return pd.DataFrame({"qid": [], "match_key": [], "distance": []})
        qm, qok = _matrix(qdf["qvec"], dim)
        out_key = pd.Series([None] * len(qdf), dtype=object)
        out_d = np.full(len(qdf), np.nan)
        if not cdf.empty:
            cdf = cdf.sort_values("ckey", kind="stable")     # argmin's first hit = smallest key
            cm, cok = _matrix(cdf["cvec"], dim)
            ckeys = cdf["ckey"].to_numpy()[cok]
            cm = cm[cok]
            if order:
                cord, cavail = cdf["cord"].to_numpy()[cok], cdf["cavail"].to_numpy()[cok]
                qord, qat = qdf["qord"].to_numpy(), qdf["qat"].to_numpy()
                cend = cdf["cuntil"].to_numpy()[cok] if until else None
            qids = qdf["qid"].to_numpy()
            step = _chunk_rows(len(ckeys))
            for lo in range(0, len(qdf) if len(ckeys) else 0, step):
                hi = min(lo + step, len(qdf))
                dist = _distances(qm[lo:hi], cm)
                dist[~qok[lo:hi]] = np.inf
                if exclude_self:
                    dist[qids[lo:hi, None] == ckeys[None, :]] = np.inf
                if order:
                    dist[~((cord[None, :] < qord[lo:hi, None]) & (cavail[None, :] <= qat[lo:hi, None]))] = np.inf
                    if until:
                        dist[cend[None, :] < qord[lo:hi, None]] = np.inf
                best = np.argmin(dist, axis=1)
                bd = dist[np.arange(hi - lo), best]
                found = np.isfinite(bd)
                out_d[lo:hi][found] = bd[found]
                out_key.iloc[np.arange(lo, hi)[found]] = ckeys[best[found]]
        return pd.DataFrame({"qid": qdf["qid"].to_numpy(), "match_key": out_key,
                             "distance": out_d})

    def run(q: DataFrame, c: DataFrame) -> DataFrame:
        cells = (q.groupBy("qblock", "cblock")
                 .cogroup(c.groupBy("qblock", "cblock"))
                 .applyInPandas(score, schema))
        return cells.withColumn("distance", F.nanvl("distance", F.lit(None).cast("double")))

    if stretches is not None:
        cb = stretches.parts
        cells = run(*stretches.deal(queries, cache, query_id, query_vec, cache_key, cache_vec, q_extra, c_extra))
    elif index is None:
        q, c, _, cb = _prepare(queries, cache, query_id, query_vec, cache_key, cache_vec, q_extra,
                               c_extra, block_rows, cache_block_rows, counts, dim)
        cells = run(q, c)
    else:
        cb = 2  # any number of blocks
        deal = lambda rows, limit, blocks: _dealt(
            index, rows, cache, query_id, query_vec, cache_key, cache_vec, q_extra, c_extra, limit, blocks,
            block_rows, counts[0] if counts else None)
        if within is not None:
            cells = run(*deal(queries, F.lit(within), "near"))
        else:
            first = materialise(run(*deal(queries, F.lit(0.0), "home")), "knn-home")
            bound = first.select(F.col("qid").alias("_qid"), F.col("distance").alias("_bound"))
            bounded = queries.join(bound, F.col(query_id) == F.col("_qid"))
            cells = first.unionByName(run(*deal(bounded, F.col("_bound"), "rest")))
    if cb > 1:
        best = cells.groupBy("qid").agg(
            F.min(F.when(F.col("match_key").isNotNull(),
                         F.struct("distance", "match_key"))).alias("b"))
        cells = best.select("qid", F.col("b.match_key").alias("match_key"),
                            F.col("b.distance").alias("distance"))
    return cells.select(F.col("qid").alias(query_id), "match_key", "distance")


def pairs_within(queries: DataFrame, cache: DataFrame, threshold: float, *,
                 query_id: str = "query_id", query_vec: str = "embedding",
                 cache_key: str = "key", cache_vec: str = "embedding",
                 dim: int, order: str | None = None, available: str | None = None,
                 exclude_self: bool = True,
                 block_rows: int | None = DEFAULT_BLOCK_ROWS, cache_block_rows: int | None = None,
                 index: PivotIndex | None = None) -> DataFrame:
    """All (query, cache) pairs with cosine distance <= threshold.

    With ``order`` (a numeric column present on both sides) only pairs where the
    cache row comes strictly earlier are kept; ``available`` (cache side) further
    requires ``available <= order`` of the query, i.e. the entry was already
    stored when the query arrived. With a pivot ``index`` of the cache (``cache`` is
    then its rows, with ``cblock``) blocks that hold none are skipped. Returns
    ``query_id, match_key, distance``.
    """
    qtype = queries.schema[query_id].dataType
    ktype = cache.schema[cache_key].dataType
    q_extra = [F.col(order).alias("qord")] if order else []
    c_extra = []
    if order:
        c_extra.append(F.col(order).alias("cord"))
        c_extra.append(F.col(available or order).alias("cavail"))
    q, c = (_prepare(queries, cache, query_id, query_vec, cache_key, cache_vec, q_extra, c_extra, block_rows,
                     cache_block_rows, None, dim)[:2] if index is None else
            _dealt(index, queries, cache, query_id, query_vec, cache_key, cache_vec, q_extra, c_extra,
                   F.lit(threshold), "near", block_rows))
    schema = T.StructType([T.StructField("qid", qtype), T.StructField("match_key", ktype),
                           T.StructField("distance", T.DoubleType())])

    def score(qdf: pd.DataFrame, cdf: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty or cdf.empty:
            return pd.DataFrame({"qid": [], "match_key": [], "distance": []})
        qm, qok = _matrix(qdf["qvec"], dim)
        cm, cok = _matrix(cdf["cvec"], dim)
        qids, ckeys = qdf["qid"].to_numpy(), cdf["ckey"].to_numpy()
        parts = []
        step = _chunk_rows(len(cdf))
        for lo in range(0, len(qdf), step):
            hi = min(lo + step, len(qdf))
            dist = _distances(qm[lo:hi], cm)
            keep = (dist <= threshold) & qok[lo:hi, None] & cok[None, :]
            if exclude_self:
                keep &= qids[lo:hi, None] != ckeys[None, :]
            if order:
                qo = qdf["qord"].to_numpy()[lo:hi, None]
                keep &= (cdf["cord"].to_numpy()[None, :] < qo) & (cdf["cavail"].to_numpy()[None, :] <= qo)
            qi, ci = np.nonzero(keep)
            parts.append(pd.DataFrame({"qid": qids[lo + qi], "match_key": ckeys[ci],
                                       "distance": dist[qi, ci]}))
        return pd.concat(parts, ignore_index=True)

    out = (q.groupBy("qblock", "cblock")
           .cogroup(c.groupBy("qblock", "cblock"))
           .applyInPandas(score, schema))
    return out.select(F.col("qid").alias(query_id), "match_key", "distance")


def hit_decision(nearest: DataFrame, threshold: float, *, distance: str = "distance",
                 match: str = "match_key") -> DataFrame:
    """HIT when the nearest distance <= threshold (inclusive); otherwise MISS.
    No candidate (empty cache, bad vector) is a MISS at distance 0."""
    return nearest.select(
        *[c for c in nearest.columns if c != distance],
        F.coalesce(F.col(distance), F.lit(0.0)).alias(distance),
        F.when(F.col(match).isNotNull() & (F.col(distance) <= F.lit(threshold)), F.lit("HIT"))
        .otherwise(F.lit("MISS")).alias("outcome"))


def near_misses(nearest: DataFrame, threshold: float, *, distance: str = "distance",
                match: str = "match_key") -> DataFrame:
    """A neighbour was found but is farther than the threshold (response withheld)."""
    return nearest.where(F.col(match).isNotNull() & (F.col(distance) > F.lit(threshold)))


def with_match(decided: DataFrame, cache: DataFrame, *, match: str = "match_key",
               cache_key: str = "key", fields: tuple[str, ...] = ("original_text", "response_text")
               ) -> DataFrame:
    """Attach the matched entry's text and response (only key + distance went
    through the search; the wide columns are joined back once here)."""
    right = cache.select(F.col(cache_key).alias(match), *fields)
    return decided.join(right, match, "left")


def neighbor_counts(queries: DataFrame, cache: DataFrame, threshold: float, *,
                    query_id: str = "query_id", query_vec: str = "embedding",
                    cache_key: str = "key", cache_vec: str = "embedding",
                    dim: int, order: str | None = None, available: str | None = None,
                    exclude_self: bool = True,
                    block_rows: int | None = DEFAULT_BLOCK_ROWS, cache_block_rows: int | None = None,
                    index: PivotIndex | None = None) -> DataFrame:
    """Per query: how many candidates lie within ``threshold`` and the nearest
    one — "is any cached prompt close enough", without emitting the pairs.

    Cells emit one row per query (count, nearest); cells are summed per query,
    so a dense group of near-copies costs compute but never output rows. With a
    pivot ``index`` of the cache blocks that hold none within ``threshold`` are skipped, and
    the nearest is given only where one lies within it.
    Returns ``query_id, n_within, match_key, distance``.
    """
    qtype = queries.schema[query_id].dataType
    ktype = cache.schema[cache_key].dataType
    q_extra = [F.col(order).alias("qord")] if order else []
    c_extra = ([F.col(order).alias("cord"),
                F.col(available or order).alias("cavail")] if order else [])
    q, c = (_prepare(queries, cache, query_id, query_vec, cache_key, cache_vec, q_extra, c_extra, block_rows,
                     cache_block_rows, None, dim)[:2] if index is None else
            _dealt(index, queries, cache, query_id, query_vec, cache_key, cache_vec, q_extra, c_extra,
                   F.lit(threshold), "near", block_rows))
    schema = T.StructType([T.StructField("qid", qtype), T.StructField("n_within", T.LongType()),
                           T.StructField("match_key", ktype), T.StructField("distance", T.DoubleType())])

    def score(qdf: pd.DataFrame, cdf: pd.DataFrame) -> pd.DataFrame:
        n = len(qdf)
        counts = np.zeros(n, dtype=np.int64)
        keys = pd.Series([None] * n, dtype=object)
        dists = np.full(n, np.nan)
        if n and not cdf.empty:
            cdf = cdf.sort_values("ckey", kind="stable")
            qm, qok = _matrix(qdf["qvec"], dim)
            cm, cok = _matrix(cdf["cvec"], dim)
            qids, ckeys = qdf["qid"].to_numpy(), cdf["ckey"].to_numpy()
            step = _chunk_rows(len(cdf))
            for lo in range(0, n, step):
                hi = min(lo + step, n)
                dist = _distances(qm[lo:hi], cm)
                dist[~qok[lo:hi]] = np.inf
                dist[:, ~cok] = np.inf
                if exclude_self:
                    dist[qids[lo:hi, None] == ckeys[None, :]] = np.inf
                if order:
                    qo = qdf["qord"].to_numpy()[lo:hi, None]
                    dist[~((cdf["cord"].to_numpy()[None, :] < qo)
                           & (cdf["cavail"].to_numpy()[None, :] <= qo))] = np.inf
                counts[lo:hi] = (dist <= threshold).sum(axis=1)
                best = np.argmin(dist, axis=1)
                bd = dist[np.arange(hi - lo), best]
                found = np.isfinite(bd)
                dists[lo:hi][found] = bd[found]
                keys.iloc[np.arange(lo, hi)[found]] = ckeys[best[found]]
        return pd.DataFrame({"qid": qdf["qid"].to_numpy(), "n_within": counts, "match_key": keys,
                             "distance": dists})

    cells = (q.groupBy("qblock", "cblock")
             .cogroup(c.groupBy("qblock", "cblock"))
             .applyInPandas(score, schema)
             .withColumn("distance", F.nanvl("distance", F.lit(None).cast("double"))))
    if index is not None:
        cells = cells.withColumn("match_key", F.when(F.col("distance") <= threshold, F.col("match_key")))
    out = cells.groupBy("qid").agg(
        F.sum("n_within").cast("bigint").alias("n_within"),
        F.min(F.when(F.col("match_key").isNotNull(), F.struct("distance", "match_key"))).alias("b"))
    return out.select(F.col("qid").alias(query_id), "n_within", F.col("b.match_key").alias("match_key"),
                      F.col("b.distance").alias("distance"))


def cache_lookup(requests: DataFrame, cache: DataFrame, threshold: float, *,
                 request_id: str = "request_id", request_vec: str = "embedding",
                 cache_key: str = "key", cache_vec: str = "embedding",
                 dim: int) -> DataFrame:
    """The gateway's lookup for a batch of requests against a cache table.

    Nearest entry (only key and distance go through the grid), HIT when within
    ``threshold``, then the matched entry's prompt joined back once. A hit
    carries the cached response; a near miss reports distance and matched
    prompt but withholds the response; no candidate is a MISS at distance 0.
    Returns ``request_id, outcome, distance, match_key, matched_prompt, response``.
    """
    nearest = knn1(requests, cache, query_id=request_id, query_vec=request_vec, cache_key=cache_key,
                   cache_vec=cache_vec, dim=dim)
    decided = hit_decision(nearest, threshold)
    enriched = with_match(decided, cache, cache_key=cache_key)
    hit = F.col("outcome") == "HIT"
    return enriched.select(
        request_id, "outcome", "distance", "match_key",
        F.col("original_text").alias("matched_prompt"),
        F.when(hit, F.col("response_text")).alias("response"))
