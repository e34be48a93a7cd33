"""Shared helpers of the training-data operators."""

from __future__ import annotations

import functools
import inspect
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Words of a text wherever a word count is asked for: runs of anything but ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: The same white space as characters, for trims.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike a cached or locally checkpointed frame the files outlive the executors
    that wrote them, and later readers prune columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns_apart(*params: str, keep: tuple[str, ...] = ()):
    """Keep the caller's columns apart from an operator's own.

    Decorates an operator whose first argument is a table and whose ``params`` name the
    columns it works on (those in ``keep`` it also knows, if they are there). All others are
    renamed by their place before the operator sees them, and get their names back in its
    result, so no name of theirs can meet one inside; one that is also an output's gives way
    to the output.
    """
    def decorate(op):
        signature = inspect.signature(op)

        @functools.wraps(op)
        def run(df: DataFrame, *args, **kwargs):
            bound = signature.bind(df, *args, **kwargs)
            bound.apply_defaults()
            used = {bound.arguments[p] for p in params} | set(keep)
            away = {c: f"_user{k}" for k, c in enumerate(df.columns) if c not in used}
            out = op(df.toDF(*[away.get(c, c) for c in df.columns]), *args, **kwargs)
            back = {v: k for k, v in away.items()}
            taken = {c for c in out.columns if c not in back}
            return out.select(*[F.col(c).alias(back[c]) if c in back else F.col(c)
                                for c in out.columns if back.get(c) not in taken])

        return run

    return decorate


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def word_count(text: Column) -> Column:
    """Number of words as bigint; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("bigint")


def row_hash(df: DataFrame, *names: str) -> Column:
    """A 64-bit hash of the named columns of a row; nulls are told from empty values.

    Used to spread rows over buckets, never as an identity.
    """
    cols = []
    for n in names:
        c = df[n]
        cols += [c.isNull().cast("int"), c]
    return F.xxhash64(*cols)


def slices(texts: list[str], max_rows: int, max_chars: int):
    """Cut a batch of texts into runs of bounded rows and characters (a text longer than
    the bound is a run of its own)."""
    run: list[str] = []
    chars = 0
    for t in texts:
        if run and (len(run) >= max_rows or chars + len(t) > max_chars):
            yield run
            run, chars = [], 0
        run.append(t)
        chars += len(t)
    if run:
        yield run


#: Bits of the filters of ``maybe_in`` (8 MB): fixed, whatever the number of keys.
FILTER_BITS = 1 << 26


def filter_of(keys: DataFrame, column: str):
    """A Bloom filter of the 64-bit hashes in ``column``: an array of FILTER_BITS bits.

    Its 32-bit words are put together in Spark and reach the driver packed, a few rows of
    bytes from each task and 16 MB in all, whatever the number of keys.
    """
    import numpy as np

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_pydict({
                    "w": pa.array([b.column(0).to_numpy(zero_copy_only=False).astype("<u4").tobytes()], pa.binary()),
                    "b": pa.array([b.column(1).to_numpy(zero_copy_only=False).astype("<u4").tobytes()], pa.binary())})

    k = F.col(column)
    places = F.explode(F.array(F.pmod(k, F.lit(FILTER_BITS)), F.pmod(F.shiftright(k, 31), F.lit(FILTER_BITS))))
    got = (keys.select(places.alias("p")).groupBy(F.shiftright("p", 5).alias("w"))
           .agg(F.bit_or(F.expr("shiftleft(1L, int(pmod(p, 32)))")).alias("b"))
           .mapInArrow(pack, "w binary, b binary"))
    words = np.zeros(FILTER_BITS // 32, dtype="u4")
    for r in got.collect():  # at most FILTER_BITS / 32 words
        words[np.frombuffer(bytes(r.w), "<u4")] = np.frombuffer(bytes(r.b), "<u4")
    return words


def passes(words, x):
    """Which of the hashes ``x`` (signed 64-bit array) may be in the filter."""
    hit = True
    for p in (x & (FILTER_BITS - 1), (x >> 31) & (FILTER_BITS - 1)):
        hit = hit & (words[p >> 5] >> (p & 31).astype("u4") & 1).astype(bool)
    return hit


def maybe_in(h: Column, keys: DataFrame, column: str) -> Column:
    """Whether a 64-bit hash may be among those in ``column`` of ``keys``.

    Keeps wide rows that surely have no partner out of a shuffle. The filter has a fixed
    size, so it is safe to send to every task; with very many keys it lets more rows
    pass, and the join that follows decides anyway.
    """
    import pandas as pd

    shared = keys.sparkSession.sparkContext.broadcast(filter_of(keys, column))
    return F.pandas_udf(lambda s: pd.Series(passes(shared.value, s.to_numpy("i8"))), "boolean")(h)
