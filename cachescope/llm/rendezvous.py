"""Operator 4: weighted rendezvous sharding of stable record keys.

Every (key, shard) pair has its own 64-bit hash, turned into a score
``-ln(u) / weight`` with ``u`` in (0, 1); the shard with the smallest score takes the
record. A shard's score for a key does not depend on the other shards, so one more
shard takes only the records it now wins and no record moves between old shards; a
shard of weight ``w`` receives a share of ``w / sum(w)`` in expectation.

Slots number the records of a shard without gaps. A shard holds a growing share of
all rows, so no task numbers a whole shard: rows are numbered in hash buckets, and a
prefix sum over the (shard, bucket) counts - shards x buckets rows, both parameters -
gives each bucket its base.

Defined cases: a null key is a key of its own (one shard); null text has size 1, the
crc32 of no bytes (0); repeated rows get slots of their own; an empty table gives an
empty result; columns of the input named like an output column are replaced by it, all others kept,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_apart, row_hash

#: Hash buckets in which the rows of a shard are numbered.
SLOT_BUCKETS = 1024


def _unit(hash64: Column) -> Column:
    """A hash as a number strictly between 0 and 1 (its upper 52 bits)."""
    return (F.shiftrightunsigned(hash64, 12).cast("double") + 0.5) / F.lit(float(2**52))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard (0-based) that wins the weighted rendezvous for ``key``."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = [
        F.struct((-F.log(_unit(F.xxhash64(key.isNull(), key, F.lit(i)))) / F.lit(float(w))).alias("score"),
                 F.lit(i).alias("shard"))
        for i, w in enumerate(weights)
    ]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


@columns_apart("key", "text")
def assign(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text",
           grown_weights: Sequence[float] | None = None, buckets: int = SLOT_BUCKETS,
           keep_text: bool = True) -> DataFrame:
    """``docs`` with ``size, text_crc32, law, shard, slot, grown_shard``.

    ``grown_weights`` is the shard set after growth (for ``grown_shard``); slots follow
    (bucket, key, crc32) and depend on the rows alone, not on their order or files.
    ``keep_text=False`` drops the text, so that only narrow rows are shuffled.
    """
    out = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    cols = [c for c in docs.columns if c not in out]
    hashed = _hashable(docs, cols)
    cols = [c for c in cols if keep_text or c != text]
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(
        *[docs[c] for c in cols],
        (F.octet_length(body).cast("bigint") + 1).alias("size"),
        F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(docs[key], weights).alias("shard"),
        (shard_of(docs[key], grown_weights) if grown_weights else F.lit(None).cast("int")).alias("grown_shard"),
        # every hashable column, so that rows that only share a key are spread as well
        F.pmod(row_hash(docs, *hashed), F.lit(buckets)).cast("int").alias("_bucket"),
    )
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select("shard", "_bucket", (F.sum("_n").over(
        Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")).alias("_base"))
    at = Window.partitionBy("shard", "_bucket").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    return (rows.withColumn("_rank", F.row_number().over(at))
            .join(base, ["shard", "_bucket"])
            .withColumn("slot", F.col("_base") + F.col("_rank") - 1)
            .select(*cols, *out))


def _hashable(df: DataFrame, cols: Sequence[str]) -> list[str]:
    kinds = dict(df.dtypes)
    return [c for c in cols if not kinds[c].startswith(("map", "variant"))]
