"""Operator 13: packing by power-of-two decomposition.

The token ids of a document (with its end id) are cut into pieces of power-of-two
lengths, the largest first: as many of ``max_len`` as fit, then one piece for every set
bit of what is left. Every piece is a training sequence of its own, so no sequence
crosses documents, none needs padding, and no id is lost. Sequences of one length form a
bucket, from which batches of one shape are drawn.

1. One scan encodes the texts and writes their pieces (the ids as bytes) to the shared
   folder. A document gives at most ``n / max_len + log2(max_len)`` pieces.
2. Sequences are numbered: buckets one after another, the longest first, and inside a
   bucket in the order of a hash of the piece, which also shuffles them for training. No
   task holds a bucket: the hash's upper bits cut every bucket into ``SLOT_RANGES`` ranges,
   a prefix sum over the (length, range) counts - a bounded table - gives each its base, and
   a window inside a range the rest. Numbers depend on the rows alone, not on their files.

``write_buckets`` writes the sequences as Parquet with a folder for each length, ordered
by number; ``batches`` counts, per bucket, the batches of a token budget.

Defined cases: null text is empty (only the end id, one piece of length 1); a very long
text gives many pieces; a null document id is kept; repeated rows are packed each on its
own (equal pieces are interchangeable); an empty table gives no pieces; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written
from .token_files import encoder

#: Tokens of the longest sequence; a power of two.
MAX_LEN = 2048
#: Hash ranges in which the sequences of a bucket are numbered.
SLOT_RANGES = 1024


def cuts(n: int, max_len: int = MAX_LEN) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: powers of two up to ``max_len``, falling."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    whole, rest = divmod(n, max_len)
    out = [(k * max_len, max_len) for k in range(whole)]
    at = whole * max_len
    for bit in range(max_len.bit_length() - 2, -1, -1):
        if rest >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, max_len: int = MAX_LEN, width: int = 2,
           key: str = "doc_id", text: str = "text", plain_specials: bool = False) -> DataFrame:
    """(key, start, length, ids, ids_crc32, doc_tokens): the pieces of every document, written
    once. ``ids`` are little-endian unsigned integers of ``width`` bytes; the checksum is over
    the ids as 32-bit integers."""
    cuts(0, max_len)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import zlib

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(tokenizer, width, plain_specials)
        end = np.asarray([end_id], dtype=f"<u{width}").tobytes()
        names = ["k", "start", "length", "ids", "ids_crc32", "doc_tokens"]
        for batch in batches:
            keys, at = batch["k"].tolist(), 0
            for run in slices(batch["t"].tolist(), 256, 1 << 20):
                rows = []
                for k, coded in zip(keys[at:at + len(run)], enc.encode(run)):
                    coded += end
                    n = len(coded) // width
                    wide = np.frombuffer(coded, dtype=f"<u{width}").astype("<u4")
                    rows += [(k, s, m, coded[s * width:(s + m) * width], zlib.crc32(wide[s:s + m]), n)
                             for s, m in cuts(n, max_len)]
                at += len(run)
                yield pd.DataFrame(rows, columns=names)

    # the key travels as text: a column of numbers and nulls would reach pandas as floats
    rows = docs.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    cut_up = rows.mapInPandas(cut, "k string, start long, length long, ids binary, ids_crc32 long, doc_tokens long")
    return written(cut_up.select(F.col("k").cast(docs.schema[key].dataType).alias(key), "start", "length", "ids",
                                 "ids_crc32", "doc_tokens"), "pieces")


def number(cut_up: DataFrame, key: str = "doc_id", ranges: int = SLOT_RANGES) -> DataFrame:
    """Pieces with ``sequence_id`` (from 0, without gaps; one bucket of equal lengths after
    another, the longest first) and ``offset``, which is 0: a piece fills its sequence."""
    h = F.xxhash64(F.col(key).isNull(), F.col(key), "start", "ids_crc32", "doc_tokens")
    rows = cut_up.withColumn("_h", h).withColumn("_range", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(ranges)))
    # at most (1 + log2(max_len)) x ranges rows, whatever the input
    counts = rows.groupBy("length", "_range").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select(F.col("length").alias("_l"), F.col("_range").alias("_r"), (F.sum("_n").over(
        Window.orderBy(F.col("length").desc(), "_range")) - F.col("_n")).alias("_base"))
    at = Window.partitionBy("length", "_range").orderBy("_h", F.col(key).asc_nulls_first(), "start", "ids_crc32")
    return (rows.withColumn("_k", F.row_number().over(at))
            .join(base, (F.col("length") == F.col("_l")) & (F.col("_range") == F.col("_r")))
            .withColumn("sequence_id", F.col("_base") + F.col("_k") - 1)
            .withColumn("offset", F.lit(0).cast("bigint"))
            .select(*cut_up.columns, "sequence_id", "offset"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, max_len: int = MAX_LEN, key: str = "doc_id",
         text: str = "text", keep_ids: bool = True, **params) -> DataFrame:
    """The sequences of all documents: ``key, start, length, ids, ids_crc32, doc_tokens,
    sequence_id, offset``. ``keep_ids=False`` leaves the ids out, so that only narrow rows
    are shuffled for the numbering."""
    cut_up = pieces(docs, tokenizer, end_id, max_len, key=key, text=text, **params)
    return number(cut_up if keep_ids else cut_up.drop("ids"), key)


def batches(sequences: DataFrame, batch_tokens: int) -> DataFrame:
    """(length, n_sequences, n_tokens, per_batch, n_batches): the buckets, and the batches of
    equal shape that a budget of tokens gives (a sequence longer than that is a batch)."""
    per = F.greatest(F.floor(F.lit(batch_tokens) / F.col("length")), F.lit(1)).cast("bigint")
    return (sequences.groupBy("length").agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("length").alias("n_tokens"))
            .withColumn("per_batch", per)
            .withColumn("n_batches", F.ceil(F.col("n_sequences") / F.col("per_batch"))))


def write_buckets(sequences: DataFrame, folder: str) -> None:
    """The sequences as Parquet, a folder ``length=N`` for each bucket, files in order of number."""
    (sequences.repartitionByRange("sequence_id").sortWithinPartitions("sequence_id")
     .write.partitionBy("length").parquet(folder))
