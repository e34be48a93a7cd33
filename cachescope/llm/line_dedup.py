"""Operator 7: corpus-wide line deduplication.

Lines are exploded to (key hash, document); documents are counted per hash; lines of
hashes over the threshold are dropped by position, and the remaining lines are put
together again in order. Only hashes, document ids and positions are shuffled for the
counting and the decision; a text moves once, to meet the positions it loses. A line
that a third of all documents hold is counted map-side and joined in splits (narrow
rows), and a document's dropped positions are bounded by its own lines.

The key of a line is the line with ASCII white space stripped at both ends and A-Z
lower-cased. Its hash is md5 (128 bits: no collision is expected at 10^12 lines).

Defined cases: null or empty text is one empty line (and stays so); a null ``doc_id``
is a document of its own that sorts below all others; rows that share a ``doc_id`` are
one document for the counts, each is rewritten on its own; an empty table gives an
empty result; input columns named like an output column are replaced, all others kept,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, columns_apart, written


def line_key(line: str) -> bytes:
    """The UTF-8 bytes of a line's key (``bytes.lower`` changes A-Z alone)."""
    return line.strip(ASCII_SPACE).encode("utf-8", "surrogatepass").lower()


def _hasher(min_chars: int):
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([
                [hashlib.md5(line_key(x)).digest() if len(x.strip(ASCII_SPACE)) >= min_chars else None
                 for x in t.split("\n")] for t in batch], dtype=object)

    return F.pandas_udf(hashes, "array<binary>")


def hashed_lines(docs: DataFrame, min_chars: int, key: str, text: str) -> DataFrame:
    """(_doc, _name, hashes): the hash of every line of every document, in order; null where
    the key is shorter than ``min_chars``. Written once: counting and dropping read it."""
    body = F.coalesce(F.col(text), F.lit(""))
    # Rows with one id and one text lose the same lines, so (id, text hash) names a row.
    return written(docs.select(F.col(key).alias("_doc"), F.xxhash64(body).alias("_name"),
                               _hasher(min_chars)(body).alias("hashes")), "lines")


def frequent_lines(lines: DataFrame, min_docs: int = 3) -> DataFrame:
    """(hash, n_docs, keeper): keys found in at least ``min_docs`` documents, and the
    largest document id that holds each."""
    held = lines.select("_doc", F.explode(F.array_distinct(F.array_compact("hashes"))).alias("hash"))
    return (held.groupBy("hash")
            .agg(F.max("_doc").alias("keeper"), F.count_distinct("_doc").alias("n_ids"),
                 F.max(F.col("_doc").isNull().cast("int")).alias("n_null"))
            .select("hash", (F.col("n_ids") + F.col("n_null")).alias("n_docs"), "keeper")
            .where(F.col("n_docs") >= min_docs))


@columns_apart("key", "text")
def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text rewritten, plus ``n_lines`` (before) and ``n_dropped``."""
    out = ("n_lines", "n_dropped")
    cols = [c for c in docs.columns if c not in out]
    docs = docs.select(*cols)
    lines = hashed_lines(docs, min_chars, key, text)
    # written, so that the join shuffles both sides by itself and can split a line that very many
    # documents hold; a grouped side would have to stay in one piece
    frequent = written(frequent_lines(lines, min_docs), "frequent")
    doomed = (lines.select("_doc", "_name", F.posexplode("hashes").alias("_pos", "hash"))
              .where(F.col("hash").isNotNull())
              .join(frequent, "hash")
              .where(~F.col("_doc").eqNullSafe(F.col("keeper")))
              .groupBy(F.col("_doc").alias("_id"), F.col("_name").alias("_of"))
              .agg(F.collect_set("_pos").alias("_drop")))
    body = F.coalesce(F.col(text), F.lit(""))
    parts = F.split(body, "\n", -1)
    # array_except hashes its arguments: linear in the lines of a very long document
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_drop"))
    kept = F.transform(left, lambda i: F.get(parts, i))
    cut = F.col("_drop").isNotNull()
    named = docs.withColumn("_name", F.xxhash64(body))
    return (named.join(doomed, (F.col("_name") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_id")), "left")
            .withColumn("n_lines", F.size(parts).cast("bigint"))
            .withColumn("n_dropped", F.when(cut, F.size("_drop")).otherwise(0).cast("bigint"))
            .withColumn(text, F.when(cut, F.array_join(kept, "\n")).otherwise(body))
            .select(*cols, *out))
