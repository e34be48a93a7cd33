"""The cache table: upsert, listing, statistics, purge.

A cache table has ``key, original_text, response_text[, embedding], stored_at,
seq``. Parquet has no in-place update, so an upsert writes a new version: the
latest write per key wins, chosen with ``max_by`` (a combinable aggregate, so a
hot key is reduced map-side).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import preview_bytes, preview_chars, prompt_key, ws_trim


def cacheable(entries: DataFrame, *, prompt: str = "original_text",
              response: str = "response_text", embedding: str | None = None) -> DataFrame:
    """Only entries with a prompt, a non-blank (trimmed) response and, when given,
    a non-empty vector are stored."""
    cond = (F.coalesce(F.col(prompt), F.lit("")) != "") & (F.coalesce(F.col(response), F.lit("")) != "")
    if embedding:
        cond &= F.coalesce(F.size(embedding), F.lit(0)) > 0
    return entries.where(cond)


def entries_from_pairs(pairs: DataFrame, *, prompt: str = "prompt", response: str = "response",
                       order: tuple[str, ...] = ("conv_id", "turn"),
                       embedding: str | None = None) -> DataFrame:
    """(prompt, response) rows -> cache writes: keyed, response trimmed, ordered by ``order``."""
    cols = [prompt_key(prompt).alias("key"), F.col(prompt).alias("original_text"),
            ws_trim(response).alias("response_text"),
            F.struct(*[F.col(c) for c in order]).alias("seq")]
    if embedding:
        cols.append(F.col(embedding).alias("embedding"))
    return cacheable(pairs.select(*cols), embedding="embedding" if embedding else None)


def upsert(writes: DataFrame, existing: DataFrame | None = None, *, seq: str = "seq") -> DataFrame:
    """Latest write per key wins (``existing`` rows count as older than ``writes``)."""
    value_cols = [c for c in writes.columns if c not in ("key", seq)]
    ordered = writes.select("key", *value_cols, F.struct(F.lit(1).alias("gen"), F.col(seq).alias("s"))
                            .alias("_o"))
    if existing is not None:
        old = existing.select("key", *value_cols, F.struct(F.lit(0).alias("gen"),
                                                            F.col(seq).alias("s")).alias("_o"))
        ordered = old.unionByName(ordered)
    latest = ordered.groupBy("key").agg(F.max_by(F.struct(*value_cols, F.col("_o.s").alias(seq)),
                                                 "_o").alias("w"))
    return latest.select("key", *[F.col(f"w.{c}").alias(c) for c in value_cols + [seq]])


def list_entries(cache: DataFrame, limit: int = config.CACHE_LIST_LIMIT,
                 preview: int = config.RESPONSE_PREVIEW_CHARS, unit: str = "chars") -> DataFrame:
    """First ``limit`` keys in key order, then entries without a prompt are
    dropped (so fewer than ``limit`` may come back). Preview and length are in
    characters (``unit='chars'``) or UTF-8 bytes (``unit='bytes'``, the
    gateway's Go listing)."""
    first = cache.select("key", "original_text", "response_text").orderBy("key").limit(max(limit, 0))
    resp = F.coalesce(F.col("response_text"), F.lit(""))
    if unit == "bytes":
        shown, size = preview_bytes(resp, preview), F.octet_length(resp)
    else:
        shown, size = preview_chars(resp, preview), F.length(resp)
    return first.where(F.coalesce(F.col("original_text"), F.lit("")) != "").select(
        "key", F.col("original_text").alias("prompt"), shown.alias("response_preview"),
        size.cast("bigint").alias("response_length"))


def stats(cache: DataFrame, *, dim: int = config.EMBEDDING_DIM,
          threshold: float = config.DISTANCE_THRESHOLD, model: str = config.EMBEDDING_MODEL
          ) -> DataFrame:
    """Entry count plus the configuration echo (one row)."""
    return cache.agg(F.count_distinct("key").cast("bigint").alias("entry_count")).select(
        "entry_count", F.lit(dim).alias("embedding_dim"), F.lit(float(threshold)).alias("threshold"),
        F.lit(model).alias("model"))


def purge(spark, path: str) -> int:
    """Delete every entry of the cache table at ``path``; returns how many were removed.

    The count is a metadata-only scan; the table is rewritten empty with the
    same schema (a new version of the files, no job over the data itself).
    """
    try:
        current = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0  # a missing table holds nothing
    removed = current.count()
    if removed:
        spark.createDataFrame([], current.schema).write.mode("overwrite").parquet(path)
    return removed
