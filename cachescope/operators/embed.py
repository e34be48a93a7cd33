"""Text -> vector (the embedder plug-in point).

No model is called by default: vectors are an input column. Two ways to
produce them in Spark:

* :func:`hashed_embedder` — a deterministic pure-Spark test embedder
  (tokenise -> feature hashing -> L2 normalise, from ``pyspark.ml``);
* :func:`embed_with` — wraps a user function ``list[str] -> list[list[float]]``
  as an iterator pandas UDF (the model loads once per Python worker, batches
  come over Arrow). Texts are de-duplicated before the UDF and joined back, so
  a prompt repeated a million times is embedded once;
* :func:`embed_new` — keeps the vectors in an append-only table by text and task, and
  calls the function only for texts that the table lacks; :func:`with_stored` reads them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ws_trim
from ..streaming import tables

#: Rows of the table of stored vectors.
STORED = "text_key string, task_type string, embedding array<float>"
#: What a text is embedded for, if nothing else is said.
TASK_TYPE = "SEMANTIC_SIMILARITY"


def clean_text(df: DataFrame, text: str) -> DataFrame:
    """Blank text cannot be embedded: drop it, strip the rest."""
    return df.where(F.length(ws_trim(text)) > 0).withColumn(text, ws_trim(text))


def hashed_embedder(df: DataFrame, text: str = "text", out: str = "embedding",
                    dim: int = 64) -> DataFrame:
    """Deterministic bag-of-words vector of ``dim`` hashed features, unit norm."""
    tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\W+", toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    norm = Normalizer(inputCol="_tf", outputCol="_vec", p=2.0)
    v = norm.transform(tf.transform(tok.transform(df)))
    return v.withColumn(out, vector_to_array("_vec", "float32")).drop("_tok", "_tf", "_vec")


def embed_with(df: DataFrame, fn: Callable[[list[str]], list[list[float]]], *, text: str = "text",
               out: str = "embedding", dim: int | None = None) -> DataFrame:
    """Embed ``text`` with a user function, once per distinct text.

    Vectors of the wrong dimension (when ``dim`` is given) become null, so they
    never match in the cache search.
    """
    @F.pandas_udf("array<float>")
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            vecs = fn(s.tolist())
            if dim is not None:
                vecs = [v if v is not None and len(v) == dim else None for v in vecs]
            yield pd.Series(vecs)

    # Blank texts are set apart, since they would all meet on one key; the rest meets on
    # the hash of the text.
    named = df.withColumn(text, ws_trim(text))
    blank = F.coalesce(F.length(text), F.lit(0)) == 0
    full = named.where(~blank).withColumn("_key", F.sha2(F.col(text).cast("binary"), 256))
    vectors = (full.groupBy("_key").agg(F.first(text).alias("_text"))
               .select("_key", _embed(F.col("_text")).alias(out)))
    none = named.where(blank).withColumn(out, F.lit(None).cast("array<float>"))
    return full.join(vectors, "_key", "left").select(*df.columns, out).unionByName(none.select(*df.columns, out))


def text_key(text: Column) -> Column:
    """Key of a text, which has no white space at its ends, in the table of stored vectors."""
    return F.sha2(text.cast("binary"), 256)


def _keyed(df: DataFrame, text: str, task_type: Column | str) -> DataFrame:
    task = F.lit(task_type) if isinstance(task_type, str) else task_type
    named = df.select("*", ws_trim(text).alias("_t"), F.coalesce(task, F.lit(TASK_TYPE)).alias("_task"))
    return named.withColumn("_key", text_key(F.col("_t")))


def embed_new(df: DataFrame, path: str, batch_id: int, fn: Callable[[list[str], str], list[list[float] | None]], *,
              text: str = "text", task_type: Column | str = TASK_TYPE, dim: int | None = None) -> None:
    """Embed the texts of ``df`` that the table at ``path`` has no vector of for their task type, and
    append theirs as batch ``batch_id`` (a batch that is run again writes the same rows again: it
    looks at earlier batches only).

    ``fn(texts, task_type)`` gives a vector for each text, None where it fails. Texts are stripped
    and embedded once each; blank ones never. Vectors of the wrong dimension (when ``dim`` is
    given), empty ones and None are not stored, so a later batch tries those texts again.
    Works as the body of a ``foreachBatch`` sink as well.
    """
    def _vectors(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, tasks in batches:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            for task, part in texts.groupby(tasks):
                for at, v in zip(part.index, fn(part.tolist(), task), strict=True):
                    out[at] = v if v is not None and len(v) and dim in (None, len(v)) else None
            yield out

    # not deterministic: or the null test below would move in front and call it twice
    embedded = F.pandas_udf(_vectors, "array<float>").asNondeterministic()
    wanted = (_keyed(df, text, task_type).where(F.length("_t") > 0).groupBy("_key", "_task").agg(F.first("_t").alias("_t")))
    known = tables.read(df.sparkSession, path, STORED, before=batch_id).select(
        F.col("text_key").alias("_key"), F.col("task_type").alias("_task"))
    new = wanted.join(known, ["_key", "_task"], "left_anti")
    rows = new.select(F.col("_key").alias("text_key"), F.col("_task").alias("task_type"),
                      embedded("_t", "_task").alias("embedding"))
    tables.append(rows.where(F.col("embedding").isNotNull()), path, batch_id)


def with_stored(df: DataFrame, path: str, *, text: str = "text", task_type: Column | str = TASK_TYPE,
                out: str = "embedding") -> DataFrame:
    """``df`` with the stored vector of each text; null for blank texts and those without one."""
    rest = [c for c in df.columns if c != out]
    keyed = _keyed(df, text, task_type)
    blank = F.coalesce(F.length("_t"), F.lit(0)) == 0  # apart, since all would meet on one key
    have = tables.read(df.sparkSession, path, STORED).select(
        F.col("text_key").alias("_key"), F.col("task_type").alias("_task"), F.col("embedding").alias("_v"))
    found = keyed.where(~blank).join(have, ["_key", "_task"], "left").select(*rest, F.col("_v").alias(out))
    return found.unionByName(keyed.where(blank).select(*rest, F.lit(None).cast("array<float>").alias(out)))
