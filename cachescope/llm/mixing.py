"""Operator 9: mixing sources to target weights.

Sources, ordered by code point with null last, weigh 1, 2, 3 and so on in repetition,
and share all words of the corpus. No source is asked for more than ``max_epochs``
times its words; what it can't give is shared out again by weight. That is water
filling: with sources ordered by ``cap / weight``, the capped ones are a prefix, so
one pass of running sums over the table of sources replaces the repetition.

Inside a source the documents are ordered by a hash-random key (md5 of document id and
text, so reruns and other engines agree). The key's leading digits cut the key space
into equal ranges; a prefix sum over the (source, range) word counts gives every range its
base, and a window inside each range the rest. A document at ``[before, before + size)``
of a source of ``s`` words with a budget of ``b`` words is taken ``b // s`` times, and
once more as far as it lies below ``b % s``: the document at the cut is taken in part,
so a source's taken words equal its budget to the word.

A hot source spreads over all its ranges, only narrow rows move, and the only tables
brought together are one row per source and one per (source, range).

Defined cases: a null source is a source; null or empty text has no words and is never
taken; a null document id counts as an empty one in the key; rows with the same id and
text have equal keys and are interchangeable; an empty table, or one without words,
gives targets of 0; input columns named like an output column are replaced (``mixture``
keeps them), all others kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_RE, columns_apart, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its own words.
MAX_EPOCHS = 3
#: Hex digits of the key that number its range: 16^3 = 4,096 ranges per source.
RANGE_DIGITS = 3

OUT = ("size", "source_size", "target", "taken")


def source_targets(sizes: DataFrame, source: str = "source", weights: Sequence[int] = WEIGHTS,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row per source with ``source_size``.

    Works on the table of sources, one small row each; its windows need them together.
    """
    ordered = Window.orderBy(F.col(source).asc_nulls_last())
    every = Window.orderBy("_ratio", "_rank").rowsBetween
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]),
                     (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("bigint")
    ranked = (sizes.withColumn("_rank", F.row_number().over(ordered))
              .withColumn("_w", w)
              .withColumn("_cap", F.col("source_size") * max_epochs)
              .withColumn("_ratio", F.col("_cap") / F.col("_w")))
    level = ranked.select(
        source, "source_size", "_cap", "_w", "_rank", "_ratio",
        F.sum("source_size").over(Window.partitionBy()).alias("_total"),
        F.coalesce(F.sum("_cap").over(every(Window.unboundedPreceding, -1)), F.lit(0)).alias("_capped"),
        F.sum("_w").over(every(0, Window.unboundedFollowing)).alias("_open"))
    # The level at which the still open sources share what the capped ones leave; it holds
    # from the first source that can give that much.
    level = level.withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
    final = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_rank", "_level"))).over(
        Window.partitionBy())["_level"]
    return level.select(source, "source_size",
                        F.least(F.col("_cap").cast("double"), final * F.col("_w")).alias("target"))


def sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``docs`` with its word count, hash-random key and cell (source and key range)."""
    cols = [c for c in docs.columns if c not in OUT]
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return (docs.select(*cols)
            .withColumn("size", word_count(F.col(text)))
            # over id and text, so that documents that share an id are spread too
            .withColumn("_key", F.md5(F.concat(part(key), F.lit("|"), part(text)).cast("binary")))
            .withColumn("_cell", F.concat(F.substring("_key", 1, RANGE_DIGITS), F.coalesce(
                F.concat(F.lit("="), F.col(source)), F.lit("~")))))


def cell_bases(rows: DataFrame, source: str) -> DataFrame:
    """(source, cell, base): words of a source in all earlier key ranges."""
    counts = rows.groupBy(source, "_cell").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy(source).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(F.col(source).alias("_src"), "_cell",
                         F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_base"))


def taken_words(before: Column, size: Column, source_size: Column, target: Column) -> Column:
    """Words taken of a document that starts ``before`` words into its source."""
    budget = F.floor(target).cast("bigint")
    rounds = F.when(source_size > 0, F.floor(budget / source_size)).otherwise(0).cast("bigint")
    rest = budget - rounds * source_size
    return rounds * size + F.least(size, F.greatest(F.lit(0).cast("bigint"), rest - before))


@columns_apart("key", "text", "source")
def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
        keep_text: bool = True) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken``.

    ``keep_text=False`` drops the text column, so that only narrow rows are shuffled.
    """
    rows = sized(docs, key, text, source)
    if not keep_text:
        rows = rows.drop(text)
    targets = source_targets(rows.groupBy(source).agg(F.sum("size").alias("source_size")),
                             source, weights, max_epochs)
    cells = cell_bases(rows, source).join(
        targets.select(F.col(source).alias("_s"), "source_size", "target"),
        F.col("_src").eqNullSafe(F.col("_s"))).drop("_s", "_src")
    cols = [c for c in rows.columns if c not in (*OUT, "_key", "_cell")]
    at = (Window.partitionBy("_cell").orderBy("_key", "size")
          .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("_in", F.coalesce(F.sum("size").over(at), F.lit(0)))
            .join(cells, "_cell")
            .withColumn("taken", taken_words(F.col("_base") + F.col("_in"), F.col("size"),
                                             F.col("source_size"), F.col("target")))
            .select(*cols, *OUT))


@columns_apart("key", "text", "source", keep=("n_chars",))
def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **params) -> DataFrame:
    """The rows of the mix, with the columns of ``docs`` (also those named like an output)."""
    return emit(mix(docs, key, text, source, **params), docs.columns, text)


def emit(mixed: DataFrame, columns: Sequence[str], text: str = "text") -> DataFrame:
    """The mix itself: a row for every time a document is taken (documents never taken
    are gone). The last one is cut after the words that its budget leaves, and a column
    ``n_chars`` of whole numbers follows the cut."""
    full = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = F.col("taken") % F.col("size")
    runs = F.concat(F.array_repeat(F.col("size"), full),
                    F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    words = F.regexp_extract_all(F.col(text), F.lit(WORD_RE + r"[\x20\x09-\x0D]*"), F.lit(0))
    head = F.rtrim(F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), ""))
    cut = F.col("_words") < F.col("size")
    rows = (mixed.where(F.col("taken") > 0).withColumn("_words", F.explode(runs))
            .withColumn(text, F.when(cut, head).otherwise(F.col(text))))
    if "n_chars" in columns and isinstance(mixed.schema["n_chars"].dataType, T.IntegralType):
        rows = rows.withColumn("n_chars", F.when(cut, F.char_length(text)).otherwise(F.col("n_chars")))
    return rows.select(*columns)
