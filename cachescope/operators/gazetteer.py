"""Listed names in texts: PERSON by gazetteer, for lists of any size.

A name is a sequence of words (runs of letters, marks, digits and ``_``; case counts). It is found where
its words follow each other with nothing but white space between them. Of names that begin at one
word the longest counts, and a text is gone through from left to right, so names found never overlap.

The list is never built into a pattern or sent whole to the tasks: every run of words whose first word may
begin a name (a bitmap of fixed size says so) is looked up in the list by a join.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITY, SCORE = "PERSON", 0.7
#: Bits of the bitmap of first words.
FIRST_BITS = 1 << 20
#: Rows that leave a task at a time.
OUT_ROWS = 100_000

_WORD = r"[\p{L}\p{M}\p{N}_]+"


def name_keys(names: DataFrame, name: str = "name") -> DataFrame:
    """(name_key, n_words, first): the different names of at least one word, their words joined by a blank."""
    words = names.select(F.regexp_extract_all(F.coalesce(F.col(name), F.lit("")), F.lit(_WORD), 0).alias("w")).where(F.size("w") > 0)
    return words.select(F.array_join("w", " ").alias("name_key"), F.size("w").alias("n_words"), F.col("w")[0].alias("first")).distinct()


def _first_words(keys: DataFrame) -> np.ndarray:
    """Bitmap of the first words of names; it comes to the driver as at most FIRST_BITS / 32 rows."""
    bit = F.pmod(F.crc32(F.col("first").cast("binary")), F.lit(FIRST_BITS))
    rows = keys.select(bit.alias("bit")).select(F.shiftright("bit", 5).alias("w"), F.expr("shiftleft(1L, int(bit % 32))").alias("b"))
    bits = np.zeros(FIRST_BITS // 32, dtype="u4")
    for r in rows.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        bits[r.w] = r.b
    return bits


def _runs(words_to: int, shared):
    """A function for mapInPandas: (k, row, start, end, name_key) of every run of at most ``words_to`` words
    that may be a name, of rows (k, row, t)."""
    names = ["k", "row", "start", "end", "name_key"]
    import regex

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word, bits = regex.compile(_WORD), shared.value
        for batch in batches:
            out = []
            for key, row, t in zip(batch["k"], batch["row"], batch["t"]):
                found = [(m.start(), m.end()) for m in word.finditer(t)]
                joined = [t[a[1]:b[0]].isspace() for a, b in zip(found, found[1:])] + [False]
                for i, (s, e) in enumerate(found):
                    h = zlib.crc32(t[s:e].encode()) % FIRST_BITS
                    if not bits[h >> 5] >> (h & 31) & 1:
                        continue
                    run, n = t[s:e], i
                    out.append((key, row, s, e, run))
                    while n - i + 1 < words_to and joined[n]:
                        n += 1
                        run = f"{run} {t[found[n][0]:found[n][1]]}"
                        out.append((key, row, s, found[n][1], run))
                    if len(out) >= OUT_ROWS:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return scan


def _leftmost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of matches sorted by row, start and falling end those that begin where the kept ones before have ended."""
    row, done = None, 0
    for batch in batches:
        keep = []
        for r, s, e in zip(batch["row"], batch["start"], batch["end"]):
            if r != row:
                row, done = r, 0
            keep.append(s >= done)
            if s >= done:
                done = e
        yield batch[np.array(keep, dtype=bool)]


def person_spans(df: DataFrame, names: DataFrame, *, key: str = "doc_id", text: str = "text", name: str = "name",
                 entity: str = ENTITY) -> DataFrame:
    """``key, entity, start, end, score, value`` of the listed names in the texts of ``df``: offsets in
    characters, end exclusive; ``value`` is the name, its words one blank apart.

    Null texts hold none; names without a word, null ones and repeated ones change nothing; rows with one key
    have spans of their own; an empty list gives an empty result.
    """
    keys = name_keys(names, name)
    longest = keys.agg(F.max("n_words")).first()[0] or 0
    shared = df.sparkSession.sparkContext.broadcast(_first_words(keys))
    # the key travels as text: a column of numbers and nulls would reach pandas as floats
    rows = df.select(F.col(key).cast("string").alias("k"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("t"))
    kind = "k string, row long, start int, end int, name_key string"
    found = rows.where(F.length("t") > 0).mapInPandas(_runs(longest, shared), kind)
    hits = found.join(keys.select("name_key"), "name_key", "left_semi").select("k", "row", "start", "end", "name_key")
    kept = hits.repartition("row").sortWithinPartitions("row", "start", F.col("end").desc()).mapInPandas(_leftmost, kind)
    return kept.select(F.col("k").cast(df.schema[key].dataType).alias(key), F.lit(entity).alias("entity"), "start", "end",
                       F.lit(SCORE).alias("score"), F.col("name_key").alias("value"))
