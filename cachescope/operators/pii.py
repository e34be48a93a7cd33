"""PII detection, redaction, flags, block events and counters.

Redaction is the native ``regexp_replace`` cascade of
:mod:`cachescope.functions.pii_patterns` (JVM, codegen, no Python). Spans are
native as well: offsets are running sums over the lengths of the matches and of
the pieces between them, and overlaps are resolved over sorted spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.pii_patterns import (CHECKS, DEFAULT_SCORE, DIGIT_ENTITIES, SCORES, VALID_SCORE, cascade_steps,
                                      entities_found, iban_valid, luhn_valid, patterns)
from ..functions.text import preview_chars


def redact(df: DataFrame, text: str = "text", *, validate_cards: bool = False, validate_ibans: bool = False,
           extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """Add ``sanitized_text``, ``entities`` (sorted, distinct) and ``has_pii``.
    Empty or null text passes through with no entities. With ``validate_cards`` or
    ``validate_ibans`` only numbers that pass their checksum are redacted.

    The result of each step is a column of its own projection, and the next step and
    the entity flags read it from there (the optimizer does not inline an expensive
    expression used twice), so each text goes through each pattern once.
    """
    red = df.select("*", F.coalesce(F.col(text), F.lit("")).alias("_red"))
    validate = (*["CREDIT_CARD"] * validate_cards, *["IBAN_CODE"] * validate_ibans)
    for step in cascade_steps(validate=validate, extra=extra):
        red = red.select(*df.columns, step(F.col("_red")).alias("_red"))
    ents = entities_found(F.col(text), F.col("_red"), extra)
    out = red.select(*df.columns, F.when(F.col(text).isNull(), F.col(text)).otherwise(F.col("_red"))
                     .alias("sanitized_text"), ents.alias("entities"))
    return out.withColumn("has_pii", F.size("entities") > 0)


def match_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Matches of every entity pattern on the original text (independent counts)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select("*", *[F.size(F.regexp_extract_all(t, F.lit(p), 0)).cast("bigint")
                            .alias(f"n_{e.lower()}") for e, p in patterns("java")])


def card_checks(df: DataFrame, text: str = "text") -> DataFrame:
    """Card-like matches and how many pass the Luhn checksum."""
    cands = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(dict(patterns())["CREDIT_CARD"]), 0)
    return df.select("*", F.size(cands).cast("bigint").alias("n_card_candidates"),
                     F.size(F.filter(cands, luhn_valid)).cast("bigint").alias("n_card_valid"))


def iban_checks(df: DataFrame, text: str = "text") -> DataFrame:
    """IBAN-like matches and how many have their country's length and pass mod 97."""
    cands = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(dict(patterns())["IBAN_CODE"]), 0)
    return df.select("*", F.size(cands).cast("bigint").alias("n_iban_candidates"),
                     F.size(F.filter(cands, iban_valid)).cast("bigint").alias("n_iban_valid"))


def block_events(redacted: DataFrame, *, key: str = "doc_id",
                 preview: int = config.PII_PREVIEW_CHARS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One block event per (text, entity): '[REDACTED] ' + first ``preview``
    characters of the sanitized text (no ellipsis).

    Texts without PII are dropped by a filter on the generated entity column.
    A filter on the flags themselves (or the one Catalyst infers from an inner
    ``explode``) would be pushed below the redaction and evaluate it twice."""
    return redacted.select(
        key, *carry, F.explode_outer("entities").alias("entity"),
        F.concat(F.lit("[REDACTED] "), preview_chars("sanitized_text", preview, ellipsis=False))
        .alias("message")).where(F.col("entity").isNotNull()).select(
        key, *carry, "entity", "message", F.concat(F.lit("Entity: "), F.col("entity")).alias("detail"))


def block_counts(events: DataFrame) -> DataFrame:
    """PII blocks per entity type (+1 per text and distinct entity)."""
    return events.groupBy("entity").agg(F.count(F.lit(1)).cast("bigint").alias("blocks"))


def last_message_only(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn",
                      content: str = "content", scope: str = "last",
                      validate_cards: bool = False) -> DataFrame:
    """Scrub the last message of each conversation (``scope='last'``, the
    gateway's behaviour) or every message (``scope='all'``).

    The last turn comes from a per-conversation max joined back (no window over
    a whole conversation); AQE splits a skewed conversation key in the join.
    """
    if scope == "all":
        target = F.lit(True)
        base = messages
    else:
        last = messages.groupBy(conv).agg(F.max(turn).alias("_last_turn"))
        base = messages.join(last, conv)
        target = F.col(turn) == F.col("_last_turn")
    marked = base.select(*messages.columns, target.alias("scrubbed"))
    red = redact(marked, content, validate_cards=validate_cards)
    return red.select(
        *messages.columns, "scrubbed",
        F.when(F.col("scrubbed"), F.col("sanitized_text")).otherwise(F.col(content)).alias("sanitized"),
        F.when(F.col("scrubbed"), F.col("entities")).otherwise(F.array().cast("array<string>"))
        .alias("entities"))


def _matches(t: Column, level: int, entity: str, pattern: str) -> Column:
    """(level, entity, gap, value) of every match in order; ``gap`` is the length of the text
    between it and the one before."""
    none = F.array().cast("array<struct<level:int,entity:string,gap:int,value:string>>")
    found = F.regexp_extract_all(t, F.lit(pattern), 0)
    rows = F.zip_with(F.slice(F.split(t, pattern, -1), F.lit(1), F.size(found)), found, lambda p, v: F.struct(
        F.lit(level).alias("level"), F.lit(entity).alias("entity"), F.length(p).alias("gap"), v.alias("value")))
    needed = "[0-9]" if entity in DIGIT_ENTITIES else "@" if "@" in pattern else None
    return rows if needed is None else F.when(t.rlike(needed), rows).otherwise(none)


def score_of(entity: Column, value: Column) -> Column:
    """How sure a match is: its pattern's score, or 1 if it passes its entity's checksum."""
    score = F.lit(DEFAULT_SCORE)
    for name, base in SCORES.items():
        score = F.when(entity == name, F.lit(base)).otherwise(score)
    for name, check in CHECKS.items():
        score = F.when((entity == name) & check(F.when(entity == name, value)), F.lit(VALID_SCORE)).otherwise(score)
    return score


def _recognised(fn: Callable[[list[str]], list[list[tuple[int, int, str, float]]]]) -> Callable[[Column], Column]:
    """A recogniser as a function of a text column: its spans in order, of those that overlap
    the first (the longer of two that begin together)."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for t, found in zip(s, fn(s.tolist()), strict=True):
                kept, done = [], 0
                for start, end, entity, score in sorted(found, key=lambda x: (x[0], -x[1])):
                    if done <= start < end <= len(t):
                        kept.append({"entity": entity, "at": start, "value": t[start:end], "score": float(score)})
                        done = end
                out.append(kept)
            yield pd.Series(out)

    return F.pandas_udf(run, "array<struct<entity:string,at:int,value:string,score:double>>").asNondeterministic()


def spans(df: DataFrame, *, key: str = "doc_id", text: str = "text", extra: list[tuple[str, str]] | None = None,
          recogniser: Callable[[list[str]], list[list[tuple[int, int, str, float]]]] | None = None) -> DataFrame:
    """Detected spans ``key, entity, start, end, score, value`` (0-based character
    offsets, end exclusive) in the original text.

    A span that overlaps a kept one of an earlier entity in cascade order is dropped (the
    cascade's overlap rule). Kept spans never overlap, so of all kept ones only the last that
    starts before a span and the first that starts after it can meet it: two running values
    over the spans of a text sorted by start decide a level, without comparing pairs. Only
    matches are shuffled, never texts.

    ``recogniser`` takes a list of texts and gives for each a list of (start, end, entity, score):
    a named-entity model, say. It comes last in the cascade: its spans give way to those of the patterns.
    """
    pats = patterns("java", extra)
    rows = df.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_t")).where(
        F.length("_t") > 0)
    # one generator per text over the matches of all patterns: a match's place in its own pattern's list is kept
    own = F.lit(None)
    lists = [F.transform(_matches(F.col("_t"), k, e, p), lambda m, i: F.struct(
        i.alias("i"), *[m[c].alias(c) for c in ("level", "entity", "gap", "value")], own.cast("int").alias("at"),
        own.cast("double").alias("own"))) for k, (e, p) in enumerate(pats)]
    if recogniser is not None:
        rows = rows.withColumn("_more", _recognised(recogniser)("_t"))
        lists.append(F.transform("_more", lambda m, i: F.struct(
            i.alias("i"), F.lit(len(pats)).alias("level"), m["entity"].alias("entity"), F.lit(0).alias("gap"),
            m["value"].alias("value"), m["at"].alias("at"), m["score"].alias("own"))))
    found = rows.select("_key", "_row", F.explode(F.flatten(F.array(*lists))).alias("m")).select("_key", "_row", "m.*")
    upto = Window.partitionBy("_row", "level").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("value")
    placed = (found.withColumn("end", F.coalesce(F.col("at") + size, F.sum(F.col("gap") + size).over(upto)).cast("int"))
              .withColumn("start", (F.col("end") - size).cast("int")).drop("i", "gap", "at"))
    past = Window.partitionBy("_row").orderBy("start", "level").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("_row").orderBy(F.col("start").desc(), F.col("level").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    kept = placed.withColumn("_kept", F.col("level") == 0)
    for level in range(1, len(lists)):
        near = (kept.withColumn("_a", F.max(F.when(F.col("_kept"), F.col("end"))).over(past))
                .withColumn("_b", F.min(F.when(F.col("_kept"), F.col("start"))).over(ahead)))
        free = (F.coalesce("_a", F.lit(0)) <= F.col("start")) & (F.coalesce("_b", F.lit(2**31 - 1)) >= F.col("end"))
        kept = near.withColumn("_kept", F.col("_kept") | ((F.col("level") == level) & free)).drop("_a", "_b")
    return kept.where("_kept").select(F.col("_key").alias(key), "entity", "start", "end",
                                      F.coalesce("own", score_of(F.col("entity"), F.col("value"))).alias("score"), "value")
