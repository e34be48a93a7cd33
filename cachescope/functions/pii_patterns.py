"""PII patterns and the redaction cascade as native Spark expressions.

The pattern bodies avoid look-around, back-references and Unicode classes so
the same text runs on Java regex (Spark) and RE2 (the SQL cross-check). Word
boundaries are written as placeholders: ``{L}`` before a word character and
``{R}`` after one. RE2 renders both as ``\\b`` (ASCII word chars); Java renders
them as explicit ASCII look-arounds, because Java's ``\\b`` also treats letters
such as 'é' as word characters.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: entity patterns in cascade order (the order is the overlap rule)
PII_PATTERNS: list[tuple[str, str]] = [
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("IBAN_CODE", r"{L}[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}{R}"),
    ("CREDIT_CARD", r"{L}[0-9](?:[ -]?[0-9]){12,18}{R}"),
    ("US_SSN", r"{L}[0-9]{3}-[0-9]{2}-[0-9]{4}{R}"),
    ("IP_ADDRESS", r"{L}(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}"
                   r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]){R}"),
    ("PHONE_NUMBER", r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|{L}[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}{R}"),
]
# fixed values: length of an IBAN by country
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 "
    "FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 "
    "LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 "
    "SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()
# --- end of fixed values ---

#: How sure a pattern's match is; one that passes its checksum is sure.
SCORES = {"EMAIL_ADDRESS": 0.9, "IBAN_CODE": 0.5, "CREDIT_CARD": 0.3, "US_SSN": 0.5, "IP_ADDRESS": 0.6, "PHONE_NUMBER": 0.4}
DEFAULT_SCORE, VALID_SCORE = 0.5, 1.0

ENTITY_ORDER = [e for e, _ in PII_PATTERNS]

_JAVA = {"{L}": "(?<![0-9A-Za-z_])", "{R}": "(?![0-9A-Za-z_])"}
_RE2 = {"{L}": r"\b", "{R}": r"\b"}


def render(pattern: str, dialect: str = "java") -> str:
    marks = _JAVA if dialect in ("java", "python") else _RE2
    for k, v in marks.items():
        pattern = pattern.replace(k, v)
    return pattern


def patterns(dialect: str = "java", extra: list[tuple[str, str]] | None = None
             ) -> list[tuple[str, str]]:
    return [(e, render(p, dialect)) for e, p in PII_PATTERNS + list(extra or [])]


def placeholder(entity: str) -> str:
    return f"<{entity}>"


def person_pattern(names: list[str]) -> tuple[str, str]:
    """PERSON by gazetteer (no NER model is available): whole-word match of any
    of ``names``, longest first."""
    alts = "|".join(re.escape(n) for n in sorted(set(names), key=len, reverse=True) if n)
    return ("PERSON", "{L}(?:" + alts + "){R}")


def luhn_valid(candidate: Column) -> Column:
    """Luhn checksum of the digits of a card-like match (Spark's luhn_check)."""
    return F.call_function("luhn_check", F.regexp_replace(candidate, "[^0-9]", ""))


def iban_valid(candidate: Column) -> Column:
    """Whether an IBAN-like match (no blanks) has its country's length and passes mod 97: the
    first four characters go to the end, letters count 10 to 35, and the number built is
    folded character by character, so it never leaves 64 bits."""
    moved = F.concat(F.substring(candidate, 5, 64), F.substring(candidate, 1, 4))
    rest = F.aggregate(F.split(moved, ""), F.lit(0).cast("bigint"), lambda acc, c: F.when(
        c == "", acc).when(c < "A", (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))
    named = F.concat(F.substring(candidate, 1, 2), F.length(candidate).cast("string"))
    return named.isin(IBAN_LENGTHS) & (rest == 1)


#: Checksums by entity.
CHECKS = {"CREDIT_CARD": luhn_valid, "IBAN_CODE": iban_valid}


def _occurrences(text: Column, literal: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(literal)))) / len(literal)


#: Patterns that every match of needs a digit for.
DIGIT_ENTITIES = ("IBAN_CODE", "CREDIT_CARD", "US_SSN", "IP_ADDRESS", "PHONE_NUMBER")


def _step(t: Column, entity: str, pat: str, validate: tuple[str, ...]) -> Column:
    if entity in validate:
        # put together again from what lies between the matches, so that a valid number is
        # replaced where it was matched and nowhere else
        found = F.regexp_extract_all(t, F.lit(pat), 0)
        mark = lambda c: F.when(CHECKS[entity](c), F.lit(placeholder(entity))).otherwise(c)
        return F.array_join(F.zip_with(F.split(t, pat, -1), found, lambda p, c: F.concat(
            p, F.coalesce(mark(c), F.lit("")))), "")
    return F.regexp_replace(t, pat, placeholder(entity))


def cascade_steps(*, validate: tuple[str, ...] = (), extra: list[tuple[str, str]] | None = None
                  ) -> list[Callable[[Column], Column]]:
    """The redaction as functions of a text, to be applied in a row: each replaces its
    matches with ``<ENTITY>``; placeholders cannot match a later pattern, so the step order
    decides overlaps. Of the entities in ``validate`` only matches that pass their checksum
    are redacted. A pattern that needs an '@' is skipped on text without one, and those that
    need a digit, one after another in the cascade, on text without any: one test for all.

    A step names its text more than once: give it a column, not an expression.
    """
    def together(pats: list[tuple[str, str]]):
        def step(t: Column) -> Column:
            out = t
            for entity, pat in pats:
                out = _step(out, entity, pat, validate)
            return out
        return step

    def guarded(step, needed: str):
        return lambda t: F.when(t.rlike(needed), step(t)).otherwise(t)

    steps = []
    for digits, group in itertools.groupby(patterns("java", extra), lambda p: p[0] in DIGIT_ENTITIES):
        group = list(group)
        if digits:
            steps.append(guarded(together(group), "[0-9]"))
            continue
        for one in group:
            steps.append(guarded(together([one]), "@") if "@" in one[1] else together([one]))
    return steps


def entities_found(original: Column, redacted: Column,
                   extra: list[tuple[str, str]] | None = None) -> Column:
    """Sorted distinct entity types a cascade replaced: a type is present when
    the redacted text holds more of its placeholders than the original did
    (placeholders survive later steps, so this equals "its pattern matched")."""
    orig = F.coalesce(original, F.lit(""))
    none = F.array().cast("array<string>")
    found = [F.when(_occurrences(redacted, placeholder(e)) > _occurrences(orig, placeholder(e)), F.lit(e))
             for e, _ in patterns("java", extra)]
    # a text that came out as it went in holds none, and most do
    return F.when(orig == redacted, none).otherwise(F.array_sort(F.array_compact(F.array(*found))))
