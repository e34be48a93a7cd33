"""Operator 6: quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps what was measured and one
failure bit per rule; a policy is a named, versioned set of rules, and applying it is
one bitwise AND, so a new version needs no second look at the texts. Ablations - what a
policy would keep without one of its rules - are sums over bitwise tests in a single
aggregation over the ledger, of a handful of counters per task.

Measurements come from one pass over the whole text in Python (bounded by the text);
rules and policies are column expressions over them.

Defined cases: null or empty text has no words and all measurements 0 (it fails
``few_words``); words are runs of anything but ASCII white space; repeated rows are judged
alike; an empty table gives an empty ledger and ablations of zeros; input columns named
like an output column are replaced, all others kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, WORD_RE, columns_apart

#: Measurements of a text, all bigint.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_digits", "n_upper")

#: Rules by bit: name and the condition (SQL over the measurements) under which a text FAILS.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("digits", "100 * n_digits > 30 * word_chars"),
    ("capitals", "100 * n_upper > 50 * word_chars"),
)

#: Versioned policies: the rules that each enforces.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "web-2": tuple(name for name, _ in RULES),
}
#: The policy whose verdict the registered query reports.
POLICY = "web-2"

_WORD = re.compile(WORD_RE)
_SYMBOLS, _DIGITS, _CAPITALS = "#*$%&|<>", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def mask_of(policy: str) -> int:
    bits = {name: 1 << k for k, (name, _) in enumerate(RULES)}
    return sum(bits[r] for r in POLICIES[policy])


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of three found twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    size = int(ids.max()) + 1
    key = ids[:-2].astype("i8") * size + ids[1:-1]
    if size >= 1 << 21:  # three ids would not fit into 64 bits: number the pairs first
        key = np.unique(key, return_inverse=True)[1].astype("i8")
    _, where, count = np.unique(key * size + ids[2:], return_inverse=True, return_counts=True)
    again = count[where] > 1
    in_window = np.zeros(n + 2, dtype=bool)
    for k in range(3):
        in_window[k:k + n] |= again
    return int(in_window.sum())


def measure_text(text: str) -> tuple[int, ...]:
    words = _WORD.findall(text)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype="i8", count=len(words))
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    count = lambda chars: sum(map(text.count, chars))
    return (len(words), sum(map(len, words)), count(_SYMBOLS), len(lines) - len(set(lines)),
            repeated_words(ids), len(lines), count(_DIGITS), count(_CAPITALS))


def _measure_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([measure_text(t) for t in batch], columns=list(MEASURES), dtype="i8")


def failure_bits() -> Column:
    """One bit per rule, from the measurement columns."""
    bits = F.lit(0).cast("bigint")
    for k, (_, fails) in enumerate(RULES):
        bits = bits + F.when(F.expr(fails), F.lit(1 << k)).otherwise(0).cast("bigint")
    return bits


@columns_apart("text")
def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with every measurement and ``fail_bits``."""
    cols = [c for c in docs.columns if c not in (*MEASURES, "fail_bits", text)]
    measure = F.pandas_udf(_measure_batches, "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">")
    return (docs.select(*[docs[c] for c in cols], measure(F.coalesce(docs[text], F.lit(""))).alias("_m"))
            .select(*cols, *[F.col(f"_m.{m}").alias(m) for m in MEASURES])
            .withColumn("fail_bits", failure_bits()))


def apply_policy(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """A ledger with ``policy, base_failed, kept``."""
    failed = lambda p: F.col("fail_bits").bitwiseAND(F.lit(mask_of(p)).cast("bigint")) != 0
    return (rows.withColumn("policy", F.lit(policy)).withColumn("base_failed", failed("base-1"))
            .withColumn("kept", ~failed("base-1") & ~failed(policy)))


def ablations(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """(policy, rule, n_docs, n_fail, n_only, kept, kept_without): for each rule of a
    policy the documents that fail it, that fail nothing else, and what the policy keeps
    with and without it. One aggregation over the bits of a ledger."""
    mask = mask_of(policy)
    own = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint"))
    rules = [(k, name) for k, (name, _) in enumerate(RULES) if mask >> k & 1]
    total = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"), total(own == 0).alias("kept"),
        *[total(own.bitwiseAND(F.lit(1 << k).cast("bigint")) != 0).alias(f"f{k}") for k, _ in rules],
        *[total(own == (1 << k)).alias(f"o{k}") for k, _ in rules])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"f{k}").alias("n_fail"),
                                        F.col(f"o{k}").alias("n_only")) for k, name in rules]))
    return (sums.select("n", "kept", each.alias("r"))
            .select(F.lit(policy).alias("policy"), "r.rule", F.col("n").alias("n_docs"), "r.n_fail", "r.n_only", "kept",
                    (F.col("kept") + F.col("r.n_only")).alias("kept_without")))
