"""Scalar text expressions: prompt keys, previews, quoting, id checks.

All of them are built-in Spark expressions (whole-stage codegen, no Python).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

# Unicode-aware whitespace at either end (Java regex; `trim()` strips only spaces).
WS_EDGES = r"(?U)^\s+|\s+$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ws_trim(text: Column | str) -> Column:
    """Strip leading/trailing whitespace of any kind (tabs, newlines, NBSP...)."""
    return F.regexp_replace(_c(text), WS_EDGES, "")


def lower(text: Column | str) -> Column:
    """Lower case letter by letter: the JVM alone would write a word-final sigma as 'ς'."""
    return F.lower(F.translate(_c(text), "Σ", "σ"))


def prompt_key(text: Column | str) -> Column:
    """Cache key of a prompt: 'prompt:' + first 16 bytes (32 hex) of SHA-256(trim(lower(text)))."""
    return F.concat(F.lit(config.KEY_PREFIX),
                    F.left(F.sha2(ws_trim(lower(text)), 256), F.lit(32)))


def preview_chars(text: Column | str, n: int, ellipsis: bool = True) -> Column:
    """First ``n`` characters, plus '…' only when something was cut."""
    t = _c(text)
    cut = F.left(t, F.lit(n))
    if ellipsis:
        cut = F.concat(cut, F.lit(config.ELLIPSIS))
    return F.when(F.length(t) > n, cut).otherwise(t)


def preview_bytes(text: Column | str, n: int) -> Column:
    """First ``n`` UTF-8 bytes plus '…' when longer; a character cut in the
    middle becomes U+FFFD (the byte form the gateway's Go side emits)."""
    t = _c(text)
    head = F.make_valid_utf8(F.substring(F.encode(t, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(t) > n, F.concat(head, F.lit(config.ELLIPSIS))).otherwise(t)


def go_quote(text: Column | str) -> Column:
    """Double-quoted string with backslash escapes for quote, backslash and control chars."""
    t = _c(text)
    for raw, esc in (("\\\\", "\\\\\\\\"), ('"', '\\\\"'), ("\n", "\\\\n"), ("\r", "\\\\r"),
                     ("\t", "\\\\t")):
        t = F.regexp_replace(t, raw, esc)
    return F.concat(F.lit('"'), t, F.lit('"'))


def session_id_valid(session_id: Column | str) -> Column:
    """8-4-4-4-12 hex UUID form, case-insensitive, and nothing after it: in Java ``$`` also
    matches before a final line break, ``\\z`` does not."""
    whole = config.SESSION_ID_PATTERN.removesuffix("$") + r"\z"
    return F.coalesce(_c(session_id).rlike("(?i)" + whole), F.lit(False))


def first_non_empty(*cols: Column | str) -> Column:
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])
