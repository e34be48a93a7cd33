"""Response-body text reassembly (server-sent events and plain JSON bodies).

Both are pure Spark expressions over the JSON parser's variant values, which keep
the types of the text: a field that must be a string takes no number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ws_trim

SSE_PREFIX = "data: "
SSE_DONE = "[DONE]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def whole_json(text: Column) -> Column:
    """A text that is one JSON value and nothing else, as a one-element variant array; null
    otherwise. (The parser alone would accept a value with other text after it.)"""
    parsed = F.array(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    return F.transform(parsed, lambda v: F.when(F.size(F.try_variant_get(v, "$", "array<variant>")) == 1, v))[0]


def is_text(v: Column) -> Column:
    """A variant that a string field takes: a string, null or nothing - not a number."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID")).isin("STRING", "VOID", "NULL")


_CHOICE = "struct<delta:struct<content:variant>,message:struct<content:variant>>"


def _pieces(payload: Column) -> Column:
    """(delta text, message text) of every choice, or null for a payload that is not JSON
    or holds content of another type."""
    return F.transform(F.array(F.try_variant_get(whole_json(payload), "$[0].choices", f"array<{_CHOICE}>")), lambda cs: F.when(
        F.forall(cs, lambda c: is_text(c["delta"]["content"]) & is_text(c["message"]["content"])),
        F.transform(cs, lambda c: F.struct(
            F.coalesce(F.try_variant_get(c["delta"]["content"], "$", "string"), F.lit("")).alias("delta"),
            F.coalesce(F.try_variant_get(c["message"]["content"], "$", "string"), F.lit("")).alias("message")))))[0]


def lines_text(lines: Column) -> Column:
    """Text of the lines of an SSE body: every ``data: `` line except ``[DONE]``, parsed as
    JSON; lines that don't parse or whose content is no string are skipped. Per choice the
    delta content, then the message content, in order."""
    data = F.filter(lines, lambda l: l.startswith(SSE_PREFIX))
    payloads = F.filter(F.transform(data, lambda l: ws_trim(F.substr(l, F.lit(len(SSE_PREFIX) + 1)))),
                        lambda p: p != SSE_DONE)
    parsed = F.filter(F.transform(payloads, _pieces), lambda p: p.isNotNull())
    return F.array_join(F.transform(F.flatten(parsed), lambda c: F.concat(c["delta"], c["message"])), "")


def sse_text(body: Column | str) -> Column:
    """Text of a whole SSE body (:func:`lines_text`). The whole body is parsed at once, so a
    line is never lost at a read boundary."""
    return lines_text(F.split(F.coalesce(_c(body), F.lit("")), "\n"))


def json_text(body: Column | str, fallback_to_body: bool = True) -> Column:
    """Concatenated message content of all choices; the raw body when that is empty, or when
    the body doesn't parse or holds content that is no string."""
    b = _c(body)
    text = F.coalesce(F.array_join(F.transform(_pieces(b), lambda c: c["message"]), ""), F.lit(""))
    if fallback_to_body:
        return F.when(text == "", F.coalesce(b, F.lit(""))).otherwise(text)
    return text


def sse_body(chunks: Column | str) -> Column:
    """Encode an array of text chunks as an SSE body ending in ``[DONE]`` (the form a
    cache hit is served in; also used to build test bodies)."""
    ch = _c(chunks)
    lines = F.transform(ch, lambda c: F.concat(F.lit(SSE_PREFIX), F.to_json(F.named_struct(
        F.lit("choices"), F.array(F.named_struct(F.lit("delta"), F.named_struct(F.lit("content"), c))))),
        F.lit("\n\n")))
    return F.concat(F.array_join(lines, ""), F.lit(f"{SSE_PREFIX}{SSE_DONE}\n\n"))


def json_body(text: Column | str) -> Column:
    """A one-choice chat-completion JSON body holding ``text``."""
    return F.to_json(F.named_struct(F.lit("choices"), F.array(F.named_struct(
        F.lit("message"), F.named_struct(F.lit("content"), _c(text))))))
