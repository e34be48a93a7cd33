"""Chat-request source: JSON bodies to typed columns.

Bodies come as a column or as the lines of files; both are parsed as variants by one rule.
A body that is no request is split off as rejected and counted nowhere.

``model`` must be a string and ``stream`` a boolean (or null, or missing); messages are free
objects, whatever their fields hold. The prompt is the last message's content; content that
is no string is taken in its printed form: lists in brackets, objects as ``map[k:v ...]`` by
key, numbers as the shortest decimal form, null as ``<nil>``.
"""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_text import is_text, whole_json

MESSAGES_SCHEMA = "array<struct<role:string,content:string>>"


def printed_number(x: float) -> str:
    """A double in its shortest form, with an exponent below 1e-4 and from 1e21 on."""
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0") or "0"
    point = len(digits) + exponent  # digits before the decimal point
    if text == "0":
        body = "0"
    elif -4 < point <= 21:
        whole = text.ljust(point, "0")
        body = (whole[:point] or "0") + ("." + whole[point:] if len(whole) > point else "") if point > 0 else (
            "0." + "0" * -point + text)
    else:
        body = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{point - 1:+03d}"
    return "-" * sign + body


def printed(value) -> str:
    """The printed form of a decoded JSON value."""
    if value is None:
        return "<nil>"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return printed_number(float(value))
    if isinstance(value, list):
        return "[" + " ".join(map(printed, value)) + "]"
    if isinstance(value, dict):
        return "map[" + " ".join(f"{k}:{printed(value[k])}" for k in sorted(value, key=lambda k: k.encode())) + "]"
    return value


def printed_json(value: Column) -> Column:
    """The printed form of JSON text; null for null (only those rows are worked on)."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else printed(json.loads(t))).astype(object),
                        "string")(value)


def parse_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``request`` (``model, messages, stream, prompt``; null when the body is no chat request).

    Messages are ``(role, content)``, a field that is no string as its JSON text. Text after
    the JSON value, a truncated body, a model that is no string, a stream that is no boolean
    or messages that are no objects make it no request; ``null`` is one without any field.

    The body is parsed once per row: ``inline(array(...))`` makes the parsed value a
    generator output, which the optimizer cannot inline back into one parse per
    field access.
    """
    cols = df.columns
    one = df.select(*cols, F.inline(F.array(F.struct(whole_json(F.col(body)).alias("_v")))))
    at = lambda path, kind: F.try_variant_get("_v", f"$[0]{path}", kind)
    kind_of = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    messages = at(".messages", "array<variant>")
    top = F.schema_of_variant(at("", "variant"))
    is_object = lambda m: kind_of(m).startswith("OBJECT") | kind_of(m).isin("VOID", "NULL")
    ok = (F.col("_v").isNotNull() & (top.startswith("OBJECT") | (top == "VOID"))
          & is_text(at(".model", "variant")) & kind_of(at(".stream", "variant")).isin("BOOLEAN", "VOID", "NULL")
          & (kind_of(at(".messages", "variant")).isin("VOID", "NULL") | messages.isNotNull())
          & F.coalesce(F.forall(messages, is_object), F.lit(True)))
    field = lambda m, name: F.try_variant_get(m, f"$.{name}", "variant")
    is_string = lambda v: kind_of(v) == "STRING"
    text = lambda v: F.when(is_string(v), F.try_variant_get(v, "$", "string")).when(
        ~kind_of(v).isin("VOID", "NULL"), F.to_json(v))
    last = field(F.get(messages, F.size(messages) - 1), "content")
    parts = one.select(
        *cols, ok.alias("_ok"), at(".model", "string").alias("_model"), at(".stream", "boolean").alias("_stream"),
        F.transform(messages, lambda m: F.struct(text(field(m, "role")).alias("role"),
                                                 text(field(m, "content")).alias("content"))).alias("_messages"),
        F.when(is_string(last), F.try_variant_get(last, "$", "string")).alias("_said"),
        # the rest of the contents, as JSON; a missing one is no content, null is printed
        F.when(last.isNotNull() & ~is_string(last), F.to_json(last)).alias("_other"))
    request = F.struct(F.col("_model").alias("model"), F.col("_messages").alias("messages"),
                       F.col("_stream").alias("stream"),
                       F.coalesce("_said", printed_json(F.col("_other")), F.lit("")).alias("prompt"))
    return parts.select(*cols, F.when(F.col("_ok"), request).alias("request"))


def accepted(parsed: DataFrame) -> DataFrame:
    """Requests that parsed, flattened to model/messages/stream/prompt."""
    r = F.col("request")
    return parsed.where(r.isNotNull()).select(
        *[c for c in parsed.columns if c != "request"],
        r["model"].alias("model"),
        F.coalesce(r["messages"], F.array().cast(MESSAGES_SCHEMA)).alias("messages"),
        F.coalesce(r["stream"], F.lit(False)).alias("stream"), r["prompt"].alias("prompt"))


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("request").isNull()).drop("request")


def read_request_files(spark, path: str) -> DataFrame:
    """(body, request) of newline-delimited JSON bodies in files, by the rule of
    ``parse_requests``; blank lines are no bodies."""
    lines = spark.read.text(path).select(F.col("value").alias("body"))
    return parse_requests(lines.where(F.length(F.trim("body")) > 0))


def request_body(model: Column, messages: Column, stream: Column) -> Column:
    """Encode a chat request as its JSON body."""
    return F.to_json(F.named_struct(F.lit("model"), model, F.lit("messages"), messages,
                                    F.lit("stream"), stream))
