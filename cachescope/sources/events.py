"""Telemetry event encoding and decoding (the stored JSON form of an event).

Optional fields (detail, metadata) are omitted from the JSON when empty;
decoding drops rows that do not parse and reads both timestamp spellings
(``2024-01-01T00:00:07Z`` and ``2024-01-01T00:00:07.179575+00:00``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_SCHEMA = ("struct<type:string,message:string,detail:string,timestamp:string,"
                "metadata:map<string,string>>")


def rfc3339_seconds(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_offset(ts: Column | str) -> Column:
    """The worker's spelling: an offset instead of Z, microseconds unless there are none."""
    c = F.col(ts) if isinstance(ts, str) else ts
    whole = F.unix_micros(c.cast("timestamp")) % 1_000_000 == 0
    return F.concat(F.when(whole, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.lit("+00:00"))


def encode_events(events: DataFrame, spelling=rfc3339_seconds) -> DataFrame:
    """``type, message, detail, ts, metadata`` -> ``json`` (to_json drops nulls), times in
    ``spelling`` (``rfc3339_seconds``, or ``iso_offset`` for the worker's)."""
    return events.select(F.to_json(F.struct(
        F.col("type"), F.col("message"),
        F.nullif(F.col("detail"), F.lit("")).alias("detail"),
        spelling("ts").alias("timestamp"),
        F.when(F.cardinality("metadata") > 0, F.col("metadata")).alias("metadata"))).alias("json"))


def parse_event_time(s: Column | str) -> Column:
    """RFC 3339 text (any offset) -> naive UTC timestamp, whatever the session zone."""
    c = F.col(s) if isinstance(s, str) else s
    instant = F.coalesce(
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")),
    )
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant),
                           F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def decode_events(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Stored JSON -> typed event rows; malformed rows are dropped silently.

    ``inline(array(from_json(...)))`` parses each row once: a generator's
    output columns cannot be inlined back into per-field ``from_json`` calls.
    """
    parsed = raw.select(F.inline(F.array(F.from_json(F.col(json_col), EVENT_SCHEMA,
                                                     {"mode": "PERMISSIVE"}))))
    return parsed.where(F.col("type").isNotNull()).select(
        "type", "message",
        F.coalesce(F.col("detail"), F.lit("")).alias("detail"),
        "timestamp",
        parse_event_time(F.col("timestamp")).alias("ts"),
        F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")).alias("metadata"))
