"""Chat sessions kept as an append-only log of saves and deletes.

Log columns: ``session_id, updated_at, op ('save'|'delete'), payload, model``.
Loading a session as of a time = the latest log row per id at or before
``as_of`` (``max_by``, combinable, so a hot session is reduced map-side); it
is visible when that row is a save newer than ``as_of - ttl``. Missing,
deleted or expired sessions come back with the defaults.

A payload is the stored object ``{"messages": [...], "model": ..., "updatedAt": ...}``; a
bare array of messages is read as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.json_text import is_text, whole_json
from .prompts import KEEP_ROLES
from ..functions.text import session_id_valid
from ..functions.timefmt import ts_literal


def split_valid_ids(df: DataFrame, id_col: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows by the UUID shape of ``id_col``."""
    ok = session_id_valid(id_col)
    return df.where(ok), df.where(~ok)


def latest_state(log: DataFrame, as_of: str, *, ttl_seconds: int = config.SESSION_TTL_SECONDS
                 ) -> DataFrame:
    """Visible sessions at ``as_of``: one row per live session id."""
    upto = ts_literal(as_of)
    rows = log.where(F.col("updated_at") <= upto)
    latest = rows.groupBy("session_id").agg(
        F.max_by(F.struct("op", "updated_at", "payload", "model"),
                 F.struct("updated_at", F.col("op") == "delete")).alias("s"))
    alive = (F.col("s.op") == "save") & (
        F.timestamp_diff("SECOND", F.col("s.updated_at"), upto) < F.lit(ttl_seconds))
    return latest.where(alive).select(
        "session_id", F.col("s.updated_at").alias("updated_at"), F.col("s.payload").alias("payload"),
        F.col("s.model").alias("model"))


MESSAGES = "array<struct<role:string,content:string,meta:string,raw:string>>"


def _member(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _text(value: Column) -> Column:
    return F.when(is_text(value), F.try_variant_get(value, "$", "string"))


def _json(value: Column) -> Column:
    return F.when(F.coalesce(F.schema_of_variant(value), F.lit("VOID")) != "VOID", F.to_json(value))


def messages_of(payload: Column) -> Column:
    """The messages of a saved payload as (role, content, meta, raw); none if it is missing or
    no such JSON. ``raw`` is the message's JSON and ``meta`` that of its meta, null without one;
    a role that is no text is null, content that is no text is its JSON."""
    v = whole_json(payload)
    found = F.coalesce(F.try_variant_get(v, "$[0].messages", "array<variant>"), F.try_variant_get(v, "$[0]", "array<variant>"))
    return F.coalesce(F.transform(found, lambda m: F.struct(
        _text(_member(m, "role")).alias("role"), F.coalesce(_text(_member(m, "content")), _json(_member(m, "content"))).alias("content"),
        _json(_member(m, "meta")).alias("meta"), F.to_json(m).alias("raw"))), F.array().cast(MESSAGES))


def model_of(payload: Column) -> Column:
    """The model named in a saved payload; null if there is none."""
    return _text(F.try_variant_get(whole_json(payload), "$[0].model", "variant"))


def worth_saving(messages: Column) -> Column:
    """Of messages as :func:`messages_of` gives them those that a save keeps, as (role, content,
    meta): from the user or the assistant, with content; meta that holds nothing is left out."""
    empty = lambda c: F.coalesce(c, F.lit("")).isin("", "null", "false", "0", "0.0", "[]", "{}", '""')
    said = lambda m: F.when(_is_string(m), m["content"] != "").otherwise(~empty(m["content"]))
    kept = F.filter(messages, lambda m: m["role"].isin(*KEEP_ROLES) & F.coalesce(said(m), F.lit(False)))
    return F.transform(kept, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"),
                                                F.when(~empty(m["meta"]), m["meta"]).alias("meta")))


def _is_string(message: Column) -> Column:
    return F.coalesce(F.schema_of_variant(_member(F.try_parse_json(message["raw"]), "content")), F.lit("")) == "STRING"


def load(requested: DataFrame, log: DataFrame, as_of: str, *,
         ttl_seconds: int = config.SESSION_TTL_SECONDS,
         default_model: str = config.DEFAULT_CHAT_MODEL, id_col: str = "session_id") -> DataFrame:
    """Session state for each requested id, its messages decoded (defaults when not found)."""
    state = latest_state(log, as_of, ttl_seconds=ttl_seconds)
    req = requested.select(F.col(id_col).alias("session_id")).distinct()
    return req.join(state, "session_id", "left").select(
        "session_id",
        F.col("updated_at").isNotNull().alias("found"),
        F.coalesce(model_of(F.col("payload")), F.col("model"), F.lit(default_model)).alias("model"),
        "updated_at", "payload", messages_of(F.col("payload")).alias("messages"))


def stored_payload(messages: Column, model: Column, at: Column) -> Column:
    """The object that is stored for a session, of messages as (role, content, meta as JSON)."""
    said = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"),
                                                    F.try_parse_json(m["meta"]).alias("meta")))
    return F.to_json(F.struct(said.alias("messages"), model.alias("model"),
                              F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("updatedAt")))


def save_rows(session_id: Column, messages: Column, model: Column, at: Column) -> list[Column]:
    """Columns of a save entry for the log, of messages as (role, content, meta as JSON)."""
    return [session_id.alias("session_id"), at.alias("updated_at"), F.lit("save").alias("op"),
            stored_payload(messages, model, at).alias("payload"), model.alias("model")]
