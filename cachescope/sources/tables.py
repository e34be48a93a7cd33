"""Readers for the input tables and the fixture views derived from them.

Every view is a lazy DataFrame over the Parquet scan, so filters and column
pruning reach the reader. The same definitions exist as SQL in
``cachescope.plans.oracle`` for the DuckDB cross-check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_CHAT_MODEL
from ..operators.sessions import stored_payload

# fixed values: the PII entity types, in the gateway's order
PII_ENTITY_TYPES = ["CREDIT_CARD", "EMAIL_ADDRESS", "IBAN_CODE", "IP_ADDRESS",
                    "PHONE_NUMBER", "US_SSN", "PERSON"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _props_k() -> Column:
    return F.get_json_object("props", "$.k").try_cast("int")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    # a stream's path must be a folder or a pattern, and a small table is one file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.removesuffix(".parquet") + "[.]parquet")


def gw_requests(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Request log: non-error events; view/click are hits, distance = k/1000 on hits.
    ``events`` takes the place of the table (its stream)."""
    ev = (table(spark, sf_dir, "events") if events is None else events).where(F.col("event_type") != "error")
    hit = F.col("event_type").isin("view", "click")
    return ev.select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.col("user_id").alias("tenant"),
        F.when(hit, F.lit("HIT")).otherwise(F.lit("MISS")).alias("outcome"),
        F.floor("value").cast("bigint").alias("latency_ms"),
        F.when(hit, _props_k() / F.lit(1000.0)).alias("distance"),
    )


def gw_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PII-block log written by the worker: error events, entity chosen by k mod 7."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    types = F.array(*[F.lit(t) for t in PII_ENTITY_TYPES])
    return ev.select(
        "event_id",
        "ts",
        F.element_at(types, (F.pmod(_props_k(), F.lit(len(PII_ENTITY_TYPES))) + 1).cast("int"))
        .alias("entity"),
        F.concat(F.lit("[REDACTED] request "), F.col("event_id").cast("string")).alias("message"),
    )


def gw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages, one row per turn."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("content"))


def gw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt, response) pairs: a user turn directly followed by an assistant turn.

    "Directly followed" is turn + 1, so the pairing is an equi-join on
    (conv_id, turn): a conversation holding a large share of the rows is split
    by AQE's skew-join handling instead of being sorted in one task (as a
    window over the conversation would be).
    """
    conv = table(spark, sf_dir, "conversations")
    users = conv.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt"), (F.col("turn") + 1).alias("_next"))
    replies = conv.where(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("_next"), F.col("text").alias("response"))
    return users.join(replies, ["conv_id", "_next"]).select("conv_id", "turn", "prompt", "response")


def vec_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, vec_id doubling as arrival order."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def uuid_from_hex(hex32: Column) -> Column:
    """Format 32 hex digits as 8-4-4-4-12."""
    return F.concat_ws("-", F.substring(hex32, 1, 8), F.substring(hex32, 9, 4),
                       F.substring(hex32, 13, 4), F.substring(hex32, 17, 4),
                       F.substring(hex32, 21, 12))


def gw_session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session-id candidates, one per message: a UUID made from md5(text),
    upper-cased on turns 1, 4, 7..., cut by one character on turns 2, 5, 8..."""
    conv = table(spark, sf_dir, "conversations")
    u = uuid_from_hex(F.md5(F.col("text")))
    shape = F.pmod(F.col("turn"), F.lit(3))
    cand = (F.when(shape == 0, u).when(shape == 1, F.upper(u))
            .otherwise(F.substring(u, 1, 35)))
    return conv.select("conv_id", "turn", cand.alias("session_id"))


def gw_session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save/delete log of chat sessions: every turn of conversation c is a save of
    session uuid(md5(c)) at 2024-01-01 + c hours + turn minutes, whose payload is the stored
    object with a system message and the turn's (with meta on even turns), or of every fifth
    conversation its bare text; a conversation whose last turn is a user turn is deleted one
    minute after it. Every third conversation names a model of its own in the payload."""
    conv = table(spark, sf_dir, "conversations")
    sid = uuid_from_hex(F.md5(F.col("conv_id").cast("string")))
    at = F.timestamp_add("MINUTE", F.col("conv_id") * 60 + F.col("turn"),
                         F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    meta = F.when(F.col("turn") % 2 == 0, F.format_string('{"turn":%d}', "turn"))
    message = lambda role, text, m: F.struct(role.alias("role"), text.alias("content"), m.alias("meta"))
    messages = F.array(message(F.lit("system"), F.lit("be brief"), F.lit(None).cast("string")),
                       message(F.col("role"), F.col("text"), meta))
    model = F.when(F.col("conv_id") % 3 == 0, F.lit("own-model")).otherwise(F.lit(DEFAULT_CHAT_MODEL))
    payload = F.when(F.col("conv_id") % 5 == 4, F.col("text")).otherwise(stored_payload(messages, model, at))
    saves = conv.select(sid.alias("session_id"), at.alias("updated_at"), F.lit("save").alias("op"),
                        payload.alias("payload"), F.lit(DEFAULT_CHAT_MODEL).alias("model"))
    last = conv.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"),
                                       F.max("turn").alias("turn"))
    deletes = last.where(F.col("last_role") == "user").select(
        sid.alias("session_id"), F.timestamp_add("MINUTE", F.lit(1), at).alias("updated_at"),
        F.lit("delete").alias("op"), F.lit(None).cast("string").alias("payload"),
        F.lit(None).cast("string").alias("model"))
    return saves.unionByName(deletes)
