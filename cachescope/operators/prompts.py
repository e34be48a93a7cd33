"""Prompt extraction, message filters and message cleaning.

Messages come either one row per turn (``conv_id, turn, role, content``) or
as an ``array<struct<role, content>>`` column of a parsed chat request; both
forms are supported with built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import prompt_key

KEEP_ROLES = ("user", "assistant")


# ------------------------------------------------------------- array form
def last_message_content(messages: Column | str) -> Column:
    """Content of the final message of any role; '' when there is none."""
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.coalesce(F.when(F.size(m) > 0, F.element_at(m, -1).getField("content")), F.lit(""))


def filter_messages(messages: Column | str) -> Column:
    """Keep messages with a non-empty role and non-null content, as (role, content)."""
    m = F.col(messages) if isinstance(messages, str) else messages
    kept = F.filter(m, lambda x: (F.coalesce(x["role"], F.lit("")) != "") & x["content"].isNotNull())
    return F.transform(kept, lambda x: F.struct(x["role"].alias("role"),
                                                 x["content"].alias("content")))


def clean_session_messages(messages: Column | str) -> Column:
    """Messages worth saving: role user/assistant and non-empty content; meta kept
    only when present."""
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.filter(m, lambda x: x["role"].isin(*KEEP_ROLES)
                    & (F.coalesce(x["content"], F.lit("")) != ""))


# ------------------------------------------------------------- row form
def last_prompt(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn",
                role: str = "role", content: str = "content") -> DataFrame:
    """Per conversation: the final message's content and role (one aggregation,
    partial per partition, no sort)."""
    return messages.groupBy(conv).agg(
        F.coalesce(F.max_by(F.col(content), F.col(turn)), F.lit("")).alias("prompt"),
        F.max_by(F.col(role), F.col(turn)).alias("last_role"),
        F.max(turn).alias("last_turn"))


def message_filter(messages: DataFrame, *, role: str = "role", content: str = "content"
                   ) -> DataFrame:
    return messages.where((F.coalesce(F.col(role), F.lit("")) != "") & F.col(content).isNotNull())


def session_clean(messages: DataFrame, *, role: str = "role", content: str = "content"
                  ) -> DataFrame:
    """Rows worth saving in a session: role user/assistant and non-empty content."""
    return messages.where(F.col(role).isin(*KEEP_ROLES)
                          & (F.coalesce(F.col(content), F.lit("")) != ""))


def session_summary(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn",
                    role: str = "role", content: str = "content") -> DataFrame:
    """Per conversation: number of saved messages (the count the save call returns),
    first/last saved turn and the role of the last one.

    Only combinable aggregates (count/min/max_by), so a conversation holding a
    large share of the rows is reduced map-side and never gathered into one task.
    """
    kept = session_clean(messages, role=role, content=content)
    return kept.groupBy(conv).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.min(turn).alias("first_turn"),
        F.max(turn).alias("last_turn"),
        F.max_by(F.col(role), F.col(turn)).alias("last_role"))


def keyed_prompts(df: DataFrame, text: str = "prompt") -> DataFrame:
    """Add the cache key of a prompt column."""
    return df.withColumn("key", prompt_key(text))
