"""Conversation lists and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseframe.functions.clean import strip
from pulseframe.operators.ranking import latest_per_key

CONVERSATION = ["user_id", "conversation_id"]


def chat_clean(messages: DataFrame) -> DataFrame:
    """Two roles only, blank messages dropped."""
    role = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    return messages.withColumn("role", role).filter(strip(F.col("content")) != "")


def chat_history(messages: DataFrame, conversation_id, user_id=None) -> DataFrame:
    """Messages of one conversation in order."""
    rows = messages.filter(F.col("conversation_id") == conversation_id)
    if user_id is not None:
        rows = rows.filter(F.col("user_id") == user_id)
    return rows.orderBy("timestamp", "id")


def chat_last_active(messages: DataFrame) -> DataFrame:
    return messages.groupBy(*CONVERSATION).agg(F.max("timestamp").alias("last_message_at"))


def latest_message(messages: DataFrame) -> DataFrame:
    """Last message of each conversation; equal times are settled by id."""
    return latest_per_key(messages, CONVERSATION, [F.col("timestamp").desc(), F.col("id").desc()])


def session_titles(latest: DataFrame, sessions: DataFrame) -> DataFrame:
    """Conversation list: title and last activity."""
    titles = sessions.select(*CONVERSATION, "title")
    return latest.join(titles, CONVERSATION, "left").select(
        *CONVERSATION, "title", F.col("timestamp").alias("last_active_date")
    )


def recent_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations, newest first; those without messages have no time and come last."""
    return sessions.join(chat_last_active(messages), CONVERSATION, "left").orderBy(
        F.col("last_message_at").desc_nulls_last(), "user_id", "conversation_id"
    )
