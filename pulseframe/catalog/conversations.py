"""Conversation lists and histories."""

from __future__ import annotations

from pulseframe.catalog.registry import query
from pulseframe.catalog.sql import with_parts
from pulseframe.operators import chat as C
from pulseframe.sources import adapter as A

LAST = """SELECT user_id, conversation_id, id, timestamp, role FROM (SELECT *, row_number() OVER (
 PARTITION BY user_id, conversation_id ORDER BY timestamp DESC, id DESC) AS rn FROM msgs) WHERE rn = 1"""


@query("chat_last_active", with_parts("SELECT user_id, conversation_id, max(timestamp) AS last_message_at FROM msgs GROUP BY 1, 2"))
def chat_last_active(spark, sf):
    return C.chat_last_active(A.messages(spark, sf))


@query("latest_message", with_parts("SELECT * FROM last", last=LAST))
def latest_message(spark, sf):
    return C.latest_message(A.messages(spark, sf).select("user_id", "conversation_id", "id", "timestamp", "role"))


@query("session_titles", with_parts("""SELECT l.user_id, l.conversation_id, t.title, l.timestamp AS last_active_date
 FROM last l LEFT JOIN titles t USING (user_id, conversation_id)""", last=LAST))
def session_titles(spark, sf):
    latest = C.latest_message(A.messages(spark, sf).drop("content"))
    return C.session_titles(latest, A.chat_sessions(spark, sf))


@query("chat_history", with_parts("SELECT user_id, conversation_id, id, timestamp, role, content FROM msgs WHERE conversation_id = 3"))
def chat_history(spark, sf):
    return C.chat_history(A.messages(spark, sf), 3)


@query("recent_sessions", with_parts("""SELECT t.user_id, t.conversation_id, t.title, max(m.timestamp) AS last_message_at
 FROM titles t JOIN msgs m USING (user_id, conversation_id) GROUP BY 1, 2, 3"""))
def recent_sessions(spark, sf):
    return C.recent_sessions(A.chat_sessions(spark, sf), A.messages(spark, sf))
