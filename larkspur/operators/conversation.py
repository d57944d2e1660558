"""Conversations: exchanges, links between turns, transcripts, compaction and episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import token_estimate


def exchanges(rows: DataFrame, key: str, user: str, agent: str, time: str) -> DataFrame:
    """Two messages a row: what the user said, then what the agent answered."""
    message = lambda n, role, c: F.struct(F.concat_ws("-", F.col(key).cast("string"), F.lit(n)).alias("message"), F.lit(n).alias("turn"), F.lit(role).alias("type"), F.col(c).alias("content"))
    return rows.select(F.col(key).alias("conversation"), F.col(time).alias("valid_at"), F.explode(F.array(message(0, "user", user), message(1, "agent", agent))).alias("m")).select("conversation", "valid_at", "m.*")


def next_edges(messages: DataFrame, conversation: str, order: str) -> DataFrame:
    """(conversation, src, dst) from each turn to the next."""
    w = Window.partitionBy(conversation).orderBy(order)
    return messages.select(conversation, F.col(order).alias("src"), F.lead(order).over(w).alias("dst")).where("dst IS NOT NULL")


def turn_pairs(messages: DataFrame, conversation: str, order: str, role: str) -> DataFrame:
    """Each user turn with the first assistant turn after it and before the next user turn, if there is one."""
    w = Window.partitionBy(conversation).orderBy(order)
    rows = messages.withColumns({"next_role": F.lead(role).over(w), "answer_turn": F.lead(order).over(w)})
    return rows.where(F.col(role) == "user").select(conversation, F.col(order).alias("turn"), F.when(F.col("next_role") == "assistant", F.col("answer_turn")).alias("answer_turn"))


def transcripts(messages: DataFrame, conversation: str, order: str, role: str, content: str) -> DataFrame:
    """(conversation, transcript, turns): role-prefixed turns in order, parted by blank lines."""
    turn = F.struct(order, F.concat(F.initcap(role), F.lit(": "), F.coalesce(F.col(content), F.lit(""))).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["line"])
    return messages.groupBy(conversation).agg(F.array_join(lines, "\n\n").alias("transcript"), F.count("*").alias("turns"))


def first_sentences(messages: DataFrame, conversation: str, order: str, content: str) -> DataFrame:
    """(conversation, summary): the first sentence of each turn; what stands in for a summarising model."""
    first = F.struct(order, F.element_at(F.split(F.coalesce(F.col(content), F.lit("")), r"(?<=[.!?])\s+"), 1).alias("s"))
    return messages.groupBy(conversation).agg(F.array_join(F.transform(F.array_sort(F.collect_list(first)), lambda t: t["s"]), " ").alias("summary"))


def compactions(messages: DataFrame, conversation: str, order: str, role: str, content: str, method: str = "extract") -> DataFrame:
    """One record a conversation: summary, counts, token estimates and the share by which it shrank."""
    both = transcripts(messages, conversation, order, role, content).join(first_sentences(messages, conversation, order, content), conversation)
    shrink = F.when(F.length("transcript") > 0, 1 - F.length("summary") / F.length("transcript")).otherwise(0.0)
    return both.select(conversation, F.lit(method).alias("compaction_method"), F.col("summary").alias("content"), F.col("turns").alias("message_count"), token_estimate(F.col("transcript")).alias("original_tokens"), token_estimate(F.col("summary")).alias("compacted_tokens"), shrink.alias("reduction_ratio"))


def compaction_edges(compactions: DataFrame, messages: DataFrame, conversation: str, compaction: str, message: str, now: Column | None = None) -> DataFrame:
    """(src, dst, type, created_at): each compaction to the messages of its conversation that it sums up."""
    both = compactions.select(conversation, F.col(compaction).alias("src")).join(messages.select(conversation, F.col(message).alias("dst")), conversation)
    return both.select("src", "dst", F.lit("summarizes").alias("type"), (F.current_timestamp() if now is None else now).alias("created_at"))


def history(messages: DataFrame, conversation: str, value, order: str, newest_first: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    return messages.where(F.col(conversation) == value).orderBy(F.desc(order) if newest_first else F.asc(order)).offset(offset).limit(limit)


def episodes(links: DataFrame, episode: str, entity: str, time: str) -> DataFrame:
    """(episode, start_time, end_time, entity_count, link_count) from links; counters are derived, never incremented."""
    return links.groupBy(episode).agg(F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.count_distinct(entity).alias("entity_count"), F.count("*").alias("link_count"))


def episodes_found(rows: DataFrame, text: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Episodes by text and time; an open one counts as lasting."""
    if text is not None:
        rows = rows.where(F.lower("name").contains(text.lower()))
    if start is not None:
        rows = rows.where(F.col("start_time") >= start)
    return rows if end is None else rows.where(F.coalesce(F.col("end_time") <= end, F.lit(True)))
