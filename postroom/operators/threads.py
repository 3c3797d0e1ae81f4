"""Threads: messages in order, per-thread heads, roll-up summaries, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postroom.operators.filters import is_searchable

SUMMARY_MESSAGES = 10
SUMMARY_SNIPPET = 200
SUMMARY_LENGTH = 500


def thread_messages(emails: DataFrame, thread_id: str, account_id: int | None = None) -> DataFrame:
    """Searchable messages of one thread, oldest first."""
    mine = is_searchable(account_id) & (F.col("gmail_thread_id") == thread_id)
    return emails.where(mine).orderBy("sent_at", "id")


def thread_heads(messages: DataFrame, thread: list[str], order: list[str], *more: Column) -> DataFrame:
    """One row per thread: subject of its first message, message count, first and last time.

    Only fixed-size aggregates, combined map-side, so a thread of any length is fine;
    the messages themselves stay rows (sorted by thread and time), never one list.
    """
    return messages.groupBy(*thread).agg(
        F.min_by("subject", F.struct(*order)).alias("subject"),
        F.count("*").alias("message_count"),
        *more,
    )


def thread_summaries(messages: DataFrame, thread: list[str], order: list[str]) -> DataFrame:
    """Text roll-up of the first ten messages of every thread.

    ``messages`` needs the columns date, from, subject and snippet.  The row-number
    filter runs before the shuffle too (window group limit), so a long thread sends at
    most ten rows per task.
    """
    first = Window.partitionBy(*thread).orderBy(*order)
    numbered = messages.withColumn("nth", F.row_number().over(first)).where(
        F.col("nth") <= SUMMARY_MESSAGES
    )
    return numbered.groupBy(*thread).agg(summary_text().alias("summary"))


def summary_text() -> Column:
    """Aggregate over at most ten rows with a column ``nth``."""
    line = F.concat(
        F.col("nth").cast("string"),
        F.lit(". ["),
        F.coalesce("date", F.lit("")),
        F.lit("] "),
        F.coalesce("from", F.lit("unknown")),
        F.lit(": "),
        F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.lit("(no subject)")),
        F.lit("\n   "),
        F.substring(F.coalesce("snippet", F.lit("")), 1, SUMMARY_SNIPPET),
    )
    lines = F.sort_array(F.collect_list(F.struct("nth", line.alias("line"))))
    text = F.array_join(F.transform(lines, lambda s: s["line"]), "\n")
    return F.when(
        F.length(text) > SUMMARY_LENGTH,
        F.concat(F.substring(text, 1, SUMMARY_LENGTH - 3), F.lit("...")),
    ).otherwise(text)


def upsert_threads(threads: DataFrame, inserted: DataFrame) -> DataFrame:
    """Add newly inserted messages to the thread table: counts add up, last time moves on.

    ``inserted`` has account_id, gmail_thread_id, subject, sent_at, seq.
    """
    key = ["account_id", "gmail_thread_id"]
    fresh = inserted.groupBy(*key).agg(
        F.min_by("subject", "seq").alias("new_subject"),
        F.count("*").alias("new_count"),
        F.max("sent_at").alias("new_last"),
    )
    return threads.join(fresh, key, "full").select(
        *key,
        F.when(F.col("message_count").isNull(), F.col("new_subject"))
        .otherwise(F.col("subject"))
        .alias("subject"),
        (F.coalesce("message_count", F.lit(0)) + F.coalesce("new_count", F.lit(0))).alias(
            "message_count"
        ),
        F.greatest("last_message_at", "new_last").alias("last_message_at"),
    )
