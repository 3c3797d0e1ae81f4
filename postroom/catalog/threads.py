"""Thread assembly, summaries and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from postroom.catalog.registry import EMAILS_SQL, ISO_SQL, SENDER_SQL, query
from postroom.functions.formatting import iso_timestamp
from postroom.functions.headers import display_sender
from postroom.operators import filters, threads
from postroom.sources import given

_WITH = f"with {EMAILS_SQL}"


@query(
    "thread_assemble",
    """
with m as (
  select *, row_number() over (partition by conv_id order by turn) as rn from conversations
)
select conv_id as thread_id, max(case when rn = 1 then split_part(text, '.', 1) end) as subject,
  count(*) as message_count, min(turn) as first_turn, max(turn) as last_turn from m group by conv_id""",
)
def thread_assemble(spark, sf):
    return threads.thread_heads(
        given.conversation_messages(spark, sf),
        ["thread_id"],
        ["turn"],
        F.min("turn").alias("first_turn"),
        F.max("turn").alias("last_turn"),
    )


def _summary_sql(source: str, thread: str, date: str, sender: str, subject: str, snippet: str, order: str) -> str:
    return f"""
numbered as (
  select *, row_number() over (partition by {thread} order by {order}) as rn from {source}
),
lines as (
  select {thread} as thread_id, rn, rn || '. [' || coalesce({date}, '') || '] ' || coalesce({sender}, 'unknown')
    || ': ' || coalesce(nullif({subject}, ''), '(no subject)') || chr(10) || '   '
    || substring(coalesce({snippet}, ''), 1, 200) as line
  from numbered where rn <= 10
),
joined as (select thread_id, string_agg(line, chr(10) order by rn) as t from lines group by thread_id)
select thread_id, case when length(t) > 500 then substring(t, 1, 497) || '...' else t end as summary
from joined"""


@query(
    "thread_summary",
    "with "
    + _summary_sql(
        "conversations", "conv_id", "cast(turn as varchar)", "role", "split_part(text, '.', 1)", "text", "turn"
    ),
)
def thread_summary(spark, sf):
    return threads.thread_summaries(
        given.conversation_messages(spark, sf), ["thread_id"], ["turn"]
    )


@query(
    "mail_thread_summary",
    f"{_WITH},"
    + _summary_sql("searchable", "gmail_thread_id", ISO_SQL, SENDER_SQL, "subject", "snippet_redacted", "sent_at, id"),
)
def mail_thread_summary(spark, sf):
    """Roll-up of every mail thread of the stand-in."""
    rows = given.emails(
        spark, sf, "id", "gmail_thread_id", "subject", "from_email", "from_name",
        "snippet_redacted", "sent_at", "deleted_at", "transform_completed_at",
    ).where(filters.is_searchable())
    shown = rows.select(
        F.col("gmail_thread_id").alias("thread_id"),
        "id",
        "sent_at",
        "subject",
        iso_timestamp(F.col("sent_at")).alias("date"),
        display_sender(F.col("from_name"), F.col("from_email")).alias("from"),
        F.col("snippet_redacted").alias("snippet"),
    )
    return threads.thread_summaries(shown, ["thread_id"], ["sent_at", "id"])


@query(
    "thread_lookup",
    f"""{_WITH}
select id, gmail_id, {ISO_SQL} as sent from searchable where gmail_thread_id = 't7' and account_id = 2""",
)
def thread_lookup(spark, sf):
    rows = given.emails(
        spark, sf, "id", "gmail_id", "gmail_thread_id", "account_id", "sent_at", "deleted_at",
        "transform_completed_at",
    )
    found = threads.thread_messages(rows, "t7", account_id=2)
    return found.select("id", "gmail_id", iso_timestamp(F.col("sent_at")).alias("sent"))


@query(
    "message_lookup",
    f"""{_WITH}
select id, gmail_id, subject from emails_v where deleted_at is null and (id = 42 or gmail_id = 'm77')""",
)
def message_lookup(spark, sf):
    """By number and by message id."""
    rows = given.emails(spark, sf, "id", "gmail_id", "subject", "deleted_at")
    wanted = filters.by_identifier("42") | filters.by_identifier(" m77 ")
    return rows.where(wanted).select("id", "gmail_id", "subject")


@query(
    "distinct_accounts",
    f"{_WITH} select distinct gmail_thread_id, account_id from searchable",
)
def distinct_accounts(spark, sf):
    """Accounts that take part in every thread."""
    rows = given.emails(
        spark, sf, "gmail_thread_id", "account_id", "deleted_at", "transform_completed_at"
    )
    return rows.where(filters.is_searchable()).select("gmail_thread_id", "account_id").distinct()
