"""Message JSON to rows, and batches of changes into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postroom.functions import headers, mime
from postroom.operators.changes import first_copies
from postroom.sources.store import MESSAGES, MailStore, batch_key

_MESSAGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("threadId", T.StringType()),
        T.StructField("historyId", T.StringType()),
        T.StructField("labelIds", T.ArrayType(T.StringType())),
        T.StructField("snippet", T.StringType()),
        T.StructField("payload", mime.SHALLOW_PAYLOAD),
    ]
)


def parse_messages(raw: DataFrame, received_at=None) -> DataFrame:
    """Rows of the message table plus ``attachments`` (array) from a ``json`` column.

    ``raw`` may carry more columns (account_id, seq); they are kept.  ``received_at``
    replaces an unreadable Date header (the current time by default).
    """
    received = F.current_timestamp() if received_at is None else received_at
    keep = [c for c in raw.columns if c not in ("json", "gmail_id")]
    parsed = raw.withColumn("m", F.from_json("json", _MESSAGE)).withColumn(
        "h", headers.header_map(F.col("m.payload.headers"))
    )

    def header(name: str):
        return F.col("h")[name]

    def none_if_empty(c):
        return F.when(F.size(c) > 0, c)

    raw_from = header("From")
    with_sender = parsed.withColumns(
        {
            "sender": headers.parse_address(raw_from),
            "files": mime.attachment_parts(F.col("m.payload.parts")),
            "cc": headers.parse_address_list(header("Cc")),
            "bcc": headers.parse_address_list(header("Bcc")),
        }
    )
    attachment = F.transform(
        "files",
        lambda p: F.struct(
            p["body"]["attachmentId"].alias("gmail_attachment_id"),
            p["filename"].alias("filename"),
            F.coalesce(p["mimeType"], F.lit("application/octet-stream")).alias("mime_type"),
            F.coalesce(p["body"]["size"], F.lit(0)).cast("int").alias("size_bytes"),
            mime.is_inline(p).alias("is_inline"),
        ),
    )
    return with_sender.select(
        *keep,
        # A stable surrogate: equal on every run and every executor.
        F.xxhash64("m.id").alias("id"),
        F.col("m.id").alias("gmail_id"),
        F.col("m.threadId").alias("gmail_thread_id"),
        F.expr("try_cast(m.historyId as bigint)").alias("history_id"),
        F.coalesce(header("Subject"), F.lit("")).alias("subject"),
        F.coalesce(
            F.nullif("sender.email", F.lit("")), raw_from, F.lit("unknown")
        ).alias("from_email"),
        F.nullif("sender.name", F.lit("")).alias("from_name"),
        headers.parse_address_list(header("To")).alias("to_emails"),
        none_if_empty(F.col("cc")).alias("cc_emails"),
        none_if_empty(F.col("bcc")).alias("bcc_emails"),
        F.nullif(header("Reply-To"), F.lit("")).alias("reply_to"),
        F.coalesce(headers.parse_date(header("Date")), received).alias("sent_at"),
        F.coalesce("m.labelIds", F.array().cast("array<string>")).alias("labels"),
        mime.body_text(F.get_json_object("json", "$.payload")).alias("body_text"),
        F.coalesce("m.snippet", F.lit("")).alias("snippet"),
        (F.size("files") > 0).alias("has_attachments"),
        F.size("files").alias("attachment_count"),
        attachment.alias("attachments"),
    )


def attachment_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("gmail_id", F.explode("attachments").alias("a")).select("gmail_id", "a.*")


def insert_messages(store: MailStore, parsed: DataFrame, batch: str, checked: bool = True) -> DataFrame:
    """Append messages that are not stored yet; returns the rows of this batch (see ``batch_key``).

    A stored id is never inserted twice, not even after a delete: a re-add brings the
    stored row back through the change log.  ``checked=False``: the caller knows that no id is stored.
    """
    fresh = first_copies(parsed)
    if checked:
        fresh = fresh.join(store.stored_ids(without=batch), "gmail_id", "left_anti")
    columns = [f.name for f in store.spark.createDataFrame([], MESSAGES).schema]
    # Both tables come from one written copy, so payloads are parsed once.
    store.append("staged", fresh, "batch", batch)
    staged = store.spark.read.parquet(f"{store.path('staged')}/batch={batch}")
    store.append("messages", staged.select(*columns), "batch", batch)
    store.append("attachments", attachment_rows(staged), "batch", batch)
    return staged


def record_changes(store: MailStore, feed: DataFrame, batch: str) -> None:
    store.append("changes", feed.select("gmail_id", "op", "seq", "at"), "batch", batch)


def sync_event(
    store: MailStore, account_id: int, kind: str, status: str, processed: int, batch: int, error=None, run: str = "0"
) -> None:
    """Audit row: started, completed or failed."""
    now = F.current_timestamp()
    row = store.spark.range(1).select(
        F.lit(account_id).cast("int").alias("account_id"),
        F.lit(kind).alias("event_type"),
        F.lit(status).alias("status"),
        F.lit(processed).cast("long").alias("emails_processed"),
        F.lit(error).cast("string").alias("error_message"),
        F.lit(batch).cast("long").alias("batch"),
        now.alias("at"),
    )
    # Started and finished rows of a batch are separate folders, so both are kept.
    store.append(f"sync_events/phase={status}", row, "writer", batch_key(account_id, kind, batch, run))
