"""Mail-shaped views over the given tables.

No mail table is given, so emails come from ``documents`` (body), ``events`` (time),
``labels`` (tier), ``embeddings`` (vectors); label names from ``nation``; threads from
``conversations``; changes from ``events``; payloads from ``documents`` and ``pages``.
A view joins only the tables that the asked columns need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom import fixed_values as fv

TIMES = ("sent_at", "deleted_at", "transform_completed_at", "updated_at")
VECTORS = ("body_embedding", "body_pooled_embedding", "subject_embedding")
TIER = ("privacy_tier", "snippet_redacted")
BASE = (
    "id", "account_id", "gmail_id", "gmail_thread_id", "subject", "from_email", "from_name",
    "to_emails", "labels", "body_text", "snippet", "body_redacted", "has_attachments",
)
ALL = BASE + TIMES + VECTORS + TIER


#: Session setting, unset by default: deal the text tables out to so many partitions when they are
#: read.  For tables in a single row group, which no scan can split; it is the user's choice and
#: does not depend on any size.
INPUT_PARTITIONS = "spark.postroom.inputPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    asked = spark.conf.get(INPUT_PARTITIONS, None) if name in ("documents", "pages") else None
    return read.repartition(int(asked)) if asked else read


def masked(c):
    return F.translate(c, "0123456789", "##########")


def emails(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The mail stand-in with the given columns (all of them by default)."""
    wanted = columns or ALL
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    df = d
    if set(wanted) & set(TIMES):
        e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
        df = df.join(e, "doc_id", "left")
    if set(wanted) & set(TIER):
        lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
        df = df.join(lab, "doc_id", "left")
    if set(wanted) & set(VECTORS):
        v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        df = df.join(v, "doc_id", "left")
    has_time, has_tier = "ts" in df.columns, "toxic" in df.columns

    def tier():
        return (
            F.when(F.col("toxic") == 1, F.lit(1))
            .when(F.col("quality") == 0, F.lit(2))
            .otherwise(F.lit(3))
        )

    def first_line():
        return F.substring_index("text", "\n", 1)

    def second_line():
        two = F.substring_index("text", "\n", 2)
        return F.when(F.col("text").contains("\n"), F.substring_index(two, "\n", -1)).otherwise(
            F.lit("")
        )

    def shown_snippet():
        return F.when(tier() != 3, F.lit(fv.SNIPPET_PLACEHOLDER)).otherwise(
            F.nullif(masked(second_line()), F.lit(""))
        )

    # Only the asked columns are built.
    expr = {
        "id": lambda: i,
        "account_id": lambda: (i % 3 + 1).cast("int"),
        "gmail_id": lambda: F.concat(F.lit("m"), i.cast("string")),
        "gmail_thread_id": lambda: F.concat(F.lit("t"), F.floor(i / 4).cast("string")),
        "subject": lambda: F.when(i % 11 != 0, F.substring_index(first_line(), ".", 1)),
        "from_email": lambda: F.concat("source", F.lit("@"), "lang", F.lit(".example.com")),
        "from_name": lambda: F.when(i % 5 != 0, F.concat(F.lit("Sender "), "source")),
        "to_emails": lambda: F.array(
            F.concat(F.lit("team@"), "lang", F.lit(".example.com")),
            F.when(i % 4 == 0, F.concat("source", F.lit("@list.example.com"))),
        ),
        "labels": lambda: F.array("lang", "source", F.concat(F.lit("L"), (i % 25).cast("string"))),
        "body_text": lambda: F.col("text"),
        "snippet": second_line,
        "body_redacted": lambda: F.when(i % 19 != 0, masked(F.col("text"))),
        "has_attachments": lambda: i % 7 == 0,
    }
    if has_time:
        expr |= {
            "sent_at": lambda: F.col("ts"),
            "deleted_at": lambda: F.when(i % 13 == 0, F.col("ts")),
            "transform_completed_at": lambda: F.when(i % 17 != 0, F.col("ts")),
            "updated_at": lambda: F.col("ts"),
        }
    if has_tier:
        expr |= {"privacy_tier": tier, "snippet_redacted": shown_snippet}
    if "embedding" in df.columns:
        expr |= {
            "body_embedding": lambda: F.when(i % 3 == 0, F.col("embedding")),
            "body_pooled_embedding": lambda: F.when(i % 3 < 2, F.col("embedding")),
            "subject_embedding": lambda: F.col("embedding"),
        }
    return df.select(*[expr[c]().alias(c) for c in wanted])


def account_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account knows the nations' labels whose number matches it."""
    n = table(spark, sf_dir, "nation")
    return n.select(
        (F.col("n_nationkey") % 3 + 1).cast("int").alias("account_id"),
        F.concat(F.lit("L"), F.col("n_nationkey").cast("string")).alias("label_id"),
        F.col("n_name").alias("label_name"),
    )


def change_feed(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """``events`` as a mailbox change feed: errors delete, anything else adds."""
    e = table(spark, sf_dir, "events") if events is None else events
    user = F.col("user_id").cast("string")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.concat(F.lit("m"), user, F.lit("-"), k).alias("gmail_id"),
        F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("add")).alias("op"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("at"),
        (F.col("user_id") % 3 + 1).cast("int").alias("account_id"),
        F.concat(F.lit("t"), user).alias("gmail_thread_id"),
        F.concat("event_type", F.lit(" "), F.col("value").cast("string")).alias("subject"),
    )


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("thread_id"),
        F.col("turn"),
        F.col("role").alias("from"),
        F.split_part("text", F.lit("."), F.lit(1)).alias("subject"),
        F.col("turn").cast("string").alias("date"),
        F.col("text").alias("snippet"),
    )


def adorned(text: Column, i: Column) -> Column:
    """A text with the trimmings of real mail: quotes, signatures, links, odd characters."""
    tail = (
        F.when(i % 9 == 0, F.lit("\n\nOn Mon, Jan 1, 2024 A B <a@b.example> wrote:\n> old text"))
        .when(i % 9 == 1, F.lit("\n-- \nJane Roe\n+1 555 123 4567"))
        .when(i % 9 == 2, F.lit("\n\nSent from my iPhone"))
        .when(i % 9 == 3, F.lit("\nThis message is confidential and so on."))
        .when(i % 9 == 4, F.lit(" see https://x.example/track/open?id=7 and https://y.example/a"))
        .when(i % 9 == 5, F.lit("\n\n----- Original Message -----\nFrom: z"))
        .when(i % 9 == 6, F.lit("​﻿ \u0007 done\n___\nFrom: someone"))
        .when(i % 9 == 7, F.lit(" call +49 30 1234 5678, id 123456789, mail a.b-c@d.example.org"))
        .otherwise(F.lit(" api_key: abcd-1234 AAAA-BBBB-CCCC-DDDD password = hunter22"))
    )
    return F.concat(text, tail)


def mail_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as mail bodies."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(i.alias("id"), "lang", "source", adorned(F.col("text"), i).alias("body_text"))


def message_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mailbox API messages (id, json): plain mail from documents, HTML mail from pages."""

    def b64url(c):
        return F.translate(F.base64(F.encode(c, "UTF-8")), "+/", "-_")

    def header(name: str, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    def part(kind: str, data, filename=None, attachment=None, disposition=None, size=None):
        return F.struct(
            F.lit(kind).alias("mimeType"),
            (F.lit(None).cast("string") if filename is None else filename).alias("filename"),
            F.array(
                header(
                    "Content-Disposition",
                    F.lit("") if disposition is None else disposition,
                )
            ).alias("headers"),
            F.struct(
                data.alias("data"),
                (F.lit(None).cast("string") if attachment is None else attachment).alias(
                    "attachmentId"
                ),
                (F.lit(0).cast("long") if size is None else size).alias("size"),
            ).alias("body"),
        )

    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    name = F.concat(F.lit("file"), i.cast("string"), F.lit(".pdf"))
    attached = part(
        "application/pdf",
        F.lit(None).cast("string"),
        F.when(i % 4 == 0, name),
        F.when(i % 4 == 0, F.concat(F.lit("att"), i.cast("string"))),
        F.when(i % 8 == 0, F.lit("Inline; x")).otherwise(F.lit("attachment")),
        i * 10,
    )
    plain = d.select(
        F.concat(F.lit("m"), i.cast("string")).alias("gmail_id"),
        F.to_json(
            F.struct(
                F.concat(F.lit("m"), i.cast("string")).alias("id"),
                F.concat(F.lit("t"), F.floor(i / 4).cast("string")).alias("threadId"),
                (i + 1000).cast("string").alias("historyId"),
                F.array("lang", "source").alias("labelIds"),
                F.col("source").alias("snippet"),
                F.struct(
                    F.lit("multipart/mixed").alias("mimeType"),
                    F.array(
                        header("Subject", F.split_part("text", F.lit("\n"), F.lit(1))),
                        header(
                            "From",
                            F.when(
                                i % 3 == 0,
                                F.concat(F.lit('"Doe, '), "source", F.lit('" <'), "source", F.lit("@x.example>")),
                            )
                            .when(i % 3 == 1, F.concat("source", F.lit("@y.example")))
                            .otherwise(F.concat(F.lit("Just "), "source")),
                        ),
                        header(
                            "To",
                            F.concat(
                                F.lit('"A, B" <a@x.example>, '), "lang", F.lit("@z.example,  bad, C <c@x.example>")
                            ),
                        ),
                        header(
                            "Date",
                            F.concat(
                                F.lit("Tue, "),
                                (i % 28 + 1).cast("string"),
                                F.lit(" Feb 2023 0"),
                                (i % 10).cast("string"),
                                F.lit(":15:30 +0130"),
                            ),
                        ),
                    ).alias("headers"),
                    F.array(part("text/plain", b64url(F.col("text"))), attached).alias("parts"),
                ).alias("payload"),
            )
        ).alias("json"),
    )
    return plain


def html_message_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as HTML mail: a nested multipart inside a mixed one."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    data = F.translate(F.base64(F.encode("html", "UTF-8")), "+/", "-_")
    inner = F.struct(
        F.lit("multipart/alternative").alias("mimeType"),
        F.array(
            F.struct(
                F.lit("text/html").alias("mimeType"), F.struct(data.alias("data")).alias("body")
            )
        ).alias("parts"),
    )
    return p.select(
        "page_id",
        F.to_json(
            F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(inner).alias("parts"))
        ).alias("payload"),
    )


def notifications(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Push notifications (message_id, base64 data) from ``events``."""
    e = table(spark, sf_dir, "events") if events is None else events
    address = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com"))
    history = F.when(F.col("event_id") % 10 == 0, F.lit("n/a")).otherwise(
        F.col("event_id").cast("string")
    )
    body = F.to_json(F.struct(address.alias("emailAddress"), history.alias("historyId")))
    return e.select(
        F.col("event_id").alias("message_id"),
        F.when(F.col("event_id") % 50 == 7, F.lit(None))
        .otherwise(F.base64(F.encode(body, "UTF-8")))
        .alias("data"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as registered mail accounts."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.cast("int").alias("id"),
        F.concat(F.lit("user"), key.cast("string"), F.lit("@example.com")).alias("email_address"),
        F.when(F.col("c_acctbal") > 0, (key * 3).cast("long")).alias("last_history_id"),
    )
