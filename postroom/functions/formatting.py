"""Privacy-aware output records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom import fixed_values as fv
from postroom.functions.headers import display_sender
from postroom.functions.tiering import tier_name


def iso_timestamp(c: Column) -> Column:
    """``2024-01-01T00:00:07.179575+00:00``; no fraction when it is zero."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(
        c.isNotNull(),
        F.concat(
            whole,
            F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
            F.lit("+00:00"),
        ),
    )


def external_body(body_redacted: Column, tier: Column, mode: str = "external") -> Column:
    shown = F.coalesce(F.nullif(body_redacted, F.lit("")), F.lit(fv.BODY_REDACTED_FALLBACK))
    if mode != "external":
        return shown
    return F.when(tier == fv.SENSITIVE, F.lit(fv.BODY_SENSITIVE_PLACEHOLDER)).otherwise(shown)


def external_record(emails: DataFrame, mode: str = "external") -> DataFrame:
    """One externally safe row per email; ``labels`` must already hold display names."""
    return emails.select(
        F.col("gmail_id").alias("id"),
        F.col("gmail_thread_id").alias("thread_id"),
        "subject",
        display_sender(F.col("from_name"), F.col("from_email")).alias("from"),
        F.coalesce("to_emails", F.array().cast("array<string>")).alias("to"),
        iso_timestamp(F.col("sent_at")).alias("date"),
        F.coalesce("snippet_redacted", F.lit("")).alias("snippet"),
        external_body(F.col("body_redacted"), F.col("privacy_tier"), mode).alias("body"),
        F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
        F.coalesce("has_attachments", F.lit(False)).alias("has_attachments"),
        F.concat(F.lit(fv.MESSAGE_URL_PREFIX), "gmail_id").alias("gmail_url"),
    )


def result_record(emails: DataFrame, *carry: str) -> DataFrame:
    """Search result rows: identity, title, snippet, metadata struct, provenance."""
    sender = display_sender(F.col("from_name"), F.col("from_email"))
    day = F.coalesce(F.date_format("sent_at", "yyyy-MM-dd"), F.lit("?"))
    return emails.select(
        F.col("gmail_id").alias("id"),
        F.lit("email").alias("source"),
        F.lit("personal").alias("source_class"),
        F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.lit("No subject")).alias("title"),
        F.coalesce("snippet_redacted", F.lit("")).alias("snippet"),
        iso_timestamp(F.col("sent_at")).alias("timestamp"),
        *carry,
        F.struct(
            F.col("gmail_id").alias("email_id"),
            F.col("gmail_thread_id").alias("thread_id"),
            sender.alias("from"),
            F.coalesce("to_emails", F.array().cast("array<string>")).alias("to"),
            F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
            F.coalesce("has_attachments", F.lit(False)).alias("has_attachments"),
            F.concat(F.lit(fv.MESSAGE_URL_PREFIX), "gmail_id").alias("gmail_url"),
            external_body(F.col("body_redacted"), F.col("privacy_tier")).alias("body"),
        ).alias("metadata"),
        F.concat(F.lit("email from "), sender, F.lit(" on "), day).alias("provenance"),
    )


def console_record(emails: DataFrame, raw: bool = False, full: bool = False) -> DataFrame:
    """Operator view: redacted (or raw) body cut at 2000, snippet at 200 characters."""
    body = F.col("body_text") if raw else F.coalesce(F.nullif("body_redacted", F.lit("")), "body_text")
    body = F.coalesce(body, F.lit(""))
    if not full:
        body = F.when(
            F.length(body) > 2000,
            F.concat(F.substring(body, 1, 2000), F.lit(fv.TRUNCATION_MARKER)),
        ).otherwise(body)
    return emails.select(
        "id",
        "gmail_id",
        F.col("gmail_thread_id").alias("thread_id"),
        "account_id",
        F.coalesce("subject", F.lit("")).alias("subject"),
        F.concat(F.coalesce("from_name", F.lit("")), F.lit(" <"), "from_email", F.lit(">")).alias(
            "from"
        ),
        tier_name(F.col("privacy_tier")).alias("privacy_tier"),
        F.substring(F.coalesce("snippet", F.lit("")), 1, 200).alias("snippet"),
        F.when(body == "", F.lit("(no body)")).otherwise(body).alias("body"),
    )
