"""Table maintenance as set operations: inserts, soft deletes, replacements, resets.

A change feed has the columns gmail_id, op ('add' / 'delete'), seq (total order), at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom.operators.filters import is_live

# Columns that the transform fills and a reset clears.
DERIVED = (
    "privacy_tier", "body_redacted", "snippet_redacted", "subject_embedding", "body_embedding",
    "body_pooled_embedding", "transform_completed_at",
)

def first_copies(incoming: DataFrame, key: str = "gmail_id", order: str = "seq") -> DataFrame:
    """The earliest row per key.  An aggregate, so copies are merged before the shuffle."""
    rest = [c for c in incoming.columns if c != key]
    return (
        incoming.groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("row"))
        .select(key, *[F.col("row")[c].alias(c) for c in rest])
        .select(*incoming.columns)
    )


def new_messages(incoming: DataFrame, emails: DataFrame, order: str = "seq") -> DataFrame:
    """First copies of messages that have no live row yet."""
    live = emails.where(is_live()).select("gmail_id")
    return first_copies(incoming, order=order).join(live, "gmail_id", "left_anti")


def fold_changes(feed: DataFrame) -> DataFrame:
    """A feed as one row of numbers and a time per message, in a form that merges with others (``merged_state``).

    Of changes with one ``seq`` (a history record) adds come before deletes.  All buffers are
    fixed-size, so this is a hash aggregate with partial sums before the shuffle.
    """
    add, delete = F.col("op") == "add", F.col("op") == "delete"
    nth = F.col("seq") * 2 + delete.cast("int")
    deleted = F.when(delete, F.col("seq"))
    return feed.groupBy("gmail_id").agg(
        F.min(F.when(add, F.col("seq"))).alias("first_add"),
        F.count_if(add).alias("adds"),
        F.count_if(delete).alias("deletes"),
        F.max(F.when(add | delete, nth)).alias("last"),
        F.max(deleted).alias("last_delete"),
        F.max_by(F.when(delete, F.col("at")), deleted).alias("last_delete_at"),
    )


def merged_state(older: str, newer: str) -> dict[str, Column]:
    """Columns of the state of two joined states (aliases), either of which may be missing."""

    def both(name: str) -> tuple[Column, Column]:
        return F.col(f"{older}.{name}"), F.col(f"{newer}.{name}")

    (a, b), zero = both("last_delete"), F.lit(0)
    later = F.coalesce(b >= a, b.isNotNull())
    return {
        "first_add": F.least(*both("first_add")),
        "adds": F.coalesce(both("adds")[0], zero) + F.coalesce(both("adds")[1], zero),
        "deletes": F.coalesce(both("deletes")[0], zero) + F.coalesce(both("deletes")[1], zero),
        "last": F.greatest(*both("last")),
        "last_delete": F.greatest(a, b),
        "last_delete_at": F.when(later, both("last_delete_at")[1]).otherwise(both("last_delete_at")[0]),
    }


def last_op(last: Column) -> Column:
    return F.when(last % 2 == 0, F.lit("add")).when(last % 2 != 0, F.lit("delete"))


def change_state(feed: DataFrame) -> DataFrame:
    """Net effect of a feed per message, from fixed-size aggregates only.

    A delete before the first add has no effect on an empty store; the last delete
    sets the time; an add after a delete brings the row back.
    """
    folded = fold_changes(feed).drop("last_delete")
    return folded.withColumn("last", last_op(F.col("last"))).withColumnRenamed("last", "last_op")


def apply_state(stored: DataFrame, state: DataFrame) -> DataFrame:
    """Stored rows with ``deleted_at`` moved on by a change state; other rows unchanged."""
    changed = state.select("gmail_id", "last_op", "last_delete_at")
    return (
        stored.join(changed, "gmail_id", "left")
        .withColumn(
            "deleted_at",
            F.when(F.col("last_op") == "delete", F.col("last_delete_at"))
            .when(F.col("last_op") == "add", F.lit(None))
            .otherwise(F.col("deleted_at")),
        )
        .drop("last_op", "last_delete_at")
        .select(*stored.columns)
    )


def upsert_accounts(accounts: DataFrame, incoming: DataFrame) -> DataFrame:
    """Known addresses get the new token, unknown ones are added."""
    fresh = incoming.select("email_address", F.col("oauth_token_encrypted").alias("token"))
    return accounts.join(fresh, "email_address", "full").select(
        "email_address",
        F.coalesce("token", "oauth_token_encrypted").alias("oauth_token_encrypted"),
        *[c for c in accounts.columns if c not in ("email_address", "oauth_token_encrypted")],
    )


def reset_scope(account_id: int | None = None) -> Column:
    cond = is_live() & F.col("body_text").isNotNull()
    return cond if account_id is None else cond & (F.col("account_id") == account_id)


def reset_emails(emails: DataFrame, account_id: int | None = None) -> DataFrame:
    """Clear the derived columns of the scope."""
    scope = reset_scope(account_id)
    cleared = {
        c: F.when(scope, F.lit(None)).otherwise(F.col(c)) for c in DERIVED if c in emails.columns
    }
    return emails.withColumns(cleared)


def reset_chunks(chunks: DataFrame, emails: DataFrame, account_id: int | None = None) -> DataFrame:
    """Chunks that remain after a reset."""
    gone = emails.where(reset_scope(account_id)).select(F.col("id").alias("email_id"))
    return chunks.join(gone, "email_id", "left_anti")


def replace_by_key(current: DataFrame, fresh: DataFrame, replaced: DataFrame, key: str) -> DataFrame:
    """Rows of ``current`` whose key is not in ``replaced``, plus ``fresh``.

    ``replaced`` lists all rewritten keys, also those that have no fresh rows.
    """
    kept = current.join(replaced.select(key), key, "left_anti")
    return kept.unionByName(fresh)


def backfill_completed(emails: DataFrame) -> DataFrame:
    """Rows that already have a subject vector count as transformed at their update time."""
    done = F.when(F.col("subject_embedding").isNotNull(), F.col("updated_at")).otherwise(
        F.col("transform_completed_at")
    )
    return emails.withColumn("transform_completed_at", done)


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose parent is missing: the check that stands in for a foreign key."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")
