"""Push and pull notifications: decoding and routing to accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SALTS = 16


def decode(raw: DataFrame, data: str = "data") -> DataFrame:
    """Adds email_address, history_id and ``status`` (``bad`` when the shape is wrong).

    Broken base64, bytes that are not UTF-8, and JSON that is no object are bad and stop nothing.
    A history id that is a number or a digit string counts, anything else is null.
    """
    text = F.try_validate_utf8(F.try_to_binary(F.col(data), F.lit("base64")).cast("string"))
    parsed = F.from_json(
        F.when(text.rlike(r"^\s*\{"), text), "emailAddress string, historyId string, _corrupt_record string"
    )
    with_body = raw.withColumn("body", parsed)
    broken = F.col("body").isNull() | F.col("body._corrupt_record").isNotNull()
    digits = F.col("body.historyId").rlike(r"^[0-9]+$")
    return with_body.select(
        *[c for c in raw.columns if c != data],
        F.col("body.emailAddress").alias("email_address"),
        F.when(digits, F.expr("try_cast(body.historyId as bigint)")).alias("history_id"),
        F.when(F.col(data).isNull() | broken, F.lit("bad"))
        .otherwise(F.lit("ok"))
        .alias("status"),
    )


def route(decoded: DataFrame, accounts: DataFrame, with_cursor: bool = False) -> DataFrame:
    """Attach the account and the cursor to start from; unknown addresses are ignored.

    The stored cursor wins over the notification's own history id.  One busy account may
    send a third of all notices, so notices are salted and the accounts (one row per
    address) copied per salt; micro-batches have no adaptive skew handling to rely on.
    Both sides are shuffled: the copies outgrow what Spark takes them for, so a broadcast of
    them would fill the driver.
    ``with_cursor`` adds the account's own ``last_history_id``.
    """
    known = accounts.select(
        F.col("email_address"),
        F.col("id").alias("account_id"),
        "last_history_id",
        F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"),
    )
    spread_out = F.pmod(F.xxhash64("history_id", *decoded.columns[:1]), F.lit(_SALTS)).cast("int")
    joined = decoded.withColumn("salt", spread_out).join(known.hint("merge"), ["email_address", "salt"], "left")
    return joined.select(
        *[c for c in decoded.columns if c != "status"],
        "account_id",
        F.when(F.col("status") == "bad", F.lit("bad"))
        .when(F.col("account_id").isNull(), F.lit("ignored"))
        .otherwise(F.lit("ok"))
        .alias("status"),
        # Zero means "no cursor", as a missing one does.
        F.when(
            F.col("account_id").isNotNull(),
            F.coalesce(F.nullif(F.col("last_history_id"), F.lit(0).cast("long")), F.col("history_id")),
        ).alias("start_history_id"),
        *["last_history_id"] * with_cursor,
    )


def accounts_to_sync(routed: DataFrame) -> DataFrame:
    """One row per account to sync: many notices of one account collapse map-side."""
    return (
        routed.where("status = 'ok'")
        .groupBy("account_id")
        .agg(
            F.min("start_history_id").alias("start_history_id"),
            F.count("*").alias("notices"),
        )
    )
