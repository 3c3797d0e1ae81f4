"""Label dimension: refresh and id-to-name resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def refresh_labels(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace the labels of every account that ``incoming`` mentions.

    Rows without an id are skipped; a missing name falls back to the id.
    """
    named = incoming.where(F.coalesce("label_id", F.lit("")) != "").select(
        "account_id",
        "label_id",
        F.coalesce(F.nullif(F.col("label_name"), F.lit("")), "label_id").alias("label_name"),
    )
    kept = current.join(incoming.select("account_id").distinct(), "account_id", "left_anti")
    return kept.unionByName(named)


def with_label_names(emails: DataFrame, labels: DataFrame) -> DataFrame:
    """Replace label ids by display names per account; unmapped ids stay.

    The dimension is folded to one map per account (the service bounds an account's labels)
    and joined by account.  The optimizer picks the join from the sizes it sees; a dominant
    account's mails are split by adaptive execution, as both sides are plain shuffles.
    """
    dimension = labels.groupBy("account_id", "label_id").agg(F.max("label_name").alias("label_name"))
    maps = dimension.groupBy("account_id").agg(
        F.map_from_entries(F.collect_list(F.struct("label_id", "label_name"))).alias("names")
    )
    named = F.transform("labels", lambda x: F.coalesce(F.element_at("names", x), x))
    return emails.join(maps, "account_id", "left").withColumn("labels", named).select(emails.columns)


def with_label_names_by_id(emails: DataFrame, labels: DataFrame, key: str = "gmail_id") -> DataFrame:
    """``with_label_names`` for whole mails with unique, non-null ``key``: only (key, account, label) rows move.

    The dimension is joined by account and label, so neither an account with most of the mail nor one
    with many labels fills a task; the names come back by ``key``, where co-located mails stay in place.
    """
    dimension = labels.groupBy("account_id", "label_id").agg(F.max("label_name").alias("label_name"))
    used = emails.select(key, "account_id", F.posexplode("labels").alias("nth", "label_id"))
    shown = F.coalesce("label_name", "label_id")
    named = used.join(dimension, ["account_id", "label_id"], "left").groupBy(key)
    named = named.agg(F.sort_array(F.collect_list(F.struct("nth", shown.alias("name")))).alias("_named"))
    resolved = F.when(F.size("labels") > 0, F.transform("_named", lambda n: n["name"])).otherwise(F.col("labels"))
    return emails.join(named, key, "left").withColumn("labels", resolved).select(emails.columns)
