"""Counts and reports.  All of them are partial-then-final aggregations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postroom import fixed_values as fv
from postroom.functions.vectors import dense_rows
from postroom.operators.filters import is_live


def total(matching: DataFrame) -> DataFrame:
    return matching.agg(F.count("*").alias("count"))


def top_groups(matching: DataFrame, group_by: str, top_n: int) -> DataFrame:
    """Most frequent senders; anything but ``from_email`` groups by ``from_name``."""
    c = "from_email" if group_by == "from_email" else "from_name"
    return (
        matching.where(F.col(c).isNotNull() & (F.col(c) != ""))
        .groupBy(F.col(c).alias("group_value"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "group_value")
        .limit(top_n)
    )


def mailbox_report(
    emails: DataFrame,
    classify_chars: int = fv.CLASSIFY_MAX_CHARS,
    embed_chars: int = fv.EMBED_MAX_CHARS,
) -> DataFrame:
    """Live rows, bodies and size limits per account in one pass."""
    size = F.length("body_text")
    return (
        emails.where(is_live())
        .groupBy("account_id")
        .agg(
            F.count("*").alias("messages"),
            F.count("body_text").alias("with_body"),
            F.count_if(size <= classify_chars).alias("within_classify"),
            F.count_if(size <= embed_chars).alias("within_embed"),
            F.max(size).cast("long").alias("max_body_chars"),
        )
    )


def against_mailbox(report: DataFrame, totals: DataFrame) -> DataFrame:
    """A report per account next to what the mailbox itself counts (account_id, messages_total).

    ``difference`` is stored minus mailbox; an account that only one side knows counts 0 on the other.
    """
    stored, own = F.coalesce("messages", F.lit(0)), F.coalesce("messages_total", F.lit(0))
    joined = report.join(totals.select("account_id", "messages_total"), "account_id", "full")
    compared = joined.withColumns({"messages": stored, "messages_total": own}).withColumn("difference", F.col("messages") - F.col("messages_total"))
    return compared.withColumn("matches", F.col("difference") == 0)


def counter_columns() -> list[Column]:
    ok = F.col("problem").isNull()
    tiers = {"sensitive": fv.SENSITIVE, "personal": fv.PERSONAL, "public": fv.PUBLIC}
    return [
        F.count_if(ok).alias("transformed"),
        F.count_if(~ok).alias("failed"),
        *[F.count_if(ok & (F.col("privacy_tier") == t)).alias(name) for name, t in tiers.items()],
        *[F.count_if(ok & (F.col("body_kind") == k)).alias(f"body_{k}") for k in ("full", "chunked")],
    ]


def transform_counters(results: DataFrame) -> DataFrame:
    """Outcome of a transform run: rows by tier, by body kind and failures."""
    return results.agg(*counter_columns())


def embed_items(results: DataFrame) -> DataFrame:
    """What a run sends to the embedder: texts per role and the id range."""
    return results.agg(
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.count_if(F.col("subject_text") != "").alias("subjects"),
        F.count_if(F.col("body_kind") == "full").alias("bodies"),
        F.coalesce(F.sum(F.size("chunks")), F.lit(0)).cast("long").alias("chunks"),
    )


def pooled_by_group(rows: DataFrame, group: str, vector: str, weight: str, dim: int) -> DataFrame:
    """Weighted mean vector per group for groups of any size.

    Arrow batches are summed inside the tasks first, so what is exploded and shuffled is
    one vector per batch and group instead of one per row; a group that holds a third of
    all rows costs no task more than its share.
    """

    def partial(batches):
        for batch in batches:
            rows_at, dense = dense_rows(batch.column(1), dim)
            if not len(rows_at):
                continue
            coded = batch.column(0).take(pa.array(rows_at)).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            w = batch.column(2).to_numpy(zero_copy_only=False)[rows_at]
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            sums = np.add.reduceat((dense * w[:, None])[order], starts, axis=0)
            weights = np.add.reduceat(w[order], starts)
            yield pa.RecordBatch.from_arrays(
                [
                    coded.dictionary.take(pa.array(codes[order][starts])),
                    pa.array(list(sums), pa.list_(pa.float64())),
                    pa.array(weights, pa.float64()),
                ],
                names=["grp", "vec", "weight"],
            )

    key_type = rows.schema[group].dataType.simpleString()
    sums = (
        rows.where(F.col(group).isNotNull() & F.col(weight).isNotNull())
        .select(group, vector, F.col(weight).cast("double"))
        .mapInArrow(partial, f"grp {key_type}, vec array<double>, weight double")
    )
    per_dim = (
        sums.select("grp", "weight", F.posexplode("vec").alias("pos", "x"))
        .groupBy("grp", "pos")
        .agg(F.sum("x").alias("x"), F.sum("weight").alias("w"))
    )
    mean = F.when(F.col("w") == 0, F.lit(0.0)).otherwise(F.try_divide("x", "w"))
    # One value per dimension: the list is as long as the vector is wide.
    return (
        per_dim.select("grp", "pos", mean.alias("x"))
        .groupBy(F.col("grp").alias(group))
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]
            ).alias("pooled")
        )
    )
