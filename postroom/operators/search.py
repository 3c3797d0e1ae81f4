"""Ranked retrieval: structured, full-text, vector, and their fusion.

Each method keeps only ids, ``sent_at`` and its score, so a branch reads the columns it
ranks by and nothing else.  ``orderBy().limit()`` becomes TakeOrderedAndProject: every
task keeps k rows and the driver merges k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postroom import fixed_values as fv
from postroom.functions import fulltext as ft
from postroom.functions.vectors import (
    cosine_distance,
    cosine_distances,
    dense_rows,
    similarity_score,
)
from postroom.operators.filters import has_any_embedding, matches_text

METHODS = ("structured", "fulltext", "vector")
RRF_CONSTANT = 60


def clamp_limit(n: int, top: int = fv.TOP_K_MAX) -> int:
    return min(max(1, n), top)


def per_method_limit(top_k: int) -> int:
    return max(top_k * 3, 30)


def structured_top(matching: DataFrame, k: int) -> DataFrame:
    """Newest first; the score falls by 0.03 per position down to 0.3."""
    top = (
        matching.select("id", "sent_at")
        .orderBy(F.desc_nulls_last("sent_at"), "id")
        .limit(k)
    )
    # The window sees at most k rows.
    position = F.row_number().over(Window.orderBy(F.desc_nulls_last("sent_at"), "id"))
    return top.select(
        "id",
        "sent_at",
        F.lit("structured").alias("method"),
        F.greatest(F.lit(0.3), 1.0 - 0.03 * (position - 1)).alias("score"),
    )


def fulltext_top(matching: DataFrame, query: str, k: int, hits: DataFrame | None = None) -> DataFrame:
    """All query words present, by cover density, then newest.

    ``hits`` (id or gmail_id, rank), read from the stored index, spares reading any text.
    """
    terms = ft.query_terms(query)
    if hits is not None:
        key = hits.columns[0]
        ranked = matching.select(*dict.fromkeys(("id", key, "sent_at"))).join(hits, key).select("id", "sent_at", "rank")
        return _fulltext_best(ranked, k)
    text = ft.document_text(*[F.col(c) for c in ("subject", "from_email", "from_name", "body_text")])
    ranked = matching.where(matches_text(text, terms)).select(
        "id", "sent_at", (ft.cover_density(text, terms) if terms else F.lit(0.0)).alias("rank")
    )
    return _fulltext_best(ranked, k)


def _fulltext_best(ranked: DataFrame, k: int) -> DataFrame:
    return (
        ranked.orderBy(F.desc("rank"), F.desc_nulls_last("sent_at"), "id")
        .limit(k)
        .select("id", "sent_at", F.lit("fulltext").alias("method"), ft.rank_score(F.col("rank")).alias("score"))
    )


def best_vector():
    """The body vector, else the pooled chunk vector, else the subject vector."""
    return F.coalesce("body_embedding", "body_pooled_embedding", "subject_embedding")


def vector_top(matching: DataFrame, query: Sequence[float] | None, k: int) -> DataFrame:
    """Exact nearest neighbours by cosine distance; nothing for a missing or zero query."""
    usable = query is not None and any(x != 0 for x in query)
    if not usable:
        return matching.where(F.lit(False)).select(
            "id", "sent_at", F.lit("vector").alias("method"), F.lit(0.0).alias("score")
        )
    return (
        matching.where(has_any_embedding())
        .select("id", "sent_at", cosine_distance(best_vector(), query).alias("distance"))
        .orderBy(F.asc_nulls_last("distance"), F.desc_nulls_last("sent_at"), "id")
        .limit(k)
        .select("id", "sent_at", F.lit("vector").alias("method"), similarity_score(F.col("distance")).alias("score"))
    )


# One pass multiplies each batch with at most this many query values (64 MB of doubles).
_QUERY_VALUES_PER_PASS = 8_000_000


def nearest_per_query(
    vectors: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int
) -> DataFrame:
    """k nearest rows of ``vectors(id, vector)`` for every query of a request batch.

    A task multiplies each Arrow batch with all queries and passes on k rows per query
    and batch, so no pair leaves the task unless it can still win.  More queries than
    one pass holds take further passes over the table.
    """
    dim = len(queries[0][1])
    block = max(1, _QUERY_VALUES_PER_PASS // dim)
    found = None
    for at in range(0, len(queries), block):
        part = _nearest_block(vectors, queries[at : at + block], k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "id")
    return (
        found.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= k)
        .select("query_id", "position", "id", "distance")
    )


def _nearest_block(vectors: DataFrame, queries, k: int) -> DataFrame:
    names = np.array([q for q, _ in queries], dtype=np.int64)
    matrix = np.array([v for _, v in queries], dtype=np.float64)

    def local_top(batches):
        for batch in batches:
            rows, dense = dense_rows(batch.column("vector"), matrix.shape[1])
            if not len(rows):
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)[rows]
            distances = cosine_distances(dense, matrix)
            out_query, out_id, out_distance = [], [], []
            for j in range(len(names)):
                keep = np.lexsort((ids, distances[:, j]))[:k]
                out_query.append(np.full(len(keep), names[j]))
                out_id.append(ids[keep])
                out_distance.append(distances[keep, j])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(out_query)),
                    pa.array(np.concatenate(out_id)),
                    pa.array(np.concatenate(out_distance)),
                ],
                names=["query_id", "id", "distance"],
            )

    return vectors.select("id", "vector").mapInArrow(
        local_top, "query_id long, id long, distance double"
    )


def default_methods(query: str, filters) -> list[str]:
    """Structured for filters or an empty query; text and vector for a non-blank query."""
    blank = not (query or "").strip()
    chosen = ["structured"] if filters or blank else []
    return chosen if blank else [*chosen, "fulltext", "vector"]


def fuse(
    branches: Sequence[DataFrame],
    methods: Sequence[str],
    top_k: int,
    weights: dict[str, float] | None = None,
    rule: str = "weighted",
) -> DataFrame:
    """Merge per-method lists (at most ``per_method_limit`` rows each) by id.

    ``weighted``: sum of weight x score over the executed methods' total weight.
    ``rrf``: sum of 1 / (60 + position in the method's list).
    """
    merged = branches[0]
    for b in branches[1:]:
        merged = merged.unionByName(b)
    weights = {m: float((weights or {}).get(m, 1.0)) for m in methods}
    if rule == "rrf":
        order = Window.partitionBy("method").orderBy(
            F.desc("score"), F.desc_nulls_last("sent_at"), "id"
        )
        share = 1.0 / (RRF_CONSTANT + F.row_number().over(order))
        merged = merged.withColumn("share", share)
    else:
        total = sum(weights.values())
        weight = F.element_at(
            F.create_map(*[F.lit(x) for m, w in weights.items() for x in (m, w / total)]),
            F.col("method"),
        )
        merged = merged.withColumn("share", weight * F.col("score"))
    # Per-method sums instead of one running sum: addition order, hence the last bit,
    # does not depend on which branch arrives first.
    per_method = [
        F.coalesce(F.max(F.when(F.col("method") == m, F.col("share"))), F.lit(0.0)) for m in methods
    ]
    final = per_method[0]
    for c in per_method[1:]:
        final = final + c
    pairs = F.sort_array(F.collect_list(F.struct("method", "score")))
    return (
        merged.groupBy("id")
        .agg(
            F.max("sent_at").alias("sent_at"),
            final.alias("final_score"),
            F.map_from_entries(pairs).alias("scores"),
            F.sort_array(F.collect_list("method")).alias("methods_used"),
        )
        .orderBy(F.desc("final_score"), F.desc_nulls_last("sent_at"), "id")
        .limit(top_k)
    )


def fetch(emails: DataFrame, ranked: DataFrame) -> DataFrame:
    """Attach email columns to a top-k list.

    ``ranked`` ends in a limit of at most 300 rows (three methods x 100), so it is the
    side to broadcast; the email table is scanned once and never shuffled.
    """
    extra = [c for c in ranked.columns if c not in ("sent_at",)]
    return emails.join(F.broadcast(ranked.select(*extra)), "id")
