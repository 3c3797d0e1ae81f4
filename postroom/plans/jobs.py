"""Jobs over a store: full sync, transform, reset, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from postroom.operators import aggregates
from postroom.operators.labels import refresh_labels, with_label_names_by_id
from postroom.plans import ingest
from postroom.plans import transform as plan
from postroom.plans.config import EngineConfig
from postroom.session import ship_package
from postroom.sources.store import MESSAGES, TRANSFORMED, MailStore, batch_key

COUNTERS = ("transformed", "failed", "sensitive", "personal", "public", "body_full", "body_chunked")
LABELS = "account_id int, label_id string, label_name string"


def full_sync(store: MailStore, raw: DataFrame, account_id: int, batch: int, limit: int | None = None) -> int:
    """Store the messages of a full listing (column ``json``); returns the new rows' number.

    ``limit`` takes only so many rows of the listing.
    Started, completed and failed are recorded like any other sync.
    """
    ship_package(store.spark)
    ingest.sync_event(store, account_id, "full_sync", "started", 0, batch)
    try:
        listed = raw if limit is None else raw.limit(limit)
        rows = listed.where(F.col("json").isNotNull()).select(
            "json",
            F.lit(account_id).cast("int").alias("account_id"),
            # Copies of a message go by its place in the mailbox's history.
            F.coalesce(F.expr("try_cast(get_json_object(json, '$.historyId') as bigint)"), F.lit(0)).alias("seq"),
        )
        key = batch_key(account_id, "full_sync", batch)
        new = ingest.insert_messages(store, ingest.parse_messages(rows), key).count()
    except Exception as e:
        ingest.sync_event(store, account_id, "full_sync", "failed", 0, batch, str(e)[:1000])
        raise
    ingest.sync_event(store, account_id, "full_sync", "completed", new, batch)
    return new


def sync_labels(store: MailStore, incoming: DataFrame) -> None:
    store.replace("labels", refresh_labels(store.newest("labels", LABELS), incoming))


def run_transform(
    store: MailStore,
    config: EngineConfig,
    account_id: int | None = None,
    email_id: int | None = None,
    force: bool = False,
    limit: int | None = None,
    run: int | None = None,
    batch: str | None = None,
) -> dict[str, int]:
    """Transform what has no result yet; a second run finds nothing to do.

    With ``batch`` only that batch's messages are looked at, whatever the store holds: the form for
    micro-batches.  What fails there is left to the next run without ``batch``.  Results are written
    once, and nothing is read back; counters and mean latency are kept in ``transform_runs``.
    """
    ship_package(store.spark)
    run = store.claim("transformed", run)
    if batch is None:
        # Whole mails are read only for the ids that narrow columns have picked.
        ids = plan.worklist(store.states(), account_id, email_id, force, limit).select("gmail_id")
        todo = store.messages().join(ids, "gmail_id", "left_semi")
    else:
        todo = store.read("messages", MESSAGES, "batch", [f"batch={batch}"]).drop("batch").where("body_text is not null")
    named = with_label_names_by_id(todo, store.newest("labels", LABELS))
    results = plan.transform(named, config, keep=("gmail_id", "answer")).withColumn("completed_at", F.current_timestamp())
    # Counters and the mean latency of the model call come out of the write itself.
    seen = Observation(f"transform-{run}")
    latency = F.avg(F.col("answer.ms")).alias("mean_ms")
    columns = [f.name for f in store.spark.createDataFrame([], TRANSFORMED).schema]
    store.append("transformed", results.observe(seen, *aggregates.counter_columns(), latency).select(*columns), "run", run)
    found = seen.get
    counts = {c: int(found.get(c) or 0) for c in COUNTERS}
    row = [(batch, account_id, *counts.values(), found.get("mean_ms"))]
    ddl = "batch string, account_id int, " + ", ".join(f"{c} long" for c in COUNTERS) + ", mean_ms double"
    store.append("transform_runs", store.spark.createDataFrame(row, ddl), "run", run)
    return counts
