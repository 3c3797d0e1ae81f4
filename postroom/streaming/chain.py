"""Notifications to stored and transformed mail, as two streams over one store.

``follow_histories``: notice -> account -> history (or a full listing without a cursor) -> change log.
``follow_new_mail``: history -> ids never seen before -> fetch -> messages -> transform.

Cursors, retries and known ids are state of the streams, so a micro-batch costs what it brings, whatever
the store holds.  Clients are opened in tasks.  A failing account is recorded, keeps its cursor and is
tried again; a message that cannot be fetched is tried again with the next batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postroom.operators.changes import change_state
from postroom.plans import ingest, jobs
from postroom.plans.config import EngineConfig
from postroom.session import ship_package
from postroom.sources import notices
from postroom.sources.store import MailStore, batch_key
from postroom.streaming import state
from postroom.streaming.feeds import ONCE, _start, stream_run

#: An account's client is opened by its id; it has the methods of ``sources.mailbox``.
OpenClient = Callable[[int], Any]

FETCHED = "account_id int, gmail_id string, seq long, json string, problem string"


def fetch(ids: DataFrame, open_client: OpenClient) -> DataFrame:
    """(account_id, gmail_id, seq, json, problem) per id; a client is opened once per task and account."""

    def run(batches):
        clients: dict[int, Any] = {}
        for batch in batches:
            found, problems = [], []
            for account, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if account not in clients:
                        clients[account] = open_client(account)
                    found.append(json.dumps(clients[account].get_message(key)))
                    problems.append(None)
                except Exception as e:
                    found.append(None)
                    problems.append(f"{type(e).__name__}: {e}")
            columns = [*batch.columns, pa.array(found, pa.string()), pa.array(problems, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "json", "problem"])

    # Ids come from few tasks (a listing is a chain of pages): spread them before fetching.
    spread_out = ids.select(F.col("account_id").cast("int"), "gmail_id", "seq").repartition("account_id", "gmail_id")
    return spread_out.mapInArrow(run, FETCHED)


def cursors(store: MailStore) -> DataFrame:
    """The furthest history id that has been read per account."""
    done = store.read("history", state.HISTORY, "batch").where("status = 'completed'")
    return done.groupBy(F.col("account_id").cast("int").alias("account_id")).agg(F.max("cursor").alias("last_history_id"))


def with_cursors(accounts: DataFrame, store: MailStore) -> DataFrame:
    """``accounts`` with the stored cursor where it is further than the account's own: for a new checkpoint."""
    own = cursors(store).select(F.col("account_id").alias("id"), F.col("last_history_id").alias("_stored"))
    joined = accounts.join(own, "id", "left")
    return joined.withColumn("last_history_id", F.greatest("last_history_id", "_stored")).drop("_stored").select(accounts.columns)


def follow_histories(
    raw: DataFrame,
    accounts: DataFrame,
    store: MailStore,
    open_client: OpenClient,
    checkpoint: str,
    retry_seconds: float = 60,
    trigger: dict | None = None,
) -> StreamingQuery:
    """From notifications to the change log; how each account went is a row of ``sync_events``.

    Without ``trigger`` one batch takes all there is and every retry that is due (a stream with timers
    never runs out of batches, so ``availableNow`` would not end).
    """
    ship_package(raw.sparkSession)
    history = state.account_history(notices.route(notices.decode(raw), accounts), open_client, retry_seconds)

    def each(batch: DataFrame, number: int) -> None:
        key = batch_key("all", "notices", number, stream_run(batch.sparkSession, checkpoint))
        store.append("history", batch, "batch", key)
        read = store.read("history", state.HISTORY, "batch", [f"batch={key}"])
        feed = read.where("gmail_id is not null")
        ingest.record_changes(store, feed, key)
        owner = feed.groupBy("gmail_id").agg(F.min("account_id").alias("account_id"))
        net = change_state(feed).where("first_add is not null and last_op = 'add'").select("gmail_id")
        added = net.join(owner, "gmail_id").groupBy("account_id").agg(F.count("*").alias("n"))
        ended = read.where("status is not null").groupBy("account_id").agg(
            F.max("event_type").alias("event_type"), F.max_by("status", "at").alias("status"), F.max_by("problem", "at").alias("problem"), F.max("at").alias("at")
        )
        events = ended.join(added, "account_id", "left").select(
            F.col("account_id").cast("int").alias("account_id"),
            "event_type",
            "status",
            F.when(F.col("status") == "completed", F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("emails_processed"),
            F.col("problem").alias("error_message"),
            F.lit(None).cast("long").alias("batch"),
            "at",
        )
        store.append("sync_events/phase=finished", events, "writer", key)

    return _start(history, checkpoint, each, trigger or {"once": True})


def follow_new_mail(
    store: MailStore,
    open_client: OpenClient,
    checkpoint: str,
    config: EngineConfig | None = None,
    exclusive: bool = True,
    files_per_batch: int = 1000,
    trigger: dict | None = None,
) -> StreamingQuery:
    """From the history to stored and, with ``config``, transformed mail.

    ``exclusive``: only this stream stores messages, so ids it has not seen are new.  Otherwise a batch
    is also held against all stored ids.  Ids that a batch could not fetch come along with the next.
    """
    spark = store.spark
    ship_package(spark)
    fs, folder = store._fs(store.path("history"))
    fs.mkdirs(folder)
    schema = spark.createDataFrame([], state.HISTORY).schema.add("batch", "string")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(store.path("history"))
    fresh = state.first_adds(source).select(F.col("account_id").cast("int"), "gmail_id", "seq")

    def each(batch: DataFrame, number: int) -> None:
        run = stream_run(batch.sparkSession, checkpoint)
        key, before = (batch_key("all", "mail", n, run) for n in (number, number - 1))
        asked = batch
        if store.exists(f"{store.path('fetched')}/batch={before}"):
            lost = store.read("fetched", FETCHED, "batch", [f"batch={before}"]).where("problem is not null")
            asked = asked.union(lost.select("account_id", "gmail_id", "seq"))
        store.append("fetched", fetch(asked, open_client), "batch", key)
        got = store.read("fetched", FETCHED, "batch", [f"batch={key}"]).where("json is not null")
        ingest.insert_messages(store, ingest.parse_messages(got.select("account_id", "seq", "json")), key, checked=not exclusive)
        if config is not None:
            jobs.run_transform(store, config, batch=key)

    return _start(fresh, checkpoint, each, trigger or ONCE)


def follow_mailboxes(
    raw: DataFrame,
    accounts: DataFrame,
    store: MailStore,
    open_client: OpenClient,
    checkpoint: str,
    config: EngineConfig | None = None,
    trigger: dict | None = None,
) -> tuple[StreamingQuery, StreamingQuery]:
    """Both streams, from notifications to searchable mail; without ``trigger`` the first runs to its end first."""
    histories = follow_histories(raw, accounts, store, open_client, f"{checkpoint}/histories", trigger=trigger)
    if trigger is None:
        histories.awaitTermination()
    return histories, follow_new_mail(store, open_client, f"{checkpoint}/mail", config, trigger=trigger)
