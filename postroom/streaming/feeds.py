"""Continuous ingest with Structured Streaming.

The checkpoint is the cursor: it moves only after a batch is written, and every batch
writes its own folders as a whole, so a replay after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postroom.operators.changes import change_state
from postroom.plans import ingest
from postroom.sources import notices
from postroom.sources.store import MailStore, batch_key


def parquet_stream(spark: SparkSession, table: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """The files of a table, be it a folder of part files or a single file.

    A plain path would have to be a folder; a pattern that only the path itself matches may be either.
    """
    path = table.rstrip("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def stream_run(spark: SparkSession, checkpoint: str) -> str:
    """Id of the stream that owns a checkpoint: equal after a restart, another for a fresh checkpoint."""
    found = spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()
    return found[0].replace("-", "")


def _start(df: DataFrame, checkpoint: str, each: Callable, trigger: dict) -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


ONCE = {"availableNow": True}


def follow_changes(
    feed: DataFrame,
    store: MailStore,
    checkpoint: str,
    messages_of: Callable[[DataFrame], DataFrame] | None = None,
    after: Callable[[int], None] | None = None,
    trigger: dict | None = None,
    account: int | str = "all",
) -> StreamingQuery:
    """Apply a change feed (gmail_id, op, seq, at) of one account, or of all, to the store.

    ``messages_of`` turns the batch's net additions into parsed message rows (fetching
    them, or joining an export); ``after`` runs once the batch is stored, typically the
    transform of what is new.
    """

    def each(batch: DataFrame, number: int) -> None:
        # The batch is written first and read back: fetches and joins below never
        # recompute the source.
        key = batch_key(account, "changes", number, stream_run(batch.sparkSession, checkpoint))
        ingest.record_changes(store, batch, key)
        if messages_of is not None:
            written = batch.sparkSession.read.parquet(f"{store.path('changes')}/batch={key}")
            added = change_state(written).where("first_add is not null")
            ids = added.select("gmail_id", F.col("first_add").alias("seq"))
            ingest.insert_messages(store, messages_of(ids), key)
        if after is not None:
            after(number)

    return _start(feed, checkpoint, each, trigger or ONCE)


def distinct_messages(stream: DataFrame, at: str = "at", lateness: str = "1 hour") -> DataFrame:
    """Drop repeats of a message id that arrive within the lateness bound.

    State is keyed by id and expires with the watermark, so it stays bounded.
    """
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["gmail_id"])


def follow_notices(
    raw: DataFrame,
    accounts: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Decode notifications, join them with the accounts, hand every batch to ``sink``.

    A malformed notification is a row with status ``bad``; it never stops the stream.
    """
    routed = notices.route(notices.decode(raw), accounts)
    return _start(routed, checkpoint, sink, trigger or ONCE)


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
