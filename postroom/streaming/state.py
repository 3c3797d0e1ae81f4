"""State that a stream keeps per key: cursors of accounts, ids of messages.

A micro-batch looks up only the keys it brings; what is stored stays out of its way.  The state lives in
the state store (RocksDB) under the checkpoint, so a restart goes on where the last batch ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

WINDOWS = "account_id long, start_history_id long, end_history_id long"
HISTORY = (
    "account_id long, event_type string, gmail_id string, op string, seq long, at timestamp, cursor long, status string, problem string"
)


def use_rocksdb(spark: SparkSession) -> None:
    """State that may outgrow an executor's memory; a cluster's own choice of provider stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, "") or ""):
        spark.conf.set(name, ROCKSDB)


class AccountWindows(StatefulProcessor):
    """The stretch of history that new notices of an account ask for: (cursor, newest history id].

    Late and repeated notices lie below the cursor and ask for nothing.  An account without a cursor
    starts at 0, which stands for a full listing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "history long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, newest = self.cursor.get()[0] if self.cursor.exists() else 0, 0
        for part in rows:
            start = max(start, int(part["start_history_id"].max(skipna=True) if part["start_history_id"].notna().any() else 0))
            newest = max(newest, int(part["history_id"].max(skipna=True) if part["history_id"].notna().any() else 0))
        if newest > start:
            self.cursor.update((newest,))
            yield pd.DataFrame({"account_id": [key[0]], "start_history_id": [start], "end_history_id": [newest]})

    def close(self) -> None:
        pass


class AccountHistory(StatefulProcessor):
    """Reads an account's history, or its whole listing, when notices come in; page by page.

    The cursor moves when the last page is out.  A failure keeps it, says so in a row, and sets a
    timer for the next try, each twice as far off as the one before; a notice tries at once.
    """

    def __init__(self, open_client: Callable[[int], Any], retry_seconds: float = 60, most_tries: int = 8):
        self.open_client, self.retry_seconds, self.most_tries = open_client, retry_seconds, most_tries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", "history long")
        self.failed = handle.getValueState("failed", "tries int, start long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = [int(v) for part in rows for v in part["start_history_id"].dropna()]
        # The state's cursor is the furthest; an account without one starts at its earliest notice, or at all mail.
        start = self.cursor.get()[0] if self.cursor.exists() else min(given, default=0)
        yield from self._read(key[0], start, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.failed.exists():
            yield from self._read(key[0], self.failed.get()[1], timerValues)

    def _read(self, account: int, start: int, timers) -> Iterator[pd.DataFrame]:
        kind = "incremental" if start else "full_sync"

        def rows(changes: list[tuple], cursor=None, status=None, problem=None) -> pd.DataFrame:
            at = datetime.now(UTC).replace(tzinfo=None)
            made = [(account, kind, *c, at, cursor, status, problem) for c in changes]
            return pd.DataFrame(made, columns=[f.split()[0] for f in HISTORY.split(", ")])

        none = [(None, None, None)]
        try:
            client = self.open_client(int(account))
            # Read first, so what arrives meanwhile is read again rather than missed.
            cursor = int(client.get_profile()["historyId"])
            for changes in change_pages(client, start, cursor):
                if changes:
                    yield rows(changes)
        except Exception as e:  # recorded for this account; the others go on
            tries = self.failed.get()[0] + 1 if self.failed.exists() else 1
            self.failed.update((tries, start))
            if tries < self.most_tries:
                wait = int(1000 * self.retry_seconds * 2 ** (tries - 1))
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + wait)
            yield rows(none, status="failed", problem=f"{type(e).__name__}: {e}")
            return
        self.failed.clear()
        self.cursor.update((cursor,))
        yield rows(none, cursor=cursor, status="completed")

    def close(self) -> None:
        pass


def change_pages(client: Any, start: int, cursor: int) -> Iterator[list[tuple]]:
    """(gmail_id, op, seq) of one page after another: the history since ``start``, or every message."""
    from postroom.sources.mailbox import history_changes, pages

    if start:
        for page in pages(lambda token: client.get_history(start, token)):
            yield [change[:3] for change in history_changes(page)]
    else:
        for page in pages(client.list_messages):
            yield [(m["id"], "add", cursor) for m in page.get("messages") or []]


def _by_account(routed: DataFrame, start: str):
    own = routed.where("status = 'ok'")
    return own.select(*[F.col(a).cast("long").alias(b) for a, b in (("account_id",) * 2, (start, "start_history_id"), ("history_id",) * 2)]).groupBy("account_id")


def account_windows(routed: DataFrame) -> DataFrame:
    """Stream of (account_id, start_history_id, end_history_id] to read, from routed notices with the account's cursor."""
    use_rocksdb(routed.sparkSession)
    return _by_account(routed, "last_history_id").transformWithStateInPandas(AccountWindows(), WINDOWS, "append", "none")


def account_history(routed: DataFrame, open_client: Callable[[int], Any], retry_seconds: float = 60) -> DataFrame:
    """Stream of history rows of the accounts that routed notices name, with retries by timers."""
    use_rocksdb(routed.sparkSession)
    return _by_account(routed, "start_history_id").transformWithStateInPandas(AccountHistory(open_client, retry_seconds), HISTORY, "append", "processingTime")


def first_adds(history: DataFrame, forget_after: str | None = None) -> DataFrame:
    """The first add of every message id ever seen, from a stream of changes; others are dropped.

    Ids are kept in the state store for good, or until ``forget_after`` (an interval) behind the newest
    ``at``, where the feed repeats no id later than that.
    """
    use_rocksdb(history.sparkSession)
    adds = history.where("op = 'add' and gmail_id is not null")
    if forget_after is None:
        return adds.dropDuplicates(["gmail_id"])
    return adds.withWatermark("at", forget_after).dropDuplicatesWithinWatermark(["gmail_id"])
