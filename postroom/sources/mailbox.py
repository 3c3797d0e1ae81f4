"""Mailbox sources: message listing, message fetch, attachments, history stream.

A client is any picklable ``open()`` factory that returns an object with
``list_messages(page_token, query)``, ``get_message(id)``, ``get_attachment(id, attachment)``,
``get_history(start, page_token)``, ``get_profile()`` and ``list_labels()``.  Calls run in
tasks; neither ids nor messages pass through the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import UTC, date, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

HISTORY_SCHEMA = "gmail_id string, op string, seq long, at timestamp"


def pages(fetch: Callable[[str | None], dict]) -> Iterator[dict]:
    """All pages of a listing, following its tokens."""
    token = None
    while True:
        page = fetch(token)
        yield page
        token = page.get("nextPageToken")
        if not token:
            return


def history_changes(page: dict, at: datetime | None = None) -> Iterator[tuple[str, str, int, datetime]]:
    """(message id, op, history id, time of reading) of one history page, in the order of the feed.

    The feed itself carries no times.
    """
    at = at or datetime.now(UTC).replace(tzinfo=None)
    for change in page.get("history") or []:
        seq = int(change.get("id") or page.get("historyId") or 0)
        for field, op in (("messagesAdded", "add"), ("messagesDeleted", "delete")):
            for entry in change.get(field) or []:
                message = entry.get("message") or {}
                if message.get("id"):
                    yield message["id"], op, seq, at


LISTED = "account_id int, after date, before date, gmail_id string, status string, problem string"


def _dated(query: str, after: date, before: date) -> str:
    return f"{query} after:{after:%Y/%m/%d} before:{before:%Y/%m/%d}".strip()


def split_ranges(ranges: DataFrame, open_client: Callable[[int], Any], query: str = "", most: int = 5_000) -> DataFrame:
    """Stretches of time (account_id, after, before) halved until the mailbox expects at most ``most`` messages in each.

    One request per stretch that is looked at; a single day is not split any more.  ``after`` is part of
    a stretch, ``before`` is not.
    """

    def run(batches):
        for batch in batches:
            out = []
            for account, after, before in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                client, left = open_client(account), [(after, before)]
                while left:
                    a, b = left.pop()
                    if (b - a).days > 1 and int(client.list_messages(None, _dated(query, a, b)).get("resultSizeEstimate") or 0) > most:
                        middle = a + (b - a) // 2
                        left += [(middle, b), (a, middle)]
                    else:
                        out.append((account, a, b))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.date32(), pa.date32()), strict=True)], ["account_id", "after", "before"])

    own = ranges.select(F.col("account_id").cast("int"), F.col("after").cast("date"), F.col("before").cast("date"))
    return own.mapInArrow(run, "account_id int, after date, before date")


def list_ranges(ranges: DataFrame, open_client: Callable[[int], Any], query: str = "", tasks: int | None = None) -> DataFrame:
    """Rows (account_id, after, before, gmail_id, status, problem) of the messages in each stretch of time.

    Every stretch is one chain of pages; a page is one batch, so no task holds a listing.  The last row
    of a stretch has no id and a status, ``completed`` or ``failed``: only completed stretches are whole.
    """

    def run(batches):
        kinds = (pa.int32(), pa.date32(), pa.date32(), pa.string(), pa.string(), pa.string())

        def rows(stretch: tuple, ids: list, status=None, problem=None) -> pa.RecordBatch:
            columns = [[v] * len(ids) for v in stretch] + [ids, [status] * len(ids), [problem] * len(ids)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in LISTED.split(", ")])

        for batch in batches:
            for stretch in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    client, asked = open_client(stretch[0]), _dated(query, *stretch[1:])
                    for page in pages(lambda token, c=client, q=asked: c.list_messages(token, q)):
                        yield rows(stretch, [m["id"] for m in page.get("messages") or []])
                    yield rows(stretch, [None], "completed")
                except Exception as e:  # the other stretches go on
                    yield rows(stretch, [None], "failed", f"{type(e).__name__}: {e}")

    own = ranges.select("account_id", "after", "before")
    by = ["account_id", "after"]
    return (own.repartition(tasks, *by) if tasks else own.repartition(*by)).mapInArrow(run, LISTED)


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def mailbox_source(open_client: Callable[[], Any]) -> type[DataSource]:
    """A Python data source ``mailbox`` over one client.

    Batch: message ids (the page tokens form a chain, so one task lists them).
    Stream: the history feed; the offset is the history id, the checkpoint is the cursor.
    """

    class ListReader(DataSourceReader):
        def read(self, partition):
            client = open_client()
            for page in pages(client.list_messages):
                for m in page.get("messages") or []:
                    yield (m["id"],)

    class HistoryReader(DataSourceStreamReader):
        def __init__(self, start: int):
            self.start = start

        def initialOffset(self) -> dict:
            return {"history": self.start}

        def latestOffset(self) -> dict:
            return {"history": int(open_client().get_profile()["historyId"])}

        def partitions(self, start: dict, end: dict):
            return [_Range(int(start["history"]), int(end["history"]))]

        def read(self, partition: _Range):
            client = open_client()
            for page in pages(lambda token: client.get_history(partition.start, token)):
                for row in history_changes(page):
                    if row[2] <= partition.end:
                        yield row

        def commit(self, end: dict) -> None:
            pass

    class MailboxSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "mailbox"

        def schema(self) -> str:
            return HISTORY_SCHEMA if "start" in self.options else "gmail_id string"

        def reader(self, schema):
            return ListReader()

        def streamReader(self, schema):
            return HistoryReader(int(self.options["start"]))

    return MailboxSource


def fetch_messages(ids: DataFrame, open_client: Callable[[], Any]) -> DataFrame:
    """(gmail_id, json, problem) per id; a failing message does not stop the others."""

    def fetch(batches):
        client = open_client()
        for batch in batches:
            found, problems = [], []
            for key in batch.column("gmail_id").to_pylist():
                try:
                    found.append(json.dumps(client.get_message(key)))
                    problems.append(None)
                except Exception as e:
                    found.append(None)
                    problems.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays(
                [batch.column("gmail_id"), pa.array(found, pa.string()), pa.array(problems, pa.string())],
                names=["gmail_id", "json", "problem"],
            )

    return ids.select("gmail_id").mapInArrow(fetch, "gmail_id string, json string, problem string")


def fetch_attachments(attachments: DataFrame, open_client: Callable[[], Any]) -> DataFrame:
    """(gmail_id, gmail_attachment_id, content, problem); bytes are decoded in the JVM.

    A failing attachment has no content and a problem, and does not stop the others.
    """
    from postroom.functions.mime import base64url_decode

    def fetch(batches):
        client = open_client()
        for batch in batches:
            data, problems = [], []
            for m, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    data.append(client.get_attachment(m, a).get("data", ""))
                    problems.append(None)
                except Exception as e:
                    data.append(None)
                    problems.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(data, pa.string()), pa.array(problems, pa.string())],
                names=["gmail_id", "gmail_attachment_id", "data", "problem"],
            )

    raw = attachments.select("gmail_id", "gmail_attachment_id").mapInArrow(
        fetch, "gmail_id string, gmail_attachment_id string, data string, problem string"
    )
    content = base64url_decode(F.col("data"))
    broken = F.when(F.col("data").isNotNull() & content.isNull(), F.lit("the content is not base64"))
    return raw.select("gmail_id", "gmail_attachment_id", content.alias("content"), F.coalesce("problem", broken).alias("problem"))


def labels(spark: SparkSession, account_id: int, client: Any) -> DataFrame:
    """The account's label dimension (the service bounds it to a few thousand rows)."""
    rows = [(account_id, x.get("id") or "", x.get("name")) for x in client.list_labels()]
    return spark.createDataFrame(rows, "account_id int, label_id string, label_name string")


def profile(spark: SparkSession, client: Any) -> DataFrame:
    p = client.get_profile()
    row = (
        p.get("emailAddress"),
        int(p.get("messagesTotal", 0)),
        int(p.get("threadsTotal", 0)),
        int(p["historyId"]) if p.get("historyId") else None,
    )
    return spark.createDataFrame(
        [row], "email_address string, messages_total long, threads_total long, history_id long"
    )


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Exported messages, one JSON document per line."""
    return spark.read.text(path).select(
        F.get_json_object("value", "$.id").alias("gmail_id"), F.col("value").alias("json")
    )
