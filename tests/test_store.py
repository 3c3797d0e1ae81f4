"""Export to search results: sync, transform, reset, publish, engine, streams."""

from __future__ import annotations

import base64
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from postroom.plans import jobs
from postroom.plans.config import EngineConfig, Limits
from postroom.plans.engine import MailEngine
from postroom.sources import mailbox
from postroom.sources.store import MailStore

DIM = 32
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def message(key, thread, subject, sender, body, date, labels=("INBOX",), parts=()):
    data = base64.urlsafe_b64encode(body.encode()).decode()
    return {
        "id": key,
        "threadId": thread,
        "historyId": "5",
        "labelIds": list(labels),
        "snippet": body[:20],
        "payload": {
            "mimeType": "multipart/mixed",
            "headers": [
                {"name": "Subject", "value": subject},
                {"name": "From", "value": sender},
                {"name": "To", "value": "me@z.example"},
                {"name": "Date", "value": date},
            ],
            "parts": [{"mimeType": "text/plain", "body": {"data": data}}, *parts],
        },
    }


PDF = {
    "mimeType": "application/pdf",
    "filename": "a.pdf",
    "headers": [{"name": "content-DISPOSITION", "value": "INLINE"}],
    "body": {"attachmentId": "att1", "size": 12},
}
MAILS = [
    message("m1", "t1", "Budget", "Ann <ann@x.example>", "Can you send the budget plan?",
            "Mon, 1 Jan 2024 10:00:00 +0000", parts=[PDF]),
    message("m2", "t1", "Re: Budget", "Bob <bob@x.example>", "Here is the budget. password = hunter22",
            "Mon, 1 Jan 2024 11:00:00 +0000"),
    message("m3", "t2", "News", "newsletter@y.example", "Weekly plan for the budget traveller. " * 40,
            "Tue, 2 Jan 2024 09:00:00 +0000", labels=("L1", "L9")),
    message("m4", "t3", "", "Cat <cat@x.example>", "", "not a date"),
]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    export = root / "export.jsonl"
    export.write_text("\n".join(json.dumps(m) for m in [*MAILS, MAILS[0]]))
    s = MailStore(spark, str(root / "data"))
    assert jobs.full_sync(s, mailbox.read_export(spark, str(export)), 1, batch=1) == 4
    # The same export again stores nothing, under the same or another batch number.
    assert jobs.full_sync(s, mailbox.read_export(spark, str(export)), 1, batch=2) == 0
    jobs.sync_labels(s, spark.createDataFrame([(1, "L1", "News letters")], jobs.LABELS))
    return s


@pytest.fixture(scope="module")
def config():
    return EngineConfig(limits=Limits(embed_max_tokens=100, chunk_target_tokens=60), dim=DIM)


@pytest.fixture(scope="module")
def transformed(store, config):
    counts = jobs.run_transform(store, config, run=1)
    assert counts == {
        "transformed": 4, "failed": 0, "sensitive": 1, "personal": 1, "public": 2,
        "body_full": 2, "body_chunked": 1,
    }
    return store


def test_messages_and_attachments(store):
    rows = {r["gmail_id"]: r for r in store.messages().collect()}
    assert rows["m1"]["from_email"] == "ann@x.example" and rows["m1"]["from_name"] == "Ann"
    assert rows["m1"]["attachment_count"] == 1 and not rows["m2"]["has_attachments"]
    assert rows["m4"]["sent_at"] is not None
    a = store.attachments().collect()
    assert [(x["gmail_id"], x["size_bytes"], x["is_inline"]) for x in a] == [("m1", 12, True)]
    audit = store.spark.read.parquet(store.path("sync_events")).collect()
    assert sorted((x["batch"], x["status"], x["emails_processed"]) for x in audit) == [
        (1, "completed", 4), (1, "started", 0), (2, "completed", 0), (2, "started", 0),
    ]
    heads = {r["gmail_thread_id"]: r["message_count"] for r in store.threads().collect()}
    assert heads == {"t1": 2, "t2": 1, "t3": 1}


def test_transform_is_idempotent(transformed, config):
    assert jobs.run_transform(transformed, config, run=2)["transformed"] == 0
    chunks = transformed.chunks().orderBy("chunk_position").collect()
    assert [c["chunk_position"] for c in chunks] == list(range(len(chunks))) and len(chunks) > 1
    assert [c["chunk_weight"] for c in chunks] == [2.0] + [1.0] * (len(chunks) - 1)
    rows = {r["gmail_id"]: r for r in transformed.emails().collect()}
    assert rows["m3"]["body_embedding"] is None and len(rows["m3"]["body_pooled_embedding"]) == DIM
    assert rows["m2"]["body_redacted"] == "Here is the budget. [REDACTED]"
    assert rows["m1"]["snippet_redacted"] == "Content redacted"
    assert rows["m4"]["subject_embedding"] is None


def engine_of(store, config):
    return MailEngine(store.served(), store.newest("labels", jobs.LABELS), config, store.index())


def test_worklist_moves_no_text(transformed):
    plan_ = transformed.states()._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan_.split("\n") if "Join" in line or "Aggregate" in line]
    assert joined and not any(c in line for line in joined for c in ("embedding", "redacted", "chunks"))


def test_search_through_the_published_index(transformed, config):
    scanned = engine_of(transformed, config).unified("budget plan", methods=["fulltext", "fulltext"])
    transformed.publish()
    indexed = engine_of(transformed, config)
    assert indexed.index is not None
    again = indexed.unified("budget plan", methods=["fulltext"])
    assert [(r["id"], r["final_score"]) for r in again["results"]] == [(r["id"], r["final_score"]) for r in scanned["results"]]
    assert again["results"] and indexed.unified("absent", methods=["fulltext"])["results"] == []
    fused, _ = indexed.ranked("budget plan", ["fulltext"])
    scan = fused._jdf.queryExecution().executedPlan().toString()
    assert "body_text" not in scan


def test_unified_search(transformed, config):
    e = engine_of(transformed, config)
    assert e.unified(mode="count")["count"] == 4
    groups = e.unified(mode="aggregate", group_by="from_name")["aggregates"]
    assert [(g["group_value"], g["count"]) for g in groups] == [("Ann", 1), ("Bob", 1), ("Cat", 1)]
    with pytest.raises(ValueError):
        e.unified(mode="aggregate", group_by="labels")
    out = e.unified("budget", filters=[{"field": "date_before", "value": "2024-01-02"}])
    assert out["methods_executed"] == ["structured", "fulltext", "vector"]
    assert {r["id"] for r in out["results"]} == {"m1", "m2", "m3"}
    secret = next(r for r in out["results"] if r["id"] == "m2")
    assert secret["metadata"]["body"] == "[SENSITIVE CONTENT REDACTED]"
    news = next(r for r in out["results"] if r["id"] == "m3")
    assert news["metadata"]["labels"] == ["News letters", "L9"]
    assert set(news["scores"]) == {"structured", "fulltext", "vector"}
    lazy = [r["id"] for r in e.search("budget", filter_list=[{"field": "date_before", "value": "2024-01-02"}]).collect()]
    assert lazy == [r["id"] for r in out["results"]]
    assert e.unified("absent", methods=["fulltext"])["results"] == []
    assert e.capabilities()["max_limit"] == 100


def test_lookup_thread_summary(transformed, config):
    e = engine_of(transformed, config)
    assert [r["title"] for r in e.get("m4").collect()] == ["No subject"]
    assert e.get("nope").collect() == []
    head, messages = e.thread("t1")
    assert head.first()["message_count"] == 2 and head.first()["subject"] == "Budget"
    assert [r["id"] for r in messages.collect()] == ["m1", "m2"]
    assert len(list(e.thread_json("t1"))) == 3
    text = e.summarize(thread_id="t1").first()["summary"]
    assert text.startswith("1. [2024-01-01T10:00:00+00:00] Ann <ann@x.example>: Budget\n   Content redacted\n2. [")
    picked = e.summarize(message_ids=["m2", "m1"]).first()["summary"]
    assert picked.startswith("1. [2024-01-01T11") and "\n2. [2024-01-01T10" in picked
    assert e.summarize(message_ids=["none"]).first()["summary"] == "No emails to summarize."
    shown = e.show("m2", raw=True).first()
    assert shown["privacy_tier"] == "SENSITIVE" and "hunter22" in shown["body"]
    assert e.get_response("m4")["title"] == "No subject" and e.summarize_response(thread_id="t1") == {"summary": text}
    assert e.get_response("nope") == {"success": False, "error": "Email not found"}
    assert e.get_response("m4", account_id=2) == {"success": False, "error": "Email not found"}
    assert e.thread_response("nope") == {"success": False, "error": "Thread not found"}
    assert e.summarize_response() == {"success": False, "error": "No emails or thread specified."}
    whole = e.thread_response("t1", most=1)
    assert whole["message_count"] == 2 and [m["id"] for m in whole["messages"]] == ["m1"]
    report = e.report().first()
    assert report["messages"] == 4 and report["with_body"] == 4


def test_default_account_and_validate_by_command_line(transformed, config, capsys, monkeypatch):
    from dataclasses import replace

    from postroom import __main__ as command

    other = engine_of(transformed, replace(config, default_account=7))
    assert other.unified(mode="count")["count"] == 0 and other.count(account_id=1).first()[0] == 4
    monkeypatch.setattr(command, "build_session", lambda *_: transformed.spark)
    assert command.main(["--store", transformed.root, "validate", "--total", "1=4"]) == 0
    assert json.loads(capsys.readouterr().out)["matches"] is True
    assert command.main(["--store", transformed.root, "validate", "--total", "1=6", "--total", "2=0"]) == 1
    lines = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert [(r["account_id"], r["difference"]) for r in lines] == [(1, -2), (2, 0)]
    runs = transformed.spark.read.parquet(transformed.path("transform_runs")).where("run = 1").first()
    assert runs.transformed == 4 and runs.mean_ms > 0


def test_deletes_resets_and_publish(spark, transformed, config):
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    feed = spark.createDataFrame(
        [("m2", "delete", 1), ("m1", "delete", 2), ("m1", "add", 3)], "gmail_id string, op string, seq long"
    ).withColumn("at", at)
    from postroom.plans import ingest

    ingest.record_changes(transformed, feed, "1-changes-0-7")
    rows = {r["gmail_id"]: r["deleted_at"] for r in transformed.emails().collect()}
    assert rows["m2"] is not None and rows["m1"] is None
    transformed.publish()
    assert engine_of(transformed, config).unified(mode="count")["count"] == 3
    transformed.reset(run=10)
    assert transformed.chunks().count() == 0
    left = transformed.emails().where("transform_completed_at is not null").select("gmail_id")
    assert [r[0] for r in left.collect()] == ["m2"]  # deleted mail is out of a reset's scope
    assert jobs.run_transform(transformed, config, run=11)["transformed"] == 3


def test_writers_with_equal_batch_numbers_keep_all_mail(spark, tmp_path):
    """Two accounts and two streams that all count their batches from 0."""
    from postroom.streaming import feeds

    s = MailStore(spark, str(tmp_path / "data"))
    one = spark.createDataFrame([(json.dumps(MAILS[0]),), (json.dumps(MAILS[1]),)], "json string")
    two = spark.createDataFrame([(json.dumps(MAILS[2]),)], "json string")
    assert jobs.full_sync(s, one, 1, batch=0) == 2 and jobs.full_sync(s, two, 2, batch=0) == 1
    assert jobs.full_sync(s, one, 1, batch=0, limit=1) == 1  # a replay replaces its own batch only
    assert jobs.full_sync(s, one, 1, batch=0) == 2
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    changes = [("m1", "delete", 5), ("m3", "delete", 6)]
    for k, change in enumerate(changes):
        folder = str(tmp_path / f"feed{k}")
        feed = spark.createDataFrame([change], "gmail_id string, op string, seq long").withColumn("at", at)
        feed.write.parquet(folder)
        stream = feeds.parquet_stream(spark, folder, feed.schema)
        feeds.run_to_end(feeds.follow_changes(stream, s, str(tmp_path / f"checkpoint{k}")))
    rows = {r["gmail_id"]: r["deleted_at"] is not None for r in s.emails().collect()}
    assert rows == {"m1": True, "m2": False, "m3": True}
    audit = spark.read.parquet(s.path("sync_events")).where("status = 'completed'")
    assert sorted((x["account_id"], x["batch"], x["emails_processed"]) for x in audit.collect()) == [(1, 0, 2), (2, 0, 1)]


def test_streams_read_tables_of_many_files(spark, sf, tmp_path):
    """The registered stream queries give the same rows for a folder of part files."""
    from postroom.catalog import QUERIES

    for name in ("events", "customer", "documents"):
        table = spark.read.parquet(f"{sf}/{name}.parquet")
        table.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("stream_incremental_sync", "stream_distinct", "stream_notifications", "stored_mail_state"):
        one, many = (sorted(map(str, QUERIES[name](spark, d).collect())) for d in (sf, str(tmp_path)))
        assert len(one) > 0 and one == many, name


def test_history_feed_fits_the_change_log(spark, tmp_path):
    from postroom.plans import ingest
    from postroom.sources.mailbox import HISTORY_SCHEMA, history_changes
    from postroom.sources.store import batch_key

    page = {"history": [{"id": "9", "messagesDeleted": [{"message": {"id": "a"}}], "messagesAdded": [{"message": {"id": "a"}}, {"message": {"id": "b"}}]}]}
    feed = spark.createDataFrame(list(history_changes(page)), HISTORY_SCHEMA)
    s = MailStore(spark, str(tmp_path / "data"))
    ingest.record_changes(s, feed, batch_key(1, "changes", 0))
    from postroom.operators.changes import change_state

    # Of one history record adds come before deletes, whatever the order of the rows.
    for rows in (s.changes(), s.changes().orderBy("op"), s.changes().orderBy(F.desc("op"))):
        assert {r.gmail_id: r.last_op for r in change_state(rows).collect()} == {"a": "delete", "b": "add"}


class Mailboxes:
    """Two accounts: one with a history, one without a cursor; a third one always fails."""

    mails = {1: {m["id"]: m for m in MAILS[:2]}, 2: {m["id"]: m for m in MAILS[2:]}}

    def __init__(self, account):
        if account == 3:
            raise RuntimeError("no access")
        self.own = self.mails[account]

    def get_profile(self):
        return {"historyId": "50"}

    def list_messages(self, token):
        ids = sorted(self.own)
        return {"messages": [{"id": ids[0]}], "nextPageToken": "2"} if token is None else {"messages": [{"id": i} for i in ids[1:]]}

    def get_history(self, start, token):
        assert start == 10
        added = [{"message": {"id": i}} for i in [*sorted(self.own), "gone"]]
        return {"history": [{"id": "20", "messagesAdded": added}, {"id": "21", "messagesDeleted": [{"message": {"id": "gone"}}]}]}

    def get_message(self, key):
        return self.own[key]


def test_notices_to_transformed_mail(spark, tmp_path, config):
    from postroom.streaming import chain, feeds

    notice = lambda address, history: base64.b64encode(json.dumps({"emailAddress": address, "historyId": history}).encode()).decode()
    folder = str(tmp_path / "notices")
    rows = [(1, notice("a@x", 40)), (2, notice("a@x", 41)), (3, notice("b@x", None)), (4, notice("c@x", 7)), (5, notice("who@x", 1)), (6, "%%")]
    raw = spark.createDataFrame(rows, "message_id long, data string")
    raw.write.parquet(folder)
    accounts = spark.createDataFrame([(1, "a@x", 10), (2, "b@x", None), (3, "c@x", 5)], "id int, email_address string, last_history_id long")
    s = MailStore(spark, str(tmp_path / "data"))
    for _ in range(2):  # the second run of the same streams has nothing to do
        stream = feeds.parquet_stream(spark, folder, raw.schema)
        for query in chain.follow_mailboxes(stream, accounts, s, Mailboxes, str(tmp_path / "checkpoint"), config):
            feeds.run_to_end(query)
    mails = {r.gmail_id: (r.account_id, r.deleted_at is not None, r.transform_completed_at is not None) for r in s.emails().collect()}
    assert mails == {"m1": (1, False, True), "m2": (1, False, True), "m3": (2, False, True), "m4": (2, False, True)}
    events = {r.account_id: (r.event_type, r.status, r.emails_processed) for r in spark.read.parquet(s.path("sync_events")).collect()}
    assert events == {1: ("incremental", "completed", 2), 2: ("full_sync", "completed", 2), 3: ("incremental", "failed", 0)}
    assert {r.account_id: r.last_history_id for r in chain.cursors(s).collect()} == {1: 50, 2: 50}
    known = {r.id: r.last_history_id for r in chain.with_cursors(accounts, s).collect()}
    assert known == {1: 50, 2: 50, 3: 5}


class Archive:
    """A mailbox of 20,000 messages over a year, a page of 500 at a time; one day is broken."""

    def __init__(self, account):
        self.asked = 0

    def list_messages(self, token, query=""):
        from datetime import date

        (a, b) = (date(*map(int, query.split(f"{side}:")[1].split()[0].split("/"))) for side in ("after", "before"))
        assert query.startswith("label:INBOX ")
        days = [d.toordinal() for d in (a, b)]
        ids = [f"m{i}" for i in range(20_000) if days[0] <= date(2024, 1, 1).toordinal() + i % 366 < days[1]]
        at = int(token or 0)
        if at and a <= date(2024, 5, 5) < b:
            raise RuntimeError("page lost")
        page = {"messages": [{"id": i} for i in ids[at : at + 500]], "resultSizeEstimate": len(ids)}
        return {**page, "nextPageToken": str(at + 500)} if at + 500 < len(ids) else page


def test_a_listing_is_split_by_dates(spark):
    from datetime import date

    from postroom.sources import mailbox

    year = spark.sql("select 1 as account_id, date'2024-01-01' as after, date'2025-01-01' as before")
    ranges = mailbox.split_ranges(year, Archive, "label:INBOX", most=3_000).cache()
    spans = sorted((r.after, r.before) for r in ranges.collect())
    assert len(spans) == 8 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    listed = mailbox.list_ranges(ranges, Archive, "label:INBOX", tasks=8)
    done = {(r.after, r.before): r.status for r in listed.where("status is not null").collect()}
    assert sorted(done) == spans and sorted(done.values()) == ["completed"] * 7 + ["failed"]
    whole = listed.join(listed.where("status = 'completed'").select("after"), "after").where("gmail_id is not null")
    bad = next(k for k, v in done.items() if v == "failed")
    want = sum(not bad[0].toordinal() <= date(2024, 1, 1).toordinal() + i % 366 < bad[1].toordinal() for i in range(20_000))
    assert whole.count() == whole.select("gmail_id").distinct().count() == want
