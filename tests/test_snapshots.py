"""Snapshots with deltas, co-located joins, keyed stream state."""

from __future__ import annotations

import base64
import json
import random
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from postroom.plans import ingest
from postroom.sources import notices
from postroom.sources.store import MESSAGES, TRANSFORMED, MailStore
from postroom.streaming import feeds, state

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TIER = "gmail_id string, privacy_tier int"


def put(store, key, mails=(), changes=(), tiers=(), run=None):
    """One batch of messages, changes and results, given as short rows."""
    spark = store.spark
    if mails:
        kinds = spark.createDataFrame([], MESSAGES).schema
        rows = spark.createDataFrame([(m,) for m in mails], "gmail_id string")
        own = {"gmail_id": F.col("gmail_id"), "id": F.xxhash64("gmail_id"), "body_text": F.concat(F.lit("body of "), "gmail_id"), "account_id": F.lit(1)}
        store.append("messages", rows.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds]), "batch", key)
    if changes:
        feed = spark.createDataFrame(list(changes), "gmail_id string, op string, seq long").withColumn("at", F.timestamp_seconds("seq"))
        ingest.record_changes(store, feed, key)
    if tiers:
        kinds = spark.createDataFrame([], TRANSFORMED).schema
        rows = spark.createDataFrame(list(tiers), TIER)
        made = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds])
        store.append("transformed", made, "run", store.claim("transformed", run))


def view(store):
    return {r.gmail_id: (r.deleted_at and r.deleted_at.second, r.privacy_tier, r.body_text) for r in store.emails().collect()}


def test_snapshot_and_news_equal_the_plain_log(spark, tmp_path):
    """Random batches, compacted or not at random, against a store that is never compacted."""
    rng = random.Random(4)
    plain, folded = (MailStore(spark, str(tmp_path / n), 3) for n in ("plain", "folded"))
    seq = 0
    for n in range(4):
        changes = [(f"m{rng.randrange(12)}", rng.choice(["add", "delete"]), (seq := seq + 1) % 59) for _ in range(9)]
        tiers = [(f"m{k}", n + 1) for k in rng.sample(range(12), 4)]
        for s in (plain, folded):
            put(s, f"1-a-0-{n}", [f"m{k}" for k in range(n * 3, n * 3 + 3)], changes, tiers)
        if n in (0, 2):
            assert folded.compact() == [1, 0, 2][n]
        if n:
            assert view(folded) == view(plain)
    assert folded.change_states().count() == plain.change_states().count()
    assert folded.messages().count() == 12 and folded.states().count() == 12
    assert folded.transformed().count() == plain.transformed().count()


def test_a_crash_between_any_two_writes_loses_nothing(spark, tmp_path, monkeypatch):
    store = MailStore(spark, str(tmp_path / "data"), 2)
    put(store, "1-a-0-0", ["m1", "m2"], [("m1", "delete", 7)], [("m2", 2)])
    store.compact()
    put(store, "1-a-0-1", ["m3"], [("m1", "add", 9), ("m2", "delete", 11)], [("m2", 3), ("m3", 1)])
    want = view(store)
    from postroom.sources import store as module

    real, writes = module.write_bucketed, []

    def failing(df, path, buckets):
        if len(writes) == stop:
            raise RuntimeError("lost the driver")
        writes.append(path)
        real(df, path, buckets)

    monkeypatch.setattr(module, "write_bucketed", failing)
    for stop in range(3):
        writes.clear()
        with pytest.raises(RuntimeError):
            store.compact()
        assert view(store) == want
    monkeypatch.setattr(module, "write_bucketed", real)
    # The list is the last write: without it the tables do not count.
    monkeypatch.setattr(type(spark.range(1)), "coalesce", lambda *_: (_ for _ in ()).throw(RuntimeError("before the list")))
    with pytest.raises(RuntimeError):
        store.compact()
    monkeypatch.undo()
    assert view(store) == want and store.compact() > 2 and view(store) == want
    assert store.compact() is None


def test_numbers_need_no_clock_and_replays_are_no_news(spark, tmp_path):
    store = MailStore(spark, str(tmp_path / "data"), 2)
    put(store, "1-a-0-0", ["m1"], [("m1", "add", 1)], [("m1", 1)], run=5)
    assert [store.claim("transformed") for _ in range(3)] == [6, 7, 8]
    put(store, "1-a-0-1", [], [("m1", "delete", 3)], [("m1", 2)], run=9)
    store.compact()
    put(store, "1-a-0-2", [], [], [("m1", 3)])
    assert view(store)["m1"][1] == 3  # a later claim wins, whatever the clocks said
    late = MailStore(spark, store.root, 2)
    put(late, "1-a-0-3", [], [], [("m1", 1)], run=7)  # an earlier claim that is written late does not
    assert view(store)["m1"][1] == 3
    store.compact()
    assert view(store)["m1"][:2] == (3, 3)
    gone = store.drop_old(keep=0)
    assert "transformed/run=9" in gone and "snapshots/version=1" in gone and view(store)["m1"][:2] == (3, 3)
    # A batch that is replayed after its folder is gone is still known to the snapshot.
    put(store, "1-a-0-1", [], [("m1", "delete", 3)])
    states = {r.gmail_id: (r.adds, r.deletes) for r in store.change_states().collect()}
    assert states == {"m1": (1, 1)} and store.compact() is None


def test_another_session_and_other_buckets(spark, tmp_path):
    store = MailStore(spark, str(tmp_path / "data"), 2)
    put(store, "1-a-0-0", ["m1", "m2"], [("m1", "delete", 7)], [("m2", 2)])
    store.compact()
    want = view(store)
    for t in spark.catalog.listTables():
        if t.name.startswith("postroom_"):
            spark.sql(f"DROP TABLE {t.name}")
    assert view(MailStore(spark, store.root)) == want
    wider = MailStore(spark, store.root, 5)
    put(wider, "1-a-0-1", ["m3"])
    wider.compact()
    assert wider.snapshot().buckets == 5 and set(view(wider)) == {"m1", "m2", "m3"}


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange " in line]


def test_co_located_joins_move_nothing(spark, sf):
    from postroom.catalog.ingest import colocated_store

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = colocated_store(spark, sf)
        assert exchanges(store.emails()) == [] and exchanges(store.states()) == []
        # News are brought to the buckets; the snapshot's mails stay where they are.
        put(store, "1-a-0-9", [], [("m1", "delete", 5_000_000)])
        moved = exchanges(store.emails())
        assert moved and store.emails()._jdf.queryExecution().executedPlan().toString().count("Bucketed: true") >= 3
        assert not any("body_text" in line for line in moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def notice(address, history):
    return base64.b64encode(json.dumps({"emailAddress": address, "historyId": history}).encode()).decode()


def run_windows(spark, folder, accounts, root):
    raw = feeds.parquet_stream(spark, folder, spark.createDataFrame([], "message_id long, data string").schema)
    routed = notices.route(notices.decode(raw), accounts, with_cursor=True)
    out = state.account_windows(routed).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
    feeds.run_to_end(out.trigger(availableNow=True).start())
    return sorted(map(tuple, spark.read.schema(state.WINDOWS).parquet(f"{root}/out").collect()))


def test_windows_go_on_after_a_restart_and_ignore_late_notices(spark, tmp_path):
    accounts = spark.createDataFrame([(1, "a@x", 10), (2, "b@x", None)], "id int, email_address string, last_history_id long")
    folder, root = str(tmp_path / "notices"), str(tmp_path / "run")
    batches = [[("a@x", 40), ("a@x", 30), ("b@x", 7)], [("a@x", 35), ("b@x", 7), ("b@x", 5)], [("a@x", 41), ("c@x", 9)]]
    want = [[(1, 10, 40), (2, 0, 7)], [], [(1, 40, 41)]]
    seen = []
    for n, batch in enumerate(batches):
        rows = [(n * 10 + i, notice(a, h)) for i, (a, h) in enumerate(batch)]
        spark.createDataFrame(rows, "message_id long, data string").write.mode("append").parquet(folder)
        seen = sorted([*seen, *want[n]])
        assert run_windows(spark, folder, accounts, root) == seen  # each run is a restart from the checkpoint


class Flaky:
    """Fails until a file exists; then it has one history page."""

    def __init__(self, account, folder):
        self.folder = folder

    def get_profile(self):
        return {"historyId": "50"}

    def get_history(self, start, token):
        from pathlib import Path

        if not Path(self.folder, "works").exists():
            raise RuntimeError("try later")
        return {"history": [{"id": str(start + 1), "messagesAdded": [{"message": {"id": "m1"}}]}]}


def test_a_failed_account_is_tried_again_by_its_timer(spark, tmp_path):
    from postroom.streaming import chain

    accounts = spark.createDataFrame([(1, "a@x", 10)], "id int, email_address string, last_history_id long")
    folder = str(tmp_path / "notices")
    spark.createDataFrame([(1, notice("a@x", 40))], "message_id long, data string").write.parquet(folder)
    store, place = MailStore(spark, str(tmp_path / "data")), str(tmp_path)

    raw = feeds.parquet_stream(spark, folder, spark.createDataFrame([], "message_id long, data string").schema)
    run = chain.follow_histories(raw, accounts, store, lambda a: Flaky(a, place), str(tmp_path / "checkpoint"), 0.5, {"processingTime": "0 seconds"})

    def events():
        if not store.exists(store.path("sync_events")):
            return set()
        reader = spark.read.schema("status string, emails_processed long").option("recursiveFileLookup", "true")
        found = reader.parquet(store.path("sync_events")).collect()
        return {(r.status, r.emails_processed) for r in found}

    def wait(status):
        until = time.time() + 60
        while status not in events() and time.time() < until and run.isActive:
            time.sleep(0.5)

    try:
        wait(("failed", 0))
        assert events() == {("failed", 0)} and chain.cursors(store).count() == 0
        (tmp_path / "works").write_text("")
        wait(("completed", 1))  # no new notice: the timer alone asks again
    finally:
        run.stop()
    assert events() == {("completed", 1), ("failed", 0)}
    assert [tuple(r) for r in chain.cursors(store).collect()] == [(1, 50)]
    assert [r.gmail_id for r in store.changes().collect()] == ["m1"]


def test_a_micro_batch_reads_its_own_folder_only(spark, tmp_path, monkeypatch):
    """The transform of a batch plans over that batch's messages, not over the store."""
    from postroom.plans import jobs, transform
    from postroom.plans.config import EngineConfig

    store = MailStore(spark, str(tmp_path / "data"), 2)
    put(store, "1-a-0-0", ["m1", "m2"])
    put(store, "1-a-0-1", ["m3"])
    seen = []

    def watched(emails, config, keep=()):
        seen.extend(emails.inputFiles())
        return store.spark.createDataFrame([], f"{TRANSFORMED}, answer struct<ms:double>").drop("completed_at")

    monkeypatch.setattr(transform, "transform", watched)
    jobs.run_transform(store, EngineConfig(dim=8), batch="1-a-0-1")
    assert seen and all("batch=1-a-0-1" in f for f in seen if "/messages/" in f)


def test_ids_are_new_once(spark, tmp_path):
    source, root = str(tmp_path / "history"), str(tmp_path / "run")
    kinds = "gmail_id string, op string, seq long, at timestamp"
    got = []
    for n, rows in enumerate([[("a", "add", 1), ("a", "add", 2), ("b", "delete", 3)], [("a", "add", 4), ("b", "add", 5), (None, "add", 6)]]):
        feed = spark.createDataFrame(rows, "gmail_id string, op string, seq long").withColumn("at", F.timestamp_seconds("seq"))
        feed.coalesce(1).write.mode("append").parquet(source)
        stream = feeds.parquet_stream(spark, source, spark.createDataFrame([], kinds).schema)
        out = state.first_adds(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/c")
        feeds.run_to_end(out.trigger(availableNow=True).start())
        got.append(sorted(r.gmail_id for r in spark.read.schema(kinds).parquet(f"{root}/out").collect()))
    assert got == [["a"], ["a", "b"]]


def test_index_segments_grow_by_tiers_and_outlive_their_batches(spark, tmp_path, monkeypatch):
    from postroom.operators import postings

    monkeypatch.setattr(postings, "TIER", 2)
    store = MailStore(spark, str(tmp_path / "data"), 2)
    assert store.index() is None and store.index_news() == 0
    put(store, "1-a-0-0", ["m1"])
    store.compact()  # indexed from the snapshot
    assert store.index_news() == 1 and store.index_news() == 0
    before = store.index()
    put(store, "1-a-0-1", ["m2"])
    assert store.index_news() == 1
    (segment,) = store.index()  # both merged; the text of the first batch was not read again
    assert segment.path != before[0].path and segment.rows == 6

    def found(query):
        return sorted(r.gmail_id for r in postings.search_segments(spark, store.index(), query, "gmail_id").collect())

    assert found("body of") == ["m1", "m2"] and found("m2") == ["m2"]
    # A batch that is in a snapshot but not in the index stays.
    put(store, "1-a-0-2", ["m3"])
    store.compact()
    assert store.drop_old(keep=0).count("messages/batch=1-a-0-1") == 1 and store.exists(f"{store.root}/messages/batch=1-a-0-2")
    assert store.index_news() == 1 and found("m3") == ["m3"]
    files = [sorted(spark.read.parquet(f"{s.path}/rows").inputFiles()) for s in store.index()]
    put(store, "1-a-0-3", [], [("m1", "delete", 4)])
    assert store.index_news() == 0 and files == [sorted(spark.read.parquet(f"{s.path}/rows").inputFiles()) for s in store.index()]


def test_first_adds_are_found_once_for_all_batches(spark, sf, monkeypatch):
    """The whole feed is folded once, not once per batch (F20), and the state is that of the whole feed."""
    from postroom.catalog import QUERIES, ingest
    from postroom.operators import changes
    from postroom.sources import given

    seen, first = [], changes.first_copies
    monkeypatch.setattr(changes, "first_copies", lambda *args, **more: seen.append(1) or first(*args, **more))

    def folded(feed):
        raise AssertionError("the feed is folded again")

    monkeypatch.setattr(ingest.changes, "change_state", folded)
    got = {r.gmail_id: r.deleted for r in QUERIES["compacted_mail_state"](spark, sf).collect()}
    assert len(seen) == 1
    last = {}
    for r in given.change_feed(spark, sf).orderBy("seq").collect():
        if r.op == "add" or r.gmail_id in last:
            last[r.gmail_id] = r.op == "delete"
    assert got == last
