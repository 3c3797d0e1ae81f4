"""Mail state as append-only Parquet folders, folded into snapshots.

Nothing large is rewritten when mail arrives, is deleted, or is transformed:

* ``messages/batch=K``     parsed messages, one row per message id
* ``attachments/batch=K``  attachment rows
* ``changes/batch=K``      the add / delete log
* ``transformed/run=N``    transform results and reset marks, the latest run per mail counts

K names the writer and its batch (``batch_key``): two accounts, a sync and a stream, or two
streams never share a folder, whatever they call their batches.  A batch folder is overwritten
as a whole, so a replayed micro-batch gives the same state.  N comes from a counter in the store.

``compact`` folds these into a snapshot (see ``snapshots``); readers take the newest snapshot and the
folders it does not hold yet.  ``publish`` writes the joined view as the table that searches read.
Mails are joined by their message id; the number ``id`` is for output only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.operators.changes import fold_changes, last_op, merged_state
from postroom.operators.postings import Segment, merge_segments, to_merge, write_segment
from postroom.sources.snapshots import DELTAS, KEY, Snapshot, overlay, read_bucketed, table_name, write_bucketed

CHANGES = "gmail_id string, op string, seq long, at timestamp"
MESSAGES = (
    "id long, account_id int, gmail_id string, gmail_thread_id string, history_id long, "
    "subject string, from_email string, from_name string, to_emails array<string>, "
    "cc_emails array<string>, bcc_emails array<string>, reply_to string, sent_at timestamp, "
    "labels array<string>, body_text string, snippet string, has_attachments boolean, "
    "attachment_count int, seq long"
)
ATTACHMENTS = (
    "gmail_id string, gmail_attachment_id string, filename string, mime_type string, "
    "size_bytes int, is_inline boolean"
)
STATES = (
    "gmail_id string, first_add long, adds long, deletes long, last long, last_delete long, last_delete_at timestamp"
)
TRANSFORMED = (
    "id long, gmail_id string, privacy_tier int, body_redacted string, snippet_redacted string, "
    "subject_embedding array<float>, body_embedding array<float>, "
    "body_pooled_embedding array<float>, "
    "chunks array<struct<text:string,position:int,weight:double,embedding:array<float>>>, "
    "body_kind string, lang string, problem string, vector_covers double, completed_at timestamp"
)
THREADS = (
    "account_id int, gmail_thread_id string, subject string, message_count long, "
    "last_message_at timestamp"
)


def batch_key(account: int | str, source: str, number: int, run: str = "0") -> str:
    """Folder of one writer's batch: account, kind of source, run (a stream's id) and number."""
    return f"{account}-{source}-{run}-{number}"


class MailStore:
    """``buckets``: of the tables that the next snapshot writes; about one per 128 MB of mail."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # ---- folders -------------------------------------------------------------

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def folders(self, name: str) -> list[str]:
        fs, p = self._fs(self.path(name))
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")))

    def versions(self, name: str) -> list[int]:
        """Completely written versions of a table that is replaced as a whole."""
        done = [n for n in self.folders(name) if self.exists(f"{self.path(name)}/{n}/_SUCCESS")]
        return sorted(int(n.split("=")[1]) for n in done)

    def claim(self, name: str, number: int | None = None) -> int:
        """The next number of a table's versions or runs, claimed by creating a file of that name.

        Later claims are larger whatever the clocks say, and of two writers only one gets a number.
        """
        fs, folder = self._fs(f"{self.path('counters')}/{name}")
        fs.mkdirs(folder)
        taken = [int(n) for n in self.folders(f"counters/{name}")]
        used = [int(n.split("=")[1]) for n in self.folders(name) if "=" in n]
        wanted = number if number is not None else max([0, *taken, *used]) + 1
        while not fs.createNewFile(self._fs(f"{self.path('counters')}/{name}/{wanted}")[1]) and number is None:
            wanted += 1
        return wanted

    def append(self, name: str, df: DataFrame, key: str, value: str | int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path(name)}/{key}={value}")

    def replace(self, name: str, df: DataFrame) -> None:
        df.write.mode("errorifexists").parquet(f"{self.path(name)}/version={self.claim(name)}")

    def read(self, name: str, schema: str, key: str, folders: list[str] | None = None) -> DataFrame:
        """All folders of a table, or the given ones."""
        kind = "long" if key == "run" else "string"
        found = self.folders(name) if folders is None else folders
        if not found:
            return self.spark.createDataFrame([], f"{schema}, {key} {kind}")
        reader = self.spark.read.schema(f"{schema}, {key} {kind}").option("basePath", self.path(name))
        return reader.parquet(*([self.path(name)] if folders is None else [f"{self.path(name)}/{f}" for f in found]))

    def newest(self, name: str, schema: str | None = None) -> DataFrame | None:
        versions = self.versions(name)
        if versions:
            return self.spark.read.parquet(f"{self.path(name)}/version={versions[-1]}")
        return None if schema is None else self.spark.createDataFrame([], schema)

    # ---- snapshots -----------------------------------------------------------

    def snapshot(self, version: int | None = None) -> Snapshot | None:
        versions = self.versions("snapshots")
        if not versions:
            return None
        number = versions[-1] if version is None else version
        rows = self.spark.read.parquet(f"{self.path('snapshots')}/version={number}").where("kind <> 'covered'").collect()  # a row per table
        paths = {r["name"]: r["value"] for r in rows if r["kind"] == "table"}
        return Snapshot(number, int(next(r["value"] for r in rows if r["kind"] == "buckets")), paths)

    def _covered(self, snap: Snapshot | None, name: str, folders: list[str]) -> set[str]:
        """Which of the folders that are there a snapshot holds."""
        if snap is None or not folders:
            return set()
        listed = self.spark.read.parquet(f"{self.path('snapshots')}/{snap.folder}").where((F.col("kind") == "covered") & (F.col("value") == name))
        return {r[0] for r in listed.where(F.col("name").isin(folders)).select("name").collect()}

    def news(self, name: str, snap: Snapshot | None) -> list[str]:
        """Delta folders of a table that the snapshot does not hold."""
        found = self.folders(name)
        return sorted(set(found) - self._covered(snap, name, found))

    def snapshot_table(self, snap: Snapshot | None, table: str) -> DataFrame | None:
        if snap is None or table not in snap.paths:
            return None
        schema = {"messages": MESSAGES, "states": STATES, "results": f"{TRANSFORMED}, run long"}[table]
        kind = self.spark.createDataFrame([], schema).schema
        return read_bucketed(self.spark, self.path(snap.paths[table]), kind, snap.buckets)

    def _delta(self, table: str, folders: list[str]) -> DataFrame | None:
        """News as a table with unique mail ids."""
        if not folders:
            return None
        if table == "messages":
            return self.read("messages", MESSAGES, "batch", folders).drop("batch")
        if table == "states":
            return fold_changes(self.read("changes", CHANGES, "batch", folders))
        runs = self.read("transformed", TRANSFORMED, "run", folders)
        # Winners are found on two narrow columns.
        latest = runs.groupBy(KEY).agg(F.max("run").alias("run"))
        return runs.join(latest, [KEY, "run"], "left_semi")

    def compact(self) -> int | None:
        """Fold the finished delta folders into a new snapshot; its number, or None without news.

        Each table is read once and written once; only the news are exchanged.  Of two results the
        later run counts, of two copies of a message the one already held.
        """
        snap = self.snapshot()
        news = {}
        for table, name in DELTAS.items():
            news[table] = [f for f in self.news(name, snap) if self.exists(f"{self.path(name)}/{f}/_SUCCESS")]
        if not any(news.values()):
            return None
        version = self.claim("snapshots")
        rebucket = snap is not None and snap.buckets != self.buckets
        paths = dict(snap.paths) if snap else {}
        for table, folders in news.items():
            older = self.snapshot_table(snap, table)
            if not folders and not (rebucket and older is not None):
                continue
            newer = self._delta(table, folders)
            if table == "states" and older is not None and newer is not None:
                joined = older.alias("a").join(newer.alias("b"), F.col(f"a.{KEY}") == F.col(f"b.{KEY}"), "full")
                merged = joined.select(F.coalesce(f"a.{KEY}", f"b.{KEY}").alias(KEY), *[c.alias(n) for n, c in merged_state("a", "b").items()])
            else:
                merged = overlay(older, newer, F.col("b.run") > F.col("a.run") if table == "results" else None)
            paths[table] = f"tables/{table}-{version}"
            write_bucketed(merged, self.path(paths[table]), self.buckets)
        rows = [("buckets", "", str(self.buckets)), *[("table", t, p) for t, p in paths.items()]]
        rows += [("covered", f, DELTAS[t]) for t, folders in news.items() for f in folders]
        listed = self.spark.createDataFrame(rows, "kind string, name string, value string")
        if snap is not None:  # names stay, so a batch that is replayed after its folder is gone is not new
            listed = listed.union(self.spark.read.parquet(f"{self.path('snapshots')}/{snap.folder}").where("kind = 'covered'"))
        # The last write: from here on the snapshot counts.
        listed.coalesce(1).write.parquet(f"{self.path('snapshots')}/version={version}")
        return version

    def drop_old(self, keep: int = 1) -> list[str]:
        """Remove what only readers of snapshots before the newest ``keep + 1`` can still want.

        Returns what was removed: delta folders that all kept snapshots hold, tables that none of them
        names, and older lists.  Nothing goes while there are no more than ``keep`` snapshots.
        """
        versions = self.versions("snapshots")
        if len(versions) <= keep:
            return []
        kept = [self.snapshot(v) for v in versions[-keep - 1 :]]
        gone = []
        for name in DELTAS.values():
            found = self.folders(name)
            held = reduce(set.intersection, [self._covered(s, name, found) for s in kept])
            if name == "messages" and (listed := self._index_list()) is not None:
                held &= self._indexed(listed, found)  # the index reads them first
            gone += [f"{name}/{f}" for f in sorted(held)]
        named = {p for s in kept for p in s.paths.values()}
        finished = kept[-1].version
        tables = [f"tables/{t}" for t in self.folders("tables") if f"tables/{t}" not in named and int(t.split("-")[1]) <= finished]
        lists = [f"snapshots/version={v}" for v in versions[: -keep - 1]]
        for folder in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table_name(self.path(folder))}")
        for folder in [*gone, *tables, *lists]:
            fs, p = self._fs(self.path(folder))
            fs.delete(p, True)
        return [*gone, *tables, *lists]

    # ---- tables --------------------------------------------------------------

    def _parts(self, table: str, *columns: str) -> list[DataFrame]:
        """Snapshot and news of a table, as far as they are there."""
        snap = self.snapshot()
        parts = [self.snapshot_table(snap, table), self._delta(table, self.news(DELTAS[table], snap))]
        return [p.select(*columns) if columns else p for p in parts if p is not None]

    def messages(self) -> DataFrame:
        none = self.spark.createDataFrame([], MESSAGES)
        return reduce(DataFrame.unionByName, self._parts("messages") or [none])

    def stored_ids(self, without: str | None = None) -> DataFrame:
        """Message ids that are stored, apart from the batch ``without``."""
        snap = self.snapshot()
        fresh = [f for f in self.news("messages", snap) if f != f"batch={without}"]
        held = self.snapshot_table(snap, "messages")
        ids = self.read("messages", "gmail_id string", "batch", fresh).select(KEY)
        return ids if held is None else held.select(KEY).union(ids)

    def changes(self) -> DataFrame:
        """The change log that no snapshot holds yet."""
        return self.read("changes", CHANGES, "batch", self.news("changes", self.snapshot())).drop("batch")

    def change_states(self) -> DataFrame:
        """Net effect of all changes per message id, those of the snapshot included."""
        parts = self._parts("states")
        if len(parts) < 2:
            found = parts[0] if parts else self.spark.createDataFrame([], STATES)
        else:
            joined = parts[0].alias("a").join(parts[1].alias("b"), F.col(f"a.{KEY}") == F.col(f"b.{KEY}"), "full")
            found = joined.select(F.coalesce(f"a.{KEY}", f"b.{KEY}").alias(KEY), *[c.alias(n) for n, c in merged_state("a", "b").items()])
        return found.withColumn("last_op", last_op(F.col("last"))).drop("last", "last_delete")

    def attachments(self) -> DataFrame:
        return self.read("attachments", ATTACHMENTS, "batch").drop("batch")

    def transformed(self) -> DataFrame:
        """The latest result per mail."""
        parts = self._parts("results") or [self.spark.createDataFrame([], f"{TRANSFORMED}, run long")]
        return overlay(parts[0], parts[1] if len(parts) > 1 else None, F.col("b.run") > F.col("a.run")).drop("run")

    def chunks(self) -> DataFrame:
        from postroom.plans.transform import chunk_rows

        return chunk_rows(self.transformed())

    def threads(self) -> DataFrame:
        """One row per thread, counted from the messages (inserts, not later deletes)."""
        from postroom.operators.threads import upsert_threads

        none = self.spark.createDataFrame([], THREADS)
        return upsert_threads(none, self.messages())

    def _view(self, mail: list[str | Column], result: dict[str, Column]) -> DataFrame:
        """Messages with their delete state and columns of their newest result.

        The snapshot's mails and the new ones are joined apart: a join of the snapshot's tables moves
        nothing, and only news are brought to their buckets.  ``result`` reads the alias ``r``.
        """
        snap = self.snapshot()
        fresh = {t: self._delta(t, self.news(n, snap)) for t, n in DELTAS.items()}
        held = {t: self.snapshot_table(snap, t) for t in DELTAS}
        views = []
        for mails in (held["messages"], fresh["messages"]):
            if mails is None:
                continue
            rows = mails.select(*mail).alias("m")
            names = []
            for alias, table in (("sa", held["states"]), ("sb", fresh["states"]), ("ra", held["results"]), ("rb", fresh["results"])):
                if table is None:
                    continue
                names.append(alias)
                if alias[0] == "r":
                    # Only the columns that are asked for leave the scan.
                    own = table.alias("r").select(F.col(f"r.{KEY}").alias("k"), F.col("r.run").alias("run"), *[c.alias(n) for n, c in result.items()])
                else:
                    own = table.withColumnRenamed(KEY, "k")
                rows = rows.join(own.alias(alias), F.col(f"m.{KEY}") == F.col(f"{alias}.k"), "left")
            views.append(rows.select("m.*", _deleted_at(names).alias("deleted_at"), *[_newest(names, n).alias(n) for n in result]))
        if not views:
            none = self.spark.createDataFrame([], MESSAGES).select(*mail)
            empty = self.spark.createDataFrame([], TRANSFORMED).alias("r").select(*[c.alias(n) for n, c in result.items()])
            return none.join(self.spark.createDataFrame([], "deleted_at timestamp")).join(empty)
        return reduce(DataFrame.unionByName, views)

    def emails(self) -> DataFrame:
        """Messages with their delete state and their derived columns."""
        names = ("privacy_tier", "body_redacted", "snippet_redacted", "subject_embedding", "body_embedding", "body_pooled_embedding")
        columns = [f.name for f in self.spark.createDataFrame([], MESSAGES).schema]
        return self._view(columns, {n: F.col(f"r.{n}") for n in names} | _completed())

    def states(self) -> DataFrame:
        """What decides about a transform, per email: narrow columns only.

        ``body_text`` is '' where there is a body; no text and no vector leaves its scan.
        """
        body = F.when(F.col("body_text").isNotNull(), F.lit("")).alias("body_text")
        return self._view(["id", "account_id", KEY, body], _completed())

    # ---- writes --------------------------------------------------------------

    def reset(self, account_id: int | None = None, run: int | None = None) -> None:
        """Append marks that outdate the scope's results: no derived row is rewritten."""
        from postroom.operators.changes import reset_scope

        scope = self.states().where(reset_scope(account_id)).select("id", KEY)
        marks = scope.select(
            "id",
            KEY,
            *[
                F.lit(None).cast(f.dataType).alias(f.name)
                for f in self.spark.createDataFrame([], TRANSFORMED).schema
                if f.name not in ("id", KEY)
            ],
        )
        self.append("transformed", marks, "run", self.claim("transformed", run))

    def publish(self) -> None:
        """Write the serving table, by account, newest mail together, and index what is new.

        Range partitions over (account, time, id) split a dominant account evenly, and
        row groups sorted by time let date filters skip most of the data.
        """
        emails = self.emails().repartitionByRange("account_id", "sent_at", "id")
        self.replace("served", emails.sortWithinPartitions("account_id", "sent_at", "id"))
        self.index_news()

    # ---- full text -----------------------------------------------------------

    def _index_list(self) -> DataFrame | None:
        return self.newest("indexes")

    def _indexed(self, listed: DataFrame | None, folders: list[str]) -> set[str]:
        if listed is None or not folders:
            return set()
        return {r[0] for r in listed.where((F.col("kind") == "batch") & F.col("name").isin(folders)).select("name").collect()}

    def index(self) -> list[Segment] | None:
        """The segments that hold all indexed mails; None before the first ``index_news``."""
        listed = self._index_list()
        if listed is None:
            return None
        found = listed.where("kind = 'segment'").orderBy("name").collect()  # few: sizes grow by tiers
        return [Segment(self.path(f"segments/{r['name']}"), r["buckets"], r["rows"]) for r in found]

    def index_news(self) -> int:
        """Index the message batches that no segment holds; the number of batches.

        The new list is written last, so a crash leaves the index of before.
        """
        listed = self._index_list()
        folders = [f for f in self.folders("messages") if self.exists(f"{self.path('messages')}/{f}/_SUCCESS")]
        snap = self.snapshot()
        if listed is None and snap is not None:  # the snapshot's mails may have no folders any more
            mails, fresh = self.messages(), folders
        else:
            fresh = sorted(set(folders) - self._indexed(listed, folders))
            mails = self.read("messages", MESSAGES, "batch", fresh)
        if not fresh and (listed is not None or snap is None):
            return 0
        name = f"segment={self.claim('segments')}"
        segments = [*(self.index() or []), write_segment(mails, self.path(f"segments/{name}"), KEY)]
        while due := to_merge(segments):
            path = self.path(f"segments/segment={self.claim('segments')}")
            segments = [s for s in segments if s not in due] + [merge_segments(self.spark, due, path, KEY)]
        rows = [("segment", s.path.rsplit("/", 1)[1], s.buckets, s.rows) for s in segments] + [("batch", f, 0, 0) for f in fresh]
        news = self.spark.createDataFrame(rows, "kind string, name string, buckets int, rows long")
        if listed is not None:
            news = news.union(listed.where("kind = 'batch'"))
        self.replace("indexes", news.coalesce(1))
        return len(fresh)

    def served(self) -> DataFrame:
        found = self.newest("served")
        return self.emails() if found is None else found


def _completed() -> dict[str, Column]:
    done = F.when(F.col("r.problem").isNull(), F.col("r.completed_at"))
    return {"transform_completed_at": done}


def _deleted_at(names: list[str]) -> Column:
    """Time of the last delete if it is the last change, from the joined states."""
    states = [n for n in names if n[0] == "s"]
    if not states:
        return F.lit(None).cast("timestamp")
    merged = merged_state(*states) if len(states) == 2 else {c: F.col(f"{states[0]}.{c}") for c in ("last", "last_delete_at")}
    return F.when(last_op(merged["last"]) == "delete", merged["last_delete_at"])


def _newest(names: list[str], column: str) -> Column:
    """A column of the joined result with the larger run."""
    results = [n for n in names if n[0] == "r"]
    if not results:
        return F.lit(None).cast(_KINDS[column])
    if len(results) == 1:
        return F.col(f"{results[0]}.{column}")
    a, b = results
    return F.when(F.coalesce(F.col(f"{b}.run") > F.col(f"{a}.run"), F.col(f"{b}.run").isNotNull()), F.col(f"{b}.{column}")).otherwise(F.col(f"{a}.{column}"))


_KINDS = {name: kind for name, kind in (f.split(" ") for f in TRANSFORMED.split(", "))} | {"transform_completed_at": "timestamp"}
