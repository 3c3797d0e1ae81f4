"""Snapshots of a mail store: three tables in hash buckets of the mail id, and what they hold.

``messages``, ``states`` (the folded change log) and ``results`` (the newest transform result) of a
mail lie in buckets of equal number, so they join without any exchange.  A snapshot names the
delta folders that it holds; readers take it together with the folders it does not name.  It counts
from the moment its list is written, which is the last step: a crash before leaves the snapshot and the
deltas of before, and nothing is removed until a later snapshot stands.  Tables that have no news are
taken over by name.  Numbers come from counters in the store, never from a clock.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "gmail_id"
TABLES = ("messages", "states", "results")
#: The delta folders that feed each table.
DELTAS = {"messages": "messages", "states": "changes", "results": "transformed"}


@dataclass(frozen=True)
class Snapshot:
    version: int
    buckets: int
    paths: dict[str, str] = field(default_factory=dict)

    @property
    def folder(self) -> str:
        return f"version={self.version}"


def table_name(path: str) -> str:
    return "postroom_" + hashlib.md5(path.encode(), usedforsecurity=False).hexdigest()


def write_bucketed(df: DataFrame, path: str, buckets: int) -> None:
    """One file per bucket, sorted by mail id; no exchange if ``df`` comes from a join of such buckets."""
    dealt = df.repartition(buckets, KEY)
    dealt.write.mode("overwrite").bucketBy(buckets, KEY).sortBy(KEY).option("path", path).saveAsTable(table_name(path))


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType, buckets: int) -> DataFrame:
    """The table of ``write_bucketed``; other sessions learn of its buckets from here."""
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        ddl = spark._jsparkSession.parseDataType(schema.json()).toDDL()
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def overlay(older: DataFrame | None, newer: DataFrame | None, newer_wins=None) -> DataFrame | None:
    """Rows of two tables with unique mail ids, one row per id, as a join: buckets stay where they are.

    ``newer_wins``: condition on the aliases ``a`` and ``b``, asked where both have the id.
    """
    if older is None or newer is None:
        return newer if older is None else older
    takes_b = F.col(f"a.{KEY}").isNull() | (F.lit(False) if newer_wins is None else F.col(f"b.{KEY}").isNotNull() & newer_wins)
    joined = older.alias("a").join(newer.alias("b"), F.col(f"a.{KEY}") == F.col(f"b.{KEY}"), "full")
    rest = [F.when(takes_b, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in older.columns if c != KEY]
    return joined.select(F.coalesce(f"a.{KEY}", f"b.{KEY}").alias(KEY), *rest).select(older.columns)
