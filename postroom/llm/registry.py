"""Queries of this subpackage with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from postroom.session import new_work_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows and bytes of whole texts in one Arrow batch: the default of 10,000 rows is too much for a worker.
BATCH_ROWS, BATCH_BYTES = "1000", "32m"


def prepare(spark: SparkSession) -> None:
    """What every job of this subpackage needs of the session."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def query(name: str, oracle: str | None = None):
    """Register a query under ``name``, with its SQL where SQL can express it."""

    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return add


def by_size(texts: Iterable, most: int = 4_000_000) -> Iterator[list]:
    """Consecutive texts in lists of up to ``most`` characters (a longer text makes one alone)."""
    part: list = []
    size = 0
    for text in texts:
        n = len(text or "")
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += n
    if part:
        yield part


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the cluster's shared folder, read again.

    Cuts the lineage: later steps read files that outlive any executor.
    """
    path = f"{new_work_dir(df.sparkSession, purpose)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
