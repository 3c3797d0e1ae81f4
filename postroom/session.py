"""Session settings and the shared folder for checkpoints and written state."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows and bytes of whole mails in one Arrow batch.  A worker holds a batch as Arrow, as Python objects and
#: as the answer at once, and a task has a worker per step in Python.
BATCH_ROWS, BATCH_BYTES = "500", "8m"


def build_session(app: str = "postroom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; sized for the cluster, overridable per key.

    Shuffles start wide and adaptive execution merges small partitions, so one setting
    serves both a laptop and a thousand executors.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
        "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
        "spark.ui.showConsoleProgress": "false",
    }
    local = master or ""
    if local.startswith("local"):
        cores = local[6:-1] if "[" in local else "1"
        width = str(os.cpu_count() if cores in ("*", "") else int(cores))
        settings["spark.sql.shuffle.partitions"] = width
    else:
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = "4000"
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="postroom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_work_dir(spark: SparkSession, purpose: str) -> str:
    return f"{shared_dir(spark)}/postroom-{purpose}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Batch limits for whole mails in a session that ``build_session`` did not make."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started.

    Once per application: the zipped sources travel with Spark's own file distribution.
    """
    context = spark.sparkContext
    if getattr(context, "_postroom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="postroom-src-")
    archive = Path(folder) / "postroom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._postroom_shipped = True
