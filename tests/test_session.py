from __future__ import annotations

from pyspark.sql import functions as F

from postroom.catalog import QUERIES


def test_python_gets_whole_mails_in_bounded_batches(spark, sf):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    QUERIES["message_parse"](spark, sf)
    seen = spark.range(0, 5000, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    counts = [r.n for r in seen.limit(2000).mapInArrow(rows, "n long").collect()]
    assert sum(counts) == 2000 and max(counts) <= 100
    narrow = [r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(rows, "n long").collect()]
    assert sum(narrow) == 5000 and max(narrow) <= 500
