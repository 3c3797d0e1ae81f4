from __future__ import annotations

import zlib

from postroom.llm import quality
from postroom.llm.registry import QUERIES


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op5_quality"](spark, sf).collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y, _ in held if y == 1], [s for s, y, _ in held if y == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins >= 0.97 * len(good) * len(bad)
    assert sum(p == y for _, y, p in held) >= 0.95 * len(held)


def test_rules_in_spark_equal_rules_in_python(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels)
    assert 0 < len(model.rules) < 120 and len(model.describe()) == len(model.rules)
    rows = quality.with_statistics(docs).withColumn("score", model.column()).collect()
    for r in rows[:200]:
        total = model.intercept
        for conditions, weight in model.rules:
            if all((r.stats[k] > t) == above for k, above, t in conditions):
                total += weight
        assert abs(r.score - 1 / (1 + 2.718281828459045**-total)) < 1e-9


def test_statistics_of_odd_texts():
    assert quality.statistics(b"") == [0.0] * len(quality.STATISTICS)
    for text in ("\n\n", " ", "é" * 10, "a" * 100_000, "line\nline\nline", "#$%|!?"):
        found = quality.statistics(text.encode())
        assert len(found) == len(quality.STATISTICS) and all(v == v and abs(v) < 1e6 for v in found)
    at = quality.STATISTICS.index("distinct_lines")
    assert quality.statistics(b"line\nline\nline\n")[at] == 1 / 3


def test_nulls_one_label_only_no_rows_and_clashing_names(spark, sf):
    rows = [(1, None, 5), (2, "", 5), (None, "some words here", 5), (3, "word " * 300_000, 5), (1, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.learn(docs, labels)
    got = quality.score(docs, model).collect()
    assert [r.doc_id for r in got] == [1, 2, None, 3, 1] and all(0 < r.score < 0.5 for r in got)
    empty = quality.learn(docs.limit(0), labels.limit(0))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.score(docs.limit(0), empty).collect() == []
