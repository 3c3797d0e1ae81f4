from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from postroom.llm import decontaminate


WORD = r"[^\W_]+"


def plain_shingles(text: str | None) -> set[str]:
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_leaks(docs, items):
    best: dict = {}
    for d, text in docs:
        own = plain_shingles(text)
        line = f" {' '.join(re.findall(WORD, (text or '').lower()))} "
        for i, passage in items:
            wanted = plain_shingles(passage)
            k = len(own & wanted)
            words = re.findall(WORD, (passage or "").lower())
            if 0 < len(words) < 5:  # anywhere in the text, in a row
                k = int(f" {' '.join(words)} " in line)
            if d is not None and i is not None and wanted and k >= math.ceil(0.8 * len(wanted) - 1e-9):
                best[d, i] = max(best.get((d, i), 0), k / len(wanted))
    return sorted((d, i, c) for (d, i), c in best.items())


def test_planted_passages_match_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["éa", "the", "of"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.choice([2, 4, 5, 6, 9, 20, 40, 90]))) for i in range(40)]
    docs = []
    for d in range(200):
        words = text(rng.choice([0, 3, 30, 400, 3000]))
        if d % 2 == 0:
            passage = list(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = passage
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(words).title() if d % 3 else " ".join(words)))
    docs += [(7, " ".join(items[3][1])), (7, None), (None, " ".join(items[3][1])), (500, " ".join(items[0][1]))]
    items = [(i, " ".join(w)) for i, w in items] + [(3, "other words of one item said here"), (None, "x y z"), (90, None), (91, ""), (92, " ".join(items[5][1]))]
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id bigint, text string, hash string")
    b = spark.createDataFrame([(*r, "c") for r in items], "item_id bigint, text string, doc_id string")
    got = sorted((r.doc_id, r.item_id, r.containment) for r in decontaminate.leaks(d, b).collect())
    want = plain_leaks(docs, items)
    assert len(want) > 30 and got == want
    assert decontaminate.leaks(d.limit(0), b).collect() == [] and decontaminate.leaks(d, b.limit(0)).collect() == []


def test_no_python_in_the_plan(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate.leaks(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_very_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a b c d e " * 60_000 + passage + " a b c" * 60_000)], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, passage)], "item_id bigint, text string")
    assert [tuple(r) for r in decontaminate.leaks(docs, items).collect()] == [(1, 5, 26, 26, 1.0)]


def test_short_items_inside_documents(spark):
    docs = [(1, "Trivia night. Who wrote Hamlet? Nobody knew."), (2, "who wrote"), (3, "hamlet who wrote"), (4, "who wrote hamlet who wrote hamlet"), (5, None)]
    items = [(7, "who wrote hamlet"), (8, "Hamlet"), (9, "wrote Hamlet, nobody"), (10, "who wrote hamlet")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.n_shingles, r.n_shared, r.containment) for r in decontaminate.leaks(d, b).collect())
    assert [r[:2] for r in got] == [(1, 7), (1, 8), (1, 9), (1, 10), (3, 8), (4, 7), (4, 8), (4, 10)] and all(r[2:] == (1, 1, 1.0) for r in got)


def test_a_shared_sentence_makes_few_candidates(spark):
    """400 items and 400 documents share one sentence; none of the documents holds an item."""
    sentence = " ".join(f"shared{i}" for i in range(12))
    own = lambda kind, n: " ".join(f"{kind}{n}x{i}" for i in range(30))
    items = spark.createDataFrame([(i, f"{own('item', i)} {sentence}") for i in range(400)], "item_id bigint, text string")
    docs = [(d, f"{own('doc', d)} {sentence} {own('more', d)}") for d in range(400)] + [(1000, f"{own('doc', 1)} {own('item', 5)} {sentence}")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    known = decontaminate.sketches(decontaminate.distinct_items(items)[1])
    text = docs.select("doc_id", "text", decontaminate.words_of(F.col("text")).alias("words"))
    assert decontaminate.candidates(text, known).select(F.explode("items")).count() < 100
    assert [r[:2] for r in decontaminate.leaks(docs, items).collect()] == [(1000, 5)]
