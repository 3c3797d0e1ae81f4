from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postroom.llm import packing, vectorpacking
from postroom.llm.vectorpacking import Example, Limits, Packer


def check(done: list, examples: list[Example], limits: Limits) -> int:
    """Every token once, all limits kept; returns the number of padded tokens."""
    spans, padded = defaultdict(list), 0
    for pieces in done:
        size = sum(b - a for _, a, b in pieces)
        assert 0 < size <= limits.tokens and len(pieces) <= limits.segments
        assert sum(w.loss(a, b) for w, a, b in pieces) <= limits.loss
        padded += limits.tokens - size if size & (size - 1) else 0
        for w, a, b in pieces:
            assert a < b
            spans[id(w)].append((a, b))
    for w in examples:
        got = sorted(spans[id(w)])
        assert [a for a, _ in got] == [0, *[b for _, b in got[:-1]]] and got[-1][1] == w.size
    return padded


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 4, 64), Limits(64, 64, 20), Limits(128, 3, 50), Limits(16, 1, 5)])
def test_limits_hold_and_nothing_is_padded(limits):
    rng = random.Random(limits.segments)
    packer = Packer(limits, window=64)
    examples = []
    for k in range(700):
        size = rng.choice([1, 2, rng.randrange(1, 30), rng.randrange(1, 3 * limits.tokens)])
        examples.append(Example(k, b"\0" * 4 * size, 0, rng.choice([0, 0, size, rng.randrange(0, size + 1)])))
        packer.add(examples[-1])
    packer.pack()
    assert not packer.waiting
    assert check(packer.done, examples, limits) == 0


def test_dot_product_mixes_scarce_needs():
    """Long prompts without loss and short answers share sequences, so neither limit is left unused."""
    limits = Limits(64, 8, 24)
    examples = [Example(k, b"\0" * 4 * 44, 0, 44) for k in range(100)] + [Example(k, b"\0" * 4 * 20, 0, 0) for k in range(100)]
    packer = Packer(limits, window=1000)
    for w in examples:
        packer.add(w)
    packer.pack()
    check(packer.done, examples, limits)
    assert len(packer.done) == 100  # one of each; equal kinds together would need more


def test_query_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plain = Tokenizer.from_file(packing.default_tokenizer())
    want = {r.doc_id: plain.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    rows = vectorpacking.op12_vectorpacking(spark, sf).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        own = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length, r.segments))
    for doc_id, ids in want.items():
        at = 0
        for start, length in sorted(by_doc[doc_id]):
            assert start == at
            at += length
        assert at == len(ids)
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length, segments in sorted(pieces):
            assert offset == at and segments == len(pieces) <= 64
            at += length
        assert at <= 1024
        padded += 1024 - at if at & (at - 1) else 0
    assert padded == 0


def test_prompts_nulls_repeats_and_other_columns(spark):
    rows = [(1, "the cat sat", "say it", 0), (1, "the cat sat", "say it", 0), (None, "words " * 3000, None, 0), (3, None, "only asked", 0), (4, "", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, asked string, ids int").coalesce(1)
    got = vectorpacking.pack(docs, limits=Limits(256, 4, 200), prompt=F.col("asked"), keep_ids=True)
    held = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("loss_tokens").alias("loss"), F.count("*").alias("k")).collect()
    assert all(r.n <= 256 and r.n & (r.n - 1) == 0 and r.loss <= 200 and r.k <= 4 for r in held)
    whole = got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    plain = Tokenizer.from_file(packing.default_tokenizer())
    ids = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    assert {r.doc_id: r.n for r in whole} == {
        1: 2 * (ids("the cat sat") + ids("say it") + 1), None: ids("words " * 3000) + 1, 3: ids("only asked") + 1, 4: 1}
    assert vectorpacking.pack(docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        vectorpacking.pack(docs, limits=Limits(1000))
