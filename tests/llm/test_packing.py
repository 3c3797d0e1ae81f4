from __future__ import annotations

import json
import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from postroom.llm import packing
from postroom.llm.registry import QUERIES


def plain_pieces(docs, capacity=1024):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    tokenizer.encode_special_tokens = True
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or min(len(ids), capacity)
        start, k = 0, 0
        while start < len(ids):
            end = start + (first if k == 0 else capacity)
            own = np.array(ids[start:end], "<u4").tobytes()
            yield doc_id, k, start, end - start, zlib.crc32(own)
            start, k = end, k + 1


def check_seats(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pieces_match_a_plain_cut_and_seats_are_gapless(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op10_packing"](spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(plain_pieces(docs))
    least = -(-sum(r.length for r in got) // 1024)
    assert check_seats(got, 1024) <= 1.03 * least


def test_plan_uses_every_length_exactly_and_stays_near_the_bound():
    rng = np.random.default_rng(3)
    for capacity, n in ((32, 400), (100, 5000), (1024, 30000), (7, 3), (1, 5)):
        histogram = np.bincount(np.minimum(capacity, 1 + rng.geometric(3 / capacity if capacity > 3 else 0.9, n)), minlength=capacity + 1)
        plan = packing.plan_sequences(histogram, capacity)
        used = np.zeros(capacity + 1, int)
        for pattern, times in plan:
            assert sum(pattern) <= capacity and times > 0
            np.add.at(used, list(pattern), times)
        assert (used == histogram).all()
        bound = -(-(histogram * np.arange(capacity + 1)).sum() // capacity)
        assert sum(t for _, t in plan) <= bound * 1.05 + 3
    assert packing.plan_sequences(np.zeros(9, int), 8) == []


def test_nnls_fits_a_histogram_made_of_patterns():
    patterns = packing.exact_patterns(12, np.arange(1, 13))
    assert (patterns.sum(1) == 12).all() and len({tuple(p) for p in patterns}) == len(patterns) == 19
    truth = np.zeros(len(patterns))
    truth[[2, 5, 11]] = [30, 50, 20]
    histogram = np.zeros(13)
    for p, x in zip(patterns, truth, strict=True):
        np.add.at(histogram, p[p > 0], x)
    x = packing.fit_counts(patterns, histogram, 3000)
    fitted = np.zeros(13)
    for p, v in zip(patterns, x, strict=True):
        np.add.at(fitted, p[p > 0], v)
    assert (x >= 0).all() and abs(fitted - histogram).max() < 0.5


def test_both_pre_token_patterns_equal_the_tokenizer():
    rng = random.Random(9)
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    tokenizer.encode_special_tokens = True
    encode = packing.Encoder(packing.default_tokenizer())
    narrow = [chr(c) for c in range(packing.NARROW)]
    wide = [*narrow, *"\u0180\u02b0\u0301\u0660\u2028\u3000\u4e2d\u1680\u200b\U0001f600\u2167\u00bd"]
    often = list(" \n\t'sdtm1aZ. \x1c\x85\xa0") + ["'re", "'ll", "'ve", "  "]
    for chars in (narrow, wide):
        for _ in range(1500):
            text = "".join(rng.choice(chars if rng.random() < 0.5 else often) for _ in range(25))
            assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), ascii(text)


def test_nulls_long_repeated_rows_and_odd_text(spark):
    rng = random.Random(2)
    odd = "".join(chr(rng.choice([9, 10, 13, 0x1C, 0x85, 0xA0, 0x2028, 0x3000, 39, 115, 32, 32, 65, 49, 0xE9, 0x4E2D, 0x1F600, 0x301])) for _ in range(3000))
    rows = [(1, None, 7), (None, "", 7), (2, "some words " * 9000, 7), (3, odd, 7), (3, odd, 7), (4, "<|endoftext|>", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length int").repartition(3)
    got = packing.pack(docs, keep_ids=True).collect()
    key = lambda r: (r[0] or -1, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(plain_pieces([r[:2] for r in rows]), key=key)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    check_seats(got, 1024)
    check_seats(packing.pack(docs, capacity=16).collect(), 16)
    assert packing.pack(docs.limit(0)).collect() == []


def test_added_tokens_get_their_ids_as_in_a_plain_call(spark, tmp_path):
    rng = random.Random(4)
    path = packing.default_tokenizer()
    more = json.loads(Path(path).read_text())
    rules = dict(single_word=False, lstrip=False, rstrip=False, normalized=False, special=False)
    more["added_tokens"] += [{"id": 60000 + k, "content": c, **rules} for k, c in enumerate(["<|a|>", "<|a|>b", "the"])]
    (tmp_path / "more.json").write_text(json.dumps(more))
    more["added_tokens"][-1] |= {"lstrip": True, "single_word": True}
    (tmp_path / "ruled.json").write_text(json.dumps(more))
    bits = ["<|endoftext|>", "<|a|>", "<|a|>b", "the", "<|", "|>", " ", "  ", "\n", "'s", "end of text", "x", "1", "\u4e2d", "<|endoftext|"]
    texts = ["end of text <|endoftext|> and on", *("".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(600))]
    for file in (path, str(tmp_path / "more.json"), str(tmp_path / "ruled.json")):
        tokenizer, encode = Tokenizer.from_file(file), packing.Encoder(file, added=True)
        for text in texts:
            assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), (file, text)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    plain = Tokenizer.from_file(path)
    want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert len(want[0]) == 8 and 50256 in want[0]
    want = [(k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in enumerate(want)]
    for got in (QUERIES["op10_packing"](spark, f"file://{tmp_path}"), corpus_pipeline.pack_sequences(spark, docs, "")):
        assert sorted((r.doc_id, r.length, r.ids_crc32) for r in got.collect()) == want
