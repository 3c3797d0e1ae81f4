from __future__ import annotations

import math
import random

import numpy as np
import pytest

from postroom.llm import topk


def plain(rows, k=10, every=100):
    fit = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fit.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    asked: dict = {}
    for i, v in fit:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v, key=lambda v: np.array(v, np.int64).tobytes())
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fit if i != q)  # noqa: B905
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_matches_brute_force_in_many_small_ranges_and_slabs(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert rows_of(topk.top_k(table, every=7, range_rows=40, slab_rows=5)) == plain(rows, every=7)


def test_nulls_ties_repeats_and_clashing_names(spark):
    rng = random.Random(4)
    same = [0.5, -0.25, 0.125]
    rows = [(i, same) for i in range(0, 400, 25)] + [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(1, 300, 9)]
    rows += [(None, same), (600, None), (700, [None, 1.0, 2.0]), (800, [float("nan"), 1.0, 2.0]), (900, [float("inf"), 0.0, 0.0])]
    rows += [(100, same), (100, [0.1, 0.2, 0.3]), (1000, [0.5]), (1100, []), (-100, [-1.0, -1.0, -1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, score int, range string")
    assert rows_of(topk.top_k(df, range_rows=16, slab_rows=2)) == plain(rows)
    assert topk.top_k(df.limit(0)).collect() == []
    few = df.where("vec_id in (0, 25)")
    assert rows_of(topk.top_k(few)) == [(0, 1, 25, 512 * 512 + 256 * 256 + 128 * 128)]


def test_bounds_prune_blocks_without_changing_the_answer():
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (40, 16))
    vectors = np.repeat(centres, 100, 0) + rng.integers(-20, 20, (4000, 16))
    index = topk.Blocks(np.arange(4000), vectors, 100)
    queries, ids = vectors[::400], np.arange(0, 4000, 400)
    scores, found = index.search(ids, queries, np.full(10, topk._LEAST), 10)
    for q in range(10):
        full = sorted((-int(s), i) for i, s in enumerate(vectors @ queries[q]) if i != ids[q])[:10]
        assert [(-int(s), int(i)) for s, i in zip(scores[q], found[q], strict=True)] == full
    assert index.scored < 0.3 * 10 * 4000


def test_queries_reach_only_ranges_that_can_win(spark):
    """Clustered vectors end to end: most ranges get no query, most pairs are never scored."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (24, 16))
    own = np.repeat(centres, 60, 0) + rng.normal(0, 0.02, (24 * 60, 16))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found, cost = topk.search(df, every=20, range_rows=60, block=20)
    assert rows_of(found) == plain(rows, every=20)
    assert cost.queries == 72 and cost.ranges >= 12
    assert cost.share < 0.5 and cost.shipped < 0.5 * cost.queries * cost.ranges


def test_scores_and_components_beyond_64_bits_are_errors(spark):
    for rows in ([(100, [1e16, 1.0]), (1, [1e16, 2.0]), (2, [1.0, 1.0])], [(100, [3e38]), (1, [1.0])], [(100, [4e9, 4e9]), (1, [4e9, 4e9])]):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        with pytest.raises(Exception, match="does not fit 64 bits"):
            topk.top_k(df).collect()
    # Large scores that fit are exact.
    rows = [(100, [2e6, 1.0]), (1, [1e6, 2.0]), (2, [1e6, 3.0]), (3, [-1e6, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert [r[3] for r in rows_of(topk.top_k(df))] == [2048000000 * 1024000000 + 1024 * c for c in (3072, 2048)] + [-2048000000 * 1024000000]
