from __future__ import annotations

import random
import re

import xxhash

from postroom.llm import simhash
from postroom.llm.graph import components
from postroom.llm.registry import QUERIES


def plain_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items: list[tuple[int | None, int]], radius: int = 3) -> dict:
    fps = sorted({fp for _, fp in items})
    root = {fp: fp for fp in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least: dict = {}
    for d, fp in items:
        if d is not None:
            least[find(fp)] = min(d, least.get(find(fp), d))
    return {fp: least.get(find(fp)) for fp in fps}


def test_fingerprints_and_components_match_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [(d, plain_fingerprint(t)) for d, t in docs]
    want = plain_components(items)
    got = QUERIES["op4_simhash"](spark, sf).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{fp:016x}", want[fp]) for d, fp in items)


def test_links_at_every_distance_and_none_beyond(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for fp in list(fps):
        for n in (1, 2, 3, 3, 3, 4, 5):
            other = fp
            for b in rng.sample(range(64) if rng.random() < 0.6 else range(32), n):
                other ^= 1 << b
            fps.add(other)
    low_only = rng.getrandbits(64)
    fps |= {low_only, low_only ^ 0b111, (1 << 63) | (1 << 31), 0, (1 << 64) - 1}
    items = sorted(fps)
    signed = [(simhash._signed(x),) for x in items]
    df = spark.createDataFrame(signed, "fp bigint")
    edges = simhash.close_edges(df).union(simhash.odd_edges(df))
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in edges.collect())
    labels = {r.node & (2**64 - 1): r.label for r in components(edges).collect()}
    want = plain_components([(i, x) for i, x in enumerate(items)])
    groups_got = {x: labels.get(x, simhash._signed(x)) for x in items}
    for a in items:
        for b in items:
            assert (groups_got[a] == groups_got[b]) == (want[a] == want[b])


def test_edges_grow_with_a_dense_group_not_with_its_square(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    group = {base}
    while len(group) < 1500:
        x = base
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        group.add(x)
    df = spark.createDataFrame([(simhash._signed(x),) for x in group], "fp bigint")
    assert simhash.close_edges(df).count() <= 65 * len(group)
    labels = components(simhash.close_edges(df).union(simhash.odd_edges(df))).collect()
    want = plain_components([(i, x) for i, x in enumerate(sorted(group))])
    assert len({r.label for r in labels}) == len(set(want.values())) - (len(group) - len(labels))


def test_nulls_empty_long_and_repeated_rows(spark):
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (None, "One two three four", "x"), (4, "one TWO three\nfour", "x"),
        (4, "one TWO three\nfour", "x"), (5, "word " * 200_000, "x"), (6, "two words", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, 1, 1), (False, 2, 1), (False, 3, 1), (False, 4, 4), (False, 4, 4), (False, 5, 5), (False, 6, 6), (True, 0, 4)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    assert simhash.near_duplicates(docs.where("doc_id is null")).first().component_id is None
