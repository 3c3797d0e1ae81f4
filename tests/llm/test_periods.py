from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from postroom.llm import periods


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """All runs by trying every period at every place."""
    n, spans = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                spans.setdefault((i, j + q), q)
            i = max(i + 1, j + 1) if j > i else i + 1
    return sorted((a, b - a, q) for (a, b), q in spans.items())


def plain_row(doc_id, text):
    """The query's row by the definition alone."""
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    return (doc_id, len(runs), *head, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def found(texts: list[str]) -> list[list[tuple]]:
    return [[tuple(map(int, r)) for r in rows] for rows in periods.text_runs([periods.words_of(t) for t in texts])]


def test_runs_of_known_texts():
    assert found(["a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "", "x"]) == [
        [], [(0, 6, 1)], [(0, 8, 2)], [], [], []]
    # A root that is itself periodic but for one word: blocks occur in progressions.
    root = "a a a a a a a a a b"
    assert found([" ".join([root] * 5)]) == [plain_runs(" ".join([root] * 5).split())]


def test_runs_against_all_periods():
    rng = random.Random(5)
    texts = []
    for _ in range(400):
        words = [rng.choice("ab" if rng.random() < 0.6 else "abcdef") for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            root = [rng.choice("abc") for _ in range(rng.randrange(1, 24))]
            if rng.random() < 0.4:
                root = ["a"] * rng.randrange(1, 20) + ["b"]
            words += (root * rng.randrange(3, 8))[: rng.randrange(1, 150)] + [rng.choice("abcd")] * rng.randrange(0, 3)
        texts.append(" ".join(words))
    for text, rows in zip(texts, found(texts), strict=True):
        assert rows == plain_runs(text.split()), text


def test_one_long_word_run_is_cheap():
    rows = found(["w " * 300_000 + "end"])
    assert rows == [[(0, 300_000, 1)]]


def test_successor_against_a_scan():
    rng = np.random.default_rng(3)
    values = rng.permutation(97)
    tree = periods.WaveletTree(values)
    low, high = rng.integers(0, 97, 500), rng.integers(0, 98, 500)
    low, high = np.minimum(low, high), np.maximum(low, high)
    least = rng.integers(0, 130, 500)
    want = [min((v for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(low, high, least, strict=True)]
    assert tree.successor(low, high, least).tolist() == want


def test_query_against_the_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in periods.op13_periods(spark, sf).collect()}
    assert len(got) == len(docs)
    damaged = sum(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in docs)
    assert sum(r[1] > 0 for r in got.values()) >= damaged // 3
    for r in docs:
        assert got[r.doc_id] == plain_row(r.doc_id, r.text)


def test_nulls_repeats_and_other_columns(spark, tmp_path):
    rows = [(1, "a a a a a a a", 0), (1, "a a a a a a a", 1), (None, "b b b b b b", 2), (3, None, 3), (4, "", 4), (5, " \t\n", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted((r.doc_id or 0, len(r.runs), bytes(r.collapsed)) for r in periods.detect_runs(docs).collect())
    assert got == [(0, 1, b"b"), (1, 1, b"a"), (1, 1, b"a"), (3, 0, b""), (4, 0, b""), (5, 0, b"")]
    assert periods.detect_runs(docs.where("false")).count() == 0
