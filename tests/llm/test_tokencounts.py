from __future__ import annotations

import math
import time
from collections import Counter
from functools import lru_cache

import numpy as np

from postroom.llm import tokencounts
from postroom.llm.registry import QUERIES


def plain_count(counter, word: str) -> int:
    text = "▁" + word

    @lru_cache(None)
    def best(i: int) -> tuple[float, int]:
        if i == 0:
            return 0.0, 0
        found = []
        for j in range(i):
            score = counter.scores.get(text[j:i])
            if score is not None:
                s, n = best(j)
                found.append((s + score, -(n + 1)))
            elif j == i - 1:
                s, n = best(j)
                size = len(text[j].encode())
                found.append((s + size * counter.byte_score, -(n + size)))
        s, n = max(found)
        return s, -n

    return best(len(text))[1]


def test_counts_match_brute_force(spark, sf):
    counter = tokencounts.learn(spark.read.parquet(f"{sf}/documents.parquet"))
    # Every round fits the words at least as well as the one before.
    assert len(counter.per_letter) == 4 and counter.per_letter == sorted(counter.per_letter)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()}
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in QUERIES["op9_tokencounts"](spark, sf).collect()}
    known: dict[str, int] = {}
    for doc_id, text in texts.items():
        for w in text.split():
            if w not in known:
                known[w] = plain_count(counter, w)
        assert got[doc_id] == (len(text.split()), sum(known[w] for w in text.split()))


def test_prefixes_are_shared_in_any_order_and_memory_may_be_emptied(monkeypatch):
    counter = tokencounts.unigram(tokencounts.default_vocabulary())
    words = ["a", "ab", "abacus", "abacuses", "b", "zebra", "zeb", "é", "日本語", "日本", "\U0001f600\U0001f600x", "a" * 300]
    want = [plain_count(counter, w) for w in words]
    assert counter.counts([[w] for w in words]) == want
    assert counter.counts([words, [], words[::-1]]) == [sum(want), 0, sum(want)]
    monkeypatch.setattr(tokencounts, "REMEMBERED", 2)
    assert counter.counts([["new", *words]])[0] == plain_count(counter, "new") + sum(want)


def test_equal_scores_take_fewer_tokens():
    counter = tokencounts.UnigramCounter({"▁": -1.0, "a": -1.0, "aa": -2.0, "▁aa": -3.0}, -9.0, 3)
    assert counter.counts([["aa"]]) == [1]


def test_nulls_empty_long_and_clashing_names(spark):
    rows = [(1, None, "q"), (2, " \n\t", "q"), (None, "some words", "q"), (3, "word " * 300_000, "q"), (3, "word " * 300_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = [(r.doc_id, r.n_pretokens, r.n_tokens) for r in tokencounts.count_tokens(docs).collect()]
    assert got[0] == (1, 0, 0) and got[1] == (2, 0, 0) and got[2][1] == 2
    assert got[3] == got[4] == (3, 300_000, 300_000 * (got[3][2] // 300_000))
    assert tokencounts.count_tokens(docs.limit(0)).collect() == []


def test_expected_counts_are_those_of_all_segmentations():
    counter = tokencounts.UnigramCounter({"▁": -1.5, "a": -1.0, "b": -2.0, "ab": -2.5, "▁a": -2.2, "ba": -1.7}, -3.0, 2)

    def cuts(text):
        if not text:
            yield []
        for n in (1, 2):
            if len(text) >= n and (text[:n] in counter.scores or n == 1):
                yield from ([text[:n], *rest] for rest in cuts(text[n:]))

    for word in ("a", "abab", "bab", "aéb"):
        weigh = lambda c: math.exp(sum(counter.scores.get(p, len(p.encode()) * -3.0) for p in c))
        ways = [(c, weigh(c)) for c in cuts("▁" + word)]
        total = sum(w for _, w in ways)
        got, log = tokencounts.expected(counter, word)
        assert abs(log - math.log(total)) < 1e-9
        for piece in got:
            assert abs(got[piece] - sum(w * c.count(piece) for c, w in ways) / total) < 1e-9


def plain_expected(counter, text):
    """(probability, pieces) of every segmentation, one after another."""
    def cuts(rest):
        if not rest:
            yield 1.0, []
        for k in range(1, min(len(rest), counter.longest) + 1):
            score = counter.scores.get(rest[:k])
            if score is None and k == 1:
                score = counter.byte_score * len(rest[0].encode())
            if score is not None:
                yield from ((math.exp(score) * p, [rest[:k], *own]) for p, own in cuts(rest[k:]))

    every = list(cuts(text))
    total = sum(p for p, _ in every)
    found = Counter()
    for p, own in every:
        for piece in own:
            found[piece] += p / total
    return found, math.log(total)


def test_expected_pieces_match_all_segmentations():
    counter = tokencounts.unigram(tokencounts.default_vocabulary())
    words = {"abacus": 3, "zebra": 1, "the": 7, "日本": 2, "\U0001f600x": 1}
    sums, want, log = np.zeros(len(counter.scores) + 1), Counter(), 0.0
    got = tokencounts.expect(counter, words, sums)
    for word, n in words.items():
        found, own = plain_expected(counter, "▁" + word)
        log += n * own
        for piece, share in found.items():
            want[piece] += n * share
    assert abs(got - log) < 1e-9
    assert all(abs(sums[i] - want[p]) < 1e-9 for p, i in counter.places.items())
    assert np.isfinite(tokencounts.expect(counter, {"\U0001f600" * 400: 1, "a" * 3000: 1}, sums))


def test_scores_are_learned_from_every_word_of_every_text(spark, monkeypatch):
    monkeypatch.setattr(tokencounts, "COUNTED", 5)
    rows = [(None if i % 2 else i, f"word{i} " + "x" * 50) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    counted = {r.word: r.n for r in tokencounts.count_words(docs).collect()}
    assert counted == {**{f"word{i}": 1 for i in range(6000)}, "x" * 50: 6000}
    alone = spark.createDataFrame([(None, "zebra " * 9)], "doc_id bigint, text string")
    assert len(tokencounts.learn(alone).per_letter) == 4


def test_plain_sums_equal_those_of_logarithms_and_are_faster(monkeypatch):
    counter = tokencounts.unigram(tokencounts.default_vocabulary())
    words = {p.strip("▁") * k + e: k for p in list(counter.scores)[::7] for k, e in ((1, ""), (2, "ing"), (1, "é日\U0001f600"))}
    words |= {"\U0001f600" * 30: 2, "a" * 300: 1, "x\0": 1}
    by_logs = np.zeros(len(counter.scores) + 1)
    with monkeypatch.context() as patch:
        patch.setattr(tokencounts, "PLAIN_LETTERS", 0)
        began = time.process_time()
        want = tokencounts.expect(counter, words, by_logs)
        slow = time.process_time() - began
    for most in (tokencounts.MOST_STEPS, 0):
        monkeypatch.setattr(tokencounts, "MOST_STEPS", most)
        counter.__dict__.pop("trie", None)
        sums = np.zeros_like(by_logs)
        counter.trie  # noqa: B018
        began = time.process_time()
        assert math.isclose(tokencounts.expect(counter, words, sums), want, rel_tol=1e-9)
        assert most == 0 or time.process_time() - began < slow / 2
        assert np.allclose(sums, by_logs, rtol=1e-8, atol=1e-12)


def test_words_counted_together_have_the_counts_of_the_walk(monkeypatch):
    monkeypatch.setattr(tokencounts, "GROUPED_LEAST", 1)
    counter = tokencounts.unigram(tokencounts.default_vocabulary())
    words = {p.strip("▁") * k + e for p in list(counter.scores)[::50] for k, e in ((1, ""), (2, "ing"), (1, "é日\U0001f600"))} - {""}
    words |= {"x\0", "\U0001f600" * 30, "a" * 300}
    counter.learn_counts(words)
    assert counter.known == {w: plain_count(counter, w) for w in words}
    tied = tokencounts.UnigramCounter({"▁": -1.0, "a": -1.0, "aa": -2.0, "▁aa": -3.0}, -9.0, 3)
    assert tied.counts([["aa", "a"]]) == [3]
