from __future__ import annotations

import math
from collections import Counter

from postroom.llm import language
from postroom.llm.registry import QUERIES


def every_cut(text: str, longest: int):
    if not text:
        yield []
    for n in range(1, min(longest, len(text)) + 1):
        for rest in every_cut(text[n:], longest):
            yield [text[:n], *rest]


def test_forward_pass_sums_all_segmentations():
    pieces = {"▁": (0.1, 0.2), "▁a": (0.2, 0.05), "ab": (0.1, 0.3), "a": (0.2, 0.1), "b": (0.15, 0.2), "▁ab": (0.02, 0.01), "bb": (0.03, 0.04)}
    model = language.LanguageModel(["x", "y"], pieces, longest=3, floor=1e-3)
    for word in ("a", "ab", "abba", "abbab", "cab", "ccc"):
        for k in range(2):
            total = 0.0
            for cut in every_cut("▁" + word, 3):
                shares = [pieces[p][k] if p in pieces else (1e-3 if len(p) == 1 else 0.0) for p in cut]
                total += math.prod(shares)
            assert math.isclose(model.word(word)[k], math.log(total), rel_tol=1e-9)
    long = model.word("ab" * 3000)
    assert all(math.isfinite(v) for v in long) and long[1] > long[0]
    assert math.isclose(long[0] * 2, model.word("ab" * 6000)[0], rel_tol=1e-2)


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_language"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_nulls_empty_tables_and_clashing_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.learn(docs, train_docs=50)
    rows = [(1, None, "q"), (2, "", "q"), (3, "12 ½ __ !?", "q"), (None, "the of and that", "q"), (1, "la " * 300_000, "q")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    got = sorted(((r.doc_id or 0, r.lang_pred, r.score) for r in language.identify(odd, model).collect()))
    assert [(g[0], g[1]) for g in got][0] == (0, "en") and {g[1:] for g in got if g[1] == "und"} == {("und", 0.0)}
    assert sum(g[1] == "und" for g in got) == 3
    assert language.identify(odd.limit(0), model).collect() == []
    empty = language.learn(docs.limit(0))
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.learn(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).languages == []


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a")], "doc_id bigint, text string, lang string")
    got = language.identify(docs, language.learn(docs)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("a", 0.5)}


def test_a_word_that_recurs_is_cut_once_and_counts_are_those_of_whole_texts():
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=language.default_vocabulary())
    texts = [("de", "Über die Brücke, über die Brücken. ﷺ"), ("en", "over the bridge " * 50), ("en", None), ("fr", " ")] * 3
    cut: list[str] = []

    def encode(words):
        cut.extend(words)
        return pieces.encode(words, out_type=str)

    want = Counter((lang, p) for lang, t in texts for p in pieces.encode(" ".join(language.words_of(t or "")), out_type=str))
    assert language.pieces_of(texts, encode) == want
    assert sorted(cut) == sorted(["über", "die", "brücke", "brücken", "ﷺ", "over", "the", "bridge"])
    assert language.pieces_of(texts, encode, most=2) == want
