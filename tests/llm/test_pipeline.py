from __future__ import annotations

import corpus_pipeline
from postroom.llm import language, secrets, tokencounts
from postroom.llm.registry import prepare
from test_decontaminate import plain_leaks
from test_packing import check_seats, plain_pieces
from test_secrets import plain
from test_simhash import plain_components, plain_fingerprint


def test_stages_match_a_plain_version(spark, sf):
    prepare(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in docs.collect()]
    model = language.learn(docs.where(~language.held_out()))
    norms = language.norms(docs.where(~language.held_out()), model)

    def like(lang, score, per_letter, words):
        if lang not in norms:
            return lang != "und"
        mean, between, by_word = norms[lang]
        return per_letter >= mean - 16 * max(between, 0.04) - 5 * by_word / max(1, words) ** 0.5

    before = len(rows)
    rows = [r for r, a in zip(rows, model.fits([r[1] for r in rows]), strict=True) if like(*a)]
    assert len(rows) >= 0.98 * before
    fps = [(r[0], plain_fingerprint(r[1])) for r in rows]
    groups = plain_components(fps)
    rows = [r for r, (d, fp) in zip(rows, fps, strict=True) if groups[fp] == d]
    leaked = {d for d, _, _ in plain_leaks([r[:2] for r in rows], items)}
    rows = [r for r in rows if r[0] not in leaked]
    texts = []
    for r in rows:
        text, spans = r[1], plain(r[1])
        out, at = "", 0
        for s, _, e in spans:
            if s >= at:
                out += text[at:s] + "[SECRET]"
            at = max(at, e)
        texts.append((r[0], out + text[at:]))
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(plain_pieces(texts))
    check_seats(got, 1024)


def test_stages_keep_columns_and_survive_odd_rows(spark, sf, tmp_path):
    prepare(spark)
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(80)
    odd = [(None, "and the of this that from", "en"), (None, None, None), (9001, None, "en"), (9002, "", "fr"), (9003, "12 34", "de"), (9004, "the and of " * 9000, "en"), (9004, "the and of " * 9000, "en")]
    odd = spark.createDataFrame(odd, "doc_id bigint, text string, lang string")
    docs = base.unionByName(odd, allowMissingColumns=True).selectExpr("*", "'x' as spans", "'k' as _key", "'r' as _row", "7 as `a.b`", "1 as score", "2L as fp", "'b' as blob", "doc_id as component_id")
    folder = f"file://{tmp_path}"
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    start = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == start.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    assert {(r._key, r._row, r["a.b"]) for r in docs.collect()} == {("k", "r", 7)}
    kept = [r.doc_id for r in docs.collect()]
    assert kept.count(9004) == 1 and not {9001, 9002, 9003} & set(kept)
    assert docs.where("doc_id is not null").count() == docs.select("doc_id").where("doc_id is not null").distinct().count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= len(kept)


def test_stage_names_and_rules():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "secret_scan", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and len(secrets.BASE) == 3


def test_near_duplicates_keep_null_ids_and_texts_that_share_an_id(spark):
    prepare(spark)
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcde"}
    rows = [
        (None, texts["a"], "alone"),
        (None, texts["b"], "all null"), (None, texts["b"], "all null"),
        (None, texts["c"], "null of 3"), (3, texts["c"], "3"), (5, texts["c"], "copy of 3"),
        (5, texts["d"], "5"), (5, texts["e"], "other 5"), (5, texts["e"], "other 5"), (7, texts["e"], "copy of 5"),
    ]
    want = ["3", "5", "all null", "alone", "other 5"]
    for n in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(n)
        got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
        assert sorted(r.source for r in got) == want
    # Rows that differ beside the text only: the same one at any order.
    one = [(9, texts["a"], None, "x"), (9, texts["a"], "x", None), (None, texts["a"], "x", "x"), (9, texts["a"], "y", "x")]
    ddl = "doc_id bigint, text string, lang string, source string"
    picks = {tuple(corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(o, ddl).coalesce(1), "").first()) for o in (one, one[::-1])}
    assert len(picks) == 1 and picks.pop()[0] == 9


def test_leaks_drop_by_text_where_ids_are_null_or_shared(spark, tmp_path):
    prepare(spark)
    item = " ".join(f"item{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    rows = [(None, f"some {item} more", "leak"), (None, "a clean text", "a"), (4, f"held {item}", "leak"), (4, "other clean text", "b"), (5, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert sorted(r.source for r in corpus_pipeline.drop_leaks(spark, docs, f"file://{tmp_path}").collect()) == ["a", "b", "c"]


def test_texts_of_no_learned_language_go_and_short_clean_ones_stay(spark, sf):
    prepare(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    short = [r.text.split(".")[0][:40] for r in docs.where("lang is not null").limit(20).collect()]
    noise = ["xkcd zzptq wrtgh bbvnm qwrtp sdfgh kljhg mnbvc " * 3, "Быстрая коричневая лиса прыгает через ленивую собаку и убегает в лес", "ждёт нас " * 40]
    rows = [(10_000 + i, t, None) for i, t in enumerate(short)] + [(20_000 + i, t, None) for i, t in enumerate(noise)]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, both, sf).collect()}
    assert {i for i, _, _ in rows if i in kept} == {10_000 + i for i in range(len(short))}
    assert docs.count() - len({i for i in kept if i < 10_000}) <= 4


def test_short_items_drop_only_texts_of_just_their_words(spark, tmp_path):
    prepare(spark)
    spark.createDataFrame([(1, "who wrote hamlet")], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "We asked who wrote Hamlet and nobody knew it."), (3, "")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, f"file://{tmp_path}").collect()) == [2, 3]


def test_norms_and_counts_come_from_all_training_texts(spark):
    prepare(spark)
    rows = [(i, "en", "the same words again and again") for i in range(3500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    assert language.training_rows(docs).count() == 3500 and language.training_rows(docs, 50).count() == 50
    once = language.learn(docs.limit(1))
    again = language.learn(docs)  # more texts weigh more against the smoothing
    piece = max(once.pieces, key=lambda p: once.pieces[p])
    most = 3500 * sum(r.n for r in language.count_pieces(docs.limit(1), language.default_vocabulary()).where(f"piece = '{piece}'").collect())
    total = 3500 * sum(r.n for r in language.count_pieces(docs.limit(1), language.default_vocabulary()).collect())
    smoothed = total + language.SMOOTHING * len(tokencounts.unigram(language.default_vocabulary()).scores)
    assert abs(again.pieces[piece][0] - most / smoothed) < 1e-4  # 3,000 texts give 0.006 less
    mean, between, by_word = language.norms(docs, again)["en"]
    assert mean < 0 and between == 0 and by_word < 1e-6
