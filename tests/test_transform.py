"""Model-shaped steps against plain Python, failure isolation, and partition independence."""

from __future__ import annotations

import re
import sys
from dataclasses import replace

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from postroom import fixed_values as fv
from postroom.catalog import QUERIES
from postroom.catalog.text import _NAMED
from postroom.catalog.transform import _INPUT, _config
from postroom.functions.embedding import PayloadTooLarge, embed_texts, embedding_udf
from postroom.functions.redaction import replace_entities
from postroom.functions.tokens import fit_to_tokens
from postroom.operators import changes
from postroom.plans import transform as plan
from postroom.plans.config import EngineConfig, Limits
from postroom.providers import HashEmbedder, PatternNer
from postroom.sources import given

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def results(spark, sf):
    rows = given.emails(spark, sf, *_INPUT)
    df = plan.transform(plan.worklist(rows, force=True), _config())
    texts = rows.select("id", "body_text", "subject")
    return df.join(texts, "id").collect()


def test_vectors_equal_python(results):
    def whole(t):
        """Halves, and halves of halves, until each has at most 512 tokens of four characters."""
        if len(t) <= 4 * 512:
            return HashEmbedder(64).embed([t])[0]
        parts = (t[: len(t) // 2], t[len(t) // 2 :])
        return np.average([whole(p) for p in parts], axis=0, weights=[len(p) for p in parts])

    def embed(texts):
        return [whole(t) for t in texts]

    chunked = 0
    for r in results:
        assert r.problem is None and r.vector_covers == 1
        if (r.subject or "").strip():
            assert np.allclose(r.subject_embedding, embed([r.subject.strip()])[0], atol=1e-6)
        if r.body_kind == "full":
            assert np.allclose(r.body_embedding, embed([r.body_text.strip()])[0], atol=1e-6)
        elif r.body_kind == "chunked":
            chunked += 1
            parts = embed([c.text for c in r.chunks])
            weights = [c.weight for c in r.chunks]
            assert np.allclose(r.body_pooled_embedding, np.average(parts, axis=0, weights=weights), atol=1e-6)
            assert all(np.allclose(c.embedding, p, atol=1e-6) for c, p in zip(r.chunks, parts))
    assert chunked > 10


def test_results_do_not_depend_on_partitions(spark, sf, results):
    rows = given.emails(spark, sf, *_INPUT).repartition(13)
    again = plan.transform(plan.worklist(rows, force=True), _config()).collect()
    first = {r.id: (r.privacy_tier, r.body_redacted, r.body_kind, r.chunks) for r in results}
    assert {r.id: (r.privacy_tier, r.body_redacted, r.body_kind, r.chunks) for r in again} == first


def test_entities_on_real_texts(spark, sf):
    """The registered query against the rules applied one by one in Python."""
    bodies = {r.id: r.body_text for r in given.mail_bodies(spark, sf).select("id", "body_text").collect()}
    find = PatternNer().open()
    for r in QUERIES["redact_entities"](spark, sf).collect():
        text = bodies[r.id] + _NAMED[r.id % 4]
        for pattern, token in fv.PII:
            text = re.sub(pattern, token, text)
        text = replace_entities(text, find(text))
        for pattern, token, ignore in (fv.LINK, *fv.SECRETS):
            text = re.sub(pattern, token, text, flags=re.I if ignore else 0)
        assert r.redacted == text


class ZeroForLongTexts:
    """Fails by content: long texts get zero vectors, others the wrong width or a good one."""

    dim = 64

    def open(self):
        def embed(texts):
            return [np.zeros(64) if len(t) > 900 else np.ones(3) if len(t) % 7 == 0 else np.ones(64) for t in texts]

        return embed


def test_a_bad_vector_fails_only_its_row(spark, sf):
    rows = given.emails(spark, sf, *_INPUT)
    df = plan.transform(plan.worklist(rows, force=True), _config().with_(embedder=ZeroForLongTexts()))
    problems = [r.problem for r in df.select("problem").collect()]
    assert None in problems
    assert any(p and "all zeros" in p for p in problems)
    assert any(p and "wrong dim 3 (expected 64)" in p for p in problems)


def test_texts_without_words_and_word_edges_like_the_sql(spark, sf):
    rows = given.emails(spark, sf, *_INPUT).limit(4).withColumns({"deleted_at": F.lit(None).cast("timestamp"), "subject": F.lit("---")})
    bodies = ["word " * 8000 + "token = abcdef " + "word " * 400 + ". | " * 7000, "|||", "id 123-45-6789\u00fc", "run erschlichereinbelichen\u00df"]
    numbered = rows.withColumn("id", F.row_number().over(Window.orderBy("id")) - 1)
    mails = numbered.withColumn("body_text", F.get(F.array(*map(F.lit, bodies)), F.col("id")))
    found = {r.id: r for r in plan.transform(mails, _config()).collect()}
    assert [found[i].problem for i in range(4)] == [None] * 4
    assert found[0].privacy_tier == 1  # what stands in the middle of a long body counts
    assert found[2].privacy_tier == 1 and found[3].body_redacted == "run [REDACTED]\u00df"


def test_too_large_requests_are_split():
    calls = []

    def embed(texts):
        calls.append(texts)
        if sum(map(len, texts)) > 300:
            raise PayloadTooLarge
        return [[float(len(t))] for t in texts]

    # Both halves of the long text count, by their lengths.
    assert [list(v) for v in embed_texts(embed, ["a" * 200, "b" * 401])] == [[200.0], [(200 * 200 + 201 * 201) / 401]]
    assert [len(c) for c in calls] == [2, 1, 1, 1, 1]
    with pytest.raises(PayloadTooLarge):
        embed_texts(lambda t: (_ for _ in ()).throw(PayloadTooLarge()), ["c" * 10])


def test_worklist_scopes(spark, sf):
    rows = given.emails(spark, sf, "id", "account_id", "body_text", "deleted_at", "transform_completed_at")

    def ids(**kw):
        return sorted(r.id for r in plan.worklist(rows, **kw).select("id").collect())

    todo = ids()
    assert todo and all(i % 17 == 0 and i % 13 for i in todo)
    assert ids(limit=3) == todo[:3]
    assert ids(limit=0) == []
    assert ids(email_id=14) == [14] and ids(email_id=13) == []
    assert ids(account_id=2) == [i for i in todo if i % 3 == 1]
    assert len(ids(force=True)) > len(todo)


def test_reset_and_replace(spark):
    emails = spark.createDataFrame(
        [(1, 1, "b", None, 3), (2, 1, None, None, 3), (3, 2, "b", "x", 3), (4, 2, "b", None, 3)],
        "id long, account_id int, body_text string, deleted_at string, privacy_tier int",
    )
    kept = {r.id: r.privacy_tier for r in changes.reset_emails(emails).collect()}
    assert kept == {1: None, 2: 3, 3: 3, 4: None}
    chunks = spark.createDataFrame([(1, 0), (2, 0), (4, 0), (4, 1)], "email_id long, n int")
    assert {r.email_id for r in changes.reset_chunks(chunks, emails, 2).collect()} == {1, 2}
    fresh = spark.createDataFrame([(4, 9)], "email_id long, n int")
    redone = spark.createDataFrame([(4,), (1,)], "email_id long")
    got = changes.replace_by_key(chunks, fresh, redone, "email_id").collect()
    assert sorted(map(tuple, got)) == [(2, 0), (4, 9)]


def test_every_query_runs_small(spark, sf):
    """Schema and rows of every registered query on the smallest tables."""
    empty = {"fulltext_multi_term", "orphan_rows"}
    for name, q in QUERIES.items():
        rows = q(spark, sf).limit(5).collect()
        assert rows or name in empty, name


def test_flagship_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())



class Fragile:
    """Fails for one text, and answers too few vectors for another."""

    def open(self):
        def embed(texts):
            if any("poison" in t for t in texts):
                raise RuntimeError("service error")
            return [[float(len(t)), 1.0] for t in texts if "short" not in t]

        return embed


def test_a_failing_mail_leaves_the_others_alone(spark):
    rows = [(1, ["good", "text"]), (2, ["poison"]), (3, None), (4, ["short"]), (5, []), (6, ["fine"])]
    df = spark.createDataFrame(rows, "id int, texts array<string>").coalesce(1)
    got = {r.id: r.e for r in df.select("id", embedding_udf(Fragile())(F.col("texts")).alias("e")).collect()}
    assert got[1].vectors == [[4.0, 1.0], [4.0, 1.0]] and got[6].vectors == [[4.0, 1.0]]
    assert [got[i].problem for i in (1, 3, 5, 6)] == [None] * 4 and got[3].vectors == got[5].vectors == []
    assert "RuntimeError" in got[2].problem and "0 vectors for 1 texts" in got[4].problem


def test_model_tokenizers_are_cut_to_the_cap(spark):
    df = spark.createDataFrame([(1, ["a b c d e f g h"])], "id int, texts array<string>")
    cut = embedding_udf(Fragile(), fit=lambda: lambda t: fit_to_tokens(t, str.split, 3))
    assert df.select(cut(F.col("texts")).alias("e")).first().e.vectors == [[float(len(fit_to_tokens("a b c d e f g h", str.split, 3))), 1.0]]


def test_long_texts_can_be_embedded_whole(spark):
    """By default the tail of an over-long sentence counts; the contract's ``prefix`` cuts it and says how far it got."""
    head, tail = "alpha beta " * 300, "omega " * 300
    row = (1, 1, head + tail, None, "a@b.c", "A", ["x"], "", False)
    mails = spark.createDataFrame([row], "id long, account_id int, body_text string, subject string, from_email string, from_name string, labels array<string>, snippet string, has_attachments boolean")
    limits = Limits(embed_max_tokens=200, chunk_target_tokens=150, embed_max_chars=900)
    embed = HashEmbedder(64).embed
    rows = [plan.transform(mails, EngineConfig(limits=replace(limits, long_texts=kind), dim=64)).first() for kind in ("parts", "prefix")]
    whole, cut = (r.body_pooled_embedding for r in rows)
    assert limits.long_texts == "parts" and rows[0].vector_covers == 1 and 0.1 < rows[1].vector_covers < 0.5
    (omega,), slot = embed(["omega"]), lambda v: v[int(np.argmax(embed(["omega"])[0]))]
    assert slot(omega) > 0 and slot(cut) == 0 and slot(whole) > 0.2
    short = mails.withColumn("body_text", F.lit("alpha beta"))
    same = [plan.transform(short, EngineConfig(limits=replace(limits, long_texts=k), dim=64)).first().body_embedding for k in ("parts", "prefix")]
    assert same[0] == same[1]
