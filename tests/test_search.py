"""Filters, ranking, fusion, vectors, labels, threads, feeds."""

from __future__ import annotations

import itertools
import random
import re
import sys
from datetime import datetime

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from postroom.functions import fulltext as ft
from postroom.functions import vectors
from postroom.operators import aggregates, changes, filters, labels, postings, search, threads
from postroom.plans.config import Limits, capabilities_document, missing_capabilities
from postroom.sources import given, mailbox, notices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EMAIL_ROWS = [
    (1, 1, "ann@x.example", "Ann", ["me@z.example", None], ["INBOX"], True, datetime(2024, 1, 1, 23, 59, 59, 999999), None, True),
    (2, 1, "bob@x.example", None, None, None, False, datetime(2024, 1, 2), None, True),
    (3, 2, "c_d@x.example", "100% Cat", ["q@z.example"], ["A", "B"], False, datetime(2024, 1, 3, 12), None, True),
    (4, 2, "ann@y.example", "Ann", [], [], False, datetime(2024, 1, 4), datetime(2024, 2, 1), True),
    (5, 2, "eve@y.example", "a\\b", [], [], False, datetime(2024, 1, 5), None, False),
]


@pytest.fixture(scope="module")
def mails(spark):
    df = spark.createDataFrame(
        EMAIL_ROWS,
        "id long, account_id int, from_email string, from_name string, to_emails array<string>, "
        "labels array<string>, has_attachments boolean, sent_at timestamp, deleted_at timestamp, done boolean",
    )
    return df.withColumn("transform_completed_at", F.when(F.col("done"), F.col("sent_at")))


def f(field, value):
    return {"field": field, "value": value, "operator": "anything"}


@pytest.mark.parametrize(
    "given_filters, account, ids",
    [
        ([], None, [1, 2, 3]),
        (None, 2, [3]),
        ([f("from_email", "ANN")], None, [1]),
        ([f("from_email", "bob"), f("from_name", "cat")], None, [2, 3]),
        ([f("from_email", "bob"), f("from_email", " ann ")], None, [1]),
        ([f("from_name", "100%")], None, [3]),
        ([f("from_email", "_d@")], None, [3]),
        ([f("from_email", "c\\_d")], None, [3]),
        ([f("from_email", "\\a\\n\\n")], None, [1]),
        ([f("to_email", "z.example")], None, [1, 3]),
        ([f("labels", "B")], None, [3]),
        ([f("labels", ["INBOX", "A"])], None, [1, 3]),
        ([f("has_attachments", "false")], None, [1]),
        ([f("has_attachments", False)], None, [2, 3]),
        ([f("has_attachments", None)], None, [1, 2, 3]),
        ([f("date_before", "2024-01-01")], None, [1]),
        ([f("date_before", "2024-01-01T23:59:59")], None, []),
        ([f("date_after", "2024-01-02 00:00:00")], None, [2, 3]),
        ([f("date_after", "2024-01-02T01:00:00+01:00")], None, [2, 3]),
        ([f("date_after", "2024-01-03T12:00:00Z")], None, [3]),
        ([f("account_id", "2")], None, [3]),
        ([f("nonsense", "x"), f("labels", []), f("from_email", "")], None, [1, 2, 3]),
    ],
)
def test_filters(mails, given_filters, account, ids):
    rows = mails.where(filters.compile_filters(given_filters, account)).select("id").collect()
    assert sorted(r[0] for r in rows) == ids


def test_filters_reach_the_scan(spark, tmp_path, mails):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
    mails.write.parquet(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    plan = stored.where(
        filters.compile_filters([f("date_after", "2024-01-02"), f("from_email", "a")], 1)
    ).select("id")._jdf.queryExecution().executedPlan().toString()
    for pushed in ("IsNull(deleted_at)", "IsNotNull(transform_completed_at)", "GreaterThanOrEqual(sent_at", "EqualTo(account_id,1)"):
        assert pushed in plan
    assert "labels" not in plan and "to_emails" not in plan


def brute_cover_density(words, terms):
    """Every span that holds all terms and has no smaller one inside."""
    spans = []
    for a, b in itertools.combinations_with_replacement(range(len(words)), 2):
        if set(terms) <= set(words[a : b + 1]):
            spans.append((a, b))
    minimal = [
        s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)
    ]
    return sum(
        0.1 / (1 + sum(w not in terms for w in words[a : b + 1])) for a, b in minimal
    )


@pytest.mark.parametrize("seed", range(6))
def test_cover_density_equals_brute_force(spark, seed):
    r = random.Random(seed)
    texts = [[r.choice("abcxyz") for _ in range(r.randint(0, 18))] for _ in range(40)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, v string")
    terms = ft.query_terms(["a", "A b", "c, a b"][seed % 3])
    text = F.col("v")
    got = {
        x[0]: x[1]
        for x in df.where(filters.matches_text(text, terms))
        .select("id", ft.cover_density(text, terms))
        .collect()
    }
    want = {i: brute_cover_density(t, terms) for i, t in enumerate(texts) if set(terms) <= set(t)}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_postings_equal_scan(spark, sf, tmp_path):
    cols = ("subject", "from_email", "from_name", "body_text")
    mail = given.emails(spark, sf, "id", *cols)
    # Two segments, and one that is merged from both.
    parts = [postings.write_segment(mail.where(F.pmod("id", F.lit(2)) == n), str(tmp_path / f"p{n}"), buckets=4 - n) for n in range(2)]
    merged = postings.merge_segments(spark, parts, str(tmp_path / "m"), "id")
    assert merged.rows == sum(s.rows for s in parts)
    text = ft.document_text(*[F.col(c) for c in cols])
    for q in ("the", "of the and", "zzzz the"):
        terms = ft.query_terms(q)
        scan = mail.where(filters.matches_text(text, terms)).select(
            "id", F.round(ft.cover_density(text, terms), 9)
        )
        for segments in (parts, [merged]):
            index = postings.search_segments(spark, segments, q).select("id", F.round("rank", 9))
            assert sorted(map(tuple, scan.collect())) == sorted(map(tuple, index.collect()))
    assert postings.search_segments(spark, parts, " ").count() == 0 == postings.search_segments(spark, [], "the").count()
    plan = postings.search_segments(spark, parts[:1], "the")
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = \d", shown)


def test_early_ending_gives_the_same_best(spark, tmp_path):
    """Skewed counts: a few mails hold the words often; ties at the end are all there."""
    rng = random.Random(8)
    rows = []
    for i in range(600):
        often = 40 - i if i < 40 else 1
        words = ["aa", "bb"] * often + [rng.choice(["aa", "bb", "cc", "x", "y", "z"]) for _ in range(20)]
        rng.shuffle(words) if i % 2 else None
        rows.append((i, " ".join(words)))
    mail = spark.createDataFrame(rows, "id long, body_text string").selectExpr("id", "body_text", "null as subject", "'' as from_email", "null as from_name")
    parts = [postings.write_segment(mail.where(F.pmod("id", F.lit(2)) == n), str(tmp_path / f"p{n}"), buckets=2) for n in range(2)]
    matching = mail.where("id % 3 <> 0")
    for query, k in (("aa", 5), ("aa bb", 5), ("bb aa", 12), ("cc aa bb", 4), ("aa none", 3), ("", 3), ("aa bb", 500)):
        best = postings.best_of_segments(spark, parts, query, k, matching)

        def top(hits, n=k):
            found = hits.join(matching.select("id"), "id").collect()
            return sorted(((-round(r.rank, 9), r.id) for r in found))[:n]

        assert top(best.hits) == top(postings.search_segments(spark, parts, query)), query
        if k <= 5 and query in ("aa", "aa bb"):
            assert 0 < best.read < 0.1


def test_query_terms_and_words_are_whole(column):
    assert ft.query_terms("Don't, DON'T é2") == ["don", "t", "é2"]
    v = F.col("v")
    assert column(["cat's", "concat", "CAT."], ft.contains_all(v, ["cat"])) == [True, False, True]
    assert column(["x"], filters.matches_text(v, [])) == [False]


def test_cosine_edges(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [-1.0, 0.0]), (6, [0.6, 0.8])],
        "id long, v array<float>",
    )
    d = vectors.cosine_distance(F.col("v"), [2.0, 0.0])
    rows = {r[0]: (r[1], r[2]) for r in df.select("id", d, vectors.similarity_score(d)).collect()}
    assert rows[1] == (0.0, 1.0) and rows[5] == (2.0, 0.0)
    assert rows[2] == (None, 0.0) and rows[4][0] is None
    assert np.isnan(rows[3][0])
    assert abs(rows[6][1] - 0.6) < 1e-6
    assert search.vector_top(df.withColumn("sent_at", F.lit(None)), [0.0, 0.0], 3).count() == 0


def test_nearest_per_query_equals_numpy(spark, sf, monkeypatch):
    e = given.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    rows = e.orderBy("id").collect()
    matrix = np.array([r["vector"] for r in rows], dtype=np.float64)
    queries = [(100 + i, matrix[i].tolist()) for i in (3, 50, 200)]
    monkeypatch.setattr(search, "_QUERY_VALUES_PER_PASS", 64 * 2)  # two passes
    got = search.nearest_per_query(e.repartition(7), queries, 5).collect()
    for q, v in queries:
        d = vectors.cosine_distances(matrix, np.array([v]))[:, 0]
        want = np.lexsort((np.arange(len(d)), d))[:5].tolist()
        assert [r["id"] for r in sorted(got, key=lambda r: r["position"]) if r["query_id"] == q] == want


def test_weighted_mean(spark):
    df = spark.createDataFrame(
        [([[1.0, 2.0], [3.0, 4.0]], [1.0, 3.0]), ([[1.0, 1.0]], [0.0]), ([[1.0]], [1.0, 2.0]), ([], [])],
        "v array<array<float>>, w array<double>",
    )
    got = [r[0] for r in df.select(vectors.weighted_mean(F.col("v"), F.col("w"))).collect()]
    assert got == [[2.5, 3.5], [0.0, 0.0], [], []]


def test_pooling_with_one_huge_group(spark):
    n, dim = 5000, 8
    rng = np.random.default_rng(1)
    m, w = rng.normal(size=(n, dim)), rng.uniform(0, 2, n)
    g = ["hot" if i % 10 else f"g{i % 7}" for i in range(n)]
    df = spark.createDataFrame([(a, b.tolist(), float(c)) for a, b, c in zip(g, m, w)], "g string, v array<double>, w double")
    got = aggregates.pooled_by_group(df.withColumn("v", F.col("v").cast("array<float>")).repartition(5), "g", "v", "w", dim)
    m32 = m.astype(np.float32).astype(float)
    for r in got.collect():
        mask = np.array([x == r["g"] for x in g])
        assert np.allclose(r["pooled"], (m32[mask] * w[mask, None]).sum(0) / w[mask].sum())


def test_fusion_rules(spark):
    def branch(method, rows):
        df = spark.createDataFrame(rows, "id long, score double")
        return df.select("id", F.lit(None).cast("timestamp").alias("sent_at"), F.lit(method).alias("method"), "score")

    a, b = branch("fulltext", [(1, 0.9), (2, 0.5)]), branch("vector", [(2, 0.8), (3, 0.9)])
    top = search.fuse([a, b], ["fulltext", "vector"], 10).collect()
    assert [(r["id"], round(r["final_score"], 6)) for r in top] == [(2, 0.65), (1, 0.45), (3, 0.45)]
    assert top[0]["scores"] == {"fulltext": 0.5, "vector": 0.8}
    weighted = search.fuse([a, b], ["fulltext", "vector"], 1, {"fulltext": 3.0}).first()
    assert weighted["id"] == 1
    rrf = search.fuse([a, b], ["fulltext", "vector"], 10, rule="rrf").collect()
    assert rrf[0]["id"] == 2 and abs(rrf[0]["final_score"] - (1 / 62 + 1 / 62)) < 1e-12


def test_structured_scores(spark):
    df = spark.range(40).select("id", F.timestamp_seconds("id").alias("sent_at"))
    rows = sorted(search.structured_top(df, 30).collect(), key=lambda r: -r["id"])
    assert [r["id"] for r in rows] == list(range(39, 9, -1))
    assert np.allclose([r["score"] for r in rows], [max(0.3, 1 - 0.03 * i) for i in range(30)])
    assert search.default_methods("", []) == ["structured"]
    assert search.default_methods("x", None) == ["fulltext", "vector"]
    assert (search.clamp_limit(0), search.clamp_limit(500), search.per_method_limit(10)) == (1, 100, 30)


def test_label_names(spark):
    mail = spark.createDataFrame(
        [(1, 1, ["a", "b", "a"]), (2, 1, []), (3, 2, ["a"]), (4, 1, None)], "id long, account_id int, labels array<string>"
    )
    dim = spark.createDataFrame([(1, "a", "Alpha"), (2, "b", "Beta")], "account_id int, label_id string, label_name string")
    want = {1: ["Alpha", "b", "Alpha"], 2: [], 3: ["a"], 4: None}
    named = labels.with_label_names(mail, dim)
    assert {r["id"]: r["labels"] for r in named.collect()} == want and named.columns == mail.columns


def replay(feed):
    """The feed applied one change at a time."""
    state = {}
    for key, op, seq, at in sorted(feed, key=lambda x: x[2]):
        if op == "add" and (key not in state or state[key] is not None):
            state[key] = None
        elif op == "delete" and key in state:
            state[key] = at
    return state


def test_change_state_equals_replay(spark):
    r = random.Random(3)
    feed = [(f"m{r.randint(0, 9) if r.random() < 0.6 else 0}", r.choice(["add", "delete"]), i, i * 10) for i in range(200)]
    feed += [("late", "delete", 300, 1), ("late2", "delete", 301, 1), ("late2", "add", 302, 2)]
    df = spark.createDataFrame(feed, "gmail_id string, op string, seq long, at long").repartition(6)
    net = changes.change_state(df).where("first_add is not null")
    got = {
        x["gmail_id"]: x["last_delete_at"] if x["last_op"] == "delete" else None for x in net.collect()
    }
    assert got == replay(feed)


def test_first_copies_of_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("gmail_id"),
        (F.lit(5000) - F.col("id")).alias("seq"), F.col("id").alias("x"),
    )
    got = {r["gmail_id"]: r["x"] for r in changes.first_copies(df).collect()}
    want = {}
    for i in range(3000):
        want[("hot" if i % 3 == 0 else f"k{i % 50}")] = i
    assert got == want


def test_summary_prefilters_before_the_shuffle(spark, sf):
    messages = given.conversation_messages(spark, sf)
    df = threads.thread_summaries(messages, ["thread_id"], ["turn"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_notices(spark):
    import base64
    import json

    def enc(x):
        return base64.b64encode(json.dumps(x).encode()).decode()

    raw = spark.createDataFrame(
        [
            (1, enc({"emailAddress": "a@x.example", "historyId": "12"})),
            (2, enc({"emailAddress": "a@x.example", "historyId": 13})),
            (3, enc({"emailAddress": "n@x.example", "historyId": "x"})),
            (4, None),
            (5, enc({"emailAddress": "b@x.example", "historyId": "7"})),
        ],
        "message_id long, data string",
    )
    accounts = spark.createDataFrame(
        [(1, "a@x.example", 5), (2, "b@x.example", None)], "id int, email_address string, last_history_id long"
    )
    routed = notices.route(notices.decode(raw), accounts)
    rows = {r["message_id"]: (r["status"], r["history_id"], r["start_history_id"]) for r in routed.collect()}
    assert rows == {
        1: ("ok", 12, 5), 2: ("ok", 13, 5), 3: ("ignored", None, None), 4: ("bad", None, None), 5: ("ok", 7, 7),
    }
    due = {r["account_id"]: (r["start_history_id"], r["notices"]) for r in notices.accounts_to_sync(routed).collect()}
    assert due == {1: (5, 2), 2: (7, 1)}


def test_notices_never_broadcast_the_copied_accounts(spark, sf):
    routed = notices.route(notices.decode(given.notifications(spark, sf)), given.accounts(spark, sf))
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


class FakeClient:
    """Two listing pages, two history pages, one message that cannot be read."""

    def list_messages(self, page_token=None):
        if page_token is None:
            return {"messages": [{"id": "m1"}, {"id": "bad"}], "nextPageToken": "2"}
        return {"messages": [{"id": "m2"}]}

    def get_message(self, key):
        if key == "bad":
            raise OSError("403")
        return {"id": key}

    def get_attachment(self, key, attachment):
        return {"data": "_-8="}

    def get_profile(self):
        return {"emailAddress": "a@x.example", "messagesTotal": 3, "historyId": "20"}

    def list_labels(self):
        return [{"id": "L1", "name": "One"}]

    def get_history(self, start, page_token=None):
        if page_token is None:
            return {
                "history": [{"id": "11", "messagesAdded": [{"message": {"id": "m1"}}]}],
                "nextPageToken": "2",
            }
        return {
            "history": [
                {"id": "12", "messagesDeleted": [{"message": {"id": "m1"}}, {"message": {}}]},
                {"id": "30", "messagesAdded": [{"message": {"id": "later"}}]},
            ]
        }


def test_mailbox_source(spark, tmp_path):
    spark.dataSource.register(mailbox.mailbox_source(FakeClient))
    ids = spark.read.format("mailbox").load()
    got = {r["gmail_id"]: r["problem"] for r in mailbox.fetch_messages(ids, FakeClient).collect()}
    assert got == {"m1": None, "bad": "OSError: 403", "m2": None}
    files = spark.createDataFrame([("m1", "a1")], "gmail_id string, gmail_attachment_id string")
    assert bytes(mailbox.fetch_attachments(files, FakeClient).first()["content"]) == b"\xff\xef"
    assert mailbox.profile(spark, FakeClient()).first()["history_id"] == 20
    assert mailbox.labels(spark, 1, FakeClient()).first()["label_name"] == "One"
    out = str(tmp_path / "out")
    q = (
        spark.readStream.format("mailbox").option("start", "10").load()
        .writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    changed = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert [c[:3] for c in changed] == [("m1", "add", 11), ("m1", "delete", 12)] and all(c[3] for c in changed)


def test_limits():
    doc = capabilities_document({"max_input_length": 512, "model_id": "e"}, {"data": [{"id": "m", "max_model_len": "4096"}, {"context_length": 8000}]}, True, False)
    assert doc["embedding"]["max_chars"] == 2048 and doc["vllm"]["max_model_len"] == 8000
    assert doc["classify_body_max_chars"] == 8000
    assert missing_capabilities(doc) == ["fasttext_langdetect.available"]
    lim = Limits.from_capabilities(doc)
    assert (lim.embed_max_tokens, lim.prompt_tokens, lim.context_chars) == (512, 7850, 28800)
    assert capabilities_document(None, None, True, True, 2000)["embedding"]["max_tokens"] == 500


def test_postings_are_grouped_in_the_row(spark):
    """One row per mail and word without an exchange (F17, F19); rows that share an id count as one mail."""
    kind = "id long, subject string, from_email string, from_name string, body_text string"
    mail = [(1, "B a", "x@y", None, "a b  A é1 É1"), (2, None, None, None, ""), (3, "gone", None, None, None)]
    more = [(4, None, None, None, "c a"), (4, "a", None, None, "d"), (None, None, None, None, "a"), (None, None, None, None, "b a")]

    def found(rows):
        return {(r.id, r.lexeme): list(r.positions) for r in postings.postings(spark.createDataFrame(rows, kind)).collect()}

    one = {(1, "b"): [0, 5], (1, "a"): [1, 4, 6], (1, "x"): [2], (1, "y"): [3], (1, "é1"): [7, 8]}
    assert found(mail) == one
    both = one | {(4, "c"): [0], (4, "a"): [0, 1], (4, "d"): [1], (None, "a"): [0, 1], (None, "b"): [0]}
    assert found(mail + more) == both
    assert postings.postings(spark.createDataFrame(mail + more, kind)).count() == len(both)


def test_lexeme_postings_shuffle_nothing(spark, sf):
    from postroom.catalog import QUERIES

    plan = QUERIES["lexeme_postings"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
