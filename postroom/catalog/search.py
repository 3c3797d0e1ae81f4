"""Search, count and aggregate over the mail stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from postroom.catalog.registry import BODY_SQL, EMAILS_SQL, ISO_SQL, SENDER_SQL, query
from postroom.functions.formatting import result_record
from postroom.operators import aggregates, search
from postroom.operators.filters import compile_filters
from postroom.sources import given

_WITH = f"with {EMAILS_SQL}"
_OUTPUT = (
    "id", "gmail_id", "gmail_thread_id", "subject", "from_email", "from_name", "to_emails",
    "labels", "snippet_redacted", "body_redacted", "privacy_tier", "has_attachments", "sent_at",
)
_RANKING = ("deleted_at", "transform_completed_at", "sent_at", "account_id")


def _matching(spark, sf, filters=None, *columns, account_id=None):
    need = dict.fromkeys((*_RANKING, "id", *columns))
    rows = given.emails(spark, sf, *need).where(compile_filters(filters, account_id))
    return rows


def _flat(result, *more):
    """Result records with scalar columns only, for row-by-row comparison."""
    m = F.col("metadata")
    return result.select(
        "id", "source", "source_class", "title", "snippet", "timestamp", "provenance",
        m["thread_id"].alias("thread_id"), m["from"].alias("sender"),
        F.array_join(m["to"], ",").alias("recipients"),
        F.array_join(m["labels"], ",").alias("label_list"),
        m["has_attachments"].alias("has_attachments"), m["gmail_url"].alias("gmail_url"),
        m["body"].alias("body"), *more,
    )


_FLAT_SQL = f"""
  gmail_id as id, 'email' as source, 'personal' as source_class,
  coalesce(nullif(subject, ''), 'No subject') as title,
  coalesce(snippet_redacted, '') as snippet, {ISO_SQL} as timestamp,
  'email from ' || {SENDER_SQL} || ' on ' || strftime(sent_at, '%Y-%m-%d') as provenance,
  gmail_thread_id as thread_id, {SENDER_SQL} as sender, to_joined as recipients,
  array_to_string(labels, ',') as label_list, has_attachments,
  'https://mail.google.com/mail/u/0/#inbox/' || gmail_id as gmail_url, {BODY_SQL} as body"""

_DATES = [
    {"field": "date_after", "operator": "gte", "value": "2024-01-01"},
    {"field": "date_before", "operator": "lte", "value": "2024-01-02"},
]


@query(
    "structured_topk",
    f"""{_WITH}
select {_FLAT_SQL}, round(cast(greatest(0.3, 1.0 - 0.03 * (rn - 1)) as double), 6) as score
from (select *, row_number() over (order by sent_at desc nulls last, id) as rn from searchable
      where sent_at >= timestamp '2024-01-01' and sent_at <= timestamp '2024-01-02 23:59:59.999999')
where rn <= 30""",
)
def structured_topk(spark, sf):
    top = search.structured_top(_matching(spark, sf, _DATES), 30)
    rows = search.fetch(given.emails(spark, sf, *_OUTPUT), top)
    return _flat(result_record(rows, F.round("score", 6).alias("score")), "score")


@query(
    "top_recent",
    f"""{_WITH}
select id, gmail_id, {ISO_SQL} as sent from searchable
order by sent_at desc nulls last, id limit 100""",
)
def top_recent(spark, sf):
    rows = _matching(spark, sf, None, "gmail_id")
    newest = rows.orderBy(F.desc_nulls_last("sent_at"), "id").limit(search.clamp_limit(500))
    from postroom.functions.formatting import iso_timestamp

    return newest.select("id", "gmail_id", iso_timestamp(F.col("sent_at")).alias("sent"))


@query(
    "filter_from_or_name",
    f"""{_WITH}
select id, from_email, from_name from searchable
where from_email ilike '%src1@FR%' or from_name ilike '%sender src_2%'""",
)
def filter_from_or_name(spark, sf):
    filters = [
        {"field": "from_email", "value": " nobody "},
        {"field": "from_email", "value": " src1@FR "},
        {"field": "from_name", "value": "sender src_2"},
        {"field": "unknown_field", "value": "ignored"},
    ]
    rows = _matching(spark, sf, filters, "from_email", "from_name")
    return rows.select("id", "from_email", "from_name")


@query(
    "filter_labels_overlap",
    f"""{_WITH}
select id, array_to_string(labels, ',') as label_list from searchable
where list_has_any(labels, ['de', 'src3', 'L7'])""",
)
def filter_labels_overlap(spark, sf):
    rows = _matching(spark, sf, [{"field": "labels", "value": ["de", "src3", "L7"]}], "labels")
    return rows.select("id", F.array_join("labels", ",").alias("label_list"))


@query(
    "filter_to_contains",
    f"{_WITH} select id, to_joined as recipients from searchable where to_joined ilike '%SRC1%list%'",
)
def filter_to_contains(spark, sf):
    rows = _matching(spark, sf, [{"field": "to_email", "value": "SRC1%list"}], "to_emails")
    return rows.select("id", F.array_join("to_emails", ",").alias("recipients"))


@query(
    "filter_dates_attach_account",
    f"""{_WITH}
select id, account_id, has_attachments from searchable
where sent_at >= timestamp '2024-01-01 06:30:00' and sent_at <= timestamp '2024-01-03 23:59:59.999999'
  and has_attachments and account_id = 2""",
)
def filter_dates_attach_account(spark, sf):
    filters = [
        {"field": "date_after", "value": "2024-01-01T08:30:00+02:00"},
        {"field": "date_before", "value": "2024-01-03"},
        {"field": "has_attachments", "value": "false"},
        {"field": "account_id", "value": "2"},
        {"field": "from_email", "value": ""},
    ]
    rows = _matching(spark, sf, filters, "has_attachments")
    return rows.select("id", "account_id", "has_attachments")


@query(
    "count_filtered",
    f"""{_WITH}
select count(*) as "count" from searchable
where account_id = 1 and sent_at >= timestamp '2024-01-01' and from_email ilike '%src%'""",
)
def count_filtered(spark, sf):
    filters = [
        {"field": "date_after", "value": "2024-01-01"},
        {"field": "from_email", "value": "src"},
    ]
    return aggregates.total(_matching(spark, sf, filters, "from_email", account_id=1))


def _top_groups_sql(c: str) -> str:
    return f"""{_WITH}
select {c} as group_value, count(*) as "count" from searchable
where {c} is not null and {c} <> '' and has_attachments group by {c}
order by "count" desc, group_value limit 10"""


def _top_groups(spark, sf, group_by):
    filters = [{"field": "has_attachments", "value": True}]
    rows = _matching(spark, sf, filters, "has_attachments", "from_email", "from_name")
    return aggregates.top_groups(rows, group_by, 10)


@query("aggregate_from_email_topn", _top_groups_sql("from_email"))
def aggregate_from_email_topn(spark, sf):
    return _top_groups(spark, sf, "from_email")


@query("aggregate_from_name_topn", _top_groups_sql("from_name"))
def aggregate_from_name_topn(spark, sf):
    return _top_groups(spark, sf, "from_name")


@query(
    "orders_count_and_top_customers",
    """
select o_custkey as customer, count(*) as "count" from orders
where o_orderstatus = 'F' and o_orderdate >= timestamp '1995-01-01'
  and o_orderdate <= timestamp '1997-06-30 23:59:59.999999'
group by o_custkey order by "count" desc, customer limit 100""",
)
def orders_count_and_top_customers(spark, sf):
    """Filtered group-by top-n at volume."""
    from postroom.operators.filters import date_bound, timestamp_literal

    o = given.table(spark, sf, "orders")
    return (
        o.where(
            (F.col("o_orderstatus") == "F")
            & (F.col("o_orderdate") >= timestamp_literal(date_bound("1995-01-01")))
            & (F.col("o_orderdate") <= timestamp_literal(date_bound("1997-06-30", True)))
        )
        .groupBy(F.col("o_custkey").alias("customer"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "customer")
        .limit(100)
    )


@query(
    "validate_report",
    f"""{_WITH}
select account_id, count(*) as messages, count(body_text) as with_body,
  count(*) filter (length(body_text) <= 600) as within_classify,
  count(*) filter (length(body_text) <= 2400) as within_embed,
  max(length(body_text)) as max_body_chars
from emails_v where deleted_at is null group by account_id""",
)
def validate_report(spark, sf):
    rows = given.emails(spark, sf, "account_id", "body_text", "deleted_at")
    return aggregates.mailbox_report(rows, classify_chars=600, embed_chars=2400)


@query(
    "validate_mailbox",
    f"""{_WITH},
stored as (select account_id, count(*) as messages from emails_v where deleted_at is null group by account_id),
mailbox as (select cast(n_regionkey as integer) as account_id, count(*) * 190 as messages_total from nation group by n_regionkey)
select account_id, coalesce(messages, 0) as messages, coalesce(messages_total, 0) as messages_total,
  coalesce(messages, 0) - coalesce(messages_total, 0) as difference, coalesce(messages, 0) = coalesce(messages_total, 0) as matches
from stored full join mailbox using (account_id)""",
)
def validate_mailbox(spark, sf):
    """Stored mails per account against what the mailboxes count; the nations of a region stand in for those."""
    rows = given.emails(spark, sf, "account_id", "body_text", "deleted_at")
    n = given.table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("int").alias("account_id"))
    totals = n.agg((F.count("*") * 190).alias("messages_total"))
    compared = aggregates.against_mailbox(aggregates.mailbox_report(rows), totals)
    return compared.select("account_id", "messages", "messages_total", "difference", "matches")


# ---- vector --------------------------------------------------------------------


def _query_vector(spark, sf) -> list[float]:
    """The request's query vector: mean of the group with label 3 (one aggregated row)."""
    e = given.table(spark, sf, "embeddings").where("label = 3")
    row = (
        aggregates.pooled_by_group(e.withColumn("w", F.lit(1.0)), "label", "embedding", "w", _DIM)
        .select(F.transform("pooled", lambda x: F.round(x, 4)).alias("pooled"))
        .first()
    )
    return list(row["pooled"])


_DIM = 64
_QUERY_SQL = """
query_dims as (
  select pos, round(avg(x), 4) as x
  from (select unnest(generate_series(1, 64)) as pos, unnest(cast(embedding as double[])) as x
        from embeddings where label = 3) group by pos
),
query_v as (select list(x order by pos) as q from query_dims)"""
_DISTANCE_SQL = (
    "round(1 - list_cosine_similarity(cast(coalesce(body_embedding, body_pooled_embedding, "
    "subject_embedding) as double[]), q), 12)"
)


@query(
    "vector_topk",
    f"""{_WITH}, {_QUERY_SQL}
select id, round(greatest(0, least(1, 1 - distance)), 6) as score from (
  select id, sent_at, {_DISTANCE_SQL} as distance from searchable, query_v
  where subject_embedding is not null or body_embedding is not null or body_pooled_embedding is not null)
order by distance, sent_at desc nulls last, id limit 20""",
)
def vector_topk(spark, sf):
    rows = _matching(spark, sf, None, *given.VECTORS)
    top = search.vector_top(rows, _query_vector(spark, sf), 20)
    return top.select("id", F.round("score", 6).alias("score"))


@query(
    "vector_multi_query",
    """
with dims as (
  select label, pos, avg(x) as x
  from (select label, unnest(generate_series(1, 64)) as pos, unnest(cast(embedding as double[])) as x
        from embeddings) group by label, pos
),
centers as (select label, list(round(x, 6) order by pos) as c from dims group by label),
ranked as (
  select label, vec_id, distance, row_number() over (partition by label order by distance, vec_id) as rn
  from (select c.label, vec_id, round(1 - list_cosine_similarity(cast(embedding as double[]), c.c), 12) as distance
        from embeddings e, centers c)
)
select cast(label as bigint) as query_id, rn as "position", vec_id as id, round(distance, 6) as distance
from ranked where rn <= 15""",
)
def vector_multi_query(spark, sf):
    """Nearest vectors of every label's centre: one request with a query per label."""
    e = given.table(spark, sf, "embeddings")
    centers = aggregates.pooled_by_group(
        e.withColumn("w", F.lit(1.0)), "label", "embedding", "w", _DIM
    ).select("label", F.transform("pooled", lambda x: F.round(x, 6)).alias("pooled"))
    # The request's queries: one row per label value.
    queries = [(r["label"], r["pooled"]) for r in centers.orderBy("label").collect()]
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.nearest_per_query(rows, queries, 15).select(
        "query_id",
        F.col("position").cast("long").alias("position"),
        "id",
        F.round("distance", 6).alias("distance"),
    )


# ---- full text -----------------------------------------------------------------

_DOC_SQL = (
    "lower(coalesce(subject, '') || ' ' || coalesce(from_email, '') || ' ' || "
    "coalesce(from_name, '') || ' ' || coalesce(body_text, ''))"
)
_TOKENS_SQL = f"regexp_extract_all({_DOC_SQL}, '[\\p{{L}}\\p{{N}}]+')"
_TEXT_COLUMNS = ("subject", "from_email", "from_name", "body_text")


@query(
    "fulltext_single_term",
    f"""{_WITH}
select id, round(cast(greatest(0.1, least(1.0, 0.1 * tf)) as double), 6) as score from (
  select id, sent_at, len(list_filter({_TOKENS_SQL}, lambda t: t = 'nicht')) as tf from searchable)
where tf > 0 order by tf desc, sent_at desc nulls last, id limit 30""",
)
def fulltext_single_term(spark, sf):
    top = search.fulltext_top(_matching(spark, sf, None, *_TEXT_COLUMNS), "Nicht", 30)
    return top.select("id", F.round("score", 6).alias("score"))


def _cover_sql(a: str, b: str) -> str:
    """Minimal covers by window functions: the earliest of the latest matches moves."""
    return f"""
words as (
  select id, sent_at, unnest(toks) as w, unnest(generate_series(1, len(toks))) as pos
  from (select id, sent_at, {_TOKENS_SQL} as toks from searchable)
),
hits as (
  select *, row_number() over (partition by id order by pos) as nth from words where w in ('{a}', '{b}')
),
latest as (
  select id, sent_at, pos, nth,
    max(case when w = '{a}' then nth end) over upto as a_nth,
    max(case when w = '{b}' then nth end) over upto as b_nth,
    max(case when w = '{a}' then pos end) over upto as a_pos,
    max(case when w = '{b}' then pos end) over upto as b_pos
  from hits window upto as (partition by id order by pos rows unbounded preceding)
),
covers as (
  select *, least(a_nth, b_nth) as first_nth, least(a_pos, b_pos) as first_pos
  from latest where a_nth is not null and b_nth is not null
),
marked as (
  select *, lag(first_nth) over (partition by id order by pos) as before from covers
),
ranked as (
  select id, max(sent_at) as sent_at,
    sum(0.1 / (1.0 + (pos - first_pos) - (nth - first_nth))) as rank
  from marked where before is null or before <> first_nth group by id
)"""


@query(
    "fulltext_multi_term",
    f"""{_WITH}, {_cover_sql("der", "nicht")}
select id, round(greatest(0.1, least(1.0, rank)), 6) as score from ranked
order by round(rank, 9) desc, sent_at desc nulls last, id limit 50""",
)
def fulltext_multi_term(spark, sf):
    rows = _matching(spark, sf, None, *_TEXT_COLUMNS)
    top = search.fulltext_top(rows, "der, NICHT der", 50)
    return top.select("id", F.round("score", 6).alias("score"))


@query(
    "fulltext_match_all",
    f"""{_WITH}, {_cover_sql("les", "est")}
select id, round(rank, 6) as rank from ranked""",
)
def fulltext_match_all(spark, sf):
    """Every match with its cover-density rank, without a limit."""
    from postroom.functions import fulltext as ft
    from postroom.operators.filters import matches_text

    text = ft.document_text(*[F.col(c) for c in _TEXT_COLUMNS])
    terms = ft.query_terms("les est")
    rows = _matching(spark, sf, None, *_TEXT_COLUMNS).where(matches_text(text, terms))
    return rows.select("id", F.round(ft.cover_density(text, terms), 6).alias("rank"))


@query(
    "lexeme_postings",
    f"""{_WITH}
select id, w as lexeme, count(*) as occurrences, min(pos) - 1 as first_position from (
  select id, unnest(toks) as w, unnest(generate_series(1, len(toks))) as pos
  from (select id, {_TOKENS_SQL} as toks from emails_v where body_text is not null))
group by id, w""",
)
def lexeme_postings(spark, sf):
    """The stored full-text column: lexemes with counts and first positions per email."""
    from postroom.operators.postings import postings

    return postings(given.emails(spark, sf, "id", *_TEXT_COLUMNS)).select(
        "id",
        "lexeme",
        F.size("positions").cast("long").alias("occurrences"),
        F.get("positions", F.lit(0)).cast("long").alias("first_position"),
    )


@query(
    "postings_search",
    f"""{_WITH}, {_cover_sql("der", "die").replace("from searchable", "from emails_v where body_text is not null")}
select id, round(rank, 6) as rank from ranked""",
)
def postings_search(spark, sf):
    """The same rank through the written inverted index."""
    from postroom.operators.postings import search_segments, write_segment
    from postroom.session import new_work_dir

    segment = write_segment(given.emails(spark, sf, "id", *_TEXT_COLUMNS), new_work_dir(spark, "postings"))
    return search_segments(spark, [segment], "der die").select("id", F.round("rank", 6).alias("rank"))


@query(
    "segmented_search",
    f"""{_WITH}, {_cover_sql("der", "nicht").replace("from searchable", "from emails_v where body_text is not null and deleted_at is null")}
select id, round(greatest(0.1, least(1.0, rank)), 6) as score from ranked
order by round(rank, 9) desc, sent_at desc nulls last, id limit 50""",
)
def segmented_search(spark, sf):
    """Mail that comes in three batches, a segment each; deleted mail is not found."""
    from postroom.catalog.ingest import batched_store
    from postroom.operators.postings import search_segments

    store = batched_store(spark, sf, 3)
    matching = store.emails().where("deleted_at is null")
    hits = search_segments(spark, store.index(), "der, NICHT der", "gmail_id")
    return search.fulltext_top(matching, "der, NICHT der", 50, hits).select("id", F.round("score", 6).alias("score"))


# ---- fusion ----------------------------------------------------------------------

_FUSION_FILTERS = [{"field": "date_before", "value": "2024-01-02"}]
_FUSION_SQL = f"""{_WITH}, {_QUERY_SQL},
base as (select * from searchable where sent_at <= timestamp '2024-01-02 23:59:59.999999'),
structured as (
  select id, sent_at, 'structured' as method, cast(greatest(0.3, 1.0 - 0.03 * (rn - 1)) as double) as score
  from (select id, sent_at, row_number() over (order by sent_at desc nulls last, id) as rn from base)
  where rn <= 30
),
fulltext as (
  select id, sent_at, 'fulltext' as method, cast(greatest(0.1, least(1.0, 0.1 * tf)) as double) as score from (
    select id, sent_at, len(list_filter({_TOKENS_SQL}, lambda t: t = 'mit')) as tf from base)
  where tf > 0 order by tf desc, sent_at desc nulls last, id limit 30
),
vector as (
  select id, sent_at, 'vector' as method, greatest(0, least(1, 1 - distance)) as score from (
    select id, sent_at, {_DISTANCE_SQL} as distance from base, query_v where subject_embedding is not null)
  order by distance, sent_at desc nulls last, id limit 30
),
merged as (
  select * from structured union all select * from fulltext union all select * from vector
)"""


def _branches(spark, sf):
    ranked = _matching(spark, sf, _FUSION_FILTERS)
    texts = _matching(spark, sf, _FUSION_FILTERS, *_TEXT_COLUMNS)
    vectors = _matching(spark, sf, _FUSION_FILTERS, *given.VECTORS)
    k = search.per_method_limit(10)
    return [
        search.structured_top(ranked, k),
        search.fulltext_top(texts, "mit", k),
        search.vector_top(vectors, _query_vector(spark, sf), k),
    ]


@query(
    "hybrid_fused",
    f"""{_FUSION_SQL},
top as (
  select id, round(sum(score) / 3, 9) as final_score, string_agg(method, ',' order by method) as methods
  from merged group by id, sent_at order by final_score desc, sent_at desc nulls last, id limit 10
)
select {_FLAT_SQL.replace("gmail_id as id", "e.gmail_id as id")},
  round(top.final_score, 6) as final_score, top.methods
from top join emails_v e on e.id = top.id""",
)
def hybrid_fused(spark, sf):
    top = search.fuse(_branches(spark, sf), search.METHODS, 10)
    rows = search.fetch(given.emails(spark, sf, *_OUTPUT), top)
    return _flat(
        result_record(
            rows,
            F.round("final_score", 6).alias("final_score"),
            F.array_join("methods_used", ",").alias("methods"),
        ),
        "final_score",
        "methods",
    )


@query(
    "hybrid_reciprocal_rank",
    f"""{_FUSION_SQL},
placed as (
  select *, row_number() over (partition by method order by score desc, sent_at desc nulls last, id) as place
  from merged
)
select id, round(sum(1.0 / (60 + place)), 6) as final_score,
  string_agg(method, ',' order by method) as methods
from placed group by id, sent_at
order by sum(1.0 / (60 + place)) desc, sent_at desc nulls last, id limit 10""",
)
def hybrid_reciprocal_rank(spark, sf):
    top = search.fuse(_branches(spark, sf), search.METHODS, 10, rule="rrf")
    return top.select(
        "id",
        F.round("final_score", 6).alias("final_score"),
        F.array_join("methods_used", ",").alias("methods"),
    )
