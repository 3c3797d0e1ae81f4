from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from postroom.session import bound_batches, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under ``name``, with its SQL where SQL can express it."""

    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            bound_batches(spark)
            # The contract's times are UTC; the given timestamps carry no zone.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return add


# The mail stand-in of sources/given.py as SQL.
EMAILS_SQL = """
emails_v as (
  select d.doc_id as id, cast(d.doc_id % 3 + 1 as integer) as account_id,
    'm' || d.doc_id as gmail_id, 't' || cast(floor(d.doc_id / 4) as bigint) as gmail_thread_id,
    case when d.doc_id % 11 <> 0
         then split_part(split_part(d.text, chr(10), 1), '.', 1) end as subject,
    d.source || '@' || d.lang || '.example.com' as from_email,
    case when d.doc_id % 5 <> 0 then 'Sender ' || d.source end as from_name,
    'team@' || d.lang || '.example.com'
      || case when d.doc_id % 4 = 0 then ',' || d.source || '@list.example.com' else '' end as to_joined,
    [d.lang, d.source, 'L' || (d.doc_id % 25)] as labels,
    d.lang, d.text as body_text, split_part(d.text, chr(10), 2) as snippet,
    case when d.doc_id % 19 <> 0 then translate(d.text, '0123456789', '##########') end as body_redacted,
    d.doc_id % 7 = 0 as has_attachments, e.ts as sent_at, e.ts as updated_at,
    case when d.doc_id % 13 = 0 then e.ts end as deleted_at,
    case when d.doc_id % 17 <> 0 then e.ts end as transform_completed_at,
    case when l.toxic = 1 then 1 when l.quality = 0 then 2 else 3 end as privacy_tier,
    case when l.toxic = 1 or l.quality = 0 then 'Content redacted'
         else nullif(translate(split_part(d.text, chr(10), 2), '0123456789', '##########'), '')
    end as snippet_redacted,
    case when d.doc_id % 3 = 0 then v.embedding end as body_embedding,
    case when d.doc_id % 3 < 2 then v.embedding end as body_pooled_embedding,
    v.embedding as subject_embedding
  from documents d left join events e on e.event_id = d.doc_id
  left join labels l on l.doc_id = d.doc_id left join embeddings v on v.vec_id = d.doc_id
),
searchable as (
  select * from emails_v where deleted_at is null and transform_completed_at is not null
)"""
SENDER_SQL = (
    "case when trim(coalesce(from_name, '')) <> '' then from_name || ' <' || from_email || '>' "
    "else from_email end"
)
ISO_SQL = (
    "strftime(sent_at, '%Y-%m-%dT%H:%M:%S') || case when strftime(sent_at, '%f') = '000000' "
    "then '' else '.' || strftime(sent_at, '%f') end || '+00:00'"
)
BODY_SQL = (
    "case when privacy_tier = 1 then '[SENSITIVE CONTENT REDACTED]' "
    "else coalesce(nullif(body_redacted, ''), '[REDACTED CONTENT]') end"
)
