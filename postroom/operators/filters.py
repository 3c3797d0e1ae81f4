"""Search filters as one Catalyst predicate."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, datetime, time, timezone
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom.functions.fulltext import contains_all


def date_bound(value: str, end_of_day: bool = False) -> datetime:
    """Naive UTC bound.  A bare date is midnight, or the last microsecond of its day."""
    text = value.strip()
    if "T" not in text and " " not in text:
        return datetime.combine(date.fromisoformat(text), time.max if end_of_day else time.min)
    stamp = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return stamp.astimezone(timezone.utc).replace(tzinfo=None) if stamp.tzinfo else stamp


def timestamp_literal(value: datetime) -> Column:
    # Zone-free on purpose: it compares with TIMESTAMP_NTZ as it is and with TIMESTAMP
    # in the session zone (UTC), and either way it reaches the Parquet scan.
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def contains_ignoring_case(c: Column, value: str) -> Column:
    """``%value%`` in which % and _ stay wildcards and a backslash quotes the next character."""
    pattern = re.sub(r"\\([^%_\\]|$)", r"\1", f"%{value}%", flags=re.DOTALL)
    return c.ilike(pattern)


def is_live() -> Column:
    return F.col("deleted_at").isNull()


def is_searchable(account_id: int | None = None) -> Column:
    """Live and fully transformed, optionally of one account."""
    cond = is_live() & F.col("transform_completed_at").isNotNull()
    return cond if account_id is None else cond & (F.col("account_id") == account_id)


def overlaps(c: Column, values: Sequence[Any]) -> Column:
    wanted = F.array(*[F.lit(v) for v in values]).cast("array<string>")
    return F.coalesce(F.arrays_overlap(c, wanted), F.lit(False))


def compile_filters(
    filters: Sequence[dict[str, Any]] | None = None, account_id: int | None = None
) -> Column:
    """Base predicate AND every filter.

    Sender address and sender name are alternatives when both are given, and the last
    value of each counts.  Operators are not interpreted, unknown fields and empty
    values are skipped.  Pushable comparisons come first, pattern matches last.
    """
    cheap = [is_searchable(account_id)]
    costly: list[Column] = []
    sender: dict[str, str] = {}
    for f in filters or ():
        field, value = f.get("field", ""), f.get("value")
        if field in ("has_attachments", "account_id"):
            if value is not None:
                wanted = bool(value) if field == "has_attachments" else int(value)
                cheap.append(F.col(field) == wanted)
        elif not value:
            continue
        elif field in ("from_email", "from_name"):
            sender[field] = str(value).strip()
        elif field == "to_email":
            costly.append(contains_ignoring_case(F.array_join("to_emails", ","), str(value)))
        elif field == "labels":
            costly.append(
                overlaps(F.col("labels"), value if isinstance(value, list) else [str(value)])
            )
        elif field == "date_after":
            cheap.append(F.col("sent_at") >= timestamp_literal(date_bound(str(value))))
        elif field == "date_before":
            cheap.append(F.col("sent_at") <= timestamp_literal(date_bound(str(value), True)))
    named = [contains_ignoring_case(F.col(c), v) for c, v in sender.items() if v]
    if named:
        costly.append(named[0] if len(named) == 1 else named[0] | named[1])
    cond = cheap[0]
    for c in cheap[1:] + costly:
        cond = cond & c
    return cond


def has_any_embedding() -> Column:
    return (
        F.col("subject_embedding").isNotNull()
        | F.col("body_embedding").isNotNull()
        | F.col("body_pooled_embedding").isNotNull()
    )


def matches_text(text: Column, terms: Sequence[str]) -> Column:
    """All terms present; no term at all matches nothing."""
    return contains_all(text, terms) if terms else F.lit(False)


def needs_transform(
    account_id: int | None = None, email_id: int | None = None, force: bool = False
) -> Column:
    """Live rows with a body that have no completion mark (or any, when forced)."""
    cond = is_live() & F.col("body_text").isNotNull()
    if email_id is not None:
        cond = cond & (F.col("id") == email_id)
    if account_id is not None:
        cond = cond & (F.col("account_id") == account_id)
    if not force and email_id is None:
        cond = cond & F.col("transform_completed_at").isNull()
    return cond


def by_identifier(identifier: str) -> Column:
    """A run of digits is the numeric id, anything else the message id; live rows only."""
    text = identifier.strip()
    key = F.col("id") == int(text) if re.fullmatch(r"[0-9]+", text) else F.col("gmail_id") == text
    return is_live() & key
