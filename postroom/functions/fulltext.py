"""Full-text tokens, matching and cover-density rank."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
LEXEME_WEIGHT = 0.1
RANK_MIN, RANK_MAX = 0.1, 1.0


def document_text(subject: Column, from_email: Column, from_name: Column, body: Column) -> Column:
    empty = F.lit("")
    return F.concat_ws(
        " ", *[F.coalesce(c, empty) for c in (subject, from_email, from_name, body)]
    )


def lexemes(text: Column) -> Column:
    """Lower-cased letter/digit runs in order; no stop words, no stemming."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def lexeme_positions(text: Column) -> Column:
    """``array<struct<lexeme, positions>>``: a text's distinct lexemes, each with its places from 0.

    The words are sorted once with their places, so equal ones stand together and each is walked once.
    """
    placed = F.transform(lexemes(text), lambda t, i: F.struct(t.alias("lexeme"), i.alias("at")))

    def cut(words: Column) -> Column:
        return _once(words["lexeme"], lambda names: _once(words["at"], lambda places: runs(names, places)))

    def runs(names: Column, places: Column) -> Column:
        begins = F.transform(names, lambda t, i: F.when(~t.eqNullSafe(F.get(names, i - 1)), i))

        def of(begin: Column) -> Column:
            return F.transform(
                begin,
                lambda b, j: F.struct(
                    F.get(names, b).alias("lexeme"),
                    F.slice(
                        places, b + 1, F.coalesce(F.get(begin, j + 1), F.size(names)) - b
                    ).alias("positions"),
                ),
            )

        return _once(F.filter(begins, lambda b: b.isNotNull()), of)

    return _once(F.sort_array(placed), cut)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def query_terms(query: str) -> list[str]:
    """Distinct query lexemes in order of appearance."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", (query or "").lower())))


def _occurrences(text: Column, term: str) -> Column:
    edge = r"[\p{L}\p{N}]"
    return F.regexp_count(text, F.lit(f"(?<!{edge}){re.escape(term)}(?!{edge})"))


def contains_all(text: Column, terms: Sequence[str]) -> Column:
    """Whole-token AND match.  A cheap substring test runs before the regex."""
    low = F.lower(text)
    cond = F.lit(True)
    for t in terms:
        cond = cond & low.contains(t)
    for t in terms:
        cond = cond & (_occurrences(low, t) > 0)
    return cond


def cover_density(text: Column, terms: Sequence[str]) -> Column:
    """Sum over minimal covers of ``0.1 / (1 + words in the span that are no query word)``.

    One term needs only its count.  Several terms fold over the matched tokens,
    keeping the latest match of every term: a new minimal cover ends at a match
    exactly when the earliest of those latest matches moves.
    """
    if len(terms) == 1:
        return _occurrences(F.lower(text), terms[0]) * F.lit(LEXEME_WEIGHT)
    wanted = F.array(*[F.lit(t) for t in terms])
    hits = F.filter(
        F.transform(
            lexemes(text),
            lambda t, i: F.struct(
                F.array_position(wanted, t).cast("int").alias("term"), i.cast("int").alias("at")
            ),
        ),
        lambda h: h["term"] > 0,
    )
    return cover_density_of_hits(hits, len(terms))


def cover_density_of_hits(hits: Column, n_terms: int) -> Column:
    """Rank from ``array<struct<term, at>>`` (terms numbered from 1) in position order."""
    numbered = F.transform(
        hits,
        lambda h, j: F.struct(
            j.cast("int").alias("nth"), h["at"].alias("at"), h["term"].alias("term")
        ),
    )
    # (nth, at) of the latest match per term; nth is null-free, -1 means "not yet seen".
    unseen = F.struct(F.lit(-1).alias("nth"), F.lit(-1).alias("at"))
    start = F.struct(
        F.array(*[unseen for _ in range(n_terms)]).alias("latest"),
        F.lit(-1).alias("begin"),
        F.lit(0.0).alias("rank"),
    )

    def step(acc: Column, h: Column) -> Column:
        latest = F.transform(
            acc["latest"],
            lambda old, k: F.when(
                k + 1 == h["term"], F.struct(h["nth"].alias("nth"), h["at"].alias("at"))
            ).otherwise(old),
        )
        first = F.array_min(latest)
        opened = (first["nth"] >= 0) & (first["nth"] != acc["begin"])
        noise = (h["at"] - first["at"]) - (h["nth"] - first["nth"])
        return F.struct(
            latest.alias("latest"),
            F.when(opened, first["nth"]).otherwise(acc["begin"]).alias("begin"),
            (
                acc["rank"]
                + F.when(opened, F.lit(LEXEME_WEIGHT) / (F.lit(1.0) + noise)).otherwise(F.lit(0.0))
            ).alias("rank"),
        )

    return F.aggregate(numbered, start, step, lambda acc: acc["rank"])


def rank_score(rank: Column) -> Column:
    return F.greatest(F.lit(RANK_MIN), F.least(F.lit(RANK_MAX), rank))
