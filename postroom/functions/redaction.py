"""Redaction of personal data and secrets (ordered regex chains, all JVM-side)."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom import fixed_values as fv
from postroom.functions.text import edged, fold_case, has_text, let, mentions, strip


# What a text must hold before a rule can match it at all, by position in the fixed lists.
# Gates look at the text as it comes in: the inserted tokens stand in brackets, so no
# replacement can complete a word, a link or a digit run that was not there before.
_KEY_WORDS = (
    "api_key", "api-key", "apikey", "api_secret", "secret_key", "auth_token", "auth-token",
    "authtoken",
)
_PII_NEEDS = ("at", "digit", "digit", "digit", "digit")
_PII_GATES = {
    "at": lambda t, low: t.contains("@"),
    "digit": lambda t, low: t.rlike(r"\p{Nd}"),
}
_SECRET_NEEDS = (
    "link", "block", "bearer", "access", "key", "password", "fours", "fives", "run", "run", "license",
)
_SECRET_GATES = {
    "link": lambda t, low: t.contains("://"),
    "block": lambda t, low: t.contains("-----"),
    "bearer": lambda t, low: mentions(low, "bearer"),
    "access": lambda t, low: mentions(low, "access_token"),
    "key": lambda t, low: mentions(low, *_KEY_WORDS),
    "password": lambda t, low: mentions(low, "passw", "pwd", "token"),
    "fours": lambda t, low: t.rlike("-[^-]{4}-[^-]{4}-"),
    "fives": lambda t, low: t.rlike("-[^-]{5}-[^-]{5}-"),
    "run": lambda t, low: t.rlike("[A-Za-z0-9+/]{20}"),
    "license": lambda t, low: mentions(low, "license", "product", "serial", "activation"),
}


def _apply(c: Column, rules, needs, gates) -> Column:
    """Ordered replacements; each runs only on texts that pass its cheap gate."""

    def tested(pair: Column) -> Column:
        passed = [test(pair["text"], pair["low"]).alias(name) for name, test in gates.items()]
        return F.struct(pair["text"].alias("text"), F.struct(*passed).alias("gates"))

    def gated(pattern: str, token: str, flags: str, need: str):
        def step(known: Column) -> Column:
            text = known["text"]
            changed = F.regexp_replace(text, f"(?{flags}){pattern}", token)
            return F.struct(
                F.when(known["gates"][need], changed).otherwise(text).alias("text"),
                known["gates"].alias("gates"),
            )

        return step

    low = fold_case(c) if gates is _SECRET_GATES else c
    # The folded copy and every gate are computed once per text and travel along with it.
    state = let(F.struct(c.alias("text"), low.alias("low")), tested)
    for rule, need in zip(rules, needs, strict=True):
        state = let(state, gated(*rule, need))
    return state["text"]


def redact_pii(c: Column, ascii_edges: bool = False) -> Column:
    """E-mail, phone, card, SSN and nine-digit ids; the order decides the outcome.

    ``ascii_edges``, here and below: a word's edge lies between ASCII letters, digits and underscores
    and anything else, so a secret that touches an accented letter goes too.
    """
    rules = [(edged(p, ascii_edges), k, "U") for p, k in fv.PII]
    # ``c`` is often a long chain itself: bind it before it is read twice.
    return let(c, lambda t: _apply(t, rules, _PII_NEEDS, _PII_GATES))


def redact_secrets(c: Column, ascii_edges: bool = False) -> Column:
    """Links first (so reset links stay readable as [LINK]), then keys and tokens."""
    rules = [(edged(p, ascii_edges), k, "Ui" if i else "U") for p, k, i in (fv.LINK, *fv.SECRETS)]
    return let(c, lambda t: _apply(t, rules, _SECRET_NEEDS, _SECRET_GATES))


_CONTRACTIONS = frozenset(w.upper() for w in fv.PERSON_CONTRACTIONS)


def _is_name(text: str, span: dict) -> bool:
    """A span of a redacted kind within the text; persons must be long enough and no contraction."""
    if span["label"] not in fv.ENTITY_LABELS or not 0 <= span["start"] <= span["end"] <= len(text):
        return False
    name = text[span["start"] : span["end"]]
    return span["label"] != "PERSON" or (len(name) >= fv.PERSON_MIN_LENGTH and name.upper().strip() not in _CONTRACTIONS)


def replace_entities(text: str, entities: Iterable[dict]) -> str:
    """The text between the names, and a label for each name; a span that begins inside an earlier one is part of it."""
    pieces, at = [], 0
    for span in sorted((e for e in entities if _is_name(text, e)), key=lambda e: (e["start"], -e["end"])):
        if span["start"] >= at:
            pieces.append(f"{text[at : span['start']]}[{span['label']}]")
            at = span["end"]
    return "".join(pieces) + text[at:]


def entity_redactor(ner):
    """Arrow UDF ``(text, lang) -> text`` around an entity recogniser.

    The recogniser is created once per Python worker through ``ner.open()``.
    """

    @F.arrow_udf("string")
    def redact(text: pa.Array, lang: pa.Array) -> pa.Array:
        find = ner.open()
        return pa.array(
            [
                None if t is None else replace_entities(t, find(t, (g or "en")[:10]))
                for t, g in zip(text.to_pylist(), lang.to_pylist())
            ],
            pa.string(),
        )

    return redact


def redact_for_display(c: Column, lang: Column | None = None, ner=None, ascii_edges: bool = False) -> Column:
    """Personal data, then named entities (when a recogniser is given), then secrets."""
    text = redact_pii(F.coalesce(c, F.lit("")), ascii_edges)
    if ner is not None:
        text = entity_redactor(ner)(text, F.lit("en") if lang is None else lang)
    return redact_secrets(text, ascii_edges)


def snippet_for_tier(snippet: Column, tier: Column, lang: Column | None = None, ner=None, ascii_edges: bool = False) -> Column:
    """Placeholder for the two private tiers, redacted snippet otherwise, '' as null."""
    private = tier.isin(fv.SENSITIVE, fv.PERSONAL)
    shown = F.when(has_text(snippet), strip(snippet)).otherwise(F.lit(""))
    return F.nullif(
        F.when(private, F.lit(fv.SNIPPET_PLACEHOLDER)).otherwise(
            redact_for_display(shown, lang, ner, ascii_edges)
        ),
        F.lit(""),
    )
