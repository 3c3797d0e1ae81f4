"""Privacy tiers: input normalisation, prompt assembly, answer parsing, offline rules."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom import fixed_values as fv
from postroom.functions.text import any_of, edged, has_text, let, mentions, strip
from postroom.functions.tokens import token_count

# ---- input -------------------------------------------------------------------


def normalized_sender(sender: Column) -> Column:
    s = strip(F.coalesce(sender, F.lit("")))
    return F.when(s.contains("@"), F.lower(s)).otherwise(F.lit(""))


#: Most characters of body, subject and sender, and most labels, that the service contract allows.
CONTRACT_INPUT = (fv.EMAIL_BODY_MAX, fv.EMAIL_SUBJECT_MAX, fv.EMAIL_SENDER_MAX, fv.EMAIL_LABELS_MAX)


def input_problem(
    subject: Column, body: Column, sender: Column, labels: Column, most: tuple[int | None, ...] = CONTRACT_INPUT
) -> Column:
    """Null when the classifier input is within the limits, else the first violation; None is no limit."""
    sizes = (F.length(strip(body)), F.length(strip(subject)), F.length(normalized_sender(sender)), F.size(labels))
    checks = zip(sizes, most, ("body", "subject", "sender", "labels"), strict=True)
    found = [F.when(size > top, F.lit(f"{field} is too long")) for size, top, field in checks if top is not None]
    return F.coalesce(*found, F.lit(None).cast("string"))


# ---- answers -----------------------------------------------------------------


def strip_think(answer: Column) -> Column:
    """Remove reasoning blocks until nothing changes.

    Every pass that removes something removes at least one '<', so the number of
    '<' (plus one for the outer strip) bounds the passes that can matter.
    """
    passes = F.sequence(F.lit(0), F.regexp_count(answer, F.lit("<")))
    block = f"(?Uid){any_of(fv.THINK_BLOCK)}"
    cleaned = F.aggregate(passes, answer, lambda acc, _: strip(F.regexp_replace(acc, block, "")))
    return F.when(has_text(answer), cleaned).otherwise(answer)


def _first_tier(upper: Column) -> Column:
    """Whole word first, then substring; SENSITIVE before PERSONAL before PUBLIC."""
    words = [F.when(upper.rlike(rf"(?U)\b{t}\b"), F.lit(t)) for t in fv.TIER_NAMES]
    parts = [F.when(upper.contains(t), F.lit(t)) for t in fv.TIER_NAMES]
    return F.coalesce(*words, *parts)


def parse_tier(answer: Column) -> Column:
    """Tier name in a model answer, or null when there is none.

    The abbreviation test precedes the word test, so "NOT PUBLIC" reads as PUBLIC.
    """
    raw = F.coalesce(answer, F.lit(""))

    def read(cleaned: Column) -> Column:
        token = F.element_at(F.split(cleaned, r"(?U)[\s\x1c-\x1f]+"), 1)
        short = [F.when(cleaned.contains(a), F.lit(t)) for a, t in fv.TIER_ABBREVIATIONS]
        return F.when(cleaned == "", _first_tier(F.upper(strip(raw)))).otherwise(
            F.coalesce(
                F.when(cleaned.isin(*fv.TIER_NAMES), cleaned),
                F.when(token.isin(*fv.TIER_NAMES), token),
                *short,
                _first_tier(cleaned),
            )
        )

    return let(F.upper(strip(strip_think(raw))), read)


def tier_code(name: Column) -> Column:
    return (
        F.when(name == "SENSITIVE", F.lit(fv.SENSITIVE))
        .when(name == "PERSONAL", F.lit(fv.PERSONAL))
        .when(name == "PUBLIC", F.lit(fv.PUBLIC))
    )


def tier_name(code: Column) -> Column:
    """Name of a tier code; any other code is shown as its number."""
    return (
        F.when(code == fv.SENSITIVE, F.lit("SENSITIVE"))
        .when(code == fv.PERSONAL, F.lit("PERSONAL"))
        .when(code == fv.PUBLIC, F.lit("PUBLIC"))
        .otherwise(code.cast("string"))
    )


# ---- prompt ------------------------------------------------------------------


def render(template: str, values: dict[str, Column]) -> Column:
    """``str.format`` placeholders filled with columns."""
    parts = []
    for text, field, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field is not None:
            parts.append(values[field])
    return F.concat(*parts)


def prompt_values(
    sender: Column, subject: Column, preview: Column, has_attachments: Column, labels: Column
) -> dict[str, Column]:
    return {
        "sender": F.coalesce(F.nullif(sender, F.lit("")), F.lit("(unknown)")),
        "subject": F.coalesce(subject, F.lit("")),
        "body_preview": preview,
        "output_labels": F.lit(fv.OUTPUT_LABELS),
        "has_attachments": F.when(has_attachments, F.lit("yes")).otherwise(F.lit("no")),
        "labels": F.when(F.size(labels) > 0, F.array_join(labels, ", ")).otherwise(F.lit("none")),
    }


def full_prompt(prompts, values: dict[str, Column]) -> Column:
    return F.concat(
        render(prompts.system, values), F.lit("\n\n"), render(prompts.user_template, values)
    )


def fit_body(
    body: Column, prompt_without_body: Column, tokenizer, max_prompt_tokens: int
) -> Column:
    """The body, or its head and tail around an ellipsis, so that the prompt fits.

    Candidates start at three quarters plus one quarter and lose 500 / 200
    characters per step down to 100 / 100; that last one is taken untested.
    ``prompt_without_body`` is the prompt rendered with an empty preview.
    """
    if not tokenizer.length_based:
        return _fit_body_udf(tokenizer, max_prompt_tokens)(body, prompt_without_body)

    def choose(text: Column) -> Column:
        n = F.length(text)
        # A length-based count of the prompt is the count of its length.
        fixed = F.length(prompt_without_body)

        def tokens(preview_length: Column) -> Column:
            return tokenizer.count_length(fixed + preview_length)

        quarter = F.floor(n / 4).cast("int")
        head = F.floor(n / 2).cast("int") + quarter
        steps = F.greatest(
            F.lit(1),
            F.ceil((head - 100) / 500).cast("int"),
            F.ceil((quarter - 100) / 200).cast("int"),
        )
        sizes = F.transform(
            F.sequence(F.lit(0), steps),
            lambda i: F.struct(
                F.when(i == 0, head)
                .otherwise(F.greatest(F.lit(100), head - i * 500))
                .alias("head"),
                F.when(i == 0, quarter)
                .otherwise(F.greatest(F.lit(100), quarter - i * 200))
                .alias("tail"),
                (i > 0).alias("shrunk"),
            ),
        )

        def length_of(s: Column) -> Column:
            return F.when(s["head"] + s["tail"] >= n, n).otherwise(
                s["head"] + s["tail"] + len(fv.ELISION)
            )

        def at_floor(s: Column) -> Column:
            return s["shrunk"] & (s["head"] <= 100) & (s["tail"] <= 100)

        def acceptable(s: Column) -> Column:
            return at_floor(s) | (tokens(length_of(s)) <= max_prompt_tokens)

        def text_of(s: Column) -> Column:
            elided = F.concat(
                F.substring(text, F.lit(1), s["head"]),
                F.lit(fv.ELISION),
                F.right(text, s["tail"]),
            )
            return F.when(~at_floor(s) & (s["head"] + s["tail"] >= n), text).otherwise(elided)

        first = F.element_at(F.filter(sizes, acceptable), 1)
        return F.when(tokens(n) <= max_prompt_tokens, text).otherwise(let(first, text_of))

    return choose(body)


def _fit_body_udf(tokenizer, budget: int):
    @F.arrow_udf("string")
    def fit(bodies: pa.Array, frames: pa.Array) -> pa.Array:
        encode = tokenizer.open()
        return pa.array(
            [
                None if b is None else fit_text(b, lambda p: len(encode(f + p)) <= budget)
                for b, f in zip(bodies.to_pylist(), frames.to_pylist())
            ],
            pa.string(),
        )

    return fit


def preview_sizes(n: int) -> Iterator[tuple[int, int, bool]]:
    """(head, tail, last): the candidates of :func:`fit_body`; the last one is taken untested."""
    quarter = n // 4
    head = n // 2 + quarter
    yield head, quarter, False
    for i in range(1, max(1, -(-(head - 100) // 500), -(-(quarter - 100) // 200)) + 1):
        sizes = max(100, head - 500 * i), max(100, quarter - 200 * i)
        yield *sizes, sizes == (100, 100)


def fit_text(body: str, fits) -> str:
    """Row form of :func:`fit_body` for tokenizers that need the text itself."""
    n = len(body)
    if fits(body):
        return body
    for head, tail, last in preview_sizes(n):
        whole = head + tail >= n and not last
        preview = body if whole else body[:head] + fv.ELISION + body[max(0, n - tail) :]
        if last or fits(preview):
            return preview
    raise AssertionError("the last candidate is always taken")


# ---- offline rules -------------------------------------------------------------

_SECRET_VALUE = any_of(
    [
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
        r"\bBearer\s+[A-Za-z0-9\-_.~+/]{16,}",
        r"(?:api[_-]?key|api_secret|secret_key|access_token|auth[_-]?token)[\s=:]+\S{8,}",
        r"(?:password|passwd|pwd|token)\s*[=:]\s*\S{4,}",
        r"\bpassword is \S{4,}",
        r"\b\d{3}-\d{2}-\d{4}\b",
        r"\b\d{16}\b",
        r"\baccount (?:number|no)[.:\s]+\d{6,}",
    ]
)
_SECRET_WORDS = (
    "private key", "bearer", "api_key", "api-key", "apikey", "api_secret", "secret_key", "password",
    "passwd", "pwd", "token", "account n",
)
_BULK_SENDER = r"(?:^|[<\s])(?:no-?reply|newsletter|notifications?|marketing|updates)@"
_BULK_BODY = r"\bunsubscribe\b|\border confirmation\b|\bhas shipped\b|\bspecial offer\b"
_BULK_WORDS = ("unsubscribe", "order confirmation", "has shipped", "special offer")
_EXPECTS_REPLY = r"\?|\blet me know\b|\bcan you\b|\bcould you\b|\bmeeting\b|\binvit(?:e|ation)\b"
_REPLY_WORDS = ("?", "let me know", "can you", "could you", "meeting", "invit")


def rule_based_answer(sender: Column, subject: Column, body: Column) -> Column:
    """Offline stand-in for the classifier model: one word by ordered rules.

    Plain substring tests decide whether a rule's regex needs to run at all.
    """
    text = F.concat_ws("\n", F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit("")))

    def decide(pair: Column) -> Column:
        t, low = pair["text"], pair["low"]
        digits = t.rlike("[0-9]{3}-[0-9]{2}-|[0-9]{16}")
        secret = (mentions(low, *_SECRET_WORDS) | digits) & t.rlike(f"(?i){edged(_SECRET_VALUE)}")
        bulk = mentions(low, *_BULK_WORDS) & t.rlike(f"(?i){edged(_BULK_BODY)}")
        reply = mentions(low, *_REPLY_WORDS) & t.rlike(f"(?i){edged(_EXPECTS_REPLY)}")
        return (
            F.when(secret, F.lit("SENSITIVE"))
            .when(sender.rlike(f"(?i){_BULK_SENDER}") | bulk, F.lit("PUBLIC"))
            .when(sender.contains("@") & reply, F.lit("PERSONAL"))
            .otherwise(F.lit("PUBLIC"))
        )

    return let(F.struct(text.alias("text"), F.lower(text).alias("low")), decide)


def prompt_over_budget(prompt: Column, tokenizer, max_prompt_tokens: int) -> Column:
    return F.when(
        token_count(prompt, tokenizer) > max_prompt_tokens,
        F.lit("Classification prompt exceeds token limit after truncation"),
    )
