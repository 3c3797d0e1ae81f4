"""Token counting and truncation.

A tokenizer whose count depends only on the text length (the offline default) is
a plain Catalyst expression.  Any other tokenizer plugs in through ``open()``, a
factory that is called once per Arrow batch inside the worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom import fixed_values as fv
from postroom.functions.text import let


def token_count(c: Column, tokenizer) -> Column:
    if tokenizer.length_based:
        return tokenizer.count_column(c)

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        encode = tokenizer.open()
        return pa.array(
            [None if t is None else len(encode(t)) if t else 0 for t in texts.to_pylist()],
            pa.int32(),
        )

    return count(c)


def truncate(
    c: Column,
    tokenizer,
    max_chars: int | None = fv.EMBED_MAX_CHARS,
    max_tokens: int | None = fv.EMBED_MAX_TOKENS,
) -> Column:
    """Cut to ``max_chars``, then to ``max_tokens`` (never above 8192)."""
    text = F.substring(c, 1, max_chars) if max_chars and max_chars > 0 else c
    if not max_tokens or max_tokens <= 0:
        return text
    cap = min(max_tokens, fv.EMBED_MAX_TOKENS)
    if tokenizer.length_based:
        # The proportional cut always satisfies a length-based count at the first try.
        return let(
            text,
            lambda t: F.when(
                (F.length(t) > cap * 3) & (tokenizer.count_column(t) > cap),
                F.substring(
                    t, F.lit(1), F.floor(F.length(t).cast("double") * cap / tokenizer.count_column(t)).cast("int")
                ),
            ).otherwise(t),
        )
    cut = _truncate_udf(tokenizer, cap)
    return let_long(text, cap * 3, cut)


def let_long(text: Column, above: int, cut) -> Column:
    """Send only the long texts to Python; the short ones pass through the JVM."""
    long_text = F.when(F.length(text) > above, text)
    return F.coalesce(cut(long_text), text)


def _truncate_udf(tokenizer, cap: int):
    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        encode = tokenizer.open()
        return pa.array(
            [None if t is None else fit_to_tokens(t, encode, cap) for t in texts.to_pylist()],
            pa.string(),
        )

    return cut


def cut_lengths(length: int, tokens: int, cap: int) -> Iterator[int]:
    """Lengths to try: in proportion to the cap first, then each a tenth shorter, fifteen times."""
    return accumulate(range(15), lambda size, _: int(size * 0.9), initial=int(length * cap / tokens))


def fit_to_tokens(text: str, encode, cap: int) -> str:
    """The text, or its first prefix of the lengths to try that fits; the shortest one if none does."""
    tokens = len(encode(text))
    if tokens <= cap:
        return text
    prefixes = [text[:size] for size in cut_lengths(len(text), tokens, cap)]
    return next((p for p in prefixes if len(encode(p)) <= cap), prefixes[-1])
