"""Token-bounded splitting of long bodies.

Packing is an order-dependent fold inside one row, so it needs no shuffle and no
window: paragraphs (long ones broken into sentences) become an array of pieces,
and ``aggregate`` packs them greedily.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom import fixed_values as fv
from postroom.functions.text import has_text, let, strip
from postroom.functions.tokens import token_count

CHUNKS_TYPE = "array<struct<text:string,position:int,weight:double>>"


def _non_empty(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    unix = F.regexp_replace(c, r"\r\n?", "\n")
    return _non_empty(F.split(unix, f"(?U){fv.BLANK_LINE}"))


def sentences(c: Column) -> Column:
    return _non_empty(F.split(c, f"(?U){fv.SENTENCE_END}"))


def _pack(pieces: Column, tokens, target: int) -> Column:
    """Fold pieces into ``array<array<string>>``, closing a chunk before it overflows."""
    empty = F.array().cast("array<string>")
    start = F.struct(
        F.array().cast("array<array<string>>").alias("done"),
        empty.alias("open"),
        F.lit(0).cast("long").alias("used"),
    )

    def step(acc: Column, piece: Column) -> Column:
        size = tokens(piece).cast("long")
        full = (acc["used"] + size > target) & (F.size(acc["open"]) > 0)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"])))
            .otherwise(acc["done"])
            .alias("done"),
            F.when(full, F.array(piece))
            .otherwise(F.concat(acc["open"], F.array(piece)))
            .alias("open"),
            (F.when(full, F.lit(0).cast("long")).otherwise(acc["used"]) + size).alias("used"),
        )

    def finish(acc: Column) -> Column:
        return F.when(
            F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))
        ).otherwise(acc["done"])

    return F.aggregate(pieces, start, step, finish)


def _as_chunks(groups: Column) -> Column:
    return F.transform(
        groups,
        lambda g, i: F.struct(
            F.array_join(g, "\n\n").alias("text"),
            i.cast("int").alias("position"),
            F.when(i == 0, F.lit(fv.CHUNK_FIRST_WEIGHT))
            .otherwise(F.lit(fv.CHUNK_REST_WEIGHT))
            .alias("weight"),
        ),
    )


def chunk_body(
    c: Column,
    tokenizer,
    max_tokens: int = fv.EMBED_MAX_TOKENS,
    target: int = fv.CHUNK_TARGET_TOKENS,
) -> Column:
    """``array<struct<text, position, weight>>``; empty when the body fits whole.

    A single sentence above the target stays in one piece.
    """
    if not tokenizer.length_based:
        return _chunk_udf(tokenizer, max_tokens, target)(c)
    tokens = tokenizer.count_column
    pieces = F.flatten(
        F.transform(
            paragraphs(c),
            lambda p: F.when(tokens(p) > target, sentences(p)).otherwise(F.array(p)),
        )
    )
    fits = ~has_text(c) | (tokens(c) <= max_tokens)
    return F.when(fits, F.array().cast(CHUNKS_TYPE)).otherwise(
        _as_chunks(_pack(pieces, tokens, target)).cast(CHUNKS_TYPE)
    )


def _chunk_udf(tokenizer, max_tokens: int, target: int):
    """Same rule for tokenizers that need a model: pieces are counted in the worker."""
    import re

    blank_line, sentence_end = re.compile(fv.BLANK_LINE), re.compile(fv.SENTENCE_END)

    @F.arrow_udf(CHUNKS_TYPE)
    def chunk(texts: pa.Array) -> pa.Array:
        encode = tokenizer.open()

        def size(t: str) -> int:
            return len(encode(t))

        def pieces(body: str):
            for block in blank_line.split(re.sub(r"\r\n?", "\n", body)):
                block = block.strip()
                if block and size(block) > target:
                    yield from filter(None, map(str.strip, sentence_end.split(block)))
                elif block:
                    yield block

        def pack(body: str | None) -> list[dict]:
            if not (body or "").strip() or size(body) <= max_tokens:
                return []
            groups: list[list[str]] = []
            used = 0
            for piece in pieces(body):
                n = size(piece)
                if not groups or used + n > target:
                    groups.append([])
                    used = 0
                groups[-1].append(piece)
                used += n
            return [
                {
                    "text": "\n\n".join(g),
                    "position": i,
                    "weight": fv.CHUNK_REST_WEIGHT if i else fv.CHUNK_FIRST_WEIGHT,
                }
                for i, g in enumerate(groups)
            ]

        kind = pa.list_(
            pa.struct([("text", pa.string()), ("position", pa.int32()), ("weight", pa.float64())])
        )
        return pa.array([pack(t) for t in texts.to_pylist()], kind)

    return chunk


def body_kind(c: Column, tokenizer, max_tokens: int = fv.EMBED_MAX_TOKENS) -> Column:
    """``none`` / ``full`` / ``chunked``."""
    return let(
        c,
        lambda t: F.when(~has_text(t), F.lit("none"))
        .when(token_count(t, tokenizer) <= max_tokens, F.lit("full"))
        .otherwise(F.lit("chunked")),
    ) if tokenizer.length_based else (
        F.when(~has_text(c), F.lit("none"))
        .when(token_count(c, tokenizer) <= max_tokens, F.lit("full"))
        .otherwise(F.lit("chunked"))
    )
