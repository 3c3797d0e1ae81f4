"""Embedding as one Arrow UDF over a row's own texts.

All texts of an email (subject, body or chunks) travel as one array and come back as
one array of vectors, so vectors never have to be matched to texts by position across
rows and the whole transform stays free of shuffles.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


class PayloadTooLarge(Exception):
    """An embedder raises this when a request is bigger than its service accepts."""


MIN_CHARS_TO_HALVE = 256


RESULT = "struct<vectors:array<array<float>>,problem:string,ms:double>"


def embed_texts(embed, texts: list[str]) -> list:
    """One request; when it is too large, one text at a time, a long text in halves.

    The halves' vectors are averaged by their lengths, so no part of a text is left out.
    """
    try:
        answer = list(embed(texts))
    except PayloadTooLarge:
        return [_embed_one(embed, t) for t in texts]
    if len(answer) != len(texts):
        raise ValueError(f"{len(answer)} vectors for {len(texts)} texts")
    return [np.asarray(v, dtype=np.float32) for v in answer]


def _embed_one(embed, text: str) -> np.ndarray:
    try:
        (vector,) = embed([text])
        return np.asarray(vector, dtype=np.float32)
    except PayloadTooLarge:
        if len(text) <= MIN_CHARS_TO_HALVE:
            raise
    middle = len(text) // 2
    parts = (text[:middle], text[middle:])
    return np.average([_embed_one(embed, p) for p in parts], axis=0, weights=[len(p) for p in parts]).astype(np.float32)


def embed_mails(embed, mails: list[list[str]], batch_size: int) -> list[dict]:
    """Vectors per mail.  A request over several mails that fails is asked again mail by mail."""
    flat = [t for texts in mails for t in texts]
    try:
        found = [v for at in range(0, len(flat), batch_size) for v in embed_texts(embed, flat[at : at + batch_size])]
    except Exception as e:  # the service's own errors: the row carries them
        if len(mails) == 1:
            return [{"vectors": [], "problem": f"Embedding failed: {type(e).__name__}: {e}"}]
        return [r for texts in mails for r in embed_mails(embed, [texts], batch_size)]
    results, at = [], 0
    for texts in mails:
        results.append({"vectors": found[at : at + len(texts)], "problem": None})
        at += len(texts)
    return results


def parts_that_fit(text: str, fits) -> list[str]:
    """The text, or its halves, or theirs, until every part fits."""
    if fits(text) or len(text) <= MIN_CHARS_TO_HALVE:
        return [text]
    middle = len(text) // 2
    return [*parts_that_fit(text[:middle], fits), *parts_that_fit(text[middle:], fits)]


def _joined(made: dict, parts: list[list[str]]) -> dict:
    """One vector per text out of its parts' vectors, averaged by their lengths."""
    if made["problem"] is not None:
        return made
    vectors, at = [], 0
    for own in parts:
        found = made["vectors"][at : at + len(own)]
        at += len(own)
        if len(own) > 1:
            found = [np.average(found, axis=0, weights=[len(p) for p in own]).astype(np.float32)]
        vectors += found
    return {"vectors": vectors, "problem": None}


def embedding_udf(embedder, batch_size: int = 64, fit=None, fits=None):
    """``array<string> -> struct<vectors, problem, ms>``; the client opens once per task.

    ``fit()`` gives a function that cuts a text to the model's token limit, where the
    tokenizer needs the text itself.  ``fits()`` gives a test instead; a longer text is embedded in
    parts, so nothing of it is left out.  A mail whose texts fail leaves the others alone.
    """

    @F.arrow_udf(RESULT)
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embed = embedder.open()
        cut = fit() if fit is not None else None
        test = fits() if fits is not None else None
        for texts in batches:
            mails = [m or [] for m in texts.to_pylist()]
            if cut is not None:
                mails = [[cut(t) for t in m] for m in mails]
            split = [[parts_that_fit(t, test) if test else [t] for t in m] for m in mails]
            flat_mails = [[p for own in m for p in own] for m in split]
            made: list[dict] = []
            took: list[float] = []  # a mail's share of its request's time
            for at in range(0, len(mails), batch_size):
                own, began = flat_mails[at : at + batch_size], time.perf_counter()
                made.extend(embed_mails(embed, own, batch_size))
                took += [(time.perf_counter() - began) * 1000 / len(own)] * len(own)
            made = [_joined(r, parts) for r, parts in zip(made, split, strict=True)]
            flat = pa.array([v for m in made for v in m["vectors"]], pa.list_(pa.float32()))
            ends = pa.array(np.cumsum([0, *(len(m["vectors"]) for m in made)]), pa.int32())
            columns = [pa.ListArray.from_arrays(ends, flat), pa.array([m["problem"] for m in made], pa.string()), pa.array(took, pa.float64())]
            yield pa.StructArray.from_arrays(columns, ["vectors", "problem", "ms"])

    return vectors
