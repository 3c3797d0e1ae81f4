"""Message payloads: choosing the body part, attachments, decoding.

Only the walk over the recursive part tree needs Python (a JSON tree of unknown
depth has no StructType).  The worker returns the candidate parts still encoded;
base64, charset and HTML work stay in the JVM.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postroom.functions.html import html_to_text
from postroom.functions.text import from_windows_1252, strip_tracking_pixels

HEADER = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]
)
_BODY = T.StructType(
    [
        T.StructField("data", T.StringType()),
        T.StructField("attachmentId", T.StringType()),
        T.StructField("size", T.LongType()),
    ]
)
PART = T.StructType(
    [
        T.StructField("mimeType", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("headers", T.ArrayType(HEADER)),
        T.StructField("body", _BODY),
    ]
)
# What the relational side needs: headers and the top-level parts, nothing deeper.
SHALLOW_PAYLOAD = T.StructType(
    [
        T.StructField("mimeType", T.StringType()),
        T.StructField("headers", T.ArrayType(HEADER)),
        T.StructField("parts", T.ArrayType(PART)),
    ]
)
_CANDIDATES = T.ArrayType(
    T.StructType([T.StructField("html", T.BooleanType()), T.StructField("data", T.StringType())])
)


def base64url_decode(c: Column) -> Column:
    """URL-safe base64 to binary (a plain ``unbase64`` would drop '-' and '_'); null when it is broken."""
    return F.try_to_binary(F.translate(c, "-_", "+/"), F.lit("base64"))


def utf8_text(data: Column) -> Column:
    """Text of UTF-8 bytes; other bytes are read as windows-1252, the usual charset of old mail."""
    plain = data.cast("string")
    return F.when(F.is_valid_utf8(plain), plain).otherwise(from_windows_1252(F.decode(data, "ISO-8859-1")))


def body_candidates(payload: dict) -> list[dict]:
    """Parts that may be the body, best first.

    Nested multiparts come before a level's own text; a level offers one of: its
    last text/plain, its last text/html, its own inline data.
    """
    found: list[dict] = []
    chosen: dict[str, str] = {}
    for part in payload.get("parts") or []:
        kind = part.get("mimeType")
        if kind in ("text/plain", "text/html"):
            # The last part of a kind counts, even when it carries no data.
            chosen[kind] = (part.get("body") or {}).get("data") or ""
        elif "parts" in part:
            found.extend(body_candidates(part))
    own = (payload.get("body") or {}).get("data")
    if chosen.get("text/plain"):
        found.append({"html": False, "data": chosen["text/plain"]})
    elif chosen.get("text/html"):
        found.append({"html": True, "data": chosen["text/html"]})
    elif own:
        found.append({"html": payload.get("mimeType") == "text/html", "data": own})
    return found


@F.arrow_udf(_CANDIDATES)
def _candidates(payloads: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("html", pa.bool_()), ("data", pa.string())]))
    return pa.array(
        [None if p is None else body_candidates(json.loads(p)) for p in payloads.to_pylist()], kind
    )


def body_text(payload_json: Column, bare: bool = True) -> Column:
    """Plain body of a payload; '' when no part has any.  ``bare``: see ``html.unescape``."""

    def decode(part: Column) -> Column:
        text = F.coalesce(utf8_text(base64url_decode(part["data"])), F.lit(""))
        return F.when(part["html"], html_to_text(strip_tracking_pixels(text), bare)).otherwise(text)

    texts = F.filter(F.transform(_candidates(payload_json), decode), lambda t: t != "")
    return F.coalesce(F.try_element_at(texts, F.lit(1)), F.lit(""))


def attachment_parts(parts: Column) -> Column:
    """Top-level parts with a file name and an attachment id."""
    empty = F.array().cast(T.ArrayType(PART))
    return F.filter(
        F.coalesce(parts, empty),
        lambda p: (F.coalesce(p["filename"], F.lit("")) != "")
        & (F.coalesce(p["body"]["attachmentId"], F.lit("")) != ""),
    )


def is_inline(part: Column) -> Column:
    """Content-Disposition (name in any case, last one wins) mentions inline."""
    lines = F.filter(
        F.coalesce(part["headers"], F.array().cast(T.ArrayType(HEADER))),
        lambda h: F.lower(h["name"]) == "content-disposition",
    )
    last = F.try_element_at(lines, F.lit(-1))["value"]
    return F.coalesce(F.lower(last).contains("inline"), F.lit(False))
