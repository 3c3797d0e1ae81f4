"""HTML to plain text with JVM regexes.

Text runs between tags and comments are stripped, empty ones dropped, the rest
joined by one blank.  Style sheets, templates and ruby annotations hold no body
text.  Character references are resolved after tags are gone, so an escaped
"&lt;" never turns into a tag.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom.functions.text import from_windows_1252, strip

# U+E000 is a private-use character; any that the text holds itself is dropped first.
_GAP = "\ue000"
# Possessive runs: the engine must not recurse once per character of a long attribute.
_TAG = r"""</?[A-Za-z][^'">]*+(?:(?:"[^"]*"|'[^']*')[^'">]*+)*+>"""
_HIDDEN = r"<(style|template|rt|rp)\b[^>]*>.*?(?:</\1\s*>|\z)"
_COMMENT = r"<!--.*?-->|<![^>]*>|<\?[^>]*>"
# The references that almost all mail uses are plain replacements; "&amp;" comes last.
_COMMON = (
    ("&nbsp;", "\u00a0"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&copy;", "\u00a9"),
    ("&middot;", "\u00b7"),
)


def _named_references() -> Column:
    """name -> character for every reference the standard library knows."""
    table = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    return F.from_json(F.lit(_json(table)), "map<string,string>")


def _json(table: dict[str, str]) -> str:
    import json

    return json.dumps(table)


def unescape(c: Column, bare: bool = True) -> Column:
    """Resolve character references; unknown names stay as written without their ';'.

    ``bare``: references that no ';' ends count too, as browsers have it; else they stay as written.
    """
    rare = F.regexp_replace(c, "&amp;", "")
    for ref, _ in _COMMON:
        rare = F.replace(rare, F.lit(ref), F.lit(""))
    simple = c
    for ref, char in _COMMON:
        simple = F.replace(simple, F.lit(ref), F.lit(char))
    simple = F.replace(simple, F.lit("&amp;"), F.lit("&"))
    gate = r"&#?\w" if bare else r"&#?\w+;"
    return F.when(rare.rlike(gate), _unescape_any(c, ";?" if bare else ";")).otherwise(simple)


def _unescape_any(c: Column, end: str) -> Column:
    """Split at '&' and resolve each piece's leading reference, ``end`` included, through the full table."""
    pieces = F.split(c, "&")
    table = _named_references()

    def resolve(p: Column, i: Column) -> Column:
        # Leading zeros do not count; more digits than any code point has are out of range.
        decimal = F.regexp_extract(p, rf"^#0*([0-9]+){end}", 1)
        hexa = F.regexp_extract(p, rf"^#[xX]0*([0-9A-Fa-f]+){end}", 1)
        name = F.regexp_extract(p, rf"^([A-Za-z][A-Za-z0-9]*){end}", 1)
        rest = F.regexp_replace(p, rf"^(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*){end}", "")
        known = F.element_at(table, name)
        beyond = F.lit(0x110000)
        code = F.coalesce(
            F.when(F.length(decimal) > 7, beyond).when(decimal != "", decimal.cast("int")),
            F.when(F.length(hexa) > 6, beyond).when(hexa != "", F.conv(hexa, 16, 10).cast("int")),
        )
        return (
            F.when(i == 0, p)
            .when(code.isNotNull(), F.concat(_code_point(code), rest))
            .when(known.isNotNull(), F.concat(known, rest))
            .when(name != "", F.concat(F.lit("&"), name, rest))
            .otherwise(F.concat(F.lit("&"), p))
        )

    return F.array_join(F.transform(pieces, resolve), "")


def _code_point(code: Column) -> Column:
    """Character of a code point, through its UTF-32 bytes; 128 to 159 are read as windows-1252."""
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    utf32 = F.unhex(F.lpad(F.hex(code), 8, "0"))
    return F.when(valid, from_windows_1252(F.decode(utf32, "UTF-32"))).otherwise(F.lit("\ufffd"))


def html_to_text(html: Column, bare: bool = True) -> Column:
    """Plain text of a page; for ``bare`` see ``unescape``."""
    text = F.replace(html, F.lit(_GAP), F.lit(""))
    text = F.regexp_replace(text, f"(?is){_COMMENT}|{_HIDDEN}|{_TAG}", _GAP)
    runs = F.filter(
        F.transform(F.split(text, _GAP), lambda r: strip(unescape(r, bare))), lambda r: r != ""
    )
    return F.array_join(runs, " ")
