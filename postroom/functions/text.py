"""Text cleaning as Catalyst column expressions (no Python in the data path).

All regexes run with ``(?U)`` so classes and word boundaries follow Unicode, and
with ``(?d)`` wherever ``$`` occurs so only LF counts as a line end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom import fixed_values as fv

# White space as the mail contract sees it: Unicode White_Space plus U+001C..U+001F.
NON_WS = r"[^\s\x1c-\x1f]"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Catalyst inlines column expressions, so an expensive value that is used twice
    would be computed twice; binding it to a lambda variable prevents that.  A body must
    not refer to another let's variable from within a nested lambda: such expressions
    cannot be the input of a Python step.  Bind a struct instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def has_text(c: Column) -> Column:
    """True when the value is non-null and holds at least one non-space character."""
    return F.coalesce(c.rlike(f"(?U){NON_WS}"), F.lit(False))


def strip(c: Column) -> Column:
    """Trim a fixed character set: looks at the two ends only, no regex over the text."""
    return F.trim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def fold_case(c: Column) -> Column:
    """Lower case in which every character that a case-insensitive regex equates with a Latin letter is that letter.

    Those are the dotted capital and the dotless small i, the long s and the Kelvin sign.
    """
    return F.lower(F.translate(c, "\u0130\u0131\u017f\u212a", "iisk"))


# The bytes that windows-1252 assigns to characters and ISO 8859-1 to controls.
_OLD_BYTES = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]


def from_windows_1252(latin: Column) -> Column:
    """Text that was decoded as ISO 8859-1, with the characters of windows-1252 in their places."""
    characters = bytes(_OLD_BYTES).decode("cp1252")
    return F.translate(latin, "".join(map(chr, _OLD_BYTES)), characters)


def mentions(folded: Column, *words: str) -> Column:
    """Plain substring tests: a gate that keeps regexes off texts that cannot match."""
    cond = folded.contains(words[0])
    for w in words[1:]:
        cond = cond | folded.contains(w)
    return cond


# Java's own "\\b" follows Unicode or not by its release and flags; this one is ASCII in all of them.
_ASCII_EDGE = "(?-i:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def edged(pattern: str, ascii_only: bool = True) -> str:
    """The pattern with word edges between ASCII word characters and anything else."""
    return pattern.replace(r"\b", _ASCII_EDGE) if ascii_only else pattern


def any_of(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def cut_at_first(c: Column, patterns: Sequence[str]) -> Column:
    """Drop everything from the first match on.

    The match is extended to the end of the text, so one regex pass does both the search
    and the cut.  All patterns start with a line feed; testing that once per character
    spares trying every alternative there.
    """
    return F.regexp_replace(c, rf"(?Uisd)(?=\n)(?:{any_of(patterns)}).*\z", "")


def _cut_stripped(text: Column, patterns: Sequence[str], otherwise: Callable) -> Column:
    """The cut text without trailing white space, or ``otherwise(text)`` without a match."""
    pair = F.struct(text.alias("text"), cut_at_first(text, patterns).alias("cut"))
    return let(
        pair,
        lambda p: F.when(F.length(p["cut"]) < F.length(p["text"]), rstrip(p["cut"])).otherwise(
            otherwise(p["text"])
        ),
    )


def strip_tracking_pixels(html: Column) -> Column:
    """Drop script-like tags (their content stays) and tracking images."""
    without_tags = F.regexp_replace(html, f"(?Ui){fv.ACTIVE_TAGS}", "")
    image = rf"(?Ui)<img\s(?=[^>]*?(?:{fv.IMAGE_SIZE_ONE}|{fv.IMAGE_TRACKING_SOURCE}))[^>]*>"
    return F.when(has_text(html), F.regexp_replace(without_tags, image, "")).otherwise(html)


def strip_tracking_urls(c: Column) -> Column:
    def replace(text: Column) -> Column:
        return F.when(
            text.contains("://"), F.regexp_replace(text, f"(?Ui){fv.TRACKING_URL}", "[LINK]")
        ).otherwise(text)

    return let(c, replace)


def strip_invisible(c: Column) -> Column:
    """Remove format, control, private-use and unassigned characters; keep TAB, LF, CR."""
    return F.regexp_replace(c, r"[\p{Cf}\p{Cc}\p{Co}\p{Cn}&&[^\t\n\r]]", "")


def strip_quoted_replies(c: Column) -> Column:
    """Cut at the first quoted reply; a text without one is stripped on both sides."""

    def whole(text: Column) -> Column:
        return F.when(has_text(text), strip(text)).otherwise(text)

    return let(c, lambda text: _cut_stripped(text, fv.QUOTE_STARTS, whole))


def strip_signatures(c: Column) -> Column:
    def same(text: Column) -> Column:
        return text

    def decide(text: Column) -> Column:
        once = _cut_stripped(text, fv.SIGNATURES, same)
        twice = let(once, lambda t: _cut_stripped(t, fv.DISCLAIMERS, same))
        return F.when(has_text(text), strip(twice)).otherwise(text)

    return let(c, decide)


def clean_body(
    c: Column,
    *,
    quotes: bool = True,
    signatures: bool = True,
    tracking: bool = True,
    invisible: bool = True,
    extract_main=None,
    extract_most: int | None = None,
) -> Column:
    """The full cleaning chain that precedes redaction, chunking and embedding.

    ``extract_main`` is an optional Column -> Column model step; a null or empty answer keeps the
    input.  Under ``extract_most`` it sees null for texts of more characters (None: no bound).
    """
    text = strip(F.coalesce(c, F.lit("")))
    if invisible:
        text = strip_invisible(text)
    if tracking:
        text = strip_tracking_urls(text)
    if quotes:
        text = strip_quoted_replies(text)
    if signatures:
        text = strip_signatures(text)
    if extract_main is not None:
        # A model step cannot sit inside a lambda, so the text is named twice here.
        size = F.length(text)
        eligible = F.when((size > 0) & (F.lit(True) if extract_most is None else size <= extract_most), text)
        text = F.coalesce(F.nullif(extract_main(eligible), F.lit("")), text)
    return strip(text)
