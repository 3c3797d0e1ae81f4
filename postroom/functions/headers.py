"""Mail header values: addresses, dates, header maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom import fixed_values as fv
from postroom.functions.text import has_text, let, strip

_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec"


def parse_address(c: Column) -> Column:
    """``struct<email, name>`` of one From-like header."""

    def read(h: Column) -> Column:
        bracketed = h.rlike(fv.ADDRESS_IN_BRACKETS)
        email = strip(F.regexp_extract(h, fv.ADDRESS_IN_BRACKETS, 1))
        outside = strip(F.regexp_replace(h, fv.ADDRESS_IN_BRACKETS, ""))
        name = F.regexp_replace(outside, r"""\A["']+|["']+\z""", "")
        return (
            F.when(bracketed, F.struct(email.alias("email"), name.alias("name")))
            .when(h.contains("@"), F.struct(h.alias("email"), F.lit("").alias("name")))
            .otherwise(F.struct(F.lit("").alias("email"), h.alias("name")))
        )

    return let(strip(F.coalesce(c, F.lit(""))), read)


def parse_address_list(c: Column) -> Column:
    """Addresses of a To-like header; commas inside quotes do not separate."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), f"(?U){fv.COMMA_OUTSIDE_QUOTES}"), strip)
    found = F.transform(
        parts,
        lambda p: F.when(
            p.rlike(fv.ADDRESS_IN_BRACKETS), strip(F.regexp_extract(p, fv.ADDRESS_IN_BRACKETS, 1))
        ).when(p.contains("@"), p),
    )
    return F.filter(found, lambda x: x.isNotNull())


def parse_date(c: Column) -> Column:
    """RFC 5322 date to TIMESTAMP; null when it cannot be read.

    Java's parser has no tolerant weekday, so the weekday and a trailing zone
    comment are removed first; zone names are turned into offsets.
    """
    text = strip(F.coalesce(c, F.lit("")))
    text = F.regexp_replace(text, r"^[A-Za-z]{3,9},?\s+(?=\d)", "")
    text = F.regexp_replace(text, r"\s*\([^)]*\)\s*$", "")
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.regexp_replace(text, r"(?i) (?:GMT|UTC|UT|Z)$", " +0000")
    for zone, offset in (
        ("EST", "-0500"), ("EDT", "-0400"), ("CST", "-0600"), ("CDT", "-0500"),
        ("MST", "-0700"), ("MDT", "-0600"), ("PST", "-0800"), ("PDT", "-0700"),
    ):  # fixed values: zone names of RFC 5322
        text = F.regexp_replace(text, rf"(?i) {zone}$", f" {offset}")
    text = F.regexp_replace(text, r"(:\d\d) -0000$", "$1 +0000")
    text = F.regexp_replace(text, r"^(\d{1,2} [A-Za-z]+) ([0-5]\d|6[0-8]) ", "$1 20$2 ")
    text = F.regexp_replace(text, r"^(\d{1,2} [A-Za-z]+) (69|[7-9]\d) ", "$1 19$2 ")
    # Case of the month name is normalised; a missing seconds field becomes :00.
    text = F.regexp_replace(text, r"^(\d{1,2} [A-Za-z]{3}[a-z]* \d{4} \d{1,2}:\d\d) ", "$1:00 ")

    def read(t: Column) -> Column:
        pieces = F.split(t, " ")
        month = F.initcap(F.substring(F.try_element_at(pieces, F.lit(2)), 1, 3))
        number = F.array_position(F.split(F.lit(_MONTHS), " "), month)
        stamp = F.concat_ws(
            " ",
            F.concat_ws(
                "-",
                F.try_element_at(pieces, F.lit(3)),
                F.lpad(number.cast("string"), 2, "0"),
                F.lpad(F.try_element_at(pieces, F.lit(1)), 2, "0"),
            ),
            F.lpad(F.try_element_at(pieces, F.lit(4)), 8, "0"),
            F.coalesce(F.try_element_at(pieces, F.lit(5)), F.lit("+0000")),
        )
        shaped = t.rlike(
            r"^\d{1,2} [A-Za-z]{3}[a-z]* \d{4} \d{1,2}:\d\d:\d\d( [+-]\d{4})?$"
        ) & (number > 0)
        return F.when(shaped, F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss Z")))

    return let(text, read)


def header_map(headers: Column) -> Column:
    """``array<struct<name,value>>`` to a case-sensitive map in which the last value wins."""
    by_last = F.reverse(F.coalesce(headers, F.array().cast("array<struct<name:string,value:string>>")))
    names = F.array_distinct(F.transform(by_last, lambda h: h["name"]))
    return F.map_from_arrays(
        names,
        F.transform(
            names,
            lambda n: F.element_at(F.filter(by_last, lambda h: h["name"] == n), 1)["value"],
        ),
    )


def display_sender(name: Column, email: Column) -> Column:
    return F.when(
        has_text(name), F.concat(name, F.lit(" <"), F.coalesce(email, F.lit("None")), F.lit(">"))
    ).otherwise(F.coalesce(email, F.lit("")))
