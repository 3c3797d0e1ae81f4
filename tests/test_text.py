"""Text operators: hand-written edge cases, and Java regexes against Python's on real texts."""

from __future__ import annotations

import base64
import json
import re
import sys
import unicodedata
from html.parser import HTMLParser

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from postroom import fixed_values as fv
from postroom.catalog import QUERIES
from postroom.functions import chunking, headers, html, language, mime, redaction, text, tiering, tokens
from postroom.providers import CharTokenizer, PatternNer, Prompts, read_entities
from postroom.sources import given, notices

V = F.col("v")
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.mark.parametrize(
    "body, kept",
    [
        ("Hi\n\nSent from my iPhone", "Hi"),
        ("Hi\nGet Outlook for iOS", "Hi"),
        ("Hi\nSent from Mail for iOS x", "Hi"),
        ("Hi\n____\nFrom: a@b", "Hi"),
        ("Hi \n -- \nJane", "Hi"),
        ("Hi\n______", "Hi"),
        ("Hi\n-\n\n", "Hi"),
        ("Hi\nThis email is confidential", "Hi"),
        ("Hi\nDisclaimer : x", "Hi"),
        ("Hi\nCONFIDENTIALITY  NOTICE: x", "Hi"),
        ("Hi\nIf you have received this e-mail in error, y", "Hi"),
        ("Hi\nPlease consider the environment before printing", "Hi"),
        ("Hi\nPrivacy matters to all of us\nmore", "Hi"),
        ("Hi -- Jane", "Hi -- Jane"),
        ("   ", "   "),
        ("", ""),
    ],
)
def test_signatures(column, body, kept):
    assert column([body], text.strip_signatures(V)) == [kept]


@pytest.mark.parametrize(
    "body, kept",
    [
        ("Hi\n\nOn Mon A wrote:\n> x", "Hi"),
        ("Hi\n___\nFrom: a", "Hi"),
        ("Hi\n--- Original Message ---\nx", "Hi"),
        ("Hi\n__\nFrom: a", "Hi"),
        ("Hi\nOn 1/2/2024 someone\nx", "Hi"),
        ("Hi\n---------- Forwarded message ----------\nx", "Hi"),
        ("Hi\nBegin forwarded message: x", "Hi"),
        ("  Hi there \n", "Hi there"),
        (" lead\nOn 1/2/24 x\n", " lead"),
        (" \n", " \n"),
    ],
)
def test_quotes(column, body, kept):
    assert column([body], text.strip_quoted_replies(V)) == [kept]


def test_tracking(column):
    cases = {
        '<p>a</p><img src="https://x/y.png" width=600>': None,
        '<img  width="1" src="a">b': "b",
        "<IMG style='height: 1px' src=a>b": "b",
        '<img src="http://t.example/open?x">b': "b",
        "<script>var a;</script>x<iframe src=q></iframe><object></object><embed>": "var a;x",
        "  ": None,
        '<img alt="click" src="ok.png">': None,
    }
    got = column(list(cases), text.strip_tracking_pixels(V))
    assert got == [k if v is None else v for k, v in cases.items()]
    urls = ["see HTTP://a.example/Unsubscribe?x=1 end", "http://a.example/page", "no url"]
    assert column(urls, text.strip_tracking_urls(V)) == ["see [LINK] end", urls[1], urls[2]]


def test_invisible_and_strip(column):
    raw = "a​b﻿c\u0007d\te\nf\rg‮hi\u0085j"
    want = "".join(
        c for c in raw if c in " \t\n\r" or unicodedata.category(c) not in ("Cf", "Cc", "Co", "Cn")
    )
    assert column([raw], text.strip_invisible(V)) == [want]
    blanks = ["　 x  \x1c", "\x1f\x85", "", "in side"]
    assert column(blanks, text.strip(V)) == [b.strip() for b in blanks]
    assert column([*blanks, None], text.has_text(V)) == [True, False, False, True, False]


def test_clean_body_switches(column):
    body = " Hello​ https://x.example/click/1\n-- \nJane\nOn 1/2/2024 x\n> y"
    assert column([body, None], text.clean_body(V)) == ["Hello [LINK]", ""]
    kept = text.clean_body(V, quotes=False, signatures=False, tracking=False, invisible=False)
    assert column([body], kept) == [body.strip()]
    model = text.clean_body(V, extract_main=lambda c: F.when(c.isNotNull(), F.lit(" core ")))
    assert column([body, "x" * 13000], model) == ["core", "core"]  # no text is left out by default
    bounded = text.clean_body(V, extract_main=lambda c: F.when(c.isNotNull(), F.lit(" core ")), extract_most=12_000)
    assert column([body, "x" * 13000], bounded) == ["core", "x" * 13000]


PII_CASES = {
    "mail josé.núñez@exämple.org now": "mail [EMAIL] now",
    "ssn 123-45-6789": "ssn [PHONE]",
    "card 4111 1111 1111 1111": "card [PHONE]",
    "card 4111\t1111\t1111\t1111": "card [CARD]",
    "id 123456789.": "id [ID].",
    "short 12345678": "short 12345678",
    "call +1 (555) 0": "call +1 (555) 0",
}
SECRET_CASES = {
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----": "[REDACTED]",
    "auth: bearer abc.def-ghi==": "auth: [REDACTED]",
    "access_token: aa.bb.cc": "access_[REDACTED]",
    "API-KEY = zzz9": "[REDACTED]",
    "Passwd : hunter2 x": "[REDACTED] x",
    "AB12-CD34-EF56-GH78": "[REDACTED]",
    "ABCDE-12345-ABCDE-12345-ABCDE": "[REDACTED]",
    "h " + "a1" * 16: "h [REDACTED]",
    "b " + "Zz" * 11 + " e": "b [REDACTED] e",
    "Serial  Number: X-1": "[REDACTED]",
    "go http://a.example/token=1 ok": "go [LINK] ok",
    "ToKen=abc": "[REDACTED]",
    "acceſs_token=a.b.c": "acceſs_[REDACTED]",
}


def chain(rules, value):
    for pattern, token, flags in rules:
        value = re.sub(pattern, token, value, flags=flags)
    return value


PII_RULES = [(p, t, 0) for p, t in fv.PII]
SECRET_RULES = [(p, t, re.I if i else 0) for p, t, i in (fv.LINK, *fv.SECRETS)]


def test_redaction_cases(column):
    assert column(list(PII_CASES), redaction.redact_pii(V)) == list(PII_CASES.values())
    got = column(list(SECRET_CASES), redaction.redact_secrets(V))
    assert got == [chain(SECRET_RULES, c) for c in SECRET_CASES]
    assert got[:11] == list(SECRET_CASES.values())[:11]


def test_redaction_equals_python_on_real_texts(spark, sf):
    rows = given.mail_bodies(spark, sf).select(
        "body_text",
        redaction.redact_pii(F.col("body_text")).alias("pii"),
        redaction.redact_secrets(F.col("body_text")).alias("sec"),
        redaction.redact_for_display(F.col("body_text")).alias("both"),
        text.strip_tracking_urls(F.col("body_text")).alias("links"),
    )
    for r in rows.collect():
        pii = chain(PII_RULES, r.body_text)
        assert r.pii == pii
        assert r.sec == chain(SECRET_RULES, r.body_text)
        assert r.both == chain(SECRET_RULES, pii)
        assert r.links == re.sub(fv.TRACKING_URL, "[LINK]", r.body_text, flags=re.I)
        assert not re.search(fv.PII[0][0], r.pii)


def test_word_edges_of_the_redacting_queries(spark, tmp_path):
    run, kept = "erschlichereinbelichen", "\u00e9" + "erschlichereinbelichen" + "\u00e9"
    texts = [f"x {run} y", f"x {run}\u00dfen y", f"\u00e9{run} y", "x 123456789\u00fc y"]
    spark.createDataFrame([(9 * i, "de", "web", t) for i, t in enumerate(texts)], "doc_id long, lang string, source string, text string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    want = ["x [REDACTED] y", "x [REDACTED]\u00dfen y", "\u00e9[REDACTED] y", "x 123456789\u00fc y"]
    ids = [*want[:3], "x [ID]\u00fc y"]
    for name, texts_found in (("redact_secrets", want), ("redact_for_display", ids), ("redact_entities", ids), ("snippet_by_tier", ids)):
        found = {r["id"] // 9: r[1] for r in QUERIES[name](spark, str(tmp_path)).collect()}
        for i, text_found in enumerate(texts_found):
            assert found[i] == "Content redacted" if name == "snippet_by_tier" and i in (1, 2) else found[i].startswith(text_found)
    # The operator itself follows Unicode, as the reference does.
    assert spark.createDataFrame([(kept,)], "v string").select(redaction.redact_secrets(V)).first()[0] == kept


def test_entities(column):
    assert read_entities({"ents": [{"start_char": 3, "end_char": 9, "type": "person"}]}) == [
        {"start": 3, "end": 9, "label": "PERSON"}
    ]
    assert read_entities([{"start": 0, "end": 0, "label": "org"}, "x", {"end": 4}]) == [
        {"start": 0, "end": 0, "label": "ORG"}
    ]
    spans = [
        {"start": 0, "end": 2, "label": "PERSON"},  # too short
        {"start": 3, "end": 8, "label": "PERSON"},  # contraction
        {"start": 9, "end": 15, "label": "GPE"},
        {"start": 15, "end": 99, "label": "ORG"},  # past the end
        {"start": 16, "end": 20, "label": "DATE"},  # not a redacted kind
    ]
    assert redaction.replace_entities("Jo can't Berlin 2024", spans) == "Jo can't [GPE] 2024"
    got = column(
        ["Dr. Alice Smith of Acme Data GmbH in Paris", None],
        redaction.redact_for_display(V, F.lit("en"), PatternNer()),
    )
    assert got == ["Dr. [PERSON] of [ORG] in [GPE]", ""]


def test_snippets(spark):
    df = spark.createDataFrame(
        [(" a@b.cd ", 3), ("x", 1), ("x", 2), ("  ", 3), (None, 3), ("x", None)], "v string, t int"
    )
    out = [r[0] for r in df.select(redaction.snippet_for_tier(V, F.col("t"))).collect()]
    assert out == ["[EMAIL]", "Content redacted", "Content redacted", None, None, "x"]


TIERS = {
    "SENSITIVE": "SENSITIVE",
    " personal\n": "PERSONAL",
    "Public. Because": "PUBLIC",
    "NOT PUBLIC": "PUBLIC",
    "this is PRIVATE": "PERSONAL",
    "<think>SENSITIVE?</think>PUBLIC": "PUBLIC",
    "<th<think>x</think>ink>a</think> PERSONAL": "PERSONAL",
    "<thinking a=1>SENSITIVE": "SENSITIVE",
    "<think>nothing": None,
    "": None,
    "dunno": None,
}


def test_tier_answers(column):
    assert column(list(TIERS), tiering.parse_tier(V)) == list(TIERS.values())
    names = column(["1", "2", "3", "9"], tiering.tier_name(V.cast("int")))
    assert names == ["SENSITIVE", "PERSONAL", "PUBLIC", "9"]


def test_tier_rules(spark):
    cases = [
        ("a@b.example", "x", "Your password is XYZ123", "SENSITIVE"),
        ("a@b.example", "x", "Please reset your password", "PUBLIC"),
        ("no-reply@b.example", "x", "Can you look?", "PUBLIC"),
        ("Shop <newsletter@b.example>", "Hi?", "y", "PUBLIC"),
        ("ann@b.example", "Lunch", "Could you join the meeting", "PERSONAL"),
        ("", "x", "Can you look?", "PUBLIC"),
    ]
    df = spark.createDataFrame(cases, "s string, t string, b string, want string")
    got = df.select(tiering.rule_based_answer(F.col("s"), F.col("t"), F.col("b")), "want").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


class WordTokenizer:
    """A tokenizer that needs the text itself."""

    length_based = False

    def open(self):
        return str.split


class CountedChars:
    """The default count through the generic path."""

    length_based = False

    def open(self):
        return lambda t: range(-(-len(t) // 4))


@pytest.mark.parametrize("budget", [60, 300, 900, 2000])
def test_fit_body_native_equals_rowwise(spark, sf, budget):
    d = given.table(spark, sf, "documents").select(F.trim("text").alias("b")).where("b <> ''")
    frame = F.lit("prompt " * 20)
    native = tiering.fit_body(F.col("b"), frame, CharTokenizer(), budget)
    generic = tiering.fit_body(F.col("b"), frame, CountedChars(), budget)
    rows = d.select("b", native.alias("n"), generic.alias("g")).collect()
    assert [r.n for r in rows] == [r.g for r in rows]
    assert any(r.n != r.b for r in rows)


def test_truncate(spark, column):
    body = "word " * 400
    t = CharTokenizer()
    assert column([body, "short", None], tokens.truncate(V, t, 1000, 100)) == [
        body[:400], "short", None,
    ]
    assert column([body], tokens.truncate(V, WordTokenizer(), None, 100)) == [
        tokens.fit_to_tokens(body, str.split, 100)
    ]
    assert column([body, ""], tokens.token_count(V, WordTokenizer())) == [400, 0]


def test_chunking(spark, column, sf):
    t = CharTokenizer()
    body = "A" * 30 + ".\r\n\r\n" + "B" * 30 + ". " + "C" * 90 + "! tail?\n \n" + "D" * 8
    (made,) = column([body], chunking.chunk_body(V, t, 20, 16))
    assert [c["text"] for c in made] == [
        "A" * 30 + ".\n\n" + "B" * 30 + ".", "C" * 90 + "!", "tail?\n\n" + "D" * 8,
    ]
    assert [(c["position"], c["weight"]) for c in made] == [(0, 2.0), (1, 1.0), (2, 1.0)]
    assert column(["fits", " ", None], chunking.chunk_body(V, t, 20, 16)) == [[], [], []]
    d = given.table(spark, sf, "documents").select("text")
    both = d.select(
        "text",
        chunking.chunk_body(F.col("text"), t, 200, 150).alias("native"),
        chunking.chunk_body(F.col("text"), CountedChars(), 200, 150).alias("generic"),
    ).collect()
    for r in both:
        assert r.native == r.generic
        if r.native:
            whole = "".join(c["text"] for c in r.native)
            assert re.sub(r"\s", "", whole) == re.sub(r"\s", "", r.text)
    kinds = column(["", "abc", "x" * 100], chunking.body_kind(V, t, 20))
    assert kinds == ["none", "full", "chunked"]


class _Text(HTMLParser):
    """Independent HTML reader: text runs between tags, style and template left out."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.runs, self.current, self.hidden = [], "", 0

    def flush(self):
        if self.current.strip():
            self.runs.append(self.current.strip())
        self.current = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.hidden += tag in ("style", "template")

    def handle_endtag(self, tag):
        self.flush()
        self.hidden -= tag in ("style", "template") and self.hidden > 0

    def handle_startendtag(self, tag, attrs):
        self.flush()

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_comment

    def handle_data(self, data):
        if not self.hidden:
            self.current += data

    def handle_entityref(self, name):
        import html as h

        known = h.unescape(f"&{name};")
        self.current += f"&{name}" if known.endswith(";") and known.startswith("&") else known

    def handle_charref(self, name):
        import html as h

        self.current += h.unescape(f"&#{name};")


def python_html_text(source):
    p = _Text()
    p.feed(source)
    p.close()
    p.flush()
    return " ".join(p.runs)


HTML_CASES = [
    "<p>a &amp; b&nbsp;</p><!-- c --><b> d </b>e",
    "x &lt;b&gt; &eacute;&#233;&#xE9; &foo; &copy;",
    '<a title="a > b">t</a><style>p{}</style>u<template><i>v</i></template>w',
    "a&amp;lt;b",
    "1 < 2 and <br/>3",
    "<!DOCTYPE html><html><body>  </body></html>",
    "&Aacute;&frac12;&hellip;",
]


def test_html_cases(column):
    assert column(HTML_CASES, html.html_to_text(V)) == [python_html_text(c) for c in HTML_CASES]


def test_html_pages_equal_the_standard_parser(spark, sf):
    stripped = text.strip_tracking_pixels(F.col("html"))
    rows = given.table(spark, sf, "pages").select(
        stripped.alias("s"), html.html_to_text(stripped).alias("t")
    )
    for r in rows.collect():
        assert r.t == python_html_text(r.s)


def test_payload_bodies(spark, column):
    import base64
    import json

    def part(kind, content=None, parts=None):
        out = {"mimeType": kind, "body": {}}
        if content is not None:
            out["body"] = {"data": base64.urlsafe_b64encode(content.encode()).decode()}
        if parts is not None:
            out["parts"] = parts
        return out

    plain, rich = part("text/plain", "täxt>>>???"), part("text/html", "<b>h</b>i")
    payloads = {
        json.dumps(plain): "täxt>>>???",
        json.dumps(rich): "h i",
        json.dumps(part("multipart/alternative", parts=[plain, rich])): "täxt>>>???",
        json.dumps(part("multipart/mixed", parts=[part("text/plain", "a"), part("text/plain", "b")])): "b",
        json.dumps(
            part("multipart/mixed", parts=[plain, part("multipart/alternative", parts=[rich])])
        ): "h i",
        json.dumps(
            part("multipart/mixed", parts=[part("m/x", parts=[part("text/html", "<p> </p>")]), plain])
        ): "täxt>>>???",
        json.dumps(part("multipart/mixed", parts=[part("text/plain"), rich])): "h i",
        json.dumps(part("image/png", parts=[])): "",
    }
    deep = part("text/plain", "deep")
    for _ in range(12):
        deep = part("multipart/mixed", parts=[deep])
    payloads[json.dumps(deep)] = "deep"
    assert column(list(payloads), mime.body_text(V)) == list(payloads.values())


def test_addresses(column):
    froms = ['"Doe, J" <j@x.example>', " a@b.example ", "Plain Name", "", None, "'Q' < q@x.example >"]
    got = column(froms, headers.parse_address(V))
    assert [(r["email"], r["name"]) for r in got] == [
        ("j@x.example", "Doe, J"), ("a@b.example", ""), ("", "Plain Name"), ("", ""), ("", ""),
        ("q@x.example", "Q"),
    ]
    lists = ['"A, B" <a@x.example>,  c@x.example , none, D <d@x.example>', "", None]
    assert column(lists, headers.parse_address_list(V)) == [
        ["a@x.example", "c@x.example", "d@x.example"], [], [],
    ]


def test_dates(column):
    from email.utils import parsedate_to_datetime

    good = [
        "Mon, 1 Jan 2024 10:00:00 +0000", "1 Feb 2023 1:02:03 -0530", "Tue, 29 Feb 2000 23:59 GMT",
        "Fri, 05 Jul 2024 08:00:00 +0200 (CEST)", "3 mar 99 10:00:00 EST",
    ]
    shown = column([*good, "nonsense", "", None, "31 Foo 2024 10:00:00 +0000"],
                   F.date_format(headers.parse_date(V), "yyyy-MM-dd HH:mm:ss"))
    from datetime import timezone

    want = [
        parsedate_to_datetime(g).astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S") for g in good
    ]
    assert shown == [*want, None, None, None, None]


def test_header_map_last_value_wins(spark):
    row = spark.sql(
        "select array(struct('A' as name,'1' as value), struct('a' as name,'2' as value), "
        "struct('A' as name,'3' as value)) as h"
    ).select(headers.header_map(F.col("h")).alias("m")).first()
    assert row["m"] == {"A": "3", "a": "2"}


def test_language(column):
    texts = ["the cat and the dog of this house", "der Hund und die Katze ist nicht", "", "12 34"]
    assert column(texts, language.detect_language(V)) == ["en", "de", "en", "en"]
    rule = language.resolve_language(F.lit("x"), V, F.lit(0.9))
    assert column(["de_DE", "F", "12", None, "PT"], rule) == ["de", "en", "en", "en", "pt"]
    assert column(["de"], language.resolve_language(F.lit("x"), V, F.lit(0.4))) == ["en"]


def test_language_quality(spark, sf):
    d = given.table(spark, sf, "documents")
    right = d.select((language.detect_language(F.col("text")) == F.col("lang")).alias("ok"))
    assert right.agg(F.avg(F.col("ok").cast("int"))).first()[0] > 0.9


def test_prompts(tmp_path):
    (tmp_path / "classification_system.md").write_text(" sys {output_labels} \n")
    (tmp_path / "classification_user.md").write_text("{sender}")
    p = Prompts.load(tmp_path)
    assert (p.system, p.user_template) == ("sys {output_labels}", "{sender}\n")


def test_gates_never_hide_a_match(spark, column):
    """Every character that the regex engine equates with a letter passes the gates like that letter."""
    letters = [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
    equal = [ch for ch, hit in zip(letters, column(letters, V.rlike("^(?Ui)[a-z]$")), strict=True) if hit]
    assert set("\u0130\u0131\u017f\u212a") <= set(equal)
    base = ["api_key=abcd1234efgh", "license key: ABCD99", "Bearer abcdef", "access_token=a.b.c", "auth-token: zzz", "passwd = x",
            "serial number: A1", "activation key A1", "secret_key=abc", "product key: k1"]
    texts = list(base)
    for ch in equal:
        twin = column([ch], F.lower(F.translate(V, "\u0130\u0131\u017f\u212a", "iisk")))[0]
        texts += [t.replace(twin, ch) for t in base] + [t.upper().replace(twin.upper(), ch) for t in base]
    ungated = V
    for pattern, token, ignore in (fv.LINK, *fv.SECRETS):
        ungated = F.regexp_replace(ungated, f"(?{'Ui' if ignore else 'U'}){pattern}", token)
    plain = column(texts, ungated)
    assert column(texts, redaction.redact_secrets(V)) == plain
    assert all("[REDACTED]" in p for p in plain[: len(base)])
    leaks = ["AP\u0130_KEY=abcd1234efgh", "l\u0131cense key: ABCD99", "L\u0130CENSE KEY: ABCD99"]
    assert all("[REDACTED]" in t for t in column(leaks, redaction.redact_secrets(V)))


def test_overlapping_and_odd_entity_spans():
    spans = [{"start": 0, "end": 10, "label": "ORG"}, {"start": 4, "end": 8, "label": "GPE"}, {"start": 10, "end": 12, "label": "LOC"},
             {"start": -1, "end": 3, "label": "ORG"}, {"start": 9, "end": 7, "label": "ORG"}]
    assert redaction.replace_entities("0123456789abcdef", spans) == "[ORG][LOC]cdef"
    assert redaction.replace_entities("plain", []) == "plain"


def test_html_references_of_old_mail(column):
    texts = ["it&#146;s", "x&#00000038;y", "&#x0000041;", "&#99999999999;", "&#x110000;", "&#129;", "&#150;&#8211;", "&#0;"]
    assert column(texts, html.unescape(V)) == ["it\u2019s", "x&y", "A", "\ufffd", "\ufffd", "\x81", "\u2013\u2013", "\ufffd"]


def test_references_without_an_end(spark, column, tmp_path):
    texts = ["a &amp b", "&lt;&eacute &eacute;", "&#65 &#65;&#x41 &#x41;", "&amp;amp", "AT&T"]
    assert column(texts, html.unescape(V, bare=False)) == ["a &amp b", "<&eacute \u00e9", "&#65 A&#x41 A", "&amp", "AT&T"]
    page = "<p>x&amp;&amp<script>y</script></p>"
    spark.createDataFrame([(1, page)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    for name in ("html_text", "html_message_body"):  # as their SQL has it
        assert QUERIES[name](spark, str(tmp_path)).first()["body"] == "x&&ampy"


def test_bad_bodies_and_notices_stop_nothing(spark, column):
    latin = base64.urlsafe_b64encode("caf\u00e9 \u20ac".encode("cp1252")).decode()
    assert column([latin, "!!!", None, ""], mime.utf8_text(mime.base64url_decode(V))) == ["caf\u00e9 \u20ac", None, None, ""]
    part = lambda d: json.dumps({"mimeType": "text/plain", "body": {"data": d}})
    assert column([part(latin), part("!!!"), part("")], mime.body_text(V)) == ["caf\u00e9 \u20ac", "", ""]
    encode = lambda b: base64.b64encode(b).decode()
    datas = [encode(b'{"emailAddress": "a@b.c", "historyId": 7}'), "%%%", encode(b"\xff\xfe"), encode(b"[]"), encode(b'{"x": 1}'),
             encode(b'{"emailAddress": '), None, encode(b"7")]
    raw = spark.createDataFrame(list(enumerate(datas)), "message_id int, data string")
    got = {r.message_id: (r.status, r.email_address, r.history_id) for r in notices.decode(raw).collect()}
    assert got[0] == ("ok", "a@b.c", 7) and got[4] == ("ok", None, None)
    assert {i for i, g in got.items() if g[0] == "bad"} == {1, 2, 3, 5, 6, 7}


def test_fit_text_equals_the_column_form(column):
    for n in (0, 3, 90, 399, 1500, 6000):
        body = "".join(chr(97 + i % 26) for i in range(n))
        for budget in (20, 60, 300, 900):
            want = column([body], tiering.fit_body(V, F.lit("frame "), CharTokenizer(), budget))[0]
            count = lambda p, b=budget: -(-len("frame " + p) // 4) <= b
            got = tiering.fit_text(body, count)
            assert got == want, (n, budget)
