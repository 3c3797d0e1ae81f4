"""Secret scans over an incremental ledger of content-addressed texts (operator 8).

A text's address is its SHA-256.  Every address is scanned once per rule version, however many
paths or historical versions hold it; the ledger, a Parquet table, keeps what each scan found, and
findings are joined back to all paths.  Only DataFrame functions are used.

A rule's matches are ``regexp_extract_all``; the text between them is ``split`` by the same
pattern, so running sums of both lengths give the places.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from postroom.llm.registry import prepare, query, table
from postroom.session import new_work_dir


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters.

    ``gate`` is a cheaper pattern that every text with a match also matches.
    """

    kind: str
    pattern: str
    gate: str
    group: int = 0
    least: int = 1


BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"(?i:passw|secret|token|api_?key)",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA", least=20),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{24}", least=24),
)
# Public token formats beside the three base kinds.
EXTRA = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----", "-----BEGIN "),
    Rule("github", r"(?:gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{82})", "gh[pousr]_|github_pat_"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", "xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", "eyJ"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", "AIza"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", "k_live_"),
)
RULES = BASE + EXTRA
#: Changes with every change of a rule, so that known texts are scanned again.
VERSION = "1"

_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
LEDGER = f"blob string, rule_version string, spans {_SPANS}"


def rule_spans(text: Column, number: int, rule: Rule) -> Column:
    """Array of (start, kind, end) in code points, end exclusive, of one rule's matches."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, rule.pattern, -1)
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    parts = F.arrays_zip(whole.alias("w"), between.alias("b"), held.alias("h"))
    none = F.expr(f"cast(array() as {_SPANS})")

    def step(state: Column, part: Column) -> Column:
        # The last part has text but no match.
        start = state["at"] + F.length(part["b"])
        end = start + F.coalesce(F.length(part["w"]), F.lit(0))
        found = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        spans = F.when(F.length(part["h"]) >= rule.least, F.concat(state["spans"], F.array(found))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    folded = F.aggregate(parts, start, step, lambda s: s["spans"])
    return F.when(F.regexp_like(text, F.lit(rule.gate)), folded).otherwise(none)


def scan_texts(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``texts`` (blob, text) to (blob, spans); spans by start, then kind as listed; none for null."""
    found = [rule_spans(F.col("text"), i, r) for i, r in enumerate(rules)]
    return texts.select("blob", F.array_sort(F.concat(*found)).alias("spans"))


def may_hold(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where a text passes a rule's gate, never null."""
    return reduce(or_, [F.regexp_like(F.coalesce(text, F.lit("")), F.lit(r.gate)) for r in rules])


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:  # nothing has been scanned yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """Scan the texts of ``versions`` (text) that the ledger lacks for this rule version; returns it.

    A text that passes no rule's gate is done with where it is read: only its address goes on.  The
    rows of one text meet in a partial aggregate, so thousands of copies shuffle as one row per task.
    A run that is repeated finds nothing to scan; one writer at a time may use a ledger.  Null texts
    count as empty.
    """
    spark = versions.sparkSession
    known = _ledger(spark, path).where(F.col("rule_version") == version).select("blob").distinct()
    text = F.coalesce("text", F.lit(""))
    addressed = versions.select(F.sha2(text, 256).alias("blob"), F.when(may_hold(text, rules), text).alias("text"))
    # Copies are merged before anything is joined: a join first would send them all to one task.
    blobs = addressed.groupBy("blob").agg(F.any_value("text").alias("text"))
    unseen = blobs.join(known, "blob", "left_anti")
    scanned = scan_texts(unseen, rules).select("blob", F.lit(version).alias("rule_version"), "spans")
    scanned.write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path).where(F.col("rule_version") == version)


def scan_paths(
    versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, version: str = VERSION, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep`` of every row of ``versions`` with the ``spans`` of its text.

    Rows without a finding have an empty array, also those of null or empty text; repeated rows are
    returned each; no rows give no rows.  Columns beside ``keep`` and text are ignored.
    """
    prepare(versions.sparkSession)
    ledger = update_ledger(versions, path, rules, version).where(F.size("spans") > 0)
    found = ledger.select(F.col("blob").alias("_seen"), F.col("spans").alias("_spans"))
    own = versions.select(*keep, F.sha2(F.coalesce("text", F.lit("")), 256).alias("_blob"))
    joined = own.join(found, F.col("_blob") == F.col("_seen"), "left")
    return joined.select(*keep, F.coalesce("_spans", F.expr(f"cast(array() as {_SPANS})")).alias("spans"))


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def mask(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """``text`` with every span, overlapping ones as one, replaced."""

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        kept = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        out = F.when(fresh, F.concat(state["out"], kept, F.lit(by))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, rest))


def _ascii_cases(pattern: str) -> str:
    """The same pattern for an engine whose ``(?i)`` folds beyond ASCII (long s, Kelvin sign)."""
    head, mark, rest = pattern.partition("(?i:")
    if not mark:
        return pattern
    keys, close, rest = rest.partition("))")
    return head + "(?:" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in keys) + close + rest


def _sql_rule(number: int, rule: Rule) -> str:
    pattern = _ascii_cases(rule.pattern).replace("'", "''")
    whole = f"regexp_extract_all(text, '{pattern}')"
    held = f"regexp_extract_all(text, '{pattern}', {rule.group})"
    return f"""
  select doc_id, {number} as kind, '{rule.kind}' as name, starts[i] as s, starts[i] + length(whole[i]) as e from (
    select doc_id, whole, held, list_transform(range(1, len(whole) + 1), lambda i:
      cast(list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) as bigint)) as starts
    from (select doc_id, {whole} as whole, {held} as held, string_split_regex(text, '{pattern}') as between
          from (select doc_id, coalesce(text, '') as text from documents) where regexp_matches(text, '{pattern}'))
  ), unnest(range(1, len(whole) + 1)) as u(i) where length(held[i]) >= {rule.least}"""


ORACLE = (
    "with found as ("
    + " union all ".join(_sql_rule(i, r) for i, r in enumerate(RULES))
    + """), per as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
    coalesce(string_agg(name || ':' || s || ':' || e, ',' order by s, kind) filter (kind < 3), '') as base,
    string_agg(name || ':' || s || ':' || e, ',' order by s, kind) as spans
  from found group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join per using (doc_id)"""
)


@query("op8_secrets", ORACLE)
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan_paths(docs, f"{new_work_dir(spark, 'secrets')}/ledger")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = [F.expr(f"cast(size(filter(spans, s -> s.kind = {i})) as bigint)").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *count, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
