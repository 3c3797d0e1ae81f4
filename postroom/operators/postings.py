"""A stored inverted index in segments: the counterpart of a full-text index on the email table.

A segment holds the words of some mails: one row per word and mail with the word's positions, in
folders by a hash of the word, so a query reads only its words' folders, and in them only the row groups
of its words.  A word's rows lie by falling number of occurrences, and a small table counts them by that
number, so a search for the best mails can start with few rows and stop early (``best_of_segments``).  New mails make a new segment; segments of one size class are merged when there are
enough of them, so a mail is rewritten a number of times that grows with the logarithm of the store.
Deleted mails are left out when hits meet the mails' state, so a delete writes nothing here.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.functions import fulltext as ft

#: A folder of a segment holds about this many rows, and there are at most so many of them.
ROWS_PER_BUCKET, MOST_BUCKETS = 4_000_000, 256
#: A frequent word's rows are dealt over so many tasks.
SALTS = 16
#: So many segments of one size class are merged into one of the next.
TIER = 8


@dataclass(frozen=True)
class Segment:
    """A written segment: its folder, number of word folders, and number of rows."""

    path: str
    buckets: int
    rows: int

    @property
    def tier(self) -> int:
        n, tier = max(1, self.rows), 0
        while n >= TIER:
            n, tier = n // TIER, tier + 1
        return tier


def email_text() -> Column:
    return ft.document_text(*[F.col(c) for c in ("subject", "from_email", "from_name", "body_text")])


def repeated_keys(emails: DataFrame, key: str = "id") -> DataFrame:
    """The mail ids that more than one row has; reads that column only."""
    return emails.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)


def postings(emails: DataFrame, key: str = "id") -> DataFrame:
    """(id, lexeme, positions) of the mails with a body: one row per mail and word, positions in rising order.

    A mail's words are grouped inside its row, so nothing is shuffled.  Only ids that several rows share
    have to be brought together, and those rows alone are.
    """
    texts = emails.where(F.col("body_text").isNotNull()).select(key, email_text().alias("text"))

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.select(key, F.inline(ft.lexeme_positions(F.col("text"))))

    shared = repeated_keys(emails, key)
    if shared.isEmpty():
        return grouped(texts)
    # Null ids are one id, as in a grouping.
    same = F.col(f"t.{key}").eqNullSafe(F.col(f"s.{key}"))
    once = texts.alias("t").join(shared.alias("s"), same, "left_anti")
    more = texts.alias("t").join(shared.alias("s"), same, "left_semi")
    merged = grouped(more).groupBy(key, "lexeme").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return grouped(once).unionByName(merged)


def _bucket(lexeme: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, key: str, path: str, buckets: int) -> int:
    """Rows (key, lexeme, positions) into a segment; the number of its rows."""
    dealt = rows.withColumns({"bucket": _bucket(F.col("lexeme"), buckets), "salt": F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")}).repartition("bucket", "salt")
    counted = dealt.drop("salt").withColumn("tf", F.size("positions"))
    counted.sortWithinPartitions("bucket", "lexeme", F.desc("tf"), key).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    written = rows.sparkSession.read.parquet(f"{path}/rows")
    sums = written.groupBy("bucket", "lexeme", "tf").agg(F.count("*").alias("n")).repartition("bucket").sortWithinPartitions("lexeme")
    sums.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")
    return written.count()  # from the footers


def write_segment(emails: DataFrame, path: str, key: str = "id", buckets: int | None = None) -> Segment:
    """Index mails with a body; ``buckets`` follows the number of mails unless it is given."""
    if buckets is None:
        words = 200 * emails.count()  # a rough size is enough
        buckets = min(MOST_BUCKETS, 1 + words // ROWS_PER_BUCKET)
    return Segment(path, buckets, _write(postings(emails, key), key, path, buckets))


def merge_segments(spark: SparkSession, segments: list[Segment], path: str, key: str) -> Segment:
    """One segment with the rows of several; no text is read."""
    buckets = min(MOST_BUCKETS, 1 + sum(s.rows for s in segments) // ROWS_PER_BUCKET)
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(f"{s.path}/rows").drop("bucket", "tf") for s in segments])
    return Segment(path, buckets, _write(rows, key, path, buckets))


def to_merge(segments: list[Segment]) -> list[Segment]:
    """The segments of the smallest size class that has enough of them."""
    for tier in sorted({s.tier for s in segments}):
        own = [s for s in segments if s.tier == tier]
        if len(own) >= TIER:
            return own
    return []


def _of_terms(spark: SparkSession, segments: list[Segment], terms: list[str], part: str) -> DataFrame:
    """Rows of the words in the part ``rows`` or ``counts`` of all segments.

    Folders and words are constant expressions that the optimizer folds, so they are pruned statically.
    """
    found = []
    for s in segments:
        wanted = [_bucket(F.lit(t), s.buckets) for t in terms]
        found.append(spark.read.parquet(f"{s.path}/{part}").where(F.col("bucket").isin(wanted) & F.col("lexeme").isin(terms)))
    return reduce(DataFrame.unionByName, found)


def _ranked(hits: DataFrame, terms: list[str], key: str) -> DataFrame:
    """(key, rank) of the mails with a row for every term.  One term needs no position: its rank is its count."""
    if len(terms) == 1:
        return hits.select(key, (F.col("tf") * F.lit(ft.LEXEME_WEIGHT)).alias("rank"))
    numbers = F.create_map(*[x for n, t in enumerate(terms) for x in (F.lit(t), F.lit(n + 1))])
    at = F.transform("positions", lambda p: F.struct(p.alias("at"), F.element_at(numbers, F.col("lexeme")).alias("term")))
    # A mail's matches are bounded by its own length, so one list per mail is safe.
    per_mail = hits.groupBy(key).agg(F.collect_list(at).alias("by_term")).where(F.size("by_term") == len(terms))
    return per_mail.select(key, ft.cover_density_of_hits(F.sort_array(F.flatten("by_term")), len(terms)).alias("rank"))


def search_segments(spark: SparkSession, segments: list[Segment], query: str, key: str = "id") -> DataFrame:
    """(key, rank) of the mails that hold every query word; the shuffle is by mail."""
    terms = ft.query_terms(query)
    if not terms or not segments:
        return spark.createDataFrame([], f"{key} string, rank double")
    return _ranked(_of_terms(spark, segments, terms, "rows"), terms, key)


@dataclass(frozen=True)
class Best:
    """Hits that hold the best mails, and the share of the words' rows that was read for them."""

    hits: DataFrame
    read: float


def best_of_segments(spark: SparkSession, segments: list[Segment], query: str, k: int, matching: DataFrame, key: str = "id") -> Best:
    """(key, rank) of at least the ``k`` best mails of ``matching``, ties of the last one included.

    A minimal cover holds each word, and for each occurrence of a word as its first one there are at most as
    many covers as there are words.  So a mail in which some word occurs fewer than x times ranks at
    most weight * words * (x - 1), and the walk stops at the x where the k-th rank so far is higher.
    It starts where each word has a few times k rows, and halves x: few rounds, each a job over fewer rows
    than the next.
    """
    terms = ft.query_terms(query)
    if not terms or not segments or k < 1:
        return Best(search_segments(spark, segments, "", key), 0.0)
    by_tf = _of_terms(spark, segments, terms, "counts").groupBy("lexeme", "tf").agg(F.sum("n").alias("n")).collect()  # a row per word and count
    counts = {t: sorted((r.tf, r.n) for r in by_tf if r.lexeme == t) for t in terms}
    total = sum(n for own in counts.values() for _, n in own)
    if not all(counts.values()):
        return Best(search_segments(spark, segments, "", key), 0.0)

    def rows_from(x: int, t: str) -> int:
        return sum(n for tf, n in counts[t] if tf >= x)

    rows, ids = _of_terms(spark, segments, terms, "rows"), matching.select(key)
    x = max(tf for own in counts.values() for tf, _ in own)
    while x > 1 and any(rows_from(x, t) < 4 * k for t in terms):
        x //= 2
    while True:
        hits = _ranked(rows.where(F.col("tf") >= x), terms, key)
        read = sum(rows_from(x, t) for t in terms) / total
        if x <= 1:
            return Best(hits, read)
        top = hits.join(ids, key, "left_semi").orderBy(F.desc("rank")).limit(k).agg(F.count("*").alias("n"), F.min("rank").alias("least")).first()
        if top.n == k and top.least > ft.LEXEME_WEIGHT * len(terms) * (x - 1) + 1e-9:
            return Best(hits, read)
        x //= 2
