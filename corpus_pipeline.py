"""A training corpus from ``documents``: the stages in order, each written and read again.

Every stage works on all rows that its predecessor kept.  The first four return the columns they
were given; packing returns one row per piece of a sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.llm import decontaminate, language, packing, secrets, simhash
from postroom.llm.registry import prepare, table, written
from postroom.session import new_work_dir

#: A text is rejected if its log-probability per letter lies below the mean of its language's training
#: texts by more than so many spreads between texts and (over the root of its number of words) per word.
TEXT_SPREADS, WORD_SPREADS = 16.0, 5.0
#: Spread between texts that is assumed at least, for training sets of a few texts.
LEAST_SPREAD = 0.04


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(_quoted(c)) for c in docs.columns]


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, or one with more underscores, that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def unlike(norms: dict[str, tuple[float, float, float]]) -> Column:
    """True for a text (lang_pred, per_letter, words) that is far from the training texts of its language."""
    far = F.lit(False)
    for lang, (mean, between, by_word) in norms.items():
        least = F.lit(mean - TEXT_SPREADS * max(between, LEAST_SPREAD)) - WORD_SPREADS * by_word / F.sqrt(F.greatest("words", F.lit(1)))
        far = far | ((F.col("lang_pred") == lang) & (F.col("per_letter") < least))
    return far


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without letters and texts unlike all that their likeliest language was learned from.

    Short texts get the leeway of their few words, so clean ones stay.  Every row is judged alone: equal
    rows share their fate, texts of any length are read whole, no rows give no rows, and a table without
    any ``lang`` loses all rows, as nothing is learned.  All columns are kept, whatever their names.
    """
    learnable = docs.where(~language.held_out())
    model = language.learn(learnable)
    norms = language.norms(learnable, model)
    own = docs.select(F.struct(*_columns(docs)).alias("_row"), "text")
    found = language.fitted(own, model, ("_row",))
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & ~unlike(norms)).select("_row.*")


def _text_key() -> Column:
    """SHA-256 of the text, null for a null text."""
    return F.unhex(F.sha2("text", 256))


def _row_key(docs: DataFrame) -> Column:
    """Equal for rows that are equal in all columns, never null; the part of the text comes first."""
    rest = [(F.to_json(_quoted(c)) if "map<" in kind else F.col(_quoted(c))) for c, kind in docs.dtypes if c != "text"]
    other = F.xxhash64(*rest, *[c.isNull() for c in rest])  # a null alone leaves the hash as it is
    return F.concat(F.coalesce(_text_key(), F.lit(b"")), F.unhex(F.lpad(F.hex(other), 16, "0")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: one with the smallest id, then the smallest key.

    A row whose id is null is kept only if its whole group has none.  Rows that share an id but not
    a group are different documents and stay apart; rows equal in all columns stay as one.  Null and empty
    texts are one group; texts of any length count whole; no rows give no rows; all columns are kept.
    """
    key = _fresh(docs, "_key")
    keyed = docs.withColumn(key, _row_key(docs))
    kept = written(simhash.least_rows(keyed, key), "least-rows")
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(_columns(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, by their texts: ids may be null or shared.

    An item of fewer words than a shingle is no evidence inside a longer text: only a text of just those
    words goes.  Null and empty texts stay; equal texts share their fate; no rows give no rows.
    """
    key = _fresh(docs, "_key")
    keyed = docs.withColumn(key, _text_key())
    own = keyed.select(F.col(key).alias("doc_id"), "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    words = decontaminate.words_of(F.col("text"))
    found = decontaminate.leaks(own, items.where(F.size(words) >= decontaminate.SHINGLE)).select("doc_id")
    short = items.select(F.array_join(words, " ").alias("line")).where(F.size(words).between(1, decontaminate.SHINGLE - 1)).distinct()
    same = own.where(F.size(words) < decontaminate.SHINGLE).select("doc_id", F.array_join(words, " ").alias("line")).join(short, "line", "left_semi")
    leaked = written(found.union(same.select("doc_id")).distinct().withColumnRenamed("doc_id", key), "leaks")
    return keyed.join(leaked, key, "left_anti").select(_columns(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets replaced and ``n_chars`` counted anew where it was given.

    Texts that pass no rule's gate, null and empty ones too, go on as they are where they are read; only the
    others meet the ledger.  Equal texts are scanned once; overlapping finds are replaced as one; no rows
    give no rows; texts of any length are scanned whole.
    """
    own = docs.select(F.struct(*_columns(docs)).alias("_row"), "text")
    gate = secrets.may_hold(F.col("text"))
    found = secrets.scan_paths(own.where(gate), f"{new_work_dir(spark, 'secrets')}/ledger", keep=("_row",))
    masked = found.select("_row", "spans", secrets.mask(F.col("_row.text"), F.col("spans")).alias("_masked"))
    counted = F.when(F.size("spans") > 0, F.length("_masked").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None
    changed = {"text": F.col("_masked"), "n_chars": counted}
    masked = masked.select(*[changed.get(c, F.col("_row")[c]).cast(kind).alias(c) for c, kind in docs.dtypes])
    return docs.where(~gate).union(masked)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document, one row per piece; see ``packing.pack`` for null, empty, long, equal and missing rows."""
    return packing.pack(docs, added=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

# Learned languages and tokenised lengths are beyond SQL; tests/llm/test_pipeline.py holds the
# stages against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
