"""Language code rules and an offline stop-word detector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postroom import fixed_values as fv
from postroom.functions.text import has_text, let

# Frequent function words that the four languages do not share.
STOP_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "auf", "sich", "von"),
    "en": ("the", "and", "of", "to", "is", "that", "for", "with", "was", "are", "this", "have"),
    "es": ("el", "los", "las", "por", "con", "para", "una", "del", "como", "que", "pero", "y"),
    "fr": ("le", "les", "des", "et", "est", "dans", "pour", "sur", "une", "du", "avec", "qui"),
}


def resolve_language(text: Column, language: Column, confidence: Column) -> Column:
    """Two-letter code of a prediction; 'en' when blank, missing or below 0.5."""
    base = F.substring(F.lower(F.element_at(F.split(F.trim(language), "_"), 1)), 1, 2)
    usable = (
        has_text(text)
        & language.isNotNull()
        & (F.coalesce(confidence, F.lit(1.0)) >= fv.LANGUAGE_CONFIDENCE_MIN)
        & (F.length(F.trim(language)) >= 2)
        & base.rlike(r"^\p{L}+$")
    )
    return F.when(usable, base).otherwise(F.lit("en"))


def words_of(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}_]+")


def stop_word_counts(words: Column) -> dict[str, Column]:
    """Hits per language in one word list (split once, looked up four times)."""

    def count(stops: tuple[str, ...]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*stops)))

    return {lang: count(stops) for lang, stops in STOP_WORDS.items()}


def predict_by_stop_words(text: Column) -> Column:
    """``struct<language, confidence>``: most hits wins, ties by language code."""

    def hits(words: Column) -> Column:
        return F.transform(
            F.array(
                *[
                    F.struct(F.lit(lang).alias("language"), n.alias("hits"))
                    for lang, n in stop_word_counts(words).items()
                ]
            ),
            lambda h: F.struct((-h["hits"]).alias("order"), h["language"], h["hits"]),
        )

    def best(found: Column) -> Column:
        top = F.array_min(found)
        total = F.aggregate(found, F.lit(0), lambda a, h: a + h["hits"])
        return F.when(
            total > 0,
            F.struct(
                top["language"].alias("language"),
                (top["hits"] / total).alias("confidence"),
            ),
        )

    return let(let(words_of(text), hits), best)


def detect_language(text: Column, predict=predict_by_stop_words) -> Column:
    return let(
        predict(text), lambda p: resolve_language(text, p["language"], p["confidence"])
    )
