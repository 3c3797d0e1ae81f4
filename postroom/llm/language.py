"""Language identification by segmentation-marginalised unigrams (operator 6).

Each language has a probability for every piece of a fixed public vocabulary.  A word's
probability is the sum, over all ways to cut it into pieces, of the product of their
probabilities; a forward pass over the word's letters gives it.  A text's score is the product
over its words, and the answer the language with the highest posterior.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postroom.llm.registry import by_size, prepare, query, table, written

RANKED_APART = 64
#: Added to every piece's count.
SMOOTHING = 0.1
#: Words, and bytes of their scores, that a Python worker remembers; beyond either the memory is emptied and filled anew.
REMEMBERED, REMEMBERED_BYTES = 500_000, 64_000_000
UNDETERMINED = "und"
#: Distinct words that a task counts before it cuts them into pieces.
COUNTED = 100_000
#: Words of up to so many letters stay within the range of floating point without scaling.
PLAIN_LETTERS = 28

_START = "▁"
_MEMORY: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    if "words" not in _MEMORY:
        import regex

        _MEMORY["words"] = regex.compile(r"\p{L}+").findall
    return _MEMORY["words"](text.lower())


def pieces_of(texts: Iterable[tuple[str, str | None]], encode, most: int = COUNTED) -> Counter:
    """Numbers of the (lang, piece) of (lang, text): words are counted first, so that one that recurs is cut once."""
    counts: Counter = Counter()
    words: Counter = Counter()

    def cut() -> None:
        for (lang, _), n, found in zip(words, words.values(), encode([w for _, w in words]), strict=True):
            for piece in found:
                counts[lang, piece] += n
        words.clear()

    for lang, text in texts:
        for word, n in Counter(words_of(text or "")).items():
            words[lang, word] += n
        if len(words) > most:
            cut()
    cut()
    return counts


def count_pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows (lang, piece, n) over ``docs`` (lang, text), counted in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        texts = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        counts = pieces_of(texts, lambda words: pieces.encode(words, out_type=str))
        rows = [(lang, piece, n) for (lang, piece), n in counts.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        kinds = [pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "piece", "n"])

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, piece string, n bigint")
    return counted.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    """Piece probabilities, one per language; languages in alphabetical order."""

    languages: list[str]
    pieces: dict[str, tuple[float, ...]]
    longest: int = 1
    #: Of a character outside the vocabulary, in every language.
    floor: float = 1e-9
    known: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def word(self, word: str) -> list[float]:
        """Log-probability of the word in each language, summed over all its segmentations."""
        text, one = _START + word, (1.0,) * len(self.languages)
        ahead, scale = [one], [0.0] * len(one)
        for i in range(1, len(text) + 1):
            total = self._sums(text, i, ahead)
            ahead.append(total)
            if min(total) < 1e-100:  # long words: keep each language's sums within range
                up = [1 / v for v in total]
                scale = [s + math.log(v) for s, v in zip(scale, total, strict=True)]
                recent = ahead[-self.longest :]
                ahead[-self.longest :] = [[v * u for v, u in zip(a, up, strict=True)] for a in recent]
        return [math.log(v) + s for v, s in zip(ahead[-1], scale, strict=True)]

    def _sums(self, text: str, i: int, ahead: list) -> list[float]:
        """Sums over all segmentations of the first ``i`` characters, from those of its prefixes."""
        get, total = self.pieces.get, None
        for j in range(i - self.longest if i > self.longest else 0, i):
            p = get(text[j:i])
            if p is None:
                if i - j > 1:
                    continue
                p = (self.floor,) * len(self.languages)
            if total is None:
                total = [a * b for a, b in zip(ahead[j], p)]  # noqa: B905
            else:
                total = [t + a * b for t, a, b in zip(total, ahead[j], p)]  # noqa: B905
        return total

    def words(self, words: set[str]) -> Iterator[tuple[str, list[float]]]:
        """``word`` for many words: in sorted order, the sums of a shared prefix are computed once."""
        path, ahead = "", [(1.0,) * len(self.languages)]
        for word in sorted(words):
            if len(word) > PLAIN_LETTERS:
                yield word, self.word(word)
                continue
            text = _START + word
            shared, most = 0, min(len(path), len(text))
            while shared < most and path[shared] == text[shared]:
                shared += 1
            del ahead[shared + 1 :]
            for i in range(shared + 1, len(text) + 1):
                ahead.append(self._sums(text, i, ahead))
            path = text
            yield word, [math.log(v) for v in ahead[-1]]

    def remember(self, words: set[str]) -> None:
        """Make sure that the scores of all the words are in the table."""
        new = words.difference(self.known)
        most = min(REMEMBERED, REMEMBERED_BYTES // (8 * max(1, len(self.languages))))
        if self.table is None or (new and len(self.known) > most):
            self.known.clear()
            self.table = np.empty((1 << 12, len(self.languages)))
            new = words
        at = len(self.known)
        while at + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        for k, (w, logs) in enumerate(self.words(new), at):
            self.known[w] = k
            self.table[k] = logs

    def answers(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its posterior per text; words new to this worker are scored together."""
        if not self.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        found = []
        for part in by_size(texts):
            split = [words_of(t or "") for t in part]
            self.remember(set().union(*split))
            for words in split:
                if not words:
                    found.append((UNDETERMINED, 0.0))
                    continue
                rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                logs = self.table[rows].sum(0)
                best = int(np.argmax(logs))
                found.append((self.languages[best], float(1 / np.exp(np.maximum(logs - logs[best], -700)).sum())))
        return found


    def fits(self, texts: list[str | None]) -> list[tuple[str, float, float, int]]:
        """(language, posterior, log-probability per letter in that language, words) per text."""
        found = []
        for part in by_size(texts):
            for text, (lang, score) in zip(part, self.answers(part), strict=True):
                words = words_of(text or "") if lang != UNDETERMINED else []
                rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                total = float(self.table[rows, self.languages.index(lang)].sum()) if words else 0.0
                found.append((lang, score, total / max(1, sum(map(len, words)) + len(words)), len(words)))
        return found


def training_rows(docs: DataFrame, train_docs: int | None = None) -> DataFrame:
    """Rows (doc_id, lang, text) to learn from: all with an id and a lang, or those of ``training_ids``."""
    rows = docs.select("doc_id", "lang", "text").where("lang is not null and doc_id is not null")
    return rows if train_docs is None else rows.join(training_ids(docs, train_docs), ["doc_id", "lang"])


def training_ids(docs: DataFrame, train_docs: int) -> DataFrame:
    """Rows (doc_id, lang) of at most ``train_docs`` ids per language, in the order of a hash of their id."""
    ids = docs.where("lang is not null and doc_id is not null").select("doc_id", "lang").distinct()
    # One language may hold most rows: its shares are ranked apart before they meet.
    share = F.pmod(F.xxhash64("doc_id"), F.lit(RANKED_APART)).alias("_share")
    for keys in (["lang", "_share"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        ranked = ids.select("doc_id", "lang", share).withColumn("_n", F.row_number().over(order))
        ids = ranked.where(F.col("_n") <= train_docs).select("doc_id", "lang")
    return ids


def norms(docs: DataFrame, model: LanguageModel, train_docs: int | None = None) -> dict[str, tuple[float, float, float]]:
    """By language: mean log-probability per letter of its training texts, its spread between texts, and per word.

    The spread per word is that of the difference from the mean times the root of the number of words.
    Languages whose texts hold no letter are missing.
    """
    rows = training_rows(docs, train_docs).select("lang", "text")
    # Written, narrow: the texts are scored once for both passes.
    own = written(fitted(rows, model, ("lang",)).where("lang = lang_pred and words > 0").select("lang", "per_letter", "words"), "norms")
    mean = own.groupBy("lang").agg(F.avg("per_letter").alias("mean"))
    away = F.col("per_letter") - F.col("mean")
    spread = own.join(F.broadcast(mean), "lang").groupBy("lang", "mean").agg(  # a row per language
        F.coalesce(F.stddev(F.when(F.col("words") >= 50, away)), F.lit(0.0)).alias("between"), F.coalesce(F.stddev(away * F.sqrt("words")), F.lit(0.0)).alias("by_word")
    )
    return {r.lang: (r.mean, r.between, r.by_word) for r in spread.collect()}


def fitted(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...]) -> DataFrame:
    """``identify`` with ``per_letter`` and ``words`` (see ``LanguageModel.fits``)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    answered = docs.select(*keep, F.col("text").alias("_text"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("per_letter", "double").add("words", "long")
    kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = own.fits(batch.column(batch.num_columns - 1).to_pylist())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score", "per_letter", "words"])

    return answered.mapInArrow(run, schema)


def learn(docs: DataFrame, vocabulary: str | None = None, train_docs: int | None = None) -> LanguageModel:
    """Piece probabilities from ``docs`` (doc_id, text, lang), rows without an id or a lang left out.

    All other rows are learned from, or (``train_docs``) so many ids per language, in the order of a
    hash of their id; what reaches the driver is at most one row per piece and language.
    """
    import sentencepiece

    prepare(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    rows = count_pieces(training_rows(docs, train_docs), path).collect()
    languages = sorted({r.lang for r in rows})
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    vocabulary_pieces = [
        pieces.id_to_piece(i)
        for i in range(pieces.get_piece_size())
        if not (pieces.is_control(i) or pieces.is_byte(i) or pieces.is_unknown(i))
    ]
    counts = np.full((len(vocabulary_pieces), len(languages)), SMOOTHING)
    place = {p: i for i, p in enumerate(vocabulary_pieces)}
    for r in rows:
        if r.piece in place:
            counts[place[r.piece], languages.index(r.lang)] += r.n
    seen = {r.piece for r in rows}
    shares = counts / counts.sum(0)
    # A piece that no language has shown tells nothing between them and is left out.
    kept = {p: tuple(map(float, shares[i])) for p, i in place.items() if p in seen}
    return LanguageModel(languages, kept, max(map(len, kept), default=1))


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score`` (posterior of that language) of whole texts.

    Null texts, texts without a letter and every text under a model that learned nothing give
    ``und`` and 0; equal scores go to the first language by name.  Each row is answered alone, so
    repeated rows get equal answers and no rows give no rows.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    answered = docs.select(*keep, F.col("text").alias("_text"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = own.answers(batch.column(batch.num_columns - 1).to_pylist())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score"])

    return answered.mapInArrow(run, schema)


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
