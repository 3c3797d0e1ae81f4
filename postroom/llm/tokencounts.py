"""Token counts by dynamic programming over a trie of pre-tokens (operator 9).

Distinct pre-tokens of one length are walked together over a trie of the pieces, a column each.  The
others form a trie themselves: the best unigram score of a prefix depends on that prefix alone, so it is
computed once per trie node and shared by all pre-tokens below it.  Walking them in sorted order visits
the trie depth first: only the current path is kept.
What stays is each pre-token's count, and a text's count is a sum of look-ups.

The scores are learned: expectation maximisation over the words of all texts, by the same forward
pass with sums in place of maxima, from a start where rank r of the vocabulary has a share of 1 / r.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.llm.registry import by_size, prepare, query, table, written

#: Pre-tokens whose counts a Python worker remembers; beyond it the memory is emptied and filled anew.
REMEMBERED = 800_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
#: Letters of equally long words that learning takes together; pieces of longer words are looked up twice instead of kept.
GROUPED_LETTERS, KEPT_LETTERS = 40_000, 1_000
#: Distinct words that learning groups by their length at once, and fewest words of a length that are counted together.
GROUPED_WORDS, GROUPED_LEAST = 50_000, 64
#: Words of up to so many letters are summed as plain probabilities, unless one's falls below the second number.
PLAIN_LETTERS, LEAST = 40, 1e-250
#: Entries of a table of the trie's steps; a larger trie is searched in its sorted steps.
MOST_STEPS = 30_000_000
ROUNDS = 4
#: Added to every piece's expected count.
SMOOTHING = 0.1
_START = "▁"


class PieceTrie:
    """The trie of the pieces as arrays, walked for many words at once; state 0 is off the trie."""

    def __init__(self, pieces: Iterable[str]):
        states: dict[str, int] = {}
        ends, steps, classes = [], [], {}
        for k, piece in enumerate(pieces):
            at = 0
            for i, letter in enumerate(piece):
                after = states.setdefault(piece[: i + 1], len(states) + 1)
                if i and after == len(states):
                    steps.append((at, classes.setdefault(letter, len(classes) + 1), after))
                at = after
            ends.append((at, k))
        #: By state: the piece that ends there, else their number.
        self.piece = np.full(len(states) + 1, len(ends))
        for state, k in ends:
            self.piece[state] = k
        self.piece[0] = len(ends)
        most = max(map(ord, "".join(states)), default=0) + 2
        #: By letter: the state after it at the start of a piece, and its number elsewhere in one.
        self.first, self.classes = np.zeros((2, most), np.int64)
        for prefix, state in states.items():
            if len(prefix) == 1:
                self.first[ord(prefix)] = state
        for letter, k in classes.items():
            self.classes[ord(letter)] = k
        self.width = len(classes) + 1
        states_, classes_, after = np.array(steps, np.int64).reshape(-1, 3).T
        keys = states_ * self.width + classes_
        if (len(states) + 1) * self.width <= MOST_STEPS:
            self.table = np.zeros((len(states) + 1) * self.width, np.int32)
            self.table[keys] = after
        else:
            self.table, order = None, np.argsort(keys)
            self.keys, self.after = np.append(keys[order], -1), np.append(after[order], 0)

    def step(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        keys = states * self.width + classes
        if self.table is not None:
            return self.table[keys]
        at = np.searchsorted(self.keys[:-1], keys)
        return np.where(self.keys[at] == keys, self.after[at], 0)

    def edges(self, letters: np.ndarray, longest: int) -> Iterator[tuple[int, int, np.ndarray | slice, np.ndarray]]:
        """(start, end, words, pieces) by start; ``letters`` has a column per word.  Single letters come for all words."""
        size = len(letters)
        known = np.minimum(letters, len(self.first) - 1)
        first, classes = self.first[known], self.classes[known]
        none = self.piece[0]
        for j in range(size):
            states, own = first[j], self.piece[first[j]]
            yield j, j + 1, slice(None), own
            words = np.flatnonzero(states)
            states = states[words]
            for i in range(j + 1, min(size, j + longest)):
                states = self.step(states, classes[i][words])
                on = np.flatnonzero(states)
                if not len(on):
                    break
                words, states = words[on], states[on]
                own = self.piece[states]
                ending = np.flatnonzero(own != none)
                if len(ending):
                    yield j, i + 1, words[ending], own[ending]


def _columns(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters of equally long words, a column each with the start mark on top, and the letters' sizes in bytes."""
    letters = np.array([_START + w for w in words], f"<U{size}").view(np.uint32).reshape(len(words), size).T.copy()
    return letters, 1 + (letters >= 0x80).astype(int) + (letters >= 0x800) + (letters >= 0x10000)


@dataclass
class UnigramCounter:
    """Counts of the likeliest segmentation; of equally likely ones the one with fewer tokens.

    A character outside the vocabulary costs one byte token for each of its UTF-8 bytes.
    """

    scores: dict[str, float]
    byte_score: float
    longest: int
    known: dict[str, int] = field(default_factory=dict, repr=False)
    #: Log-probability per letter of all words before each round of learning.
    per_letter: list[float] = field(default_factory=list)

    @cached_property
    def places(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.scores)}

    @cached_property
    def trie(self) -> PieceTrie:
        return PieceTrie(self.scores)

    @cached_property
    def logs(self) -> np.ndarray:
        """Scores by place; the place after them stands for everything else."""
        return np.array([*self.scores.values(), -np.inf])

    @cached_property
    def shares(self) -> np.ndarray:
        return np.exp(self.logs)

    def learn_counts(self, words: set[str]) -> None:
        """Keep the count of each word: many words of a length together, the others in sorted order."""
        groups: dict[int, list[str]] = {}
        for word in words:
            groups.setdefault(len(word) + 1, []).append(word)
        for size, group in groups.items():
            if size > PLAIN_LETTERS + 1 or len(group) < GROUPED_LEAST:
                continue
            words = words.difference(group)
            most = max(1, GROUPED_LETTERS // size)
            for at in range(0, len(group), most):
                part = group[at : at + most]
                self.known.update(zip(part, self._counts_of_equally_long(size, part), strict=True))
        self.grow(words)

    def _counts_of_equally_long(self, size: int, words: list[str]) -> list[int]:
        letters, in_bytes = _columns(words, size)
        none = len(self.scores)
        best, count = np.full((size + 1, len(words)), -np.inf), np.zeros((size + 1, len(words)), np.int64)
        best[0] = 0.0
        for j, i, at, own in self.trie.edges(letters, self.longest):
            score, tokens = self.logs[own], 1
            if i == j + 1:
                score = np.where(own == none, in_bytes[j] * self.byte_score, score)
                tokens = np.where(own == none, in_bytes[j], 1)
            score, tokens = best[j][at] + score, count[j][at] + tokens
            so_far, fewest = best[i][at], count[i][at]
            better = (score > so_far) | ((score == so_far) & (tokens < fewest))
            best[i][at], count[i][at] = np.where(better, score, so_far), np.where(better, tokens, fewest)
        return count[size].tolist()

    def grow(self, words: set[str]) -> None:
        """Walk the trie of the words and keep the count at each word's end."""
        get, longest, known = self.scores.get, self.longest, self.known
        path = ""
        best, count = [0.0], [0]  # by depth on the current path
        for word in sorted(words):
            text = _START + word
            shared, most = 0, min(len(path), len(text))
            while shared < most and path[shared] == text[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for i in range(shared + 1, len(text) + 1):
                n = len(text[i - 1].encode())
                score = get(text[i - 1])
                top, tokens = (best[i - 1] + n * self.byte_score, count[i - 1] + n) if score is None else (best[i - 1] + score, count[i - 1] + 1)
                for j in range(max(0, i - longest), i - 1):
                    score = get(text[j:i])
                    if score is not None:
                        score += best[j]
                        if score > top or (score == top and count[j] + 1 < tokens):
                            top, tokens = score, count[j] + 1
                best.append(top)
                count.append(tokens)
            path = text
            known[word] = count[-1]

    def counts(self, texts: list[list[str]]) -> list[int]:
        new = set().union(*texts).difference(self.known)
        if new:
            if len(self.known) > REMEMBERED:
                self.known.clear()
                new = set().union(*texts)
            self.learn_counts(new)
        return [sum(map(self.known.__getitem__, words)) for words in texts]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def unigram(vocabulary: str) -> UnigramCounter:
    """Scores before learning: pieces stand in the order of their frequency, and rank r has a share of 1 / r (Zipf)."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    total = math.log(sum(1 / r for r in range(1, pieces.get_piece_size() + 1)))
    scores, byte_score = {}, -total - math.log(pieces.get_piece_size())
    for i in range(pieces.get_piece_size()):
        if pieces.is_byte(i):
            byte_score = min(byte_score, -total - math.log(i + 1))
        elif not (pieces.is_control(i) or pieces.is_unknown(i)):
            scores[pieces.id_to_piece(i)] = -total - math.log(i + 1)
    return UnigramCounter(scores, byte_score, max(map(len, scores), default=1))


def expect(counter: UnigramCounter, words: dict[str, int], sums: np.ndarray) -> float:
    """Adds the expected number of each piece, over all segmentations of all words, to ``sums``; the log-likelihood.

    ``sums`` has a place per score and one for characters outside the vocabulary.  Words of a length go
    together, a column each; where a word's probability leaves the range of floating point, sums are taken of logarithms,
    so words may be of any length.
    """
    groups: dict[int, list[str]] = {}
    for word in words:
        groups.setdefault(len(word) + 1, []).append(word)
    total = 0.0
    for size, group in groups.items():
        most = max(1, GROUPED_LETTERS // size)
        for at in range(0, len(group), most):
            part = group[at : at + most]
            if size <= PLAIN_LETTERS + 1:
                log, part = _expect_plainly(counter, size, part, np.array([words[w] for w in part], float), sums)
                total += log
            if part:
                total += _expect_equally_long(counter, size, part, np.array([words[w] for w in part], float), sums)
    return total


def _expect_plainly(counter: UnigramCounter, size: int, words: list[str], n: np.ndarray, sums: np.ndarray) -> tuple[float, list[str]]:
    """``_expect_equally_long`` with plain probabilities; the words that are too improbable for them are handed back."""
    letters, in_bytes = _columns(words, size)
    none, shares = len(counter.scores), counter.shares
    outside = np.exp(counter.byte_score * in_bytes)
    ahead, behind = np.zeros((2, size + 1, len(words)))
    ahead[0] = behind[size] = 1.0
    edges = []
    for j, i, at, own in counter.trie.edges(letters, counter.longest):
        share = shares[own]
        if i == j + 1:
            share = np.where(own == none, outside[j], share)
        reached = ahead[j][at] * share
        ahead[i][at] += reached
        edges.append((j, i, at, own, share, reached))
    fits = ahead[size] >= LEAST
    weight = np.where(fits, n, 0.0) / np.where(fits, ahead[size], 1.0)
    found = []
    for j, i, at, _, share, reached in reversed(edges):
        after = behind[i][at]
        behind[j][at] += after * share
        found.append(reached * after * weight[at])
    sums += np.bincount(np.concatenate([e[3] for e in reversed(edges)]), np.concatenate(found), none + 1)
    left = [words[k] for k in np.flatnonzero(~fits)]
    return float(np.log(ahead[size][fits]) @ n[fits]), left


def expected(counter: UnigramCounter, word: str) -> tuple[dict[str, float], float]:
    """Expected number of each piece in a word over all its segmentations, and its log-probability."""
    sums = np.zeros(len(counter.scores) + 1)
    log = expect(counter, {word: 1}, sums)
    return {p: float(sums[i]) for p, i in counter.places.items() if sums[i]}, log


def _expect_equally_long(counter: UnigramCounter, size: int, words: list[str], n: np.ndarray, sums: np.ndarray) -> float:
    texts, places, logs, none = [_START + w for w in words], counter.places, counter.logs, len(counter.scores)
    ends: dict[int, list] = {}

    def edges(i: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(start, pieces, their scores) of the pieces that end at ``i``."""
        if i in ends:
            return ends[i]
        found = []
        for j in range(max(0, i - counter.longest), i):
            own = np.fromiter((places.get(t[j:i], none) for t in texts), np.int64, len(texts))
            scores = logs[own]
            if j == i - 1:
                scores = np.where(own == none, [counter.byte_score * len(t[j].encode()) for t in texts], scores)
            elif (own == none).all():
                continue
            found.append((j, own, scores))
        if size <= KEPT_LETTERS:
            ends[i] = found
        return found

    ahead, behind = np.full((2, size + 1, len(texts)), -np.inf)
    ahead[0] = behind[size] = 0.0
    for i in range(1, size + 1):
        ahead[i] = np.logaddexp.reduce([ahead[j] + scores for j, _, scores in edges(i)])
    for i in range(size, 0, -1):
        for j, own, scores in edges(i):
            behind[j] = np.logaddexp(behind[j], behind[i] + scores)
            np.add.at(sums, own, n * np.exp(ahead[j] + scores + behind[i] - ahead[size]))
    return float(ahead[size] @ n)


def count_words(docs: DataFrame) -> DataFrame:
    """Rows (word, n) over all texts, counted in the tasks before the shuffle."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def given() -> pa.RecordBatch:
            columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for part in by_size(batch.column(0).to_pylist()):
                for text in part:
                    counts.update((text or "").split())
                if len(counts) > COUNTED:
                    yield given()
                    counts.clear()
        yield given()

    return docs.select("text").mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, vocabulary: str | None = None, rounds: int = ROUNDS) -> UnigramCounter:
    """Scores of the vocabulary's pieces from all words of ``docs`` (text); without words those of ``unigram``.

    Words are counted once and written; each round is a job over the distinct words whose sums, one row
    per piece, reach the driver.
    """
    prepare(docs.sparkSession)
    counter = unigram(vocabulary or default_vocabulary())
    counted = written(count_words(docs), "words")
    byte_cost = counter.byte_score
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(counter)

        def one(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, letters, total = shared.value, 0, 0.0
            sums = np.zeros(len(own.scores) + 1)
            words: dict[str, int] = {}  # of many batches: a group of a length is worth its steps only if it is large
            for batch in batches:
                words.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                if len(words) >= GROUPED_WORDS:
                    total += expect(own, words, sums)
                    letters += sum(n * len(w) for w, n in words.items())
                    words.clear()
            total += expect(own, words, sums)
            letters += sum(n * len(w) for w, n in words.items())
            # Two rows without a piece of the vocabulary carry the likelihood.
            rows = [(p, float(sums[i])) for p, i in own.places.items() if sums[i]] + [("\n", total), ("\n\n", float(letters))]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64())], ["piece", "n"])

        sums = {r.piece: r.n for r in counted.mapInArrow(one, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
        letters = sums.get("\n\n", 0.0)
        if not letters:
            break
        counts = {p: sums.get(p, 0.0) + SMOOTHING for p in counter.scores}
        log_total = math.log(sum(counts.values()))
        # Rounded, so that the order of additions does not show.
        scores = {p: round(math.log(n) - log_total, 6) for p, n in counts.items()}
        counter = UnigramCounter(scores, byte_cost, counter.longest, per_letter=[*counter.per_letter, sums["\n"] / letters])
    return counter


def count_tokens(
    docs: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = ("doc_id",), counter: UnigramCounter | None = None
) -> DataFrame:
    """Columns ``keep`` with ``n_pretokens`` and ``n_tokens`` of whole texts.

    Pre-tokens are runs without white space; ``counter``: learned scores, else those of ``unigram``.  Null and empty texts have none; each row is counted
    alone, so repeated rows get equal counts and no rows give none; other columns are ignored.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(counter or unigram(vocabulary or default_vocabulary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value  # one per worker, with what it remembers
        for batch in batches:
            last = batch.num_columns - 1
            pretokens, tokens = [], []
            for part in by_size(batch.column(last).to_pylist()):
                texts = [(t or "").split() for t in part]
                pretokens += map(len, texts)
                tokens += own.counts(texts)
            columns = [batch.column(i) for i in range(last)] + [pa.array(pretokens, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_pretokens", "n_tokens"])

    schema = docs.select(*keep).schema.add("n_pretokens", "long").add("n_tokens", "long")
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


@query("op9_tokencounts")
def op9_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, counter=learn(docs))
