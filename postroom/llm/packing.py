"""Best-fit packing of tokenised documents by length patterns (operator 10).

Only the histogram of piece lengths, at most ``capacity`` rows, reaches the driver.  Patterns
of up to three lengths that fill a sequence exactly are fitted to it by non-negative least
squares and rounded down; what is left over is packed best fit decreasing, again on the
histogram.  The result is a list of slots (length, range of ranks, sequence, offset), and
every piece finds its slot by its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postroom.llm.registry import prepare, query, table, written

CAPACITY = 1024
END_ID = 2
#: Pre-tokens whose ids a Python worker remembers; beyond it the memory is emptied and filled anew.
REMEMBERED = 600_000

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint, ids binary"
_MEMORY: dict[tuple[str, bool], Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Characters below this code point are split by a pattern of the standard library, which is faster
#: with small classes than one with Unicode properties.
NARROW = 0x180


def pre_token_pattern(letter: str, number: str, space: str) -> str:
    """The pre-token pattern of the byte-level vocabularies, over the members of three classes.

    Letters come first because most pre-tokens are words; no other alternative starts like them.
    """
    return (
        rf" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


def narrow_class(kind: str) -> str:
    """The characters below ``NARROW`` of a general category, for a class of the ``re`` module."""
    return "".join(re.escape(chr(c)) for c in range(NARROW) if unicodedata.category(chr(c))[0] == kind)


class Encoder:
    """Ids of a byte-level BPE as little-endian 32-bit bytes, remembered per pre-token.

    The merges of a byte-level BPE never cross its pre-tokens, so the ids of a text are those of
    its pre-tokens in order.  ``added``: the file's added tokens get their own ids, as in a plain
    ``encode``; texts are cut at them first.  Otherwise their strings are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        if sys.byteorder != "little":
            raise RuntimeError("ids are kept in native order, which must be little-endian")
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        tokens = self.tokenizer.get_added_tokens_decoder() if added else {}
        self.added = {t.content: array("I", [i]).tobytes() for i, t in tokens.items()}
        # Tokens with further rules are left to the tokenizer, a whole text at a time.
        ruled = any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in tokens.values())
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = None if ruled else re.compile(f"({'|'.join(map(re.escape, longest_first))})").split
        self.split_any = regex.compile(pre_token_pattern(r"\p{L}", r"\p{N}", r"\s")).findall
        # Unicode White_Space below NARROW.
        self.split_narrow = re.compile(pre_token_pattern(narrow_class("L"), narrow_class("N"), "\t-\r \x85\xa0")).findall
        self.wide = re.compile(f"[^\0-{chr(NARROW - 1)}]").search
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return self.split_narrow(text) if text.isascii() or not self.wide(text) else self.split_any(text)

    def __call__(self, text: str) -> bytes:
        if not any(t in text for t in self.added):
            return self.plain(text)
        if self.cut is None:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(self.added[p] if k % 2 else self.plain(p) for k, p in enumerate(self.cut(text)))

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        parts, known = self.split(text), self.known
        new = set(parts).difference(known)
        if new:
            if len(known) > REMEMBERED:
                known.clear()
                new = set(parts)
            new = list(new)
            for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                known[p] = array("I", e.ids).tobytes()
        return b"".join(map(known.__getitem__, parts))


def _encoder(path: str, added: bool) -> Encoder:
    if (path, added) not in _MEMORY:
        _MEMORY[path, added] = Encoder(path, added)
    return _MEMORY[path, added]


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, added: bool = False
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, part, place[, ids]) of tokenised documents.

    ``part`` is the task that made the row and ``place`` its number among that task's rows of
    the same length; together they number the pieces of a length without any sort.
    """
    prepare(docs.sparkSession)
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = _encoder(tokenizer, added), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + last
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k in range(len(cuts) - 1):
                    a, b = cuts[k], cuts[k + 1]
                    own = ids[4 * a : 4 * b]
                    out.append((doc_id, k, a, b - a, zlib.crc32(own), part, seen[b - a], own if keep_ids else None))
                    seen[b - a] += 1
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)
    return made if keep_ids else made.drop("ids")


def exact_patterns(capacity: int, lengths: np.ndarray) -> np.ndarray:
    """All multisets of one to three of the given lengths that sum to ``capacity``; 0 pads."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    found = [np.array([[capacity, 0, 0]])] if have[capacity] else []
    for a in lengths:
        b = np.arange(a, (capacity - a) // 2 + 1)
        c = capacity - a - b
        ok = have[b] & have[c]
        found.append(np.stack([c[ok], b[ok], np.full(ok.sum(), a)], 1))
        if a <= capacity - a and have[capacity - a]:
            found.append(np.array([[capacity - a, a, 0]]))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: repeat counts x of the patterns so that A x is near the histogram.

    Accelerated projected gradient; A is never built, its columns are the patterns' indices.
    """
    if not len(patterns):
        return np.zeros(0)
    used = (patterns > 0).astype(float)
    size = len(histogram)

    def usage(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns.ravel(), (used * x[:, None]).ravel(), size)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[patterns] * used).sum(1)

    v = np.ones(len(patterns))
    for _ in range(30):  # largest eigenvalue of A'A
        v = back(usage(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(patterns))
    momentum = 1.0
    for _ in range(rounds):
        x_new = np.maximum(0, y + back(histogram - usage(y)) / (1.01 * top))
        m_new = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = x_new + (momentum - 1) / m_new * (x_new - x)
        x, momentum = x_new, m_new
    return x


def _within(patterns: np.ndarray, counts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Lower the counts, in order, until no length is used more often than it occurs."""
    kept = np.zeros(len(counts), np.int64)
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] <= 0:
            break
        own, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
        n = min(int(counts[i]), int((left[own] // times).min()))
        if n > 0:
            kept[i] = n
            left[own] -= n * times
    return kept


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over a histogram: equal sequences are handled together."""
    opened: dict[int, dict[tuple[int, ...], int]] = {}

    def put(space: int, pattern: tuple[int, ...], n: int) -> None:
        group = opened.setdefault(space, {})
        group[pattern] = group.get(pattern, 0) + n

    for length in range(capacity, 0, -1):
        count = int(left[length])
        while count:
            space = min((s for s in opened if s >= length), default=None)
            if space is None:
                fits = capacity // length
                if count >= fits:
                    put(capacity - fits * length, (length,) * fits, count // fits)
                if count % fits:
                    put(capacity - count % fits * length, (length,) * (count % fits), 1)
                break
            group = opened[space]
            pattern, n = next(iter(group.items()))
            take = min(n, count)
            fits = min(space // length, count // take) or 1
            group[pattern] -= take
            if not group[pattern]:
                del group[pattern]
            if not group:
                del opened[space]
            put(space - fits * length, pattern + (length,) * fits, take)
            count -= take * fits
    return [(p, n) for group in opened.values() for p, n in group.items()]


def plan_sequences(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) for all pieces of the histogram (index: length)."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    for _ in range(3):  # what rounding down leaves is fitted again
        lengths = np.flatnonzero(left)
        if not len(lengths):
            break
        patterns = exact_patterns(capacity, lengths)
        counts = _within(patterns, np.floor(fit_counts(patterns, left.astype(float)) + 1e-6), left)
        if not counts.any():
            break
        plan += [(tuple(int(v) for v in patterns[i] if v), int(counts[i])) for i in np.flatnonzero(counts)]
    return plan + best_fit(left, capacity)


def slots(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted by length and rank."""
    rows, used, sequence = [], {}, 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
    added: bool = False,
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): one per piece.

    Null and empty texts give the end id alone.  A document longer than ``capacity`` is cut into
    pieces of ``capacity``, the first of which may be shorter.  Repeated rows and null ids are
    packed like any other row; equal lengths go by task and place; no rows give no rows; columns
    other than doc_id and text are ignored.  ``added`` is that of ``Encoder``; the query and the
    pipeline set it.
    """
    cut = written(pieces(docs, tokenizer or default_tokenizer(), capacity, end_id, keep_ids, added), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = written(counts, "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        histogram[length] = n
    places = slots(plan_sequences(histogram, capacity))
    span = int(histogram.max(initial=0)) + 1
    keys = places[:, 0] * span + places[:, 1]
    shared = docs.sparkSession.sparkContext.broadcast((keys, places))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            slot = places[np.searchsorted(keys, length * span + rank, "right") - 1] if len(rank) else places[:0]
            columns = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
            columns["sequence_id"] = pa.array(slot[:, 2] + rank - slot[:, 1], pa.int64())
            columns["offset"] = pa.array(slot[:, 3], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # One row per task, with at most ``capacity`` entries; they grow with the tasks, so they are not broadcast.
    firsts = first.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "first"))).alias("firsts"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    ranked = cut.join(firsts.hint("merge"), "part").select(*kept, (F.element_at("firsts", F.col("length")) + F.col("place")).alias("rank"))
    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, " + "ids binary, " * keep_ids
    return ranked.mapInArrow(seat, ddl + "sequence_id bigint, offset bigint")


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), added=True)
