"""Periodic runs of words by internal pattern matching (operator 13).

Many texts are laid out in one array of word numbers, each followed by a symbol of its own.  Prefix
doubling sorts the suffixes and keeps, for every power of two, the class of each place's substring of
that length; the places of a class are one interval of the suffix array.  A run of period q and
exponent four or more holds an aligned block of m words (a power of two near q) and that block's
copy q words later.  So every aligned block asks a wavelet tree over the suffix array for the next
places of its class in the neighbouring window.  Up to two places give their distances as candidate
periods; three or more form a progression, whose stretch and the block's own stretch can only match
at their left or right ends.  Candidates are verified by longest common extensions on the classes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.llm.registry import by_size, prepare, query, table

#: A run has at least this many words and periods.
LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Characters of texts handled in one array (a longer text makes one alone).
TOGETHER = 1_000_000

_RUN = "start bigint, length bigint, period bigint"


class SuffixOrder:
    """Suffixes sorted by their first ``reach`` symbols, with the classes of all dyadic lengths.

    ``classes[k][i]`` is the first place in ``order`` of the suffixes that share the 2^k symbols at i.
    """

    def __init__(self, symbols: np.ndarray, reach: int):
        n = len(symbols)
        self.order = np.argsort(symbols, kind="stable")
        rank = np.empty(n + 1, np.int64)
        rank[n] = -1
        rank[self.order] = _first_of_equal(symbols[self.order], np.arange(n))
        self.classes = [rank]
        width = 1
        while width < reach:
            size = np.bincount(rank[:n], minlength=n)
            slots = np.flatnonzero(size[rank[self.order]] > 1)  # places not yet told apart
            if not len(slots):
                break
            at = self.order[slots]
            key = rank[at] * (n + 1) + rank[np.minimum(at + width, n)] + 1
            by = np.argsort(key, kind="stable")
            self.order[slots] = at[by]
            rank = rank.copy()
            rank[at[by]] = _first_of_equal(key[by], slots)
            self.classes.append(rank)
            width *= 2

    def same(self, k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.classes[k][x] == self.classes[k][y]

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at x < y."""
        last, got = len(self.classes[0]) - 1, np.zeros(len(x), np.int64)
        top = len(self.classes) - 1
        # Beyond the largest class length the extension goes on in steps of that length.
        going = np.arange(len(x))
        while len(going):
            a, b = x[going] + got[going], y[going] + got[going]
            ok = (b + (1 << top) <= last) & self.same(top, np.minimum(a, last), np.minimum(b, last))
            going = going[ok]
            got[going] += 1 << top
        for k in range(top - 1, -1, -1):
            a, b = x + got, y + got
            got += ((b + (1 << k) <= last) & self.same(k, np.minimum(a, last), np.minimum(b, last))) << k
        return got

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common suffix of what ends before x < y."""
        got = np.zeros(len(x), np.int64)
        top = len(self.classes) - 1
        going = np.arange(len(x))
        while len(going):
            a, b = x[going] - got[going] - (1 << top), y[going] - got[going] - (1 << top)
            ok = (a >= 0) & self.same(top, np.maximum(a, 0), np.maximum(b, 0))
            going = going[ok]
            got[going] += 1 << top
        for k in range(top - 1, -1, -1):
            a, b = x - got - (1 << k), y - got - (1 << k)
            got += ((a >= 0) & self.same(k, np.maximum(a, 0), np.maximum(b, 0))) << k
        return got


def _first_of_equal(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For sorted keys: the place of the first key that equals each."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return places[np.flatnonzero(new)][np.cumsum(new) - 1]


class WaveletTree:
    """Range successor over an array of numbers below its length; one level per bit, high bits first."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros = []  # by level: zeros before each place
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[~one], values[one]])

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest value >= ``least`` in [low, high), or -1."""
        a, b, below = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for level, before in enumerate(self.zeros):
            one = (least >> (self.bits - 1 - level)) & 1 == 1
            za, zb = before[a], before[b]
            below += np.where(one, zb - za, 0)
            a, b = np.where(one, a - za + before[-1], za), np.where(one, b - zb + before[-1], zb)
        found = (below < high - low) & (least < 1 << self.bits)
        # The value of that rank in the interval.
        a, b, rank, value = low[found], high[found], below[found], np.zeros(found.sum(), np.int64)
        for level, before in enumerate(self.zeros):
            za, zb = before[a], before[b]
            one = rank >= zb - za
            rank = np.where(one, rank - (zb - za), rank)
            a, b = np.where(one, a - za + before[-1], za), np.where(one, b - zb + before[-1], zb)
            value |= one.astype(np.int64) << (self.bits - 1 - level)
        out = np.full(len(low), -1, np.int64)
        out[found] = value
        return out


def find_runs(symbols: np.ndarray, longest: int, least_words: int = LEAST_WORDS) -> np.ndarray:
    """Rows (start, end, period) of all runs, sorted by start and period.

    ``symbols``: word numbers, every text followed by a number that occurs once; ``longest``: words
    of the longest text.
    """
    none = np.zeros((0, 3), np.int64)
    if longest < least_words:
        return none
    most = longest // LEAST_EXPONENT
    suffixes = SuffixOrder(symbols, (3 * most + 1) // 2)
    tree = WaveletTree(suffixes.order)
    n = len(symbols)
    places, periods = [none[:, 0]], [none[:, 0]]

    def candidates(at: np.ndarray, period: np.ndarray, least: int, top: int) -> None:
        ok = (period >= least) & (period <= top)
        places.append(at[ok])
        periods.append(period[ok])

    for k in range(1, len(suffixes.classes)):
        # Blocks of m words answer for the periods whose runs of exponent four hold an aligned block and its copy.
        m = 1 << k
        least, top = -(-(2 * m - 1) // 3), min((4 * m - 2) // 3, most)
        if least > top:
            break
        own = suffixes.classes[k][:n]
        size = np.bincount(own, minlength=n)
        at = np.arange(0, n, m)
        at = at[size[own[at]] > 1]
        low = own[at]
        high, last = low + size[low], at + top

        first = tree.successor(low, high, at + least)
        ok = (first >= 0) & (first <= last)
        at, low, high, last, first = at[ok], low[ok], high[ok], last[ok], first[ok]
        candidates(at, first - at, least, top)
        second = tree.successor(low, high, first + 1)
        ok = (second >= 0) & (second <= last)
        at, low, high, last, first, second = at[ok], low[ok], high[ok], last[ok], first[ok], second[ok]
        candidates(at, second - at, least, top)
        third = tree.successor(low, high, second + 1)
        ok = (third >= 0) & (third <= last)
        at, first, step = at[ok], first[ok], (second - first)[ok]
        # A progression: the block has period ``step``, and so have the stretches around it and around the first place.
        left, right = at - suffixes.backward(at, at + step), at + step + suffixes.forward(at, at + step)
        left2, right2 = first - suffixes.backward(first, first + step), first + step + suffixes.forward(first, first + step)
        apart = left != left2  # in one stretch, all distances are multiples of its period
        candidates(at[apart], (left2 - left)[apart], least, top)
        candidates(at[apart], (right2 - right)[apart], least, top)

    at, period = np.concatenate(places), np.concatenate(periods)
    at, period = at[at + period < n], period[at + period < n]
    start = at - suffixes.backward(at, at + period)
    end = at + period + suffixes.forward(at, at + period)
    ok = end - start >= np.maximum(least_words, LEAST_EXPONENT * period)
    found = np.unique(np.stack([start, end, period], 1)[ok], axis=0)
    # The smallest period of a stretch is found with its multiples.
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def text_runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each list of words its rows (start, length, period), sorted by start and period."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(words) + 1 for words in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    symbols = np.full(int(sizes.sum()), -1, np.int64)
    for begin, words in zip(begins, texts, strict=True):
        symbols[begin : begin + len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
    ends = begins + sizes - 1
    symbols[ends] = len(numbers) + np.arange(len(ends))
    found = find_runs(symbols, int(sizes.max(initial=1)) - 1)
    of = np.searchsorted(begins, found[:, 0], "right") - 1
    rows = np.stack([found[:, 0] - begins[of], found[:, 1] - found[:, 0], found[:, 2]], 1)
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run repeats after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than the space and U+0009 to U+000D, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def with_stutter(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's planted repetition: from word a on, a tenth of the texts repeat their next p words."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + p]
    return words[:a] + (again * -(-(n - a) // p))[: n - a]


def detect_runs(docs: DataFrame, id_column: str = "doc_id", prepared=None) -> DataFrame:
    """Rows (id, runs array<start, length, period>, collapsed) of whole texts, one for each row.

    A run is a stretch of words with smallest period q, at least six words and four periods long, that
    no neighbour extends; ``collapsed`` is the text, its words joined by single spaces, without what
    runs repeat.  Null and empty texts have no runs and an empty text; texts of any length are taken
    whole (memory grows with the longest text of a batch, about 400 bytes a word); ties in start go
    by period; repeated rows are judged one by one; no rows give no rows; other columns are ignored.
    ``prepared``: a function of id and words that returns the words to use.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            at = 0
            for part in by_size(batch.column(1).to_pylist(), TOGETHER):
                texts = [words_of(t) for t in part]
                if prepared is not None:
                    texts = [prepared(i, w) for i, w in zip(ids.slice(at, len(part)).to_pylist(), texts, strict=True)]
                runs = text_runs(texts)
                sizes = np.array([len(r) for r in runs], np.int32)
                flat = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
                fields = [pa.array(flat[:, c]) for c in range(3)]
                made = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"])
                )
                kept = pa.array([b" ".join(collapse(w, r)) for w, r in zip(texts, runs, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), made, kept], [batch.schema.names[0], "runs", "collapsed"])
                at += len(part)

    kind = docs.schema[id_column].dataType.simpleString()
    own = docs.select(F.col(id_column), F.col("text").alias("_text"))
    made = own.mapInArrow(run, f"`{id_column}` {kind}, runs array<struct<{_RUN}>>, collapsed binary")
    return made


@query("op13_periods")
def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    found = detect_runs(docs, prepared=with_stutter)
    best = F.expr(
        "reduce(runs, cast(null as struct<start bigint, length bigint, period bigint>), "
        "(b, r) -> case when b is null or cast(r.length as decimal(19,0)) * b.period > cast(b.length as decimal(19,0)) * r.period then r else b end)"
    )
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    own = found.select("doc_id", "runs", best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    head = [F.col(f"b.{c}").alias(c) for c in ("start", "length", "period")]
    return own.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *head,
        F.expr("(1000 * b.length) div b.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
