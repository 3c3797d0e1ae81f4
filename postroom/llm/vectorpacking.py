"""Vector bin packing of tokenised examples by the dot-product heuristic (operator 12).

An example needs tokens, one segment, and loss-bearing tokens; a sequence offers a limit on each.
Sequences are filled one at a time: of the examples that still fit, the one whose need has the largest
dot product with what is left (both as shares of the limits, weighted by how much of a limit the
waiting examples need) goes in next.  When none fits whole, one is cut to fill the place.  A sequence
that the other limits end early gives tokens back until its length is a power of two, as only
other lengths are padded.  Each task packs what it tokenises, from a window of waiting examples, so
nothing is shuffled and memory is bounded by the window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.llm.packing import Encoder, default_tokenizer
from postroom.llm.registry import prepare, query, table

END_ID = 0
#: Examples that wait in a task; packing stops when half of them are left, to keep a choice.
WINDOW = 4_096
#: Bits of a sequence id that number the sequences of one task.
OWN_BITS = 40


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


@dataclass
class Example:
    """What is left of a document: tokens from ``start`` on; those from ``loss_from`` on bear loss."""

    doc_id: int | None
    ids: bytes
    start: int
    loss_from: int
    base: int = 0  # tokens before those that ``ids`` still holds

    @property
    def size(self) -> int:
        return self.base + len(self.ids) // 4

    def held(self, start: int, end: int) -> bytes:
        return self.ids[4 * (start - self.base) : 4 * (end - self.base)]

    def forget(self) -> None:
        """Drop the ids before ``start``, so that a waiting example holds only what is left of it."""
        self.ids, self.base = self.held(self.start, self.size), self.start

    def loss(self, start: int, end: int) -> int:
        """Loss-bearing tokens of [start, end); the end token bears loss like the text before it."""
        return max(0, end - max(start, self.loss_from))

    def end_within(self, start: int, room: int, loss: int) -> int:
        """Largest end of a piece from ``start`` with at most ``room`` tokens and ``loss`` loss-bearing ones."""
        return min(self.size, start + room, max(start, self.loss_from) + loss)


@dataclass
class Packer:
    """Packs the examples of one task; ``done`` holds (sequence, example, start, end) in order of place."""

    limits: Limits
    window: int = WINDOW
    waiting: list[Example] = field(default_factory=list)
    done: list[list[tuple[Example, int, int]]] = field(default_factory=list)

    def add(self, example: Example) -> None:
        most = self.limits.tokens
        # Whole sequences of one long document need no choice.
        while example.size - example.start >= most and example.loss(example.start, example.start + most) <= self.limits.loss:
            self.done.append([(example, example.start, example.start + most)])
            example.start += most
        if example.start < example.size:
            self.waiting.append(example)
        if len(self.waiting) >= self.window:
            self.pack(self.window // 2)

    def pack(self, leave: int = 0) -> None:
        """Fill sequences until at most ``leave`` examples wait."""
        limits, waiting = self.limits, self.waiting
        most = np.array([limits.tokens, limits.segments, limits.loss], float)
        # Needs by example; one that is used up needs more than any sequence offers.
        tokens = np.array([w.size - w.start for w in waiting], float)
        loss = np.array([w.loss(w.start, w.size) for w in waiting], float)
        weight = np.array([tokens.sum(), len(waiting), loss.sum()]) / most
        weight /= max(weight.max(), 1e-12)

        def measure(i: int) -> None:
            w = waiting[i]
            tokens[i], loss[i] = w.size - w.start, w.loss(w.start, w.size)

        left = len(waiting)
        while left > leave:
            room = most.copy()
            placed: list[tuple[int, int, int]] = []
            while room[0] > 0 and room[1] > 0 and left:
                by_token, by_segment, by_loss = weight * room / most**2
                pull = tokens * by_token + loss * by_loss + by_segment
                whole = np.where((tokens <= room[0]) & (loss <= room[2]), pull, -1)
                i = int(whole.argmax())
                if whole[i] >= 0:
                    end = waiting[i].size
                else:  # none fits whole: one is cut
                    i = int(np.where(tokens < np.inf, pull, -1).argmax())
                    end = waiting[i].end_within(waiting[i].start, int(room[0]), int(room[2]))
                    if end <= waiting[i].start:
                        break  # no loss-bearing token fits any more
                w = waiting[i]
                placed.append((i, w.start, end))
                room -= (end - w.start, 1, w.loss(w.start, end))
                w.start = end
                measure(i)
                if w.start == w.size:
                    tokens[i] = np.inf
                    left -= 1
            filled = limits.tokens - int(room[0])
            back = 0 if filled == limits.tokens else filled - (1 << (filled.bit_length() - 1))
            while back:  # only powers of two are not padded
                i, start, end = placed.pop()
                keep = max(start, end - back)
                back -= end - keep
                left += tokens[i] == np.inf
                waiting[i].start = keep
                measure(i)
                if keep > start:
                    placed.append((i, start, keep))
            self.done.append([(waiting[i], start, end) for i, start, end in placed])
        self.waiting = [w for w in waiting if w.start < w.size]


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    limits: Limits | None = None,
    end_id: int = END_ID,
    prompt: Column | None = None,
    keep_ids: bool = False,
    window: int = WINDOW,
) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, segments, loss_tokens[, ids]).

    One row per piece.  An example is the ids of ``prompt`` (bears no loss; none if null), then those of
    the text, then ``end_id``; cuts lie anywhere, pieces of one document may lie in any sequences.
    ``segments`` and ``loss_tokens`` are the sequence's, never above the limits; the length of a sequence is
    the limit of tokens or a power of two.  Null and empty texts give the end id; texts of any length are cut;
    ties go to the example that waited longest; repeated rows and null ids are packed like any other row; no
    rows give no rows; columns other than doc_id, text and those of ``prompt`` are ignored.
    """
    limits, path = limits or Limits(), tokenizer or default_tokenizer()
    if min(limits.tokens, limits.segments, limits.loss) < 1 or limits.tokens & (limits.tokens - 1):
        raise ValueError("limits must be positive and that of tokens a power of two")
    prepare(docs.sparkSession)
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = _encoder(path), Packer(limits, window)
        sequence = TaskContext.get().partitionId() << OWN_BITS

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            out: list[tuple] = []
            for pieces in packer.done:
                loss, offset = sum(w.loss(a, b) for w, a, b in pieces), 0
                for w, a, b in pieces:
                    own = w.held(a, b)
                    out.append((w.doc_id, a, b - a, zlib.crc32(own), w.size, sequence, offset, len(pieces), loss, own if keep_ids else None))
                    offset += b - a
                sequence += 1
            packer.done.clear()
            for w in packer.waiting:
                if w.start > w.base:
                    w.forget()
            columns = list(zip(*out, strict=True)) or [[]] * 10
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], _NAMES)

        for batch in batches:
            for doc_id, head, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                first = encode(head.as_py() or "")
                ids = first + encode(text.as_py() or "") + last
                packer.add(Example(doc_id, ids, 0, len(first) // 4))
            yield flush()
        packer.pack()
        yield flush()

    own = docs.select(F.col("doc_id").cast("long"), (F.lit(None) if prompt is None else prompt).cast("string").alias("_prompt"), "text")
    made = own.mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in _NAMES))
    return made if keep_ids else made.drop("ids")


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segments", "loss_tokens", "ids"]
_KINDS = [pa.int64()] * 9 + [pa.binary()]
_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, added=True)
    return _ENCODERS[path]


@query("op12_vectorpacking")
def op12_vectorpacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
