"""Cheapest repair of conversation structure by a square-root checkpointed DP (operator 11).

A conversation must read ``(s?(ua)+)?`` in the initials of its roles: an automaton of four states,
in which a user's or assistant's turn has one place to go.  The least cost from a row on is a vector
over the states.  Rows are put in order by ranges, so that a conversation may span any number of tasks,
and are cut into blocks of about the square root of the longest conversation.  Backward, each block is a
min-plus matrix and only the vectors between blocks, the checkpoints, are kept.  Forward, every block
recomputes its own vectors from its checkpoint and walks from each state it may be entered in, taking
the least letter among the edits that keep the cost; the states at the checkpoints pick the walk.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postroom.llm.registry import prepare, query, table, written

#: Costs of an edit; a truncated row that stays costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: State after a user's or assistant's turn that is inserted or given a role, by state.
NEXT = (2, 2, 3, 2)
#: State after keeping a row, by initial and state.
KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: States: 0 nothing yet, 1 after the system's turn, 2 after the user's, 3 after the assistant's.
ROLE_AT = ("user", "user", "assistant", "user")
#: Cost of the inserts that end a conversation, by state.
AT_END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 50
#: A block is no shorter than this; conversations below it have one block.
LEAST_BLOCK = 256
#: Blocks and steps remembered in a worker; beyond it the memory is emptied.
REMEMBERED = 200_000

# One letter per row: initial (o: another) if sound, capital if truncated, the letter after it if it must go.
_SOUND, _CUT, _GONE = "suao", "SUAO", "tvbp"
_INITIAL = {c: "suao"[i] for kind in (_SOUND, _CUT, _GONE) for i, c in enumerate(kind)}


class Steps:
    """One row's step of the DP, remembered by the row's letter and the vector behind it."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, tuple], tuple] = {}

    def back(self, letter: str, after: tuple) -> tuple:
        """(vector before the row, what was taken off it, walk by state); ``after`` has the least value 0.

        A walk is (edits, their cost, state behind the row), e.g. ("IK", 2, 3).
        """
        key = (letter, after)
        if key in self.known:
            return self.known[key]
        gone = letter in _GONE
        more = TRUNCATED if letter in _CUT else 0
        keeps = KEEPS.get(_INITIAL[letter], {})
        edits = []  # by state, in the order of the letters: (cost to the end, letter, cost, state behind)
        for s in range(4):
            options = [(DELETE + after[s], "D", DELETE, s)]
            if not gone and s in keeps:
                options.append((more + after[keeps[s]], "K", more, keeps[s]))
            if not gone:
                options.append((REROLE + more + after[NEXT[s]], "R", REROLE + more, NEXT[s]))
            edits.append(options)
        plain = [min(o[0] for o in options) for options in edits]
        before = [min(plain[s], INSERT + plain[NEXT[s]], 2 * INSERT + plain[NEXT[NEXT[s]]]) for s in range(4)]
        walks = []
        for s in range(4):
            at, made, cost = s, "", 0
            while True:
                tight = [o for o in edits[at] if o[0] == before[at]]
                if tight and tight[0][1] == "D":
                    break
                if INSERT + before[NEXT[at]] == before[at]:
                    made, cost, at = made + "I", cost + INSERT, NEXT[at]
                    continue
                break
            _, letter_of, own, behind = tight[0]
            walks.append((made + letter_of, cost + own, behind))
        least = min(before)
        found = (tuple(min(v - least, NEVER) for v in before), least, tuple(walks))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known[key] = found
        return found

    def matrix(self, letters: str) -> list[int]:
        """Cost from state s before the letters to state t behind them at 4 s + t, without the inserts behind."""
        made = [NEVER] * 16
        for t in range(4):
            vector, total = tuple(0 if s == t else NEVER for s in range(4)), 0
            for c in reversed(letters):
                # Values beyond reach stay so, whatever is added to them.
                vector, taken = self._reach(c, vector)
                total += taken
            for s in range(4):
                made[4 * s + t] = min(NEVER, vector[s] + total) if vector[s] < NEVER else NEVER
        return made

    def _reach(self, letter: str, vector: tuple) -> tuple[tuple, int]:
        before, least, _ = self.back(letter, vector)
        return tuple(NEVER if v > NEVER // 2 else v for v in before), least

    def walk(self, letters: str, after: tuple) -> list[tuple[str, int, int]]:
        """By state before the letters: (edits, cost, state behind them), for the checkpoint behind them."""
        vectors = [after]
        for c in reversed(letters[1:]):
            vectors.append(self.back(c, vectors[-1])[0])
        made = []
        for s in range(4):
            at, edits, total = s, [], 0
            for k, c in enumerate(letters):
                own, cost, at = self.back(c, vectors[len(letters) - 1 - k])[2][at]
                edits.append(own)
                total += cost
            made.append(("".join(edits), total, at))
        return made


def normal(vector: list[int]) -> tuple:
    least = min(vector)
    return tuple(v - least for v in vector)


def checkpoints(matrices: list[list[int]]) -> list[list[int]]:
    """Vectors behind each of the blocks of one conversation, from the last to the first and turned round."""
    vectors = [list(AT_END)]
    for m in reversed(matrices[1:]):
        after = vectors[-1]
        vectors.append([min(m[4 * s + t] + after[t] for t in range(4)) for s in range(4)])
    return vectors[::-1]


def _per_batch(df: DataFrame, schema: str, rows_of) -> DataFrame:
    """``mapInArrow`` over rows as lists of values; ``rows_of(steps, columns)`` returns the columns of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(*rows_of(steps, batch))

    return df.mapInArrow(run, schema)


def in_order(conversations: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, same, place) of a written table; ``place`` numbers all rows in order.

    Order: conversation, turn (nulls first), role, text by its first 64 characters and then its SHA-256.
    Equal rows may lie in different ranges, so no conversation, turn or group of copies fills one task.
    """
    own = conversations.select(_key("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    keyed = own.withColumns({"same": F.unhex(F.sha2("text", 256)), "_copy": F.monotonically_increasing_id()})
    order = ["conv", F.asc_nulls_first("turn"), "role", F.left("text", F.lit(64)), "same", "_copy"]
    sorted_ = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(sorted_.select("conv", "turn", "role", "text", "same", F.monotonically_increasing_id().alias("place")), "conversations")


def _key(column: str) -> Column:
    """A conversation's id as text that is never null; a null id makes a conversation of its own."""
    return F.concat(F.when(F.col(column).isNull(), "n").otherwise("v"), F.coalesce(F.col(column).cast("string"), F.lit("")))


def faults(ordered: DataFrame) -> DataFrame:
    """Rows (conv, turn, place, fault, letter): the first fault of each row (blank, duplicate, truncated or null)."""
    seen = "[^\\x20\\x09-\\x0D]"
    blank = ~F.col("text").rlike(seen)
    # The first of the rows of a conversation that share role and text; places are unique, so the join has no hot key.
    firsts = ordered.where(~blank).groupBy("conv", "role", "same").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    narrow = ordered.select("conv", "turn", "place", F.left("role", F.lit(1)).alias("initial"), blank.alias("blank"), (~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")).alias("cut"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    at = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.col("initial")) * F.when(F.col("initial") == "", 0).otherwise(1), F.lit(0)), F.lit(4))
    kind = F.when(fault.isNull(), F.lit(_SOUND)).when(fault == "truncated", F.lit(_CUT)).otherwise(F.lit(_GONE))
    return narrow.join(firsts, "place", "left").select("conv", "turn", "place", fault.alias("fault"), F.substring(kind, at, F.lit(1)).alias("letter"))


def repair(conversations: DataFrame, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, edits) of conversations (conv_id, turn, role, text).

    summary: (conv, gaps, blank, duplicate, truncated, illegal, cost, trailing), one row per conversation.
    edits: (conv, place, step, edit, role, text) in order of place and step, one row per edit; ``text`` is
    null for a deleted row, empty for an inserted one; ``role`` is the row's new role, null if deleted.
    Null roles and texts count as one space; null turns come first; a null conv_id is a conversation of
    its own; equal turns are taken in the order of ``in_order``; repeated rows are duplicates; empty tables
    give empty tables; texts of any length are only read, by task; other columns are ignored.
    """
    spark = conversations.sparkSession
    prepare(spark)
    ordered = in_order(conversations)
    rows = written(faults(ordered), "faults")
    longest = rows.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    width = block or max(LEAST_BLOCK, math.isqrt(longest) + 1)
    of_block = F.floor(F.col("place") / F.lit(width)).alias("block")
    blocks = rows.groupBy("conv", of_block).agg(F.sort_array(F.collect_list(F.struct("place", "letter"))).alias("own"))
    # At most ``width`` letters a block.
    blocks = written(blocks.select("conv", "block", F.expr("transform(own, o -> o.place)").alias("places"), F.array_join("own.letter", "").alias("letters")), "blocks")

    def matrices(steps: Steps, batch: pa.RecordBatch):
        known: dict[str, list[int]] = {}
        texts = batch.column(2).to_pylist()
        for t in set(texts):
            known[t] = steps.matrix(t)
        return [batch.column(0), batch.column(1), pa.array([known[t] for t in texts], pa.list_(pa.int64()))], ["conv", "block", "matrix"]

    # One block needs no matrix; the others' meet by conversation, as many as the square root of its rows.
    alone = blocks.groupBy("conv").agg(F.count("*").alias("n"), F.min("block").alias("block"))
    many = blocks.join(alone.where("n > 1").select("conv"), "conv", "left_semi").select("conv", "block", "letters")
    chain = _per_batch(many, "conv string, block long, matrix array<long>", matrices)
    chain = chain.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "matrix"))).alias("own"))

    def ends(steps: Steps, batch: pa.RecordBatch):
        chains = batch.column(1).to_pylist()
        names = pa.array([[b["block"] for b in own] for own in chains], pa.list_(pa.int64()))
        made = pa.array([checkpoints([b["matrix"] for b in own]) for own in chains], pa.list_(pa.list_(pa.int64())))
        return [batch.column(0), names, made], ["conv", "blocks", "ends"]

    chain = _per_batch(chain, "conv string, blocks array<long>, ends array<array<long>>", ends)
    chain = chain.select("conv", F.inline(F.arrays_zip(F.col("blocks").alias("block"), F.col("ends").alias("end"))))
    single = alone.where("n = 1").select("conv", "block", F.array(*[F.lit(v).cast("long") for v in AT_END]).alias("end"))
    ended = blocks.join(chain.union(single), ["conv", "block"])

    def walks(steps: Steps, batch: pa.RecordBatch):
        known: dict[tuple, list] = {}
        made = []
        for letters, end in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            key = (letters, normal(end))
            if key not in known:
                known[key] = [{"edits": e, "cost": c, "behind": b} for e, c, b in steps.walk(*key)]
            made.append(known[key])
        kind = pa.list_(pa.struct([("edits", pa.string()), ("cost", pa.int64()), ("behind", pa.int32())]))
        return [*batch.columns[:4], pa.array(made, kind)], ["conv", "block", "places", "letters", "walks"]

    ended = ended.select("conv", "block", "places", "letters", "end")
    walked = written(_per_batch(ended, "conv string, block long, places array<long>, letters string, walks array<struct<edits string, cost long, behind int>>", walks), "walks")

    def enter(steps: Steps, batch: pa.RecordBatch):
        blocks_of, entries, behind, costs = [], [], [], []
        for own in batch.column(1).to_pylist():
            state, cost, at = 0, 0, []
            for b in own:
                at.append(state)
                cost += b["costs"][state]
                state = b["behind"][state]
            blocks_of.append([b["block"] for b in own])
            entries.append(at)
            behind.append(state)
            costs.append(cost)
        return [batch.column(0), pa.array(blocks_of, pa.list_(pa.int64())), pa.array(entries, pa.list_(pa.int32())), pa.array(behind, pa.int32()), pa.array(costs, pa.int64())], ["conv", "blocks", "entries", "behind", "cost"]

    hops = walked.select("conv", F.struct("block", F.col("walks.cost").alias("costs"), F.col("walks.behind").alias("behind")).alias("hop"))
    entered = hops.groupBy("conv").agg(F.sort_array(F.collect_list("hop")).alias("own"))
    entered = written(_per_batch(entered, "conv string, blocks array<long>, entries array<int>, behind int, cost long", enter), "entries")
    # Inserts behind the last row: what is missing to the end of a pair.
    trailing = F.element_at(F.array(*[F.lit(v // INSERT) for v in AT_END]), F.col("behind") + 1)
    entry = entered.select("conv", F.inline(F.arrays_zip(F.col("blocks").alias("block"), F.col("entries").alias("entry"))))
    taken = walked.join(entry, ["conv", "block"]).select("conv", "block", "places", "letters", F.col("entry"), F.expr("walks[entry].edits").alias("edits"))
    taken = written(taken, "taken")

    initials = F.translate("letters", _SOUND + _CUT + _GONE, "suao" * 3)
    legal = F.expr("size(filter(sequence(1, greatest(1, length(i) - 1)), k -> substring(i, k, 2) in ('su', 'ua', 'au')))")
    pairs = taken.select("conv", "block", initials.alias("i")).select("conv", "block", (F.length("i") - 1 - legal).cast("long").alias("bad"), F.left("i", F.lit(1)).alias("head"), F.right("i", F.lit(1)).alias("tail"))
    pairs = pairs.groupBy("conv").agg(F.sum("bad").alias("bad"), F.sort_array(F.collect_list(F.struct("block", "head", "tail"))).alias("e"))
    between = F.expr("size(filter(sequence(1, size(e)), k -> k < size(e) and concat(e[k - 1].tail, get(e, k).head) not in ('su', 'ua', 'au')))")
    illegal = pairs.select("conv", (F.col("bad") + between).alias("illegal"))
    spread = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = rows.groupBy("conv").agg(F.coalesce(spread, F.lit(0)).alias("gaps"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    summary = counts.join(illegal, "conv").join(entered.select("conv", trailing.cast("long").alias("trailing"), "cost"), "conv")
    summary = summary.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", (F.col("cost") + INSERT * F.col("trailing")).alias("cost"), "trailing")

    def spell(steps: Steps, batch: pa.RecordBatch):
        """Every edit as a row: its place, its step there and the role it gives (null: the row's own)."""
        conv, place, step, edit, role = [], [], [], [], []
        names = batch.column(0).to_pylist()
        for name, places, letters, state, edits in zip(names, *(batch.column(c).to_pylist() for c in range(1, 5)), strict=True):
            k = n = 0
            for e in edits:
                conv.append(name)
                place.append(places[k])
                step.append(n)
                edit.append(e)
                role.append(ROLE_AT[state] if e in "IR" else None)
                if e == "K":
                    state = KEEPS[_INITIAL[letters[k]]][state]
                elif e != "D":
                    state = NEXT[state]
                k, n = (k, n + 1) if e == "I" else (k + 1, 0)
        return [pa.array(conv, pa.string()), pa.array(place, pa.int64()), pa.array(step, pa.int32()), pa.array(edit, pa.string()), pa.array(role, pa.string())], ["conv", "place", "step", "edit", "role"]

    spelt = _per_batch(taken.select("conv", "places", "letters", "entry", "edits"), "conv string, place long, step int, edit string, role string", spell)
    stays = spelt.where("edit in ('K', 'R')").select("place", "step", "edit", F.col("role").alias("given"))
    kept = ordered.select("conv", "place", "role", "text").join(stays, "place").select("conv", "place", "step", "edit", F.coalesce("given", "role").alias("role"), "text")
    others = spelt.where("edit in ('I', 'D')").select("conv", "place", "step", "edit", "role", F.when(F.col("edit") == "I", "").alias("text"))
    after = F.explode(F.sequence(F.lit(1), F.col("trailing").cast("int"))).alias("step")
    behind = summary.where("trailing > 0").select("conv", F.lit((1 << 63) - 1).alias("place"), after, F.lit("I").alias("edit"), "trailing")
    role = F.when(F.col("trailing") - F.col("step") == 1, "user").otherwise("assistant")
    behind = behind.select("conv", "place", "step", "edit", role.alias("role"), F.lit("").alias("text"))
    return summary, kept.unionByName(others).unionByName(behind)


def digests(edits: DataFrame) -> DataFrame:
    """Rows (conv, audit, repaired_sha256) of the edits of each conversation.

    SHA-256 has to be taken in order, so a conversation's rows pass one task; they are streamed, not held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, sha, any_line = None, [], None, False
        done: list[tuple[str, str, str]] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * 3
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["conv", "audit", "repaired_sha256"])
            done.clear()
            return made

        for batch in batches:
            for conv, edit, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if conv != now:
                    if now is not None:
                        done.append((now, "".join(audit), sha.hexdigest()))
                    now, audit, sha, any_line = conv, [], hashlib.sha256(), False
                audit.append(edit)
                if line.is_valid:
                    if any_line:
                        sha.update(b"\n")
                    sha.update(line.as_py().encode("utf-8", "surrogatepass"))
                    any_line = True
            yield out()
        if now is not None:
            done.append((now, "".join(audit), sha.hexdigest()))
        yield out()

    line = F.concat("role", F.lit(":"), "text")
    rows = edits.select("conv", "place", "step", "edit", F.when(F.col("edit") != "D", line).alias("line"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "place", "step").select("conv", "edit", "line")
    return rows.mapInArrow(run, "conv string, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's planted faults, by the CRC-32 of ``conv_id:turn`` modulo 20; nulls count as one space."""
    space = F.lit(" ")
    own = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")])
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    own = own.withColumn("_fault", F.crc32(name.cast("binary")) % 20).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1))).alias("_copy")
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("_copy")


@query("op11_conversations")
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    summary, edits = repair(damaged(given))
    found = summary.join(digests(edits), "conv")
    empty = hashlib.sha256(b"").hexdigest()
    ids = given.select("conv_id").distinct().withColumn("conv", _key("conv_id"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    texts = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")]
    return ids.join(found, "conv", "left").select("conv_id", *zero.values(), *texts)
