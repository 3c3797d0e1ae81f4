from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from postroom.llm import conversations as op


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation, by its definition."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    kinds, seen = [], set()
    for _, _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "ok" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @cache
    def best(i: int, state: str, inserts: int):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        for c in "ua":
            if inserts < 4 and c in step[state]:
                cost, audit, made = best(i, step[state][c], inserts + 1)
                found.append((cost + 2, "I" + audit, (("user" if c == "u" else "assistant", ""), *made)))
        if i < len(rows):
            cost, audit, made = best(i + 1, state, 0)
            found.append((cost + 3, "D" + audit, made))
            if kinds[i] in ("ok", "truncated"):
                more = kinds[i] == "truncated"
                if initials[i] in step[state]:
                    cost, audit, made = best(i + 1, step[state][initials[i]], 0)
                    found.append((cost + more, "K" + audit, (rows[i][2:], *made)))
                for c in "ua":
                    if c in step[state]:
                        cost, audit, made = best(i + 1, step[state][c], 0)
                        found.append((cost + 2 + more, "R" + audit, (("user" if c == "u" else "assistant", rows[i][3]), *made)))
        return min(found, default=(1 << 60, "", ()), key=lambda f: f[:2])

    for i in range(len(rows), 0, -1):  # keeps the recursion flat
        for state in step:
            best(i, state, 0)
    cost, audit, made = best(0, "", 0)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def grouped(rows):
    found = {}
    for r in rows:
        found.setdefault(r[0], []).append(r)
    return found


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(spark, rows, block=None, tasks=3):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(tasks)
    summary, edits = op.repair(table, block)
    found = summary.join(op.digests(edits), "conv").collect()
    return {None if r.conv[0] == "n" else int(r.conv[1:]): tuple(r[n] for n in NAMES) for r in found}


def made_up(rng, conv, turns):
    texts = ["", " ", "Yes.", "No!", "So", "And then", "Why?", "End.  "]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "Assistant"]
    return [(conv, rng.choice([None, t, t, t]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"row {rng.random()}.") for t in range(turns)]


@pytest.mark.parametrize("block", [None, 4])
def test_against_all_edits(spark, block):
    rng = random.Random(7)
    rows = [r for conv in range(150) for r in made_up(rng, conv, rng.randrange(1, 14))]
    rows += made_up(rng, None, 9) + made_up(rng, 1000, 150)
    got = repaired(spark, rows, block)
    want = {conv: plain_repair(own) for conv, own in grouped(rows).items()}
    assert got == want


def test_blocks_meet_at_checkpoints():
    """The matrices give the vectors of the whole, and the walks between them its edits."""
    rng = random.Random(2)
    steps = op.Steps()
    for _ in range(300):
        letters = "".join(rng.choice("suaoSUAOtvbp" if rng.random() < 0.5 else "ua") for _ in range(rng.randrange(1, 40)))
        whole = steps.walk(letters, op.AT_END)[0]
        cuts = sorted({0, len(letters), *(rng.randrange(len(letters)) for _ in range(4))})
        parts = [letters[a:b] for a, b in zip(cuts, cuts[1:])]
        ends = op.checkpoints([steps.matrix(p) for p in parts])
        state, edits, cost = 0, "", 0
        for part, end in zip(parts, ends, strict=True):
            own, more, state = steps.walk(part, op.normal(end))[state]
            edits, cost = edits + own, cost + more
        assert (edits, cost, state) == whole


def test_query_against_the_definition(spark, sf):
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {conv: (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for conv in grouped(given)}
    want |= {conv: plain_repair(own) for conv, own in grouped(plain_damage(given)).items()}
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in op.op11_conversations(spark, sf).collect()}
    assert got == want


def test_nulls_repeats_empty_tables_and_other_columns(spark, tmp_path):
    rows = [(None, None, None, None, 1), (1, 0, "user", "Hi.", 2), (1, 0, "user", "Hi.", 2), (1, 1, "assistant", None, 3), (2, None, "assistant", "x" * 200_000, 4)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in op.op11_conversations(spark, str(tmp_path)).collect()}
    own = [r[:4] for r in rows]
    want = {conv: (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for conv in (None, 1, 2)}
    assert got == want | {c: plain_repair(g) for c, g in grouped(plain_damage(own)).items()}
    frame.where("false").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert op.op11_conversations(spark, f"{tmp_path}/none").count() == 0
    assert repaired(spark, own) == {c: plain_repair([(c, t, r or " ", " " if x is None else x) for _, t, r, x in g]) for c, g in grouped(own).items()}


def test_one_conversation_in_many_tasks(spark):
    """Equal and unequal turns of one conversation lie in several ranges and blocks."""
    rng = random.Random(11)
    rows = [(5, i // 3, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"t{i}."])) for i in range(900)]
    rows += [(6, 0, "user", "Copy.")] * 600
    got = repaired(spark, rows, block=16, tasks=8)
    assert got == {c: plain_repair(g) for c, g in grouped(rows).items()}
