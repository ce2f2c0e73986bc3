"""Conversation repair against a search over all edit sequences, and over a plain table of costs."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import conversations
from corpusloom.llm.store import table

SCHEMA = "conv_id long, turn long, role string, text string"
RIGHT = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        spot = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fault = zlib.crc32(spot.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def faults(rows):
    """The first fault of each of one conversation's rows, in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(BLANK)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def options(row, fault):
    _, _, role, text = row
    if fault not in ("blank", "duplicate"):
        extra = 5 if fault == "truncated" else 0
        yield extra, "K", (role, text)
        for made in ("user", "assistant"):
            yield extra + 1, "R", (made, text)
    yield 2, "D", None


def cheapest(rows, found):
    """(cost, audit, repaired) over all sequences of edits with at most one insertion; more never pay for few rows."""
    best = None
    for chosen in itertools.product(*[list(options(r, f)) for r, f in zip(rows, found)]):
        inserts = [None] + [(at, made) for at in range(len(rows) + 1) for made in ("user", "assistant")]
        for insert in inserts:
            steps = list(chosen)
            if insert:
                steps.insert(insert[0], (5, "I", (insert[1], "")))
            kept = [s[2] for s in steps if s[2]]
            if RIGHT.fullmatch("".join(role[:1] or " " for role, _ in kept)):
                one = (sum(s[0] for s in steps), "".join(s[1] for s in steps), "\n".join(f"{r}:{t}" for r, t in kept))
                best = min(best, one) if best else one
    return best


def plain(rows, found):
    """(cost, audit, repaired) from one table of costs and audits, without blocks or checkpoints."""
    after = {0: (0, "", ()), 1: None, 2: None, 3: (0, "", ())}
    turned = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    made = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

    def add(cost, mark, line, rest):
        return rest and (cost + rest[0], mark + rest[1], (line, rest[2]) if line else rest[2])

    def inserted(now):
        for _ in range(3):
            for state, (role, target) in made.items():
                one = add(5, "I", f"{role}:", now[target])
                if one and (now[state] is None or one[:2] < now[state][:2]):
                    now[state] = one
        return now

    after = inserted(after)
    for row, fault in zip(reversed(rows), reversed(found)):
        now = {}
        for state in range(4):
            choices = []
            for cost, mark, line in options(row, fault):
                if mark == "D":
                    choices.append(add(2, "D", None, after[state]))
                elif mark == "K" and (state, line[0][:1]) in turned:
                    choices.append(add(cost, "K", f"{line[0]}:{line[1]}", after[turned[state, line[0][:1]]]))
                elif mark == "R" and line[0] == made[state][0]:
                    choices.append(add(cost, "R", f"{line[0]}:{line[1]}", after[made[state][1]]))
            now[state] = min((c for c in choices if c), key=lambda c: c[:2], default=None)
        after = inserted(now)
    cost, audit, lines = after[0]
    out = []
    while lines:
        out.append(lines[0])
        lines = lines[1]
    return cost, audit, "\n".join(out)


def expected(rows, solve):
    """Report rows by conversation id."""
    out = {}
    broken = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in broken if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        found = faults(own)
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, text = solve(own, found) if own else (0, "", "")
        counts = [found.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def reported(spark, rows, **options):
    given = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = conversations.report(conversations.damaged(given), all_ids=given, **options).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r[1:]) for r in got}


def invented(rng, conv, n, roles=("user", "assistant", "system", "tool", None)):
    rows = []
    for turn in range(n):
        text = rng.choice(["Yes.", "No", "a b", "Why?", " ", "", None, "Is it? ok\n", "Same.", "x" * 50 + "!"])
        rows.append((conv, turn + rng.randint(0, 1) * 3 * n, rng.choice(roles), text))
    return list({r[1]: r for r in rows}.values())


def test_against_all_edit_sequences(spark):
    rng = random.Random(6)
    rows = [r for conv in range(120) for r in invented(rng, conv, rng.randint(1, 4))]
    rows += invented(rng, None, 4) + [(500, None, "user", "Hi."), (500, 3, "assistant", "Ho."), (501, None, None, None)]
    rng.shuffle(rows)
    want = expected(rows, cheapest)
    assert want == expected(rows, plain)
    assert reported(spark, rows) == want


@pytest.mark.parametrize("block", [1, 3, 50, conversations.BLOCK])
def test_blocks_of_long_conversations(spark, block):
    rng = random.Random(7)
    rows = [r for conv in range(3) for r in invented(rng, conv, 150 * conv + 40)]
    rows += [(9, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(300)]
    assert reported(spark, rows, block=block) == expected(rows, plain)


def test_a_row_repeated_very_often(spark):
    rows = [(1, 0, "user", "Hi.")] + [(1, 1, "user", "Ho.")] * 5000 + [(1, 2, "assistant", "Ha.")]
    got = conversations.report(spark.createDataFrame(rows, SCHEMA)).first()
    assert got.duplicate == 4999 and got.audit.count("D") == 5000 and got.illegal == 5000
    assert got.cost == 10000 and len(got.audit) == 5002


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be."), (1, 1, "user", "Hi."), (1, 2, "user", "Ho."), (1, 3, "assistant", "cut"), (2, 0, "assistant", "Yes.")]
    got = conversations.repaired(spark.createDataFrame(rows, SCHEMA), block=2).orderBy("conv_id", "position").collect()
    by_conv = {c: [(r.position, r.edit, r.turn, r.role, r.text) for r in got if r.conv_id == c] for c in (1, 2)}
    assert by_conv[1] == [
        (1, "K", 0, "system", "Be."), (2, "K", 1, "user", "Hi."), (3, "R", 2, "assistant", "Ho."), (4, "D", 3, None, None),
    ]
    assert by_conv[2] == [(1, "D", 0, None, None)]


def test_nothing_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.report(empty).count() == 0 and conversations.repaired(empty).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "Hi.")], SCHEMA).withColumns({"mark": F.lit(1), "kind": F.lit("x"), "edit": F.lit("D")})
    assert conversations.report(rows).first().audit == "D"


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert reported(spark, rows) == expected(rows, plain)
