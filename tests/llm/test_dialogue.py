"""Conversation repair against enumeration of all edits and a plain search, with segments of any length."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import dialogue

GOOD = re.compile(r"(s?(ua)+)?\Z")
WHITE = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    """The first fault of every (role, text)."""
    seen, found = set(), []
    for role, text in rows:
        bare = text.rstrip(WHITE)
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def enumerated(rows):
    """(cost, audit) by trying all edits with up to two rows inserted at every place."""
    found, choices = faults(rows), []
    inserts = [(3 * len(roles), "I" * len(roles), roles) for roles in ("", "u", "a", "ua", "au", "uu", "aa")]
    for (role, _), fault in zip(rows, found):
        ways = [(4, "D", "")]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault else 0
            ways += [(more, "K", role[:1] or "-"), (3 + more, "R", "u"), (3 + more, "R", "a")]
        choices += [inserts, ways]
    best = None
    for way in itertools.product(*choices, inserts):
        if GOOD.match("".join(w[2] for w in way)):
            best = min(best or (1 << 30, ""), (sum(w[0] for w in way), "".join(w[1] for w in way)))
    return best


def searched(rows):
    """The same for longer rows: least cost to the end from every state, then the least edit at every turn."""
    found, n = faults(rows), len(rows)
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    wanted = {0: "u", 1: "u", 2: "a", 3: "u"}

    def moves(i, state, inserts):
        out = []
        if i < n:
            out.append(("D", 4, i + 1, state, 0))
            if found[i] not in ("blank", "duplicate"):
                more = 3 if found[i] else 0
                if rows[i][0][:1] in after[state]:
                    out.append(("K", more, i + 1, after[state][rows[i][0][:1]], 0))
                out.append(("R", 3 + more, i + 1, after[state][wanted[state]], 0))
        if inserts < 2:
            out.append(("I", 3, i, after[state][wanted[state]], inserts + 1))
        return out

    @functools.cache
    def least(i, state, inserts):
        ends = [0] if i == n and state in (0, 3) else []
        return min([cost + least(*rest) for _, cost, *rest in moves(i, state, inserts)] + ends, default=1 << 30)

    at, audit, lines = (0, 0, 0), "", []
    while not (at[0] == n and at[1] in (0, 3) and least(*at) == 0):
        edit, cost, *rest = min(m for m in moves(*at) if m[1] + least(*m[2:]) == least(*at))
        if edit == "K":
            lines.append(":".join(rows[at[0]]))
        elif edit == "R":
            lines.append(f"{NAMES[wanted[at[1]]]}:{rows[at[0]][1]}")
        elif edit == "I":
            lines.append(f"{NAMES[wanted[at[1]]]}:")
        audit, at = audit + edit, tuple(rest)
    return least(0, 0, 0), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def code(role, fault):
    return ("sua".index(role[:1]) if role[:1] in ("s", "u", "a") else 3) + 4 * ["", "blank", "duplicate", "truncated"].index(fault)


def test_plain_search_equals_enumeration():
    rng = random.Random(1)
    for _ in range(150):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["Yes.", "cut", "", "Hm."])) for _ in range(rng.randrange(4))]
        assert searched(rows)[:2] == enumerated(rows), rows


def test_edits_equal_plain_search():
    rng = random.Random(2)
    for n in range(600):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["Yes.", "cut", "", "Hm.", f"{i}.", f"{i}"])) for i in range(rng.randrange(30))]
        codes = bytes(code(role, fault) for (role, _), fault in zip(rows, faults(rows)))
        assert dialogue.edits(codes)[:2] == searched(rows)[:2], rows


def test_halves_between_known_states():
    """Segments between the states of the whole give the whole's edits."""
    rng = random.Random(3)
    for _ in range(200):
        codes = bytes(rng.randrange(16) for _ in range(rng.randrange(2, 40)))
        whole = dialogue.edits(codes)
        cut = sorted(rng.sample(range(1, len(codes)), min(3, len(codes) - 1)))
        parts = [codes[a:b] for a, b in zip([0, *cut], [*cut, len(codes)])]
        steps = dialogue.Steps([dialogue._matrix(dialogue.matrix(p)) for p in parts], range(len(parts)))
        states = list(steps.crossings(0, len(parts), 0, dialogue.FINISH))
        found = [dialogue.edits(p, a, b if i < len(parts) - 1 else None) for i, (p, (a, b)) in enumerate(zip(parts, states))]
        assert (sum(f[0] for f in found), "".join(f[1] for f in found)) == whole[:2]


def damage(rows):
    """Rows of (conv, turn, role, text) in plain Python; dropped ones are left out."""
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(rows):
    left, found = damage(rows), {}
    for conv in {r[0] for r in rows}:
        own = [r for r in left if r[0] == conv]
        content = lambda r: hashlib.md5(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, content(r)))
        pairs = [(r[2], r[3]) for r in own]
        kinds = faults(pairs)
        turns = [r[1] for r in own if r[1] is not None]
        initials = [r[:1] for r, _ in pairs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found[conv] = (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, *searched(pairs))
    return found


SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string, at int, n int, mark int, end int"


@pytest.mark.parametrize("segment", [1, 3, 4096])
def test_conversations(spark, segment):
    rng = random.Random(segment)
    rows = []
    for conv in [*range(40), None]:
        turn = rng.randrange(3)
        for _ in range(rng.randrange(1, 12)):
            turn += rng.choice([0, 1, 1, 1, 1, 2, 4])
            text = rng.choice(["Yes.", "No!", "cut off", "", None, " \n", f"{turn} is it?", f"{turn} or \x0b", "é😀."])
            rows.append((conv, rng.choice([turn] * 9 + [None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), text))
    # One conversation with a third of all rows, most of them alike, and repeated rows.
    rows += [(7, i, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"{i}."])) for i in range(100, 250)]
    rows += rows[:20]
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA).repartition(4)
    out = dialogue.repair(dialogue.damaged(frame), segment=segment)
    assert out.columns == dialogue.RESULTS
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out.collect()}
    assert got == expected(rows)


def test_lines_nothing_left_and_empty(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"5:{i}".encode()) % 20 == 0)
    kept = next(i for i in range(1000) if zlib.crc32(f"6:{i}".encode()) % 20 > 4)
    frame = spark.createDataFrame([(5, dropped, "user", "Hi."), (6, kept, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")
    out = {r.conv_id: r for r in dialogue.repair(dialogue.damaged(frame), keep_lines=True).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(out[5])[1:9] == (0, 0, 0, 0, 0, 0, "", nothing) and out[5].repaired == []
    assert out[6].audit == "KI" and [tuple(line) for line in out[6].repaired] == [("user", "Hi."), ("assistant", "")]
    assert dialogue.repair(dialogue.damaged(frame.filter(F.lit(False)))).count() == 0
