"""Repair of conversations by Hirschberg's divide and conquer over the edits of their rows.

A repaired conversation spells ``(s?(ua)+)?`` in the initials of its roles. Four states
read that: nothing yet, after s, after u, after a. Every row is kept, given another
role or deleted, and rows may be inserted; from each state one role is next, so a
string of edits says all about a repair. Edits in front of a boundary between rows end
with a row's own edit, so two such strings never begin one another, and a vector of
(cost, rank) for the four states holds all that matters of what lies before: the
cheapest way into each state, and the order of these ways as strings.

Forward vectors of the first half of a conversation and backward vectors of the second
half meet in the middle. Of the crossings whose costs add up to the least one, that
with the least string before it is taken, and both halves go on alone between known
states. No more than a vector is kept of what was read, so space is linear.

Spark spreads long conversations too. Rows are dealt by range of (conversation, turn)
and cut into segments; a segment of a long conversation becomes a matrix of four
vectors, and matrices are multiplied in groups until one stands for the conversation.
The way back finds the states between the members of each group by the same recursion,
down to the segments, which then find the edits of their rows at once.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import written

STATES = range(4)
# The state after the next role is read, its initial, and the rows that are missing at the end.
NEXT, WANTED, MISSING = (2, 2, 3, 2), "uuau", (0, 2, 1, 0)
ROLES = {"u": "user", "a": "assistant"}
INITIALS = "sua"
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
NEVER = 1 << 60
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
# Rows of a segment, and members of a group (as a power of two).
SEGMENT, FAN = 4096, 8
# Segments of a task, as a power of two.
TASK = 32

Vector = tuple[tuple[int, int], ...]
Matrix = tuple[Vector, ...]

WHITE = " \t\n\x0b\x0c\r"


def _ways(code: int) -> list[list[tuple[int, str, int]]]:
    """(cost, edits, next state) from every state for a row: its initial in the low two bits, its fault above."""
    initial, fault = code & 3, code >> 2
    found = []
    for state in STATES:
        ways = [(DELETE, "D", state)]
        if fault in (NONE, TRUNCATED):
            more = CUT if fault == TRUNCATED else 0
            for inserts in range(2):
                at = NEXT[state] if inserts else state
                read = NEXT[at] if initial < 3 and INITIALS[initial] == WANTED[at] else 1 if initial == 0 and at == 0 else None
                if read is not None:
                    ways.append((inserts * INSERT + more, "I" * inserts + "K", read))
                ways.append((inserts * INSERT + REROLE + more, "I" * inserts + "R", NEXT[at]))
        found.append(ways)
    return found


WAYS = [_ways(code) for code in range(16)]


def _ranked(ends: list[tuple[int, object]]) -> Vector:
    """Costs with the order of what leads to them; ``ends`` has (cost, anything that sorts) for each state."""
    order = {way: i for i, way in enumerate(sorted({way for cost, way in ends if cost < NEVER}))}
    return tuple((cost, order[way]) if cost < NEVER else (NEVER, 0) for cost, way in ends)


def _row(code: int) -> Matrix:
    """The cheapest edits of one row, of equal ones the least as a string, from every state into every state."""
    return tuple(
        _ranked([min(((cost, edits) for cost, edits, end in ways if end == state), default=(NEVER, "")) for state in STATES])
        for ways in WAYS[code]
    )


ROWS = [_row(code) for code in range(16)]
START: list[Vector] = [tuple((0, 0) if s == state else (NEVER, 0) for s in STATES) for state in STATES]
#: Costs of what is missing at the end of a conversation.
FINISH = tuple(INSERT * n for n in MISSING)


def forward(vector: Vector, matrix: Matrix) -> Vector:
    """The vector after one more row or segment."""
    ends = []
    for state in STATES:
        ways = [(cost + matrix[s][state][0], (rank, matrix[s][state][1])) for s, (cost, rank) in enumerate(vector) if cost < NEVER and matrix[s][state][0] < NEVER]
        ends.append(min(ways, default=(NEVER, (0, 0))))
    return _ranked(ends)


def backward(costs: tuple[int, ...], matrix: Matrix) -> tuple[int, ...]:
    """The least cost from every state to the end, one row or segment earlier."""
    return tuple(min(min(matrix[state][s][0] + costs[s], NEVER) for s in STATES) for state in STATES)


class Steps:
    """Vectors over a row of matrices; equal steps from equal vectors are worked out once."""

    def __init__(self, matrices: list[Matrix] | tuple[Matrix, ...], row: bytes | range):
        self.matrices, self.row = matrices, row
        self.ahead: dict[tuple[Vector, int], tuple[int, Vector]] = {}
        self.back: dict[tuple[tuple[int, ...], int], tuple[int, tuple[int, ...]]] = {}

    def forward(self, lo: int, hi: int, vector: Vector) -> Vector:
        total, ahead = 0, self.ahead
        for code in self.row[lo:hi]:
            step = ahead.get((vector, code))
            if step is None:
                after = forward(vector, self.matrices[code])
                least = min(cost for cost, _ in after)
                step = ahead[vector, code] = (least, tuple((min(cost - least, NEVER), rank) if cost < NEVER else (NEVER, 0) for cost, rank in after))
            total += step[0]
            vector = step[1]
        return tuple((cost + total, rank) if cost < NEVER else (NEVER, 0) for cost, rank in vector)

    def backward(self, lo: int, hi: int, costs: tuple[int, ...]) -> tuple[int, ...]:
        total, back = 0, self.back
        for code in self.row[lo:hi][::-1]:
            step = back.get((costs, code))
            if step is None:
                before = backward(costs, self.matrices[code])
                least = min(before)
                step = back[costs, code] = (least, tuple(c - least if c < NEVER else NEVER for c in before))
            total += step[0]
            costs = step[1]
        return tuple(c + total if c < NEVER else NEVER for c in costs)

    def crossings(self, lo: int, hi: int, start: int, finish: tuple[int, ...]) -> Iterator[tuple[int, int]]:
        """(state before, state after) of every step from ``lo`` to ``hi`` on the least of the cheapest ways."""
        middle = lo + 1 if hi - lo == 1 else (lo + hi) // 2
        ahead = self.forward(lo, middle, START[start])
        behind = self.backward(middle, hi, finish)
        state = min(STATES, key=lambda s: (min(ahead[s][0] + behind[s], NEVER), ahead[s][1] if ahead[s][0] < NEVER else 4))
        if hi - lo == 1:
            yield start, state
            return
        yield from self.crossings(lo, middle, start, exactly(state))
        yield from self.crossings(middle, hi, state, finish)


def exactly(state: int) -> tuple[int, ...]:
    return tuple(0 if s == state else NEVER for s in STATES)


_CODES: dict[str, dict] = {"ahead": {}, "back": {}}


def _row_steps(codes: bytes) -> Steps:
    steps = Steps(ROWS, codes)
    # Rows have sixteen codes, so vectors recur all over; there are few.
    steps.ahead, steps.back = _CODES["ahead"], _CODES["back"]
    return steps


def edits(codes: bytes, start: int = 0, end: int | None = None) -> tuple[int, str, int]:
    """(cost, edits, last state) of rows from one state to another; without ``end``, to the end of a conversation."""
    if not codes:
        return FINISH[start], "I" * MISSING[start], start
    total, found, after = 0, [], start
    for code, (before, after) in zip(codes, _row_steps(codes).crossings(0, len(codes), start, FINISH if end is None else exactly(end))):
        cost, way = min((cost, way) for cost, way, state in WAYS[code][before] if state == after)
        total += cost
        found.append(way)
    if end is None:
        total += FINISH[after]
        found.append("I" * MISSING[after])
    return total, "".join(found), after


def matrix(codes: bytes) -> list[int]:
    """Costs and ranks from every state into every state over some rows, as 32 numbers."""
    steps = _row_steps(codes)
    return _flat(tuple(steps.forward(0, len(codes), START[s]) for s in STATES))


def _flat(m: Matrix) -> list[int]:
    return [x for vector in m for pair in vector for x in pair]


def _matrix(flat) -> Matrix:
    return tuple(tuple((int(flat[8 * s + 2 * t]), int(flat[8 * s + 2 * t + 1])) for t in STATES) for s in STATES)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) after damage by ``crc32(conv_id:turn) % 20``; dropped rows have copy -1.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes the role user.
    """
    blank = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    kind = F.crc32(name) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(kind == 0, F.array(F.lit(-1))).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _content() -> Column:
    """A row's role and text in 16 bytes."""
    return F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def _code() -> Column:
    """Initial and fault of a row by itself."""
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    fault = F.when(end == "", BLANK).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    first = F.left("role", F.lit(1))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return (initial + 4 * fault).cast("int")


ORDER = ["conv_id", "turn", "content", "copy"]


def _segments(rows: DataFrame, most: int) -> DataFrame:
    """Segments of conversations: codes of up to ``most`` rows with what can be counted, under the key of the first row."""
    repeats = rows.select("conv_id", "turn", "content", "copy")
    at = F.struct(F.col("turn").isNotNull().alias("t"), "turn", "copy")
    first = repeats.groupBy("conv_id", "content").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("content").alias("x"), "first")
    seen = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("content") == F.col("x")), "left")
    again = F.coalesce(F.struct(F.col("turn").isNotNull().alias("t"), "turn", "copy") > F.col("first"), F.lit(False))
    seen = written(seen.select(*ORDER, "code", again.alias("again")), "turns")
    dealt = seen.repartitionByRange("conv_id", "turn", "content", "copy").sortWithinPartitions(*ORDER)
    kind = dict(rows.dtypes)["conv_id"]
    schema = (
        f"conv_id {kind}, turn bigint, content binary, copy int, at bigint, codes binary, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
        " first int, last int, low bigint, high bigint, turns bigint, last_turn bigint"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Segments are numbered through the ranges, which follow each other like the rows.
        number = TaskContext.get().partitionId() << TASK
        kinds, held, codes, now, before = None, [], bytearray(), None, None

        def settle() -> None:
            nonlocal number
            conv, turn, content, copy = now
            faults = [0] * 4
            for code in codes:
                faults[code >> 2] += 1
            initials = [code & 3 for code in codes]
            illegal = sum((a, b) not in LEGAL for a, b in zip(initials, initials[1:]))
            held.append((conv, turn, content, copy, number, bytes(codes), *faults[1:], illegal, initials[0], initials[-1], low, high, turns, last))
            number += 1

        low = high = last = None
        turns = 0
        for batch in batches:
            if kinds is None:
                kinds = [batch.schema.field(0).type, pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.int32(), pa.int32(), *[pa.int64()] * 4]
            for conv, turn, content, copy, code, again in zip(*[c.to_pylist() for c in batch.columns]):
                if codes and (conv != now[0] or len(codes) >= most):
                    settle()
                    codes = bytearray()
                if not codes:
                    now, low, high, turns, last = (conv, turn, content, copy), None, None, 0, None
                if turn is not None:
                    low, high, turns, last = turn if low is None else low, turn, turns + (turn != last), turn
                # An equal row of the same place counts as well; those next to each other include all.
                if (again or (conv, turn, content) == before) and code >> 2 != BLANK:
                    code = code & 3 | DUPLICATE << 2
                before = (conv, turn, content)
                codes.append(code)
                if len(held) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                    held.clear()
        if codes:
            settle()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    names = [part.split()[0] for part in schema.split(",")]
    return dealt.select(*ORDER, "code", "again").mapInArrow(run, schema)


# Neighbouring initials su, ua, au as numbers.
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _grouped(nodes: DataFrame, work: Callable, kind: str, out: str) -> DataFrame:
    """``work`` on the rows of each (conv_id, up), in the order of ``at``."""
    def run(frame):
        return work(frame.sort_values("at"))

    return nodes.groupBy("conv_id", "up").applyInPandas(run, out.replace("KIND", kind))


def _product(group):
    """One matrix for the members of a group."""
    first, rest = group["m"].iloc[0], list(group["m"])[1:]
    product = list(_matrix(first))
    for flat in rest:
        following = _matrix(flat)
        product = [forward(vector, following) for vector in product]
    out = group.iloc[:1][["conv_id", "up"]].copy()
    out["m"] = [_flat(tuple(product))]
    return out.rename(columns={"up": "at"})


def _between(group):
    """The states before and after each member, from those of the group; end -1 is the end of a conversation."""
    end = int(group["end"].iloc[0])
    steps = Steps([_matrix(flat) for flat in group["m"]], range(len(group)))
    states = list(steps.crossings(0, len(group), int(group["start"].iloc[0]), FINISH if end < 0 else exactly(end)))
    out = group[["conv_id", "at"]].copy()
    out["start"] = [a for a, _ in states]
    out["end"] = [b for _, b in states]
    if end < 0:
        out.iloc[-1, out.columns.get_loc("end")] = -1
    return out


def _states(segments: DataFrame) -> DataFrame | None:
    """(conv_id, at, start, end) of the segments of conversations that have several; None if none has."""
    many = segments.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"))
    long = segments.join(many, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    long = written(long.select("conv_id", "at", F.udf(lambda codes: matrix(bytes(codes)), "array<bigint>")("codes").alias("m")), "matrices")
    highest = long.agg(F.max("at")).first()[0]
    if highest is None:
        return None
    kind = dict(segments.dtypes)["conv_id"]
    levels, shift = [long], TASK
    while highest:
        highest >>= shift
        nodes = levels[-1].withColumn("up", F.shiftright("at", shift))
        levels[-1] = nodes
        levels.append(written(_grouped(nodes, _product, kind, "conv_id KIND, at bigint, m array<bigint>"), "matrices"))
        shift = FAN
    ends = levels.pop().select("conv_id", "at", F.lit(0).alias("start"), F.lit(-1).alias("end"))
    for nodes in reversed(levels):
        above = ends.select(F.col("conv_id").alias("c"), F.col("at").alias("above"), "start", "end")
        met = nodes.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("above")))
        ends = written(_grouped(met.select("conv_id", "up", "at", "m", "start", "end"), _between, kind, "conv_id KIND, at bigint, start int, end int"), "states")
    return ends


def _audited(segments: DataFrame, states: DataFrame | None) -> DataFrame:
    """Segments with the edits of their rows and what these cost."""
    whole = segments.withColumn("start", F.lit(0)).withColumn("end", F.lit(-1))
    if states is not None:
        known = states.select(F.col("conv_id").alias("c"), F.col("at").alias("a"), F.col("start").alias("s"), F.col("end").alias("e"))
        whole = segments.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("at") == F.col("a")), "left")
        whole = whole.withColumn("start", F.coalesce("s", F.lit(0))).withColumn("end", F.coalesce("e", F.lit(-1))).drop("c", "a", "s", "e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("codes", "start", "end")])
            found = [edits(codes, start, None if end < 0 else end) for codes, start, end in rows]
            columns = [batch.column(c) for c in KEPT]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=[*KEPT, "cost", "edits"])

    types = dict(segments.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in KEPT) + ", cost bigint, edits string"
    return whole.select(*KEPT, "codes", "start", "end").mapInArrow(run, schema)


KEPT = ["conv_id", "turn", "content", "copy", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "last_turn"]
RESULTS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


class Conversation:
    """What a conversation comes to, as its segments and rows pass by in order."""

    def __init__(self, conv, keep: bool):
        self.conv, self.sums, self.illegal, self.cost = conv, [0] * 3, 0, 0
        self.low = self.high = self.last_turn = self.last = None
        self.turns, self.audit, self.todo = 0, [], deque()
        self.state, self.hash, self.any, self.keep, self.lines = 0, hashlib.sha256(), False, keep, []

    def segment(self, blank, duplicate, truncated, illegal, first, last, low, high, turns, last_turn, cost, found) -> None:
        self.sums = [a + b for a, b in zip(self.sums, (blank, duplicate, truncated))]
        self.illegal += illegal + (self.last is not None and (self.last, first) not in LEGAL)
        self.last = last
        if low is not None:
            self.turns += turns - (low == self.last_turn)
            self.low, self.high, self.last_turn = low if self.low is None else self.low, high, last_turn
        self.cost += cost
        self.audit.append(found)
        self.todo.extend(found)

    def line(self, role: str, text: str) -> None:
        line = f"{role}:{text}"
        self.hash.update(("\n" + line if self.any else line).encode("utf-8", "surrogatepass"))
        self.any = True
        if self.keep:
            self.lines.append((role, text))

    def row(self, role: str, text: str) -> None:
        while (edit := self.todo.popleft()) == "I":
            self.insert()
        if edit == "K":
            self.state = 1 if role[:1] == "s" else NEXT[self.state]
            self.line(role, text)
        elif edit == "R":
            self.line(ROLES[WANTED[self.state]], text)
            self.state = NEXT[self.state]

    def insert(self) -> None:
        self.line(ROLES[WANTED[self.state]], "")
        self.state = NEXT[self.state]

    def result(self) -> tuple:
        while self.todo:
            self.todo.popleft()
            self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.sums, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest(), self.lines)


def _streamed(parts: DataFrame, keep: bool) -> DataFrame:
    """One row for each conversation from its segments and rows, sorted; a row's text is held only while it is read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, kind = None, [], None

        def out() -> pa.RecordBatch:
            arrays = [pa.array(c, k) for c, k in zip(zip(*done), [kind, *[pa.int64()] * 6, pa.string(), pa.string(), lines])]
            return pa.RecordBatch.from_arrays(arrays, names=[*RESULTS, "repaired"])

        lines = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, mark, role, text, *segment in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.result())
                        if len(done) >= 1024 or keep:
                            yield out()
                            done = []
                    now = Conversation(conv, keep)
                if mark == 1:
                    now.segment(*segment)
                elif mark == 2:
                    now.row(role, text)
        if now is not None:
            done.append(now.result())
        if done:
            yield out()

    kind = dict(parts.dtypes)["conv_id"]
    schema = f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string, repaired array<struct<role: string, text: string>>"
    names = ["conv_id", "mark", "role", "text", *KEPT[4:], "cost", "edits"]
    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "gone", "turn", "content", "copy", "mark")
    return dealt.select(*names).mapInArrow(run, schema)


def repair(rows: DataFrame, keep_lines: bool = False, segment: int = SEGMENT) -> DataFrame:
    """Damage-free audit of (conv_id, turn, role, text, copy) rows: RESULTS and, with ``keep_lines``, the repaired rows.

    Rows of one conversation stand by turn, nulls first; those of one turn by a hash of
    role and text. A row is blank without a character beyond ASCII white space,
    duplicate if an earlier row has its role and text, truncated if its last such
    character is none of ``.!?``; the first of these counts. A role whose initial is not
    s, u or a is never kept as it is. Rows with a null conv_id are one conversation. A
    conversation whose rows all have copy -1 has zeros, an empty audit and the hash of
    nothing. The repaired text of a conversation passes through one task as a stream,
    since SHA-256 reads its input in order; its edits are found by many.
    """
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "copy").withColumn("content", _content())
    left = rows.filter("copy >= 0")
    segments = written(_segments(left.select(*ORDER, _code().alias("code")), segment), "segments")
    audited = _audited(segments, _states(segments))
    types = {**dict(audited.dtypes), "mark": "int", "gone": "boolean", "role": "string", "text": "string"}
    columns = ["conv_id", "gone", "turn", "content", "copy", "mark", "role", "text", *KEPT[4:], "cost", "edits"]
    empty = lambda c: F.lit(None).cast(types[c]).alias(c)
    marks = audited.withColumn("mark", F.lit(1)).withColumn("gone", F.lit(False))
    marks = marks.select(*[F.col(c) if c in marks.columns else empty(c) for c in columns])
    gone = F.col("copy") < 0
    texts = rows.withColumn("gone", gone).withColumn("mark", F.when(gone, 0).otherwise(2))
    texts = texts.withColumn("text", F.when(~gone, F.col("text"))).withColumn("content", F.when(~gone, F.col("content")))
    texts = texts.select(*[F.col(c) if c in texts.columns else empty(c) for c in columns])
    out = _streamed(marks.unionByName(texts), keep_lines)
    return out if keep_lines else out.drop("repaired")
