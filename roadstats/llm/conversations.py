"""Conversation structure repair by weighted CYK parsing over spans.

A repaired conversation's role initials are ``(s?(ua)+)?``.  The grammar in Chomsky
normal form has a symbol X[p, q] for each pair of states of that language (nothing yet,
after s, after u, after a): X[p, q] derives the spans of rows whose edits lead from p to q.

* X[p, q] -> one row: kept, given the role user or assistant, or deleted;
* insertion closure: inserted turns before and after a row, or alone, are derived by the
  empty span, so that every cell is closed under them;
* X[p, q] -> X[p, r] X[r, q], for every r.

A cell holds the least (cost, audit) of each symbol.  Every span can be cut anywhere, as a
binary rule exists for each state in between; so one cut a span is enough, and cells are
combined bottom-up with spans that double in length.  Of two audits of one cost over the
same rows neither begins the other, so the least of the parts gives the least whole.

Rows are sorted by ranges of (conversation, turn), so a conversation of any size lies in
as many tasks as it fills.  A conversation inside one task is repaired there.  One that may go
on in the task before or after gives its span's cell; cells are combined in order, the
slices of the best audit go back to the spans, and the repaired text is hashed as it
streams past (SHA-256 of one text can't be split), a span's slice in memory at a time.

Defined cases: a null role or text is one space; rows are ordered by turn (nulls first),
then role, then text; roles are told by their first character, and an empty role has
none, so its row can't be kept; a null conv_id is a conversation; repeated rows are
duplicates; other columns are ignored; an empty table gives an empty result; a
conversation without rows has the empty repair.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadstats.llm.common import WHITE_SPACE, save, sent

#: The costs of the edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of a conversation that a task holds before it streams them on.
HELD = 20_000

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
STEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE = {"u": "user", "a": "assistant"}

#: least (cost, audit) by (state before, state after)
Cell = dict[tuple[int, int], tuple[int, str]]


def combined(left: Cell, right: Cell) -> Cell:
    """X[p, q] -> X[p, r] X[r, q]: the cell of two spans side by side."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            then = right.get((r, q))
            if then is None:
                continue
            total, known = cost + then[0], out.get((p, q))
            if known is None or total < known[0]:
                out[p, q] = (total, audit + then[1])
            elif total == known[0] and audit + then[1] < known[1]:
                out[p, q] = (total, audit + then[1])
    return out


def _closure() -> Cell:
    """The empty span: insertions alone, the fewest first."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    once = {(p, q): (INSERT, "I") for (p, role), q in STEP.items() if role in ROLE}
    for _ in range(3):
        longer = combined(cell, once)
        cell = {k: min(x for x in (cell.get(k), longer.get(k)) if x) for k in cell | longer}
    return cell


EMPTY = _closure()


@lru_cache(maxsize=None)
def row_cell(initial: str, must_go: bool, truncated: bool) -> Cell:
    """The closed cell of one row; ``initial`` is s, u, a or anything else."""
    edits: Cell = {(p, p): (DELETE, "D") for p in range(4)}

    def offer(p: int, q: int, cost: int, edit: str) -> None:
        edits[p, q] = min(edits.get((p, q), (cost, edit)), (cost, edit))

    for (p, role), q in STEP.items() if not must_go else ():
        if role == initial:
            offer(p, q, KEEP + TRUNCATED * truncated, "K")
        if role in ROLE:
            offer(p, q, REROLE + TRUNCATED * truncated, "R")
    return combined(combined(EMPTY, edits), EMPTY)


class _Short:
    """Cells of short spans, kept by what their rows are."""

    def __init__(self) -> None:
        self.cells: dict[tuple, Cell] = {}

    def __call__(self, rows: tuple) -> Cell:
        found = self.cells.get(rows)
        if found is None:
            if len(rows) == 1:
                found = row_cell(*rows[0])
            else:
                half = len(rows) // 2
                found = combined(self(rows[:half]), self(rows[half:]))
            if len(self.cells) > 20_000:
                self.cells.clear()
            self.cells[rows] = found
        return found


def span_cell(rows: list[tuple[str, bool, bool]], short: _Short | None = None) -> Cell:
    """The cell of consecutive rows (initial, must_go, truncated), combined by spans of doubling length."""
    short = short or _Short()
    cells = [short(tuple(rows[i:i + 4])) for i in range(0, len(rows), 4)]
    while len(cells) > 1:
        cells = [combined(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else EMPTY


def cheapest(cell: Cell, start: int = NOTHING) -> tuple[int, str]:
    return min(cell[start, q] for q in ENDS if (start, q) in cell)


def follow(audit: str, rows: Iterator[tuple[str, str]], state: int) -> Iterator[tuple[str, str, str, int]]:
    """(edit, role, text, state) of each edit of ``audit`` over ``rows`` (role, text); deletions too."""
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "K":
            state = STEP[state, role[:1]]
        elif edit != "D":
            initial = "a" if state == USER else "u"
            role, state = ROLE[initial], STEP[state, initial]
        yield edit, role, text, state


# --- rows ------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of ``conversations`` after the damage that crc32 of ``conv_id:turn`` modulo 20
    gives: 0 drops the row (``gone`` stays, so that its conversation is known), 1 empties its text, 2 removes its
    full stops and exclamation and question marks, 3 repeats it, 4 makes its role user."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
                                F.coalesce("text", space).alias("text"), kind.alias("kind"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"),
                       F.explode(times)).drop("col")


def _after(turn: Column, first: Column) -> Column:
    return F.coalesce(turn > first, turn.isNotNull() & first.isNull())


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, gone) with blank, open_end (no end mark) and again (role and text are in an
    earlier turn; repeats within a turn stand side by side and are told there)."""
    end = F.rtrim("text", F.lit(WHITE_SPACE))
    rows = rows.withColumns({"said": F.xxhash64("role", "text"), "blank": end == "",
                             "open_end": ~F.substring(end, -1, 1).isin(".", "!", "?")})
    # messages that two turns of a conversation hold: an aggregate with a map-side part, so that a hot one stays small
    first = rows.where("not gone").groupBy("conv_id", "said").agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.max(F.col("turn").isNull()).alias("none"))
    first = save(first.where("low <> high or (none and low is not null)").select(
        F.col("conv_id").alias("in_conv"), F.col("said").alias("of"), F.when(~F.col("none"), F.col("low")).alias("low"),
        F.lit(True).alias("twice")), "repair-repeated")
    joined = rows.join(sent(first, 32), rows["conv_id"].eqNullSafe(first["in_conv"]) & (rows["said"] == first["of"]), "left")
    return joined.select("conv_id", "turn", "role", "text", "gone", "blank", "open_end",
                         (F.coalesce("twice", F.lit(False)) & _after(F.col("turn"), F.col("low"))).alias("again"))


# --- spans within a task -----------------------------------------------------------------

class _Span:
    """Consecutive rows of one conversation: counts, and what its cell is made of."""

    def __init__(self, conv) -> None:
        self.conv, self.rows, self.kinds, self.cells, self.counts = conv, [], [], [], [0, 0, 0, 0, 0]
        self.low = self.high = self.first_turn = self.last_turn = None
        self.first = self.last = None  # initials
        self.distinct, self.previous, self.streamed = 0, None, False

    def add(self, turn, role: str, text: str, blank: bool, open_end: bool, again: bool) -> None:
        again = again or self.previous == (turn, role, text)
        self.previous = (turn, role, text)
        n, blanks, repeats, cut, illegal = self.counts
        cut_off = open_end and not blank and not again
        illegal += self.first is not None and self.last + role[:1] not in ("su", "ua", "au")
        self.counts = [n + 1, blanks + blank, repeats + (again and not blank), cut + cut_off, illegal]
        if self.first is None:
            self.first, self.first_turn = role[:1], turn
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += self.high is None or turn != self.high
            self.high = turn
        self.last, self.last_turn = role[:1], turn
        self.kinds.append((role[:1] if role[:1] in "sua" else "", blank or again, cut_off))

    def folded(self, short: _Short) -> None:
        """The rows so far as one cell, so that a span of any length holds its audits only."""
        if self.kinds:
            self.cells.append(span_cell(self.kinds, short))
            self.kinds = []

    def cell(self, short: _Short) -> Cell:
        self.folded(short)
        cells = self.cells
        while len(cells) > 1:
            cells = [combined(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
        return cells[0] if cells else EMPTY


def _hashed(digest, started: bool, audit: str, rows: Iterator[tuple[str, str]], state: int) -> tuple[bool, int]:
    for edit, role, text, state in follow(audit, rows, state):
        if edit != "D":
            digest.update((("\n" if started else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            started = True
    return started, state


NAMES = ["conv_id", "kind", "seg", "pos", "nums", "a", "b"]


def _records(schema_type: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [schema_type, pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string()]
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=NAMES)


def _spans(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to records: ``done`` (a conversation's result), ``cell`` and ``row`` (of spans that may go on elsewhere).

    seg: the task, in the order of the rows; pos: the row's place in its span."""
    seg, short, span, opened, out, kind = TaskContext.get().partitionId(), _Short(), None, True, [], None

    def told(s: _Span, at_edge: bool) -> list[tuple]:
        cell = s.cell(short)
        if at_edge or s.streamed:
            rows = [(s.conv, "row", seg, s.counts[0] - len(s.rows) + i, None, role, text) for i, (role, text) in enumerate(s.rows)]
            edge = [s.first, s.last, s.first_turn, s.last_turn, s.low, s.high]
            return [*rows, (s.conv, "cell", seg, -1, [*s.counts, s.distinct],
                            json.dumps([[p, q, c, a] for (p, q), (c, a) in cell.items()]), json.dumps(edge))]
        cost, audit = cheapest(cell)
        digest = hashlib.sha256()
        _hashed(digest, False, audit, iter(s.rows), NOTHING)
        n, blanks, repeats, cut, illegal = s.counts
        gaps = s.high - s.low + 1 - s.distinct if s.low is not None else 0
        return [(s.conv, "done", seg, -1, [gaps, blanks, repeats, cut, illegal, cost], audit, digest.hexdigest())]

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, turn, role, text, gone, blank, open_end, again in zip(*[c.to_pylist() for c in batch.columns]):
            if span is None or conv != span.conv:
                if span is not None:
                    out += told(span, opened)
                    opened = False
                span = _Span(conv)
            if not gone:
                span.add(turn, role, text, blank, open_end, again)
                span.rows.append((role, text))
                if len(span.rows) >= held:  # goes the way of spans at the edges, which holds no rows
                    span.folded(short)
                    start = span.counts[0] - len(span.rows)
                    out += [(conv, "row", seg, start + i, None, r, t) for i, (r, t) in enumerate(span.rows)]
                    span.rows, span.streamed = [], True
            if len(out) >= 2000:
                yield _records(kind, out)
                out = []
    if span is not None:
        out += told(span, True)
    if out:
        yield _records(kind, out)


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of conversations, in order, to one ``plan`` a span: its slice of the best audit (a), the state before it and,
    for the last, the conversation's numbers."""
    held, conv, kind = [], None, None

    def told() -> list[tuple]:
        best, path = {NOTHING: (0, "")}, []
        totals, gaps_low, gaps_high, distinct, last, last_turn = [0] * 5, None, None, 0, None, None
        for _, nums, text, edge in held:
            cell = {(p, q): (c, a) for p, q, c, a in json.loads(text)}
            came, new = {}, {}
            for (p, q), (c, a) in cell.items():
                if p in best and (q not in new or (best[p][0] + c, best[p][1] + a) < new[q]):
                    new[q], came[q] = (best[p][0] + c, best[p][1] + a), p
            path.append((came, cell))
            best = new
            first, end, first_turn, end_turn, low, high = json.loads(edge)
            if nums[0]:
                totals = [x + y for x, y in zip(totals, nums)]
                totals[4] += last is not None and last + first not in ("su", "ua", "au")
                distinct += nums[5] - (low is not None and low == gaps_high)
                gaps_low = low if gaps_low is None else gaps_low
                gaps_high, last, last_turn = high if high is not None else gaps_high, end, end_turn
        state = min((best[q], q) for q in ENDS if q in best)[1]
        cost, slices = best[state][0], []
        for came, cell in reversed(path):
            slices.append((came[state], cell[came[state], state][1]))
            state = came[state]
        gaps = gaps_high - gaps_low + 1 - distinct if gaps_low is not None else 0
        numbers = [gaps, *totals[1:], cost]
        return [(conv, "plan", seg, -1, [state, *(numbers if i == len(held) - 1 else [])], audit, None)
                for i, ((seg, *_), (state, audit)) in enumerate(zip(held, reversed(slices)))]

    for batch in batches:
        kind = batch.schema.field(0).type
        for c, seg, nums, text, edge in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "seg", "nums", "a", "b")]):
            if held and c != conv:
                yield _records(kind, told())
                held = []
            conv = c
            held.append((seg, nums, text, edge))
    if held:
        yield _records(kind, told())


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plans and rows, each plan before its span's rows, to ``done`` records; one slice in memory at a time."""
    kind, out = None, []
    digest, audits, started, state, rest, numbers = None, [], False, NOTHING, "", None

    def finish(conv) -> None:
        nonlocal started, state
        started, state = _hashed(digest, started, rest, iter(()), state)
        out.append((conv, "done", -1, -1, numbers, "".join(audits), digest.hexdigest()))

    current = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, what, nums, a, b in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "kind", "nums", "a", "b")]):
            if digest is not None and conv != current:
                finish(current)
                digest = None
            if digest is None:
                current, digest, audits, started, rest, numbers = conv, hashlib.sha256(), [], False, "", None
            if what == "plan":
                started, state = _hashed(digest, started, rest, iter(()), state)  # insertions at the end of a span
                state, rest = nums[0], a
                audits.append(a)
                numbers = nums[1:] or numbers
            else:
                at = len(rest) - len(rest.lstrip("I"))
                started, state = _hashed(digest, started, rest[:at + 1], iter([(a, b)]), state)
                rest = rest[at + 1:]
        if len(out) >= 2000:
            yield _records(kind, out)
            out = []
    if digest is not None:
        finish(current)
    if out:
        yield _records(kind, out)


def repair(rows: DataFrame, held: int = HELD) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, gone): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit and repaired_sha256."""
    found = faults(rows)
    ordered = found.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(
        "conv_id", "turn", "role", "text")
    kind = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {kind}, kind string, seg bigint, pos bigint, nums array<bigint>, a string, b string"
    records = save(ordered.mapInArrow(lambda batches: _spans(batches, held), schema), "repair-records")
    cells = records.where("kind = 'cell'").repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    plans = save(cells.mapInArrow(_plans, schema), "repair-plans")
    stream = plans.union(records.where("kind = 'row'")).repartition("conv_id").sortWithinPartitions("conv_id", "seg", "pos")
    done = records.where("kind = 'done'").union(stream.mapInArrow(_streamed, schema))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return done.select("conv_id", *[F.col("nums")[i].alias(n) for i, n in enumerate(names)],
                       F.col("a").alias("audit"), F.col("b").alias("repaired_sha256"))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text) of the repaired conversations of ``rows`` (conv_id, turn, role, text, gone).

    The audits of ``repair`` are cut into one edit a row; a row's place among its conversation's rows says which is its
    own, and inserted turns come from the audits alone."""
    audits = save(repair(rows).select("conv_id", "audit"), "repair-audits")
    edits = audits.select("conv_id", F.posexplode(F.split("audit", "")).alias("at", "edit")).where("edit <> ''")
    return _placed(edits, rows)


def _placed(edits: DataFrame, rows: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    own = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    edits = edits.withColumn("nth", F.sum((F.col("edit") != "I").cast("int")).over(own)).where("edit <> 'D'")
    place = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    said = rows.where("not gone").select(F.col("conv_id").alias("of"), F.row_number().over(place).alias("n"),
                                         F.col("role").alias("had"), "text")
    joined = edits.join(said, edits["conv_id"].eqNullSafe(said["of"]) & (edits["nth"] == said["n"])
                        & (edits["edit"] != "I"), "left")
    order = Window.partitionBy("conv_id").orderBy("at")
    opens = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn("position", F.row_number().over(order) - 1)
    system = F.max(((F.col("position") == 0) & (F.col("edit") == "K") & F.col("had").startswith("s")).cast("int")).over(opens)
    role = F.when(F.col("edit") == "K", F.col("had")).when((F.col("position") - system) % 2 == 0, "user").otherwise("assistant")
    return joined.select("conv_id", F.col("position").cast("long").alias("position"), "edit", role.alias("role"),
                         F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))
