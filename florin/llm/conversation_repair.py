"""Conversation structure repair by Hirschberg's divide and conquer.

The rows of a conversation, by turn, get edits so that the role initials read ``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (1),
Delete (2), and Insert (5) of an empty user or assistant row anywhere. Blank rows and repetitions of an earlier role and text
have to go; a row that stays although it breaks off costs 5 more. Of the cheapest edits those whose initials, read in order, come first in ASCII are taken.

What has been read is in one of four states: nothing, s, an open u, a closed a. Over a stretch of rows there is a cost from every
state to every other, and the initials of equally dear ways into different states are never prefixes of each other,
so besides the costs only the rank of the four ways is carried. Forward costs and ranks meet backward costs in the middle of a stretch; of the states in which
their sums are least the one of lowest rank is crossed, and both halves are solved alone, in space linear in the rows.

Conversations are cut into pieces of at most an Arrow batch after a range partitioning by (conversation, turn, role, digest), so one long
conversation is spread over many tasks. Rows carry digests instead of texts there, and equal rows of a turn are one row with a count. Pieces of conversations with several
are summed up as costs and ranks from state to state, the crossings between pieces follow from these few numbers, and then every
piece is solved alone. Texts move once, for the digest of the repaired conversation, which by its definition is one sequence: it streams through one task in constant memory.

Defined results: rows are ordered by turn (nulls first), role and digest of the text; a null role or text is one space; a null conv_id is a conversation; conversations
without rows have no edits; ties of cost go by ASCII; repeated rows are duplicates; a row's initial is the first character of its role; very long conversations are cut as above,
very long texts are hashed as they pass; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import materialise

WHITE = " \t\n\x0b\x0c\r"
DELETE_COST, REROLE_COST, INSERT_COST, BROKEN_COST = 2, 1, 5, 5
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
INF = 1 << 60
#: Initials by number, s u a and any other; the state after an initial, by state (-1: not allowed); the state after an inserted or reroled row.
INITIALS = "sua"
STEP = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
NEXT = (2, 2, 3, 2)
ROLES = ("user", "user", "assistant", "user")
#: Rows to insert after the last one, by state.
CLOSING = (0, 2, 1, 0)
LEAF = 32
CACHE = 200_000
KEY = ["conv_id", "turn", "role", "digest"]
ROW = "turn: bigint, role: string, digest: string, fault: int, initial: int, n: bigint"
_SOLVED: dict[tuple, tuple[list[str], list[int]]] = {}


def _ways(fault: int, initial: int, state: int) -> list[tuple[int, int, str]]:
    """(state behind, cost, initials) of the best way over one row to every state that can be reached."""
    found: dict[int, tuple[int, str]] = {}
    for inserts in range(4):
        extra, letters = inserts * INSERT_COST, "I" * inserts
        options = [(state, DELETE_COST, "D")]
        if fault not in (BLANK, DUPLICATE):
            stays = BROKEN_COST if fault == TRUNCATED else 0
            options += [(STEP[state][initial], stays, "K"), (NEXT[state], REROLE_COST + stays, "R")]
        for behind, cost, letter in options:
            if behind >= 0:
                found[behind] = min(found.get(behind, (INF, "")), (extra + cost, letters + letter))
        state = NEXT[state]
    return [(behind, cost, letters) for behind, (cost, letters) in found.items()]


#: Per code (fault * 4 + initial) and state.
WAYS = [[_ways(code // 4, code % 4, state) for state in range(4)] for code in range(16)]


def from_state(state: int) -> tuple[list[int], list[int]]:
    return [0 if s == state else INF for s in range(4)], [0] * 4


def forward(codes: bytes, costs: list[int], ranks: list[int]) -> tuple[list[int], list[int]]:
    """Costs and ranks of the least ways into the four states."""
    for code in codes:
        best: list[tuple | None] = [None] * 4
        for state, cost in enumerate(costs):
            if cost < INF:
                rank = ranks[state]
                for behind, extra, letters in WAYS[code][state]:
                    way = (cost + extra, rank, letters)
                    if best[behind] is None or way < best[behind]:
                        best[behind] = way
        costs = [INF if w is None else w[0] for w in best]
        order = sorted((w[1:], s) for s, w in enumerate(best) if w is not None)
        ranks = [0] * 4
        for rank, (_, s) in enumerate(order):
            ranks[s] = rank
    return costs, ranks


def backward(codes: bytes, costs: list[int]) -> list[int]:
    """Costs from the four states to the end of the stretch, with ``costs`` there."""
    for code in reversed(codes):
        costs = [min((extra + costs[behind] for behind, extra, _ in WAYS[code][state]), default=INF) for state in range(4)]
    return costs


def audit_between(codes: bytes, first: int, last: int) -> str:
    """The ASCII-least of the cheapest edits that lead from one state to another."""
    if len(codes) <= LEAF:
        best = {first: (0, "")}
        for code in codes:
            ways: dict[int, tuple[int, str]] = {}
            for state, (cost, audit) in best.items():
                for behind, extra, letters in WAYS[code][state]:
                    way = (cost + extra, audit + letters)
                    if behind not in ways or way < ways[behind]:
                        ways[behind] = way
            best = ways
        return best[last][1]
    middle = len(codes) // 2
    before, ranks = forward(codes[:middle], *from_state(first))
    after = backward(codes[middle:], from_state(last)[0])
    cross = min(range(4), key=lambda s: (before[s] + after[s], ranks[s]))
    return audit_between(codes[:middle], first, cross) + audit_between(codes[middle:], cross, last)


def last_state(costs: list[int], ranks: list[int]) -> int:
    return min(range(4), key=lambda s: (costs[s] + CLOSING[s] * INSERT_COST, ranks[s]))


def audit_of(codes: bytes, first: int = 0, last: int | None = None) -> str:
    """Edits of a piece from one state to another; without ``last`` of a last piece, closed."""
    if last is not None:
        return audit_between(codes, first, last)
    last = last_state(*forward(codes, *from_state(first)))
    return audit_between(codes, first, last) + "I" * CLOSING[last]


def crossings(pieces: list[tuple[list[int], list[int]]]) -> list[int]:
    """The states at the ends of a conversation's pieces, from their costs and ranks (16 each, by state before and behind)."""
    costs, ranks = from_state(0)
    came = []
    for step, order in pieces:
        ways = [min((costs[s] + step[4 * s + t], ranks[s], s) for s in range(4)) for t in range(4)]
        came.append([w[2] for w in ways])
        costs = [min(w[0], INF) for w in ways]
        places = sorted((w[1], order[4 * w[2] + t], t) for t, w in enumerate(ways))
        ranks = [[t for _, _, t in places].index(t) for t in range(4)]
    states = [last_state(costs, ranks)]
    for back in reversed(came[1:]):
        states.append(back[states[-1]])
    return states[::-1]


def split_audit(audit: str, sizes: list[int], codes: bytes, state: int) -> tuple[list[str], list[int]]:
    """Every row's letters (``sizes[k]`` of them besides inserts) and the state before them; inserts behind the last row are with it."""
    edits, states, at, place = [], [], 0, 0
    for k, n in enumerate(sizes):
        begin, left = at, n
        states.append(state)
        while left or (k == len(sizes) - 1 and at < len(audit)):
            letter = audit[at]
            if letter != "I":
                left -= 1
                place += 1
            state = state if letter == "D" else STEP[state][codes[place - 1] % 4] if letter == "K" else NEXT[state]
            at += 1
        edits.append(audit[begin:at])
    return edits, states


def _solve(codes: bytes, sizes: list[int], first: int, last: int | None) -> tuple[list[str], list[int]]:
    key = (codes, first, last) if len(codes) == len(sizes) <= LEAF else None
    if key in _SOLVED:
        return _SOLVED[key]
    found = split_audit(audit_of(codes, first, last), sizes, codes, first)
    if key:
        if len(_SOLVED) > CACHE:
            _SOLVED.clear()
        _SOLVED[key] = found
    return found


def _codes(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """A code per row, and how many equal rows it stands for."""
    return (rows.field("fault").to_numpy() * 4 + rows.field("initial").to_numpy()).astype(np.uint8), rows.field("n").to_numpy()


def _expanded(codes: np.ndarray, sizes: np.ndarray) -> bytes:
    """The repetitions behind a row have to go."""
    if (sizes == 1).all():
        return codes.tobytes()
    out = np.full(int(sizes.sum()), DUPLICATE * 4 + 3, np.uint8)
    out[np.cumsum(sizes) - sizes] = codes
    return out.tobytes()


def _keyed(rows: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(" "))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.md5(text.cast("binary")).alias("digest"), text.alias("text"))


def faulty_rows(rows: DataFrame) -> DataFrame:
    """One row per (conv_id, turn, role, digest): how many equal rows it stands for, the first one's fault and its role's initial."""
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    seen = _keyed(rows).select(*KEY, F.when(end == "", BLANK).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(NONE).alias("own"))
    seen = seen.groupBy(*KEY).agg(F.count("*").alias("n"), F.first("own").alias("own"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = seen.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(F.min(place).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    joined = seen.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
    repeated = F.col("turns").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    return joined.select(
        *KEY, F.when(F.col("own") == BLANK, BLANK).when(repeated, DUPLICATE).otherwise(F.col("own")).alias("fault"),
        F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1).alias("initial"), "n",
    )


def conversation_pieces(rows: DataFrame) -> DataFrame:
    """``(conv_id, piece, rows)``: the rows in order, pieces numbered in order; at most an Arrow batch of rows each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0)
            ids, known = conv.fill_null(0).to_numpy(), conv.is_valid().to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])]))
            inside = pa.StructArray.from_arrays(batch.columns[1:], batch.schema.names[1:])
            lists = pa.ListArray.from_arrays(pa.array(np.append(begins, batch.num_rows), pa.int32()), inside)
            yield pa.RecordBatch.from_arrays([conv.take(pa.array(begins)), pa.array(piece + np.arange(len(begins))), lists], ["conv_id", "piece", "rows"])
            piece += len(begins)

    ordered = faulty_rows(rows).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    return ordered.mapInArrow(cut, f"conv_id long, piece long, rows array<struct<{ROW}>>")


def _routes(pieces: DataFrame) -> DataFrame:
    """``(conv, number, before, behind)`` of the pieces of conversations with several; ``behind`` is null for the last one."""
    several = pieces.groupBy(F.col("conv_id").alias("_conv")).agg(F.count("*").alias("pieces")).where("pieces > 1")

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, ranks = [], []
            for k in range(batch.num_rows):
                codes = _expanded(*_codes(batch.column(2)[k].values))
                found = [forward(codes, *from_state(s)) for s in range(4)]
                costs.append([c for x, _ in found for c in x])
                ranks.append([c for _, x in found for c in x])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int64()))], ["conv_id", "piece", "costs", "ranks"])

    def route(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        states = crossings(list(zip(table.column("costs").to_pylist(), table.column("ranks").to_pylist())))
        return pa.table({"conv": table.column("conv_id"), "number": table.column("piece"), "before": pa.array([0, *states[:-1]], pa.int32()), "behind": pa.array([*states[:-1], None], pa.int32())})

    summed = pieces.join(several, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "piece", "rows").mapInArrow(sum_up, "conv_id long, piece long, costs array<long>, ranks array<long>")
    return summed.groupBy("conv_id").applyInArrow(route, "conv long, number long, before int, behind int")


def conversation_edits(rows: DataFrame) -> DataFrame:
    """Per distinct row of a conversation its fault, its letters in the audit (inserts before it, its own, one D per repetition, inserts behind the last row) and the state before them."""
    pieces = materialise(conversation_pieces(rows))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            codes, sizes = _codes(lists.flatten())
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            edits, states = [], []
            for k, (before, behind) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                own = sizes[ends[k] : ends[k + 1]]
                found = _solve(_expanded(codes[ends[k] : ends[k + 1]], own), own.tolist(), before or 0, behind)
                edits += found[0]
                states += found[1]
            owners = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends)))
            inside = lists.flatten()
            columns = [batch.column(0).take(owners), *inside.flatten(), pa.array(edits, pa.string()), pa.array(states, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", *(f.name for f in inside.type), "edit", "state"])

    routed = pieces.join(_routes(pieces), F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("piece") == F.col("number")), "left")
    return routed.select("conv_id", "rows", "before", "behind").mapInArrow(solve, f"conv_id long, {ROW.replace(':', '')}, edit string, state int")


class _Report:
    """One conversation as its rows pass."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.hash, self.lines = conv_id, hashlib.sha256(), 0
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.initial, self.audit, self.waiting = None, [], None

    def line(self, role: str, text: str) -> None:
        self.hash.update(b"\n" * (self.lines > 0) + f"{role}:{text}".encode())
        self.lines += 1

    def row(self, turn: int | None, fault: int, initial: int, n: int, edit: str, state: int) -> None:
        if turn is not None and turn != self.turn:
            self.low, self.high = (turn if self.low is None else self.low), turn
            self.turn, self.turns = turn, self.turns + 1
        self.blank += n * (fault == BLANK)
        self.duplicate += n if fault == DUPLICATE else (n - 1) * (fault != BLANK)
        self.truncated += fault == TRUNCATED
        self.illegal += n - 1 + (self.initial is not None and (self.initial, initial) not in ((0, 1), (1, 2), (2, 1)))
        self.initial = initial
        self.audit.append(edit)
        self.waiting = self.play(edit, fault, initial, state)
        if next(self.waiting, None) is None:
            self.waiting = None

    def play(self, edit: str, fault: int, initial: int, state: int):
        """Adds up the letters; stops where the row's own text is needed."""
        for letter in edit:
            if letter == "D":
                self.cost += DELETE_COST
                continue
            if letter == "I":
                self.cost += INSERT_COST
                self.line(ROLES[state], "")
            else:
                self.cost += (letter == "R") * REROLE_COST + (fault == TRUNCATED) * BROKEN_COST
                role, text = yield True
                self.line(ROLES[state] if letter == "R" else role, text)
            state = STEP[state][initial] if letter == "K" else NEXT[state]

    def text(self, role: str, text: str) -> None:
        if self.waiting is not None:
            try:
                self.waiting.send((role, text))
            except StopIteration:
                pass
            self.waiting = None

    def values(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def conversation_report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: gaps and faults of its ``rows``, the edits and their cost, and the digest of the repaired ``role:text`` lines."""
    names = [*KEY, "kind", "text", "fault", "initial", "n", "edit", "state"]
    pad = lambda df, **given: df.select(*(given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in zip(names, ("long", "long", "string", "string", "int", "string", "int", "int", "long", "string", "int"))))
    own = lambda *columns: {c: F.col(c) for c in columns}
    ids = pad(conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), **own("conv_id"), kind=F.lit(0))
    edits = pad(conversation_edits(rows), **own(*KEY, "fault", "initial", "n", "edit", "state"), kind=F.lit(1))
    texts = pad(_keyed(rows), **own(*KEY, "text"), kind=F.lit(2))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Report | None = None
        columns = REPORT.replace(",", "").split()[::2]
        for batch in batches:
            done = []
            for conv_id, turn, role, _, kind, text, fault, initial, n, edit, state in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        done.append(current.values())
                    current = _Report(conv_id)
                if kind == 1:
                    current.row(turn, fault, initial, n, edit, state)
                elif kind == 2:
                    current.text(role, text)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(columns, r)) for r in done], schema=SCHEMA)
        if current is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(columns, current.values()))], schema=SCHEMA)

    ordered = ids.union(edits).union(texts).repartition("conv_id").sortWithinPartitions(*KEY, "kind")
    return ordered.mapInArrow(report, REPORT)


SCHEMA = pa.schema([(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in REPORT.replace(",", "").split()[::2]])
