"""Conversation repair: the cheapest edits that make the roles alternate, by a best path whose survivors coalesce (operator 12)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blank text has nothing but these; truncated text ends, before them, in something other than an end mark.
SPACE, END_MARKS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Costs of the edits.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: What has been put out so far: nothing, the system row alone, up to a user row, up to an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: State after a row of each role, by the state before.
_AFTER = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: By (kept, dropped) states: what the rest of the cheapest way costs more from the kept one, at most. From EMPTY a system row
#: can still be kept where others delete it; whatever follows SYSTEM can follow ASSISTANT; a user row can be answered by an insertion.
_MORE = {(ASSISTANT, EMPTY): DELETE, (ASSISTANT, SYSTEM): 0, (USER, EMPTY): INSERT + DELETE, (USER, SYSTEM): INSERT}
#: Pairs of neighbouring initials that may stand.
LEGAL = frozenset({"su", "ua", "au"})
#: Rows of an output batch.
BATCH = 4096


class _Edit:
    """A node of the tree of surviving ways: the edit that led here. ``refs`` counts its children and the states at it."""

    __slots__ = ("above", "below", "depth", "letter", "refs")

    def __init__(self, above: _Edit | None, letter: str):
        self.above, self.letter, self.refs, self.below = above, letter, 0, None
        self.depth = 0 if above is None else above.depth + 1
        if above is not None:
            above.refs += 1
            if above.below is None:
                above.below = set()
            above.below.add(self)


def _release(node: _Edit) -> None:
    """Takes one reference away and frees what nothing survives of."""
    node.refs -= 1
    while node.refs == 0 and node.above is not None:
        above, node.above = node.above, None
        above.below.discard(node)
        above.refs -= 1
        node = above


def _before(a: _Edit, b: _Edit) -> bool:
    """Whether the letters on the way to ``a`` come first; both are compared from where they part, whole.

    Two ways to one state with one cost and the same rows behind them are never a beginning of each other: what one had more
    would be insertions, which cost.
    """
    mine, other = [], []
    while a is not b:
        if a.depth >= b.depth:
            mine.append(a.letter)
            a = a.above
        else:
            other.append(b.letter)
            b = b.above
    return mine[::-1] < other[::-1]


class Survivors:
    """The cheapest way to each state, ties by the smallest letters, of one conversation; ``step`` takes its rows in order.

    Letters on which all survivors agree are handed to ``settled`` at once, so memory holds the part still open.
    """

    def __init__(self):
        self.root = _Edit(None, "")
        self.root.refs = 1
        self.ways: dict[int, tuple[int, _Edit]] = {EMPTY: (0, self.root)}
        self.settled: list[str] = []
        self._insert()

    def _offer(self, ways: dict, state: int, cost: int, above: _Edit, letter: str) -> None:
        held = ways.get(state)
        if held is not None and held[0] < cost:
            return
        node = _Edit(above, letter)
        node.refs = 1
        if held is not None:
            if held[0] == cost and not _before(node, held[1]):
                _release(node)
                return
            _release(held[1])
        ways[state] = cost, node

    def _insert(self) -> None:
        """Insertions reach a user row from all states, and an assistant row from there; a longer row of them is never cheaper."""
        for before, after in ((EMPTY, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
            if before in self.ways:
                cost, node = self.ways[before]
                self._offer(self.ways, after, cost + INSERT, node, "I")

    def step(self, initial: str, must_go: bool, cut_off: bool) -> None:
        ways: dict[int, tuple[int, _Edit]] = {}
        extra = CUT_OFF if cut_off else 0
        for state, (cost, node) in self.ways.items():
            self._offer(ways, state, cost + DELETE, node, "D")
            if not must_go:
                for role, after in _AFTER[state].items():
                    if role == initial:
                        self._offer(ways, after, cost + extra, node, "K")
                    elif role != "s":
                        self._offer(ways, after, cost + extra + REROLE, node, "R")
        for _, node in self.ways.values():
            _release(node)
        self.ways = ways
        self._insert()
        for (kept, dropped), more in _MORE.items():
            if kept in ways and dropped in ways and ways[kept][0] + more < ways[dropped][0]:
                _release(ways.pop(dropped)[1])
        self._settle()

    def _settle(self) -> None:
        standing = {id(node) for _, node in self.ways.values()}
        while self.root.refs == 1 and id(self.root) not in standing:
            (child,) = self.root.below
            self.settled.append(child.letter)
            child.above, self.root = None, child

    def end(self) -> tuple[int, str]:
        """Cost and letters of the cheapest way that leaves nothing, or ends with an assistant row."""
        best = None
        for state in (EMPTY, ASSISTANT):
            if state in self.ways:
                cost, node = self.ways[state]
                if best is None or cost < best[0] or (cost == best[0] and _before(node, best[1])):
                    best = cost, node
        cost, node = best
        open_ = []
        while node is not self.root:
            open_.append(node.letter)
            node = node.above
        return cost, "".join(self.settled) + "".join(reversed(open_))


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the query's planted damage, by the remainder of crc32(``conv_id:turn``) and 20.

    0 drops the row, 1 empties its text, 2 takes its end marks, 3 repeats it, 4 makes it a user's. Nulls are written as one
    space, and a null role or text is one. A dropped row stays as one without role and text (``present`` false), so that its
    conversation is known.
    """
    fault = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", fault.alias("_fault"), _text("role").alias("role"), _text("text").alias("text"))
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", (F.col("_fault") != 0).alias("present"), role.alias("role"), text.alias("text"), copies.alias("_copy")).select(
        "conv_id", "turn", "present", F.when(F.col("present"), F.col("role")).alias("role"), F.when(F.col("present"), F.col("text")).alias("text"))


def _marked(rows: DataFrame) -> DataFrame:
    body = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumn("_digest", F.when(F.col("present"), F.md5(body.cast("binary"))))


def _streamed(rows: DataFrame, order: list) -> DataFrame:
    """Whole conversations side by side in sorted partitions. A conversation is one run of rows, read as a stream."""
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _planned(key: pa.DataType):
    fields = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    schema = pa.schema([("conv_id", key), *fields, ("audit", pa.string())])

    def plan(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, turns in groupby(rows, key=lambda r: r[0]):
            blank = duplicate = truncated = illegal = distinct = 0
            first = last = marked = previous = None
            way = Survivors()
            for _, turn, digest, kind, initial, empty, cut_off in turns:
                if kind == 0:
                    # The mark lies right before the first row with this role and text.
                    marked = turn, digest
                    continue
                if kind == 2:  # a dropped row
                    continue
                if turn is not None and turn != last:
                    first, last, distinct = turn if first is None else first, turn, distinct + 1
                again = marked != (turn, digest)
                marked = None
                fault = "blank" if empty else "duplicate" if again else "truncated" if cut_off else ""
                blank, duplicate, truncated = blank + (fault == "blank"), duplicate + (fault == "duplicate"), truncated + (fault == "truncated")
                illegal += previous is not None and previous + initial not in LEGAL
                previous = initial
                way.step(initial, fault in ("blank", "duplicate"), fault == "truncated")
            cost, audit = way.end()
            yield conv, 0 if first is None else last - first + 1 - distinct, blank, duplicate, truncated, illegal, cost, audit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Task function: one plan a conversation."""
        yield from _batched(plan(_rows(batches)), schema)

    return run


def plans(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of every conversation; see ``repair``.

    Texts stay where they are: a row is sent as its digest and three facts. The first row of each role and text is found by
    an aggregation and sent as a mark that sorts right before it, so no task keeps the texts it has seen.
    """
    here = F.col("present")
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    skeleton = _marked(rows).select(
        "conv_id", "turn", "_digest", F.when(here, 1).otherwise(2).alias("_kind"), F.substring("role", 1, 1).alias("_initial"),
        (last == "").alias("_empty"), (~last.isin(*END_MARKS)).alias("_cut"))
    earliest = skeleton.where(here).groupBy("conv_id", "_digest").agg(F.bool_or(F.col("turn").isNull()).alias("_null"), F.min("turn").alias("turn"))
    marks = earliest.select("conv_id", F.when(~F.col("_null"), F.col("turn")).alias("turn"), "_digest", F.lit(0).alias("_kind"),
                            F.lit(None).cast("string").alias("_initial"), F.lit(None).cast("boolean").alias("_empty"), F.lit(None).cast("boolean").alias("_cut"))
    stream = _streamed(skeleton.unionByName(marks), [F.col("turn").asc_nulls_first(), F.col("_digest").asc_nulls_first(), "_kind"])
    key = rows.schema["conv_id"].dataType
    counts = ", ".join(f"{n} long" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return stream.mapInArrow(_planned(_arrow(key)), f"conv_id {key.simpleString()}, {counts}, audit string")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _applied(key: pa.DataType, turn: pa.DataType):
    schema = pa.schema([("conv_id", key), ("position", pa.int64()), ("edit", pa.string()), ("turn", turn), ("role", pa.string()), ("text", pa.string())])
    names = {"K": "keep", "R": "rerole", "D": "delete", "I": "insert"}

    def apply(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, turns in groupby(rows, key=lambda r: r[0]):
            audit, at, wanted, position = "", 0, "user", 0
            for _, turn_, role, text, plan in turns:
                if plan is not None:  # sorts before all rows
                    audit = plan
                    continue
                while True:
                    letter, at = audit[at], at + 1
                    if letter == "I":
                        yield conv, position, "insert", None, wanted, ""
                    elif letter != "D":
                        if letter == "K" and position == 0 and role[:1] == "s":
                            yield conv, position, "keep", turn_, role, text
                            position = 1
                            break
                        yield conv, position, names[letter], turn_, role if letter == "K" else wanted, text
                    else:
                        yield conv, None, "delete", turn_, role, text
                        break
                    position, wanted = position + 1, "assistant" if wanted == "user" else "user"
                    if letter != "I":
                        break
            for _ in audit[at:]:
                yield conv, position, "insert", None, wanted, ""
                position, wanted = position + 1, "assistant" if wanted == "user" else "user"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Task function: the edits of each conversation, in order."""
        yield from _batched(apply(_rows(batches)), schema)

    return run


def repair(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``conv_id, position, edit, turn, role, text``: every edit of ``planned`` applied to its row, in order.

    ``rows`` has ``conv_id, turn, present, role, text``; rows that are not present only name their conversation. Rows are
    taken by turn, nulls first, equal turns by the digest of role and text, so copies stand side by side. ``position`` counts
    the rows of the repaired conversation; a deleted row has none. Result rows of a conversation lie in one partition, in
    order.

    Repaired roles are an optional system row and then user and assistant in turn; the edits are the cheapest, of equal ones
    those whose initials come first. Blank rows and rows whose role and text came before must go. Roles count by their first
    letter; one other than s, u or a can't be kept. Null ids are one conversation. A conversation without rows has no edits,
    an empty table no plans.
    """
    body = _marked(rows).where("present").select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("_plan"), "_digest")
    heads = planned.select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"),
                           F.lit(None).cast("string").alias("text"), F.col("audit").alias("_plan"), F.lit(None).cast("string").alias("_digest"))
    stream = _streamed(body.unionByName(heads), [F.col("_plan").isNull(), F.col("turn").asc_nulls_first(), "_digest"]).drop("_digest")
    kinds = [rows.schema[c].dataType for c in ("conv_id", "turn")]
    return stream.mapInArrow(_applied(*map(_arrow, kinds)), f"conv_id {kinds[0].simpleString()}, position long, edit string, turn {kinds[1].simpleString()}, role string, text string")


def _summed(key: pa.DataType):
    schema = pa.schema([("conv_id", key), ("repaired_sha256", pa.string())])

    def add(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, edits in groupby(rows, key=lambda r: r[0]):
            total = hashlib.sha256()
            for _, position, role, text in edits:
                if position is not None:
                    total.update(("\n" if position else "").encode() + f"{role}:{text}".encode())
            yield conv, total.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Task function: the digest of each repaired conversation, row by row."""
        yield from _batched(add(_rows(batches)), schema)

    return run


def digest(planned: DataFrame, repaired: DataFrame) -> DataFrame:
    """The contract's columns: the plan and the SHA-256 of the repaired ``role:text`` lines, joined by line breaks."""
    key = planned.schema["conv_id"].dataType
    sums = repaired.select("conv_id", "position", "role", "text").mapInArrow(_summed(_arrow(key)), f"conv_id {key.simpleString()}, repaired_sha256 string")
    again = sums.withColumnRenamed("conv_id", "_conv")
    return planned.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
