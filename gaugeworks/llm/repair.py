"""Repair of conversations by weighted CYK parsing over spans.

The role initials of a sound conversation are ``(s?(ua)+)?``. The repair grammar is in Chomsky normal form: a nonterminal
[p, q] stands for edits that take the reader of initials from state p to q, with rules [p, q] -> [p, r] [r, q], and terminals that
keep, re-role or delete one turn. Insertions make the closure: what they reach without a turn is put around every terminal
once. A cell holds, for each nonterminal over a span of turns, the least (cost, audit). A regular grammar derives a
span from any split of it, so cells are combined bottom-up by span length, doubling it.

Turns lie in ranges of (conversation, turn); a task makes one cell per conversation and range, and cells of ranges are combined
in their order. So a conversation may be of any length; texts are never gathered, they stream by in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.llm.common import write_down

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
BLANK_TURN, DUPLICATE, CUT_OFF, SOUND = "blank", "duplicate", "truncated", ""
#: Reader's states: nothing read, system, user and assistant read last. Where an initial leads; a user's turn wants an answer.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {
    "s": {NOTHING: SYSTEM},
    "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
ENDS = (NOTHING, ASSISTANT)
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}

Cell = dict[tuple[int, int], tuple[int, str]]


def combine(left: Cell, right: Cell) -> Cell:
    """[p, q] -> [p, r] [r, q]: the least (cost, audit) of each nonterminal over two neighbouring spans.

    Audits of one span and cost are never one the beginning of the other, as what is longer has more insertions; so the
    least parts make the least whole.
    """
    made: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (s, q), (more, rest) in right.items():
            if r == s:
                found = made.get((p, q))
                if found is None or cost + more < found[0] or cost + more == found[0] and audit + rest < found[1]:
                    made[p, q] = (cost + more, audit + rest)
    return made


def combine_all(cells: list[Cell]) -> Cell:
    """The cell of a whole row of neighbouring spans, bottom-up by span length."""
    while len(cells) > 1:
        pairs = [combine(*cells[at : at + 2]) for at in range(0, len(cells) - 1, 2)]
        cells = pairs + cells[len(pairs) * 2 :]
    return cells[0] if cells else EMPTY


def _closure() -> Cell:
    """What insertions reach from each state: the cell of a span without turns."""
    cell: Cell = {(state, state): (0, "") for state in range(4)}
    single: Cell = dict(cell)
    for initial in ROLES:
        single |= {move: (INSERT, "I") for move in MOVES[initial].items()}
    while (wider := combine(cell, single)) != cell:
        cell = wider
    return cell


EMPTY = _closure()


def turn_cell(initial: str, fault: str, copies: int = 1) -> Cell:
    """The cell of a turn that stands there ``copies`` times; the others are duplicates of the first, or blank like it."""
    stay: Cell = {(state, state): (DELETE, "D") for state in range(4)}
    edits = dict(stay)
    if fault in (SOUND, CUT_OFF):
        extra = TRUNCATED if fault == CUT_OFF else 0
        options = [(REROLE + extra, "R", move) for role in ROLES for move in MOVES[role].items()]
        options += [(extra, "K", move) for move in MOVES.get(initial, {}).items()]
        for cost, letter, move in options:
            edits[move] = min(edits.get(move, (cost, letter)), (cost, letter))
    cell = combine(combine(EMPTY, edits), EMPTY)
    if copies > 1:
        gone: Cell = {(state, state): (DELETE * (copies - 1), "D" * (copies - 1)) for state in range(4)}
        cell = combine(combine(cell, gone), EMPTY)
    return cell


def best(cell: Cell) -> tuple[int, str]:
    """(cost, audit) of the whole conversation."""
    return min(cell[NOTHING, end] for end in ENDS if (NOTHING, end) in cell)


class Replay:
    """Applies an audit to turns that come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def _next(self, role: str | None = None) -> str:
        """The role of the turn that is put out."""
        if role is None or not role:
            role = ROLES["a" if self.state == USER else "u"]
        self.state = MOVES[role[0]][self.state]
        return role

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._next(), ""

    def turn(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str]]:
        for _ in range(copies):
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                yield self._next(role if edit == "K" else None), text


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the turns after damage by crc32(``conv_id:turn``) % 20, alike ones counted.

    Null roles, texts, ids and turns read as one space. Several rows of one turn are damaged alike; those with the same role and
    text are one row here.
    """
    spelled = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")]
    kind = F.crc32(F.concat(spelled[0], F.lit(":"), spelled[1]).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", kind.alias("kind"), role.alias("role"), text.alias("text")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1).cast("long")
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def faults(turns: DataFrame) -> DataFrame:
    """``turns`` with the first fault of the first of each row's copies in a column ``fault``."""
    seen = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    ranked = turns.withColumn("rank", F.row_number().over(seen))
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    fault = (
        F.when(last == "", BLANK_TURN)
        .when(F.col("rank") > 1, DUPLICATE)
        .when(~last.isin(".", "!", "?"), CUT_OFF)
        .otherwise(SOUND)
    )
    return ranked.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


_CELLS = "array<struct<p:int,q:int,cost:long,audit:string>>"
_BLOCKS = f"conv_id {{kind}}, block long, illegal long, first string, last string, cells {_CELLS}"


def _in_order() -> list:
    return [F.col(name).asc_nulls_first() for name in ("conv_id", "turn", "role", "text")]


def blocks(turns: DataFrame) -> DataFrame:
    """One row per conversation and range of turns: its cell, its illegal neighbours, its first and last initials."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        number, made = TaskContext.get().partitionId(), []
        conversation, cells, initials, illegal = None, [], [], 0

        def end():
            whole = combine_all(cells)
            listed = [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in whole.items()]
            made.append((conversation, number, illegal, initials[0], initials[1], listed))

        known: dict[tuple, Cell] = {}
        for batch in batches:
            for conv_id, role, copies, fault in zip(*[column.to_pylist() for column in batch.columns]):
                if not initials or conv_id != conversation:
                    if initials:
                        end()
                    conversation, cells, initials, illegal = conv_id, [], [role[:1], role[:1]], copies - 1
                else:
                    illegal += copies - 1 + (initials[1] + role[:1] not in LEGAL)
                    initials[1] = role[:1]
                kind = (role[:1], fault, copies)
                if kind not in known and copies < 9:
                    known[kind] = turn_cell(*kind)
                cells.append(known[kind] if kind in known else turn_cell(*kind))
                if len(cells) == 256:  # long runs are combined as they come
                    cells = [combine_all(cells)]
            if made:
                yield _rows(made, schema)
                made = []
        if initials:
            end()
            yield _rows(made, schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    fields = _BLOCKS.format(kind=kind)
    schema = to_arrow_schema(turns.sparkSession.createDataFrame([], fields).schema)
    laid = turns.repartitionByRange(*_in_order()).sortWithinPartitions(*_in_order())
    return laid.select("conv_id", "role", "copies", "fault").mapInArrow(run, fields)


def _rows(made: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*made), schema)], schema=schema)


def audits(parts: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit) from ``blocks``: a conversation has one per range that holds some of it."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    ordered = F.array_sort(F.collect_list(F.struct("block", "illegal", "first", "last", "cells"))).alias("parts")

    def run(batches):
        for batch in batches:
            made = []
            for conv_id, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cell = combine_all([{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in part["cells"]} for part in row])
                between = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(row, row[1:]))
                made.append((conv_id, sum(part["illegal"] for part in row) + between, *best(cell)))
            if made:
                yield _rows(made, schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    fields = f"conv_id {kind}, illegal long, cost long, audit string"
    schema = to_arrow_schema(parts.sparkSession.createDataFrame([], fields).schema)
    return parts.groupBy("conv_id").agg(ordered).mapInArrow(run, fields)


def _stream(found: DataFrame, turns: DataFrame) -> DataFrame:
    """Each conversation's audit, then its turns in order, in one partition; partitions are read as a stream."""
    heads = found.select("conv_id", F.lit(0).alias("kind"), "audit", *[F.lit(None).cast(turns.schema[n].dataType).alias(n) for n in ("turn", "role", "text", "copies")])
    bodies = turns.select("conv_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "copies")
    order = [F.col("conv_id").asc_nulls_first(), "kind", *_in_order()[1:]]
    return heads.union(bodies).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "audit", "role", "text", "copies")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, turns put out) for what each row of the stream adds; a conversation begins with None and ends with its rest."""
    replay = conversation = None
    for batch in batches:
        for conv_id, kind, audit, role, text, copies in zip(*[column.to_pylist() for column in batch.columns]):
            if kind == 0:
                if replay is not None:
                    yield conversation, replay.inserted()
                replay, conversation = Replay(audit), conv_id
                yield conv_id, None
            else:
                yield conv_id, replay.turn(role, text, copies)
    if replay is not None:
        yield conversation, replay.inserted()


def repaired_turns(found: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, places counted from 0."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        made, place = [], 0
        for conv_id, added in _replayed(batches):
            if added is None:
                place = 0
                continue
            for role, text in added:
                made.append((conv_id, place, role, text))
                place += 1
            if len(made) > 1000:
                yield _rows(made, schema)
                made = []
        if made:
            yield _rows(made, schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    fields = f"conv_id {kind}, place long, role string, text string"
    schema = to_arrow_schema(turns.sparkSession.createDataFrame([], fields).schema)
    return _stream(found, turns).mapInArrow(run, fields)


def digests(found: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of each repaired conversation's ``role:text``, joined by newlines.

    The digest is fed turn by turn, so a task holds one turn and one audit at a time.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        digest = conversation = None
        made, first = [], True
        for conv_id, added in _replayed(batches):
            if added is None:
                if digest is not None:
                    made.append((conversation, digest.hexdigest()))
                    if len(made) > 1000:
                        yield _rows(made, schema)
                        made = []
                digest, conversation, first = hashlib.sha256(), conv_id, True
                continue
            for role, text in added:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if digest is not None:
            made.append((conversation, digest.hexdigest()))
        if made:
            yield _rows(made, schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    fields = f"conv_id {kind}, repaired_sha256 string"
    schema = to_arrow_schema(turns.sparkSession.createDataFrame([], fields).schema)
    return _stream(found, turns).mapInArrow(run, fields)


def parse(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of conversations as ``faults`` gives them."""
    bare = F.when(F.col("fault") == BLANK_TURN, F.col("copies")).otherwise(0)
    others = F.when(F.col("fault") == DUPLICATE, F.col("copies")).when(F.col("fault") == BLANK_TURN, 0).otherwise(F.col("copies") - 1)
    cut = F.when(F.col("fault") == CUT_OFF, 1).otherwise(0)
    by_turn = turns.groupBy("conv_id", "turn").agg(*[F.sum(value).alias(name) for name, value in ((BLANK_TURN, bare), (DUPLICATE, others), (CUT_OFF, cut))])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    sums = [F.sum(name).cast("long").alias(name) for name in (BLANK_TURN, DUPLICATE, CUT_OFF)]
    counted = by_turn.groupBy("conv_id").agg(gaps.alias("gaps"), *sums)
    found = audits(blocks(turns)).withColumnRenamed("conv_id", "c")
    return counted.join(found, F.col("c").eqNullSafe(F.col("conv_id"))).drop("c")


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    ``conversations`` has conv_id, turn, role and text; other columns are not read. It is damaged first (``damaged``). Turns go by
    number, null ones first, then by role and text. Conversations with a null id are one conversation; one without turns after
    damage has zeros, an empty audit and the digest of nothing; empty tables give an empty one.
    """
    turns = write_down(faults(damaged(conversations)))
    found = write_down(parse(turns))
    made = found.join(digests(found, turns).withColumnRenamed("conv_id", "c"), F.col("c").eqNullSafe(F.col("conv_id"))).drop("c")
    every = conversations.select(F.col("conv_id").alias("c")).distinct()
    numbers = ("gaps", BLANK_TURN, DUPLICATE, CUT_OFF, "illegal", "cost")
    nothing = hashlib.sha256().hexdigest()
    return every.join(made, F.col("c").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("c").alias("conv_id"),
        *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
