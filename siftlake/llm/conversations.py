"""Repair of conversation structure with the fewest edits, over an automaton of shared suffixes.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``. Its rows become a
signature, one symbol per row for the role and the fault. What the cheapest edits of a row are
depends only on the rows after it, so signatures are read from their ends: they are sorted by
their reverse, equal suffixes then lie together, and each is one node of an automaton, for which
the cost to go and the next edit are found once per state of the grammar.

Rows are streamed through sorted partitions: a task holds one byte per row of one conversation,
never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SPACES = " \t\n\x0b\x0c\r"
ENDS = [".", "!", "?"]

# Costs of the edits, and how an edit is written in an audit.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAULTS = {"blank": 1, "duplicate": 2, "truncated": 3}

# Grammar states: nothing yet, after s, after u, after a. The first and the last may end.
START, OPENED, ASKED, ANSWERED = range(4)
_NEXT = {(START, "s"): OPENED, (START, "u"): ASKED, (OPENED, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
_WANTED = {START: "u", OPENED: "u", ASKED: "a", ANSWERED: "u"}
_ROLE = {"u": "user", "a": "assistant"}
_NEVER = 1 << 40
_LEGAL = {"su", "ua", "au"}


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with reproducible faults, chosen by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's.
    NULL in any column reads as one space.
    """
    text, role = (F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("text", "role"))
    key = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")]
    kind = F.crc32(F.concat(key[0], F.lit(":"), key[1]).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = rows.withColumns(
        {
            "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
            "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")),
            "copy": F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
        }
    )
    return changed.select("conv_id", "turn", "role", "text")


def _ordered_rows(rows: DataFrame) -> DataFrame:
    text, role = (F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("text", "role"))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("digest", F.md5(F.concat("role", F.lit("\0"), "text")))


def _faults(rows: DataFrame) -> DataFrame:
    """The initial and the first fault of each row. Of equal rows all but the first are duplicates."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    marked = rows.select(
        "conv_id",
        "turn",
        "digest",
        "role",
        F.substring("role", 1, 1).alias("initial"),
        (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(*ENDS)).alias("cut"),
    )
    seen = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(F.col("blank"), FAULTS["blank"]).when(F.col("seen") > 1, FAULTS["duplicate"])
    fault = fault.when(F.col("cut"), FAULTS["truncated"]).otherwise(0)
    return marked.withColumn("seen", seen).select(
        "conv_id", "turn", "role", "digest", "seen", F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o").alias("initial"), fault.alias("fault")
    )


class _Signature:
    """What one conversation's rows add up to, read in order."""

    def __init__(self) -> None:
        self.symbols = bytearray()
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.least = self.most = self.last = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if self.last is not None and self.last + initial not in _LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.most:
            self.turns += 1
            self.most = turn
            self.least = turn if self.least is None else self.least
        self.faults[fault] += 1
        symbol = "x" if fault in (FAULTS["blank"], FAULTS["duplicate"]) else initial.upper() if fault else initial
        self.symbols += symbol.encode()

    def row(self) -> list:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return [gaps, *self.faults[1:], self.illegal, bytes(reversed(self.symbols)).decode()]


_STATS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from rows sorted by conversation and turn."""
    current, open_id = None, None
    for batch in batches:
        ids, found = [], []
        for key, turn, initial, fault in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "initial", "fault"))):
            if current is None or key != open_id:
                if current is not None:
                    ids.append(open_id)
                    found.append(current.row())
                current, open_id = _Signature(), key
            current.add(turn, initial, fault)
        yield _signature_batch(ids, found, batch.schema.field("conv_id").type)
    if current is not None:
        yield _signature_batch([open_id], [current.row()], batch.schema.field("conv_id").type)


def _signature_batch(ids: list, found: list, kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [[]] * 6
    arrays = [pa.array(ids, kind), *(pa.array(list(c), pa.int64()) for c in columns[:5]), pa.array(list(columns[5]), pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["conv_id", *_STATS, "backward"])


class SuffixAutomaton:
    """Nodes for suffixes of signatures, with the cost to go and the best next edit by grammar state.

    A node is registered by its symbol and the node of the rest, and nodes whose relative costs and
    edits are equal are one, so the register stays small whatever the number of conversations.
    A node's edits are written as inserts before its row and the edit of the row itself.
    """

    def __init__(self) -> None:
        self.nodes: list[tuple[tuple[int, ...], tuple[str, ...]]] = []
        self.numbers: dict[tuple, int] = {}
        self.register: dict[tuple[str, int], tuple[int, int]] = {}
        end = self._closed({START: (0, ""), ANSWERED: (0, "")})
        self.end, self.end_cost = self._node(end)

    @staticmethod
    def _closed(row: dict[int, tuple[int, str]]) -> list[tuple[int, str]]:
        """Allow inserts before the row: one moves between asked and answered, or from the start to asked."""
        asked, answered = row.get(ASKED, (_NEVER, "")), row.get(ANSWERED, (_NEVER, ""))
        after = (INSERT + answered[0], "I" + answered[1])
        two = min(asked, after)
        more = (INSERT + two[0], "I" + two[1])
        return [
            min(row.get(START, (_NEVER, "")), more),
            min(row.get(OPENED, (_NEVER, "")), more),
            two,
            min(answered, (INSERT + asked[0], "I" + asked[1])),
        ]

    def _node(self, states: list[tuple[int, str]]) -> tuple[int, int]:
        base = min(cost for cost, _ in states)
        record = (tuple(cost - base for cost, _ in states), tuple(edits for _, edits in states))
        if record not in self.numbers:
            self.numbers[record] = len(self.nodes)
            self.nodes.append(record)
        return self.numbers[record], base

    def before(self, symbol: str, rest: int) -> tuple[int, int]:
        """The node of a row followed by node ``rest``, and what its least cost adds to that of ``rest``."""
        known = self.register.get((symbol, rest))
        if known is None:
            known = self.register[symbol, rest] = self._node(self._closed(self._row(symbol, rest)))
        return known

    def _row(self, symbol: str, rest: int) -> dict[int, tuple[int, str]]:
        costs = self.nodes[rest][0]
        row = {}
        for state in range(4):
            choices = [(DELETE + costs[state], "D")]
            if symbol != "x":
                initial, late = symbol.lower(), TRUNCATED * symbol.isupper()
                if (state, initial) in _NEXT:
                    choices.append((KEEP + late + costs[_NEXT[state, initial]], "K"))
                choices.append((REROLE + late + costs[_NEXT[state, _WANTED[state]]], "R"))
            # Edits are single letters here, so of equal costs the first letter decides the whole audit.
            row[state] = min(choices)
        return row

    def audit(self, forward: str, nodes: list[int]) -> str:
        """Follow the best edits from the start; ``nodes`` are those of the suffixes, longest first."""
        state, found = START, []
        for symbol, node in zip([*forward, ""], nodes):
            edits = self.nodes[node][1][state]
            found.append(edits)
            for edit in edits:
                if edit == "K":
                    state = _NEXT[state, symbol.lower()]
                elif edit != "D":
                    state = _NEXT[state, _WANTED[state]]
        return "".join(found)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and audit of signatures sorted by their reverse: what two have in common from the end is kept."""
    automaton = SuffixAutomaton()
    nodes, costs, previous, result = [automaton.end], [automaton.end_cost], "", None
    for batch in batches:
        total, audits = [], []
        for backward in batch.column("backward").to_pylist():
            if backward != previous or result is None:
                same = _common(previous, backward)
                del nodes[same + 1 :], costs[same + 1 :]
                for symbol in backward[same:]:
                    node, more = automaton.before(symbol, nodes[-1])
                    nodes.append(node)
                    costs.append(costs[-1] + more)
                start = automaton.nodes[nodes[-1]][0][START]
                result = costs[-1] + start, automaton.audit(backward[::-1], nodes[::-1])
                previous = backward
            total.append(result[0])
            audits.append(result[1])
        kept = [batch.column(name) for name in ("conv_id", *_STATS)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(total, pa.int64()), pa.array(audits, pa.string())], ["conv_id", *_STATS, "cost", "audit"])


def _common(one: str, other: str) -> int:
    """Length of the common beginning."""
    length = min(len(one), len(other))
    if one[:length] == other[:length]:
        return length
    a, b = (np.frombuffer(text[:length].encode(), np.uint8) for text in (one, other))
    return int(np.argmax(a != b))


def repairs(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``.

    ``rows`` has conv_id, turn, role, text. A conversation's rows are taken by turn, NULL first; rows of one turn
    by role and then by the MD5 of role and text. NULL role or text reads as one space; a NULL conv_id is a conversation
    of its own; an empty table gives no rows; other columns are ignored. Rows that repeat are duplicates.

    Equal signatures may be very common, so they are dealt out by range together with the conversation's id.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = _faults(_ordered_rows(rows)).repartition("conv_id")
    marked = marked.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "seen")
    kind = rows.schema["conv_id"].dataType.simpleString()
    stats = ", ".join(f"{name} long" for name in _STATS)
    marked = marked.select("conv_id", "turn", "initial", "fault")
    found = marked.mapInArrow(_signatures, f"conv_id {kind}, {stats}, backward string")
    found = found.repartitionByRange(partitions, "backward", "conv_id").sortWithinPartitions("backward")
    return found.mapInArrow(_audits, f"conv_id {kind}, {stats}, cost long, audit string")


def edits_of(audit: str, roles: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str | None, str | None]]:
    """Apply an audit to the (role, text) rows of a conversation; yields each edit and the row it leaves."""
    state = START
    for edit in audit:
        if edit == "I":
            wanted = _WANTED[state]
            yield edit, _ROLE[wanted], ""
            state = _NEXT[state, wanted]
            continue
        role, text = next(roles)
        if edit == "D":
            yield edit, None, None
            continue
        initial = _WANTED[state] if edit == "R" else role[:1]
        yield edit, _ROLE[initial] if edit == "R" else role, text
        state = _NEXT[state, initial]


class _Conversations:
    """Cut a sorted stream of headers and rows into conversations without holding their texts."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.rows = self._rows(batches)
        self.head = next(self.rows, None)

    @staticmethod
    def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(name).to_pylist() for name in batch.schema.names))

    def __iter__(self) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
        while self.head is not None:
            header, self.head = self.head, next(self.rows, None)
            yield header, self._own()

    def _own(self) -> Iterator[tuple[str, str]]:
        while self.head is not None and self.head[1] is None:
            row, self.head = self.head, next(self.rows, None)
            yield row[2], row[3]


def _with_headers(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, header, role, text) with each conversation's header before its rows, in one shuffle of the texts."""
    headers = found.select("conv_id", F.struct(*[c for c in found.columns if c != "conv_id"]).alias("header"))
    plain = _ordered_rows(rows).withColumn("header", F.lit(None).cast(headers.schema["header"].dataType))
    both = headers.unionByName(plain, allowMissingColumns=True).repartition("conv_id")
    both = both.sortWithinPartitions("conv_id", F.col("header").isNull(), F.asc_nulls_first("turn"), "role", "digest")
    return both.select("conv_id", "header", "role", "text")


def _blocks(kind: pa.Schema, rows: Iterator[list], size: int = 1000) -> Iterator[pa.RecordBatch]:
    block = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*block), kind)], schema=kind)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*block), kind)], schema=kind)


def _id_type(rows: DataFrame) -> pa.DataType:
    return to_arrow_type(rows.schema["conv_id"].dataType)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, ``position`` (of the edit, from 0), ``edit``, ``role``, ``text``.

    A deleted row has NULL role and text. Rows and their order are as in :func:`repairs`.
    """
    schema = pa.schema([("conv_id", _id_type(rows)), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[list]:
            for (key, header, _, _), own in _Conversations(batches):
                for at, (edit, role, text) in enumerate(edits_of(header["audit"], own)):
                    yield [key, at, edit, role, text]

        yield from _blocks(schema, each(), 100)

    kind = rows.schema["conv_id"].dataType.simpleString()
    sorted_rows = _with_headers(rows, repairs(rows).select("conv_id", "audit"))
    return sorted_rows.mapInArrow(turns, f"conv_id {kind}, position long, edit string, role string, text string")


def repair_digests(rows: DataFrame) -> DataFrame:
    """:func:`repairs` with ``repaired_sha256``, the digest of the repaired ``role:text`` lines.

    The digest of a conversation can only be taken in its order, so its rows pass through one task; they are
    streamed there and only the digest's state is held.
    """
    names = [*_STATS, "cost", "audit", "repaired_sha256"]
    types = [pa.int64()] * 6 + [pa.string()] * 2
    schema = pa.schema([("conv_id", _id_type(rows)), *zip(names, types)])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[list]:
            for (key, header, _, _), own in _Conversations(batches):
                digest, lines = hashlib.sha256(), 0
                for _, role, text in edits_of(header["audit"], own):
                    if role is not None:
                        digest.update((("\n" if lines else "") + role + ":" + text).encode())
                        lines += 1
                for _ in own:
                    raise ValueError("rows beyond the audit")
                yield [key, *(header[name] for name in names[:-1]), digest.hexdigest()]

        yield from _blocks(schema, each())

    kind = rows.schema["conv_id"].dataType.simpleString()
    fields = ", ".join(f"{name} {'long' if t == pa.int64() else 'string'}" for name, t in zip(names, types))
    return _with_headers(rows, repairs(rows)).mapInArrow(digests, f"conv_id {kind}, {fields}")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Damage all conversations and report their repair; one row for every original conv_id.

    Conversations of which no row is left have zeros, an empty audit and the digest of the empty string.
    """
    found = repair_digests(damage(conversations))
    ids = conversations.select(F.col("conv_id").alias("__conv_id")).distinct()
    full = ids.join(found, F.col("__conv_id").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in [*_STATS, "cost"]]
    empty = hashlib.sha256(b"").hexdigest()
    return full.select(
        F.col("__conv_id").alias("conv_id"),
        *zeros,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
