"""Repairing the turn structure of conversations at least cost, by an auction shortest-path algorithm.

The rows of a conversation, by turn (missing first, ties by role and then by the text's hash), are a lattice:
a node is a number of rows passed and what the repaired roles end with (nothing yet, ``s``, ``u``,
``a``). Arcs keep a row, give it another role, delete it or insert an empty one; their costs are integers.
A path to the end is a repair whose role initials match ``(s?(ua)+)?``.

Every node has a price, at first 0 and never above its distance to the end. The auction grows a path
from a node: if the last node's price is below the least of arc plus price of its successors, the
price is raised to that and the path gives up the node; else it goes on to the successor. Once the
end is reached, the prices along the path are distances. An arc is tight when its cost plus the price behind
it equals the price before it. The trace takes, from the start on, the tight arc with the ASCII-least
letter; prices behind other arcs are settled by the same auction when they are asked for.

Long rows of nodes are cut into lattices of SPAN rows from the back; the four settled prices where one
begins are the ends of the one before. Equal runs of rows are solved once a task.

On the cluster the rows are sorted by range, so a conversation of any length is spread over tasks in blocks
of BLOCK rows. A conversation that lies inside one block is finished there. For the others (long, or cut
by the border of two tasks) every block gives the least costs between its entry and exit states, the
blocks' costs are added up from the back, and every block is traced for each entry state; what remains to be
done in order is to choose one of four traces a block, and the digest of the repaired text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nichegrid.llm.tables import stored

#: rows of a lattice, and rows of a conversation that one task holds
SPAN, BLOCK = 32, 1024
#: solved runs of rows that a task remembers
KEPT = 1 << 14
#: what faults are planted by: crc32 of the row's key modulo this
FAULTS = 20
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: ends of the repaired roles so far
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
_ROLES = {USER: "user", ASSISTANT: "assistant"}
#: how a row is written down for the lattice: its role's initial, in capitals if truncated; "x" has to go
_GONE = "x"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: the rows with planted faults.

    The remainder of the crc32 of ``conv_id:turn`` decides: 0 drops the row (it stays here, marked, so
    that no conversation is lost), 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it
    the user's. A missing role or text, and a missing part of the key, is one space.
    """

    def given(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % FAULTS
    text = F.when(fault.isin(0, 1), "").when(fault == 2, F.regexp_replace(given("text"), "[.!?]", ""))
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(given("role")).alias("role"),
        text.otherwise(given("text")).alias("text"),
        (fault == 0).alias("dropped"),
        F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


class Lattice:
    """Prices of up to SPAN rows; ``ends`` are the costs beyond the last row for each state."""

    def __init__(self, rows: str, ends: Sequence[int]) -> None:
        self.rows = rows
        self.below = min(ends) if min(ends) < NEVER else 0  # prices need not climb what all paths have in common
        self.ends = [e - self.below if e < NEVER else NEVER for e in ends]
        # repaired roles never go back to none or to the system's, so these may be the only states with a path
        self.alive = 4 if min(ends[USER], ends[ASSISTANT]) < NEVER else 2 if ends[SYSTEM] < NEVER else 1
        self.price = [0] * (4 * len(rows) + 4)
        self.settled: set[int] = set()
        self.out: dict[int, list] = {}
        # a distance beyond this is no path at all
        self.most = 8 * INSERT + (RELABEL + TRUNCATED) * len(rows) + max((e for e in self.ends if e < NEVER), default=0)

    def arcs(self, node: int) -> list[tuple[int, str, int]]:
        """(cost, letter, next node) in the order of the letters; the end is node -1."""
        known = self.out.get(node)
        if known is not None:
            return known
        at, state = divmod(node, 4)
        arcs = []
        turn = ASSISTANT if state == USER else USER
        if at == len(self.rows):
            if self.ends[state] < NEVER:
                arcs.append((self.ends[state], "", -1))
            arcs.append((INSERT, "I", 4 * at + turn))
        else:
            row, below = self.rows[at], 4 * at + 4
            arcs = [(DELETE, "D", below + state), (INSERT, "I", 4 * at + turn)]
            if row != _GONE:
                extra, initial = (TRUNCATED, row.lower()) if row.isupper() else (0, row)
                if initial == "s" and state == START:
                    arcs.append((extra, "K", below + SYSTEM))
                elif (initial == "u" and turn == USER) or (initial == "a" and turn == ASSISTANT):
                    arcs.append((extra, "K", below + turn))
                arcs.append((RELABEL + extra, "R", below + turn))
        self.out[node] = arcs = [arc for arc in arcs if arc[2] % 4 < self.alive or arc[2] < 0]
        return arcs

    def settle(self, node: int) -> int:
        """The node's distance to the end, NEVER without a path, by the auction from it."""
        if node % 4 >= self.alive:
            return NEVER
        price, path = self.price, [node]
        while node not in self.settled:
            here = path[-1]
            least, then = NEVER, -1
            for cost, _, to in self.arcs(here):
                total = cost + (price[to] if to >= 0 else 0)
                if total < least:
                    least, then = total, to
            if price[here] < least:  # contraction
                price[here] = least
                if least > self.most:
                    price[here] = NEVER
                    self.settled.add(here)
                if len(path) > 1:
                    path.pop()
            elif then < 0 or then in self.settled:  # the end, or a price that is a distance already
                self.settled.update(path)
            else:  # extension
                path.append(then)
        return price[node]

    def cost(self, state: int) -> int:
        """The least cost from before the first row."""
        inside = self.settle(state)
        return inside + self.below if inside < NEVER else NEVER

    def trace(self, state: int) -> tuple[str, int]:
        """The letters of the cheapest path from the first row, ASCII-least among equals, and its last state."""
        node, letters = state, []
        while True:
            here = self.settle(node)
            for cost, letter, to in self.arcs(node):
                if cost + (self.settle(to) if to >= 0 else 0) == here:
                    break
            else:
                raise ValueError("no path")
            if to < 0:
                return "".join(letters), node % 4
            letters.append(letter)
            node = to


def _lattices(rows: str, ends: Sequence[int]) -> list[Lattice]:
    """The lattices of a run of rows from front to back."""
    out = []
    for last in range(len(rows), -1, -SPAN) if rows else [0]:
        first = max(last - SPAN, 0)
        if out and first == last:
            break
        out.append(Lattice(rows[first:last], ends))
        ends = [out[-1].cost(state) for state in range(4)]
    return out[::-1]


def traced(rows: str, ends: tuple[int, ...], state: int) -> tuple[int, str, int]:
    """Cost, letters and last state of the best path through ``rows`` from ``state``; NEVER: none."""
    lattices = _lattices(rows, ends)
    cost, letters = lattices[0].cost(state), []
    if cost >= NEVER:
        return cost, "", state
    for lattice in lattices:
        more, state = lattice.trace(state)
        letters.append(more)
    return cost, "".join(letters), state


def crossing(rows: str) -> tuple[int, ...]:
    """The least cost from each state before ``rows`` to each state behind them, NEVER without a path."""
    out = [[NEVER] * 4 for _ in range(4)]
    for to in range(4):
        lattice = _lattices(rows, [0 if state == to else NEVER for state in range(4)])[0]
        for state in range(4):
            out[state][to] = lattice.cost(state)
    return tuple(c for row in out for c in row)


FINAL = (0, NEVER, NEVER, 0)


def _fault(text: str) -> str:
    body = text.rstrip(" \t\n\x0b\x0c\r")
    return "blank" if not body else "whole" if body[-1] in ".!?" else "cut"


def _code(role: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return _GONE
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if fault == "cut" else initial


_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


@dataclass
class Block:
    """Consecutive rows of one conversation, in order."""

    turns: list
    roles: list[str]
    texts: list[str]

    def faults(self) -> list[str]:
        seen, out = set(), []
        for role, text in zip(self.roles, self.texts, strict=True):
            fault = _fault(text)
            if fault != "blank" and (role, text) in seen:
                fault = "duplicate"
            seen.add((role, text))
            out.append(fault)
        return out

    def illegal(self) -> int:
        return sum((a[:1], b[:1]) not in _LEGAL for a, b in zip(self.roles, self.roles[1:], strict=False))


def repaired(audit: str, state: int, roles: Sequence[str], texts: Sequence[str]) -> Iterator[str]:
    """``role:text`` of every row that stays, as the letters say; ``state`` is that before the first."""
    row = 0
    for letter in audit:
        if letter == "D":
            row += 1
            continue
        state = SYSTEM if letter == "K" and roles[row][:1] == "s" else ASSISTANT if state == USER else USER
        if letter == "I":
            yield _ROLES[state] + ":"
            continue
        yield (roles[row] if letter == "K" else _ROLES[state]) + ":" + texts[row]
        row += 1


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_DONE = f"{_COUNTS}, audit string, repaired_sha256 string"
_BLOCK = (
    "part int, at long, codes string, marks array<binary>, roles array<string>, texts array<string>, "
    "first_turn long, last_turn long, turns long, illegal long"
)
_WHERE = ["conv_id", "part", "at"]
_CROSSED = "struct<codes: string, crossing: array<bigint>>"
_PATHS = "array<struct<audit: string, state: int>>"


def _done(block: Block, solve: Callable = traced) -> dict:
    faults = block.faults()
    cost, audit, _ = solve("".join(map(_code, block.roles, faults)), FINAL, START)
    turns = {t for t in block.turns if t is not None}
    text = "\n".join(repaired(audit, START, block.roles, block.texts))
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        "blank": faults.count("blank"),
        "duplicate": faults.count("duplicate"),
        "truncated": faults.count("cut"),
        "illegal": block.illegal(),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }


def _mark(role: str, text: str) -> bytes:
    """What equal rows share."""
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def _open(block: Block, part: int, at: int) -> dict:
    faults = [_fault(text) for text in block.texts]
    turns = [t for t in block.turns if t is not None]
    marks = [None if f == "blank" else _mark(r, t) for f, r, t in zip(faults, block.roles, block.texts, strict=True)]
    return {
        "part": part,
        "at": at,
        "codes": "".join(map(_code, block.roles, faults)),
        "marks": marks,
        "roles": block.roles,
        "texts": block.texts,
        "first_turn": turns[0] if turns else None,
        "last_turn": turns[-1] if turns else None,
        "turns": len(set(turns)),
        "illegal": block.illegal(),
    }


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema))


class _Rows:
    """Rows of a task on their way to Arrow."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema = schema
        self.columns: list[list] = [[] for _ in schema]

    def put(self, *values) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)

    def full(self) -> bool:
        return len(self.columns[0]) >= 1 << 10

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)]
        self.columns = [[] for _ in self.columns]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _split(rows: DataFrame, block_rows: int) -> DataFrame:
    """conv_id, done (the result of a conversation that lies inside one block) or open (a block of another)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, done struct<{_DONE}>, open struct<{_BLOCK}>"
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", "turn", "role", "text", "dropped", F.spark_partition_id().alias("part"))

    fields = _arrow(schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, held, part, at = None, None, Block([], [], []), None, 0
        solve = functools.lru_cache(KEPT)(traced)
        cut = True  # the first conversation of a task may have begun in the one before
        for batch in batches:
            out = out or _Rows(fields)
            for conv_id, turn, role, text, dropped, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part is not None and conv_id != conv:
                    if cut:
                        out.put(conv, None, _open(held, part, at))
                    else:
                        out.put(conv, _done(held, solve), None)
                    held, cut, at = Block([], [], []), False, at + 1
                conv, part = conv_id, own
                if dropped:
                    continue
                held.turns.append(turn)
                held.roles.append(role)
                held.texts.append(text)
                if len(held.roles) >= block_rows:
                    out.put(conv, None, _open(held, part, at))
                    held, cut, at = Block([], [], []), True, at + 1
                if out.full():
                    yield out.batch()
        if part is not None:  # the last conversation may go on in the next task
            out.put(conv, None, _open(held, part, at))
            yield out.batch()

    return dealt.mapInArrow(blocks, schema)


def _without_repeats(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``again``: the places of rows that equal an earlier row of the conversation."""
    key = F.struct("conv_id").alias("key")
    marks = blocks.select(key, "part", "at", F.posexplode("marks").alias("i", "mark")).where("mark is not null")
    place = F.struct("part", "at", "i")
    firsts = marks.groupBy("key", "mark").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = stored(firsts.drop("n"), "first-rows")
    again = marks.join(firsts, ["key", "mark"]).where(place != F.col("first"))
    again = again.groupBy("key", "part", "at").agg(F.collect_list("i").alias("again"))
    return blocks.withColumn("key", F.struct("conv_id")).join(again, ["key", "part", "at"], "left").drop("key")


def _crossed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    solve = functools.lru_cache(KEPT)(crossing)
    for codes, again in batches:
        out = []
        for code, places in zip(codes.to_pylist(), again.to_pylist(), strict=True):
            gone = set(places or ())
            code = "".join(_GONE if i in gone else c for i, c in enumerate(code))
            out.append({"codes": code, "crossing": solve(code)})
        yield pa.array(out, pa.struct([("codes", pa.string()), ("crossing", pa.list_(pa.int64()))]))


def _ends(blocks: DataFrame) -> DataFrame:
    """conv_id, part, at, ends: what the rest of the conversation costs from each state behind a block.

    A conversation's blocks pass in one task from the back, sixteen numbers for BLOCK rows, none of them kept.
    """
    kind = blocks.schema["conv_id"].dataType.simpleString()
    order = [F.asc_nulls_first("conv_id"), F.desc("part"), F.desc("at")]
    light = blocks.select(*_WHERE, "crossing").repartition("conv_id").sortWithinPartitions(*order)
    schema = f"conv_id {kind}, part int, at long, ends array<long>"
    fields = _arrow(schema)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, ends, any_ = None, FINAL, False
        for batch in batches:
            out = _Rows(fields)
            for conv_id, part, at, costs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not any_ or conv_id != conv:
                    conv, ends, any_ = conv_id, FINAL, True
                out.put(conv_id, part, at, list(ends))
                ends = tuple(
                    min(min(costs[4 * s + t] + ends[t] for t in range(4)), NEVER) for s in range(4)
                )
            yield out.batch()

    return light.mapInArrow(back, schema)


def _all_traces(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    solve = functools.lru_cache(KEPT)(traced)
    kind = pa.list_(pa.struct([("audit", pa.string()), ("state", pa.int32())]))
    for codes, ends in batches:
        out = []
        for code, beyond in zip(codes.to_pylist(), ends.to_pylist(), strict=True):
            low = min(beyond)
            paths = (solve(code, tuple(e - low if e < NEVER else NEVER for e in beyond), s) for s in range(4))
            out.append([{"audit": audit, "state": state} for _, audit, state in paths])
        yield pa.array(out, kind)


def _joined(blocks: DataFrame) -> DataFrame:
    """conv_id and the result of each conversation from its blocks, which pass in order and are not kept."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    order = [F.asc_nulls_first("conv_id"), "part", "at"]
    columns = ["codes", "marks", "paths", "roles", "texts", "first_turn", "last_turn", "turns", "illegal"]
    dealt = blocks.select(*_WHERE, *columns).repartition("conv_id").sortWithinPartitions(*order)
    schema = f"conv_id {kind}, {_DONE}"
    fields = _arrow(schema)

    def forth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, any_ = None, None, False
        state, audit, digest, some, counts, low, high, last_role = START, [], hashlib.sha256(), False, {}, None, None, None

        def finish() -> None:
            n = counts
            gaps = high - low + 1 - n["turns"] if low is not None else 0
            letters = "".join(audit)
            cost = sum(letters.count(k) * c for k, c in (("R", RELABEL), ("D", DELETE), ("I", INSERT))) + n["kept"]
            out.put(
                conv, gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, letters, digest.hexdigest()
            )

        for batch in batches:
            out = out or _Rows(fields)
            for row in batch.to_pylist():
                if any_ and row["conv_id"] != conv:
                    finish()
                    any_ = False
                if not any_:
                    conv, any_, state, audit, digest, some = row["conv_id"], True, START, [], hashlib.sha256(), False
                    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns", "kept"), 0)
                    low = high = last_role = None
                codes, roles, path = row["codes"], row["roles"], row["paths"][state]
                for piece in repaired(path["audit"], state, roles, row["texts"]):
                    digest.update(("\n" if some else "").encode() + piece.encode())
                    some = True
                blank = row["marks"].count(None)
                counts["blank"] += blank
                counts["duplicate"] += codes.count(_GONE) - blank
                counts["truncated"] += sum(c.isupper() for c in codes)
                counts["illegal"] += row["illegal"]
                if roles:
                    counts["illegal"] += last_role is not None and (last_role, roles[0][:1]) not in _LEGAL
                    last_role = roles[-1][:1]
                counts["turns"] += row["turns"] - (high is not None and row["first_turn"] == high)
                low = row["first_turn"] if low is None else low
                high = row["last_turn"] if row["last_turn"] is not None else high
                rows = [letter for letter in path["audit"] if letter != "I"]
                kept = sum(c.isupper() and letter != "D" for c, letter in zip(codes, rows, strict=True))
                counts["kept"] += TRUNCATED * kept
                audit.append(path["audit"])
                state = path["state"]
            if out.full():
                yield out.batch()
        if any_:
            finish()
        if out is not None:
            yield out.batch()

    return dealt.mapInArrow(forth, schema)


def repair(rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text, dropped): conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256.

    Rows with ``dropped`` only name their conversation; one without other rows has zeros, an empty audit and
    the digest of nothing. A missing conv_id is a conversation like any other. Equal rows of a turn are
    told apart by nothing and come one after the other. An empty table has no rows.
    """
    split = stored(_split(rows, block_rows), "conversation-blocks")
    blocks = _without_repeats(split.where("open is not null").select("conv_id", "open.*"))
    crossed, all_traces = F.arrow_udf(_crossed, _CROSSED), F.arrow_udf(_all_traces, _PATHS)
    blocks = blocks.withColumn("_c", crossed("codes", "again")).drop("codes", "again")
    blocks = blocks.select("*", "_c.*").drop("_c")
    blocks = stored(blocks, "crossed-blocks")
    ends = _ends(blocks).withColumn("key", F.struct("conv_id")).drop("conv_id")
    priced = blocks.withColumn("key", F.struct("conv_id")).join(ends, ["key", "part", "at"])
    traces = priced.withColumn("paths", all_traces("codes", "ends"))
    return split.where("done is not null").select("conv_id", "done.*").unionByName(_joined(traces))


def judge(conversations: DataFrame) -> DataFrame:
    """The result of ``repair`` for ``conversations`` with faults planted by ``damaged``."""
    return repair(damaged(conversations))
