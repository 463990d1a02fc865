"""Structure repair of conversations by the cheapest edits, found by bidirectional Dijkstra.

A conversation is taken by turn (nulls first; ties by role, then text).  Its edit lattice has
a node for every (rows passed, state of the role grammar ``(s?(ua)+)?``); edges keep, rerole,
delete or insert.  Forward and reverse heaps meet in the middle, every crossing of least cost is
finished, and of these the audit (the edits' initials) that is least in ASCII is taken.

Rows are dealt out by ranges of (conversation, turn, ...), so a conversation of any length
spreads over tasks.  Where it is cut, each block of rows gives a table of its cheapest edits
between every entry and exit state; the tables of a conversation (16 letters a row) are joined
by the same search, and the rows then stream past their audit.

Cases: null role or text counts as one space, a null conversation id is an id of its own, null
turns come first and don't count for gaps; rows that are equal throughout are duplicates but for
the first; a role counts by its first letter, an empty one has none; an empty table gives an
empty result; other columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the role grammar: nothing yet, after s, after u, after a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_FREE = {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # where a row of a role of our choice leads
_BLOCK_CHARS, _FAN = 1_000_000, 32
_WORDLESS = re.compile(r"[\x20\t-\r]*\Z")
_LAST = re.compile(r"([^\x20\t-\r])[\x20\t-\r]*\Z")
Edge = tuple[int, int, int, str]  # position, state, cost, letters


def cheapest(steps: int, ahead: Callable[[int, int], list[Edge]], back: Callable[[int, int], list[Edge]], entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest path from (0, entry) to (steps, an exit), the ASCII-least of these.

    ahead(i, s) and back(i, s) give the edges out of and into a node.  Edges that cost nothing pass
    a row, so nodes settled by (cost, rows passed on that side) have got all their labels of that cost; two
    labels of a node of one cost pass the same rows, so neither starts the other and the lesser one stays lesser.
    """
    sides = ({(0, entry): (0, "")}, {(steps, t): (0, "") for t in exits})
    settled: tuple[set, set] = (set(), set())
    heaps = tuple([(0, 0, node) for node in side] for side in sides)
    best = (0, "") if steps == 0 and entry in exits else None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best[0]):
        # sources of both sides first, then the side that is less far
        side = next((k for k in (0, 1) if heaps[k][0][0] == 0 and heaps[k][0][1] == 0), int(heaps[1][0][0] < heaps[0][0][0]))
        _, _, node = heapq.heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side].add(node)
        cost, audit = sides[side][node]
        for j, t, c, letters in (back if side else ahead)(*node):
            if (j, t) in settled[1 - side]:
                c2, audit2 = sides[1 - side][j, t]
                found = (cost + c + c2, audit2 + letters + audit if side else audit + letters + audit2)
                best = found if best is None else min(best, found)
            if (j, t) not in settled[side]:
                label, old = (cost + c, letters + audit if side else audit + letters), sides[side].get((j, t))
                if old is None or label < old:
                    sides[side][j, t] = label
                    heapq.heappush(heaps[side], (cost + c, steps - j if side else j, (j, t)))
    return best


def _row_edges(symbol: str, s: int) -> list[tuple[int, int, str]]:
    """(state, cost, letter) of the edits of one row; symbol: its role's initial, upper case where truncated, - where it must go."""
    out = [(s, DELETE, "D")]
    if symbol != "-":
        extra, role = TRUNCATED * symbol.isupper(), symbol.lower()
        if s in _NEXT.get(role, ()):
            out.append((_NEXT[role][s], extra, "K"))
        out.append((_FREE[s], RETYPE + extra, "R"))
    return out


@functools.lru_cache(100_000)
def _edges_of(symbol: str) -> tuple[tuple, tuple]:
    """The row's edges by state they leave, and by state they reach."""
    out = tuple(tuple(_row_edges(symbol, s)) for s in range(4))
    return out, tuple(tuple((s, c, x) for s in range(4) for t, c, x in out[s] if t == r) for r in range(4))


@functools.lru_cache(50_000)
def solve_rows(symbols: str, entry: int = EMPTY, exits: tuple[int, ...] = (EMPTY, ASSISTANT)) -> tuple[int, str] | None:
    """The cheapest edits of rows given by their symbols."""
    n = len(symbols)

    def ahead(i: int, s: int) -> list[Edge]:
        passed = [(i + 1, t, c, x) for t, c, x in _edges_of(symbols[i])[0][s]] if i < n else []
        return [*passed, (i, _FREE[s], INSERT, "I")]

    def back(i: int, t: int) -> list[Edge]:
        passed = [(i - 1, s, c, x) for s, c, x in _edges_of(symbols[i - 1])[1][t]] if i else []
        return [*passed, *((i, s, INSERT, "I") for s in range(4) if _FREE[s] == t)]

    return cheapest(n, ahead, back, entry, exits)


Table = list[list[tuple[int, str] | None]]  # by entry and exit


def solve_blocks(tables: list[Table], entry: int = EMPTY, exits: tuple[int, ...] = (EMPTY, ASSISTANT)) -> tuple[int, str] | None:
    """The cheapest edits of blocks that follow each other, from their tables."""
    while len(tables) > _FAN:
        tables = [[[solve_blocks(group, s, (t,)) for t in range(4)] for s in range(4)] for group in (tables[i:i + _FAN] for i in range(0, len(tables), _FAN))]
    n = len(tables)

    def ahead(i: int, s: int) -> list[Edge]:
        return [(i + 1, t, *x) for t, x in enumerate(tables[i][s]) if x] if i < n else []

    def back(i: int, t: int) -> list[Edge]:
        return [(i - 1, s, *tables[i - 1][s][t]) for s in range(4) if tables[i - 1][s][t]] if i else []

    return cheapest(n, ahead, back, entry, exits)


def _fault(text: str, again: bool) -> str:
    """b, d, t or blank: the first fault of a row."""
    if _WORDLESS.match(text):
        return "b"
    return "d" if again else " " if _LAST.search(text)[1] in ".!?" else "t"


def _symbol(role: str, fault: str) -> str:
    if fault in "bd":
        return "-"
    x = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return x.upper() if fault == "t" else x


_BLOCK = [("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())),
          ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.string())]
_BLOCK_DDL = "kind int, part int, block int, costs array<long>, audits array<string>, turns array<long>, roles array<string>, texts array<string>, faults string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _blocks(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows to blocks of `most` rows; a conversation that may go on beyond its block also gives tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, size, schema = TaskContext.get().partitionId(), [], 0, None
        conv, first, block, rows, chars = None, True, 0, [], 0

        def close(more: bool) -> None:
            """Rows held leave as a block; more: the conversation may go on behind them."""
            nonlocal block, rows, chars, size
            if more or first or block:
                symbols = "".join(_symbol(r[1], r[3]) for r in rows)
                table = [solve_rows(symbols, s, (t,)) for s in range(4) for t in range(4)]
                out.append((conv, 0, part, block, [x[0] if x else -1 for x in table], [x[1] if x else "" for x in table], None, None, None, None))
            turns, roles, texts, faults = zip(*rows, strict=True)
            out.append((conv, 1, part, block, None, None, turns, roles, texts, "".join(faults)))
            block, rows, size, chars = block + 1, [], size + chars, 0

        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), *_BLOCK])
            for c, turn, role, text, copies, again in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if rows and c != conv:
                    close(False)
                    first, block = False, 0
                conv = c
                for k in range(copies):
                    if len(rows) >= most or chars >= _BLOCK_CHARS:
                        close(True)
                    rows.append((turn, role, text, _fault(text, again or k > 0)))
                    chars += len(text) + 100
                if size >= _BLOCK_CHARS:
                    yield _batch(out, schema)
                    out, size = [], 0
        if rows:
            close(True)
        if out:
            yield _batch(out, schema)

    return run


class _Repair:
    """One conversation's rows as they stream past its audit."""

    def __init__(self, conv) -> None:
        self.conv, self.tables, self.cost, self.audit = conv, [], 0, None
        self.at, self.state, self.last_role, self.turns, self.low, self.high = 0, EMPTY, None, 0, None, None
        self.counts, self.illegal, self.digest, self.kept = dict.fromkeys("bdt ", 0), 0, hashlib.sha256(), 0

    def _emit(self, role: str, text: str, edit: str, turn: int | None) -> tuple:
        self.digest.update(f"{chr(10) * (self.kept > 0)}{role}:{text}".encode())
        self.kept += 1
        self.state = SYSTEM if edit == "K" and self.state == EMPTY and role[:1] == "s" else _FREE[self.state]
        return (self.conv, self.kept - 1, turn, role, text, edit)

    def _inserts(self) -> Iterator[tuple]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._emit("assistant" if self.state == USER else "user", "", "I", None)

    def rows(self, turns: list, roles: list, texts: list, faults: str) -> Iterator[tuple]:
        if self.audit is None:
            self.cost, self.audit = solve_blocks(self.tables) if self.tables else solve_rows("".join(map(_symbol, roles, faults)))
        for turn, role, text, fault in zip(turns, roles, texts, faults, strict=True):
            self.counts[fault] += 1
            self.illegal += self.last_role is not None and self.last_role + role[:1] not in ("su", "ua", "au")
            self.last_role = role[:1]
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
            yield from self._inserts()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit != "D":
                yield self._emit(role if edit == "K" else "assistant" if self.state == USER else "user", text, edit, turn)

    def end(self) -> Iterator[tuple]:
        if self.audit is None:
            self.audit = ""
        yield from self._inserts()

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, self.cost, self.audit, self.digest.hexdigest())


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROWS = "position long, turn long, role string, text string, edit string"


def _stream(fields: str, reports: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks sorted by conversation, tables first, to reports or to repaired rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Repair | None = None
        out: list[tuple] = []
        schema = None

        def done() -> None:
            rows = list(now.end())
            out.extend([now.report()] if reports else rows)

        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), *((c, pa.int64() if t == "long" else pa.string()) for c, t in (f.split(" ") for f in fields.split(", ")))])
            for i in range(batch.num_rows):
                r = {k: batch.column(j)[i].as_py() for j, k in enumerate(batch.schema.names)}
                if now is None or r["conv_id"] != now.conv:
                    if now is not None:
                        done()
                    now = _Repair(r["conv_id"])
                if r["kind"] == 0:
                    cells = [None if c < 0 else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)]
                    now.tables.append([cells[s * 4:s * 4 + 4] for s in range(4)])
                elif r["kind"] == 1:
                    for row in now.rows(r["turns"], r["roles"], r["texts"], r["faults"]):
                        if not reports:
                            out.append(row)
                if len(out) >= (10_000 if reports else 1_000):
                    yield _batch(out, schema)
                    out.clear()
        if now is not None:
            done()
        if out:
            yield _batch(out, schema)

    return run


def _repaired(turns: DataFrame, ids: DataFrame | None, reports: bool, block_rows: int) -> DataFrame:
    n, key = partitions(turns.sparkSession), turns.schema["conv_id"].dataType.simpleString()
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = t.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").cast("int").alias("copies"))
    named = rows.withColumn("k", F.sha2("text", 256))
    timed = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = named.groupBy("conv_id", "role", "k").agg(F.min(timed).alias("at"), F.count("*").alias("times")).where("times > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("k").alias("d"), "at")
    rows = named.join(seen, named["conv_id"].eqNullSafe(F.col("c")) & (named["role"] == F.col("r")) & (named["k"] == F.col("d")), "left")
    again = F.when(F.col("at.known"), F.col("turn") > F.col("at.turn")).otherwise(F.col("turn").isNotNull())
    rows = rows.select("conv_id", "turn", "role", "text", "copies", (F.col("at").isNotNull() & again).alias("again"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*order)
    blocks = dealt.mapInArrow(_blocks(block_rows), f"conv_id {key}, {_BLOCK_DDL}")
    heads = (turns if ids is None else ids).select("conv_id").distinct().select("conv_id", F.lit(-1).alias("kind"))
    together = heads.unionByName(blocks, allowMissingColumns=True).repartition(n, "conv_id").sortWithinPartitions("conv_id", "kind", "part", "block")
    fields = _REPORT if reports else _ROWS
    return together.mapInArrow(_stream(fields, reports), f"conv_id {key}, {fields}")


def repair_reports(turns: DataFrame, ids: DataFrame | None = None, block_rows: int = 512) -> DataFrame:
    """One row for every conv_id of turns (conv_id, turn, role, text), or of ids where given: faults, cost, audit, digest."""
    return _repaired(turns, ids, True, block_rows)


def repair_turns(turns: DataFrame, block_rows: int = 512) -> DataFrame:
    """The repaired rows: conv_id, position, turn (null: inserted), role, text, edit (K, R or I)."""
    return _repaired(turns, None, False, block_rows)


def damage(turns: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn``: one in 20 each dropped, emptied, cut of its end marks, repeated, made user's."""
    kind = turns.schema["conv_id"].dataType
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = turns.select(F.col("conv_id").cast(kind).alias("conv_id"), F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"),
                     (F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("h") == 3, 2).otherwise(1)
    return t.where("h <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_")).drop("_")
