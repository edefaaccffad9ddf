"""Repair of a conversation's structure at the least cost, with an audit of the edits.

Each row is a symbol: its role's kind and its fault. Runs of equal symbols are collapsed; a run is
advanced by cached binary powers of its symbol's min-plus transition between the grammar's states,
from the conversation's end to its start, and the choices are unrolled by the same halves.

Rows are range-sorted, so that a conversation of any length is spread over tasks. One that lies
inside a task's range is repaired there. What may go on in a neighbour's range, and long ones, are
carried on as symbols, one character a row, and meet their rows again by place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from taxaspark.llm.common import cut

SPACES = " \t\n\v\f\r"
#: Kinds of roles by their initial (other ones have the next number) and faults: a symbol is 4 * kind + fault.
INITIALS, OTHER = "sua", 3
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
STATES = range(4)
ROLE_NEXT = ("user", "user", "assistant", "user")
STATE_NEXT = (2, 2, 3, 2)
EMITS = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
#: Costs of the edits, and what a truncated row costs that stays.
DELETE, INSERT, KEEP, REROLE, STAYS_CUT = 2, 5, 0, 1, 5
FAR = 1 << 60
#: Rows of a conversation that a task repairs at once; longer ones go the way of those that span tasks.
LONG = 4096
#: A run's choices are remembered up to this power of two.
SMALL = 10

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def _product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


def _inserts() -> Matrix:
    one = tuple(tuple(0 if i == j else INSERT if STATE_NEXT[i] == j else FAR for j in STATES) for i in STATES)
    return _product(_product(one, one), one)


def _edits(symbol: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a row: (initial, cost, state after), by initial."""
    kind, fault = divmod(symbol, 4)
    out = []
    for i in STATES:
        own = [("D", DELETE, i)]
        if fault not in (BLANK, DUPLICATE):
            more = STAYS_CUT if fault == TRUNCATED else 0
            if (i, kind) in EMITS:
                own.append(("K", KEEP + more, EMITS[i, kind]))
            own.append(("R", REROLE + more, STATE_NEXT[i]))
        out.append(own)
    return out


INSERTS = _inserts()
EDITS = [_edits(s) for s in range(4 * (OTHER + 1))]
#: From each state to the end: inserts until the grammar accepts.
END: Vector = tuple(min(INSERTS[i][0], INSERTS[i][3]) for i in STATES)


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> Matrix:
    """Least costs between states over 2**k rows of a symbol, inserts before each included."""
    if k:
        half = power(symbol, k - 1)
        return _product(half, half)
    row = [[min((c for _, c, to in EDITS[symbol][i] if to == j), default=FAR) for j in STATES] for i in STATES]
    return _product(INSERTS, tuple(map(tuple, row)))


@lru_cache(maxsize=1 << 16)
def advance(symbol: int, k: int, costs: Vector) -> tuple[Vector, int]:
    """Costs to the end from before 2**k rows, given those from behind them; the least is taken off."""
    m = power(symbol, k)
    out = [min(m[i][j] + costs[j] for j in STATES) for i in STATES]
    least = min(out)
    return tuple(x - least for x in out), least


def _row(symbol: int, costs: Vector, state: int) -> tuple[str, int]:
    """The ASCII-least edits of one row that keep to the least cost."""
    before, off = advance(symbol, 0, costs)
    done = ""
    while True:
        left = before[state] + off
        for name, cost, to in EDITS[symbol][state][:1]:
            if cost + costs[to] == left:
                return done + name, to
        if INSERT + before[STATE_NEXT[state]] + off == left:
            done, state = done + "I", STATE_NEXT[state]
            continue
        for name, cost, to in EDITS[symbol][state][1:]:
            if cost + costs[to] == left:
                return done + name, to


def _halves(symbol: int, k: int, costs: Vector, state: int) -> tuple[str, int]:
    if not k:
        return _row(symbol, costs, state)
    first, between = unroll(symbol, k - 1, advance(symbol, k - 1, costs)[0], state)
    second, after = unroll(symbol, k - 1, costs, between)
    return first + second, after


_known = lru_cache(maxsize=1 << 14)(_halves)


def unroll(symbol: int, k: int, costs: Vector, state: int) -> tuple[str, int]:
    """Edits of 2**k rows of a symbol and the state after them, given the costs from behind them."""
    return (_known if k <= SMALL else _halves)(symbol, k, costs, state)


def _runs(symbols: str) -> list[tuple[int, int]]:
    """(symbol, k) of blocks of 2**k equal symbols, in order."""
    out = []
    for c, same in groupby(symbols):
        n = sum(1 for _ in same)
        out += [(ord(c) - 65, k) for k in range(n.bit_length()) if n >> k & 1]
    return out


def solve_parts(parts: list[str]) -> tuple[list[str], list[int], int]:
    """Of a conversation's symbols in parts: the edits of each part, the state before it, the cost.

    Inserts at the end belong to the last part. Only a part's runs are held at once.
    """
    behind, costs, total = [], END, 0
    for part in reversed(parts):
        behind.append(costs)
        for symbol, k in reversed(_runs(part)):
            costs, off = advance(symbol, k, costs)
            total += off
    total += costs[0]
    pieces, states, state = [], [], 0
    for part, costs in zip(parts, reversed(behind)):
        states.append(state)
        runs, after = _runs(part), []
        for symbol, k in reversed(runs):
            after.append(costs)
            costs = advance(symbol, k, costs)[0]
        piece = []
        for (symbol, k), costs in zip(runs, reversed(after)):
            edits, state = unroll(symbol, k, costs, state)
            piece.append(edits)
        pieces.append("".join(piece))
    while END[state]:
        pieces[-1] += "I"
        state = STATE_NEXT[state]
    return pieces, states, total


def moves(edits: str, symbols: str, state: int = 0) -> list[tuple[int, int, str, str | None]]:
    """(row, place among what comes at that row, edit, role or None for the row's own) of each turn
    that stays or comes. Inserts come at the row behind them, or at the last row after it."""
    out, row, place = [], 0, 0
    for e in edits:
        if e != "D":
            if e == "K":
                role, state = None, EMITS[state, (ord(symbols[row]) - 65) // 4]
            else:
                role, state = ROLE_NEXT[state], STATE_NEXT[state]
            last = row == len(symbols)
            out.append((row - last, place, e, role))
        if e == "I":
            place += 1
        else:
            row += 1
            place = 0 if row < len(symbols) else place + 1
    return out


def counts(symbols: str) -> tuple[int, int, int, int]:
    """(blank, duplicate, truncated, illegal) of a conversation's symbols."""
    s = np.frombuffer(symbols.encode(), np.uint8) - 65
    faults, kinds = np.bincount(s % 4, minlength=4), s // 4
    pair = 4 * kinds[:-1] + kinds[1:]
    legal = np.isin(pair, [4 * INITIALS.index(a) + INITIALS.index(b) for a, b in ("su", "ua", "au")])
    return int(faults[BLANK]), int(faults[DUPLICATE]), int(faults[TRUNCATED]), int((~legal).sum())


@lru_cache(maxsize=1 << 14)
def solve(symbols: str) -> tuple[str, int, tuple, list]:
    (edits,), _, cost = solve_parts([symbols])
    return edits, cost, counts(symbols), moves(edits, symbols)


TURN, AUDIT, OPEN = range(3)
_AUDIT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _schema(conv_id: T.DataType) -> T.StructType:
    long, text = T.LongType(), T.StringType()
    fields = [("kind", T.ByteType()), ("conv_id", conv_id), ("pos", long), ("place", long), ("edit", text), ("turn", long), ("role", text), ("text", text), ("symbol", T.ByteType()), ("digest", T.BinaryType())]
    return T.StructType([T.StructField(n, t) for n, t in fields + [(n, long) for n in _AUDIT] + [("audit", text)]])


def _repair_sorted(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def given(n: int, kind: int, **columns) -> pa.RecordBatch:
        filled = {"kind": pa.array(np.full(n, kind, np.int8))} | columns
        return pa.record_batch([filled[f.name].cast(f.type) if f.name in filled else pa.nulls(n, f.type) for f in schema], schema=schema)

    def marked(rows: pa.Table, seen: set) -> list[int]:
        """Symbols of rows in which repeats of what was seen are duplicates; adds to what was seen."""
        out = []
        for symbol, digest in zip(rows["symbol"].to_pylist(), rows["digest"].to_pylist()):
            if symbol % 4 != BLANK:
                if digest in seen:
                    symbol += DUPLICATE - symbol % 4
                else:
                    seen.add(digest)
            out.append(symbol)
        return out

    def left_open(rows: pa.Table, seen: set) -> Iterator[pa.RecordBatch]:
        symbols = marked(rows, seen)
        digest = [d if s % 4 not in (BLANK, DUPLICATE) else None for s, d in zip(symbols, rows["digest"].to_pylist())]
        own = rows.combine_chunks()
        same = {c: own[c].chunk(0) if own[c].num_chunks else pa.array([], own[c].type) for c in ("conv_id", "pos", "turn", "role", "text")}
        yield given(len(symbols), OPEN, symbol=pa.array(symbols, pa.int8()), digest=pa.array(digest, pa.binary()), **same)

    def repaired(rows: pa.Table, bounds: list[int]) -> Iterator[pa.RecordBatch]:
        """Whole conversations, each of the rows between two bounds."""
        turns, symbols, digests = (rows[c].to_pylist() for c in ("turn", "symbol", "digest"))
        take, place, edit, role, audits, found = [], [], [], [], [], []
        for a, b in zip(bounds, bounds[1:]):
            seen, own = set(), []
            for s, d in zip(symbols[a:b], digests[a:b]):
                if s % 4 != BLANK:
                    if d in seen:
                        s += DUPLICATE - s % 4
                    else:
                        seen.add(d)
                own.append(chr(65 + s))
            edits, cost, faults, stay = solve("".join(own))
            for r, p, e, as_role in stay:
                take.append(a + r)
                place.append(p)
                edit.append(e)
                role.append(as_role)
            numbered = [t for t in turns[a:b] if t is not None]
            gaps = numbered[-1] - numbered[0] + 1 - len(set(numbered)) if numbered else 0
            audits.append((gaps, *faults, cost))
            found.append(edits)
        kept = rows.select(["conv_id", "pos", "role", "text"]).take(pa.array(take, pa.int64())).combine_chunks()
        edit_column = pa.array(edit, pa.string())
        given_role = pa.array(role, pa.string())
        column = lambda c: pa.concat_arrays(kept[c].chunks) if kept[c].num_chunks else pa.array([], kept[c].type)
        text = pa.compute.if_else(pa.compute.equal(edit_column, "I"), "", column("text"))
        yield given(len(take), TURN, conv_id=column("conv_id"), pos=column("pos"), place=pa.array(place, pa.int64()), edit=edit_column, role=pa.compute.coalesce(given_role, column("role")), text=text)
        ids = rows["conv_id"].take(pa.array(bounds[:-1], pa.int64())).combine_chunks()
        yield given(len(audits), AUDIT, conv_id=ids, audit=pa.array(found, pa.string()), **{c: pa.array(x, pa.int64()) for c, x in zip(_AUDIT, zip(*audits))})

    held: pa.Table | None = None
    is_open, seen, before = True, set(), None  # the conversation at hand; a range's first may have begun before it
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        elif before is not None and before != (rows["conv_id"][0].as_py(),):
            is_open, seen = False, set()  # the open one ended with the batch before
        codes = rows["conv_id"].combine_chunks()
        codes = (pa.concat_arrays(codes.chunks) if isinstance(codes, pa.ChunkedArray) else codes).dictionary_encode(null_encoding="encode").indices.to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        before = (rows["conv_id"][len(codes) - 1].as_py(),)
        if is_open:
            yield from left_open(rows.slice(0, bounds[1]), seen)
            if len(bounds) == 2:
                held = None
                continue
            bounds = bounds[1:]
            is_open, seen = False, set()
        if len(bounds) > 2:
            start = bounds[0]
            yield from repaired(rows.slice(start, bounds[-2] - start), [b - start for b in bounds[:-1]])
        held = rows.slice(bounds[-2])
        if held.num_rows > LONG or held.nbytes > 1 << 24:
            is_open, seen = True, set()
            yield from left_open(held, seen)
            held = None
    if held is not None:
        yield from left_open(held, set())


@dataclass
class Repaired:
    audits: DataFrame  # conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    turns: DataFrame  # conv_id, pos, place, edit, role, text: the conversations after it, by pos and place


def _open_symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, symbol) with the repeats marked that other ranges began."""
    own = rows.select("conv_id", "pos", "symbol", "digest")
    fresh = own.filter(F.col("digest").isNotNull())  # one of a digest in each range
    first = fresh.groupBy("conv_id", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    met = fresh.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    repeat = F.col("pos") > F.col("first")
    met = met.select("conv_id", "pos", F.when(repeat, F.col("symbol") - F.col("symbol") % 4 + DUPLICATE).otherwise(F.col("symbol")).alias("symbol"))
    return met.unionByName(own.filter(F.col("digest").isNull()).select("conv_id", "pos", F.col("symbol").cast("int").alias("symbol")))


_SOLVED = T.StructType([T.StructField("edits", T.ArrayType(T.StringType())), T.StructField("states", T.ArrayType(T.IntegerType()))])
for _c in ("cost", "blank", "duplicate", "truncated", "illegal"):
    _SOLVED.add(_c, T.LongType())


@arrow_udf(_SOLVED)
def _solve_parts(parts: pa.Array) -> pa.Array:
    out = []
    for own in parts.to_pylist():
        edits, states, cost = solve_parts(own)
        out.append({"edits": edits, "states": states, "cost": cost} | dict(zip(("blank", "duplicate", "truncated", "illegal"), counts("".join(own)))))
    kinds = [("edits", pa.list_(pa.string())), ("states", pa.list_(pa.int32()))] + [(c, pa.int64()) for c in ("cost", "blank", "duplicate", "truncated", "illegal")]
    return pa.array(out, pa.struct(kinds))


def _moves_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batch.to_pylist():
            found = moves(part["edits"], part["symbols"], part["state"])
            for at in range(0, len(found), 1 << 16):
                row, place, edit, role = zip(*found[at : at + (1 << 16)])
                yield pa.record_batch({"pos": pa.array(np.array(row) + part["start"], pa.int64()), "place": pa.array(place, pa.int64()), "edit": pa.array(edit, pa.string()), "as_role": pa.array(role, pa.string())})


def _repair_open(rows: DataFrame) -> Repaired:
    """Of conversations whose rows lie in several ranges. Their rows have consecutive places in each."""
    symbols = cut(_open_symbols(rows))
    part = F.shiftright("pos", 33)
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda s: F.char(s["symbol"] + 65)), "")
    parts = symbols.groupBy("conv_id", part.alias("part")).agg(F.min("pos").alias("start"), letters.alias("symbols"))  # no longer than a range
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "symbols"))).alias("parts"))  # a character a row, as in the audit
    solved = cut(whole.withColumn("found", _solve_parts(F.transform("parts", lambda p: p["symbols"]))))
    turns = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    turns = turns.withColumnRenamed("conv_id", "_conv")
    audits = solved.join(turns, F.col("conv_id").eqNullSafe(F.col("_conv")))
    audits = audits.select("conv_id", "gaps", *[F.col(f"found.{c}").alias(c) for c in _AUDIT[1:]], F.array_join("found.edits", "").alias("audit"))
    each = solved.select(F.explode(F.arrays_zip("parts", F.col("found.edits").alias("edits"), F.col("found.states").alias("states"))).alias("p"))
    each = each.select("p.parts.start", "p.parts.symbols", "p.edits", F.col("p.states").alias("state"))
    found = each.mapInArrow(_moves_of_parts, "pos bigint, place bigint, edit string, as_role string")
    kept = found.join(rows.select("conv_id", "pos", "role", "text"), "pos")
    text = F.when(F.col("edit") == "I", "").otherwise(F.col("text"))
    return Repaired(audits, kept.select("conv_id", "pos", "place", "edit", F.coalesce("as_role", "role").alias("role"), text.alias("text")))


def repair(turns: DataFrame) -> Repaired:
    """The cheapest edits that make each conversation's role initials ``(s?(ua)+)?``.

    ``turns(conv_id, turn, role, text)``; other columns are left out. A null role or text is one
    space; rows come by turn, nulls first, then by role and text (by its first 64 characters, then
    by a digest), so equal rows are neighbours. Blank rows and repeats of a role and text go;
    truncated ones go or cost ``STAYS_CUT``. Of edits of equal cost the ASCII-least audit is taken. A
    null conv_id is a conversation. No rows give no audits and no turns.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    df = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.left("role", F.lit(1))
    kind = F.lit(OTHER)
    for k, c in enumerate(INITIALS):
        kind = F.when(initial == c, k).otherwise(kind)
    fault = F.when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    digest = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")))
    df = df.withColumns({"symbol": (4 * kind + fault).cast("tinyint"), "digest": digest, "_start": F.left("text", F.lit(64)), "_row": F.monotonically_increasing_id()})
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "_start", "digest", "_row")]  # _row parts equal rows
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()).drop("_start", "_row")
    schema = _schema(turns.schema["conv_id"].dataType)
    arrow = pa.schema([(f.name, pa.int8() if f.name in ("kind", "symbol") else {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}.get(f.dataType.simpleString())) for f in schema if f.name != "conv_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal out
            for b in batches:
                out = out or pa.schema([pa.field("conv_id", b.schema.field("conv_id").type) if f.name == "conv_id" else arrow.field(f.name) for f in schema])
                yield b

        out = None
        first = next(rows := typed(), None)
        if first is not None:
            yield from _repair_sorted(out, (b for part in ([first], rows) for b in part))

    stored = cut(placed.mapInArrow(run, schema))
    inner = stored.filter(F.col("kind") == TURN).select("conv_id", "pos", "place", "edit", "role", "text")
    audits = stored.filter(F.col("kind") == AUDIT).select("conv_id", *_AUDIT, "audit")
    spanning = _repair_open(stored.filter(F.col("kind") == OPEN))
    return Repaired(audits.unionByName(spanning.audits), inner.unionByName(spanning.turns))


def digests(turns: DataFrame, line: Column) -> DataFrame:
    """(conv_id, sha256) of each conversation's lines, joined by newlines. Lines stream through the
    hash one after another, so a conversation of any length takes no memory."""
    import hashlib

    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "pos", "place", line.alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "place").select("conv_id", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hashed, kind = None, None, None
        for batch in batches:
            done, kind = [], batch.schema.field(0).type
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at == (conv,):
                    hashed.update(b"\n")
                else:
                    if at is not None:
                        done.append((at[0], hashed.hexdigest()))
                    at, hashed = (conv,), hashlib.sha256()
                hashed.update(text.encode())
            if done:
                yield pa.record_batch([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], ["conv_id", "sha256"])
        if at is not None:
            yield pa.record_batch([pa.array([at[0]], kind), pa.array([hashed.hexdigest()])], ["conv_id", "sha256"])

    return rows.mapInArrow(run, f"conv_id {kind}, sha256 string")
