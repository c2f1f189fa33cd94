"""Conversation structure repair by a generalised LR parser over the grammar of roles.

A conversation is right if the initials of its roles are ``(s?(ua)+)?``. The parser reads the rows of one that may be
wrong. At every row it tries each edit (keep, rerole, delete, and inserts before it) on every stack that is alive; stacks
share their lower cells, and equal ones are merged by the minimum of (cost, audit), where the audit is the
initials of the edits so far. Two audits of one row and cost are never prefixes of each other, so the lesser one stays the
lesser whatever follows, and merging is exact.

Few stacks can be alive between two rows, whatever came before (``STACKS``). A conversation is therefore cut into segments
that are parsed apart, from each of these stacks, and the segments of a conversation are joined by their ends: one that
holds a third of all rows is parsed by many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cuelight.plans.groups import has_hot_group
from cuelight.plans.scan import following, ordered_scan, previous, running

from .tables import stored

#: Size of a segment; a row counts one, and one more for every 1024 bytes.
SEGMENT = 1024
#: The grammar of roles, first the goal; the roles; costs of the edits and of a truncated row that stays.
GRAMMAR = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "Q"), ("P", "PQ"), ("Q", "ua"))
ROLES = {"s": "system", "u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"


class Parser:
    """LR(0) states of a grammar and the stacks that can be alive. A stack is ``(state, stack below)``."""

    def __init__(self, grammar: tuple[tuple[str, str], ...], tokens: str):
        self.rules = [("", grammar[0][0]), *grammar]
        self.states = [self._closed({(0, 0)})]
        self.goto: dict[tuple[int, str], int] = {}
        for n, items in enumerate(self.states):  # grows meanwhile
            for symbol in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
                target = self._closed({(r, d + 1) for r, d in items if self.rules[r][1][d:d + 1] == symbol})
                if target not in self.states:
                    self.states.append(target)
                self.goto[n, symbol] = self.states.index(target)
        self.stacks = [(0, None)]
        self.moves: list[dict[str, tuple[int, ...]]] = []
        for stack in self.stacks:
            self.moves.append({})
            for token in tokens:
                found = sorted(self._shifted(stack, token))
                self.stacks += [s for s in found if s not in self.stacks]
                self.moves[-1][token] = tuple(self.stacks.index(s) for s in found)
        self.accepts = [any(self.states[s[0]] >= {(0, 1)} for s in self._reduced(stack)) for stack in self.stacks]

    def _closed(self, items: set[tuple[int, int]]) -> frozenset:
        todo = list(items)
        while todo:
            rule, dot = todo.pop()
            ahead = self.rules[rule][1][dot:dot + 1]
            new = {(i, 0) for i, (left, _) in enumerate(self.rules) if left == ahead and ahead} - items
            items |= new
            todo += new
        return frozenset(items)

    def _reductions(self, stack: tuple) -> list[tuple]:
        out = []
        for rule, dot in self.states[stack[0]]:
            left, right = self.rules[rule]
            if dot == len(right) and left:
                below = stack
                for _ in right:
                    below = below[1]
                out.append((self.goto[below[0], left], below))
        return out

    def _settled(self, stack: tuple) -> tuple:
        """The stack after the reductions that are the only thing to do."""
        while len(self.states[stack[0]]) == 1 and (found := self._reductions(stack)):
            stack, = found
        return stack

    def _reduced(self, stack: tuple) -> set:
        found, todo = {stack}, [stack]
        while todo:
            new = set(self._reductions(todo.pop())) - found
            found |= new
            todo += new
        return found

    def _shifted(self, stack: tuple, token: str) -> set:
        return {self._settled((self.goto[s[0], token], s)) for s in self._reduced(stack) if (s[0], token) in self.goto}


PARSER = Parser(GRAMMAR, "".join(ROLES))
STACKS = len(PARSER.stacks)

Alive = dict[int, tuple[int, str]]


def inserted(alive: Alive) -> Alive:
    """The stacks alive after any number of inserts."""
    alive = dict(alive)
    todo = list(alive)
    while todo:
        stack = todo.pop()
        cost, audit = alive[stack]
        for token in "ua":
            for target in PARSER.moves[stack][token]:
                if (offer := (cost + INSERT, audit + "I")) < alive.get(target, (offer[0] + 1, "")):
                    alive[target] = offer
                    todo.append(target)
    return alive


def advanced(alive: Alive, initial: str, fault: str | None) -> Alive:
    """The stacks alive after a row with the given initial of its role and fault."""
    out: Alive = {}

    def offer(stack: int, cost: int, audit: str) -> None:
        if (cost, audit) < out.get(stack, (cost + 1, "")):
            out[stack] = cost, audit

    stays = CUT if fault == "truncated" else 0
    for stack, (cost, audit) in inserted(alive).items():
        offer(stack, cost + DELETE, audit + "D")
        if fault in ("blank", "duplicate"):
            continue
        for target in PARSER.moves[stack].get(initial, ()):
            offer(target, cost + stays, audit + "K")
        for token in "ua":
            for target in PARSER.moves[stack][token]:
                offer(target, cost + REROLE + stays, audit + "R")
    return out


def finished(alive: Alive) -> tuple[int, str]:
    """The least (cost, audit) of the stacks that are right conversations, at the end of the rows."""
    return min(weight for stack, weight in inserted(alive).items() if PARSER.accepts[stack])


def parsed(rows: Iterable[tuple[str, str | None]], start: int = 0) -> Alive:
    """The stacks alive after rows of (initial, fault) that begin on one stack."""
    alive: Alive = {start: (0, "")}
    for initial, fault in rows:
        alive = advanced(alive, initial, fault)
    return alive


def rendered(start: int, audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) that edits make of rows of (role, text), from a stack on."""
    stack, rows = start, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            token = role[0]
        else:
            token = next(t for t in "ua" if PARSER.moves[stack][t])
            role = ROLES[token]
        stack, = PARSER.moves[stack][token]
        yield role, text


def damage(rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
           text_column: str = "text") -> DataFrame:
    """``rows`` with faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes its ``.!?``,
    3 repeats it, 4 sets its role to user. Nulls in text and role, and in the sum, are one space; ids and turns stay null."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    lot = F.crc32(F.concat_ws(":", filled(id_column), filled(turn_column)).cast("binary")) % 20
    text, role = filled(text_column), filled(role_column)
    return rows.select(F.col(id_column).alias("conv_id"), F.col(turn_column).alias("turn"), lot.alias("lot"), role.alias("role"), text.alias("text")).filter(
        "lot <> 0").select(
        "conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


KEY = ["none", "conv"]
ORDER = ["turn", "role", "text", "place"]


def _key(column: Column, kind: str) -> list[Column]:
    return [column.isNull().alias("none"), F.coalesce(column, F.lit(0).cast(kind)).alias("conv")]


def marked(rows: DataFrame, max_group_rows: int | None = None) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` in order, each with its fault, its segment and what the row before it says.

    The order is by turn (nulls first), then role and text. Conversations that are too long for a task are numbered in
    ranges.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("text", "role"))
    plain = rows.select(*_key(F.col("conv_id"), kind), "turn", role, text, F.monotonically_increasing_id().alias("place"))
    hot = has_hot_group(plain.select(*KEY), KEY, max_group_rows)
    if not hot:
        plain = plain.repartition(*KEY)
    named = plain.withColumn("digest", F.sha2("text", 256))
    seen = ordered_scan(named, [*KEY, "role", "digest"], ["turn", "place"], [previous("seen", F.lit(True))], hot=hot).drop("digest")
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (F.when(end == "", "blank").when(F.col("seen"), "duplicate")
             .when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated"))
    faulty = seen.select(*KEY, *ORDER, F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    return ordered_scan(faulty, KEY, ORDER, [
        running("before", "sum", F.lit(1) + F.floor(F.octet_length("text") / 1024)),
        previous("last_initial", F.col("initial")), previous("last_turn", F.col("turn")), following("next", F.lit(True)),
    ], hot=hot).withColumn("segment", F.floor(F.coalesce("before", F.lit(0)) / SEGMENT).cast("long")).drop("before")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow each other with the same first ``keys`` columns: those, and the others of each row."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    for key, run in groupby(rows, key=lambda row: row[:keys]):
        yield key, [row[keys:] for row in run]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def solved(rows: DataFrame) -> DataFrame:
    """Rows ``(none, conv, segment, start, edits, cost, audit)`` of ``marked`` rows: for each segment the stack that it begins
    on and its edits, and with the last one of a conversation the cost and audit of all of it. A task of the last step holds the ends of
    one conversation's segments: some dozen times its audit, which is one value of the result."""
    kind = rows.schema["conv"].dataType.simpleString()
    small = rows.select(*KEY, "segment", *ORDER, "initial", "fault", F.col("next").isNull().alias("last"))
    small = small.repartition(*KEY, "segment").sortWithinPartitions(*KEY, "segment", *ORDER).drop(*ORDER)
    schema = f"none boolean, conv {kind}, segment long, start int, stop int, cost long, edits string"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for (none, conv, segment), run in _runs(batches, 3):
                own = [(initial, fault) for initial, fault, _ in run]
                if segment == 0 and run[-1][2]:  # all of a conversation
                    cost, edits = finished(parsed(own))
                    yield none, conv, segment, 0, None, cost, edits
                    continue
                for start in range(1 if segment == 0 else STACKS):
                    for stop, (cost, edits) in parsed(own, start).items():
                        yield none, conv, segment, start, stop, cost, edits

        return _batches(found(), arrow)

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        key = frame["none"].iloc[0], frame["conv"].iloc[0]
        alive = {0: (0, "", None)}  # cost, audit, (segment, start, edits, earlier ones)
        for segment, own in frame.groupby("segment"):
            following_ones: dict[int, tuple] = {}
            for start, stop, cost, edits in own[["start", "stop", "cost", "edits"]].itertuples(index=False):
                if start in alive:
                    total, audit, path = alive[start]
                    offer = total + cost, audit + edits
                    if stop not in following_ones or offer < following_ones[stop][:2]:
                        following_ones[stop] = *offer, (segment, start, edits, path)
            alive = following_ones
        ends = inserted({stack: weight[:2] for stack, weight in alive.items()})
        total, audit = min(weight for stack, weight in ends.items() if PARSER.accepts[stack])
        for cost, head, path in alive.values():
            if audit[:len(head)] == head and total - cost == INSERT * (len(audit) - len(head)) and not audit[len(head):].strip("I"):
                break
        out, more = [], audit[len(head):]
        while path is not None:
            segment, start, edits, path = path
            out.append((*key, segment, start, edits + more, None if out else total, None if out else audit))
            more = ""
        return pd.DataFrame(out, columns=["none", "conv", "segment", "start", "edits", "cost", "audit"]).astype({"cost": "Int64"})

    arrow = pa.schema([("none", pa.bool_()), ("conv", _arrow_type(rows, "conv")), ("segment", pa.int64()), ("start", pa.int32()),
                       ("stop", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
    parts = stored(small.mapInArrow(parse, schema), "segments")
    whole = parts.filter("stop is null").select(*KEY, "segment", "start", "edits", "cost", F.col("edits").alias("audit"))
    cut = parts.filter("stop is not null").groupBy(*KEY).applyInPandas(
        join, f"none boolean, conv {kind}, segment long, start int, edits string, cost long, audit string")
    return whole.unionByName(cut)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """Rows ``(conv_id, segment, place, role, text)``: the conversations of ``rows(conv_id, turn, role, text)`` repaired, in the
    order of segment and place. Cases as in ``repair``."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    done = stored(marked(rows), "marked")
    ready = done.join(solved(done), [*KEY, "segment"]).select(*KEY, "segment", "start", "edits", *ORDER)
    ready = ready.repartition(*KEY, "segment").sortWithinPartitions(*KEY, "segment", *ORDER).drop("turn", "place")
    arrow = pa.schema([("conv_id", _arrow_type(rows, "conv_id")), ("segment", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for (none, conv, segment, start, edits), run in _runs(batches, 5):
                for place, (role, text) in enumerate(rendered(start, edits, run)):
                    yield None if none else conv, segment, place, role, text

        return _batches(found(), arrow)

    return ready.mapInArrow(render, f"conv_id {kind}, segment long, place long, role string, text string")


def repair(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """Rows ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, one per conversation of
    ``rows(conv_id, turn, role, text)`` and of ``originals(conv_id)``.

    Rows are taken by turn, nulls first; rows of one turn by role and text. A null role or text is one space; null ids are
    one conversation. A role tells its kind by its first character; an empty one, like any that is not s, u or a, cannot be
    kept as it is. Repeated rows are duplicates. ``gaps`` beyond a long is null. A conversation of ``originals`` without
    rows has zeros, an empty audit and the digest of nothing; an empty table gives an empty one. Other columns are not read.

    The digest of a conversation is taken by one task, as SHA-256 goes from the first byte to the last, but it passes its rows on one by
    one; all other steps divide long conversations.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    done = stored(marked(rows), "marked")
    pieces = stored(solved(done), "pieces")
    pair = F.concat("last_initial", "initial")
    n = lambda condition: F.count(F.when(condition, 1))
    stats = done.groupBy(*KEY).agg(
        *[n(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")],
        n(F.col("last_initial").isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"),
        F.max("turn").cast("decimal(20,0)").alias("most"), F.min("turn").cast("decimal(20,0)").alias("least"),
        n(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("last_turn"))).alias("turns"),
    ).withColumn("gaps", F.expr("coalesce(try_cast(most - least + 1 - turns as long), if(most is null, 0, null))"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            key, state, empty = None, None, True
            for (none, conv, _, start, edits), run in _runs(batches, 5):
                if key != (none, conv):
                    if key is not None:
                        yield *key, state.hexdigest()
                    key, state, empty = (none, conv), hashlib.sha256(), True
                for role, text in rendered(start, edits, run):
                    state.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            if key is not None:
                yield *key, state.hexdigest()

        return _batches(found(), arrow)

    arrow = pa.schema([("none", pa.bool_()), ("conv", _arrow_type(done, "conv")), ("repaired_sha256", pa.string())])
    ready = done.select(*KEY, "segment", *ORDER).repartition(*KEY).join(
        pieces.select(*KEY, "segment", "start", "edits").repartition(*KEY), [*KEY, "segment"])
    ready = ready.select(*KEY, "segment", "start", "edits", *ORDER).sortWithinPartitions(*KEY, "segment", *ORDER).drop("turn", "place")
    hashed = ready.mapInArrow(digest, f"none boolean, conv {kind}, repaired_sha256 string")
    totals = pieces.filter("cost is not null").select(*KEY, "cost", "audit")
    ids = rows.select("conv_id") if originals is None else rows.select("conv_id").unionByName(originals.select("conv_id"))
    ids = ids.distinct().select("conv_id", *_key(F.col("conv_id"), kind))
    joined = ids.join(stats, KEY, "left").join(totals, KEY, "left").join(hashed, KEY, "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id", F.when(F.col("blank").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps")).alias("gaps"), *zero,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
