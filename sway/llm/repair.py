"""Repair of broken conversations by the cheapest edits, found with an auction algorithm.

A conversation must read ``(s?(ua)+)?`` in the initials of its roles: an optional system message, then user and
assistant in turn, ending with an assistant; or nothing.  Rows may be kept, get another role, be deleted, or
have empty messages inserted around them, at whole-number costs, so the repairs of n rows are the paths through a
lattice of nodes (row, state) to its last layer, where the state is what was read so far.

The auction algorithm finds the shortest path: each node has a price, at first a lower bound; a path grows from the origin
along the arc of least cost plus price, and where the last node's price is below that least sum, the price
rises to it and the path steps back.  Prices never exceed true distances, and those of nodes on shortest
paths reach them, so the arcs of every shortest path are tight: cost equals the difference of prices.  The tight arcs
that lead to the end are traced in the order of their letters (Delete, Insert, Keep, Rerole), which gives the
ASCII-least of the cheapest repairs.  A long lattice is cut into spans that are priced from the last to the first, each ending
at the settled prices of the next, so the work grows with the rows and not with their square.

A conversation may hold any share of the rows.  All rows are dealt to sorted ranges, whatever key is hot, and
numbered; a conversation of more than BLOCK rows is cut into blocks.  For these, tasks price each block from every
state to every state, the little matrices are combined per conversation, and so each block learns its end prices and
its first state, and is repaired by a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sway.llm.chat import stream
from sway.llm.common import prepare, shared_table, shuffle_partitions

DELETE, INSERT, TRUNCATED, KEEP, REROLE = 4, 3, 3, 0, 3
#: Rows of a block, and rows whose prices are settled together.
BLOCK, SPAN = 1024, 8
FAULTS = ("", "blank", "duplicate", "truncated")
#: States: nothing read, system read, user read, assistant read.  An inserted or rerole'd message leads to:
ADDED = (2, 2, 3, 2)
ENDS = (0, 3)
ROLES = {2: "user", 3: "assistant"}
FAR = float("inf")


@cache
def arcs(initial: str, fault: int) -> tuple[tuple[tuple[str, int, int, int], ...], ...]:
    """For each state, the arcs (letter, cost, rows used, next state) at a row; a fault of -1: behind the last row."""
    out = []
    for state in range(4):
        found = [("I", INSERT, 0, ADDED[state])]
        if fault >= 0:
            found.append(("D", DELETE, 1, state))
        if fault in (0, 3):
            more = TRUNCATED if fault == 3 else 0
            found.append(("R", REROLE + more, 1, ADDED[state]))
            following = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, initial))
            if following is not None:
                found.append(("K", KEEP + more, 1, following))
        out.append(tuple(sorted(found)))
    return tuple(out)


class Lattice:
    """Prices of the nodes of some rows; ``ends`` are the settled prices of the layer behind them (none: the
    conversation ends there)."""

    def __init__(self, rows: list[tuple[str, int]], ends: Iterable[float] | None = None, states: Iterable[int] = range(4)):
        self.rows, self.n = rows, len(rows)
        self.final = ends is None
        self.price = [[FAR] * 4 for _ in range(self.n + 1)]
        self.bids = 0
        if self.final:
            # the last layer: a node that may end costs nothing, the others insert what is missing
            self.price[self.n] = [0.0] * 4
            for state in range(4):
                self._auction(self.n, state, self.n + 1)
        else:
            self.price[self.n] = [float(x) for x in ends]
        for high in range(self.n, 0, -SPAN):
            low = max(0, high - SPAN)
            self._open(low, high)
            for state in states if low == 0 else range(4):
                if self.price[low][state] < FAR:
                    self._auction(low, state, high)

    def _arcs(self, i: int, state: int) -> list[tuple[str, int, int, int]]:
        return arcs(*self.rows[i])[state] if i < self.n else arcs("", -1)[state] if self.final else ()

    def _open(self, low: int, high: int) -> None:
        """Give the nodes of a span that can reach its end a price no distance is below."""
        base = min(self.price[high])
        for i in range(high - 1, low - 1, -1):
            open_ = [any(used and self.price[i + 1][to] < FAR for _, _, used, to in self._arcs(i, s)) for s in range(4)]
            for _ in range(2):  # two inserts lead everywhere that inserts lead
                open_ = [open_[s] or open_[ADDED[s]] for s in range(4)]
            self.price[i] = [base if x else FAR for x in open_]

    def _auction(self, i: int, state: int, stop: int) -> None:
        """Extend and contract a path from (i, state) until it reaches layer ``stop`` (beyond the last: an end state)."""
        price, path = self.price, [(i, state)]
        while True:
            i, state = path[-1]
            if i >= stop:
                return
            if stop > self.n and state in ENDS:
                return  # in the last layer, at the price 0
            self.bids += 1
            least, best = FAR, None
            for _, cost, used, to in self._arcs(i, state):
                bid = cost + price[i + used][to]
                if bid < least:
                    least, best = bid, (i + used, to)
            if price[i][state] < least:
                price[i][state] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(best)

    def _live(self) -> list[list[bool]]:
        """Nodes from which tight arcs lead to the end."""
        live = [[False] * 4 for _ in range(self.n + 1)]
        for i in range(self.n, -1, -1):
            for state in sorted(range(4), key=lambda s: self.price[i][s]):  # a tight insert leads to a lower price
                here = self.price[i][state]
                if here < FAR:
                    live[i][state] = (i == self.n and (not self.final or (state in ENDS and here == 0))) or any(
                        here == cost + self.price[i + used][to] and live[i + used][to] for _, cost, used, to in self._arcs(i, state))
        return live

    def trace(self, state: int) -> tuple[list[tuple[str, int, int]], int]:
        """The ASCII-least of the cheapest repairs from a state: edits (letter, cost, state they lead to), and the last state."""
        live, i, edits = self._live(), 0, []
        while not (i == self.n and (not self.final or state in ENDS)):
            letter, cost, used, to = next(a for a in self._arcs(i, state) if self.price[i][state] == a[1] + self.price[i + a[2]][a[3]] and live[i + a[2]][a[3]])
            edits.append((letter, cost, to))
            i, state = i + used, to
        return edits, state


def _blocks(emit: Callable[[list[tuple]], list[tuple]], key: int) -> Callable[[tuple | None], list[tuple]]:
    """A step that gathers the rows that agree in their first ``key`` fields and hands them to ``emit``."""
    held: list[tuple] = []

    def step(row: tuple | None) -> list[tuple]:
        out = []
        if held and (row is None or held[0][:key] != row[:key]):
            out = emit(held)
            held.clear()
        if row is not None:
            held.append(row)
        return out

    return step


def _in_blocks(rows: DataFrame, columns: list[str], emit: Callable[[list[tuple]], list[tuple]], schema: T.StructType) -> DataFrame:
    """Run ``emit`` over the rows of each (conv, block), in order; columns begin with conv and block."""
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in schema]
    dealt = rows.select(*columns, "pos").repartition("conv", "block").sortWithinPartitions("conv", "block", "pos").select(*columns)
    return dealt.mapInArrow(lambda batches: stream(fields, _blocks(emit, 2))(batches), schema)


def numbered(rows: DataFrame, conv: str, order: list[Column]) -> DataFrame:
    """Add conv (the conversation as a text that is never null), pos (from 0 within the conversation) and block.

    Rows go to ranges of (conversation, order), so neither a hot conversation nor a hot turn is sorted by one task; rows that
    agree in everything are parted by where they were read, and may swap places."""
    spark = rows.sparkSession
    name = F.when(F.col(conv).isNull(), "").otherwise(F.concat(F.lit("="), F.col(conv).cast("string")))
    keys = [f"__o{i}" for i in range(len(order))]
    marked = rows.select("*", name.alias("conv"), *[o.alias(k) for o, k in zip(order, keys, strict=True)], F.monotonically_increasing_id().alias("__at"))
    by = [F.col("conv"), *[F.col(k).asc_nulls_first() for k in keys], F.col("__at")]
    ranged = marked.repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by)
    table = shared_table(ranged.select(*rows.columns, "conv", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row")), "ordered")
    counts = {r["__part"]: (r["first"], r["count"]) for r in table.groupBy("__part").agg(F.min("__row").alias("first"), F.count("*").alias("count")).collect()}
    shift, total = {}, 0
    for part in sorted(counts):
        first, count = counts[part]
        shift[part], total = total - first, total + count
    most = max(counts, default=0) + 1
    at = F.col("__row") + F.get(F.lit([shift.get(i, 0) for i in range(most)]).cast("array<bigint>"), F.col("__part"))
    table = table.withColumn("__row", at)
    starts = table.groupBy("conv").agg(F.min("__row").alias("__start"))
    placed = table.join(starts, "conv").withColumn("pos", F.col("__row") - F.col("__start"))
    return placed.select(*rows.columns, "conv", "pos", F.floor(F.col("pos") / BLOCK).alias("block"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Add fault, the first that holds: 1 blank, 2 duplicate (role and text came earlier in the conversation), 3
    truncated (the last character that isn't a space is none of ``.!?``), 0 none; rows have conv, pos, role, text."""
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    marked = rows.withColumn("__same", same)
    again = marked.groupBy("conv", "__same").agg(F.min("pos").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    blank = ~F.col("text").rlike("[^ \\t-\\r]")
    fault = F.when(blank, 1).when(F.col("pos") > F.col("__first"), 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    return marked.join(again, ["conv", "__same"], "left").withColumn("fault", fault).drop("__same", "__first")


def _long_conversations(rows: DataFrame) -> DataFrame | None:
    """(conv, block, ends, entry) of every block of the conversations with several; None if there are none."""
    sizes = rows.groupBy("conv").agg(F.max("block").alias("last")).where("last > 0")
    sizes = shared_table(sizes, "long")
    if not sizes.limit(1).count():
        return None
    slim = shared_table(rows.select("conv", "block", "pos", F.substring("role", 1, 1).alias("initial"), "fault").join(sizes, "conv"), "slim")
    name, number, states = (T.StructField(n, t) for n, t in (("conv", T.StringType()), ("block", T.LongType()), ("cells", T.ArrayType(T.DoubleType()))))

    def matrix(held: list[tuple]) -> list[tuple]:
        conv, block, last = held[0][:3]
        codes = [r[3:5] for r in held]
        if block == last:
            return [(conv, block, Lattice(codes).price[0])]
        return [(conv, block, [x for end in range(4) for x in Lattice(codes, [0.0 if s == end else FAR for s in range(4)]).price[0]])]

    cells = shared_table(_in_blocks(slim, ["conv", "block", "last", "initial", "fault"], matrix, T.StructType([name, number, states])), "cells")

    def backward(frame: pd.DataFrame) -> pd.DataFrame:
        found = sorted(zip(frame["conv"], frame["block"], frame["cells"], strict=True), key=lambda r: -r[1])
        out, ends = [], None
        for conv, block, cells in found:
            out.append((conv, block, ends))
            ends = [float(x) for x in cells] if ends is None else [min(cells[4 * e + s] + ends[e] for e in range(4)) for s in range(4)]
        return pd.DataFrame(out, columns=["conv", "block", "ends"])

    ends = cells.groupBy("conv").applyInPandas(backward, "conv string, block long, ends array<double>")

    def leave(held: list[tuple]) -> list[tuple]:
        conv, block = held[0][:2]
        lattice = Lattice([r[3:5] for r in held], held[0][2])
        return [(conv, block, held[0][2], [lattice.trace(s)[1] if lattice.price[0][s] < FAR else s for s in range(4)])]

    ends = shared_table(ends, "ends")
    left = _in_blocks(slim.join(ends, ["conv", "block"]), ["conv", "block", "ends", "initial", "fault"], leave,
                      T.StructType([name, number, T.StructField("ends", T.ArrayType(T.DoubleType())), T.StructField("leave", T.ArrayType(T.IntegerType()))]))

    def forward(frame: pd.DataFrame) -> pd.DataFrame:
        out, state = [], 0
        for conv, block, ends, leave in sorted(zip(frame["conv"], frame["block"], frame["ends"], frame["leave"], strict=True), key=lambda r: r[1]):
            out.append((conv, block, ends, state))
            state = int(leave[state])
        return pd.DataFrame(out, columns=["conv", "block", "ends", "entry"])

    return shared_table(left.groupBy("conv").applyInPandas(forward, "conv string, block long, ends array<double>, entry int"), "entries")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", order: tuple[str, ...] = ()) -> DataFrame:
    """The cheapest edits of every conversation, a row per edit.

    Rows are read by turn (nulls first), then by the columns ``order``, then by a hash of role and text.  Returns the
    conversation, ``conv`` (the same as a text), block and step (which sort its edits), edit (K, R, D, I), cost,
    fault, and of the row that it edits (null for an insert) turn and was_role; role and text are those that the
    repaired conversation has there (null for a deletion).

    Null roles and texts count as one space; rows with a null conversation are one of their own; roles other
    than system, user and assistant go by their initial; repeated rows are duplicates; a conversation whose rows
    are all faulty ends empty; an empty table gives no rows; other columns are not read."""
    prepare(rows.sparkSession)
    kind, turns = rows.schema[conv].dataType, rows.schema[turn].dataType
    extra = [F.col(c).alias(f"order{i}") for i, c in enumerate(order)]
    slim = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), *extra)
    ties = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    placed = numbered(slim, "conv_id", [F.col("turn"), *[F.col(f"order{i}") for i in range(len(order))], ties])
    found = shared_table(with_faults(placed), "faults")
    plans = _long_conversations(found)
    if plans is None:
        found = found.withColumns({"ends": F.lit(None).cast("array<double>"), "entry": F.lit(0)})
    else:
        found = found.join(plans, ["conv", "block"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    columns = ["conv", "block", "ends", "entry", "conv_id", "turn", "role", "text", "fault"]

    def edits(held: list[tuple]) -> list[tuple]:
        conv, block, ends, entry, conv_id = held[0][:5]
        lattice = Lattice([(r[6][:1], r[8]) for r in held], ends, states=[entry])
        out, at = [], 0
        for step, (letter, cost, state) in enumerate(lattice.trace(entry)[0]):
            if letter == "I":
                out.append((conv_id, conv, block, step, letter, cost, None, None, None, ROLES[state], ""))
                continue
            _, _, _, _, _, turn, role, text, fault = held[at]
            at += 1
            now = (None, None) if letter == "D" else (ROLES[state] if letter == "R" else role, text)
            out.append((conv_id, conv, block, step, letter, cost, FAULTS[fault], turn, role, *now))
        return out

    string, number, long = T.StringType(), T.IntegerType(), T.LongType()
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("conv_id", kind), ("conv", string), ("block", long), ("step", number), ("edit", string), ("cost", number), ("fault", string),
        ("turn", turns), ("was_role", string), ("role", string), ("text", string))])
    return _in_blocks(found, columns, edits, schema)
