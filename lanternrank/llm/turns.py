"""Conversation structure repair: the cheapest edits that give a conversation the turns ``(s?(ua)+)?``.

Rows of a conversation are taken by turn (nulls first, then role and text).
Each is blank, a duplicate (role and text seen earlier), truncated (no full
stop, exclamation or question mark at its end) or sound.  Edits: Keep costs 0,
Rerole 2, Delete 3 (the only one for blank rows and duplicates), Insert of an
empty user or assistant turn 2; a truncated row that stays costs 1 more.

A pass from the last row to the first keeps the cost to go from each grammar
state, four numbers, and writes down at each row the edits that are tight from
each state, ASCII-least first; a pass from the first row walks along them.  Both
read a conversation's rows as a stream in order, so a conversation of any length
is held by no task: besides a batch a pass has four numbers, or the state.  The
conversation is the unit of the exchange, since its repaired text is one
SHA-256, which takes its bytes one after the other.

Defined cases: null roles and texts are one space; a null conv_id is a
conversation of its own; rows of equal turn go by role and text, and equal rows
count each; a conversation without rows has no edits; an empty table gives no
rows.  Columns other than conv_id, turn, role and text are left out.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import common

SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Grammar states: nothing yet, after s, after u, after a; where a user or assistant turn leads, and what it is.
START, S, U, A = range(4)
NEXT, ROLE = (U, U, A, U), ("user", "user", "assistant", "user")
KINDS = {"s": 0, "u": 1, "a": 2}
FAULTS = ("blank", "duplicate", "truncated")


# ---- rows and their faults

def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of a conversation table after the faults that crc32(conv_id:turn) % 20 deals out."""
    fault = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn"))) % 20
    rows = rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), fault.alias("f")).where("f <> 0")
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("f") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("f") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and fault (0 none, 1 blank, 2 duplicate, 3 truncated); a conversation's rows stand in one partition."""
    rows = rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text")).repartition("conv_id")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    body = F.rtrim("text", F.lit(SPACE))
    fault = F.when(body == "", 1).when(earlier, 2).when(~F.right(body, F.lit(1)).isin(*ENDS), 3).otherwise(0)
    return rows.withColumn("fault", fault)


# ---- costs to go

@lru_cache(1 << 16)
def step(after: tuple[int, ...], kind: int, fault: int) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Costs to go from each state before a row, and the edits up to and with that row from each state and the state they lead to.

    after: costs to go behind the row, less the one of state A, so that few different ones occur; kind: the role's initial.
    """
    def edits(q: int) -> list[tuple[str, int, int]]:
        """Letter, cost with what follows, next state; in ASCII order, Insert left out."""
        out = [("D", DELETE + after[q], q)]
        if fault not in (1, 2):
            cut = CUT if fault == 3 else 0
            if kind < 3 and (to := ((S if q == START else None), (U if q != U else None), (A if q == U else None))[kind]) is not None:
                out.append(("K", KEEP + cut + after[to], to))
            out.append(("R", REROLE + cut + after[NEXT[q]], NEXT[q]))
        return out

    cost = [min(c for _, c, _ in edits(q)) for q in range(4)]
    for q in (U, A, U, S, START):  # inserts lead from U to A and back, and from the others to U
        cost[q] = min(cost[q], INSERT + cost[NEXT[q]])
    walks = []
    for q in range(4):
        letters = ""
        while True:
            tight = {letter: to for letter, c, to in edits(q) if c == cost[q]}
            if INSERT + cost[NEXT[q]] == cost[q]:
                tight["I"] = NEXT[q]
            letter = min(tight)
            letters, q = letters + letter, tight[letter]
            if letter != "I":
                break
        walks.append((letters, q))
    return tuple(cost), tuple(walks)


#: Costs to go behind the last row: what is open is closed by inserts.
END, CLOSING = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")


def planned(rows: DataFrame) -> DataFrame:
    """Rows of `faults` with the edits from each state (`letters` and next state, comma-joined) and whether a conversation ends; last rows first."""
    schema = StructType(rows.schema.fields + StructType().add("plan", "string").add("last", "boolean").fields)
    by = [*(F.col(c).desc_nulls_last() for c in ("conv_id", "turn", "role", "text")), (F.col("fault") == 2).desc()]  # of equal rows the first is no duplicate

    def run(batches):
        conv, after = run, END  # no id equals a function
        names: dict = {}
        for b in batches:
            plans, last = [], []
            for c, role, fault in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("fault").to_pylist()):
                last.append(c != conv)
                if c != conv:
                    conv, after = c, END
                after, walks = step(after, KINDS.get(role[:1], 3), fault)
                after = tuple(x - after[A] for x in after)
                plan = names.get(walks)
                if plan is None:
                    plan = names[walks] = ",".join(f"{letters}{to}" for letters, to in walks)
                plans.append(plan)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(plans, pa.string()), pa.array(last, pa.bool_())], names=schema.names)

    return rows.sortWithinPartitions(*by).mapInArrow(run, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The edits of every conversation in their order: conv_id, step, edit (D, I, K, R), turn, was (role before), role, text and fault.

    Deleted rows have no role and text, inserted ones neither turn nor fault.  A
    conversation's rows stay in one partition and in order.
    """
    kind = rows.schema
    fields = [kind["conv_id"], *StructType().add("step", "long").add("edit", "string").fields, kind["turn"], *StructType().add("was", "string").add("role", "string").add("text", "string").add("fault", "integer").fields]
    schema = StructType(fields)
    by = [*(F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")), (F.col("fault") == 2).asc()]

    def run(batches):
        conv, n, q = run, 0, START
        for b in batches:
            at, edits, roles, places = [], [], [], []  # row of the batch (none: inserted), letter, new role, number of the edit
            ids, was, plans, last = (b.column(c).to_pylist() for c in ("conv_id", "role", "plan", "last"))
            owner = []
            for i in range(b.num_rows):
                if ids[i] != conv:
                    conv, n, q = ids[i], 0, START
                plan = plans[i].split(",")[q]
                for letter in plan[:-1]:
                    at.append(None if letter == "I" else i)
                    edits.append(letter)
                    roles.append(None if letter == "D" else was[i] if letter == "K" else ROLE[q])
                    if letter == "I":
                        q = NEXT[q]
                    owner.append(i)
                    places.append(n)
                    n += 1
                q = int(plan[-1])
                if last[i]:
                    for letter in CLOSING[q]:
                        at.append(None)
                        edits.append(letter)
                        roles.append(ROLE[q])
                        q = NEXT[q]
                        owner.append(i)
                        places.append(n)
                        n += 1
            take = pa.array(at, pa.int32())
            text = pa.array([None if e == "D" or a is None else a for a, e in zip(at, edits)], pa.int32())
            texts = b.column("text").take(text)
            texts = pa.compute.if_else(pa.array([e == "I" for e in edits], pa.bool_()), pa.scalar("", texts.type), texts)
            columns = [b.column("conv_id").take(pa.array(owner, pa.int32())), pa.array(places, pa.int64()), pa.array(edits, pa.string()), b.column("turn").take(take), b.column("role").take(take), pa.array(roles, pa.string()), texts, b.column("fault").take(take)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return planned(faults(rows)).sortWithinPartitions(*by).mapInArrow(run, schema)


def report(edits: DataFrame) -> DataFrame:
    """A row a conversation of `repaired`, whose order is kept: faults, gaps in its turns, illegal neighbours, cost, edits' initials and digest."""
    counted = ("gaps", *FAULTS, "illegal", "cost")
    schema = StructType([edits.schema["conv_id"]])
    for name in counted:
        schema = schema.add(name, "long")
    schema = schema.add("audit", "string").add("repaired_sha256", "string")
    arrow = to_arrow_schema(schema)
    price = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}

    class State:
        def __init__(self, conv):
            self.conv, self.audit, self.hash, self.any = conv, [], hashlib.sha256(), False
            self.n, self.cost, self.illegal = [0, 0, 0, 0], 0, 0
            self.before = self.first = self.turn = None
            self.turns = 0

        def row(self):
            gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
            return (self.conv, gaps, *self.n[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())

    def run(batches):
        state = None
        for b in batches:
            out = []
            for c, edit, turn, was, role, text, fault in zip(*(b.column(x).to_pylist() for x in ("conv_id", "edit", "turn", "was", "role")), common.utf8(b.column("text")), b.column("fault").to_pylist()):
                if state is None or c != state.conv:
                    if state:
                        out.append(state.row())
                    state = State(c)
                state.audit.append(edit)
                state.cost += price[edit] + (CUT if fault == 3 and edit != "D" else 0)
                if edit != "I":
                    state.n[fault] += 1
                    if state.before is not None:
                        state.illegal += state.before + was[:1] not in ("su", "ua", "au")
                    state.before = was[:1]
                    if turn is not None and turn != state.turn:
                        state.first = turn if state.first is None else state.first
                        state.turn, state.turns = turn, state.turns + 1
                if edit != "D":
                    state.hash.update(b"\n" * state.any + role.encode() + b":" + text)
                    state.any = True
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=arrow)
        if state:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, state.row()))], schema=arrow)

    return edits.mapInArrow(run, schema)


def judged(conversations: DataFrame) -> DataFrame:
    """A row for every conversation of the table, after its rows were damaged: `report`, with zeros and an empty audit where no row is left."""
    found = report(repaired(damaged(conversations)))
    every = conversations.select(F.col("conv_id").alias("every_id")).distinct()
    joined = every.join(found, F.col("every_id").eqNullSafe(F.col("conv_id")), "left")
    filled = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", *FAULTS, "illegal", "cost")}
    filled |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}
    return joined.withColumns(filled).select(F.col("every_id").alias("conv_id"), "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256")
