"""Conversation repair: generalised LR parsing of role sequences with weighted edits.

Rows become three facts each (role initial, must go, truncated); the parser reads only those, one conversation after the other as a
stream, and returns an edit per row. Texts meet their edits again in a join, so no conversation's texts are ever held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = r"[^\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
ROLES = {"u": "user", "a": "assistant"}

#: LR tables of the role grammar  Talk -> nothing | Body | s Body,  Body -> Pair | Body Pair,  Pair -> u a.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (5, "u"): 2, (7, "u"): 2}
#: States that reduce whatever comes next: length of the rule and its left side.
REDUCE = {3: (2, "Pair"), 4: (1, "Body"), 6: (2, "Body")}
GOTO = {(0, "Pair"): 4, (0, "Body"): 7, (1, "Pair"): 4, (1, "Body"): 5, (5, "Pair"): 6, (7, "Pair"): 6}
ACCEPT = {0, 5, 7}


class Node:
    """A stack node: its state and the node below; nodes are shared between stacks."""

    __slots__ = ("below", "state")

    def __init__(self, state: int, below: Node | None):
        self.state, self.below = state, below


class Reading:
    """A stack top with its cheapest reading. `rank` is the place of its edits up to the last row among all live readings in
    ASCII order, `step` the initials since; `edits` links back to all of them."""

    __slots__ = ("cost", "edits", "rank", "step", "top")

    def __init__(self, top: Node, cost: int, rank: int, step: str, edits: tuple | None):
        self.top, self.cost, self.rank, self.step, self.edits = top, cost, rank, step, edits

    def key(self) -> tuple[int, int, str]:
        return self.cost, self.rank, self.step


def shifted(top: Node, initial: str) -> Node | None:
    """The stack after an initial and all reductions due; None where the grammar has no place for it."""
    state = SHIFT.get((top.state, initial))
    if state is None:
        return None
    node = Node(state, top)
    while node.state in REDUCE:
        length, left = REDUCE[node.state]
        for _ in range(length):
            node = node.below
        node = Node(GOTO[node.state, left], node)
    return node


def _merge(front: dict[int, Reading], new: Reading) -> bool:
    """Equal stack tops become one, the reading of least (cost, audit). What may follow depends on the top state alone here: below a
    `u` any stack waits for its `a` and then for another pair or the end."""
    old = front.get(new.top.state)
    if old is None or new.key() < old.key():
        front[new.top.state] = new
        return True
    return False


def _inserted(front: dict[int, Reading]) -> dict[int, Reading]:
    """All readings that inserted turns reach."""
    out, open_ = dict(front), list(front.values())
    while open_:
        r = open_.pop()
        for initial in ROLES:
            top = shifted(r.top, initial)
            if top is not None:
                new = Reading(top, r.cost + INSERT, r.rank, r.step + "I", (r.edits, "I", initial))
                if _merge(out, new):
                    open_.append(new)
    return out


class Parser:
    """Reads the rows of one conversation; `result()` is the cost and the edits (initial, role initial or None)."""

    def __init__(self):
        self.front = {0: Reading(Node(0, None), 0, 0, "", None)}

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        after: dict[int, Reading] = {}
        for r in self.front.values():
            _merge(after, Reading(r.top, r.cost + DELETE, r.rank, r.step + "D", (r.edits, "D", None)))
        if not must_go:
            extra = TRUNCATED if truncated else 0
            for r in _inserted(self.front).values():
                for letter, to, cost in (("K", initial, KEEP), ("R", "u", REROLE), ("R", "a", REROLE)):
                    top = shifted(r.top, to)
                    if top is not None:
                        _merge(after, Reading(top, r.cost + cost + extra, r.rank, r.step + letter, (r.edits, letter, None if letter == "K" else to)))
        # audits of as many rows are never prefixes of each other here (each ends with a row's edit), so their order is kept by what follows
        for rank, r in enumerate(sorted(after.values(), key=lambda r: (r.rank, r.step))):
            r.rank, r.step = rank, ""
        self.front = after

    def result(self) -> tuple[int, list[tuple[str, str | None]]]:
        best = min((r for r in _inserted(self.front).values() if r.top.state in ACCEPT), key=Reading.key)
        edits, at = [], best.edits
        while at is not None:
            at, letter, to = at
            edits.append((letter, to))
        return best.cost, edits[::-1]


def _streamed(rows: DataFrame, order: str, start: Callable, schema: str) -> DataFrame:
    """Rows of each conv_id, in the order of a column, through an object of start(): row(*columns) for each row, then rows()
    of the result. Only one conversation's object is alive at a time."""
    names = [c for c in rows.columns if c not in ("conv_id", order)]
    out_names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, ready = None, None, []
        kinds: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*ready)) or [()] * len(out_names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=out_names)
            ready.clear()
            return batch

        for batch in batches:
            kinds = kinds or [batch.schema.field("conv_id").type] + [pa.int64() if "bigint" in c else pa.string() for c in schema.split(",")[1:]]
            for conv, *values in zip(*(batch.column(c).to_pylist() for c in ["conv_id", *names])):
                if held is None or conv != current:
                    if held is not None:
                        ready += [(current, *r) for r in held.rows()]
                        if len(ready) > 10_000:
                            yield flush()
                    current, held = conv, start()
                held.row(*values)
        if held is not None:
            ready += [(current, *r) for r in held.rows()]
            yield flush()

    sent = rows.repartition("conv_id").sortWithinPartitions("conv_id", order).select("conv_id", *names)
    return sent.mapInArrow(run, schema)


class _Edits(Parser):
    def rows(self) -> list[tuple]:
        out, no = [], 0
        for position, (letter, to) in enumerate(self.result()[1]):
            no += letter != "I"
            out.append((position, letter, ROLES.get(to), None if letter == "I" else no))
        return out


class _Sum:
    """Audit and hash of a repaired conversation, row by row."""

    def __init__(self):
        self.letters, self.hash, self.first = [], hashlib.sha256(), True

    def row(self, edit: str, role: str, text: str) -> None:
        self.letters.append(edit)
        if edit != "D":
            self.hash.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
            self.first = False

    def rows(self) -> list[tuple]:
        return [("".join(self.letters), self.hash.hexdigest())]


def checked(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text, ..) -> (conv_id, turn, role, text, no, fault, illegal): rows numbered by turn (nulls first), then
    role and text; nulls read as one space. fault is the first that holds: blank (no character but white space), duplicate (role
    and text seen earlier in the conversation), truncated (the last such character is none of .!?). illegal marks a row whose role
    initial may not follow the one before."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    inside = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    again = Window.partitionBy("conv_id", "role", "text").orderBy("no")
    initial = F.substring("role", 1, 1)
    numbered = rows.repartition("conv_id").withColumn("no", F.row_number().over(inside).cast("bigint")).withColumn(
        "pair", F.concat(F.lag(initial).over(inside), initial))
    fault = (F.when(~F.col("text").rlike(BLANK), "blank").when(F.row_number().over(again) > 1, "duplicate")
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated"))
    return numbered.withColumn("fault", fault).withColumn("illegal", F.coalesce(~F.col("pair").isin("su", "ua", "au"), F.lit(False))).drop("pair")


def repaired(rows: DataFrame) -> DataFrame:
    """Rows of checked() -> (conv_id, position, edit, role, text, cost): each conversation's rows and inserted turns in order, with the edits
    K(eep), R(erole), D(elete), I(nsert) of the cheapest repair whose kept rows read `(s?(ua)+)?` by role initials.

    Blank and duplicate rows are deleted. Of repairs of equal cost the one with the ASCII-least edits holds, whatever the
    partitioning. Deleted rows stay in the result, marked. Null conv_ids are one conversation. An empty table gives no rows.
    """
    facts = rows.select("conv_id", "no", F.substring("role", 1, 1).alias("initial"), F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("must_go"),
                        (F.coalesce("fault", F.lit("")) == "truncated").alias("truncated"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    edits = _streamed(facts, "no", _Edits, f"conv_id {kind}, position bigint, edit string, new_role string, no bigint").alias("e")
    own = rows.select("conv_id", "no", "role", "text", "fault").alias("r")
    met = edits.join(own, F.col("e.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("e.no") == F.col("r.no")), "left")
    price = (F.when(F.col("edit") == "K", KEEP).when(F.col("edit") == "R", REROLE).when(F.col("edit") == "D", DELETE).otherwise(INSERT)
             + F.when((F.col("fault") == "truncated") & (F.col("edit") != "D"), TRUNCATED).otherwise(0))
    return met.select("e.conv_id", "position", "edit", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), price.cast("bigint").alias("cost"))


def digest(turns: DataFrame, every: DataFrame) -> DataFrame:
    """Faults, cost, audit and hash per conversation of `every`(conv_id); conversations without rows have zeros."""
    rows = checked(turns)
    faults = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], F.count_if("illegal").alias("illegal")).alias("f")
    whole = repaired(rows)
    kind = turns.schema["conv_id"].dataType.simpleString()
    sums = _streamed(whole.select("conv_id", "position", "edit", "role", "text"), "position", _Sum, f"conv_id {kind}, audit string, repaired_sha256 string").alias("s")
    cost = whole.groupBy("conv_id").agg(F.sum("cost").alias("cost")).alias("c")
    same = lambda side: F.col("i.conv_id").eqNullSafe(F.col(f"{side}.conv_id"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return (every.select("conv_id").distinct().alias("i").join(faults, same("f"), "left").join(sums, same("s"), "left").join(cost, same("c"), "left").select(
        "i.conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")))


def damaged(turns: DataFrame, kinds: int = 20) -> DataFrame:
    """turns with seeded faults: by the crc32 of `conv_id:turn` modulo kinds a row is dropped (0), emptied (1), stripped of .!? (2),
    repeated (3) or given to the user (4). Nulls read as one space."""
    space = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    what: Column = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % kinds
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("what") == 0, 0).when(F.col("what") == 3, 2).otherwise(1)
    return rows.withColumn("what", what).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")
