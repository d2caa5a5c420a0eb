"""Conversation structure repair: cheapest edits by a checkpointed dynamic programme.

A repaired conversation has the role initials ``(s?(ua)+)?``. Keep costs 0, Rerole to
user or assistant 2, Delete 3 (the only choice for blank and duplicate rows), Insert of an
empty user or assistant turn 2; a truncated row that stays adds 1. Of the cheapest edits
the result is the sequence whose initials (the audit) are least in ASCII order.

The state is what was said last (nothing, system, user, assistant). Backward vectors of
the cost to finish from each state are stored only at checkpoints, one in about the square
root of the rows; walking forward, the vectors of a block are computed again from the
checkpoint behind it, and the least tight edit is taken at each step. Rows become one byte
for this; texts take no part.

Rows are range partitioned by conversation and order, so a conversation of any length is
spread over tasks. Where one does not end in its task, the ends of its chunks are
checkpoints too: a chunk's costs from state to state give the vectors at its ends, those
give the walk from each state, and the walks chain up from the start. These steps move a
few numbers for each chunk of ``CHUNK`` rows.

A row's faults: blank (no character but ASCII white space), duplicate (role and text as in
an earlier row of the conversation), truncated (last such character not one of ``.!?``);
the first one counts. Rows alike in everything are one run with a count, so a hot repeated
row is combined before it is shuffled.

Defined results: null roles and texts count as one space (the role then fits nowhere);
rows go by turn, null turns first, then role, then SHA-256 of the text, so repeated rows
are adjacent; rows without a conversation id are one conversation; ``gaps`` ignores null
turns and is null where it exceeds a long; a conversation with no rows gets zeros, an
empty audit and the hash of an empty string. For the hash and the repaired turns the texts
of a conversation pass through one task in their order, as SHA-256 has to take them; they
are sorted on disk and never held together, so length costs that task time, not memory. Other columns, whatever their names, take no part. Empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
import math
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gapline.llm.tables import partitions
from gapline.runtime import cut_lineage

START, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)  # state after the turn that is due in each state
SAID = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
KEEPS = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
LEGAL = {"su", "ua", "au"}
WHOLE, TRUNCATED, GONE = range(3)  # code of a row: 3 * initial + one of these
DELETE, CHANGE = 3, 2
CHUNK = 1 << 15
OUT_ROWS = 10_000
SPACES = " \t\n\x0b\x0c\r"

Vector = tuple[float, float, float, float]


def with_inserts(cost: list) -> Vector:
    two, three = min(cost[USER], CHANGE + cost[ASSISTANT]), min(cost[ASSISTANT], CHANGE + cost[USER])
    return min(cost[START], CHANGE + two), min(cost[SYSTEM], CHANGE + two), two, three


END: Vector = with_inserts([0, math.inf, math.inf, 0])


def one_back(code: int, after: Vector) -> Vector:
    """Costs before a row from the costs after it."""
    initial, fault = divmod(code, 3)
    cost = []
    for state in range(4):
        best = DELETE + after[state]
        if fault != GONE:
            best = min(best, CHANGE + fault + after[DUE[state]])
            if (state, initial) in KEEPS:
                best = min(best, fault + after[KEEPS[state, initial]])
        cost.append(best)
    return with_inserts(cost)


class Programme:
    """The dynamic programme over codes; steps from vectors that differ by a constant are computed once."""

    def __init__(self):
        self.known: dict = {}

    def back(self, code: int, after: Vector) -> Vector:
        base = min(after)
        key = (code, *(x - base for x in after))
        if key not in self.known:
            if len(self.known) > 1 << 16:
                self.known.clear()
            self.known[key] = one_back(code, key[1:])
        return tuple(x + base for x in self.known[key])

    def start(self, codes: bytes, after: Vector) -> Vector:
        for code in reversed(codes):
            after = self.back(code, after)
        return after

    def walk(self, codes: bytes, after: Vector, state: int) -> tuple[list[str], int]:
        """The edits of each row, with inserts before it, and the state after the last."""
        size = math.isqrt(len(codes)) + 1
        marks = [after]  # at the ends of the blocks, the last block first
        firsts = range(0, len(codes), size)
        for first in reversed(firsts[1:]):
            marks.append(self.start(codes[first : first + size], marks[-1]))
        edits = []
        for first in firsts:
            block = codes[first : first + size]
            vectors = list(accumulate(reversed(block), lambda v, code: self.back(code, v), initial=marks.pop()))[::-1]
            for code, here, then in zip(block, vectors, vectors[1:]):
                initial, fault = divmod(code, 3)
                done = ""
                while True:
                    cost = here[state]
                    if DELETE + then[state] == cost:
                        done += "D"
                    elif CHANGE + here[DUE[state]] == cost:
                        done, state = done + "I", DUE[state]
                        continue
                    elif fault + then[KEEPS.get((state, initial), state)] == cost and (state, initial) in KEEPS:
                        done, state = done + "K", KEEPS[state, initial]
                    else:
                        done, state = done + "R", DUE[state]
                    break
                edits.append(done)
        return edits, state


def last_inserts(state: int) -> str:
    """Inserts after the last row."""
    out = ""
    while state not in (START, ASSISTANT):
        out, state = out + "I", DUE[state]
    return out


def _coded(rows: DataFrame) -> DataFrame:
    """Runs of equal rows: key, turn, role, digest, copies, code, and how many have which fault."""
    stripped = F.rtrim("text", F.lit(SPACES))
    last = F.right(stripped, F.lit(1))
    lean = rows.select(
        "key", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (stripped == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut")
    )
    runs = lean.groupBy("key", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    runs = cut_lineage(runs)
    at = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    several = runs.groupBy("key", "role", "digest").agg(F.min(at).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    named = runs.join(several, ["key", "role", "digest"], "left").withColumn("seen", F.coalesce(at > F.col("earliest"), F.lit(False)))
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("blank") | F.col("seen"), GONE).when(F.col("cut"), TRUNCATED).otherwise(WHOLE)
    none = F.lit(0).cast("long")
    return named.select(
        "key",
        "turn",
        "role",
        "digest",
        "copies",
        (place * 3 + fault).alias("code"),
        F.when(F.col("blank"), F.col("copies")).otherwise(none).alias("blank"),
        F.when(F.col("blank"), none).when(F.col("seen"), F.col("copies")).otherwise(F.col("copies") - 1).alias("duplicate"),
        F.when(F.col("blank") | F.col("seen") | ~F.col("cut"), none).otherwise(F.lit(1)).alias("truncated"),
    )


RUN = ["key", "turn", "role", "digest", "copies", "code", "blank", "duplicate", "truncated"]
RUN_TYPES = "key string, turn long, role string, digest binary, copies long, code int, blank long, duplicate long, truncated long"


def _walked(chunk: int):
    """Rows in order; conversations that begin and end in the task get their edits, others their chunk."""

    def run(stream):
        programme, part = Programme(), TaskContext.get().partitionId()
        out = {c: [] for c in [*RUN, "part", "chunk", "at", "edits"]}
        held = {c: [] for c in RUN}
        inside, number = False, 0  # whether the conversation began in this task; chunks so far

        def close(ends: bool) -> None:
            nonlocal number
            n = len(held["key"])
            if inside and ends and not number:
                edits, state = programme.walk(bytes(held["code"]), END, START)
                edits = [e + "D" * (c - 1) for e, c in zip(edits, held["copies"])]
                edits[-1] += last_inserts(state)
            else:
                edits = [None] * n
            for c in RUN:
                out[c].extend(held[c])
                held[c] = []
            out["part"].extend([part] * n)
            out["chunk"].extend([number] * n)
            out["at"].extend(range(n))
            out["edits"].extend(edits)
            number = 0 if ends else number + 1

        def taken():
            batch = pa.RecordBatch.from_pydict({c: pa.array(v, SCHEMA.field(c).type) for c, v in out.items()}, schema=SCHEMA)
            for c in out:
                out[c] = []
            return batch

        key = None
        for batch in stream:
            rows = batch.to_pydict()
            keys, first = rows["key"], 0
            while first < len(keys):
                if keys[first] != key:
                    if key is not None:
                        if held["key"]:
                            close(True)
                        inside = True
                    key, number = keys[first], 0
                to = first
                room = first + chunk - len(held["key"])
                while to < len(keys) and to < room and keys[to] == key:
                    to += 1
                for c in RUN:
                    held[c].extend(rows[c][first:to])
                first = to
                if len(held["key"]) >= chunk:
                    close(False)
                if len(out["key"]) >= OUT_ROWS:
                    yield taken()
        if held["key"]:
            close(False)
        if out["key"]:
            yield taken()

    return run


SCHEMA = pa.schema(
    [("key", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("copies", pa.int64()), ("code", pa.int32())]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "part", "chunk", "at")]
    + [("edits", pa.string())]
)


def _codes(items) -> bytes:
    return bytes(items.values.field("code").to_pylist())


def _costs(stream):
    """Costs of each chunk from every state before it to every state after it."""
    programme = Programme()
    for batch in stream:
        tables = []
        for items in batch.column("items"):
            codes = _codes(items)
            ends = [tuple(0.0 if s == t else math.inf for s in range(4)) for t in range(4)]
            tables.append([x for end in ends for x in programme.start(codes, end)])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "part", "chunk")), pa.array(tables, pa.list_(pa.float64()))], ["key", "part", "chunk", "costs"])


def _behind(table):
    """The costs to finish after each chunk of a conversation, from the last to the first."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["chunk"]), reverse=True)
    after, out = END, []
    for i, row in enumerate(rows):
        out.append({"key": row["key"], "part": row["part"], "chunk": row["chunk"], "after": list(after), "ends": i == 0})
        costs = row["costs"]
        after = with_inserts([min(costs[4 * t + s] + after[t] for t in range(4)) for s in range(4)])
    return pa.Table.from_pylist(out, pa.schema([("key", pa.string()), ("part", pa.int64()), ("chunk", pa.int64()), ("after", pa.list_(pa.float64())), ("ends", pa.bool_())]))


def _walks(stream):
    """Edits and last state of each chunk, from every state before it."""
    programme = Programme()
    kind = pa.list_(pa.struct([("state", pa.int32()), ("edits", pa.list_(pa.string()))]))
    for batch in stream:
        found = []
        for items, after, ends in zip(batch.column("items"), batch.column("after").to_pylist(), batch.column("ends").to_pylist()):
            codes, copies, walks = _codes(items), items.values.field("copies").to_pylist(), []
            for state in range(4):
                edits, last = programme.walk(codes, tuple(after), state) if after[state] < math.inf else ([""] * len(codes), state)
                edits = [e + "D" * (c - 1) for e, c in zip(edits, copies)]
                if ends:
                    edits[-1] += last_inserts(last)
                walks.append({"state": last, "edits": edits})
            found.append(walks)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "part", "chunk")), pa.array(found, kind)], ["key", "part", "chunk", "walks"])


def _starts(table):
    """The state before each chunk of a conversation."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["chunk"]))
    state, out = START, []
    for row in rows:
        out.append({"key": row["key"], "part": row["part"], "chunk": row["chunk"], "state": state})
        state = row["states"][state]
    return pa.Table.from_pylist(out, pa.schema([("key", pa.string()), ("part", pa.int64()), ("chunk", pa.int64()), ("state", pa.int32())]))


def _edited(runs: DataFrame, chunk: int) -> DataFrame:
    """Runs with their edits: initials of what is inserted before a row, its own, and those of its copies."""
    keys = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ordered = runs.select(*RUN).repartitionByRange(partitions(runs.sparkSession), *keys).sortWithinPartitions(*keys)
    walked = cut_lineage(ordered.mapInArrow(_walked(chunk), f"{RUN_TYPES}, part long, chunk long, at long, edits string"))
    done = walked.where(F.col("edits").isNotNull()).select(*RUN, "edits")
    open_ = walked.where(F.col("edits").isNull())
    where = ["key", "part", "chunk"]
    chunks = cut_lineage(open_.groupBy(*where).agg(F.array_sort(F.collect_list(F.struct("at", "code", "copies"))).alias("items")))
    costs = chunks.mapInArrow(_costs, "key string, part long, chunk long, costs array<double>")
    behind = costs.groupBy("key").applyInArrow(_behind, "key string, part long, chunk long, after array<double>, ends boolean")
    walks = chunks.join(behind, where).mapInArrow(_walks, "key string, part long, chunk long, walks array<struct<state:int,edits:array<string>>>")
    walks = cut_lineage(walks)
    states = walks.select(*where, F.col("walks.state").alias("states"))
    starts = states.groupBy("key").applyInArrow(_starts, "key string, part long, chunk long, state int")
    chosen = walks.join(starts, where).select(*where, F.posexplode(F.get("walks", F.col("state"))["edits"]).alias("at", "edits"))
    late = open_.drop("edits").join(chosen, [*where, "at"]).select(*RUN, "edits")
    return done.unionByName(late)


class Conversation:
    """What is known of a conversation as its runs and texts pass by in order.

    ``say`` gets the conversation, role and text of each repaired turn.
    """

    def __init__(self, conv, say):
        self.conv, self.say, self.state, self.waits = conv, say, START, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.turns, self.first, self.last, self.before = 0, None, None, None
        self.audit, self.hash, self.said = [], hashlib.sha256(), 0

    def run(self, row: dict) -> None:
        edits, initial, turn = row["edits"], row["role"][:1], row["turn"]
        self.blank += row["blank"]
        self.duplicate += row["duplicate"]
        self.truncated += row["truncated"]
        self.illegal += row["copies"] - 1 + (self.before is not None and self.before + initial not in LEGAL)
        self.before = initial
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        self.audit.append(edits)
        self.cost += CHANGE * (edits.count("I") + edits.count("R")) + DELETE * edits.count("D")
        rest = edits.lstrip("I")
        self.insert(len(edits) - len(rest))
        if rest[0] == "D":
            self.insert(rest.count("I"))
        else:
            self.cost += row["truncated"]
            self.waits = (rest[0] == "K", row["role"], row["code"] // 3, rest.count("I"))

    def insert(self, times: int) -> None:
        for _ in range(times):
            self.state = DUE[self.state]
            self.tell(SAID[self.state], "")

    def text(self, text: str) -> None:
        """The text of the run that waits for it; texts of copies bring nothing new."""
        if self.waits:
            kept, role, initial, inserts = self.waits
            self.waits = None
            self.state = KEEPS[self.state, initial] if kept else DUE[self.state]
            self.tell(role if kept else SAID[self.state], text)
            self.insert(inserts)

    def tell(self, role: str, text: str) -> None:
        self.say(self, role, text)
        self.said += 1

    def gaps(self) -> int | None:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps if gaps < 1 << 63 else None


def _passing(stream, say):
    """With each batch, the conversations that have passed."""
    now = None
    for batch in stream:
        passed = []
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if now is not None:
                    passed.append(now)
                now = Conversation(row["conv"], say)
            elif row["kind"] == 1:
                now.run(row)
            else:
                now.text(row["text"])
        yield passed
    if now is not None:
        yield [now]


def _batch(rows: list, types: list) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types)], [n for n, _ in types])


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _audits(kind: pa.DataType):
    types = [("conv", kind), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]

    def say(c, role, text):
        c.hash.update(f"{chr(10) if c.said else ''}{role}:{text}".encode("utf-8", "surrogatepass"))

    def run(stream):
        for passed in _passing(stream, say):
            rows = [(c.conv, c.gaps(), c.blank, c.duplicate, c.truncated, c.illegal, c.cost, "".join(c.audit), c.hash.hexdigest()) for c in passed]
            yield _batch(rows, types)

    return run


def _turns(kind: pa.DataType):
    types = [("conv", kind), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]

    def run(stream):
        rows: list = []
        for _ in _passing(stream, lambda c, role, text: rows.append((c.conv, c.said, role, text))):
            yield _batch(rows, types)
            rows.clear()

    return run


def _in_order(rows: DataFrame, all_ids: DataFrame | None, conv: str, turn: str, role: str, text: str, chunk: int) -> DataFrame:
    """Conversations in order: what they are (kind 0), then each run with its edits (1) and its texts (2)."""

    def key(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n"))

    space = F.lit(" ")
    plain = rows.select(
        F.col(conv).alias("conv"), key(conv).alias("key"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text")
    )
    edited = cut_lineage(_edited(_coded(plain), chunk))
    names = plain.select("conv", "key") if all_ids is None else plain.select("conv", "key").unionByName(all_ids.select(F.col(conv).alias("conv"), key(conv).alias("key")))
    heads = names.distinct().withColumn("kind", F.lit(0))
    texts = plain.select("key", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text").withColumn("kind", F.lit(2))
    united = heads.unionByName(edited.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    order = ["key", F.col("kind") > 0, F.col("turn").asc_nulls_first(), "role", "digest", "kind"]
    return united.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions(*order)


def audits(rows: DataFrame, all_ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The hash is that of the repaired turns, ``role:text`` joined by newlines, and takes
    each as it passes. ``all_ids`` names conversations that may have no rows.
    """
    ordered = _in_order(rows, all_ids, conv, turn, role, text, chunk)
    kind = rows.schema[conv].dataType
    out = ", ".join(f"{c} long" for c in COUNTS)
    found = ordered.mapInArrow(_audits(to_arrow_type(kind)), f"conv {kind.simpleString()}, {out}, audit string, repaired_sha256 string")
    return found.withColumnRenamed("conv", conv)


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The repaired turns: the conversation's id, place (from 0), role, text."""
    ordered = _in_order(rows, None, conv, turn, role, text, chunk)
    kind = rows.schema[conv].dataType
    found = ordered.mapInArrow(_turns(to_arrow_type(kind)), f"conv {kind.simpleString()}, place long, role string, text string")
    return found.withColumnRenamed("conv", conv)
