"""Operator 12: conversations brought into legal order by the cheapest edits, with a lazily determinised automaton."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, stored

#: States: nothing said yet, then the initial of the last turn.
STATES = ("", "s", "u", "a")
#: The state after a turn of the side whose turn it is, and that side's role; the start admits a system turn too.
NEXT, SIDE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NONE = 1 << 30
#: A letter is 2 * (place of the initial in INITIALS) + truncated; GONE is a turn that must go, whatever its initial.
INITIALS = ("s", "u", "a", "")
GONE = -1
#: Turns of a block at most, and the bytes of text after which it is cut.
BLOCK, BLOCK_BYTES = 256, 4 << 20


def kept(state: int, initial: str) -> int | None:
    """The state after a turn that stays as it is; None if it can't."""
    after = 1 if state == 0 and initial == "s" else NEXT[state]
    return after if STATES[after] == initial else None


def closed(costs: list[int]) -> list[int]:
    """The least costs when turns may be inserted first."""
    for _ in STATES:
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return [min(c, NONE) for c in costs]


#: The cost of what is still to do when all turns are read: a conversation may end before it began or after an assistant.
END = closed([0, NONE, NONE, 0])


class Automaton:
    """Vectors of the costs still to come, a state's each, less their least: the states of a deterministic automaton.

    It reads turns from the last to the first.  States and transitions are made when first met and kept in a table, so
    that a scan is a lookup a turn.  There are few: costs of two states differ by two insertions at most.
    """

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.names: dict[tuple[int, ...], int] = {}
        self.table: list[list[tuple[int, int] | None]] = []
        self.arcs: dict[tuple[int, int, int], tuple[str, int]] = {}

    def state(self, vector) -> tuple[int, int]:
        """The automaton's state for a vector, and what was taken off."""
        least = min(vector)
        normal = tuple(c if c >= NONE else c - least for c in vector)
        if normal not in self.names:
            self.names[normal] = len(self.vectors)
            self.vectors.append(normal)
            self.table.append([None] * (2 * len(INITIALS)))
        return self.names[normal], least

    def before(self, at: int, letter: int) -> tuple[int, int]:
        """The state before a turn, if ``at`` is the one after it, and the cost it takes."""
        step = self.table[at][letter]
        if step is None:
            after, initial, extra = self.vectors[at], INITIALS[letter // 2], TRUNCATED * (letter % 2)
            costs = []
            for q in range(len(STATES)):
                keep = kept(q, initial) if initial else None
                ways = [DELETE + after[q], RELABEL + extra + after[NEXT[q]]] + ([extra + after[keep]] if keep is not None else [])
                costs.append(min(ways))
            step = self.table[at][letter] = self.state(closed(costs))
        return step

    def scan(self, letters: list[int], at: int) -> tuple[list[int], int]:
        """The states after each turn, with that before the first in front, and the cost taken off along the way."""
        states, cost = [at], 0
        for letter in reversed(letters):
            at, off = self.before(at, letter)
            states.append(at)
            cost += off
        return states[::-1], cost

    def tight(self, after: int, letter: int, q: int) -> tuple[str, int]:
        """The least edits of a turn that lie on a cheapest way from ``q``, insertions before it included, and the state then."""
        known = self.arcs.get((after, letter, q))
        if known is None:
            at, off = self.before(after, letter)
            here, there = [c + off for c in self.vectors[at]], self.vectors[after]
            initial, extra = INITIALS[letter // 2], TRUNCATED * (letter % 2)
            edits, state = "", q
            while True:
                keep = kept(state, initial) if initial else None
                if DELETE + there[state] == here[state]:
                    known = edits + "D", state
                elif INSERT + here[NEXT[state]] == here[state]:
                    edits, state = edits + "I", NEXT[state]
                    continue
                elif keep is not None and extra + there[keep] == here[state]:
                    known = edits + "K", keep
                else:
                    known = edits + "R", NEXT[state]
                break
            self.arcs[after, letter, q] = known
        return known

    def trace(self, letters: list[int], at: int, q: int) -> tuple[list[str], int]:
        """The edits of each turn on the cheapest way from ``q``, of equal ones the ASCII-least, and the state at the end."""
        out, after = [], self.scan(letters, at)[0][1:]
        for letter, a in zip(letters, after):
            edits, q = self.tight(a, letter, q)
            out.append(edits)
        return out, q


AUTOMATON = Automaton()


def matrix(letters: list[int]) -> list[int]:
    """The least cost from each state before the turns to each after them, flat at 4 * start + end."""
    out = [[0] * len(STATES) for _ in STATES]
    for end in range(len(STATES)):
        at, off = AUTOMATON.state(closed([0 if q == end else NONE for q in range(len(STATES))]))
        states, cost = AUTOMATON.scan(letters, at)
        for q, c in enumerate(AUTOMATON.vectors[states[0]]):
            out[q][end] = NONE if c >= NONE else c + cost + off
    return [c for row in out for c in row]


def live(letters: list[int]) -> list[int]:
    return [x for x in letters if x != GONE]


def closing(q: int) -> str:
    """The insertions that end a conversation."""
    return "I" * (END[q] // INSERT)


def faulted(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, mark, text, letter, blank, m): different turns with their number, their letter and whether they are blank.

    Equal turns of one number are one row here; the first of them that no earlier turn equals may stay, the others go.
    Both counts are aggregated before they meet, so that a turn that is repeated a million times is a row.
    """
    ends = F.rtrim("text", F.lit(BLANKS))
    marked = turns.withColumn("mark", F.md5("text")).withColumn("end", F.right(ends, F.lit(1)))
    runs = marked.groupBy("conv", "turn", "role", "mark").agg(F.count("*").alias("m"), F.any_value("text").alias("text"), F.any_value("end").alias("end"))
    first = marked.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("mark").alias("k")).agg(F.min(F.struct("turn")).alias("first"))
    met = runs.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("k")))
    initial = "coalesce(array_position(array('s', 'u', 'a'), left(role, 1)) - 1, 3)"
    initial = f"if({initial} < 0, 3, {initial})"
    return met.select(
        "conv", "turn", "role", "mark", "text", "m", F.expr("end = ''").alias("blank"),
        F.expr(f"cast(if(end = '' or not (first.turn <=> turn), {GONE}, 2 * {initial} + if(end in ('.', '!', '?'), 0, 1)) as int)").alias("letter"),
    )


def blocks(rows: DataFrame) -> DataFrame:
    """(conv, block, turns, matrix): the turns in order, in blocks that ascend along a conversation."""
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "mark"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text", "m", "blank", "letter")
    turn = T.StructType([f for f in dealt.schema if f.name != "conv"])
    schema = T.StructType([rows.schema["conv"], *T._parse_datatype_string("block long"), T.StructField("turns", T.ArrayType(turn)), *T._parse_datatype_string("matrix array<int>")])

    def run(batches):
        name = TaskContext.get().partitionId() << 40
        held, size, conv, out = [], 0, None, None

        def done():
            nonlocal name, held, size
            name += 1
            letters = live([t["letter"] for t in held])
            made = ([conv], [name], [held], [matrix(letters)])
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, types)], names=["conv", "block", "turns", "matrix"])

        types = None
        for batch in batches:
            types = types or [
                batch.schema.field("conv").type, pa.int64(), pa.list_(pa.struct([batch.schema.field(f.name) for f in turn])), pa.list_(pa.int32()),
            ]
            for row in batch.to_pylist():
                this = row.pop("conv")
                if held and (this != conv or len(held) == BLOCK or size >= BLOCK_BYTES):
                    yield done()
                conv = this
                held.append(row)
                size += len(row["text"])
        if held:
            yield done()

    return dealt.mapInArrow(run, schema)


def after_blocks(cut: DataFrame) -> DataFrame:
    """(block, ends, last): the costs still to come after each block, from a conversation's last block to its first."""

    def run(batches):
        conv, ends, begun = None, END, False
        for batch in batches:
            names, convs = batch.column("block").to_pylist(), batch.column("conv").to_pylist()
            out, lasts = [], []
            for c, m in zip(convs, batch.column("matrix").to_pylist()):
                last = not begun or c != conv
                if last:
                    conv, ends, begun = c, END, True
                out.append(list(ends))
                lasts.append(last)
                ends = [min(m[4 * q + e] + ends[e] for e in range(4)) for q in range(4)]
                ends = [min(c - min(ends), NONE) for c in ends]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.list_(pa.int32())), pa.array(lasts)], names=["block", "ends", "last"])

    dealt = cut.select("conv", "block", "matrix").repartition("conv").sortWithinPartitions("conv", F.col("block").desc())
    return dealt.mapInArrow(run, "block long, ends array<int>, last boolean")


def before_blocks(cut: DataFrame, after: DataFrame) -> DataFrame:
    """(block, q): the state in which each block begins, from a conversation's first block to its last."""

    def traced(batches):
        for batch in batches:
            got = []
            for letters, ends in zip(batch.column("letters").to_pylist(), batch.column("ends").to_pylist()):
                at, letters = AUTOMATON.state(ends)[0], live(letters)
                got.append([AUTOMATON.trace(letters, at, q)[1] for q in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(got, pa.list_(pa.int32()))], names=["conv", "block", "out"])

    def chained(batches):
        conv, q, begun = None, 0, False
        for batch in batches:
            states = []
            for c, out in zip(batch.column("conv").to_pylist(), batch.column("out").to_pylist()):
                if not begun or c != conv:
                    conv, q, begun = c, 0, True
                states.append(q)
                q = out[q]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(states, pa.int32())], names=["block", "q"])

    schema = T.StructType([cut.schema["conv"], *T._parse_datatype_string("block long, out array<int>")])
    ways = cut.select("conv", "block", F.col("turns.letter").alias("letters")).join(after.select("block", "ends"), "block").select("conv", "block", "letters", "ends")
    return ways.mapInArrow(traced, schema).repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(chained, "block long, q int")


def mended(block: dict) -> tuple[str, list[dict], int]:
    """A block's edits in order, the turns that they leave, and what they cost."""
    turns, q = block["turns"], block["q"]
    edits, end = AUTOMATON.trace(live([t["letter"] for t in turns]), AUTOMATON.state(block["ends"])[0], q)
    audit, out, cost, made = [], [], 0, iter(edits)

    def put(edit: str, turn: dict | None):
        nonlocal q, cost
        if edit == "K":
            out.append({"edit": "K", "role": turn["role"], "text": turn["text"]})
            q = kept(q, turn["role"][:1])
        else:
            out.append({"edit": edit, "role": SIDE[q], "text": turn["text"] if edit == "R" else ""})
            q = NEXT[q]
            cost += RELABEL if edit == "R" else INSERT
        cost += TRUNCATED if turn and turn["letter"] % 2 else 0

    for t in turns:
        gone = t["m"]
        if t["letter"] != GONE:
            gone -= 1
            for edit in (these := next(made)):
                if edit == "D":
                    cost += DELETE
                else:
                    put(edit, t if edit != "I" else None)
            audit.append(these)
        audit.append("D" * gone)
        cost += DELETE * gone
    if block["last"]:
        audit.append(closing(end))
        for _ in closing(end):
            put("I", None)
    return "".join(audit), out, cost


PIECE = "audit string, made array<struct<edit:string,role:string,text:string>>, cost long, blank long, duplicate long, truncated long, illegal long, head string, tail string"


def pieces(turns: DataFrame) -> DataFrame:
    """(conv, block, ...): each block's edits, the turns they leave, their cost and the faults of those that were there."""
    cut = stored(blocks(faulted(turns)))
    after = stored(after_blocks(cut))
    whole = cut.drop("matrix").join(after, "block").join(before_blocks(cut, after), "block")
    schema = T.StructType([cut.schema["conv"], *T._parse_datatype_string("block long"), *T._parse_datatype_string(PIECE)])
    legal = {"su", "ua", "au"}

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a block at a time: its texts are bounded, those of a batch are not
                row = batch.slice(i, 1)
                block = row.to_pylist()[0]
                audit, made, cost = mended(block)
                turns = block["turns"]
                initials = [t["role"][:1] for t in turns]
                free = [t["letter"] for t in turns if t["letter"] != GONE]
                blank = sum(t["m"] for t in turns if t["blank"])
                illegal = sum(t["m"] - 1 for t in turns) + sum(a + b not in legal for a, b in zip(initials, initials[1:]))
                duplicate = sum(t["m"] for t in turns) - blank - len(free)
                values = [audit, made, cost, blank, duplicate, sum(x % 2 for x in free), illegal, initials[0], initials[-1]]
                arrays = [pa.array([v], t) for v, t in zip(values, types)]
                yield pa.RecordBatch.from_arrays([row.column("conv"), row.column("block"), *arrays], names=schema.names)

    one = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    types = [pa.string(), pa.list_(one), *[pa.int64()] * 5, pa.string(), pa.string()]
    return whole.mapInArrow(run, schema)


def named(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(" "))
    return df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))


def repaired_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, edit, role, text): the turns of the repaired conversations; ``place`` ascends along a conversation."""
    made = pieces(named(df, conv_col, turn_col, role_col, text_col))
    return made.select("conv", F.posexplode("made").alias("at", "t"), "block").select(
        "conv", F.expr("struct(block, at)").alias("place"), "t.edit", "t.role", "t.text"
    )


def repair_structure(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation that has turns.

    Turns go by number, null first, then by role and a digest of the text; those without a conversation id form one
    conversation.  Null roles and texts are a space.  A turn without a letter is blank; one whose role and text were
    there before is a duplicate; one that does not end in ``.``, ``!`` or ``?`` is truncated; the first fault counts.
    Legal is an optional system turn before user and assistant in turn, the assistant last, or nothing at all.  Edits:
    Keep costs 0, Relabel 1, Delete 2 and Insert 5; blank and duplicate turns go, and a truncated one that stays costs 5
    more.  ``audit`` has the cheapest edits' initials, of equal ones the ASCII-least.  ``gaps`` is null beyond a long.

    A conversation may be of any length.  Its turns are dealt out by ranges, cut into blocks, and scanned and traced
    block by block; sixteen numbers a block pass through one task to join them.  What the result holds whole, the
    edits' initials and one digest over all that is said, is put together from the blocks' pieces in a stream.  An
    empty table gives an empty one; other columns don't matter.
    """
    turns = named(df, conv_col, turn_col, role_col, text_col)
    dealt = pieces(turns).withColumn("said", F.expr("array_join(transform(made, t -> concat(t.role, ':', t.text)), '\\n')")).withColumn("n_said", F.size("made")).drop("made")
    dealt = dealt.repartition("conv").sortWithinPartitions("conv", "block")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([dealt.schema["conv"], *T._parse_datatype_string(", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string")])
    legal = {"su", "ua", "au"}

    def run(batches):
        conv, begun, audit, digest, said, sums, tail = None, False, [], None, False, [], ""

        def done(kind):
            arrays = [pa.array([conv], kind), *(pa.array([s], pa.int64()) for s in sums), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv").type
            for row in batch.to_pylist():
                if not begun or row["conv"] != conv:
                    if begun:
                        yield done(kind)
                    conv, begun, audit, digest, said, sums = row["conv"], True, [], hashlib.sha256(), False, [0] * len(counts)
                else:
                    sums[3] += tail + row["head"] not in legal
                tail = row["tail"]
                audit.append(row["audit"])
                sums = [s + row[c] for s, c in zip(sums, counts)]
                if row["n_said"]:
                    digest.update((b"\n" if said else b"") + row["said"].encode())
                    said = True
        if begun:
            yield done(kind)

    folded = dealt.mapInArrow(run, schema)
    numbers = turns.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("conv").alias("c")).agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("turn").alias("n"))
    gaps = F.expr("coalesce(try_cast(cast(hi as decimal(38,0)) - cast(lo as decimal(38,0)) + 1 - n as long), if(hi is null, 0L, null))").alias("gaps")
    return folded.join(numbers, F.col("conv").eqNullSafe(F.col("c"))).select("conv", gaps, *counts, "audit", "repaired_sha256")


def damaged(df: DataFrame) -> DataFrame:
    """``conversations`` with a twentieth each of the turns dropped, emptied, cut short, repeated and given to the user.

    What happens to a turn is told by the crc32 of ``conv_id:turn``; nulls read as one space.
    """
    space = lambda c: f"coalesce(cast({c} as string), ' ')"
    chosen = df.select("conv_id", "turn", "role", "text", F.expr(f"crc32(encode(concat({space('conv_id')}, ':', {space('turn')}), 'UTF-8')) % 20").alias("way"))
    hurt = chosen.where("way <> 0").select(
        "conv_id", "turn",
        F.expr("if(way = 4, 'user', coalesce(role, ' '))").alias("role"),
        F.expr("case way when 1 then '' when 2 then translate(coalesce(text, ' '), '.!?', '') else coalesce(text, ' ') end").alias("text"),
        F.explode(F.expr("array_repeat(0, if(way = 3, 2, 1))")).alias("copy"),
    )
    return hurt.drop("copy")
