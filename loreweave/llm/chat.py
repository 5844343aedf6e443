"""Operator 5: chat formatting by minimum-cost role repair over an automaton of legal turns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: States: nothing yet, then the role of the last turn.  Fixed values: other names of the roles.
ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "developer": "system"}
STATES, NONE = 4, 1 << 30
RELABEL, RELABEL_SYSTEM, NAME, MERGE, INSERT = 3, 4, 1, 1, 5
#: The legal next turns of each state, and the states in which a conversation may end.
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
ENDS = (0, 3)
#: Turns of a block at most; a block is repaired in one piece for each pair of border states.
BLOCK = 256


def way(state: int, target: int) -> tuple[int, ...] | None:
    """The fewest turns to insert so that ``target`` may follow ``state``; None if none will do."""
    paths = [(state, ())]
    for _ in range(STATES):
        for at, made in paths:
            if target in LEGAL[at]:
                return made
        paths = [(n, (*made, n)) for at, made in paths for n in LEGAL[at]]
    return None


def ending(state: int) -> tuple[int, ...]:
    """The turns to insert at the end."""
    if state in ENDS:
        return ()
    return (*way(state, 3), 3)


#: STEP[s][l]: the cost that a turn labelled l follows s; a turn of the same role is merged into it.
STEP = [[MERGE if s == l else NONE if l == 0 or (w := way(s, l)) is None else INSERT * len(w) for l in range(STATES)] for s in range(STATES)]
STEP[0][0] = NONE
AFTER = [INSERT * len(ending(s)) for s in range(STATES)]


def label_costs(role: str | None) -> list[int]:
    """The cost of each label for a turn that says it is of ``role``; names that mean no role may be either side's."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    if name not in ROLES:
        return [NONE, NAME + RELABEL_SYSTEM, NAME, NAME]
    own = ROLES.index(name) + 1
    return [NONE] + [0 if l == own else RELABEL_SYSTEM if 1 in (l, own) else RELABEL for l in (1, 2, 3)]


def repair_block(roles: list[str | None]) -> tuple[list[int], list[str]]:
    """Of a block: the least cost from each state to each, and for each turn its label on each of those paths.

    Among paths of one cost the one whose last differing turn has the lower state wins.
    Both are flat, at ``4 * start + end``; a label is a digit.
    """
    cost, labels = [], []
    known: dict[str | None, list[list[tuple[int, int]]]] = {}
    for r in roles:
        if r not in known:
            c = label_costs(r)
            known[r] = [[(s, STEP[s][l] + c[l]) for s in range(STATES) if STEP[s][l] + c[l] < NONE] for l in range(STATES)]
    for start in range(STATES):
        at = [0 if s == start else NONE for s in range(STATES)]
        trail = []
        for r in roles:
            best, came = [NONE] * STATES, [0] * STATES
            for l, ways in enumerate(known[r]):
                for s, w in ways:
                    if at[s] + w < best[l]:
                        best[l], came[l] = at[s] + w, s
            at = best
            trail.append(came)
        cost += at
        for end in range(STATES):
            l, out = end, []
            for came in reversed(trail):
                out.append(l)
                l = came[l]
            labels.append(out[::-1])
    return cost, ["".join(str(p[i]) for p in labels) for i in range(len(roles))]


def borders(blocks: list[list[int]]) -> tuple[list[int], int]:
    """The state before each block and after the last, on the cheapest way through all; and its cost."""
    at, trail = [0] + [NONE] * (STATES - 1), []
    for m in blocks:
        best, came = [NONE] * STATES, [0] * STATES
        for e in range(STATES):
            for s in range(STATES):
                if at[s] < NONE and m[4 * s + e] < NONE and at[s] + m[4 * s + e] < best[e]:
                    best[e], came[e] = at[s] + m[4 * s + e], s
        at = best
        trail.append(came)
    total, end = min((at[s] + AFTER[s], s) for s in range(STATES))
    out = [end]
    for came in reversed(trail):
        out.append(came[out[-1]])
    return out[::-1], total


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys of a sorted partition, whole."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        key = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        at = 0
        for i in range(len(key) + 1):
            if i == len(key):
                held.append(table.slice(at, i - at))
            elif (key[i] != key[i - 1]) if i else held and key[0] != tuple(held[-1].column(k)[-1].as_py() for k in keys):
                if i > at:
                    held.append(table.slice(at, i - at))
                yield pa.concat_tables(held)
                held, at = [], i
    if held and sum(map(len, held)):
        yield pa.concat_tables(held)


def repair_roles(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Add to each turn ``new_role``, ``action``, ``inserted``, ``appended``, ``rendered`` and its conversation's ``cost``.

    Turns are ordered by number, then role and text; a null number comes first, and
    turns without a conversation id form one conversation.  Legal are an optional
    system turn, then user and assistant in turn, the assistant last.  ``action`` is
    keep, relabel, merge (into the turn before it) or both; ``inserted`` lists the
    empty turns put before this one and ``appended`` those put after the last.
    ``rendered`` is this turn's piece: the pieces of a conversation in order make
    the whole.  An unknown or null role may become either side's; a null text is
    empty.  Repeated rows are turns of their own, an empty table gives an empty
    one, and columns named like a result are replaced.

    A conversation may be of any length, and numbers may repeat: all turns are dealt
    out by ranges of their order, equal ones too, and cut into blocks of at most 256
    turns, which are repaired apart for each pair of border states; a second step of
    sixteen numbers a block chooses the borders.
    """
    made = ["new_role", "action", "inserted", "appended", "rendered", "cost"]
    columns = [c for c in df.columns if c not in made]
    # so that no column clashes with those made here
    keyed = df.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(columns)])
    conv_col, turn_col, role_col, text_col = (f"in_{columns.index(c)}" for c in (conv_col, turn_col, role_col, text_col))
    order = [conv_col, turn_col, role_col, text_col, "lw_row"]
    dealt = keyed.withColumn("lw_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("lw_row")
    schema = T.StructType([*keyed.schema, *T._parse_datatype_string("lw_paths string, lw_at int, lw_costs array<int>, lw_block long")])
    names = keyed.columns

    def blocks(batches):
        block = TaskContext.get().partitionId() << 40  # blocks of later ranges come later
        for batch in batches:
            convs = batch.column(conv_col).to_pylist()
            cuts = [0]
            for i in range(1, len(convs) + 1):
                if i == len(convs) or convs[i] != convs[i - 1] or i - cuts[-1] == BLOCK:
                    cuts.append(i)
            for at, end in zip(cuts, cuts[1:]):
                if end > at:
                    g = batch.slice(at, end - at)
                    cost, paths = repair_block(g.column(role_col).to_pylist())
                    n = end - at
                    more = [pa.array(paths), pa.array(range(n), pa.int32()), pa.array([None] * (n - 1) + [cost], pa.list_(pa.int32())), pa.array([block] * n, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*(g.column(c) for c in names), *more], names=[*names, "lw_paths", "lw_at", "lw_costs", "lw_block"])
                    block += 1

    done = stored(dealt.mapInArrow(blocks, schema))
    conv_type = keyed.schema[conv_col].dataType
    chain_schema = T.StructType([T.StructField("lw_conv", conv_type), *T._parse_datatype_string("lw_of long, lw_path int, lw_start int, lw_last boolean, cost int")])

    def chain(batches):
        for g in groups(batches, ["lw_conv"]):
            states, total = borders(g.column("lw_costs").to_pylist())
            n = len(g)
            arrays = [
                g.column("lw_conv").combine_chunks(),
                g.column("lw_of").combine_chunks(),
                pa.array([4 * a + b for a, b in zip(states, states[1:])], pa.int32()),
                pa.array(states[:-1], pa.int32()),
                pa.array([i == n - 1 for i in range(n)]),
                pa.array([total] * n, pa.int32()),
            ]
            arrays = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
            yield pa.RecordBatch.from_arrays(arrays, names=chain_schema.names)

    ends = done.where("lw_costs is not null").select(F.col(f"`{conv_col}`").alias("lw_conv"), F.col("lw_block").alias("lw_of"), "lw_costs")
    chained = ends.repartition("lw_conv").sortWithinPartitions("lw_conv", "lw_of").mapInArrow(chain, chain_schema)
    joined = done.join(chained, F.col(f"`{conv_col}`").eqNullSafe(F.col("lw_conv")) & (F.col("lw_block") == F.col("lw_of")))

    ways = ", ".join("array(" + ", ".join(f"'{ROLES[x - 1]}'" for x in (way(s, l) or () if s != l else ())) + ")" for s in range(STATES) for l in range(STATES))
    lasts = ", ".join("array(" + ", ".join(f"'{ROLES[x - 1]}'" for x in ending(s)) + ")" for s in range(STATES))
    name = f"lower(trim(coalesce(`{role_col}`, '')))"
    known = f"case {name} " + " ".join(f"when '{k}' then '{v}'" for k, v in ALIASES.items()) + f" else {name} end"
    empty = "concat('<|', x, '|>\\n\\n<|end|>\\n')"
    stepped = (
        joined.withColumn("lw_label", F.expr("cast(substr(lw_paths, lw_path + 1, 1) as int)"))
        .withColumn("lw_end", F.expr("lw_last and lw_costs is not null"))
        .withColumn("lw_before", F.expr("cast(null as int)"))
    )
    # the state before a turn is its own block's: the label of the turn before, told by the path strings' order
    w = "lag(cast(substr(lw_paths, lw_path + 1, 1) as int)) over (partition by lw_conv, lw_of order by lw_at)"
    stepped = stepped.withColumn("lw_before", F.coalesce(F.expr(w), F.col("lw_start")))
    shown = (
        stepped.withColumn("new_role", F.expr(f"element_at(array({', '.join(repr(r) for r in ROLES)}), lw_label)"))
        .withColumn("lw_merged", F.expr("lw_before = lw_label"))
        .withColumn("lw_renamed", F.expr(f"not (new_role <=> ({known}))"))
        .withColumn("action", F.expr("case when lw_merged and lw_renamed then 'relabel+merge' when lw_merged then 'merge' when lw_renamed then 'relabel' else 'keep' end"))
        .withColumn("inserted", F.expr(f"cast(element_at(array({ways}), 4 * lw_before + lw_label + 1) as array<string>)"))
        .withColumn("appended", F.expr(f"cast(if(lw_end, element_at(array({lasts}), lw_label + 1), array()) as array<string>)"))
        .withColumn(
            "rendered",
            F.expr(
                "concat(if(lw_merged, '\\n', concat(if(lw_before = 0, '', '<|end|>\\n'), "
                f"array_join(transform(inserted, x -> {empty}), ''), '<|', new_role, '|>\\n')), coalesce(`{text_col}`, ''), "
                f"if(lw_end, concat('<|end|>\\n', array_join(transform(appended, x -> {empty}), '')), ''))"
            ),
        )
    )
    return shown.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(columns)], *made)
