"""Repair of conversations against all edits of short ones, in one block and in many, and on hard small inputs."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from loreweave.llm import queries, structure

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"
FULL = {"u": "user", "a": "assistant"}


def cheapest(turns):
    """(cost, audit, repaired) by Dijkstra's search over (turns read, roles said), audits compared whole."""
    seen, letters = set(), []
    for role, text in turns:
        last = text.rstrip(BLANK)[-1:]
        letters.append((not last or (role, text) in seen, last not in (".", "!", "?")))
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, said = heapq.heappop(heap)
        if i == len(turns) and state in ("", "a"):
            return cost, audit, "\n".join(said)
        if (i, state) in done:
            continue
        done.add((i, state))
        side = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", i, side, (*said, FULL[side] + ":")))
        if i < len(turns):
            (role, text), (gone, cut) = turns[i], letters[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, said))
            if not gone:
                extra = 5 * cut
                first = role[:1]
                if first == side or state == "" and first == "s":
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, first, (*said, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, side, (*said, f"{FULL[side]}:{text}")))


def report(rows):
    """What the operator returns, conversation by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns = [r[1:] for r in own]
        numbers = {t for t, _, _ in own if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        blank = duplicate = truncated = 0
        for i, (role, text) in enumerate(turns):
            last = text.rstrip(BLANK)[-1:]
            if not last:
                blank += 1
            elif (role, text) in turns[:i]:
                duplicate += 1
            elif last not in ".!?":
                truncated += 1
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, said = cheapest(turns)
        out[conv] = (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def made(rng, n):
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, 9)):
            for _ in range(rng.choice([1, 1, 1, 2, 4])):
                role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
                rows.append((conv, rng.choice([turn, turn, None]), role, rng.choice(["Yes.", "No!", "cut off", "", " \n", "why?  ", None, "Ünd.", f"say {turn}."])))
    return rows


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 2), (3, 1)])
def test_equals_a_search_of_all_edits(spark, monkeypatch, seed, block):
    monkeypatch.setattr(structure, "BLOCK", block)
    rows = made(random.Random(seed), 60)
    got = {r[0]: tuple(r) for r in structure.repair_structure(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == report(rows)


def test_a_long_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(structure, "BLOCK", 16)
    rng = random.Random(4)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice([f"Turn {i}.", "again.", "cut"])) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in structure.repair_structure(df).collect()] == [report(rows)[7]]
    turns = structure.repaired_turns(df).orderBy("place").collect()
    assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == report(rows)[7][-1]
    assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in turns))


def test_few_states_and_legal_results():
    """Whatever is read, the automaton stays small; each trace is legal."""
    rng = random.Random(6)
    a = structure.Automaton()
    for _ in range(3000):
        letters = [rng.randrange(8) for _ in range(rng.randint(0, 12))]
        edits, q = a.trace(letters, a.state(structure.END)[0], 0)
        assert len(edits) == len(letters) and structure.STATES[q] in structure.STATES
    assert len(a.vectors) < 60


def test_repeated_turns_are_one_row(spark):
    rows = [(1, 0, "user", "Same.")] * 500 + [(1, 1, "assistant", "Fine.")]
    (got,) = structure.repair_structure(spark.createDataFrame(rows, SCHEMA)).collect()
    assert tuple(got) == report(rows)[1]
    assert structure.faulted(structure.named(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text")).count() == 2


def test_far_numbers_and_nothing(spark):
    rows = [(1, -(1 << 63), "user", "A."), (1, (1 << 63) - 1, "assistant", "B."), (2, None, None, None)]
    got = {r.conv: r for r in structure.repair_structure(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].gaps is None and got[1].audit == "KK" and got[2].gaps == 0 and got[2].audit == "D"
    assert structure.repair_structure(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_blanks_are_cut_from_the_end(spark):
    """Vertical tabs and form feeds are blanks; the letters of their escapes are none."""
    texts = ["See v1.0", "0", "bc", "Fine.x", "Done.\x0b", "\x0c", "\x0b\x0c ", "Why? \x0c\r", "a\\", "Ok.\xa0", "Ok.\x1c"]
    rows = [(c, t, ["user", "assistant"][t % 2], x) for c, own in enumerate([texts, texts[::-1], *([x] for x in texts)]) for t, x in enumerate(own)]
    got = {r[0]: tuple(r) for r in structure.repair_structure(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == report(rows)


def test_query_on_damaged_turns(spark, tmp_path):
    """Every conversation comes back, those that lose all turns too; damage follows the crc32 of each turn's name."""
    rows = [(c, t, ["system", "user", "assistant"][t % 3], f"Text {c} {t}. And more!") for c in range(150) for t in range(1 + c % 5)]
    rows += [(None, None, None, None), (900, None, "user", "x?")]
    spark.createDataFrame(rows, SCHEMA).withColumn("cost", structure.F.lit("clash")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r) for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    hurt = []
    for c, t, role, text in rows:
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        hurt += [(c, t, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    expected = report(hurt)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: expected.get(c, (c, *nothing)) for c in {r[0] for r in rows}}
    assert any(v[7] == "" for v in got.values())
