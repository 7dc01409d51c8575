import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from namesmith.llm import conversation_repair as R

DDL = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
           "repaired_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, digest(*r[2:])))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = text.strip(" \t\n\r\x0b\x0c")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen
                   else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_best(rows, marks):
    """All audits, row by row, the best of each role string's state; no heaps."""
    def state(initials):
        if re.fullmatch("(s?(ua)+)?", initials):
            return "end" if initials else ""
        return initials if initials == "s" else "u" if re.fullmatch("s?(ua)*u", initials) else None

    best = {"": (0, "", "", ())}  # by state: cost, audit, initials, lines

    def improve(found, cost, audit, initials, lines):
        key = state(initials)
        if key is not None and (key not in found or (cost, audit) < found[key][:2]):
            found[key] = cost, audit, initials, lines

    def inserted(found):
        for _ in range(3):
            for cost, audit, initials, lines in list(found.values()):
                for role in ("user", "assistant"):
                    improve(found, cost + 3, audit + "I", initials + role[0], (*lines, f"{role}:"))
        return found

    best = inserted(best)
    for (_, _, role, text), mark in zip(rows, marks):
        found = {}
        for cost, audit, initials, lines in best.values():
            improve(found, cost + 4, audit + "D", initials, lines)
            if mark in ("blank", "duplicate"):
                continue
            more = 3 if mark == "truncated" else 0
            improve(found, cost + more, audit + "K", initials + role[:1], (*lines, f"{role}:{text}"))
            for given in ("user", "assistant"):
                improve(found, cost + 3 + more, audit + "R", initials + given[0],
                        (*lines, f"{given}:{text}"))
        best = inserted(found)
    ends = [best[k] for k in ("", "end") if k in best]
    cost, audit, _, lines = min(ends, key=lambda b: b[:2])
    return cost, audit, lines


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = damaged([r for r in rows if r[0] == conv and (r[0] is None) == (conv is None)])
        marks = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = plain_best(mine, marks)
        out.append((conv, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"),
                    illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL + ", key string, copies int")
    found = R.repair(df.repartition(3), **how)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()), key=str)


def some_rows(seed, convs, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "a?", "b! ", " ", "", None, "Long one, without an end", "x.\n\t"]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "unknown"])
            text = rng.choice([f"t{conv} {turn}.", *texts])
            rows.append((conv, rng.choice([turn] * 6 + [None, 3]), role, text))
    return rows


def test_random_conversations(spark):
    rows = some_rows(1, 60, 14)
    assert run(spark, rows) == brute(rows)


def test_conversations_in_segments(spark):
    rows = some_rows(2, 8, 60) + some_rows(3, 20, 4)
    want = brute(rows)
    assert run(spark, rows, segment=3, fan=2) == want
    assert run(spark, rows, segment=1, fan=3) == want


def test_awkward_rows(spark):
    rows = [(None, None, None, None), (None, 2, "user", "a"), (None, 2, "assistant", "b."), (1, 0, "user", "z" * 50_000),
            (7, 5, "assistant", "only."), (8, -3, "system", "s."), (9, 2 ** 40, "user", "q?"), (9, 0, "user", "q?")]
    dropped = next(i for i in range(10 ** 6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "gone")]
    rows += [(5, t, "user", "same.") for t in range(40)] + [(6, 1, "assistant", "copy.")] * 300
    found = run(spark, rows)
    assert found == brute(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in found
    assert run(spark, []) == []


def test_sql_gives_the_same(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = some_rows(5, 40, 12) + [(None, 1, None, "n"), (None, None, "user", None)]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    found = con.execute(f"select {', '.join(COLUMNS)} from ({R.oracle()})").fetchall()
    assert sorted(found, key=str) == run(spark, rows)


def test_many_equal_rows_are_one_record(spark):
    rows = [(1, t, r, x) for t, r, x in ((1, "user", "q?"), (2, "assistant", "a."))] + [(1, 3, "user", "q?")] * 50_000
    (found,) = run(spark, rows)
    marks = damaged(rows)
    assert found[3] == len(marks) - len(set((r, x) for _, _, r, x in marks))
    assert found[7].count("D") >= 49_000


@pytest.mark.parametrize("n", range(5))
def test_search_finds_the_least_of_all_audits(n):
    kinds = [("s", False), ("u", False), ("a", True), ("o", False), ("", False), None]
    for rows in product(kinds, repeat=n):
        moves = [R.run_moves(1) if k is None else R.row_moves(*k) for k in rows]
        want = every_path(moves)
        for entry, exits in ((0, (0, 3)), (2, (1,)), (3, (2, 0)), (1, (3,))):
            found = [want[entry, x] for x in exits if (entry, x) in want]
            assert R.cheapest(moves, entry, exits) == min(found, default=None)


def every_path(moves):
    """Dynamic programming over all pairs of states, with insertions to a fixed point."""
    table = {(q, q): (0, "") for q in range(4)}

    def relaxed(table):
        table = dict(table)
        for _ in range(4):
            for (e, q), (cost, audit) in list(table.items()):
                for w, x, p in R._INSERTS.get(q, ()):
                    if (cost + w, audit + x) < table.get((e, p), (99, "")):
                        table[e, p] = cost + w, audit + x
        return table

    table = relaxed(table)
    for step in moves:
        after = {}
        for (e, q), (cost, audit) in table.items():
            for w, x, p in step.get(q, ()):
                if (cost + w, audit + x) < after.get((e, p), (10 ** 6, "")):
                    after[e, p] = cost + w, audit + x
        table = relaxed(after)
    return table
