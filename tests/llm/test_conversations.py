"""Repair of conversations against the SQL, against a plain search over edits, and by ranges against streams."""

import functools
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from quillon.llm import conversations
from quillon.llm.conversations import damaged, repair

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def table(spark, seed=3, convs=40, longest=12):
    rng = random.Random(seed)
    texts = ["Yes.", "No?", "no end", "", None, " \n\t", "Yes. ", "a! b", "é", " ", "x" * 500]
    roles = ["user", "assistant", "system", "tool", None, "", "ux"]
    rows = []
    for conv in [None, *range(convs)]:
        for n in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([n, n, n, n + 3, 5, None]), rng.choice(roles[: rng.choice([2, 3, 7])]), rng.choice(texts), "clash", 1))
    rows.append((10**17 + 1, 2**60, "user", "Far.", "clash", 1))
    rows += [(777, t, r, "Same.", "clash", 1) for t in (1, 1, 2, 9) for r in ("user", "user", "assistant")] * 4
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind string, part int").repartition(3)


def plain(rows):
    """Each conversation by a search over (row, role last put out), with costs before letters."""
    held = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        role = "user" if lot == 4 else role
        held[conv] += [(turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text)] * {0: 0, 3: 2}.get(lot, 1)
    out = []
    for conv, mine in held.items():
        mine.sort()
        seen, faults = set(), []
        for _, _, role, _, text in mine:
            own = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not own else "duplicate" if (role, text) in seen else "truncated" if own[-1] not in ".!?" else "")
            seen.add((role, text))

        @functools.cache
        def best(i, last, run, mine=mine, faults=faults):
            found = [(0, "", ())] if i == len(mine) and last in ("", "a") else []
            want = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
            name = {"u": "user", "a": "assistant"}[want]
            if run < 4:
                c, a, o = best(i, want, run + 1)
                found.append((c + 5, "I" + a, (name + ":", *o)))
            if i < len(mine):
                c, a, o = best(i + 1, last, 0)
                found.append((c + 2, "D" + a, o))
                if faults[i] in ("", "truncated"):
                    more, role, text = 5 * bool(faults[i]), mine[i][2], mine[i][4]
                    c, a, o = best(i + 1, want, 0)
                    found.append((c + more + 1, "R" + a, (f"{name}:{text}", *o)))
                    if role[:1] == want or role[:1] == "s" and last == "":
                        c, a, o = best(i + 1, role[:1], 0)
                        found.append((c + more, "K" + a, (f"{role}:{text}", *o)))
            return min(found) if found else (10**9, "", ())

        cost, audit, lines = best(0, "", 0)
        turns = [m[1] for m in mine if m[0]]
        first = [m[2][:1] for m in mine]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(x) for x in ("blank", "duplicate", "truncated")],
                    sum(x + y not in ("su", "ua", "au") for x, y in zip(first, first[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(str, out))


def listed(df):
    return sorted(str(tuple(r)) for r in df.select(*COLUMNS).collect())


def test_repair_equals_search(spark):
    rows = table(spark)
    want = plain([tuple(r)[:4] for r in rows.collect()])
    assert listed(repair(damaged(rows))) == want
    assert repair(damaged(rows.limit(0))).count() == 0


@pytest.mark.parametrize("seed", [5, 6])
def test_long_conversations_by_ranges(spark, monkeypatch, seed):
    rows = table(spark, seed, convs=12, longest=30).cache()
    want = listed(repair(damaged(rows)))
    monkeypatch.setattr(conversations, "MOST_ROWS", 4)
    monkeypatch.setattr(conversations, "SEGMENT", 9)
    assert listed(repair(damaged(rows))) == want


def test_a_conversation_of_which_nothing_is_left(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    rows = spark.createDataFrame([(7, gone, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert listed(repair(damaged(rows))) == [str((7, 0, 0, 0, 0, 0, 0, "", empty))]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = sorted(str(tuple(r)) for r in con.sql(f"select {', '.join(COLUMNS)} from ({conversations.SQL})").fetchall())
    assert listed(conversations.op13_repair(spark, SF)) == want
