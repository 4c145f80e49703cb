"""The repair of conversations against a program that keeps whole strings, an exhaustive search, and the query's SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pandas
import pytest
from helpers import by_repr

from pyspark.sql import functions as F
from tidemark.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHOLE = re.compile(r"(s?(ua)+)?")


def sown(rows):
    out = []
    for conv, turn, role, text in rows:
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if f:
            text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
            out += [(conv, turn, "user" if f == 4 else role, text)] * (1 + (f == 3))
    return out


def brute(original, rows):
    """By conversation; the program keeps the cheapest and least string of each way the roles can read so far."""
    out = []
    for conv in dict.fromkeys(r[0] for r in original):
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        states = {"": (0, "", ())}  # by what the initials come to: nothing, s, and then u or a last
        put = lambda to, x, into: into.__setitem__(to, min(into.get(to, x), x))

        def grow(now):
            now = dict(now)
            for _ in range(3):
                for q, (cost, edits, said) in list(now.items()):
                    to = "a" if q == "u" else "u"
                    put(to, (cost + 3, edits + "I", (*said, ({"u": "user", "a": "assistant"}[to], ""))), now)
            return now

        def runs(now):
            """All insertion runs of each state, not only the best that leads somewhere."""
            for q, (cost, edits, said) in now.items():
                yield q, cost, edits, said
                for _ in range(3):
                    q = "a" if q == "u" else "u"
                    cost, edits, said = cost + 3, edits + "I", (*said, ({"u": "user", "a": "assistant"}[q], ""))
                    yield q, cost, edits, said

        for (_, role, text), fault in zip(own, faults):
            into = {}
            for q, cost, edits, said in runs(states):
                more = 3 * (fault == "t")
                put(q, (cost + 4, edits + "D", said), into)
                if fault in ("b", "d"):
                    continue
                to = "a" if q == "u" else "u"
                put(to, (cost + 3 + more, edits + "R", (*said, ({"u": "user", "a": "assistant"}[to], text))), into)
                if role[:1] == to or (role[:1] == "s" and q == "" and not said):
                    put(role[:1], (cost + more, edits + "K", (*said, (role, text))), into)
            states = into
        cost, edits, said = min((c, e, s) for q, c, e, s in runs(states) if q == "a" or (q == "" and not s))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        assert WHOLE.fullmatch("".join(r[:1] for r, _ in said))
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, edits, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()))
    return out


def exhaustive(rows):
    """(cost, audit) of the cheapest and least of all edits of a few rows (initial, fault)."""
    best = None
    choices = [[k * "I" + e for k in range(3) for e in "DKR"] for _ in rows]
    for codes in itertools.product(*choices, ["", "I", "II"]):
        cost, slots = 0, []
        for code, row in zip(codes, [*rows, None]):
            cost += 3 * code.count("I")
            slots += ["ua"] * code.count("I")
            edit = code.strip("I")
            if not edit:
                continue
            if edit == "D":
                cost += 4
                continue
            if row[1] in ("b", "d"):
                break
            cost += 3 * (row[1] == "t") + 3 * (edit == "R")
            slots.append("ua" if edit == "R" else row[0])
        else:
            if any(WHOLE.fullmatch("".join(x)) for x in itertools.product(*slots)):
                best = min(best or (cost, "".join(codes)), (cost, "".join(codes)))
    return best


def fixture(seed=1, n=60, longest=14):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        turn = rng.choice([0, 3])
        for i in range(rng.randint(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "usher", "", None])
            text = rng.choice(["Well.", "Why?", "So!  \n", "and so", "", " \t", None, "日本。", "Ok. \x0b", f"n{i}."])
            out.append((conv, None if rng.random() < 0.05 else turn, role, text))
            turn += rng.choice([1, 1, 1, 0, 2, 5])
    out += [(None, 1, "user", "Who?"), (None, 2, "assistant", "Nobody."), (None, None, "system", "Be kind."), (n, None, "user", "A?"), (n, None, "user", "A?")]
    return out + [(n + 1, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(300)] + [(n + 2, i, "user", "the same.") for i in range(200)] + [(n + 3, 7, "user", "and the same.")] * 50


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("conv", "at", "mark", "same", "before", "task", "place", "id", "fault")})


@pytest.mark.parametrize(("seed", "most"), [(1, 2048), (2, 3), (3, 1)])
def test_repair(spark, seed, most, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", most)
    rows = fixture(seed)
    turns = frame(spark, rows)
    whole = repair.repair(repair.damaged(turns), most=most)[0]
    got = {r[0]: tuple(r) for r in whole.collect()}
    want = brute(rows, sown(rows))
    assert [got[w[0]] for w in want if w[0] in got] == [w for w in want if w[0] in got]
    assert all(w[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for w in want if w[0] not in got)
    if most == 2048:
        assert by_repr(repair.repaired_conversations(turns, repair.damaged(turns)).collect()) == by_repr(want)


def test_least_of_all_edits():
    rng = random.Random(4)
    for _ in range(150):
        rows = [(rng.choice("suax"), rng.choice(["", "", "t", "b", "d"])) for _ in range(rng.randint(0, 4))]
        initials, standings = [" sua".find(r) if r != "x" else 0 for r, _ in rows], [{"": 0, "t": 2}.get(f, 1) for _, f in rows]
        costs, ranks = repair.summary(initials, standings, (repair.START,))
        cost, _, added, state = min((costs[0, q] + 3 * k, ranks[0, q], k, q) for q, k in repair.ENDS if (0, q) in costs)
        assert (cost, repair.audit(initials, standings, 0, state) + "I" * added) == exhaustive(rows), rows


def test_as_its_sql(spark):
    rows = fixture(7, 80)
    conversations = pandas.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    want = duckdb.sql(queries.ORACLE_SQL["op13_structure_repair"]).fetchall()
    turns = frame(spark, rows)
    assert by_repr(repair.repaired_conversations(turns, repair.damaged(turns)).collect()) == by_repr(want)


def test_turns_of_the_parts(spark):
    rows = [(1, 0, "system", "Be."), (1, 1, "user", "Why?"), (1, 2, "user", "Really?"), (2, 0, "assistant", "x" * 3_000_000 + "."), (2, 1, "assistant", "Done.")]
    plain = spark.createDataFrame(rows, SCHEMA)
    whole, parts = repair.repair(plain, id_col="conv_id")
    said = {r.conv: [(t.role, len(t.text)) for t in r.turns] for r in parts.where("conv = 1").collect()}
    assert said == {1: [("system", 3), ("user", 4), ("assistant", 7)]}
    assert {r.conv: (r.cost, r.audit) for r in whole.collect()} == {1: (3, "KKR"), 2: (3, "RK")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repaired_conversations(none, repair.damaged(none)).collect() == []
