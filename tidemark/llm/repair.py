"""Conversation structure repair by a rank-compressed dynamic program.

A conversation's rows become a well-formed one, ``(s?(ua)+)?`` by the roles' initials, at the
least cost; of equally cheap edits the audit string that sorts first wins.  An edit of a row is a
macro: a run of insertions and what is done with the row, written as a code such as ``IK``.  The
codes are prefix-free, so that strings of as many codes compare as their codes do one by one.
The program keeps no strings: a layer holds for each state a cost, the rank of its string among
the layer's, and a pointer to its parent; the next layer's ranks are those of (rank, code).

Rows are sorted by range, so that a conversation of any length is spread over many tasks, and
cut into blocks.  A block's layers are worked out from each state that it may be entered in, with
one ranking over all of them; that leaves 16 costs and ranks, which compose in the same way: a
second pass over the blocks' summaries, of a few bytes for each row, tells how each block is
entered and left, and the blocks then give their parts of the audit and of the repaired text.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidemark.llm import _kit

#: What an edit costs, and what an unfinished row adds if it stays.
DELETE, REROLE, INSERT, UNFINISHED = 4, 3, 3, 3
#: Rows of a block, and characters of their texts after which it ends too.
BLOCK, CHARACTERS = 2048, 1 << 18
NAMES = {2: "user", 3: "assistant"}
#: States: nothing yet, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
FINE, GONE, OPEN = range(3)  # a row's standing: nothing wrong, must be deleted, unfinished
#: Insertion runs longer than two never pay: two that follow each other can be left out.
CODES = sorted("I" * k + edit for k in range(3) for edit in "DKR")
FAR = 1 << 60


def _inserted(state: int, times: int) -> int:
    for _ in range(times):
        state = ASSISTANT if state == USER else USER
    return state


@lru_cache(None)
def _edits(initial: int, standing: int) -> tuple[tuple[int, int, int, int], ...]:
    """(state, code, next state, cost) of all edits of a row; initial is the state its role leads to, 0 if none."""
    out = []
    for state in range(4):
        for code, letters in enumerate(CODES):
            times, edit = len(letters) - 1, letters[-1]
            at, cost = _inserted(state, times), INSERT * times
            extra = UNFINISHED * (standing == OPEN)
            if edit == "D":
                out.append((state, code, at, cost + DELETE))
            elif standing != GONE:
                to = ASSISTANT if at == USER else USER
                if edit == "R":
                    out.append((state, code, to, cost + REROLE + extra))
                elif initial == (SYSTEM if at == START and initial == SYSTEM else to):
                    out.append((state, code, initial, cost + extra))
    return tuple(out)


#: What may be inserted at the end: (state, insertions), for each state.
ENDS = tuple((state, k) for state in range(4) for k in range(3) if _inserted(state, k) == ASSISTANT or (state == START and k == 0))


def layer(costs: dict, ranks: dict, initial: int, standing: int) -> tuple[dict, dict, dict]:
    """The next layer's costs, ranks and parents, by (state entered in, state)."""
    best: dict = {}
    for (entry, state), cost in costs.items():
        rank = ranks[entry, state]
        for _, code, to, more in _edits_of(initial, standing, state):
            if (entry, to) not in best or (cost + more, rank, code) < best[entry, to][0]:
                best[entry, to] = ((cost + more, rank, code), (state, code))
    order = {x: i for i, x in enumerate(sorted({b[0][1:] for b in best.values()}))}
    return {k: b[0][0] for k, b in best.items()}, {k: order[b[0][1:]] for k, b in best.items()}, {k: b[1] for k, b in best.items()}


@lru_cache(None)
def _edits_of(initial: int, standing: int, state: int) -> tuple:
    return tuple(e for e in _edits(initial, standing) if e[0] == state)


def summary(initials: list[int], standings: list[int], entries: tuple[int, ...]) -> tuple[dict, dict]:
    """A block's least cost and its string's rank, by (state entered in, state left in)."""
    costs, ranks = {(e, e): 0 for e in entries}, {(e, e): 0 for e in entries}
    for initial, standing in zip(initials, standings, strict=True):
        costs, ranks, _ = layer(costs, ranks, initial, standing)
    return costs, ranks


def audit(initials: list[int], standings: list[int], entry: int, left: int) -> str:
    """A block's cheapest and least string between two states, by the parents of each layer."""
    costs, ranks, parents = {(entry, entry): 0}, {(entry, entry): 0}, []
    for initial, standing in zip(initials, standings, strict=True):
        costs, ranks, parent = layer(costs, ranks, initial, standing)
        parents.append(parent)
    out, state = [], left
    for parent in reversed(parents):
        state, code = parent[entry, state]
        out.append(CODES[code])
    return "".join(reversed(out))


def damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text): rows with faults sown by a checksum of conversation and turn, to try a repair on."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat(said(id_col), F.lit(":"), said(turn_col))) % 20).cast("int")
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), fault.alias("fault")).where("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return rows.drop("_copy")


def _last_mark(text: str) -> Column:
    """The last character that is no white space, empty if there is none."""
    return F.right(F.rtrim(text, F.lit(" \t\n\v\f\r")), F.lit(1))


def _standing(rows: DataFrame) -> DataFrame:
    """rows with mark (the last of the text), at (which tells equal rows apart) and before: whether role
    and text are an earlier row's of the conversation."""
    known = F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), F.lit("")), F.length("role").cast("string"), "role", "text")
    rows = _kit.written(rows.select("conv", "turn", "role", "text", _last_mark("text").alias("mark"), F.sha2(known, 256).alias("same"), F.monotonically_increasing_id().alias("at")), "turns")
    first = rows.groupBy("same").agg(F.min(F.struct("turn", "at")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    first = _kit.written(first, "repeated")
    salt, salts = _kit.salted(first, "same", "rows", rows.count())
    told = rows.withColumn("_dealt", F.col("at")).withColumn("_salt", salt).join(first.select("same", F.col("first")["at"].alias("first"), F.explode(salts).alias("_salt")), ["same", "_salt"], "left")
    return told.select("conv", "turn", "role", "text", "mark", "at", F.coalesce(F.col("first") != F.col("at"), F.lit(False)).alias("before"))


def _fields(schema: str) -> list[pa.Field]:
    return list(to_arrow_schema(_parse_datatype_string(schema)))


def _packed(rows: Iterable[tuple], fields: list[pa.Field], size=lambda row: 256) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``CHARACTERS`` each by the sizes told."""
    some, total = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], f.type) for i, f in enumerate(fields)], [f.name for f in fields])

    for row in rows:
        some.append(row)
        total += size(row)
        if total >= CHARACTERS:
            yield batch()
            some, total = [], 0
    if some:
        yield batch()


class _Block:
    """Rows of one conversation that follow each other, in one task."""

    def __init__(self, entries: tuple[int, ...]):
        self.entries = entries
        self.roles, self.texts, self.initials, self.standings = [], [], [], []
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.turns, self.least, self.most, self.size = 0, None, None, 0

    def add(self, turn, role: str, text: str, mark: str, repeated: bool) -> None:
        fault = 0 if not mark else 1 if repeated else 2 if mark not in ".!?" else 3
        if fault < 3:
            self.counts[fault] += 1
        if self.roles and self.roles[-1][:1] + role[:1] not in ("su", "ua", "au"):
            self.counts[3] += 1
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)
        self.initials.append(" sua".find(role[:1] or " ") if role[:1] in "sua" else 0)
        self.standings.append((GONE, GONE, OPEN, FINE)[fault])
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn


def _blocks(rows: DataFrame, most: int, characters: int) -> DataFrame:
    """Blocks of the rows in their order, each with its summary; (task, place) is a block's place in the order."""
    turn, kind = rows.schema["turn"].dataType.simpleString(), rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, task int, place long, roles array<string>, texts array<string>, initials array<tinyint>, standings array<tinyint>, counts array<bigint>, turns long, least {turn}, most {turn}, costs array<bigint>, ranks array<int>"
    fields, by = _fields(schema), [(p, q) for p in range(4) for q in range(4)]

    def cut(batches):
        task, conv, now, place, first = TaskContext.get().partitionId(), None, None, 0, True

        def row():
            costs, ranks = summary(now.initials, now.standings, now.entries)
            return (conv, task, place, now.roles, now.texts, now.initials, now.standings, now.counts, now.turns, now.least, now.most, [costs.get(x, -1) for x in by], [ranks.get(x, -1) for x in by])

        for batch in batches:
            for c, turn, role, text, mark, before in zip(*(batch[x].to_pylist() for x in ("conv", "turn", "role", "text", "mark", "before")), strict=True):
                same = now is not None and c == conv
                if not same or len(now.roles) >= most or now.size >= characters:
                    if now is not None:
                        yield row()
                        place, first = place + 1, first and same
                    # only a task's first conversation may have begun before, so others are entered at the start
                    now, conv = _Block((START, SYSTEM, USER, ASSISTANT) if same or first else (START,)), c
                now.add(turn, role, text, mark, before)
        if now is not None:
            yield row()

    order = ("conv", "turn", "role", "text", "at")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda batches: _packed(cut(batches), fields, lambda r: 512 + 64 * len(r[3]) + sum(map(len, r[4]))), schema)


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """(conv, rows) of a stream that is sorted by conv; rows is an iterator that must be used up first."""
    rows = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("conv", *columns)), strict=True))
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        yield conv, (r[1:] for r in group)


def _walked(blocks: DataFrame) -> DataFrame:
    """For each block how it is entered and left and what is inserted at the end; on a conversation's first
    block its figures.  A task holds of a conversation four pointers for each of its blocks."""
    schema = "task int, place long, entered tinyint, left_in tinyint, added tinyint, figures array<bigint>"
    fields, columns = _fields(schema), ["task", "place", "counts", "turns", "least", "most", "costs", "ranks", "first", "last"]

    def walk(batches):
        for conv, rows in _runs(batches, columns):
            keys, parents, counts = [], [], np.zeros(4, np.int64)
            turns, least, most, before = 0, None, None, None
            costs, ranks = {START: 0}, {START: 0}
            for task, place, count, n, low, high, cost, rank, first, last in rows:
                keys.append((task, place))
                counts += count
                counts[3] += before is not None and before + first not in ("su", "ua", "au")
                before = last
                if low is not None:
                    turns += n - (low == most)
                    least, most = low if least is None else least, high
                best: dict = {}
                for state, c in costs.items():
                    for to in range(4):
                        if (more := cost[4 * state + to]) >= 0:
                            x = ((c + more, ranks[state], rank[4 * state + to]), state)
                            best[to] = min(best.get(to, x), x)
                order = {x: i for i, x in enumerate(sorted({b[0][1:] for b in best.values()}))}
                costs, ranks = {q: b[0][0] for q, b in best.items()}, {q: order[b[0][1:]] for q, b in best.items()}
                parents.append(tuple(best[q][1] if q in best else -1 for q in range(4)))
            total, _, added, state = min((costs[q] + INSERT * k, ranks[q], k, q) for q, k in ENDS if q in costs)
            ways = []
            for parent in reversed(parents):
                ways.append((parent[state], state))
                state = parent[state]
            ways.reverse()
            gaps = 0 if least is None else most - least + 1 - turns
            last = len(keys) - 1
            for i, (key, way) in enumerate(zip(keys, ways, strict=True)):
                yield (*key, *way, added * (i == last), [gaps, *counts.tolist(), total] if i == 0 else None)

    slim = blocks.select("conv", "task", "place", "counts", "turns", "least", "most", "costs", "ranks", F.left(F.element_at("roles", 1), F.lit(1)).alias("first"), F.left(F.element_at("roles", -1), F.lit(1)).alias("last"))
    # null is a conversation, and hashes as any value does
    return slim.repartition("conv").sortWithinPartitions("conv", "task", "place").mapInArrow(lambda batches: _packed(walk(batches), fields), schema)


def repaired(roles: list[str], texts: list[str], edits: str, state: int) -> list[tuple[str, str]]:
    """(role, text) of the turns that a block's edits leave."""
    out, at = [], 0
    for edit in edits:
        if edit == "I":
            state = _inserted(state, 1)
            out.append((NAMES[state], ""))
            continue
        if edit != "D":
            if edit == "K":
                state = " sua".find(roles[at][:1])
                out.append((roles[at], texts[at]))
            else:
                state = _inserted(state, 1)
                out.append((NAMES[state], texts[at]))
        at += 1
    return out


def repair(turns: DataFrame, id_col: str = "conv", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most: int = BLOCK, characters: int = CHARACTERS) -> tuple[DataFrame, DataFrame]:
    """(conversations, parts) of the repair of each conversation's rows.

    parts: conv, task, place (a block's place in its conversation), turns (role and text of the
    repaired turns).  conversations: conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256 of ``role:text`` joined by newlines.

    Rows are taken by turn, null turns first; rows of one turn by role, then by text.  Null roles
    and texts are taken as one space.  A null id is a conversation of its own.  Rows of one
    conversation, role and text are duplicates of the first of them, however many there are.
    A role is known by its first letter.  Texts and conversations may be of any length; the audit
    string and the digest of a conversation are made in one task each, as strings in order are,
    from a stream of its blocks.  Other columns are ignored; an empty table gives empty results.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))
    blocks = _kit.written(_blocks(_standing(rows), most, characters), "blocks")
    ways = _kit.written(_walked(blocks), "ways")
    kind = blocks.schema["conv"].dataType.simpleString()

    part = f"conv {kind}, task int, place long, audit string, turns array<struct<role: string, text: string>>, figures array<bigint>"
    of_part = _fields(part)

    def rebuild(batches):
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                conv, task, place, roles, texts, initials, standings, entered, left, added, figures = (x.as_py() for x in row)
                edits = audit(initials, standings, entered, left) + "I" * added
                yield conv, task, place, edits, [{"role": r, "text": t} for r, t in repaired(roles, texts, edits, entered)], figures

    told = blocks.select("conv", "task", "place", "roles", "texts", "initials", "standings").join(ways, ["task", "place"])
    told = told.select("conv", "task", "place", "roles", "texts", "initials", "standings", "entered", "left_in", "added", "figures")
    parts = _kit.written(told.mapInArrow(lambda batches: _packed(rebuild(batches), of_part, lambda r: 256 + 64 * len(r[4]) + sum(len(t["text"]) for t in r[4])), part), "repaired")
    whole = f"conv {kind}, {', '.join(f'{x} long' for x in FIGURES)}, audit string, repaired_sha256 string"
    of_whole = _fields(whole)

    def finish(batches):
        for conv, rows in _runs(batches, ["audit", "turns", "figures"]):
            edits, digest, between, own = [], hashlib.sha256(), "", None
            for piece, said, figures in rows:
                edits.append(piece)
                own = own or figures
                for turn in said:
                    digest.update(f"{between}{turn['role']}:{turn['text']}".encode())
                    between = "\n"
            yield conv, *own, "".join(edits), digest.hexdigest()

    done = parts.repartition("conv").sortWithinPartitions("conv", "task", "place").select("conv", "audit", "turns", "figures")
    return done.mapInArrow(lambda batches: _packed(finish(batches), of_whole, lambda r: 256 + len(r[-2])), whole), parts.select("conv", "task", "place", "turns")


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired_conversations(turns: DataFrame, rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """A row of figures, audit and digest for each conversation of ``turns``, after the repair of ``rows``
    (conv, turn, role, text); one without rows has zeros, an empty audit and the digest of nothing."""
    done, _ = repair(rows)
    every = turns.select(F.col(id_col).alias("of")).distinct()
    joined = every.join(done, F.col("of").eqNullSafe(F.col("conv")), "left")
    return joined.select(F.col("of").alias(id_col), *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in FIGURES), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
