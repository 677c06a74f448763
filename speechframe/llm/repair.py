"""Conversation repair: A* over the lattice of edits.

A conversation's rows, in order of turn, must become roles of the form
``(s?(ua)+)?`` by the cheapest edits: Keep (0), Rerole to user or assistant (1),
Delete (2; blank rows and duplicates must go), Insert an empty turn (5); a
truncated row that isn't deleted costs 5 more.  A node is (rows read, state of
the form); the heuristic is the suffix sum of what no path avoids, the deletion
of rows that must go and the lesser of deleting or paying for truncated ones.
It is consistent, so with the queue keyed by (cost plus heuristic, audit) the
first visit of a node has its least cost and, of these, the least audit.  An
audit isn't stored per node: nodes are the prefix tree of the audits, and two are
compared at their lowest common ancestor, found by jump pointers.

Two passes, each one shuffle on the conversation and a sort by turn: the first
reads rows as a stream, keeps a digest and a letter a row, and searches; the
second reads each conversation's audit and then its rows, applies the edits and
hashes, again as a stream.  So of a conversation of any size about a
kilobyte a row at most is ever in one task, never its texts; its letters must
meet there, as its audit is one value.

Defined results: null conversations are one conversation; null turns come
first; rows of one turn are ordered by role and text (code points); null roles
and texts are one space, so the row is blank; other roles can only be reroled or
deleted, a role counts by its initial; repeated rows are duplicates; extra
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_arrow, schema

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the form: nothing yet, after the system turn, after a user's, after an assistant's; where they lead by a turn's initial.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ENDS = (START, ASSISTANT)
#: The turn that a rerole or an insertion makes in a state.
MADE = ("user", "user", "assistant", "user")
OK, CUT, GO = range(3)
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"


class Audits:
    """The prefix tree of the edits tried: per node its parent, letter, depth and a jump pointer."""

    def __init__(self):
        self.parent, self.jump, self.depth, self.letter = array("q", [0]), array("q", [0]), array("q", [0]), bytearray(b" ")

    def add(self, parent: int, letter: str) -> int:
        jump = self.jump[parent]
        far = self.depth[parent] - self.depth[jump] == self.depth[jump] - self.depth[self.jump[jump]]
        self.parent.append(parent)
        self.jump.append(self.jump[jump] if far else parent)
        self.depth.append(self.depth[parent] + 1)
        self.letter.append(ord(letter))
        return len(self.parent) - 1

    def _up(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.jump[node] if self.depth[self.jump[node]] >= depth else self.parent[node]
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether a's letters come before b's; a prefix comes before what it begins."""
        d = min(self.depth[a], self.depth[b])
        x, y = self._up(a, d), self._up(b, d)
        if x == y:
            return self.depth[a] < self.depth[b]
        while self.parent[x] != self.parent[y]:
            x, y = (self.jump[x], self.jump[y]) if self.jump[x] != self.jump[y] else (self.parent[x], self.parent[y])
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        out = bytearray()
        while node:
            out.append(self.letter[node])
            node = self.parent[node]
        return out[::-1].decode()


class Entry:
    """A queue entry: cost plus heuristic, then audit."""

    __slots__ = ("f", "node", "cost", "row", "state", "audits")

    def __init__(self, f: int, node: int, cost: int, row: int, state: int, audits: Audits):
        self.f, self.node, self.cost, self.row, self.state, self.audits = f, node, cost, row, state, audits

    def __lt__(self, other: Entry) -> bool:
        return self.audits.less(self.node, other.node) if self.f == other.f else self.f < other.f


def cheapest(initials: str, faults: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of rows with these role initials and faults (OK, CUT, GO)."""
    n = len(faults)
    owed = array("q", bytes(8 * (n + 1)))
    for i in range(n - 1, -1, -1):
        owed[i] = owed[i + 1] + (DELETE if faults[i] == GO else min(DELETE, TRUNCATED) if faults[i] == CUT else 0)
    audits, done = Audits(), bytearray(4 * (n + 1))
    queue = [Entry(owed[0], 0, 0, 0, START, audits)]

    def push(e: Entry, letter: str, cost: int, row: int, state: int) -> None:
        if not done[4 * row + state]:
            total = e.cost + cost
            heapq.heappush(queue, Entry(total + owed[row], audits.add(e.node, letter), total, row, state, audits))

    while True:
        e = heapq.heappop(queue)
        if done[4 * e.row + e.state]:
            continue
        done[4 * e.row + e.state] = 1
        if e.row == n and e.state in ENDS:
            return e.cost, audits.text(e.node)
        made = NEXT[e.state][MADE[e.state][0]]
        push(e, "I", INSERT, e.row, made)
        if e.row < n:
            push(e, "D", DELETE, e.row + 1, e.state)
            if faults[e.row] != GO:
                charge = TRUNCATED if faults[e.row] == CUT else 0
                push(e, "R", REROLE + charge, e.row + 1, made)
                kept = NEXT[e.state].get(initials[e.row])
                if kept is not None:
                    push(e, "K", charge, e.row + 1, kept)


def spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) after damage drawn by crc32 of "conv_id:turn" modulo 20: 0 drops the row, 1 empties its text, 2 takes its sentence ends out, 3 repeats it, 4 makes it the user's."""
    draw = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), draw.alias("__draw"))
    rows = rows.withColumn("text", F.when(F.col("__draw") == 1, "").when(F.col("__draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("__draw") == 4, "user").otherwise(F.col("role")))
    copies = F.when(F.col("__draw") == 0, 0).when(F.col("__draw") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", "role", "text", copies.alias("copies"))


class Faults:
    """What the first pass keeps of a conversation while its rows go by."""

    def __init__(self):
        self.initials, self.faults, self.seen = [], bytearray(), set()
        self.counts, self.illegal, self.turns, self.first, self.last = [0, 0, 0], 0, 0, None, None

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        body = text.rstrip(BLANKS)
        kind = 0 if not body else 1 if key in self.seen else 2 if body[-1] not in ".!?" else None
        self.seen.add(key)
        if kind is not None:
            self.counts[kind] += 1
        self.faults.append(OK if kind is None else CUT if kind == 2 else GO)
        initial = role[:1] or " "
        self.illegal += bool(self.initials) and self.initials[-1] + initial not in LEGAL
        self.initials.append(initial)

    def row(self) -> tuple:
        self.seen.clear()
        cost, audit = cheapest("".join(self.initials), bytes(self.faults))
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (gaps, *self.counts, self.illegal, cost, audit)


class Repaired:
    """What the second pass keeps: where it is in the audit, the form's state, and the hash so far."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.any = audit, 0, START, hashlib.sha256(), False

    def emit(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any, self.state = True, NEXT[self.state][role[0]]

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.emit(MADE[self.state], "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            self.emit(role if edit == "K" else MADE[self.state], text)

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


PLAN = schema("conv_id long,gaps long,blank long,duplicate long,truncated long,illegal long,cost long,audit string")
RESULT = schema("conv_id long,gaps long,blank long,duplicate long,truncated long,illegal long,cost long,audit string,repaired_sha256 string")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def batches_of(rows: Iterator[tuple], like: pa.Schema, size: int = 4096, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of up to ``size`` rows, and of little more than ``most`` letters of audits."""
    some, letters = [], 0
    for r in rows:
        some.append(r)
        letters += len(r[7])
        if len(some) >= size or letters >= most:
            yield pa.RecordBatch.from_pylist([dict(zip(like.names, x)) for x in some], schema=like)
            some, letters = [], 0
    if some:
        yield pa.RecordBatch.from_pylist([dict(zip(like.names, x)) for x in some], schema=like)


def plans(rows: DataFrame) -> DataFrame:
    """The first pass over damaged or given ``rows`` (conv_id, turn, role, text, copies): faults, cost and audit of each conversation."""
    arrow = to_arrow_schema(PLAN)

    def search(all_rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, state = None, None
        for c, turn, role, text, copies in all_rows:
            if state is None or c != conv:
                if state is not None:
                    yield (conv, *state.row())
                conv, state = c, Faults()
            for _ in range(copies):
                state.add(turn, role, text)
        if state is not None:
            yield (conv, *state.row())

    ordered = rows.select("conv_id", "turn", "role", "text", "copies").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_arrow(ordered, lambda batches: batches_of(search(rows_of(batches)), arrow), PLAN)


def apply(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The second pass: `plans` with repaired_sha256. An audit comes before the rows of its conversation."""
    arrow, names = to_arrow_schema(RESULT), PLAN.names[1:]
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in names]
    audits = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(-1).alias("copies"), *names)
    both = rows.select("conv_id", "turn", "role", "text", "copies", *none).unionByName(audits).withColumn("later", F.col("copies") >= 0)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "later", "turn", "role", "text").drop("later")

    def edit(all_rows: Iterator[tuple]) -> Iterator[tuple]:
        head, state = None, None
        for c, _, role, text, copies, *values in all_rows:
            if copies < 0:
                if state is not None:
                    yield (*head, state.digest())
                head, state = (c, *values), Repaired(values[-1])
            for _ in range(copies):
                state.add(role, text)
        if state is not None:
            yield (*head, state.digest())

    return map_arrow(ordered, lambda batches: batches_of(edit(rows_of(batches)), arrow), RESULT)


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired turns of every conversation of ``rows`` (conv_id, turn, role, text and, optionally, copies: how often the row stands there)."""
    if "copies" not in rows.columns:
        rows = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), F.lit(1).alias("copies"))
    return apply(rows, plans(rows))


def _sql() -> str:
    """DuckDB SQL for `repair` of `damaged` conversations.

    The form's states are a list of four keys, the cost in eight digits and then the
    audit, so that least() is the cheapest and, of ties, the least audit; "~" can't be reached.
    Rows are folded over it, insertions before each and at the end.
    """

    def plus(key: str, cost: str, edit: str) -> str:
        return f"CASE WHEN {key} < '~' THEN lpad(CAST(CAST(substr({key}, 1, 8) AS INTEGER) + {cost} AS VARCHAR), 8, '0') || substr({key}, 9) || '{edit}' ELSE '~' END"

    def least(*keys: str) -> str:
        return f"least({', '.join(keys)})"

    def given(test: str, key: str) -> str:
        return f"CASE WHEN {test} THEN {key} ELSE '~' END"

    # States 1 to 4 as above; a user's turn follows 1, 2 and 4, an assistant's 3.
    cut, user = "IF(r.f = 't', 5, 0)", [1, 2, 4]
    inserted = lambda k: f"[{k}[1], {k}[2], {least(f'{k}[3]', *(plus(f'{k}[{i}]', '5', 'I') for i in user))}, {least(f'{k}[4]', plus(f'{k}[3]', '5', 'I'))}]"
    to_user = least(*(plus(f"z[{i}]", f"1 + {cut}", "R") for i in user), *(given("r.i = 'u'", plus(f"z[{i}]", cut, "K")) for i in user))
    to_assistant = least(plus("z[3]", f"1 + {cut}", "R"), given("r.i = 'a'", plus("z[3]", cut, "K")))
    keep = "r.f IN ('o', 't')"
    read = f"""[{plus('z[1]', '2', 'D')}, {least(plus('z[2]', '2', 'D'), given(f"{keep} AND r.i = 's'", plus('z[1]', cut, 'K')))},
                 {least(plus('z[3]', '2', 'D'), given(keep, to_user))}, {least(plus('z[4]', '2', 'D'), given(keep, to_assistant))}]"""
    fold = "acc.k"
    for i in range(3):
        fold = f"list_transform([{fold}], lambda k{i}: {inserted(f'k{i}')})[1]"
    return rf"""
    WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
    crc AS (SELECT key, list_reduce(list_transform(range(CAST(length(key) AS BIGINT)), lambda i: CAST(ascii(substr(key, CAST(i + 1 AS INTEGER), 1)) AS BIGINT)),
        lambda c, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, xor(c, x)), 4294967295::BIGINT) AS crc FROM (SELECT DISTINCT key FROM k)),
    g AS (SELECT k.*, xor(crc, 4294967295::BIGINT) % 20 AS x FROM k JOIN crc USING (key)),
    d AS (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role, CASE x WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                 unnest(range(CASE x WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM g),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM d),
    f AS (SELECT *, substr(role, 1, 1) AS i, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prev,
                 CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
                      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 't' ELSE 'o' END AS fault FROM o),
    c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
                 count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE prev IS NOT NULL AND prev || i NOT IN ('su', 'ua', 'au')) AS illegal,
                 list({{'i': i, 'f': fault}} ORDER BY pos) AS rows, list(role ORDER BY pos) AS roles, list(text ORDER BY pos) AS texts FROM f GROUP BY conv_id),
    s AS (SELECT *, list_reduce(list_concat(rows, [{{'i': '', 'f': 'end'}}]), lambda acc, r: list_transform([{fold}], lambda z: {{'k': CASE WHEN r.f = 'end' THEN z ELSE {read} END}})[1],
                                {{'k': ['00000000', '~', '~', '~']}}).k AS k FROM c),
    b AS (SELECT *, CAST(substr(least(k[1], k[4]), 1, 8) AS BIGINT) AS cost, substr(least(k[1], k[4]), 9) AS audit FROM s),
    r AS (SELECT *, list_reduce(string_split(audit, ''), lambda a, e: {{'n': a.n + IF(e = 'I', 0, 1), 'last': CASE e WHEN 'D' THEN a.last WHEN 'K' THEN substr(roles[a.n + 1], 1, 1) ELSE IF(a.last = 'u', 'a', 'u') END,
                 'out': IF(e = 'D', a.out, list_append(a.out, CASE WHEN e = 'K' THEN roles[a.n + 1] WHEN a.last = 'u' THEN 'assistant' ELSE 'user' END || ':' || IF(e = 'I', '', texts[a.n + 1])))}},
                 {{'n': 0, 'last': '', 'out': CAST([] AS VARCHAR[])}}).out AS out FROM b)
    SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(out, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM i.conv_id"""


ORACLE_SQL = _sql()
