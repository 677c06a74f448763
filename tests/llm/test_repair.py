"""Repair against exhaustive search, and the whole query against a plain loop."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from speechframe.llm import repair

FORM = re.compile(r"(s?(ua)+)?\Z")


def by_tables(initials, faults):
    """The cheapest (cost, audit) by a plain table over prefixes, with strings."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "")}

    def relax(b):
        for _ in range(4):
            for st, (c, a) in list(b.items()):
                to = "a" if st == "u" else "u"
                b[to] = min(b.get(to, (10**9, "")), (c + 5, a + "I"))
        return b

    for x, f in zip(initials, faults):
        new = {}

        def put(st, v):
            new[st] = min(new.get(st, (10**9, "")), v)

        for st, (c, a) in relax(best).items():
            put(st, (c + 2, a + "D"))
            if f != repair.GO:
                more = 5 if f == repair.CUT else 0
                put("a" if st == "u" else "u", (c + 1 + more, a + "R"))
                if x in step[st]:
                    put(step[st][x], (c + more, a + "K"))
        best = new
    return min(v for st, v in relax(best).items() if st in ("", "a"))


def by_trying(initials, faults):
    """All edit strings, up to two insertions in a row."""
    best = (10**9, "")

    @lru_cache(None)
    def roles_ok(s):
        return FORM.match(s)

    def go(i, cost, audit, roles, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(initials) and roles_ok(roles):
            best = min(best, (cost, audit))
        if inserted < 2:
            for r in "ua":
                go(i, cost + 5, audit + "I", roles + r, inserted + 1)
        if i < len(initials):
            go(i + 1, cost + 2, audit + "D", roles, 0)
            if faults[i] != repair.GO:
                more = 5 if faults[i] == repair.CUT else 0
                go(i + 1, cost + more, audit + "K", roles + initials[i], 0)
                for r in "ua":
                    go(i + 1, cost + 1 + more, audit + "R", roles + r, 0)

    go(0, 0, "", "", 0)
    return best


def test_search_like_trying_all():
    r = random.Random(3)
    for _ in range(120):
        n = r.randrange(5)
        x, f = "".join(r.choices("suax", k=n)), bytes(r.choices(range(3), weights=[6, 2, 1], k=n))
        assert repair.cheapest(x, f) == by_trying(x, f), (x, f)


def test_search_like_tables():
    r = random.Random(4)
    for _ in range(1500):
        n = r.choice([1, 3, 8, 20, 60])
        x, f = "".join(r.choices("suax ", weights=[1, 6, 6, 1, 1], k=n)), bytes(r.choices(range(3), weights=[8, 2, 1], k=n))
        assert repair.cheapest(x, f) == by_tables(x, f), (x, f)


def test_a_very_long_conversation():
    x, f = "ua" * 5000 + "u", bytes(10_001)
    assert repair.cheapest(x, f) == (2, "K" * 10_000 + "D")


def brute(rows):
    """rows (conv, turn, role, text): the contract, row by row."""
    out = []
    for conv in {r[0] for r in rows}:
        after = []
        for _, t, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if t is None else t}".encode()) % 20
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            after += [(t is not None, t or 0, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        after.sort()
        seen, faults, counts = set(), [], [0, 0, 0]
        for _, _, role, text in after:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            k = 0 if not ink else 1 if (role, text) in seen else 2 if ink[-1] not in ".!?" else 3
            seen.add((role, text))
            faults.append((repair.GO, repair.GO, repair.CUT, repair.OK)[k])
            if k < 3:
                counts[k] += 1
        turns = {x[1] for x in after if x[0]}
        x = [r[2][:1] for r in after]
        cost, audit = by_tables([c or " " for c in x], faults)
        made, last, i = [], "", 0
        for e in audit:
            role = after[i][2] if e == "K" else "assistant" if last == "u" else "user"
            if e != "D":
                made.append(f"{role}:{'' if e == 'I' else after[i][3]}")
                last = role[0]
            i += e != "I"
        assert FORM.match("".join(m[0] for m in made))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, sum(a + b not in ("su", "ua", "au") for a, b in zip(x, x[1:])), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=repr)


def some(seed, n=60):
    r = random.Random(seed)
    return [(c, t if r.random() < 0.95 else None, r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), r.choice(["Yes.", "no", "", " \n", "Why?\t", "ö!", None, "　", f"t{t}."]))
            for c in [None, *range(n)] for t in range(-1, r.randrange(8))]


@pytest.mark.parametrize("rows", [
    [], [(1, None, None, None)], [(1, 0, "user", "x" * 200_000), (1, 1, "assistant", "ok.")], [(5, k, "user", "same.") for k in range(50)], [(7, 3, r, t) for r in ("user", "assistant") for t in ("a.", "b.", "a.")],
    some(1), some(2), some(3),
])
def test_like_the_contract(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, copies int")
    got = repair.repair(repair.damaged(df))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_rows_as_given(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Again."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Hm."), (3, 0, "system", "Be."), (3, 1, "user", "Go.")]
    got = {r.conv_id: (r.cost, r.audit) for r in repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: (2, "DKK"), 2: (2, "D"), 3: (2, "RR")}
