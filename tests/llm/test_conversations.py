"""Operator 13 against an exhaustive search over all edits."""

import hashlib
import random
import re
from functools import lru_cache
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from foldwise.llm.conversations import DELETE, Repair, Turn, damage, repair_report, repaired_turns
from tests.llm.helpers import CLASHES, SF, table

PATTERN = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, repaired lines) by trying everything; rows are (role, text, fault)."""
    @lru_cache(maxsize=None)
    def rest(i, state):
        """Least (cost, audit, lines) from row i on."""
        found = []
        if i == len(rows) and state in "0a":
            found.append((0, "", ()))
        for initial, name in (("u", "user"), ("a", "assistant")):
            if (state, initial) in {("0", "u"), ("s", "u"), ("a", "u"), ("u", "a")} and budget[0]:
                budget[0] -= 1
                cost, audit, lines = rest(i, initial)
                found.append((cost + 5, "I" + audit, (name + ":",) + lines))
                budget[0] += 1
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, lines = rest(i + 1, state)
            found.append((cost + 2, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                for letter, price, new in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if (state, new[:1]) in {("0", "u"), ("s", "u"), ("a", "u"), ("u", "a"), ("0", "s")} and (
                            letter == "K" or new[:1] != "s"):
                        cost, audit, lines = rest(i + 1, new[0])
                        found.append((cost + price + 5 * (fault == "truncated"), letter + audit, (f"{new}:{text}",) + lines))
        return min(found) if found else (10 ** 9, "", ())

    budget = [4]
    rest.cache_clear()
    return rest(0, "0")


def cheapest_listed(rows, inserts=2):
    """The same by listing every edit string: no dynamic programming at all."""
    options = [[]]
    for role, text, fault in rows:
        edits = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            cut = 5 * (fault == "truncated")
            edits += [("K", cut, f"{role}:{text}"), ("R", 1 + cut, f"user:{text}"), ("R", 1 + cut, f"assistant:{text}")]
        options = [o + [e] for o in options for e in edits]
    best = None
    extra = [("I", 5, "user:"), ("I", 5, "assistant:")]
    level = options
    for _ in range(inserts + 1):
        for o in level:
            lines = [line for _, _, line in o if line is not None]
            kept_s = [letter for letter, _, line in o if line is not None and line[:1] == "s"]
            if PATTERN.fullmatch("".join(line[:1] if line[:1] != ":" else "?" for line in lines)) and all(x == "K" for x in kept_s):
                key = sum(p for _, p, _ in o), "".join(x for x, _, _ in o), tuple(lines)
                best = key if best is None or key < best else best
        level = [o[:i] + [e] + o[i:] for o in level for i in range(len(o) + 1) for e in extra]
    return best


def searched(rows):
    out = []
    search = Repair(out.append)
    most = 0
    for role, text, fault in rows:
        search.push(Turn(None, role, text, fault))
        most = max(most, search.unresolved())
    cost = search.finish()
    assert search.unresolved() == 0
    lines = tuple(f"{e.role}:{e.row.text if e.row else ''}" for e in out if e.role is not None)
    return (cost, "".join(e.letter for e in out), lines), most


def drawn(seed, length):
    draw = random.Random(seed)
    return [(draw.choice(["user", "assistant", "system", "tool", "", "User", "s", "a"]), f"t{i}.",
             draw.choice(["", "", "", "truncated", "blank", "duplicate"])) for i in range(length)]


@pytest.mark.parametrize("seed", range(60))
def test_search_against_every_edit_string(seed):
    rows = drawn(seed, seed % 5)
    assert searched(rows)[0] == cheapest_listed(rows)


@pytest.mark.parametrize("seed", range(150))
def test_search_against_dynamic_program(seed):
    rows = drawn(1000 + seed, 5 + seed % 9)
    assert searched(rows)[0] == cheapest(rows)


def test_memory_follows_the_unresolved_rows():
    turns = [("user", f"q{i}?", "") if i % 2 == 0 else ("assistant", f"a{i}.", "") for i in range(4000)]
    (cost, audit, _), most = searched(turns)
    assert (cost, audit) == (0, "K" * 4000) and most < 20
    noisy = [(r, t, f if i % 7 else "truncated") for i, (r, t, f) in enumerate(turns)]
    assert searched(noisy)[1] < 60
    (cost, audit, _), most = searched([("user", "", "blank")] * 3000)
    assert (cost, audit) == (3000 * DELETE, "D" * 3000) and most < 20


def test_unresolved_ties_are_compared_whole():
    """Every row needs a role: two survivors differ from the first row on and tie at the end."""
    rows = [("tool", f"t{i}.", "") for i in range(41)]
    (cost, audit, _), most = searched(rows)
    assert (cost, audit) == (42, "D" + "R" * 40) and most >= 41


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out.setdefault(conv, [])
        if hit == 0:
            continue
        if hit == 4:
            role = "user"
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out[conv] += [(turn, role, text)] * (2 if hit == 3 else 1)
    return out


def plain_report(rows):
    out = []
    for conv, kept in damaged(rows).items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in kept:
            body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else
                          "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for t, _, _ in kept if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, lines = cheapest([(r, t, f) for (_, r, t), f in zip(kept, faults)])
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"),
                    faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def report(df):
    return sorted(map(tuple, repair_report(damage(df)).collect()), key=str)


def test_table_against_brute_force(spark):
    df = table(spark, "conversations", SF)
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert report(df) == plain_report(rows)


def test_awkward_table(spark):
    draw = random.Random(3)
    rows = [(draw.choice([1, 2, 3, None]), draw.choice([None, 0, 1, 2, 3, 9]), draw.choice(["user", "assistant", "system", None, ""]),
             draw.choice([None, "", " \t\x0b", "Fine.", "Cut off", "Fine.\n", "é!", "x" * 50_000 + "?"])) for _ in range(40)]
    rows += rows[:5] + [(77, 4, "user", "alone."), (78, None, None, None), (5, 2 ** 40, "user", "a."), (5, -3, "assistant", "b.")]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(c).alias(c) for c in [*CLASHES, "alive", "fault", "role_", "edit"]])
    assert report(df) == plain_report(rows)


def test_dropped_conversation_keeps_its_row(spark):
    turn = next(t for t in range(1000) if crc32(f"6:{t}".encode()) % 20 == 0)
    got = report(spark.createDataFrame([(6, turn, "user", "Hi.")], SCHEMA))
    assert got == [(6, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert report(df) == [] and repaired_turns(df).collect() == []


def test_repaired_turns_are_the_text_of_the_digest(spark):
    df = damage(table(spark, "conversations", SF)).filter("alive").drop("alive")
    want = {r["conv_id"]: r for r in repair_report(damage(table(spark, "conversations", SF))).collect()}
    turns = {}
    for r in repaired_turns(df).collect():
        turns.setdefault(r["conv_id"], []).append(r)
    for conv, rows in turns.items():
        kept = sorted((r for r in rows if r["place"] is not None), key=lambda r: r["place"])
        assert [r["place"] for r in kept] == list(range(len(kept)))
        assert PATTERN.fullmatch("".join(r["role"][0] for r in kept))
        text = "\n".join(f"{r['role']}:{r['text']}" for r in kept)
        assert hashlib.sha256(text.encode()).hexdigest() == want[conv]["repaired_sha256"]
        assert sorted(r["edit"] for r in rows) == sorted(want[conv]["audit"])
