"""Conversation repair against enumeration of all edits and against a plain dynamic program."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taxaspark.llm import repair
from taxaspark.llm.queries import QUERIES, damaged

EMPTY = hashlib.sha256(b"").hexdigest()


def faults_of(rows: list[tuple]) -> list[str]:
    """Of (role, text) rows: f(ine), b(lank), d(uplicate) or t(runcated)."""
    seen, out = set(), []
    for role, text in rows:
        full = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("b" if not full else "d" if (role, text) in seen else "t" if full[-1] not in ".!?" else "f")
        seen.add((role, text))
    return out


def apply_edits(audit: str, rows: list[tuple], faults: list[str]) -> tuple[int, list[tuple]] | None:
    """(cost, repaired rows), or None if the edits are not allowed. What follows is forced: after u comes a."""
    out, k, cost = [], 0, 0
    for e in audit:
        last = out[-1][0][:1] if out else ""
        forced = "assistant" if last == "u" else "user"
        if e == "I":
            out.append((forced, ""))
            cost += 5
            continue
        if k == len(rows):
            return None
        (role, text), fault = rows[k], faults[k]
        k += 1
        if e == "D":
            cost += 2
            continue
        if fault in "bd":
            return None
        cost += (5 if fault == "t" else 0) + (e == "R")
        out.append((role if e == "K" else forced, text))
    initials = "".join(r[:1] or "-" for r, _ in out)
    return (cost, out) if k == len(rows) and re.fullmatch("(s?(ua)+)?", initials) else None


def by_enumeration(rows):
    faults = faults_of(rows)
    best = None
    for n in range(len(rows), len(rows) + 3):
        for letters in itertools.product("DIKR", repeat=n):
            audit = "".join(letters)
            if len(audit) - audit.count("I") == len(rows) and (got := apply_edits(audit, rows, faults)):
                best = min(best or (1 << 30, ""), (got[0], audit))
    return best


def by_rows(rows):
    """(cost, audit): best (cost, audit) from each state at each row, with up to three inserts."""
    faults, step, go = faults_of(rows), {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}, {"": "u", "s": "u", "u": "a", "a": "u"}

    def with_inserts(best):
        for _ in range(3):
            best = {s: min(best[s], (best[go[s]][0] + 5, "I" + best[go[s]][1])) for s in best}
        return best

    best = with_inserts({"": (0, ""), "a": (0, ""), "s": (1 << 30, ""), "u": (1 << 30, "")})
    for (role, _), fault in zip(reversed(rows), reversed(faults)):
        new = {}
        for s in best:
            found = [(best[s][0] + 2, "D" + best[s][1])]
            if fault not in "bd":
                more = 5 if fault == "t" else 0
                if to := step.get((s, role[:1])):
                    found.append((best[to][0] + more, "K" + best[to][1]))
                to = go[s]
                found.append((best[to][0] + more + 1, "R" + best[to][1]))
            new[s] = min(found)
        best = with_inserts(new)
    return best[""]


def expected(rows: list[tuple]) -> dict:
    """Of a conversation's (turn, role, text) rows after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns, own = [t for t, _, _ in rows if t is not None], [(r, x) for _, r, x in rows]
    faults = faults_of(own)
    cost, audit = by_rows(own)
    again, out = apply_edits(audit, own, faults)
    assert again == cost
    pairs = [(a[:1] + b[:1]) for (a, _), (b, _) in zip(own, own[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired": [f"{r}:{x}" for r, x in out],
    }


ROW = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.sampled_from(["", "one.", "two", "a!", " \n", "x? "]))


@given(st.lists(ROW, max_size=4))
@settings(max_examples=80, deadline=None)
def test_plain_program_is_right(rows):
    assert by_rows(rows) == by_enumeration(rows)


def symbols_of(rows):
    return "".join(chr(65 + 4 * ("sua".find(r[:1]) if r[:1] and r[:1] in "sua" else 3) + "fbdt".index(f)) for (r, _), f in zip(rows, faults_of(rows)))


@given(st.lists(st.tuples(ROW, st.integers(1, 40)), max_size=8), st.integers(1, 7))
@settings(max_examples=150, deadline=None)
def test_runs_as_rows(runs, size):
    rows = [(role, f"{k}{text}" if text.strip() else text) for k, (role, text) in enumerate(r for r, n in runs for _ in range(n))]
    s = symbols_of(rows)
    edits, cost, _, _ = repair.solve(s)
    assert (cost, edits) == by_rows(rows)
    parts = [s[k : k + size] for k in range(0, len(s), size)]
    if parts:
        pieces, states, again = repair.solve_parts(parts)
        assert ("".join(pieces), again) == (edits, cost)
        whole = [(k * size + r, e, role) for k, (p, e_, q) in enumerate(zip(parts, pieces, states)) for r, _, e, role in repair.moves(e_, p, q)]
        assert whole == [(r, e, role) for r, _, e, role in repair.moves(edits, s)]


def test_long_runs():
    n = 1_000_003
    edits, cost, _, _ = repair.solve.__wrapped__(chr(65 + 4) * n)  # fine user rows only
    assert cost == n // 2 + 2 and len(edits) == n
    assert edits[-4:].count("R") == 2 or "D" in edits


CASES = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "user", "Hi."), (1, 2, "user", "Hi."), (1, None, "system", "Be kind!"), (2, None, None, None),
    (3, 5, "assistant", "Alone."), (4, 1, "user", "cut off"), (4, 9, "assistant", "Right?"), (None, 1, "user", "No id."), (None, 2, "assistant", "None?"), (5, 1, "tool", "z!"), (5, 1, "tool", "y!"),
]


def rows_of(spark, cases):
    return spark.createDataFrame([(*c, "extra") for c in cases], "conv_id bigint, turn bigint, role string, text string, `conv.id` string")


def grouped(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return out


def check(spark, cases):
    out = repair.repair(rows_of(spark, cases))
    audits = {r["conv_id"]: r for r in out.audits.collect()}
    turns = defaultdict(list)
    for r in out.turns.orderBy("conv_id", "pos", "place").collect():
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    wanted = {c: expected(rows) for c, rows in grouped(cases).items()}
    assert set(audits) == set(wanted)
    for c, w in wanted.items():
        assert turns[c] == w.pop("repaired")
        assert {k: audits[c][k] for k in w} == w
    hashed = {r["conv_id"]: r["sha256"] for r in repair.digests(out.turns, repair.F.concat("role", repair.F.lit(":"), "text")).collect()}
    assert hashed == {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in turns.items() if t}


def test_small_cases(spark):
    check(spark, CASES)
    none = repair.repair(rows_of(spark, CASES).limit(0))
    assert none.audits.count() == none.turns.count() == 0


@pytest.mark.parametrize("long", [4, 4096])
def test_one_conversation_over_many_tasks(spark, monkeypatch, long):
    """Half of all rows are one conversation's, with repeats far apart; equal rows too."""
    monkeypatch.setattr(repair, "LONG", long)
    roles = ["user", "user", "assistant", "system", "assistant", "tool", "user"]
    hot = [(7, k // 3 if k % 11 else None, roles[k * k % 7], f"text {k % 400}" + "." * (k % 3 > 0)) for k in range(3000)]
    same = [(8, 1, "user", "Again and again.")] * 800
    rest = [(100 + k // 6, k % 6, roles[k % 7], f"t{k % 3}" + "!" * (k % 4 > 0)) for k in range(2500)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, hot + same + rest)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def damage(conv, turn, role, text):
    key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
    role, text = " " if role is None else role, " " if text is None else text
    case = zlib.crc32(key.encode()) % 20
    text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
    return [(conv, turn, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)


def test_damage_of_nulls(spark):
    cases = [(c, t, r, x) for c in (1, None, 12) for t in (None, *range(9)) for r, x in (("user", "A. B!"), (None, None))]
    got = sorted(map(tuple, damaged(rows_of(spark, cases).drop("`conv.id`")).select("conv_id", "turn", "role", "text").collect()), key=repr)
    assert got == sorted((d for c in cases for d in damage(*c)), key=repr)


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after = grouped(d for r in rows for d in damage(*r))
    got = {r["conv_id"]: r.asDict() for r in QUERIES["op11_conversation_repair"](spark, small).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        w = expected(after.get(conv, []))
        lines = w.pop("repaired")
        assert r["repaired_sha256"] == (hashlib.sha256("\n".join(lines).encode()).hexdigest() if lines else EMPTY)
        assert {k: r[k] for k in w} == w
