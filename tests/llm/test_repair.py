import hashlib
import itertools
import random

import pytest

from rarespark.llm import repair
from rarespark.llm.repair import apply_edits, cheapest_edits, edits_between_states, join_pieces, repair_conversations, repaired_digests, repaired_turns

COST = {"K": 0, "R": 1, "D": 2, "I": 5}


def legal(initials):
    body = initials[1:] if initials.startswith("s") else initials
    return initials == "" or (body and body == "ua" * (len(body) // 2))


def brute_edits(codes):
    """All ways with at most one insert before each row and at the end, tried one by one."""
    n = len(codes) // 2
    best = None
    for puts in itertools.product(["", "u", "a"], repeat=n + 1):
        if 5 * sum(map(bool, puts)) > 2 * n:
            continue  # dearer than deleting all
        choices = []
        for i in range(n):
            initial, fault = codes[2 * i], codes[2 * i + 1]
            extra = 5 * (fault == "3")
            choices.append([("D", "", 2)] + ([] if fault in "12" else [("K", initial, extra), ("R", "u", 1 + extra), ("R", "a", 1 + extra)]))
        for way in itertools.product(*choices):
            audit = initials = ""
            for put, (letter, initial, _) in zip(puts, [*way, ("", "", 0)]):
                audit, initials = audit + "I" * bool(put) + letter, initials + put + initial
            if legal(initials):
                found = (5 * sum(map(bool, puts)) + sum(w[2] for w in way), audit)
                best = found if best is None else min(best, found)
    return best


def all_codes(n):
    return ("".join(c) for c in itertools.product([a + f for a in "suax" for f in "0123"], repeat=n))


def test_edits_against_brute_force():
    for n in (0, 1, 2):
        for codes in all_codes(n):
            assert cheapest_edits(codes) == brute_edits(codes), codes
    draw = random.Random(2)
    for _ in range(300):
        codes = "".join(draw.choice("suax") + draw.choice("0000123") for _ in range(draw.randint(3, 5)))
        assert cheapest_edits(codes) == brute_edits(codes), codes


def test_pieces_give_the_same_edits():
    draw = random.Random(3)
    for _ in range(150):
        codes = "".join(draw.choice("suuaaax") + draw.choice("00000123") for _ in range(draw.randint(2, 40)))
        rows = draw.randint(1, 7)
        pieces = [codes[i : i + 2 * rows] for i in range(0, len(codes), 2 * rows)]
        cost, parts = join_pieces([edits_between_states(p) for p in pieces])
        assert (cost, "".join(parts)) == cheapest_edits(codes)
        assert [sum(c != "I" for c in p) for p in parts] == [len(p) // 2 for p in pieces]


def brute(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)}"""
    out, low = {}, -(1 << 63)
    for conv in {r[0] for r in rows}:
        own = sorted(((low if t is None else t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv))
        seen, codes, faults = set(), "", [0, 0, 0, 0]
        for _, role, text in own:
            said = text.rstrip(" \t\n\r\x0b\x0c")
            fault = 1 if not said else 2 if (role, text) in seen else 3 if said[-1] not in ".!?" else 0
            seen.add((role, text))
            faults[fault] += 1
            codes += (role[:1] if role[:1] in ("s", "u", "a") else "x") + str(fault)
        turns = {t for t, _, _ in own if t != low}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = cheapest_edits(codes)
        kept, _ = apply_edits([(r, x) for _, r, x in own], audit)
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
        out[conv] = (gaps, *faults[1:], illegal, cost, audit, digest)
    return out


def conversations(draw, n):
    rows = []
    for conv in range(n):
        for turn in range(draw.choice([1, 3, 6, 6, 30])):
            text = draw.choice(["Hello.", "Why?", "no end", "", " \t", f"turn {turn}.", "日本 é!"])
            row = (conv, None if draw.random() < 0.1 else turn - 3, draw.choice(["user", "assistant", "system", "tool", None, ""]), None if draw.random() < 0.1 else text)
            rows += [row] * draw.choice([1, 1, 1, 2])
    return rows + [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (900, None, None, None), (900, None, None, None)]


@pytest.mark.parametrize("piece_rows", [128, 3])
def test_against_brute_force(spark, piece_rows):
    rows = conversations(random.Random(4), 40)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.repartition(4).selectExpr("*", "1 AS seg", "2 AS _conv", "3 AS codes")
    reports, pieces, audits = repair_conversations(df, piece_rows)
    digests = {r.conv_id: r.repaired_sha256 for r in repaired_digests(pieces, audits).collect()}
    got = {r.conv_id: (*r[1:], digests[r.conv_id]) for r in reports.collect()}
    assert got == brute(rows)
    turns = {}
    for r in repaired_turns(pieces, audits).orderBy("conv_id", "seg", "sub", "place").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(turns.get(c, [])).encode()).hexdigest() for c in got} == digests


def test_long_and_empty(spark, monkeypatch):
    monkeypatch.setattr(repair, "_PIECE_BYTES", 100)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "long " * 30 + f"{t}.") for t in range(20)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    reports, pieces, audits = repair_conversations(df)
    assert pieces.count() == 20 and reports.first().audit == "K" * 20 and reports.first().cost == 0
    assert repaired_turns(pieces, audits).count() == 20
    reports, pieces, audits = repair_conversations(df.where("conv_id = 5"))
    assert reports.count() == repaired_digests(pieces, audits).count() == 0
