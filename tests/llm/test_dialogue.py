"""Conversation repair against all edits of small conversations, and in segments against whole."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.llm import dialogue

COST = {"K": 0, "R": 2, "D": 3, "I": 2}


def every_edit(rows, most_inserts):
    """(cost, audit, repaired) of all edits: rows are (role, text, fault)."""
    for letters in itertools.product("KRD", repeat=len(rows)):
        for inserts in itertools.product(range(most_inserts + 1), repeat=len(rows) + 1):
            if sum(inserts) > most_inserts:
                continue
            for roles in itertools.product(("user", "assistant"), repeat=sum(inserts) + letters.count("R")):
                cost, audit, made, pick = 0, "", [], iter(roles)
                for i in range(len(rows) + 1):
                    for _ in range(inserts[i]):
                        made.append((next(pick), ""))
                        audit, cost = audit + "I", cost + 2
                    if i < len(rows):
                        role, text, fault = rows[i]
                        if letters[i] != "D":
                            if fault in ("blank", "duplicate"):
                                break
                            made.append((role if letters[i] == "K" else next(pick), text))
                            cost += fault == "truncated"
                        audit, cost = audit + letters[i], cost + COST[letters[i]]
                else:
                    if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in made)):
                        yield cost, audit, made


def fault_of(rows):
    out, seen = [], set()
    for role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def test_all_edits_of_small_conversations():
    rng = np.random.default_rng(5)
    for _ in range(60):
        rows = [(("system", "user", "assistant", "tool", "")[rng.integers(5)], ("One.", "two", " \t", "Three!")[rng.integers(4)]) for _ in range(rng.integers(0, 5))]
        judged = fault_of(rows)
        want = min((c, a) for c, a, _ in every_edit(judged, 2 if len(rows) < 4 else 1))
        codes = [(r[:1], f in ("blank", "duplicate"), f == "truncated") for r, _, f in judged]
        got = dialogue.Lattice(codes).best(dialogue.BEGIN, dialogue.FINAL)
        # more inserts than tried here may be cheaper or equal
        assert got <= want
        if got != want:
            assert got[1].count("I") > (2 if len(rows) < 4 else 1)


def plain(rows):
    """The result for one conversation's rows (turn, role, text), by a plain table of costs and texts."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    judged = fault_of([(role, text) for _, role, text in rows])
    codes = [(r[:1], f in ("blank", "duplicate"), f == "truncated") for r, _, f in judged]
    best = {0: (0, "")}

    def inserted(states):
        for _ in range(3):
            for s, (c, a) in list(states.items()):
                to = dialogue.MADE[s]
                states[to] = min(states.get(to, (9e9, "")), (c + 2, a + "I"))
        return states

    best = inserted(best)
    for initial, gone, short in codes:
        nxt = {}
        for s, (c, a) in best.items():
            steps = [(3, "D", s)]
            if not gone:
                steps.append((2 + short, "R", dialogue.MADE[s]))
                if s in dialogue.KEPT.get(initial, {}):
                    steps.append((0 + short, "K", dialogue.KEPT[initial][s]))
            for more, letter, to in steps:
                nxt[to] = min(nxt.get(to, (9e9, "")), (c + more, a + letter))
        best = inserted(nxt)
    cost, audit = min(best[s] for s in dialogue.FINAL if s in best)
    made = dialogue.apply_audit(audit, [(role, text) for _, role, text in rows])
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in made).encode()).hexdigest(),
    )


@pytest.fixture(scope="module")
def talks(spark):
    rng = np.random.default_rng(9)
    rows = []
    for conv in [None, *range(30)]:
        for t in range(rng.integers(1, 40) if conv else 150):
            turn = None if rng.integers(20) == 0 else int(t + rng.integers(2))
            rows.append((conv, turn, (None, "system", "user", "assistant", "assistant", "user")[rng.integers(6)], (None, "Yes.", "no", "", f"text {t}!", f"T {t}.", f"ü {t}?")[rng.integers(7)], "x"))
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, COST string").repartition(3)


def whole(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_segments_equal_whole_conversations(spark, talks):
    rows, df = talks
    want = {}
    for conv, turn, role, text, _ in rows:
        want.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    want = {k: plain(v) for k, v in want.items()}
    assert whole(dialogue.Repair(df).summary()) == want
    cut = dialogue.Repair(df, long_rows=10, segment=3, fan=2)
    assert cut.most > 100 and whole(cut.summary()) == want
    assert whole(dialogue.Repair(df, long_rows=0, segment=1, fan=3).summary()) == want
    for repair in (cut, dialogue.Repair(df)):
        turns = {}
        for r in sorted(repair.turns().collect(), key=lambda r: (r["pos"], r["place"])):
            turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        for conv, w in want.items():
            assert hashlib.sha256("\n".join(turns.get(conv, [])).encode()).hexdigest() == w[-1]


def test_damage_and_lost_conversations(spark, talks):
    rows, df = talks
    want = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text, _ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert whole(dialogue.Repair(dialogue.damage(df)).summary()) == {k: plain(v) for k, v in want.items()}
    gone = dialogue.damage(df).withColumn("lost", F.lit(True))
    assert set(whole(dialogue.Repair(gone).summary()).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert dialogue.Repair(dialogue.damage(df.filter("false"))).summary().count() == 0
