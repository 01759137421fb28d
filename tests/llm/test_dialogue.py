"""Conversation repair against trying every edit."""

import random

import pytest

from captionloom.llm import dialogue
from tests.llm import brute
from tests.llm.test_operators import check

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"
FAULTS = {"": dialogue.SOUND, "blank": dialogue.BLANK, "duplicate": dialogue.DUPLICATE, "truncated": dialogue.CUT}


def turns_of(rng, n, roles="suaatx"):
    return [(rng.choice(roles), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(n)]


@pytest.mark.parametrize("roles", ["suaatx", "ua", "u", "a", "sx", "uua"])
def test_survivors_tell_the_cheapest_edits(roles):
    rng = random.Random(5)
    for _ in range(150):
        turns = turns_of(rng, rng.randrange(1, 14), roles)
        cost, audit, _ = brute.cheapest([(0, r, "t") for r, _ in turns], [f for _, f in turns])
        coded = [(r, FAULTS[f]) for r, f in turns]
        # At once, and in runs that are put together.
        paths = dialogue.Survivors(dialogue.NONE)
        for turn in coded:
            paths.turn(*turn)
        got, state, letters = paths.end()
        extra = state == dialogue.U
        assert (got + 5 * extra, "".join(x for x, _ in letters) + "I" * extra) == (cost, audit)
        cuts = sorted({0, len(coded), *(rng.randrange(len(coded)) for _ in range(3))})
        runs = [coded[a:b] for a, b in zip(cuts, cuts[1:])]
        told = ""
        for run, (start, to) in zip(runs, dialogue.join_runs([dialogue.transfer(r) for r in runs])):
            paths = dialogue.Survivors(start)
            for turn in run:
                paths.turn(*turn)
            told += "".join(x for x, _ in paths.end(to)[2])
        assert told + "I" * (to == dialogue.U) == audit


def test_survivors_hold_only_what_is_unresolved():
    rng = random.Random(6)
    paths, most = dialogue.Survivors(dialogue.NONE), 0
    for turn in [(r, FAULTS[f]) for r, f in turns_of(rng, 20_000, "sua")]:
        paths.turn(*turn)
        most = max(most, paths.held())
    assert most < 400 and len(paths.emitted) > 19_000


def odd_rows(real):
    rows = list(real)
    texts = ["Well.", "and so", "", "  \t", None, "Is it?", "word " * 20_000 + ".", "é!"]
    rng = random.Random(7)
    rows += [(100 + i % 9, rng.choice([None, 0, 1, 2, 5, 5, 9]), rng.choice(["system", "user", "assistant", "tool", "", None, "usr"]), rng.choice(texts)) for i in range(150)]
    rows += [(None, i, r, t) for i, (r, t) in enumerate([("user", "Hi."), ("assistant", "Ho."), ("user", "Hi."), (None, None)])]
    rows += [(200, None, None, None), (201, 3, "user", "Only me."), (202, None, "user", "a."), (202, None, "assistant", "b.")]
    # One conversation with most turns: equal ones, users only, and an ordinary stretch.
    rows += [(300, 1, "user", "same.")] * 60 + [(300, 10 + i, "user", f"u{i}.") for i in range(80)]
    rows += [(300, 100 + i, ("user", "assistant")[i % 2], f"t{i}" + ".!?x"[i % 4]) for i in range(120)]
    return rows


@pytest.mark.parametrize("bits", [2, 12])
def test_dialogue(spark, monkeypatch, bits):
    monkeypatch.setattr(dialogue, "RUN_BITS", bits)
    real = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = odd_rows(real)
    extra = ", spot string, edit string, cost string, part int"
    table = spark.createDataFrame([(*r, "x", "y", "z", 9) for r in rows], SCHEMA + extra).repartition(5)
    out = dialogue.report(table)
    assert out.columns == COLUMNS
    check(out, COLUMNS, brute.dialogue(rows))


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Yes."), (2, 0, "user", "What?"), (2, 1, "user", "no end"), (3, 0, "user", "Only.")]
    turns = dialogue.as_turns(spark.createDataFrame(rows, SCHEMA))
    edited = dialogue.edits(dialogue.ordered(turns))
    got = {}
    for r in dialogue.repair(turns, edited).orderBy("spot", "part").collect():
        got.setdefault(r["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    # A system turn that nobody follows becomes the user's; deleting a lone user costs less than an inserted answer.
    assert got == {1: [("R", "user", "Be kind."), ("K", "assistant", "Yes.")]}
    assert {r["conv_id"]: r["audit"] for r in dialogue.costs(edited).collect()} == {1: "RK", 2: "DD", 3: "D"}
    rows = [(1, 0, "user", "a."), (1, 1, "assistant", "b."), (1, 2, "user", "c."), (1, 3, "user", "d."), (1, 4, "user", "e."), (1, 5, "assistant", "f.")]
    turns = dialogue.as_turns(spark.createDataFrame(rows, SCHEMA))
    repaired = dialogue.repair(turns, dialogue.edits(dialogue.ordered(turns))).orderBy("spot", "part").collect()
    assert [(r["edit"], r["role"], r["text"]) for r in repaired] == [
        ("K", "user", "a."), ("K", "assistant", "b."), ("K", "user", "c."), ("R", "assistant", "d."), ("K", "user", "e."), ("K", "assistant", "f."),
    ]


def test_no_turns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dialogue.report(none).count() == 0
    gone = spark.createDataFrame([(i, t, "user", "x.") for i in range(40) for t in range(1)], SCHEMA)
    rows = [tuple(r) for r in gone.collect()]
    check(dialogue.report(gone), COLUMNS, brute.dialogue(rows))
    assert any(not turns for turns in brute.damaged(rows).values())
