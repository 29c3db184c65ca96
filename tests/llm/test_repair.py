"""Conversation repair against plain searches over all edits."""

import hashlib
import random
import zlib

import pytest

from kickstand.llm import op12_repair as op12


STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """Least (cost, audit) over all edit sequences, row by row from the end: what follows a state does not depend on
    what led to it, so the least rest per state is enough."""
    rest = {"": (0, ""), "a": (0, "")}
    for i in range(len(rows), -1, -1):
        if i < len(rows):
            initial, gone, cut = rows[i]
            now = {}
            for state in ("", "s", "u", "a"):
                options = [(rest[state][0] + 3, "D" + rest[state][1])] if state in rest else []
                for said, edit, cost in [(initial, "K", 0), ("u", "R", 2), ("a", "R", 2)]:
                    to = STEPS.get((state, said))
                    if not gone and to in rest:
                        options.append((rest[to][0] + cost + cut, edit + rest[to][1]))
                if options:
                    now[state] = min(options)
            rest = now
        # inserts before row i: three in a row never pay
        for _ in range(3):
            for (state, said), to in STEPS.items():
                if said != "s" and to in rest:
                    rest[state] = min(rest.get(state, (10**9, "")), (rest[to][0] + 2, "I" + rest[to][1]))
    return rest[""]


def _signature(rng, n):
    return tuple((rng.choice("suax "), rng.random() < 0.15, rng.random() < 0.2) for _ in range(n))


def test_dijkstra_finds_the_least_audit_of_least_cost():
    rng = random.Random(3)
    for _ in range(400):
        rows = _signature(rng, rng.randrange(0, 9))
        assert op12.solve(rows, op12.START, op12.ACCEPTED, True) == cheapest(rows), rows


def _plain(conversation):
    """A conversation's result row from (turn, role, text) rows in order, without chunks."""
    seen, faults = set(), []
    for _, role, text in conversation:
        faults.append(op12.fault(text, (role, text) in seen))
        seen.add((role, text))
    signature = tuple((r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(conversation, faults, strict=True))
    cost, audit = cheapest(signature)
    turns = {t for t, _, _ in conversation if t is not None}
    initials = [r[:1] for _, r, _ in conversation]
    lines, at, last = [], 0, ""
    for edit in audit:
        if edit != "D":
            role = conversation[at][1] if edit == "K" else "assistant" if last == "u" else "user"
            lines.append(f"{role}:{conversation[at][2] if edit != 'I' else ''}")
            last = role[:1]
        at += edit != "I"
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            text = "" if k == 1 else text.translate({ord(c): None for c in ".!?"}) if k == 2 else text
            held += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return {c: sorted(h, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, h in out.items()}


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _conversations(rng):
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randrange(0, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, rng.choice(["Yes.", "no", "What?", "", " \n", None, "é!", "Yes. ok"])))
    # one conversation holds a third of all rows, another many copies of one row
    rows += [(777, t, "user" if t % 2 else "assistant", rng.choice(["Fine.", f"Turn {t}.", f"cut {t}"])) for t in range(260)]
    rows += [(778, 5, "user", "Again.")] * 40 + [(779, None, None, None)] * 3
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("chunk_rows", "range_rows"), [(128, 50_000), (7, 90)])
def test_repair_equals_brute_force(spark, chunk_rows, range_rows):
    rows = _conversations(random.Random(5))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as copies", "2 as n", "'x' as audit")
    want = {c: _plain(h) for c, h in damaged(rows).items()}
    found = op12.repair(op12.damage(frame), chunk_rows=chunk_rows, range_rows=range_rows).collect()
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in found}
    assert len(found) == len(got)
    assert got == {c: w for c, w in want.items() if damaged(rows)[c]}


def test_every_conversation_has_a_row_and_empty_tables_none(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"0:{t}".encode()) % 20 == 0)
    frame = spark.createDataFrame([(0, dropped, "user", "a")] + [(i, t, "user", "Hi.") for i in range(1, 60) for t in range(2)], "conv_id long, turn long, role string, text string")
    rows = [tuple(r) for r in frame.collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in op12.repair_damaged(frame).collect()}
    assert got == {c: _plain(h) for c, h in damaged(rows).items()}
    assert any(not h for h in damaged(rows).values())
    assert op12.repair_damaged(frame.limit(0)).count() == 0


def test_repaired_text_follows_the_pattern(spark):
    rows = [(1, 0, "system", "Be."), (1, 1, "assistant", "Hi."), (1, 2, "user", "Yes")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = op12.repair(frame, with_text=True).first()
    assert (got["cost"], got["audit"]) == cheapest((("s", False, False), ("a", False, False), ("u", False, True)))
    assert hashlib.sha256(got["repaired"].encode()).hexdigest() == got["repaired_sha256"]
    assert [line[0] for line in got["repaired"].split("\n")] in (["s", "u", "a"], ["s", "u", "a", "u", "a"])
