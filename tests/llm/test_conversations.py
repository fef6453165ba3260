import hashlib
import itertools
import random
import re
import zlib

import pytest

from barloom.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost long, copies int, digest string"
SPACE = " \t\n\x0b\x0c\r"


def end_marks_off(text):
    return re.sub("[.!?]", "", text)


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw:
            text = "" if draw == 1 else end_marks_off(text) if draw == 2 else text
            out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def repairs(rows, limit):
    """All (cost, audit, lines) with at most ``limit`` inserts, by trying everything."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    options = []
    for (role, text), fault in zip(rows, faults):
        found = [(4, "D", None)]
        if fault not in ("b", "d"):
            more = 3 if fault == "t" else 0
            found += [(more, "K", (role, text))] + [(3 + more, "R", (r, text)) for r in ("user", "assistant")]
        options.append(found)
    gaps = [p for n in range(limit + 1) for p in itertools.product([(3, "I", (r, "")) for r in ("user", "assistant")], repeat=n)]
    best = None
    for edits in itertools.product(*options):
        for spots in itertools.product(gaps, repeat=len(rows) + 1) if rows else ((g,) for g in gaps):
            chain = [e for spot, edit in itertools.zip_longest(spots, edits) for e in (*spot, *([edit] if edit else []))]
            lines = [e[2] for e in chain if e[2]]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines)):
                got = sum(e[0] for e in chain), "".join(e[1] for e in chain), lines
                best = min(best, got) if best else got
    return faults, best


def slow(rows, limit=2):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(
            (r for r in slow_damage(rows) if r[0] == conv),
            key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()),
        )
        faults, (cost, audit, lines) = repairs([r[2:] for r in own], limit)
        turns = {r[1] for r in own} - {None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)
    return out


def found(spark, rows):
    turns = spark.createDataFrame([(*r, "x", 7, 1, "y") for r in rows], SCHEMA)
    got = conversations.audited(turns, conversations.damaged(turns)).collect()
    assert len(got) == len({r[0] for r in got})
    return {r[0]: tuple(r[1:]) for r in got}


def test_equals_trying_all_edits(spark):
    rng = random.Random(5)
    texts = ["Hello.", "What?", "cut off", "", " \t", "Yes!", None, "Hello.", "Trailing space. "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    rows = [
        (conv, turn, rng.choice(roles), rng.choice(texts))
        for conv in range(70)
        for turn in range(rng.randrange(1, 4))
    ]
    assert found(spark, rows) == slow(rows)


def test_order_nulls_ties_repeats_and_long_texts(spark):
    long = "word " * 300_000 + "end."
    rows = [
        (None, 1, "user", "Hi."), (None, None, "system", "Be kind."), (None, 2, "assistant", long),
        (7, 3, "assistant", "B."), (7, 3, "user", "A."), (7, 3, "user", "A."), (7, None, "user", "C."),
        (8, None, None, None), (9, 5, "user", long),
    ]
    assert found(spark, rows) == slow(rows, limit=1)
    assert found(spark, []) == {}


def test_all_rows_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert found(spark, [(conv, 0, "user", "Hi.")]) == {conv: (0, 0, 0, 0, 0, 0, "", empty)}


def shortest_edits(signature):
    """Costs and audits by a plain recursion over strings."""
    layer = {0: (0, ""), 1: (6, "II"), 2: (3, "I"), 3: (0, "")}
    for symbol in reversed(signature):
        more, new = 3 if symbol.isupper() else 0, {}
        for state in range(4):
            found = [(layer[state][0] + 4, "D" + layer[state][1])]
            if symbol != "x":
                kept = conversations.KEEP.get((state, symbol.lower()))
                if kept is not None:
                    found.append((layer[kept][0] + more, "K" + layer[kept][1]))
                to = conversations.TURN[state]
                found.append((layer[to][0] + more + 3, "R" + layer[to][1]))
            new[state] = min(found)
        for _ in range(3):
            new = {s: min(v, (3 + new[conversations.TURN[s]][0], "I" + new[conversations.TURN[s]][1])) for s, v in new.items()}
        layer = new
    return layer[0]


def test_automaton_shares_suffixes_and_keeps_ties_by_byte_order():
    rng = random.Random(2)
    signatures = ["".join(rng.choices("suaoeSUAOEx", k=rng.randrange(1, 40))) for _ in range(600)]
    signatures += ["uauaua" * n + "x" for n in range(1, 30)]
    automaton, made = conversations.Automaton(), 0
    for signature in sorted(set(signatures), key=lambda s: s[::-1]):
        assert automaton.audit(signature) == shortest_edits(signature)
        made = max(made, len(automaton.nodes))
    assert made == max(map(len, signatures)) + 1  # one path is all that is held
    assert len(automaton.steps) < 500


def test_a_long_conversation_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 7)
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", f"b{t}", "", f"c{t}."])) for t in range(500)]
    turns = spark.createDataFrame([(*r, "", 0, 1, "") for r in rows], SCHEMA)
    told, lines = conversations.repair(turns)
    (got,), kept = told.collect(), lines.collect()
    seen, signature = set(), ""
    for _, _, role, text in rows:
        gone = not text or (role, text) in seen
        signature += "x" if gone else role[0] if text.endswith(".") else role[0].upper()
        seen.add((role, text))
    assert (got.cost, got.audit) == shortest_edits(signature)
    assert got.illegal == sum(a[2][0] + b[2][0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in kept))
    assert "".join(r.edit for r in kept) == got.audit.replace("D", "")


@pytest.mark.parametrize("column", ["role", "text"])
def test_undamaged_conversations_of_nulls(spark, column):
    turns = spark.createDataFrame([(1, 0, None, None, "", 0, 1, ""), (1, 1, "assistant", "Hi.", "", 0, 1, "")], SCHEMA)
    (got,) = conversations.repair(turns)[0].collect()
    assert (got.blank, got.cost, got.audit) == (1, 7, "DIK")
