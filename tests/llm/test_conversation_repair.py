import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from plantpulse.llm import conversation_repair as repair
from plantpulse.llm import entries

SCHEMA = "conv_id long, turn long, role string, text string"
WORDED = re.compile(r"[^\x20\x09-\x0D]")


def spoilt(rows):
    """The damage, row by row."""
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(c, t, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def brute(rows):
    """rows of one conversation; what ``repair`` says of them, by forward
    dynamic programming over (cost, audit, repaired) of every state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64].encode(), hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    nxt, names = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}

    def inserted(best):
        for _ in range(4):
            for s, (cost, audit, made) in list(best.items()):
                to = nxt[s]
                new = (cost + 3, audit + "I", made + [names[to] + ":"])
                best[to] = min(best.get(to, new), new)
        return best

    best, seen, faults, illegal = {0: (0, "", [])}, set(), [0, 0, 0], 0
    for i, (_, role, text) in enumerate(rows):
        found = WORDED.findall(text)
        fault = 1 if not found else 2 if (role, text) in seen else 3 if found[-1] not in ".!?" else 0
        seen.add((role, text))
        if fault:
            faults[fault - 1] += 1
        if i:
            illegal += rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        after = {}

        def offer(s, new):
            after[s] = min(after.get(s, new), new)

        extra = 3 if fault == 3 else 0
        for s, (cost, audit, made) in inserted(dict(best)).items():
            offer(s, (cost + 4, audit + "D", made))
            if fault in (0, 3):
                offer(nxt[s], (cost + 3 + extra, audit + "R", made + [f"{names[nxt[s]]}:{text}"]))
                to = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(role[:1])
                if to:
                    offer(to, (cost + extra, audit + "K", made + [f"{role}:{text}"]))
        best = after
    best = inserted(best)
    cost, audit, made = min(best[s] for s in (0, 3) if s in best)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


def expected(rows, ids=()):
    by = {c: [] for c in ids}
    for c, *rest in rows:
        by.setdefault(c, []).append(tuple(rest))
    return {c: brute(r) for c, r in by.items()}


def found(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def made(rng, n, conv):
    """A conversation with all kinds of trouble."""
    texts = ["Yes.", "No!", "cut off", "", " \t", "Well? ", "x" * 70 + ".", "x" * 70 + "!"]
    roles = ["user", "assistant", "system", "tool", "", "Assistant", "agent"]
    rows = []
    for t in range(n):
        role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
        rows.append((conv, None if rng.random() < 0.03 else t * rng.randint(1, 2), role, rng.choice(texts) if rng.random() < 0.5 else f"turn {conv} {t}."))
    return rows


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(5)
    rows = [r for conv in range(80) for r in made(rng, rng.randint(1, 9), conv)]
    rows += made(rng, 700, 500) + [(501, t, "tool", f"odd {t}.") for t in range(300)] + [(502, t, "user", "the same.") for t in range(200)]
    rows += [(503, t, "user", "again." if t < 150 else f"new {t}.") for t in range(260)] + made(rng, 20, None) + [(504, None, None, None), (504, None, "user", "hm")]
    return rows


@pytest.mark.parametrize("bits, passes", [(3, 10), (4, 1), (4, 0), (10, 10)])
def test_repair_equals_brute_force(spark, talk, monkeypatch, bits, passes):
    """Conversations over many chunks, with and without the exact way for the rest."""
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    df = spark.createDataFrame([(*r, "x") for r in talk], SCHEMA + ", place string").repartition(7)
    talk = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in talk]
    got, want = found(repair.repair(df, passes=passes)), expected(talk)
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], c


def test_damage_and_ids_without_rows(spark, talk):
    df = spark.createDataFrame(talk + [(900 + i, 0, "user", "only.") for i in range(60)], SCHEMA).repartition(3)
    rows = [tuple(r) for r in df.collect()]
    got = repair.damage(df)
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(spoilt(rows), key=order)
    want = expected(spoilt(rows), {r[0] for r in rows})
    assert found(repair.repair(got, df)) == want
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert nothing in want.values()


def test_repaired_turns_follow_the_grammar(spark, talk, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 4)
    df = spark.createDataFrame(talk, SCHEMA)
    turns, digests = {}, found(repair.repair(df))
    for r in repair.repaired_turns(df).collect():
        turns.setdefault(r.conv_id, []).append((r.number, r.role, r.text))
    for c, rows in turns.items():
        assert [n for n, _, _ in sorted(rows)] == list(range(len(rows)))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in sorted(rows)))
        assert digests[c][-1] == hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in sorted(rows)).encode()).hexdigest()


def test_fix_up_stops_where_vectors_run_alike():
    rng = random.Random(2)
    sound = bytes([1, 2] * 500)
    lanes = repair.Lanes([sound, bytes(rng.choice([1, 2, 3, 13, 14, 5, 9]) for _ in range(800))])
    end, other = np.tile(repair.END, (2, 1)), np.array([[0, 9, 0, 3], [2, 0, 5, 1]])
    before = lanes.starts(end)
    fixed, steps = lanes.fix(end, before, other)
    assert (repair.pack(fixed) == repair.pack(lanes.starts(other))).all()
    assert steps < 200  # of 1800
    swing = repair.Lanes([bytes([3] * 400)])  # rows that fit no role never settle
    assert swing.fix(end[:1], swing.starts(end[:1]), np.array([[1, 1, 0, 1]]))[1] == 400


def test_odd_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair(repair.damage(empty), empty).count() == 0 and repair.repaired_turns(empty).count() == 0
    rows = [(1, 1, "user", "long. " * 200_000)] * 3 + [(None, None, None, None)] * 2
    assert found(repair.repair(spark.createDataFrame(rows, SCHEMA))) == expected([(c, t, r or " ", x or " ") for c, t, r, x in rows])


def test_registered_query(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert found(entries.op12_conversation_repair(spark, sf)) == expected(spoilt(rows), {r[0] for r in rows})
