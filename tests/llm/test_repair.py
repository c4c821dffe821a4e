import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from riskbook.llm import repair
from riskbook.llm.queries import op13_chat_repair

SPACE = " \t\n\x0b\x0c\r"
COLUMNS = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]


def brute_one(rows):
    """Forward over all states with (cost, edits, turns); rows: [(turn, role, text)] in order."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts, seen, marks = [0, 0, 0], set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        marks.append(fault)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    after = lambda q, x: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((q, x))
    states = {"": (0, "", ())}

    def put(to, q, value):
        if q is not None and (q not in to or value[:2] < to[q][:2]):
            to[q] = value

    def inserted(now):
        for _ in range(4):
            for q, (cost, edits, out) in list(now.items()):
                for x, role in (("u", "user"), ("a", "assistant")):
                    put(now, after(q, x), (cost + 2, edits + "I", (*out, f"{role}:")))
        return now

    for (_, role, text), fault in zip(rows, marks, strict=True):
        then = {}
        for q, (cost, edits, out) in inserted(states).items():
            put(then, q, (cost + 3, edits + "D", out))
            if fault not in (0, 1):
                cut = fault == 2
                put(then, after(q, role[:1]), (cost + cut, edits + "K", (*out, f"{role}:{text}")))
                for x, new in (("u", "user"), ("a", "assistant")):
                    put(then, after(q, x), (cost + 2 + cut, edits + "R", (*out, f"{new}:{text}")))
        states = then
    cost, edits, out = min((v for q, v in inserted(states).items() if q in ("", "a")), key=lambda v: v[:2])
    return (gaps, *counts, illegal, cost, edits, "\n".join(out))


def brute(rows):
    """rows: [(conv, turn, role, text)] -> {conv: result}"""
    out, spaced = {}, lambda x: " " if x is None else x
    for conv in {r[0] for r in rows}:
        mine = [(t, spaced(role), spaced(text)) for c, t, role, text in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        out[conv] = brute_one(mine)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, no long, c string, n int")


def check(spark, rows, **args):
    got = {r["conv"]: tuple(r)[1:] for r in repair.repair(frame(spark, rows).repartition(3), **args).select(COLUMNS).collect()}
    assert got == brute(rows)


def talk(rng, conv, n, roles=("user", "assistant", "system", "tool", "", None, "u"), weights=(9, 9, 1, 1, 1, 1, 1)):
    text = lambda: rng.choice(["Yes.", "No!", "what", "É?", " ", "", None, "ok. ", *[f"text {rng.randrange(40)}{rng.choice('.!? ')}" for _ in range(6)]])
    return [(conv, rng.choice([k, k, k, k // 2, None] if k % 7 == 0 else [k]), rng.choices(roles, weights)[0], text()) for k in range(n)]


def test_costs_and_trace_equal_all_short_conversations():
    rng = random.Random(3)
    for _ in range(400):
        rows = [(k, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a", "b.", "c!", "d"]) + str(k) + rng.choice([".", ""])) for k in range(rng.randrange(7))]
        kinds = bytes("sua".find(r[:1]) % 4 + 4 * (t[-1] not in ".!?") for _, r, t in rows)
        costs = repair.costs_back(kinds, repair.END)
        state, audit, turns, cost = repair.trace(kinds, [0] * (len(rows) + 1), costs, 0, True)
        want = brute_one(rows)
        assert (cost, audit) == want[5:7] and costs[0][0] == cost and repair.END[state] == 0
        assert "\n".join(f"{rows[i][1] if r is None else r}:{'' if i is None else rows[i][2]}" for r, i in turns) == want[7]


@pytest.mark.parametrize("size,passes", [(256, 6), (3, 6), (2, 1)])
def test_equals_brute_force(spark, size, passes):
    rng = random.Random(size)
    rows = [r for c in range(25) for r in talk(rng, c if c % 9 else None, rng.randrange(14))] + talk(rng, 100, 150)
    rows += [(200, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(120)]  # sound
    rows += [(201, k, "tool", f"turn {k}") for k in range(60)]  # vectors never agree
    rows += [(202, None, None, None), (203, 5, "user", "same.")] + [(203, 5, "user", "same.")] * 20
    rows += [(204, -(1 << 61), "user", "a."), (204, (1 << 62), "assistant", "b.")]
    check(spark, rows, size=size, passes=passes)


def test_gaps_stop_at_the_largest_number(spark):
    rows = [(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b."), (2, None, "user", "a.")]
    got = {r["conv"]: r["gaps"] for r in repair.repair(frame(spark, rows)).collect()}
    assert got == {1: (1 << 63) - 1, 2: 0}


def test_long_texts_and_empty_table(spark):
    rows = [(1, 0, "user", "long text. " * 200_000), (1, 1, "assistant", "short"), (1, 2, "assistant", "x" * 500_000)]
    check(spark, rows, chars=1_000)
    assert repair.repair(frame(spark, rows).limit(0)).count() == 0


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [r for c in range(60) for r in talk(rng, c if c else None, rng.randrange(1, 9))] + [(k, 0, "user", "one row.") for k in range(1000, 1060)]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in op13_chat_repair(spark, str(tmp_path)).collect()}
    want = brute(damaged(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", "")
    assert got == {c: (*(v := want.get(c, nothing))[:7], hashlib.sha256(v[7].encode()).hexdigest()) for c in {r[0] for r in rows}}
    assert any(c not in want for c in got)


def test_damage_repeats_rows_beside_each_other(spark):
    rows = [(c, t, "user", "a. b!") for c in range(20) for t in range(20)]
    got = sorted((tuple(r) for r in repair.damage(frame(spark, rows)).select("conv_id", "turn", "role", "text").collect()))
    assert got == sorted(damaged(rows)) and repair.damage(frame(spark, rows)).where(F.col("text") == "").count() > 5
