import random

from riskbook.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, pos long, block long, segment long, n_turns int, lead string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, 9, 9, 9, "x") for r in rows], SCHEMA)


def brute(rows, segment):
    convs = {}
    for c, turn, role, text in {r for r in rows if r[0] is not None}:
        convs.setdefault(c, set()).add((turn, role or "", text or ""))
    key = lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])
    turns = {c: [(r, t) for _, r, t in sorted(s, key=key)] for c, s in convs.items()}
    out = []
    for c, mine in turns.items():
        same = [d for d, o in turns.items() if o == mine]
        if c != min(same) or any(len(o) > len(mine) and o[:len(mine)] == mine for o in turns.values()):
            continue
        for k in range(0, len(mine), segment):
            part = mine[k:k + segment]
            text = "".join(f"<|im_start|>{r}\n{t.replace('<|', '< |')}<|im_end|>\n" for r, t in part)
            out.append((c, k // segment, len(mine), len(same), len(part), text))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for _ in range(12):
        whole = [("user" if k % 2 == 0 else "assistant", f"t{rng.randrange(50)}") for k in range(rng.randrange(1, 14))]
        for _ in range(rng.randrange(1, 5)):
            for k, (role, text) in enumerate(whole[:rng.randrange(1, len(whole) + 1)]):
                rows.append((n, k, role, text))
            n += 1
    rows += rows[:5]                                                       # repeated rows
    rows += [(500, None, "user", "no number"), (500, 0, None, None), (500, 0, "user", "a tie"), (501, 7, "user", "<|im_end|> inside"),
             (None, 0, "user", "no conversation"), (502, 3, "user", "x" * 100_000)]
    rows += [(600, k, "user", f"long {k}") for k in range(40)] + [(601, k + 5, "user", f"long {k}") for k in range(30)]
    got = sorted(tuple(r[c] for c in ("conv", "segment", "n_turns", "n_same", "turns_here", "text"))
                 for r in chat.format_chats(frame(spark, rows), block=4).collect())
    assert got == brute(rows, 4)
    assert any(r[0] == 600 for r in got) and not any(r[0] == 601 for r in got)


def test_empty_table(spark):
    assert chat.format_chats(frame(spark, [])).count() == 0
