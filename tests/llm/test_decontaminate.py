import random
import re

import pytest

from riskbook.llm import decontaminate
from tests.llm.helpers import docs_frame, word_salad

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(0, len(w) - window) + 1 if w else 0):
            wins.setdefault(tuple(w[k:k + window]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        out.append((str(i), len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [4_000_000, 300])
def test_equals_brute_force(spark, block_bytes):
    rng = random.Random(2)
    passages = [word_salad(rng, n, 30) for n in (20, 13, 12, 5, 1, 40)]
    items = [(k, p) for k, p in enumerate(passages)] + [(10, passages[0]), (11, None), (12, " ,. "), (None, "orphan item"), (0, passages[0])]
    texts = [(k, f"{word_salad(rng, rng.randrange(30), 30)} {rng.choice(passages)}; {word_salad(rng, rng.randrange(300), 30)}") for k in range(40)]
    texts += [(100, None), (101, ""), (102, " .,!"), (103, passages[0].upper().replace(" ", " -- ")), (103, passages[1]), (None, passages[5]),
              (104, "é" + passages[2]), (105, word_salad(rng, 30_000, 30) + " " + passages[5])]
    df = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.with_decision(decontaminate.find_contamination(docs_frame(spark, texts), df, block_bytes=block_bytes)).collect()
    got = sorted((str(r["id"]), r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found)
    assert got == brute(texts, [i for i in items if i[0] is not None])
    by_id = dict(texts)
    for r in found:
        if r["id"] in by_id and r["id"] != 103:
            text, w = by_id[r["id"]], words(by_id[r["id"]])
            assert [words(text[s["a"]:s["b"]]) for s in r["spans"]] == [w[x["a"]:x["b"]] for x in r["runs"]]


def test_empty_tables(spark):
    docs, none = docs_frame(spark, [(1, "some words")]), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, none).collect()[0]["n_words"] == 2
    assert decontaminate.find_contamination(docs.where("false"), none).count() == 0


@pytest.mark.parametrize("block_bytes", [4_000_000, 300])
def test_items_without_an_id_hit(spark, block_bytes):
    rng = random.Random(4)
    passages = [word_salad(rng, 20, 400) for _ in range(12)]
    items = [(None, p) for p in passages[:6]] + [(7, p) for p in passages[6:]] + [(8, passages[0])]
    texts = [(k, f"{word_salad(rng, 9)} {p}") for k, p in enumerate(passages)] + [(99, word_salad(rng, 30))]
    df = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.with_decision(decontaminate.find_contamination(docs_frame(spark, texts), df, block_bytes=block_bytes)).collect()
    got = {r["id"]: (r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in found}
    assert got == {0: (20, 2, ["8", None], True), **{k: (20, 1, [None], True) for k in range(1, 6)}, **{k: (20, 1, ["7"], True) for k in range(6, 12)},
                   99: (0, 0, [], False)}


def test_items_that_share_an_id_are_dealt_over_blocks(spark, monkeypatch):
    rng, sizes = random.Random(5), []
    items = [(7, word_salad(rng, 20, 400)) for _ in range(200)] + [(7, "the same text of a hot item again")] * 200
    share = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda block: sizes.append(sum(len(t) for _, t in block)) or share(block))
    decontaminate.find_contamination(docs_frame(spark, [(1, "x")]), spark.createDataFrame(items, "item_id long, text string"), block_bytes=5_000)
    assert len(sizes) > 3 and max(sizes) <= 5_000
