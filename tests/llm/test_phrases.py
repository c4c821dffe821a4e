import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from riskbook.llm import phrases
from tests.llm.helpers import docs_frame

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, share=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    frequent = [g for g, c in f.items() if c >= least and len(g) > 2]
    for g in frequent:
        lang, words, a = g[0], g[1:], f[g]
        cuts = [(2_000_000 * a // (f[(lang, *words[:k])] + f[(lang, *words[k:])]), k, f[(lang, *words[:k])], f[(lang, *words[k:])]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        inside = [f[h] for h in frequent if h[0] == lang and len(h) > len(g) and any(h[i:i + len(words)] == words for i in range(1, len(h)))]
        if not any(100 * x >= share * a for x in inside):
            out.append((lang, " ".join(words), a, left, right, n[lang], score))
    result = []
    for lang in {r[0] for r in out}:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        result += [(r[0], k, *r[1:]) for k, r in enumerate(best, 1)]
    return sorted(result)


def salad(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "Éa", "A", "日本", "x.y", "don't", "a b"]
    pick = lambda: vocabulary[min(int(rng.expovariate(0.25)), len(vocabulary) - 1)]
    ends = [" "] * 9 + ["  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "; ", " ? "]
    text = lambda: "".join(pick() + rng.choice(ends) for _ in range(rng.randrange(60)))
    return [(rng.choice(["en", "en", "fr", None, "und"]), text()) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(k, lang, text, 1.0, 5, "x", 7) for k, (lang, text) in enumerate(rows)],
                                 "doc_id long, lang string, text string, score double, id long, phrase string, f long")


@pytest.mark.parametrize("bound,block", [(300_000, 1 << 10), (300_000, 30), (0, 30)])
def test_equals_brute_force(spark, monkeypatch, bound, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "HELD", 4 * block)
    rows = salad(1, 150) + [(None, None), ("en", ""), ("en", " \t. ,")]
    got = phrases.collocations(frame(spark, rows).repartition(3), least=5, top=15, most_broadcast=bound).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 15)


def test_long_texts_ties_and_repeats(spark):
    rows = [("en", "a b c d. " * 20_000), ("en", "one two three " * 9), ("en", "one two three " * 9), ("fr", "q r s"), (None, "é Z é Z é Z é Z")]
    got = phrases.collocations(frame(spark, rows), least=3, top=2_000).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 2_000)


def test_all_phrases_without_rank_and_empty_tables(spark):
    rows = salad(2, 40)
    got = phrases.collocations(frame(spark, rows), least=4, top=None).collect()
    assert {r["rank"] for r in got} == {None}
    assert sorted((r["lang"], r["phrase"]) for r in got) == sorted((r[0], r[2]) for r in brute(rows, 4, 10**9))
    assert phrases.collocations(docs_frame(spark, [(1, None), (2, "")])).count() == 0
    assert phrases.collocations(frame(spark, rows).limit(0)).count() == 0


def test_counts_are_handed_on_before_they_grow(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 7)
    rows = salad(3, 60)
    frames = [frame(spark, rows).toPandas()[["lang", "text"]]]
    counts = Counter()
    for part in phrases._count_words(iter(frames)):
        for lang, phrase, n in part.itertuples(index=False):
            counts[lang, phrase] += n
    want = Counter()
    for lang, text in rows:
        want.update((lang, w.decode()) for w in phrases.words_of(text) if w != b".")
    assert counts == want


def test_joined_in_chunks_and_buckets(spark, monkeypatch):
    """chunks and buckets of any size give the same; a chunk sends a packed row for a bucket, not one for a group."""
    for name, value in (("CHUNK", 40), ("BUCKETS", 3), ("BUCKET", 4)):
        monkeypatch.setattr(phrases, name, value)
    rows, seen, joined_back = salad(4, 120) + [(None, None), ("a b", "x y x y. " * 9), ("", "x y x y x " * 6)], [], phrases._joined_back
    monkeypatch.setattr(phrases, "_joined_back", lambda *a: seen.append((a[0].groupBy("chunk").count().count(), a[0].where(f"bucket < {a[2]}").count(), a[2]))
                        or joined_back(*a))
    got = phrases.collocations(frame(spark, rows).repartition(3), least=5, top=15, most_broadcast=0).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 15)
    assert len(seen) == 3 and max(buckets for _, _, buckets in seen) > 3 and seen[1][0] > 10
    assert all(0 < sent <= chunks * buckets for chunks, sent, buckets in seen)


def test_pairs_are_counted_once_however_they_are_held(monkeypatch):
    rng = np.random.default_rng(1)
    entries = rng.integers(-1, 50, 5000)
    blocks = [np.append(half, -1) for part in np.split(entries, 5) for half in np.split(part, [7])]
    frames = [pd.DataFrame({"entries": [x.tobytes() for x in blocks[i:i + 2]]}) for i in range(0, 10, 2)]
    want = Counter((int(a), int(b)) for x in blocks for a, b in zip(x, x[1:]) if a >= 0 and b >= 0)
    for held in (1 << 17, 100, 3):
        monkeypatch.setattr(phrases, "HELD", held)
        got = Counter()
        for part in phrases._count_pairs(50, iter(frames)):
            for a, b, n in part.itertuples(index=False):
                got[a, b] += n
        assert got == want
    assert [len(x) for x in phrases._count_pairs(0, iter([frames[0].iloc[:0]]))] in ([], [0])
