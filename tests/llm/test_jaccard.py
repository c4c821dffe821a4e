import random
from fractions import Fraction

import numpy as np
import pytest

from riskbook.llm import jaccard
from tests.llm.helpers import docs_frame, edited, find_components, word_salad


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k=5):
    w = words(text)
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = []
    for x in range(len(rows)):
        for y in range(x + 1, len(rows)):
            a, b = sets[x], sets[y]
            if rows[x][0] is not None and rows[y][0] is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                links.append((rows[x][0], rows[y][0]))
    comp = find_components({r[0] for r in rows if r[0] is not None}, links)
    return sorted((str(i), len(s), str(comp.get(i))) for (i, _), s in zip(rows, sets, strict=True))


def result(spark, rows, **more):
    return sorted((str(r["id"]), r["n_shingles"], str(r["component"])) for r in jaccard.jaccard_links(docs_frame(spark, rows), **more).collect())


def corpus(seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(14):
        base = word_salad(rng, rng.choice([5, 6, 9, 14, 30, 70, 200, 900]))
        for _ in range(rng.randrange(1, 7)):
            rows.append((n, edited(rng, base, rng.choice([0, 0, 0.005, 0.02, 0.05, 0.1]))))
            n += rng.randrange(1, 4)
    passage = word_salad(rng, 60)
    rows += [(10_000 + k, passage + " " + word_salad(rng, rng.randrange(3, 60))) for k in range(25)]
    rows += [(20_000 + k, "Same  text\tof these\nFIVE words") for k in range(6)] + [(20_010, "same text of these five words")]
    rows += [(30_000, None), (30_001, ""), (30_002, " \t\n"), (30_003, "two words"), (30_004, "Two  WORDS"), (30_005, "wörter"), (30_006, "WÖRTER"),
             (None, "same text of these five words"), (30_007, "lone one"), (30_007, "two words"), (30_008, "a b c d e " * 5000), (30_009, "a b c d e " * 4000)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert result(spark, rows) == brute(rows)


def test_order_of_signatures_never_changes_the_result(spark):
    rows = corpus(3)
    assert result(spark, rows, heavy=0) == result(spark, rows, heavy=10) == brute(rows)


def test_similar_sets_share_a_signature():
    """For random sets near the threshold, of all sizes, some signature is the same under any order."""
    rng = np.random.default_rng(1)
    for trial in range(300):
        n = int(rng.choice([1, 2, 3, 4, 7, 12, 15, 16, 17, 60, 63, 64, 300]))
        a = np.unique(rng.integers(0, 1 << 63, size=n, dtype=np.uint64))
        cut = rng.permutation(len(a))[:int(rng.integers(0, len(a) // 4 + 1))]
        b = np.delete(a, cut) if rng.random() < 0.5 else np.unique(np.concatenate([np.delete(a, cut[::2]), rng.integers(0, 1 << 63, size=len(cut) // 2, dtype=np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if 100 * inter < 75 * (len(a) + len(b) - inter):
            continue
        rows, h = np.repeat([0, 1], [len(a), len(b)]), np.concatenate([np.sort(a), np.sort(b)])
        plain = jaccard.Signatures(Fraction(3, 4))
        every = np.unique(np.concatenate([s for _, s, _ in plain.each(rows, h, 2)]))
        heavy = np.sort(every[rng.random(len(every)) < 0.5])
        for maker in (plain, jaccard.Signatures(Fraction(3, 4), heavy, rng.integers(1, 9, size=len(heavy)))):
            got = [{}, {}]
            for r, s, rank in maker.each(rows, h, 2):
                for k in (0, 1):
                    got[k].update(zip(s[r == k].tolist(), rank[r == k].tolist(), strict=True))
            common = got[0].keys() & got[1].keys()
            assert any(max(got[0][c], got[1][c]) * 7 <= len(a) + len(b) for c in common), (trial, len(a), len(b))


def test_bitmaps_never_rule_out_a_similar_pair(spark):
    rng, rows, want = np.random.default_rng(7), [], []
    for k in range(400):
        n = int(rng.choice([1, 3, 15, 16, 17, 30, 33, 200, 1000]))
        a = np.unique(rng.integers(0, 1 << 63, size=n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.choice([0.0, 0.1, 0.24, 0.6])],
                                      rng.integers(0, 1 << 63, size=int(rng.choice([0, 1, n // 5])), dtype=np.uint64)]))
        bits = jaccard.bitmaps(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2).to_pylist()
        inter = len(np.intersect1d(a, b))
        rows.append((k, len(a), len(b), *bits))
        want.append(4 * inter >= 3 * (len(a) + len(b) - inter))
    df = spark.createDataFrame([r for r in rows if r[1] and r[2]], "k int, n long, m long, x array<long>, y array<long>")
    got = {r["k"] for r in df.where(jaccard.possible(Fraction(3, 4))).collect()}
    assert {k for k, w in enumerate(want) if w} <= got and len(got) < 330


def test_empty_table(spark):
    assert result(spark, []) == []


def test_signatures_of_wide_sets_have_several_elements():
    """Sets that share some elements by chance rarely share a signature."""
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 1 << 63, size=120, dtype=np.uint64)
    sets = [np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, size=280, dtype=np.uint64)])) for _ in range(20)]
    rows = np.repeat(np.arange(20), [len(s) for s in sets])
    seen = [set() for _ in sets]
    for r, s, _ in jaccard.Signatures(Fraction(3, 4)).each(rows, np.concatenate(sets), 20):
        for k in range(20):
            seen[k] |= set(s[r == k].tolist())
    common = [len(seen[i] & seen[j]) for i in range(20) for j in range(i)]
    assert sum(common) / len(common) < 10


def test_pair_is_found_at_any_of_its_groups(spark):
    """Two sets with 40 groups in common, and one that meets them in a group each, at other ranks."""
    rows = [(s, node, 300, s) for s in range(40) for node in (1, 2)] + [(7, 3, 300, 0), (30, 3, 300, 1), (50, 3, 300, 2), (50, 4, 300, 90)]
    members = spark.createDataFrame(rows, "sig long, node long, n int, rank int")
    place = spark.createDataFrame([(k, str(k)) for k in (1, 2, 3, 4)], "node long, c string")
    fits = "(n + m) * 1 >= greatest(rank, other) * 7"
    pairs = jaccard.open_pairs(members, place, fits)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3), (2, 3)]  # 90 is over 600 / 7


def test_pairs_of_groups_are_those_of_a_plain_join(spark):
    rng = random.Random(9)
    own = {node: rng.sample(range(60), 15) for node in range(25)}  # in an order of its own
    rows = [(s, node, 40, r) for node, sigs in own.items() for r, s in enumerate(sorted(sigs, key=lambda s: (s * 37) % 61))]
    comp = {node: str(rng.randrange(8)) for node in own}
    got = jaccard.open_pairs(spark.createDataFrame(rows, "sig long, node long, n int, rank int"),
                             spark.createDataFrame(list(comp.items()), "node long, c string"), "n + m >= 7 * greatest(rank, other)").collect()
    want = {(a, b) for s, a, _, i in rows for t, b, _, j in rows if s == t and a < b and comp[a] != comp[b] and 80 >= 7 * max(i, j)}
    assert sorted(map(tuple, got)) == sorted(want)
