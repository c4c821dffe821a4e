import numpy as np
import pytest

from riskbook.llm import vectors
from tests.llm.helpers import find_components

SCHEMA = "vec_id long, embedding array<float>, label int, n_links long, component long, h1 long, size int"


def brute(rows, threshold=0.98):
    good = []
    for i, v, g in rows:
        ok = i is not None and g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, dtype=np.float32).astype(np.float64) if ok else None)
    links, count = [], [0] * len(rows)
    for x in range(len(rows)):
        for y in range(x + 1, len(rows)):
            a, b = good[x], good[y]
            if a is not None and b is not None and rows[x][2] == rows[y][2] and len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                links.append((rows[x][0], rows[y][0]))
                count[x] += 1
                count[y] += 1
    comp = find_components({r[0] for r in rows if r[0] is not None}, links)
    return sorted((str(r[0]), c, str(comp.get(r[0]))) for r, c in zip(rows, count, strict=True))


def result(spark, rows, **more):
    df = spark.createDataFrame([(i, v, g, 1, 2, 3, 4) for i, v, g in rows], SCHEMA)
    return sorted((str(r["id"]), r["n_links"], str(r["component"])) for r in vectors.link_vectors(df, **more).collect())


@pytest.mark.parametrize("block", [1_000, 7])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 24))
    rows = []
    for k in range(160):
        v = base[k % 12] + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.12, 0.2])
        rows.append((k * 3 + 1, v.astype(np.float32).tolist(), int(k % 2)))
    rows += [(1000 + k, base[0].astype(np.float32).tolist(), 0) for k in range(9)]                   # copies
    chain = [(2000 + k, [float(np.cos(k * 0.15)), float(np.sin(k * 0.15)), 0.0], 1) for k in range(12)]  # each near the next
    odd = [(3000, None, 0), (3001, [], 0), (3002, [0.0, 0.0, 0.0], 0), (3003, [1.0, None, 2.0], 0), (3004, [float("nan"), 1.0, 0.0], 0),
           (3005, [float("inf"), 1.0, 0.0], 0), (3006, [1.0, 0.0, 0.0], None), (None, [1.0, 0.0, 0.0], 0), (3007, [1.0, -0.0, 0.0], 0),
           (3008, [2.0, 0.0, 0.0], 0), (3008, [2.0, 0.0, 0.0], 0), (3009, [0.0, 5.0, 0.0], 0), (3009, [1.0, 0.0, 0.0], 0)]
    rows += chain + odd
    assert result(spark, rows, block=block) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_recall_at_the_threshold(spark):
    """Pairs hardly above the threshold, the worst case of the plan."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(300):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.astype(np.float32).tolist(), 0), (2 * k + 1, (0.9805 * a + np.sqrt(1 - 0.9805 ** 2) * b).astype(np.float32).tolist(), 0)]
    found = sum(r[1] for r in result(spark, rows))
    assert found >= 0.995 * sum(r[1] for r in brute(rows))


def test_tiny_and_huge_vectors_link(spark):
    rows = [(k, [x * s for x in (1.0, 2.0, -1.0, 0.5)], 1) for k, s in enumerate([1e-200, 1e-200 * 3, 1e200, 5e-320, 1.0])] + [(9, [1e300, -1e300, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["id"]: (r["n_links"], r["component"]) for r in vectors.link_vectors(df).collect()}
    assert got == {**{k: (4, 0) for k in range(5)}, 9: (0, 9)}
