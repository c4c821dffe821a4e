"""Exact quantiles and global-order curves against NumPy brute force."""
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from riskbook.operators.curves import gini, gini_desc, ordered_positions, qcut_labels
from riskbook.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.01, 0.1, 0.25, 0.5, 0.9, 0.995, 1.0]


def _np_gini(y, p):
    total = y.sum()
    if total == 0:
        return 0.0
    idx = np.lexsort((np.arange(len(p)), p))
    cl = np.cumsum(y[idx]) / total
    cp = np.arange(1, len(y) + 1) / len(y)
    area = np.sum((cp[1:] - cp[:-1]) * (cl[1:] + cl[:-1]) / 2)
    return float(np.clip(1 - 2 * area, 0, 1))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=300))
def test_exact_quantiles_with_ties(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    q = exact_quantiles(df, "x", PROBS, bins=4, leaf=3)
    for p in PROBS:
        assert q[("", p)] == pytest.approx(float(np.percentile(values, p * 100)), abs=1e-9)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.floats(min_value=1e-300, max_value=1e300), st.floats(min_value=-1e300, max_value=-1e-300),
                          st.sampled_from([0.0, 1.0, 1e-299, 1e299])), min_size=1, max_size=200))
def test_exact_quantiles_over_any_range(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    q = exact_quantiles(df, "x", [0.0, 1.0], bins=8, leaf=2)
    assert q[("", 0.0)] == min(values) and q[("", 1.0)] == max(values)
    n = len(values)
    ranks = [r / (n - 1) for r in range(n)][::7] if n > 1 else [0.5]
    q = exact_quantiles(df, "x", ranks, bins=8, leaf=2)
    for p in ranks:
        pos = p * (n - 1)
        lo, hi = sorted(values)[int(pos)], sorted(values)[min(int(pos) + 1, n - 1)]
        assert lo <= q[("", p)] <= hi


def test_exact_quantiles_spread_over_600_magnitudes(spark):
    values = [10.0 ** k for k in range(-299, 300, 2)] * 7 + [5.0] * 500
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert exact_quantiles(df, "x", [0.5], leaf=10)[("", 0.5)] == float(np.median(values))


def test_exact_quantiles_grouped(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g in "abc" for v in rng.normal(size=500)]
    df = spark.createDataFrame(rows, "g string, x double")
    q = exact_quantiles(df, "x", [0.25, 0.75], by="g", bins=16, leaf=10)
    for g in "abc":
        vals = [v for gg, v in rows if gg == g]
        assert q[(g, 0.75)] == pytest.approx(float(np.percentile(vals, 75)))


def test_ordered_positions_match_sort(spark):
    rng = np.random.default_rng(2)
    p = rng.integers(0, 20, 2000).astype(float)        # heavy ties, broken by key
    y = rng.exponential(size=2000)
    df = spark.createDataFrame([(f"K{i:05d}", float(a), float(b)) for i, (a, b) in enumerate(zip(p, y))],
                               "policy_id string, p double, y double")
    out = ordered_positions(df, [("p", True), ("policy_id", False)], ["y"], buckets=7).toPandas()
    out = out.sort_values("_pos")
    exp = df.toPandas().sort_values(["p", "policy_id"], ascending=[False, True])
    assert list(out["policy_id"]) == list(exp["policy_id"])
    assert np.allclose(out["_cum_y"].values, np.cumsum(exp["y"].values))


def test_gini_against_trapezoid(spark):
    rng = np.random.default_rng(3)
    y = np.where(rng.random(3000) < 0.06, rng.exponential(20000, 3000), 0.0)
    p = rng.random(3000) + y / 1e5
    df = spark.createDataFrame([(f"P{i:05d}", float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                               "policy_id string, y double, p double")
    assert gini(df, "y", "p") == pytest.approx(_np_gini(y, p), abs=1e-9)
    idx = np.lexsort((np.arange(len(p)), -p))
    lz = np.cumsum(y[idx]) / (y.sum() + 1e-9)
    assert gini_desc(df, "y", "p") == pytest.approx(2 * lz.mean() - 1, abs=1e-9)


def test_gini_no_claims(spark):
    df = spark.createDataFrame([(f"P{i}", 0.0, float(i)) for i in range(50)], "policy_id string, y double, p double")
    assert gini(df, "y", "p") == 0.0


def test_qcut_duplicates_dropped(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 1, 1, 2, 3]], "x double")
    labels = [r[0] for r in df.select(qcut_labels(df, "x", 10).alias("d")).collect()]
    import pandas as pd
    exp = pd.qcut(pd.Series([1, 1, 1, 1, 1, 1, 2, 3], dtype=float), 10, labels=False, duplicates="drop").tolist()
    assert labels == exp


def test_constant_prediction(spark):
    df = spark.createDataFrame([(5.0,)] * 20, "x double")
    labels = {r[0] for r in df.select(qcut_labels(df, "x", 10).alias("d")).collect()}
    assert labels == {0}


def _brute_tau_b(x, y):
    n = len(x)
    nc = nd = t1 = t2 = 0
    for i in range(n):
        for j in range(i + 1, n):
            s = (x[i] - x[j]) * (y[i] - y[j])
            nc += s > 0
            nd += s < 0
            t1 += x[i] == x[j]
            t2 += y[i] == y[j]
    n0 = n * (n - 1) / 2
    return (nc - nd) / ((n0 - t1) * (n0 - t2)) ** 0.5, nd


def test_kendall_tau_b_heavy_ties(spark):
    from riskbook.operators.curves import kendall_tau_b
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, 400).astype(float)          # a few values, heavy ties
    y = np.where(rng.random(400) < 0.3, 7.0, rng.integers(0, 40, 400)).astype(float)   # one hot value
    df = spark.createDataFrame([(f"K{i:04d}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                               "policy_id string, x double, y double")
    tau, nd = _brute_tau_b(list(x), list(y))
    for block in (1000, 60, 25, 7, None):        # one block, and grids of more and more
        r = kendall_tau_b(df, "x", "y", block=block)
        assert r["discordant"] == nd
        assert r["tau_b"] == pytest.approx(tau, abs=1e-12)
