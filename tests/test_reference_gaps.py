"""Exact split, percent rank, tolerant reader, nested tests, centred R2, bundle versions."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskbook.operators import curves as C
from riskbook.operators import experience as X
from riskbook.operators import sampling as O
from riskbook.sources import io as IO


@pytest.mark.parametrize("narrow", [4096, 2])
def test_exact_split_shares_are_exact_in_every_stratum(spark, narrow):
    sizes = {("a", 1): 700, ("a", 0): 13, ("b", 1): 1, (None, 0): 2, ("c", None): 57}
    rows = [(f"P{k}{s}{c}", s, c, 1) for (s, c), n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "policy_id string, state string, claim int, h int")
    got = O.split_exact(df, ["state", "claim"], narrow=narrow).toPandas()
    assert len(got) == len(rows) and list(got.columns) == [*df.columns, "split"]
    import hashlib
    for (s, c), n in sizes.items():
        mine = got[(got["state"].isna() if s is None else got["state"] == s) & (got["claim"].isna() if c is None else got["claim"] == c)]
        order = mine.assign(u=[int(hashlib.md5(f"{k}split".encode()).hexdigest()[:15], 16) for k in mine["policy_id"]]).sort_values(["u", "policy_id"])
        first, second = math.floor(n * 0.6 + 0.5), math.floor(n * (0.6 + 0.2) + 0.5)
        assert order["split"].tolist() == ["train"] * first + ["val"] * (second - first) + ["test"] * (n - second)
    assert O.split_exact(df.limit(0), ["state"]).count() == 0


def test_percent_rank_of_runs_that_go_over_ranges(spark):
    rng = np.random.default_rng(3)
    values = [5.0] * 400 + [7.0] * 3 + rng.integers(0, 9, 200).astype(float).tolist() + [None, None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "policy_id long, x double").repartition(5)
    got = C.percent_rank_score(df, "x").toPandas().sort_values("policy_id")["percent_rank"].to_numpy()
    v = np.array([-np.inf if x is None else x for x in values])
    want = np.array([(v < x).sum() for x in v]) / (len(v) - 1)
    assert np.allclose(got, want, atol=1e-8)
    assert C.percent_rank_score(df.limit(1), "x").collect()[0]["percent_rank"] == 0.0
    assert C.percent_rank_score(df.limit(0), "x").count() == 0
    plan = C.percent_rank_score(df, "x")._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan


def test_unreadable_fields_are_null_and_listed(spark, book):
    path = IO.scratch_path(spark, "odd") + ".csv"
    few = book.orderBy("policy_id").limit(4)
    names = [r["policy_id"] for r in few.select("policy_id").collect()]
    odd = few.withColumns({"policy_year": F.when(F.col("policy_id") == names[1], "20x1").otherwise(F.col("policy_year").cast("string")),
                           "total_loss": F.when(F.col("policy_id") == names[2], "12,5").otherwise(F.col("total_loss").cast("string"))})
    IO.write_policies(odd, path, fmt="csv")
    back = {r["policy_id"]: r for r in IO.read_policies(spark, path).collect()}
    assert len(back) == 4 and back[names[1]]["policy_year"] is None and back[names[2]]["total_loss"] is None and back[names[0]]["policy_year"]
    bad = sorted((r["policy_id"], r["column"], r["text"]) for r in IO.bad_fields(spark, path).collect())
    assert bad == [(names[1], "policy_year", "20x1"), (names[2], "total_loss", "12,5")]


def test_r2_on_a_large_mean(spark):
    y = [1e9 + 0.1 * k for k in range(100)]
    df = spark.createDataFrame([(v, v + 0.01 * (-1) ** k) for k, v in enumerate(y)], "y double, p double").repartition(7)
    centred = np.array(y) - 1e9
    want = 1 - 100 * 0.01 ** 2 / ((centred - centred.mean()) ** 2).sum()
    assert X.reg_metrics(df, "y", "p").first()["r2"] == pytest.approx(want, abs=1e-6)


def test_nested_tests_equal_numpy(spark):
    from riskbook.ml.attribution import _f_sf, interaction_lrt
    from riskbook.plans.features import T12
    rng = np.random.default_rng(6)
    n = 400
    frame = pd.DataFrame(rng.normal(size=(n, len(T12))), columns=["z_" + c for c in T12])
    frame["t1"], frame["t2"] = rng.integers(0, 2, n).astype(float), rng.integers(0, 2, n).astype(float)
    mean = np.exp(0.2 + 0.3 * frame["z_home_age"] + 0.4 * frame["t1"])
    frame["count"], frame["amount"] = rng.poisson(mean).astype(float), rng.gamma(2.0, mean / 2)
    df = spark.createDataFrame(frame).repartition(3)

    def plain(y, cols, p):
        x, b = np.column_stack([np.ones(len(y)), *[frame[c] for c in cols]]), np.zeros(len(cols) + 1)
        b[0] = np.log(y.mean())
        for _ in range(60):
            mu = np.exp(x @ b)
            w = mu ** (2 - p)
            b = b + np.linalg.lstsq((x.T * w) @ x, x.T @ ((y - mu) * mu ** (1 - p)), rcond=None)[0]
        mu = np.exp(x @ b)
        dev = 2 * np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0).sum() - 2 * (y - mu).sum() if p == 1 else 2 * (-np.log(y / mu) + (y - mu) / mu).sum()
        return dev, ((y - mu) ** 2 / mu ** p).sum() / (len(y) - len(b))

    for p, label in ((1.0, "count"), (2.0, "amount")):
        got = interaction_lrt(df, p, label, ["t1", "t2"])
        base = ["z_" + c for c in T12]
        y = frame[label].to_numpy()
        reduced, _ = plain(y, base, p)
        full, phi = plain(y, [*base, "t1", "t2"], p)
        assert got["deviance_reduced"] == pytest.approx(reduced, rel=1e-7) and got["deviance_full"] == pytest.approx(full, rel=1e-7)
        assert got["dispersion"] == pytest.approx(phi, rel=1e-6) and got["df"] == 2
        assert got["f_statistic"] == pytest.approx((reduced - full) / 2 / phi, rel=1e-5)
        assert got["p_value"] < 0.01 and got["p_value_f"] < 0.01
    assert _f_sf(4.2565, 2, 9) == pytest.approx(0.05, abs=1e-4) and _f_sf(3.0, 1, 120) == pytest.approx(0.0858, abs=1e-3) and _f_sf(0, 2, 3) == 1


def test_a_writer_that_dies_leaves_the_version_before(spark, book, bundle, monkeypatch):
    from riskbook.ml.score import evaluate, score_book, test_split
    from riskbook.sources import models
    path = models.save_model(bundle, spark, IO.scratch_path(spark, "versions"))
    before = models.committed(spark, path)
    prints = models._fingerprint
    calls = []
    monkeypatch.setattr(models, "_fingerprint", lambda df: calls.append(1) or (_ for _ in ()).throw(OSError("lost")) if len(calls) > 3 else calls.append(1) or prints(df))
    with pytest.raises(OSError):
        models.save_model(bundle, spark, path)
    monkeypatch.setattr(models, "_fingerprint", prints)
    assert models.committed(spark, path) == before
    again = models.load_model(spark, path)
    a, b = (score_book(book, x).select("policy_id", "expected_loss", "risk_score_a2").orderBy("policy_id").toPandas() for x in (bundle, again))
    assert a.equals(b)
    found = dict(evaluate(again, test_split(book, again)))
    assert {"poisson_gini_occurrence", "gamma_gini_claimants", "display_freq_r2", "display_sev_mape", "mhat_mape", "mean_el_full"} <= set(found)
    table = f"{path}/{before['version']}/scalars"
    spark.createDataFrame([("el_min", 5.0)], "name string, value double").write.mode("append").parquet(table)
    with pytest.raises(ValueError):
        models.load_model(spark, path)
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, IO.scratch_path(spark, "nothing"))
