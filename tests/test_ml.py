"""Model invariants (fitted operators have no SQL oracle)."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskbook.ml.ensemble import EnsembleParams
from riskbook.ml.score import score_book, train_all
from riskbook.operators.sampling import fold_id, split
from riskbook.plans.features import T12

SMALL = EnsembleParams(rf_trees=8, gbt_iter=5, et_trees=8, oof_rf_trees=4, oof_gbt_iter=3, oof_et_trees=4, display_iter=4, max_bins=16, forest_bins=16)


def test_poisson_score_equations(spark, book, bundle):
    """At the penalised optimum: X'(y - mu)/n = alpha * beta (intercept row: 0)."""
    tr = bundle.prep.scaled(split(book)["train"], keep=["claim_occurred"])
    g = bundle.poisson
    mu = F.exp(g.eta())
    aggs = [F.avg(F.col("claim_occurred") - mu).alias("g0")] + \
           [F.avg((F.col("claim_occurred") - mu) * F.col("z_" + c)).alias("g_" + c) for c in T12]
    r = tr.agg(*aggs).first()
    mean_y = tr.agg(F.avg("claim_occurred")).first()[0]
    assert abs(r["g0"]) < 1e-8
    for c in T12:
        assert r["g_" + c] == pytest.approx(0.01 * g.coef[c], abs=1e-8)


def test_relativities_are_exp_coef(bundle):
    rel = bundle.poisson.relativities()
    for f, b in bundle.poisson.coef.items():
        assert rel[f] == round(math.exp(b), 4)


def test_tweedie_converges(bundle):
    assert bundle.tweedie.coef and all(np.isfinite(list(bundle.tweedie.coef.values())))


def test_scoring_identity_and_ranges(book, bundle):
    s = score_book(book, bundle)
    r = s.agg(F.min("m_hat"), F.max("m_hat"), F.min("risk_score_a1"), F.max("risk_score_a1"),
              F.max(F.abs(F.col("expected_loss") - F.col("el_baseline") * F.col("m_hat"))
                    - F.col("el_baseline") * 0.0005 - F.col("m_hat") * 0.005 - 0.01),
              F.count("*")).first()
    assert 0.10 <= r[0] and r[1] <= 8.0
    assert 50 <= r[2] and r[3] <= 950
    assert r[4] <= 1e-6          # differences come from rounding m_hat to 3 decimals only
    assert r[5] == book.count()


def test_mhat_one_gives_baseline(book, bundle):
    """With M-hat forced to 1 the full chain collapses to the GLM baseline."""
    from riskbook.ml.score import _with_glm
    z = _with_glm(bundle.prep.scaled(book, keep=["policy_id"]), bundle.poisson, bundle.gamma)
    d = z.select(F.max(F.abs(F.col("glm_el") * F.lit(1.0) - F.col("lambda_glm") * F.col("mu_glm")))).first()[0]
    assert d < 1e-9


def test_isotonic_monotone(bundle):
    b, p = bundle.mhat.points, bundle.mhat.values
    assert np.all(np.diff(b) >= 0) and np.all(np.diff(p) >= -1e-12)


def test_folds_disjoint_and_complete(book):
    f = book.select("policy_id", fold_id(5).alias("fold"))
    r = f.groupBy("fold").count().collect()
    assert sorted(x["fold"] for x in r) == [0, 1, 2, 3, 4]
    assert sum(x["count"] for x in r) == book.count()


def test_glm_attribution_sums_to_eta(book, bundle):
    from riskbook.ml.attribution import glm_attribution
    z = bundle.prep.scaled(book, keep=["policy_id"])
    a = glm_attribution(z, [bundle.poisson], top=len(T12))
    chk = a.groupBy("policy_id").agg((F.sum("contribution") + F.first("base") - F.first("eta")).alias("d"))
    assert chk.select(F.max(F.abs("d"))).first()[0] < 1e-6


def test_save_load_identical_scores(spark, book, bundle):
    from riskbook.sources.io import scratch_path
    from riskbook.sources.models import load_model, save_model
    path = save_model(bundle, spark, scratch_path(spark, "model-test"))
    b2 = load_model(spark, path)
    a = score_book(book, bundle).select("policy_id", "expected_loss", "risk_score_a1")
    b = score_book(book, b2).select("policy_id", F.col("expected_loss").alias("e2"), F.col("risk_score_a1").alias("s2"))
    j = a.join(b, "policy_id")
    assert j.where((F.col("expected_loss") != F.col("e2")) | (F.col("risk_score_a1") != F.col("s2"))).count() == 0


def test_stream_equals_batch(spark, book, bundle):
    from riskbook.sources.io import scratch_path, write_policies
    from riskbook.streaming.submissions import run_submissions
    src = scratch_path(spark, "subm")
    write_policies(book.repartition(3), src)
    out = run_submissions(spark, bundle, src, scratch_path(spark, "sink"), scratch_path(spark, "ck"))
    batch = score_book(book, bundle).select("policy_id", F.col("expected_loss").alias("b"))
    j = out.select("policy_id", "expected_loss").join(batch, "policy_id")
    assert j.count() == book.count()
    assert j.where(F.col("expected_loss") != F.col("b")).count() == 0


def test_lrt_pvalue_helper():
    from riskbook.ml.attribution import _chi2_sf
    assert _chi2_sf(12.5916, 6) == pytest.approx(0.05, abs=1e-4)
    assert _chi2_sf(3.84146, 1) == pytest.approx(0.05, abs=1e-4)


def test_tweedie_score_equations(book, bundle):
    """At the IRLS optimum: X'((y - mu) mu^(1-p))/n = alpha * beta (intercept row: 0)."""
    tr = bundle.prep.scaled(split(book)["train"], keep=["claim_amount"])
    g, p = bundle.tweedie, 1.65
    mu = F.exp(g.eta())
    r_ = (F.col("claim_amount") - mu) * F.pow(mu, 1 - p)
    r = tr.agg(F.avg(r_).alias("g0"), *[F.avg(r_ * F.col("z_" + c)).alias("g_" + c) for c in T12]).first()
    assert abs(r["g0"]) < 1e-6 * max(1.0, abs(g.intercept))
    for c in T12:
        assert r["g_" + c] == pytest.approx(0.01 * g.coef[c], abs=1e-6)


def test_stream_resumes_from_checkpoint(spark, book, bundle):
    """Two arrivals, two availableNow runs on one checkpoint: every row scored once."""
    from riskbook.sources.io import scratch_path, write_policies
    from riskbook.streaming.submissions import run_submissions
    src, sink, ck = scratch_path(spark, "subm2"), scratch_path(spark, "sink2"), scratch_path(spark, "ck2")
    first = book.where(F.col("policy_year") <= 2022)
    second = book.where(F.col("policy_year") > 2022)
    write_policies(first, f"{src}/a")
    out1 = run_submissions(spark, bundle, f"{src}/*", sink, ck)
    n1 = out1.count()
    write_policies(second, f"{src}/b")
    out2 = run_submissions(spark, bundle, f"{src}/*", sink, ck)
    assert n1 == first.count()
    assert out2.count() == book.count()
    assert out2.select("policy_id").distinct().count() == book.count()


def test_gamma_score_equations(book, bundle):
    """Gamma, log link, claimants only: mean((y - mu)/mu * z) = alpha * beta at the optimum."""
    tr = bundle.prep.scaled(split(book)["train"], keep=["claim_amount"]).where(F.col("claim_amount") > 0)
    g = bundle.gamma
    mu = F.exp(g.eta())
    r_ = (F.col("claim_amount") - mu) / mu
    r = tr.agg(F.avg(r_).alias("g0"), *[F.avg(r_ * F.col("z_" + c)).alias("g_" + c) for c in T12]).first()
    assert abs(r["g0"]) < 1e-8
    for c in T12:
        assert r["g_" + c] == pytest.approx(0.01 * g.coef[c], abs=1e-8)


def test_spark_glr_option_close_to_newton(spark):
    """The Spark ML GLR option lands near the exact optimum at sf0.01."""
    from riskbook.catalog import book as cached_book
    from riskbook.ml.glm import fit_poisson
    from riskbook.ml.prep import Prep
    bk = cached_book(spark, "/root/testdata/sf0.01")
    sp = split(bk)
    tr = Prep.fit(sp["train"]).scaled(sp["train"], keep=["claim_occurred"])
    a, b = fit_poisson(tr), fit_poisson(tr, solver="spark-glr")
    assert a.intercept == pytest.approx(b.intercept, abs=0.02)
    assert max(abs(a.coef[c] - b.coef[c]) for c in T12) < 0.02
