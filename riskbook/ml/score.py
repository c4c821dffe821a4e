"""Training (the full chain) and book scoring.

``train_all`` fits everything on a book split 60/20/20 by key hash; the driver only
ever receives coefficients, moments, encoder codes, the cell table (one row per
cell) and percentile anchors. ``score_book`` is one projection plus the Spark ML
tree transforms; it runs no action, so it also scores a streaming DataFrame.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskbook.functions.bands import risk_band, uw_action
from riskbook.functions.columns import clip, lit_d, rnd
from riskbook.ml.ensemble import DisplayModels, EnsembleParams, MHatModel, fit_ensemble
from riskbook.ml.glm import GLM, LAMBDA_CLIP, MU_CLIP, fit_gamma, fit_poisson, fit_tweedie
from riskbook.ml.prep import Prep
from riskbook.operators import experience as X
from riskbook.operators.quantiles import exact_quantiles
from riskbook.operators.sampling import fold_id, split, union_train_val
from riskbook.plans import rating as R
from riskbook.plans.features import cell_bound, cell_key
from riskbook.plans.interactions import active_interactions
from riskbook.plans.rules import input_warnings
from riskbook.session import collect_garbage

KEEP = ["policy_id", "claim_occurred", "claim_amount", "lambda_true", "mu_true", "M_true",
        "expected_loss_true", "indicated_premium", "risk_score_true"]


@dataclass
class ModelBundle:
    prep: Prep
    poisson: GLM
    gamma: GLM
    tweedie: GLM
    mhat: MHatModel
    display: DisplayModels
    cells: list                 # (cell, n, total_claim, total_expected, oe_raw, oe)
    scale_factor: float
    el_min: float
    el_max: float
    metrics: dict = field(default_factory=dict)


def _cell(df: DataFrame) -> DataFrame:
    """P17 on encoded columns (codes as integers)."""
    c = lambda n: F.col(n).cast("int")
    return df.withColumn("cell", cell_key(c("wildfire_zone"), c("roof_material"), c("flood_zone"),
                                          c("earthquake_zone"), F.col("slope_steepness_pct")))


def _with_glm(df: DataFrame, poisson: GLM, gamma: GLM) -> DataFrame:
    lam = poisson.predict(*LAMBDA_CLIP)
    mu = gamma.predict(*MU_CLIP)
    return df.select("*", lam.alias("lambda_glm"), mu.alias("mu_glm"), (lam * mu).alias("glm_el"))


def train_all(book: DataFrame, params: EnsembleParams = EnsembleParams(), alpha: float = 0.01,
              with_tweedie: bool = True) -> ModelBundle:
    import time
    clock = {"t": time.time()}
    timings: dict = {}

    def lap(name):
        now = time.time()
        timings[name] = round(now - clock["t"], 2)
        collect_garbage(book.sparkSession)  # each step leaves its passes behind
        clock["t"] = now

    sp = split(book)
    prep = Prep.fit(sp["train"])
    tr = _cell(prep.scaled(sp["train"], keep=KEEP)).persist(StorageLevel.MEMORY_AND_DISK)
    lap("prep")
    poisson = fit_poisson(tr, alpha)
    gamma = fit_gamma(tr, alpha)
    lap("poisson_gamma")
    tweedie = fit_tweedie(tr, 1.65, alpha) if with_tweedie else GLM("tweedie", 0.0, {})
    lap("tweedie")
    tr_g = _with_glm(tr, poisson, gamma)
    cells = X.group_oe(tr_g, "claim_amount", "glm_el", "cell", X.MIN_GROUP_TRAIN)
    cells_rows = [tuple(r) for r in cells.collect()]                   # one row per cell
    cells_df = book.sparkSession.createDataFrame(cells_rows, cells.schema)
    study = X.oe_normalise(tr_g, cells_df, "claim_amount", "glm_el", "cell", rows_bound=len(cells_rows))
    tr_t = X.normalised_target(tr_g, study).persist(StorageLevel.MEMORY_AND_DISK)
    va = _cell(prep.scaled(sp["val"], keep=KEEP))
    va_t = X.normalised_target(va, study)
    cols = KEEP + list(dict.fromkeys(prep_cols(prep))) + ["cell", "m_target", "train"]
    stack = union_train_val(tr_t.withColumn("train", F.lit(True)).select(*cols), va_t.withColumn("train", F.lit(False)).select(*cols))
    stack = stack.withColumns({"fold": fold_id(params.folds), "h": F.xxhash64("policy_id")}).persist(StorageLevel.MEMORY_AND_DISK)
    lap("oe_study")
    mhat, display = fit_ensemble(stack, params)
    lap("ensemble_and_display")
    # anchors on the test split
    te = _test_rows(sp["test"], prep, poisson, gamma, mhat).persist(StorageLevel.MEMORY_AND_DISK)
    el_min = exact_quantiles(te, "el_baseline", [0.01])[("", 0.01)] or 1.0
    el_max = exact_quantiles(te, "el_full", [0.99])[("", 0.99)] or 2.0
    bundle = ModelBundle(prep, poisson, gamma, tweedie, mhat, display, cells_rows, study.scale_factor,
                         float(el_min), float(el_max))
    lap("test_anchors")
    bundle.metrics = {"n_train": tr.count(), "n_cells": len(cells_rows), "scale_factor": study.scale_factor,
                      "overall_oe_train": study.overall_oe, **{"sec_" + k: v for k, v in timings.items()}}
    for d in (tr, tr_t, stack, te):
        d.unpersist()
    return bundle


def _test_rows(df: DataFrame, prep: Prep, poisson: GLM, gamma: GLM, mhat: MHatModel) -> DataFrame:
    te = mhat.transform(_with_glm(_cell(prep.scaled(df, keep=KEEP)), poisson, gamma))
    return te.withColumns({"el_baseline": F.col("glm_el"), "el_full": F.col("glm_el") * F.col("m_hat")})


def test_split(book: DataFrame, b: ModelBundle) -> DataFrame:
    """The held-out rows of ``book``, scored for ``evaluate``; the bundle may be a loaded one."""
    return b.display.transform(_test_rows(split(book)["test"], b.prep, b.poisson, b.gamma, b.mhat))


def prep_cols(prep: Prep) -> list[str]:
    from riskbook.plans.features import SEV_FEATS, T12
    return list(dict.fromkeys(SEV_FEATS + ["defensible_space_score"])) + ["z_" + c for c in T12]


def score_book(book: DataFrame, b: ModelBundle, cfg: R.PricingConfig = R.PricingConfig(),
               keep: list[str] = ("policy_id",)) -> DataFrame:
    """M8: lambda, mu (GLMs), M-hat (ensemble), E baseline / full, scores, premium,
    bands, action, score A2, interactions and warnings for every row of ``book``."""
    pre = book.select("*", active_interactions(cfg.m_overrides or None).alias("interactions"),
                      input_warnings().alias("warnings"))
    z = b.prep.scaled(pre, keep=list(keep) + ["interactions", "warnings"])
    z = _with_glm(z, b.poisson, b.gamma)
    z = b.mhat.transform(z)
    z = b.display.transform(z, cfg.lam_cap)
    lo, hi = math.log1p(b.el_min), math.log1p(b.el_max)
    el_b = F.col("glm_el")
    el_f = F.col("glm_el") * F.col("m_hat")
    sb, sf = R.score_a1(el_b, lo, hi), R.score_a1(el_f, lo, hi)
    f_sc, s_sc = R.sub_scores(F.col("lambda_disp"), F.col("mu_disp") * F.col("m_hat"), cfg)
    a2 = R.score_a2(F.col("lambda_disp"), F.col("mu_disp") * F.col("m_hat"), cfg)
    band_b, band_f = risk_band(sb), risk_band(sf)
    return z.select(
        *keep,
        rnd(F.col("lambda_glm"), 5).alias("lambda_pred"), rnd(F.col("mu_glm"), 2).alias("mu_pred"),
        rnd(F.col("m_hat"), 3).alias("m_hat"),
        rnd(F.col("lambda_disp"), 5).alias("lambda_display"), rnd(F.col("mu_disp"), 2).alias("mu_display"),
        rnd(el_f, 2).alias("pure_premium"),
        rnd(el_b, 2).alias("el_baseline"), rnd(el_f, 2).alias("expected_loss"),
        rnd(sb, 1).alias("score_baseline"), rnd(sf, 1).alias("risk_score_a1"),
        rnd(R.premium(el_b, cfg), 2).alias("premium_baseline"), rnd(R.premium(el_f, cfg), 2).alias("premium"),
        band_b.alias("band_baseline"), band_f.alias("risk_band"), uw_action(band_f).alias("uw_action"), uw_action(band_b).alias("uw_action_baseline"),
        rnd(a2, 1).alias("risk_score_a2"), rnd(f_sc, 1).alias("f_score"), rnd(s_sc, 1).alias("s_score"),
        rnd(R.tier3_share(F.col("m_hat")), 1).alias("pct_from_tier3"),
        "interactions", "warnings")


def ml_pair(scored: DataFrame, book: DataFrame | None = None) -> DataFrame:
    """M9: baseline (M-hat = 1) and full scores in the report pair shape (no join:
    both come from the same projection). ``actual`` needs the book's loss column."""
    cols = [F.col("policy_id"), F.col("el_baseline"), F.col("expected_loss").alias("el_full"),
            F.col("m_hat"), F.col("score_baseline"), F.col("risk_score_a1").alias("score_full"),
            F.col("band_baseline"), F.col("risk_band").alias("band_full"),
            F.col("premium_baseline"), F.col("premium").alias("premium_full")]
    if "actual" in scored.columns:
        cols.append(F.col("actual"))
    return scored.select(*cols)


def evaluate(b: ModelBundle, te: DataFrame) -> list[tuple[str, float]]:
    """Holdout report on the scored test rows (``test_split``): the GLMs by themselves, baseline and
    full chain, M-hat against test experience and true multiplier, display models, scores."""
    from riskbook.operators.curves import decile_loss_ratio, gini
    te = te.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _evaluated(b, te, decile_loss_ratio, gini)
    finally:
        te.unpersist()


def _evaluated(b: ModelBundle, te: DataFrame, decile_loss_ratio, gini) -> list[tuple[str, float]]:
    out: list[tuple[str, float]] = []
    r2 = X.reg_metrics(te, "expected_loss_true", "el_baseline").first()
    out.append(("glm_r2_vs_true_el", r2["r2"]))
    claimants = te.where("claim_occurred = 1")
    out += [("poisson_gini_occurrence", gini(te, "claim_occurred", "lambda_glm")), ("gamma_gini_claimants", gini(claimants, "claim_amount", "mu_glm"))]
    means = te.agg(*[F.avg(c).alias(c) for c in ("lambda_glm", "mu_glm", "el_baseline", "el_full", "expected_loss_true", "claim_occurred")]).first().asDict()
    out += [(f"mean_{k}", v) for k, v in means.items()]
    blocks = [("poisson", te, "lambda_true", "lambda_glm"), ("gamma", claimants, "claim_amount", "mu_glm"),
              ("display_freq", te, "lambda_true", "lambda_disp"), ("display_sev", te, "mu_true", "mu_disp")]
    for name, rows, y, yhat in blocks:
        out += [(f"{name}_{k}", v) for k, v in X.reg_metrics(rows, y, yhat).first().asDict().items()]
    gb = gini(te, "claim_amount", "el_baseline")
    gf = gini(te, "claim_amount", "el_full")
    out += [("gini_baseline", gb), ("gini_full", gf), ("gini_delta", gf - gb)]
    te_cells = X.group_oe(te, "claim_amount", "glm_el", "cell", X.MIN_GROUP_TEST)
    from riskbook.operators.joins import apply_cell_oe
    te_t = apply_cell_oe(te, te_cells, "cell", "oe", "te_oe", rows_bound=cell_bound(b.prep.encoder)) \
        .withColumn("te_target", clip(F.col("te_oe") / lit_d(b.scale_factor), 0.10, 8.0))
    m = X.reg_metrics(te_t, "te_target", "m_hat").first()
    out += [("mhat_r2_vs_test_oe", m["r2"]), ("mhat_mae", m["mae"]), ("mhat_rmse", m["rmse"]), ("mhat_mape", m["mape"])]
    out.append(("mhat_oracle_corr", X.pearson(te, "m_hat", "M_true").first()["corr"]))
    for kind, col in (("baseline", "el_baseline"), ("full", "el_full")):
        for r in decile_loss_ratio(te, "claim_amount", col, "indicated_premium").collect():
            out.append((f"decile_lr_{kind}_{r['decile']}", r["loss_ratio_pct"]))
    lo, hi = math.log1p(b.el_min), math.log1p(b.el_max)
    sc = te.select("risk_score_true", R.score_a1(F.col("el_full"), lo, hi).alias("score_full"))
    s = X.reg_metrics(sc, "risk_score_true", "score_full").first()
    out += [("score_r2_vs_true", s["r2"]), ("score_mae", s["mae"])]
    # M-hat distribution, premium uplift and reclassification on the test split (the
    # same report functions as the book-level reports, fed with the model pair)
    from riskbook.functions.bands import risk_band
    from riskbook.operators import portfolio as P
    sb = R.score_a1(F.col("el_baseline"), lo, hi)
    sf = R.score_a1(F.col("el_full"), lo, hi)
    pair = te.select("policy_id", "el_baseline", "el_full", "m_hat", sb.alias("score_baseline"),
                     sf.alias("score_full"), risk_band(sb).alias("band_baseline"), risk_band(sf).alias("band_full"))
    md = P.m_distribution(pair).first().asDict()
    out += [(f"mhat_{k}", v) for k, v in md.items()]
    up = P.premium_uplift(pair).first().asDict()
    out += [(f"uplift_{k}", v) for k, v in up.items()]
    rc = P.reclassification(pair).first().asDict()
    out += [(k, v) for k, v in rc.items()]
    out += [(k, float(v)) for k, v in b.metrics.items()]
    return [(k, None if v is None else float(v)) for k, v in out]
