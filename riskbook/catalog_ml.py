"""Registered model queries (M1-M16, S4, O1, O3). Fitted once per (application,
folder) on the fixture book; checked by the driver's rows-only rule and by our own
pytest invariants (no SQL oracle exists for a fitted model)."""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from riskbook.catalog import book, query
from riskbook.functions.columns import rnd
from riskbook.ml import attribution as AT
from riskbook.ml import glm as G
from riskbook.ml.ensemble import EnsembleParams, tree_importances
from riskbook.ml.score import evaluate, ml_pair, score_book, test_split, train_all
from riskbook.operators.sampling import split
from riskbook.sources import io as IO

_BUNDLES: dict = {}
#: Sizes of the ensemble that ``bundle`` fits; tests set small ones.
PARAMS = EnsembleParams()


def bundle(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUNDLES:
        _BUNDLES[key] = train_all(book(spark, sf_dir), PARAMS)
    return _BUNDLES[key]


def scored(spark, sf_dir):
    key = ("scored", spark.sparkContext.applicationId, sf_dir)
    if key not in _BUNDLES:
        bk = book(spark, sf_dir)
        _BUNDLES[key] = score_book(bk, bundle(spark, sf_dir), keep=["policy_id", "total_loss"]) \
            .withColumnRenamed("total_loss", "actual").persist(StorageLevel.MEMORY_AND_DISK)
    return _BUNDLES[key]


def _coef_df(spark, g):
    return spark.createDataFrame(g.rows(), "model string, feature string, beta double") \
        .select("model", "feature", rnd(F.col("beta"), 8).alias("beta"))


@query("poisson_glm")
def q_m1(spark, sf_dir):
    return _coef_df(spark, bundle(spark, sf_dir).poisson)


@query("gamma_glm")
def q_m2(spark, sf_dir):
    return _coef_df(spark, bundle(spark, sf_dir).gamma)


@query("tweedie_glm")
def q_m3(spark, sf_dir):
    return _coef_df(spark, bundle(spark, sf_dir).tweedie)


@query("glm_relativities")
def q_m4(spark, sf_dir):
    b = bundle(spark, sf_dir)
    return G.glm_relativities_table(spark, [b.poisson, b.gamma, b.tweedie])


@query("top_relativities")
def q_o1(spark, sf_dir):
    b = bundle(spark, sf_dir)
    return G.top_relativities(G.glm_relativities_table(spark, [b.poisson, b.gamma, b.tweedie]), 6)


@query("glm_baseline_score")
def q_m5(spark, sf_dir):
    return scored(spark, sf_dir).select("policy_id", "lambda_pred", "mu_pred", "el_baseline", "score_baseline",
                                        "premium_baseline", "band_baseline")


@query("mhat_base_learners")
def q_m6(spark, sf_dir):
    b = bundle(spark, sf_dir)
    allp = b.prep.encoded(book(spark, sf_dir), keep=["policy_id"])
    out = b.mhat.base_learners(allp)
    return out.select("policy_id", rnd(F.col("p_rf"), 6).alias("p_rf"), rnd(F.col("p_gbt"), 6).alias("p_gbt"),
                      rnd(F.col("p_et"), 6).alias("p_et"))


@query("mhat_stack")
def q_m7(spark, sf_dir):
    b = bundle(spark, sf_dir)
    allp = b.prep.encoded(book(spark, sf_dir), keep=["policy_id", "M_true"])
    return b.mhat.transform(allp).select("policy_id", rnd(F.col("m_hat"), 6).alias("m_hat"), "M_true")


@query("score_book")
def q_m8(spark, sf_dir):
    return scored(spark, sf_dir)


@query("predict_both")
def q_m9(spark, sf_dir):
    return ml_pair(scored(spark, sf_dir))


@query("display_freq_sev")
def q_m10(spark, sf_dir):
    b = bundle(spark, sf_dir)
    enc = b.prep.encoded(book(spark, sf_dir), keep=["policy_id", "lambda_true", "mu_true"])
    return b.display.transform(enc).select("policy_id", rnd(F.col("lambda_disp"), 6).alias("lambda_disp"),
                                           rnd(F.col("mu_disp"), 2).alias("mu_disp"), "lambda_true", "mu_true")


@query("model_eval")
def q_m11(spark, sf_dir):
    return spark.createDataFrame(evaluate(bundle(spark, sf_dir), test_split(book(spark, sf_dir), bundle(spark, sf_dir))), "metric string, value double")


@query("glm_attribution")
def q_m12(spark, sf_dir):
    b = bundle(spark, sf_dir)
    z = b.prep.scaled(book(spark, sf_dir), keep=["policy_id"])
    return AT.glm_attribution(z, [b.poisson, b.gamma], top=24)


@query("top_n_attribution")
def q_o3(spark, sf_dir):
    b = bundle(spark, sf_dir)
    z = b.prep.scaled(book(spark, sf_dir), keep=["policy_id"])
    return AT.glm_attribution(z, [b.poisson, b.gamma], top=15)


@query("mhat_attribution")
def q_m13(spark, sf_dir):
    b = bundle(spark, sf_dir)
    bk = book(spark, sf_dir)
    ref = AT.reference_values(b.prep.encoded(split(bk)["train"]))
    return AT.mhat_ablation(b.prep.encoded(bk, keep=["policy_id"]), b.mhat, ref, top=15)


@query("feature_importance")
def q_m14(spark, sf_dir):
    b = bundle(spark, sf_dir)
    return AT.importances([b.poisson, b.gamma], tree_importances(b.mhat), spark, 15)


@query("interaction_lrt")
def q_m15(spark, sf_dir):
    b = bundle(spark, sf_dir)
    tr = AT.interaction_terms(book(spark, sf_dir))          # the whole book
    z = b.prep.scaled(tr, keep=["policy_id", "claim_occurred", "claim_amount", *AT.INTERACTION_TERMS]).persist(StorageLevel.MEMORY_AND_DISK)
    found = [AT.interaction_lrt(z), AT.interaction_lrt(z, 2.0, "claim_amount")]
    z.unpersist()
    return spark.createDataFrame([tuple(r.values()) for r in found],
                                 "family string, n_rows long, deviance_reduced double, deviance_full double, lr_statistic double, df int, p_value double, "
                                 "dispersion double, f_statistic double, p_value_f double")


@query("save_load_model")
def q_s4(spark, sf_dir):
    from riskbook.sources.models import load_model, save_model
    b = bundle(spark, sf_dir)
    path = save_model(b, spark, IO.scratch_path(spark, "model"))
    b2 = load_model(spark, path)
    return score_book(book(spark, sf_dir), b2).select("policy_id", "m_hat", "expected_loss", "risk_score_a1", "premium")


@query("submission_stream")
def q_m16(spark, sf_dir):
    from riskbook.streaming.submissions import run_submissions
    b = bundle(spark, sf_dir)
    src = IO.scratch_path(spark, "submissions")
    IO.write_policies(book(spark, sf_dir), src)          # every policy arrives as a submission file
    out = run_submissions(spark, b, src, IO.scratch_path(spark, "scored"), IO.scratch_path(spark, "stream-ckpt"))
    return out.select("policy_id", "m_hat", "expected_loss", "risk_score_a1", "premium", "risk_band")


@query("save_model")
def q_s4_save(spark, sf_dir):
    """S4 (write): a new version of the fitted bundle; lists the tables that its manifest commits."""
    from riskbook.sources.models import committed, save_model
    path = save_model(bundle(spark, sf_dir), spark, IO.scratch_path(spark, "model"))
    rows = [(name, n) for name, (n, _) in committed(spark, path)["tables"].items()]
    return spark.createDataFrame(rows, "part string, rows long")


@query("load_model")
def q_s4_load(spark, sf_dir):
    """S4 (read): reload a saved bundle and score the whole book with it."""
    from riskbook.sources.models import load_model, save_model
    path = save_model(bundle(spark, sf_dir), spark, IO.scratch_path(spark, "model"))
    return score_book(book(spark, sf_dir), load_model(spark, path)).select(
        "policy_id", "m_hat", "expected_loss", "risk_score_a1", "premium", "risk_band")


@query("predict_whatif")
def q_m9_whatif(spark, sf_dir):
    """M9 (what-if): the same edit applied to every policy, scored by the model chain, with deltas
    against the unedited scores; a row carries its first scores and raw fields to the second scoring."""
    from riskbook.catalog import WHATIF_CHANGES
    from riskbook.operators.joins import with_overrides
    b = bundle(spark, sf_dir)
    bk = book(spark, sf_dir)
    fields = [c for c in bk.columns if c != "policy_id"]
    base = score_book(bk.withColumn("raw", F.struct(*fields)), b, keep=["policy_id", "raw"])
    first = F.struct("expected_loss", "risk_score_a1", "premium", "m_hat")
    edited = with_overrides(base.select("policy_id", first.alias("first"), "raw.*"), WHATIF_CHANGES)
    new = score_book(edited, b, keep=["policy_id", "first"])
    j = new.select("policy_id", "first.*", F.col("expected_loss").alias("el_new"), F.col("risk_score_a1").alias("score_new"),
                   F.col("premium").alias("premium_new"), F.col("m_hat").alias("m_new"))
    return j.select("policy_id", rnd(F.col("el_new") - F.col("expected_loss"), 2).alias("d_el"),
                    rnd(F.col("score_new") - F.col("risk_score_a1"), 1).alias("d_score"),
                    rnd(F.col("premium_new") - F.col("premium"), 2).alias("d_premium"),
                    rnd(F.col("m_new") - F.col("m_hat"), 3).alias("d_m"))


# ── what SQL can say about fitted models: score equations and identities ─────
@query("glm_balance")
def q_glm_balance(spark, sf_dir):
    """M1-M3: the intercepts' score equations on the fitting rows. Poisson: fitted claims add up to the
    claims; Gamma: y / mu adds up to the claimants; Tweedie: sum y mu^(1-p) over sum mu^(2-p) is 1."""
    b = bundle(spark, sf_dir)
    z = b.prep.scaled(split(book(spark, sf_dir))["train"], keep=["claim_occurred", "claim_amount"])
    y = F.col("claim_amount").cast("double")
    t = z.agg(F.count("*").alias("n"), F.sum(F.col("claim_occurred").cast("double")).alias("claims"),
              F.sum(b.poisson.predict()).alias("lam"), F.sum((y > 0).cast("long")).alias("claimants"),
              F.sum(F.when(y > 0, y / b.gamma.predict())).alias("ratio"),
              (F.sum(y * F.pow(b.tweedie.predict(), F.lit(1 - 1.65))) / F.sum(F.pow(b.tweedie.predict(), F.lit(2 - 1.65)))).alias("tw"))
    row = lambda name, n, actual, fitted: F.struct(F.lit(name).alias("model"), F.col(n).alias("n_rows"), actual.alias("actual"),
                                                   rnd(F.col(fitted), 3).alias("fitted"))
    rows = F.array(row("poisson", "n", F.col("claims"), "lam"), row("gamma", "claimants", F.col("claimants").cast("double"), "ratio"),
                   row("tweedie", "n", F.lit(1.0), "tw"))
    return t.select(F.explode(rows).alias("r")).select("r.*")


@query("attribution_identity")
def q_attribution_identity(spark, sf_dir):
    """Rows of the full attribution, and policies whose contributions don't add up to eta."""
    parts = q_m12(spark, sf_dir).groupBy("policy_id", "model").agg(
        F.count("*").alias("n"), (F.sum("contribution") + F.first("base") - F.first("eta")).alias("off"))
    return parts.agg(F.sum("n").alias("n_rows"), F.sum((F.abs("off") > 1e-5).cast("long")).alias("n_off"))


@query("model_identity")
def q_model_identity(spark, sf_dir):
    """Policies, and those scored otherwise by the reloaded model or by the stream."""
    cols = ["m_hat", "expected_loss", "risk_score_a1", "premium"]
    batch = scored(spark, sf_dir).select("policy_id", *cols)

    def off(other, name):
        o = other.select("policy_id", F.struct(*cols).alias(name))
        return o, F.coalesce(F.col(name) != F.struct(*cols), F.lit(True)).cast("long")

    again, a = off(q_s4_load(spark, sf_dir), "again")
    stream, s = off(q_m16(spark, sf_dir), "stream")
    j = batch.join(again, "policy_id", "left").join(stream, "policy_id", "left")
    return j.agg(F.count("*").alias("policies"), F.sum(a).alias("reloaded_off"), F.sum(s).alias("streamed_off"))


# ── the reports of A14-A18 and W5 on the model-scored pair (reference: test split
#    and batch scores of the model); same functions as the plan-pair reports ──────
def _model_pair(spark, sf_dir):
    return ml_pair(scored(spark, sf_dir))


@query("m_distribution_model")
def q_a14_model(spark, sf_dir):
    from riskbook.operators import portfolio as P
    return P.m_distribution(_model_pair(spark, sf_dir))


@query("premium_uplift_model")
def q_a15_model(spark, sf_dir):
    from riskbook.operators import portfolio as P
    return P.premium_uplift(_model_pair(spark, sf_dir))


@query("reclassification_model")
def q_a16_model(spark, sf_dir):
    from riskbook.operators import portfolio as P
    return P.reclassification(_model_pair(spark, sf_dir))


@query("reclass_threshold_model")
def q_a17_model(spark, sf_dir):
    from riskbook.operators import portfolio as P
    return P.reclass_threshold(_model_pair(spark, sf_dir))


@query("hidden_danger_leakage_model")
def q_a18_model(spark, sf_dir):
    from riskbook.operators import portfolio as P
    return P.leakage(_model_pair(spark, sf_dir))


@query("decile_lift_model")
def q_w5_model(spark, sf_dir):
    from riskbook.operators import curves as C
    return C.decile_lift(_model_pair(spark, sf_dir))
