"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator key.

Every query reads the driver tables through the fixture book, so its work grows
with the data. The book is built once per (application, folder) and written to the
shared scratch folder (S5); all reports of a run are served from it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskbook.functions import bands as B
from riskbook.functions.columns import hash_uniform, lit_d, rnd
from riskbook.operators import curves as C
from riskbook.operators import experience as X
from riskbook.operators import joins as J
from riskbook.operators import portfolio as P
from riskbook.operators import sampling as O
from riskbook.plans import features as FE
from riskbook.plans import interactions as IX
from riskbook.plans import rating as R
from riskbook.plans import rules as V
from riskbook.sources import io as IO
from riskbook.sources.book import build_book, release_cached, winsorize
from riskbook.sources.fixture import state_dim
from riskbook.session import compiled_methods, hold, release, scratch_folder

QUERIES: dict = {}
_BOOKS: dict = {}
_FOLDERS: dict = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored book for ``sf_dir``, built and written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    compiled_methods(spark)        # the reports' projections are wide as well
    if key not in _BOOKS:
        # Parquet in the shared spark.checkpoint.dir: the lineage (hash features, joins, cap
        # passes) is cut, so a lost executor re-reads files instead of recomputing the book,
        # and a report reads its own columns only.
        path = hold(scratch_folder(spark, "book"))  # outlives the lease of the report that asks first
        built = build_book(spark, sf_dir)
        built.write.parquet(path)
        release_cached()           # the pre-cap intermediate is no longer needed
        _BOOKS[key] = spark.read.schema(built.schema).parquet(path)
        _FOLDERS[key] = path
    return _BOOKS[key]


def release_books(spark: SparkSession) -> None:
    """Delete the books' folders; reports build them anew."""
    for key in [k for k in _FOLDERS if k[0] == spark.sparkContext.applicationId]:
        _BOOKS.pop(key, None)
        release(spark, _FOLDERS.pop(key))


def pair(spark, sf_dir) -> DataFrame:
    return P.plan_score_pair(book(spark, sf_dir))


def _explode_texts(df: DataFrame, arr) -> DataFrame:
    return df.select("policy_id", F.posexplode(arr).alias("pos", "text"))


def _fitted_split(spark, sf_dir):
    """Train / test split of the book with the encoder fitted on train."""
    sp = O.split(book(spark, sf_dir))
    enc = FE.Encoder.fit(sp["train"])
    return sp, enc


# ── S: sources and sinks ──────────────────────────────────────────────────
@query("read_policies")
def q_read_policies(spark, sf_dir):
    """CSV round trip with the fixed schema: count and column sums."""
    path = IO.scratch_path(spark, "policies") + ".csv"
    IO.write_policies(book(spark, sf_dir), path, fmt="csv")
    df = IO.read_policies(spark, path)
    return df.agg(F.count("*").alias("policies"), rnd(F.sum("indicated_premium"), 2).alias("total_premium"),
                  rnd(F.sum("total_loss"), 2).alias("total_loss"), F.sum("home_value").alias("total_value"),
                  F.sum(F.col("defensible_space_score").isNull().cast("int")).cast("long").alias("null_defensible"))


@query("read_policies_dirty")
def q_read_policies_dirty(spark, sf_dir):
    """A CSV book in which a twentieth of the rows hold unreadable fields: rows stay, fields are null
    and listed."""
    dirty = hash_uniform(F.col("policy_id"), "dirty") < F.lit(0.05)
    path = IO.scratch_path(spark, "dirty") + ".csv"
    bk = book(spark, sf_dir)
    text = lambda c: F.concat(F.col(c).cast("string"), F.lit("x"))
    IO.write_policies(bk.withColumns({"home_value": F.when(dirty, text("home_value")).otherwise(F.col("home_value").cast("string")),
                                      "credit_score": F.when(dirty & (F.col("credit_score") > 700), text("credit_score")).otherwise(F.col("credit_score").cast("string"))}), path, fmt="csv")
    good = IO.read_policies(spark, path).agg(F.count("*").alias("policies"), F.sum("home_value").alias("total_value"), F.count_if(F.col("home_value").isNull()).alias("null_value"),
                                             F.sum("credit_score").alias("total_score"))
    bad = IO.bad_fields(spark, path).agg(F.count_if(F.col("column") == "home_value").alias("bad_value"), F.count_if(F.col("column") == "credit_score").alias("bad_score"))
    one = F.lit(1).alias("one")
    return good.select("*", one).join(bad.select("*", one), "one").select("policies", "bad_value", "bad_score", "total_value", "null_value", "total_score")  # one row each


@query("holdout_sample_part")
def q_holdout_sample_part(spark, sf_dir):
    """No held-out file, a sample smaller than the book."""
    return O.holdout_or_sample(spark, book(spark, sf_dir), None, 500, "7").select("policy_id", "expected_loss_true")


@query("holdout_or_sample")
def q_holdout_or_sample(spark, sf_dir):
    """No held-out file here -> the 20,000-row seeded sample of the book."""
    s = O.holdout_or_sample(spark, book(spark, sf_dir), None, 20_000, "42")
    return s.select("policy_id", "expected_loss_true")


@query("write_policies")
def q_write_policies(spark, sf_dir):
    """S3: parquet partitioned by state, read back: per-state counts and premium."""
    path = IO.scratch_path(spark, "book")
    IO.write_policies(book(spark, sf_dir), path, partition_by=["state"])
    back = spark.read.parquet(path)
    return back.groupBy("state").agg(F.count("*").alias("policies"),
                                     rnd(F.sum("indicated_premium"), 2).alias("premium"))


@query("cached_scores")
def q_cached_scores(spark, sf_dir):
    """One persisted book serving two reports (A1 and A7) united."""
    bk = book(spark, sf_dir)
    k = P.kpis(bk).select(F.lit("kpi").alias("report"), F.lit("all").alias("key"),
                          F.col("total_premium").alias("value"))
    lr = P.loss_ratio_by_band(bk).select(F.lit("loss_ratio").alias("report"), F.col("risk_band").alias("key"),
                                         F.col("loss_ratio_pct").alias("value"))
    return k.unionByName(lr)


# ── P: projections ────────────────────────────────────────────────────────
@query("home_age_year_built")
def q_p1(spark, sf_dir):
    return FE.with_age(book(spark, sf_dir)).select("policy_id", "year_built_calc", "home_age_submission")


@query("coverage_ratio")
def q_p2(spark, sf_dir):
    return book(spark, sf_dir).select("policy_id", FE.coverage_ratio("single").alias("ratio_single"),
                                      rnd(FE.coverage_ratio("batch"), 8).alias("ratio_batch"))


@query("credit_restricted")
def q_p3(spark, sf_dir):
    return book(spark, sf_dir).select("policy_id", FE.credit_flag("data").alias("flag_data"),
                                      FE.credit_flag("inference").alias("flag_inference"),
                                      FE.credit_flag("form").alias("flag_form"),
                                      FE.form_credit_score().alias("form_credit_score"))


@query("trend_factor")
def q_p4(spark, sf_dir):
    return book(spark, sf_dir).select("policy_id", FE.trend_factor().alias("trend_factor"))


@query("vintage_multiplier")
def q_p5(spark, sf_dir):
    return FE.with_vintage(book(spark, sf_dir).select("policy_id", "policy_year")).select(
        "policy_id", "policy_year", "vintage_mult")


@query("permit_score")
def q_p6(spark, sf_dir):
    return book(spark, sf_dir).select("policy_id", FE.permit_adjusted().alias("permit_adjusted"))


@query("renewal_credit")
def q_p7(spark, sf_dir):
    return book(spark, sf_dir).select("policy_id", R.renewal_credit().alias("renewal_credit"))


@query("label_encode")
def q_p8(spark, sf_dir):
    sp, enc = _fitted_split(spark, sf_dir)
    return spark.createDataFrame(enc.to_rows(), "column string, value string, code int")


@query("label_encode_large")
def q_p8_large(spark, sf_dir):
    """P8 on a column with a value a policy: codes from a dictionary table."""
    bk = book(spark, sf_dir).select("policy_id", "state", "expected_loss_true")
    dictionary = FE.fit_dictionary(bk, ["policy_id", "state"])
    coded = FE.encode_by(bk.withColumn("key", F.col("policy_id")), dictionary, ["policy_id", "state"])
    return coded.select("key", F.col("policy_id").alias("policy_code"), F.col("state").alias("state_code"))


@query("mean_impute")
def q_p9(spark, sf_dir):
    sp, _ = _fitted_split(spark, sf_dir)
    imp = FE.Imputer.fit(sp["train"])                       # fitted on train, applied to every policy
    out = imp.transform(book(spark, sf_dir).select("policy_id", "defensible_space_score"))
    return out.select("policy_id", rnd(F.col("defensible_space_score"), 8).alias("defensible_space_score"))


@query("standard_scale")
def q_p10(spark, sf_dir):
    sp, enc = _fitted_split(spark, sf_dir)
    tr = enc.transform(sp["train"].select(*FE.T12))
    sc = FE.Scaler.fit(tr, FE.T12)
    allp = enc.transform(book(spark, sf_dir).select("policy_id", *FE.T12))     # applied to every policy
    return allp.select("policy_id", *[rnd(sc.col(c), 6).alias(c) for c in FE.T12])


@query("sentinel_neutralise")
def q_p11(spark, sf_dir):
    return book(spark, sf_dir).select("policy_id", FE.neutralised_fire_distance().alias("fire_dist"),
                                      FE.neutralised_defensible_space().alias("defensible_m_rule"))


@query("risk_band")
def q_p12(spark, sf_dir):
    return book(spark, sf_dir).select("policy_id", B.risk_band(F.col("risk_score_true")).alias("band"))


@query("uw_action")
def q_p13(spark, sf_dir):
    return book(spark, sf_dir).select("policy_id", B.uw_action(F.col("risk_band")).alias("uw_action"))


@query("decision_tier")
def q_p14(spark, sf_dir):
    s = F.col("risk_score_true")
    return book(spark, sf_dir).select("policy_id", B.decision_tier(s, "tier").alias("tier"),
                                      B.decision_tier(s, "action").alias("action"))


@query("credit_tier_note")
def q_p15(spark, sf_dir):
    return book(spark, sf_dir).select("policy_id", B.credit_tier(F.col("credit_score")).alias("credit_tier"))


@query("winsorize_loss")
def q_p16(spark, sf_dir):
    bk = book(spark, sf_dir)
    capped, cap = winsorize(bk.select("policy_id", "claim_amount", "coverage_amount"), "claim_amount",
                            q=0.99, cap_col="coverage_amount", out="capped")
    return capped.agg(F.count("*").alias("policies"),
                      F.sum((F.col("claim_amount") > 0).cast("int")).cast("long").alias("positives"),
                      F.sum((F.col("capped") < F.col("claim_amount")).cast("int")).cast("long").alias("capped_rows"),
                      rnd(F.sum("capped"), 2).alias("total_capped"),
                      rnd(lit_d(cap if cap is not None else 0.0), 4).alias("cap"))


@query("cell_key")
def q_p17(spark, sf_dir):
    sp, enc = _fitted_split(spark, sf_dir)
    return book(spark, sf_dir).select("policy_id", FE.encoded_cell_key(enc).alias("cell"))


# ── R: rating plan ────────────────────────────────────────────────────────
@query("frequency_plan")
def q_r1(spark, sf_dir):
    return book(spark, sf_dir).select("policy_id", "renewal_credit", "lambda_true")


@query("severity_plan")
def q_r2(spark, sf_dir):
    return book(spark, sf_dir).select("policy_id", "mu_true")


@query("interaction_plan")
def q_r3(spark, sf_dir):
    return book(spark, sf_dir).select("policy_id", "M_true")


@query("expected_loss")
def q_r4(spark, sf_dir):
    return book(spark, sf_dir).select("policy_id", "expected_loss_true")


@query("score_a1_minmax")
def q_r5(spark, sf_dir):
    bk = book(spark, sf_dir)
    lo, hi = R.minmax_log_anchors(bk, "expected_loss_true")
    return bk.select("policy_id", rnd(R.score_a1(F.col("expected_loss_true"), lo, hi), 1).alias("score"))


@query("score_a1_anchored")
def q_r6(spark, sf_dir):
    """anchors = p1 of baseline E and p99 of full E, stored, then applied."""
    pr = pair(spark, sf_dir)
    from riskbook.operators.quantiles import exact_quantiles
    import math
    lo = exact_quantiles(pr, "el_baseline", [0.01])[("", 0.01)]
    hi = exact_quantiles(pr, "el_full", [0.99])[("", 0.99)]
    return pr.select("policy_id", rnd(R.score_a1(F.col("el_full"), math.log1p(lo), math.log1p(hi)), 1).alias("score"),
                     rnd(lit_d(lo), 4).alias("el_min"), rnd(lit_d(hi), 4).alias("el_max"))


@query("score_a1_percentile")
def q_r7(spark, sf_dir):
    return C.percent_rank_score(book(spark, sf_dir), "expected_loss_true")


@query("score_a2")
def q_r8(spark, sf_dir):
    cfg = R.PricingConfig()
    lam, mum = F.col("lambda_true"), F.col("mu_true") * F.col("M_true")
    f, s = R.sub_scores(lam, mum, cfg)
    return book(spark, sf_dir).select("policy_id", rnd(f, 4).alias("f_score"), rnd(s, 4).alias("s_score"),
                                      rnd(R.score_a2(lam, mum, cfg), 4).alias("score_a2"))


@query("indicated_premium")
def q_r9(spark, sf_dir):
    el = F.col("expected_loss_true")
    loaded = R.PricingConfig(expense_load=0.18)
    return book(spark, sf_dir).select("policy_id", rnd(R.premium(el), 2).alias("premium"),
                                      rnd(R.premium(el, loaded, "divisor"), 2).alias("premium_divisor"),
                                      rnd(R.premium(el, loaded, "multiplier"), 2).alias("premium_multiplier"))


@query("pct_from_tier3")
def q_r10(spark, sf_dir):
    pr = pair(spark, sf_dir)
    return pr.select("policy_id", rnd(R.tier3_share(F.col("m_hat")), 4).alias("pct_from_tier3"),
                     rnd(F.col("premium_full") - F.col("premium_baseline"), 2).alias("premium_added"))


@query("active_interactions")
def q_r11(spark, sf_dir):
    return book(spark, sf_dir).select("policy_id", F.posexplode(IX.active_interactions()).alias("pos", "ix")) \
        .select("policy_id", "pos", "ix.label", "ix.mult", "ix.severity")


@query("rule_based_m")
def q_r12(spark, sf_dir):
    arr = IX.active_interactions()
    return book(spark, sf_dir).select("policy_id", F.size(arr).alias("n_rules"),
                                      rnd(IX.rule_based_m(arr), 6).alias("rule_m"), F.col("M_true").alias("m_hat"))


@query("interaction_contribution")
def q_r13(spark, sf_dir):
    return IX.interaction_contribution(book(spark, sf_dir))


@query("premium_attribution")
def q_r14(spark, sf_dir):
    return IX.premium_attribution(book(spark, sf_dir))


@query("plan_vs_tier")
def q_r15(spark, sf_dir):
    return P.impact_classes(pair(spark, sf_dir))


# ── V: rules ──────────────────────────────────────────────────────────────
@query("input_warnings")
def q_v1(spark, sf_dir):
    return _explode_texts(book(spark, sf_dir), V.input_warnings())


@query("reason_codes")
def q_v2(spark, sf_dir):
    return _explode_texts(book(spark, sf_dir), V.reason_codes())


@query("mitigants")
def q_v3(spark, sf_dir):
    return _explode_texts(book(spark, sf_dir), V.mitigants())


@query("recommendations")
def q_v4(spark, sf_dir):
    return _explode_texts(book(spark, sf_dir), V.recommendations())


@query("risk_narrative")
def q_v5(spark, sf_dir):
    return book(spark, sf_dir).select("policy_id", V.risk_narrative().alias("narrative"))


@query("over_insurance_flag")
def q_v6(spark, sf_dir):
    a, b, c = V.over_insurance()
    return book(spark, sf_dir).select("policy_id", a.alias("over_115"), b.alias("over_125"), c.alias("over_130"))


# ── J: joins ──────────────────────────────────────────────────────────────
@query("state_dimension_join")
def q_j1(spark, sf_dir):
    dim = state_dim(spark).drop("k")
    return J.join_dim(book(spark, sf_dir).select("policy_id", "state"), dim, "state", "left", rows_bound=10)


@query("cell_oe_lookup")
def q_j2(spark, sf_dir):
    sp, enc = _fitted_split(spark, sf_dir)
    withcell = lambda d: d.select("policy_id", "claim_amount", FE.encoded_cell_key(enc).alias("cell"),
                                  rnd(F.col("lambda_true") * F.col("mu_true"), 2).alias("glm_el"))
    cells = X.group_oe(withcell(sp["train"]))               # train-set cell O/E ...
    out = J.apply_cell_oe(withcell(book(spark, sf_dir)), cells, rows_bound=FE.cell_bound(enc))   # ... to every policy
    return out.select("policy_id", "cell", rnd(F.col("cell_oe"), 6).alias("cell_oe"))


@query("baseline_full_align")
def q_j3(spark, sf_dir):
    bk = book(spark, sf_dir)
    # both score sets come from one scan: one projection instead of a join (J.align joins two sources)
    al = bk.select("policy_id", rnd(F.col("lambda_true") * F.col("mu_true"), 2).alias("el_base"), F.col("expected_loss_true").alias("el_full"))
    return al.select("*", rnd(F.col("el_full") - F.col("el_base"), 2).alias("el_delta"))


SCENARIO_CARDS = [
    # The 2x2 roof x wildfire scenario cards.
    {"scenario": "Asphalt 5yr / Low WF", "roof_material": "Asphalt Shingle", "roof_age_yr": 5, "wildfire_zone": "Low"},
    {"scenario": "Asphalt 5yr / High WF", "roof_material": "Asphalt Shingle", "roof_age_yr": 5, "wildfire_zone": "High"},
    {"scenario": "Wood Shake 28yr / Low WF", "roof_material": "Wood Shake", "roof_age_yr": 28, "wildfire_zone": "Low"},
    {"scenario": "Wood Shake 28yr / High WF", "roof_material": "Wood Shake", "roof_age_yr": 28, "wildfire_zone": "High"},
]


@query("scenario_cross")
def q_j4(spark, sf_dir):
    bk = book(spark, sf_dir)
    lo, hi = R.minmax_log_anchors(bk, "expected_loss_true")
    sc = J.scenario_cross(bk, SCENARIO_CARDS, ["roof_material", "roof_age_yr", "wildfire_zone"])
    m = rnd(R.interaction_expr(), 4)
    el_b = rnd(F.col("lambda_true") * F.col("mu_true"), 2)
    el_f = rnd(F.col("lambda_true") * F.col("mu_true") * m, 2)
    return sc.select("policy_id", "scenario", m.alias("m_scenario"), el_b.alias("el_baseline"), el_f.alias("el_full"),
                     rnd(R.score_a1(el_f, lo, hi), 1).alias("score_full"))


WHATIF_CHANGES = {"roof_material": "Metal", "sprinkler_system": 1, "security_system": 1, "prior_claims_3yr": 0}


@query("whatif_delta")
def q_j5(spark, sf_dir):
    """The same edit applied to every policy, re-rated on the original book's scale."""
    bk = book(spark, sf_dir)
    mean_raw = R.frequency_normaliser(bk)
    lo, hi = R.minmax_log_anchors(bk, "expected_loss_true")
    edited = J.with_overrides(bk.drop("renewal_credit"), WHATIF_CHANGES)
    rr = R.interaction_plan(R.severity_plan(R.frequency_plan(edited, mean_raw=mean_raw, out="_new_lam"), "_new_mu"), "_new_m")
    lam2, mu2, m2 = rnd(F.col("_new_lam"), 5), rnd(F.col("_new_mu"), 0), rnd(F.col("_new_m"), 4)
    el2 = rnd(F.col("_new_lam") * F.col("_new_mu") * F.col("_new_m"), 2)
    s1 = rnd(R.score_a1(F.col("expected_loss_true"), lo, hi), 1)
    s2 = rnd(R.score_a1(el2, lo, hi), 1)
    ds = s2 - s1
    # shares of the score's move: relative changes of lambda and mu, the rest is M's
    by_lam = (lam2 - F.col("lambda_true")) / (F.col("lambda_true") + lit_d(1e-9)) * ds * lit_d(0.4)
    by_mu = (mu2 - F.col("mu_true")) / (F.col("mu_true") + lit_d(1e-9)) * ds * lit_d(0.3)
    return rr.select("policy_id", rnd(lam2 - F.col("lambda_true"), 5).alias("d_lambda"),
                     rnd(mu2 - F.col("mu_true"), 0).alias("d_mu"), rnd(m2 - F.col("M_true"), 4).alias("d_m"),
                     rnd(el2 - F.col("expected_loss_true"), 2).alias("d_el"), rnd(ds, 1).alias("d_score"),
                     rnd(el2 / lit_d(0.67) - F.col("indicated_premium"), 2).alias("d_premium"),
                     rnd(by_lam, 2).alias("d_score_lambda"), rnd(by_mu, 2).alias("d_score_mu"),
                     rnd(ds - by_lam - by_mu, 2).alias("d_score_m"))


# ── A: aggregations ───────────────────────────────────────────────────────
@query("portfolio_kpis")
def q_a1(spark, sf_dir):
    return P.kpis(book(spark, sf_dir))


@query("band_distribution")
def q_a2(spark, sf_dir):
    return P.band_distribution(book(spark, sf_dir))


@query("state_summary")
def q_a3(spark, sf_dir):
    return P.state_summary(book(spark, sf_dir))


@query("state_top_peril")
def q_a4(spark, sf_dir):
    return P.state_top_peril(book(spark, sf_dir))


@query("state_peril_matrix")
def q_a5(spark, sf_dir):
    return P.state_peril_matrix(book(spark, sf_dir))


@query("hottest_cell")
def q_a6(spark, sf_dir):
    return P.hottest_cell(book(spark, sf_dir))


@query("loss_ratio_by_band")
def q_a7(spark, sf_dir):
    return P.loss_ratio_by_band(book(spark, sf_dir))


@query("category_counts")
def q_a8(spark, sf_dir):
    return P.category_counts(book(spark, sf_dir))


@query("correlation_matrix")
def q_a9(spark, sf_dir):
    return P.correlations(book(spark, sf_dir))


@query("column_summary")
def q_a10(spark, sf_dir):
    return P.describe(book(spark, sf_dir))


def _oe_inputs(spark, sf_dir):
    sp, enc = _fitted_split(spark, sf_dir)
    prep = lambda d: d.select("policy_id", "claim_amount", FE.encoded_cell_key(enc).alias("cell"),
                              rnd(F.col("lambda_true") * F.col("mu_true"), 2).alias("glm_el"))
    return sp, prep(sp["train"]), prep(sp["test"])


@query("group_oe")
def q_a11(spark, sf_dir):
    _, tr, _ = _oe_inputs(spark, sf_dir)
    cells = X.group_oe(tr)
    return cells.select("cell", "n_policies", rnd(F.col("total_claim"), 2).alias("total_claim"),
                        rnd(F.col("total_expected"), 2).alias("total_expected"),
                        rnd(F.col("oe_raw"), 6).alias("oe_raw"), rnd(F.col("oe"), 6).alias("oe"))


@query("oe_normalise")
def q_a12(spark, sf_dir):
    sp, tr, te = _oe_inputs(spark, sf_dir)
    study = X.oe_normalise(tr, X.group_oe(tr), rows_bound=FE.cell_bound(FE.Encoder.fit(sp["train"])))
    tgt = X.normalised_target(tr, study)
    return tgt.agg(rnd(lit_d(study.scale_factor), 6).alias("scale_factor"),
                   rnd(lit_d(study.overall_oe), 6).alias("overall_oe"),
                   rnd(F.avg("m_target"), 6).alias("mean_target"), F.count("*").alias("policies"))


@query("oe_percentiles")
def q_a13(spark, sf_dir):
    sp, tr, _ = _oe_inputs(spark, sf_dir)
    cells = X.group_oe(tr)
    study = X.oe_normalise(tr, cells, rows_bound=FE.cell_bound(FE.Encoder.fit(sp["train"])))
    return X.oe_percentiles(cells, X.normalised_target(tr, study))


@query("m_distribution")
def q_a14(spark, sf_dir):
    return P.m_distribution(pair(spark, sf_dir))


@query("premium_uplift")
def q_a15(spark, sf_dir):
    return P.premium_uplift(pair(spark, sf_dir))


@query("reclassification")
def q_a16(spark, sf_dir):
    return P.reclassification(pair(spark, sf_dir))


@query("reclass_matrix")
def q_a16m(spark, sf_dir):
    return P.reclass_matrix(pair(spark, sf_dir))


@query("reclass_threshold")
def q_a17(spark, sf_dir):
    return P.reclass_threshold(pair(spark, sf_dir))


@query("hidden_danger_leakage")
def q_a18(spark, sf_dir):
    return P.leakage(pair(spark, sf_dir))


@query("regression_metrics")
def q_a19(spark, sf_dir):
    return X.reg_metrics(pair(spark, sf_dir), "el_full", "el_baseline")


@query("regression_metrics_shifted")
def q_a19_shifted(spark, sf_dir):
    """A19 where the mean is large against the spread."""
    far = pair(spark, sf_dir).select((F.lit(1e9) + F.col("el_full")).alias("y"), (F.lit(1e9) + F.col("el_baseline")).alias("p"))
    return X.reg_metrics(far, "y", "p")


@query("pearson_pair")
def q_a20(spark, sf_dir):
    return X.pearson(book(spark, sf_dir), "expected_loss_true", "total_loss")


@query("generation_report")
def q_a21(spark, sf_dir):
    return P.book_report(book(spark, sf_dir))


@query("health_checks")
def q_a22(spark, sf_dir):
    return P.health_checks(book(spark, sf_dir))


@query("peril_severity")
def q_a23(spark, sf_dir):
    return P.peril_severity(book(spark, sf_dir))


@query("benchmark_table")
def q_a24(spark, sf_dir):
    return P.benchmarks(book(spark, sf_dir))


@query("missingness_profile")
def q_a25(spark, sf_dir):
    return P.missingness(book(spark, sf_dir), by="state")


@query("histogram")
def q_a26(spark, sf_dir):
    pr = pair(spark, sf_dir)
    m = P.histogram(pr, "m_hat", 60, 0.7, 3.5).select(F.lit("m_60").alias("hist"), "*")
    m = m.unionByName(P.histogram(pr, "m_hat", 35, 0.7, 3.5).select(F.lit("m_35").alias("hist"), "*"))
    up = pr.select(((F.col("el_full") - F.col("el_baseline")) / (F.col("el_baseline") + 1) * 100).alias("uplift"))
    u = P.histogram(up, "uplift", 50, 0.0, 300.0, clip_values=True).select(F.lit("uplift_50").alias("hist"), "*")
    return m.unionByName(u)


@query("roi_grid")
def q_a27(spark, sf_dir):
    return P.roi_grid(book(spark, sf_dir))


@query("drift_psi")
def q_a28(spark, sf_dir):
    return P.psi(book(spark, sf_dir))


# ── W: curves ─────────────────────────────────────────────────────────────
@query("gini")
def q_w1(spark, sf_dir):
    pr = pair(spark, sf_dir)
    gb = C.gini(pr, "actual", "el_baseline")
    gf = C.gini(pr, "actual", "el_full")
    return spark.createDataFrame([(round(gb, 6), round(gf, 6), round(gf - gb, 6))],
                                 "gini_baseline double, gini_full double, gini_delta double")


@query("gini_oracle")
def q_w2(spark, sf_dir):
    g = C.gini_desc(book(spark, sf_dir), "total_loss", "expected_loss_true")
    return spark.createDataFrame([(round(g, 6),)], "gini_oracle double")


@query("lorenz_curve")
def q_w3(spark, sf_dir):
    return C.lorenz(book(spark, sf_dir), "total_loss", "expected_loss_true", 10)


@query("decile_loss_ratio")
def q_w4(spark, sf_dir):
    return C.decile_loss_ratio(book(spark, sf_dir), "total_loss", "expected_loss_true", "indicated_premium")


@query("decile_lift")
def q_w5(spark, sf_dir):
    return C.decile_lift(pair(spark, sf_dir))


# ── O: sort, sample, split ────────────────────────────────────────────────
@query("seeded_sample")
def q_o2(spark, sf_dir):
    return O.seeded_sample(book(spark, sf_dir), 2000, "42").select("policy_id", "expected_loss_true")


@query("stratified_split")
def q_o4(spark, sf_dir):
    bk = book(spark, sf_dir)
    labels = F.array(F.struct(F.lit("60/20/20").alias("scheme"), O.split_label().alias("split")),
                     F.struct(F.lit("80/20").alias("scheme"),
                              O.split_label((0.8, 0.2), ("train", "test"), salt="split80").alias("split")))
    return (bk.select(F.explode(labels).alias("s"), "claim_occurred")
            .groupBy(F.col("s.scheme").alias("scheme"), F.col("s.split").alias("split"), "claim_occurred")
            .agg(F.count("*").alias("policies")))


@query("stratified_split_exact")
def q_o4_exact(spark, sf_dir):
    """O4 with shares exact to one row in every state and claim stratum."""
    cut = O.split_exact(book(spark, sf_dir), ["state", "claim_occurred"])
    return cut.groupBy("state", "claim_occurred", "split").agg(F.count("*").alias("policies"), F.min("policy_id").alias("first_id"),
                                                               rnd(F.sum("indicated_premium"), 2).alias("premium"))


@query("kfold")
def q_o5(spark, sf_dir):
    return book(spark, sf_dir).select(O.fold_id(5).alias("fold")).groupBy("fold").agg(F.count("*").alias("policies"))


@query("union_train_val")
def q_o6(spark, sf_dir):
    sp = O.split(book(spark, sf_dir))
    u = O.union_train_val(sp["train"], sp["val"])
    return u.agg(F.count("*").alias("policies"), rnd(F.sum("expected_loss_true"), 2).alias("total_el"))


@query("stable_order")
def q_o7(spark, sf_dir):
    return P.state_peril_matrix(book(spark, sf_dir)).select("state", "row_order")



@query("fixture_book")
def q_fixture_book(spark, sf_dir):
    """The policy book itself (features, rating plan, outcomes, scores)."""
    return book(spark, sf_dir)


@query("kendall_tau_b")
def q_a29(spark, sf_dir):
    """A29 over every claimant (the reference samples 3,000; here the whole set)."""
    claimants = book(spark, sf_dir).where(F.col("total_loss") > 0)
    r = C.kendall_tau_b(claimants, "expected_loss_true", "total_loss")
    return spark.createDataFrame([(r["n"], round(r["tau_b"], 8) if r["tau_b"] is not None else None,
                                   int(r["discordant"]), int(r["concordant"]))],
                                 "claimants long, tau_b double, discordant long, concordant long")


# model queries register themselves on import
import riskbook.catalog_ml  # noqa: E402,F401
