"""Rule-based text outputs and row validation (V1-V6), as array<string> columns.

Numbers inside texts are rounded explicitly before formatting, so the text does not
depend on an engine's tie rule in ``%.0f``.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskbook.functions.columns import lit_d, rnd
from riskbook.plans.interactions import active_interactions

# Texts, limits and factors of the rules below.


def _money(c: Column) -> Column:
    """'1,234' for a whole-dollar amount (rounded half up first)."""
    return F.format_number(rnd(c.cast("double"), 0), 0)


def _list(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def input_warnings() -> Column:
    """V1: six input-consistency rules."""
    hv = F.col("home_value").cast("double")
    ca = F.col("coverage_amount")
    yb = F.coalesce(F.col("year_built"), F.lit(2000))
    ded = F.col("deductible")
    return _list(
        F.when(ca < hv * 0.70, F.concat(F.lit("⚠️ Coverage ($"), _money(ca), F.lit(") is below 70% of home value — underinsurance risk"))),
        F.when(ca > hv * 1.30, F.concat(F.lit("⚠️ Coverage ($"), _money(ca), F.lit(") exceeds 130% of home value — over-insurance / moral hazard signal"))),
        F.when(yb > 2024, F.lit("⚠️ Year built is in the future")),
        F.when(yb < 1900, F.lit("⚠️ Year built before 1900 — unusual for active policy")),
        F.when(ded > hv * 0.06, F.concat(F.lit("⚠️ Deductible ($"), _money(ded), F.lit(") exceeds 6% of home value — high self-retention"))),
        F.when((F.col("protection_class") == 10) & (F.coalesce(F.col("dist_to_fire_station_mi"), lit_d(3.0)) < 1),
               F.lit("⚠️ PC=10 but fire station distance < 1mi — data inconsistency")),
    )


def reason_codes() -> Column:
    """V2: adverse drivers, including every active interaction; default text if none."""
    n = F.col("prior_claims_3yr")
    ix = F.transform(active_interactions(), lambda x: F.concat(
        F.lit("• "), x["label"], F.lit(" → ×"), F.format_string("%.2f", rnd(x["mult"], 2)), F.lit(" (Tier 3)")))
    head = _list(
        F.when(n >= 2, F.concat(F.lit("• "), n.cast("string"), F.lit(" prior claims → freq ×"),
                                F.format_string("%.2f", rnd(F.pow(lit_d(1.32), n.cast("double")), 2)))),
        F.when(F.col("credit_score") < 650, F.concat(F.lit("• Credit "), F.col("credit_score").cast("string"),
                                                     F.lit(" → sub-prime frequency load"))),
        F.when(F.col("protection_class") >= 8, F.concat(F.lit("• PC "), F.col("protection_class").cast("string"),
                                                        F.lit(" → limited fire coverage"))),
    )
    tail = _list(
        F.when(F.col("occupancy") == "Vacant", F.lit("• Vacant → +65% frequency load")),
        F.when(F.col("roof_age_yr") > 20, F.concat(F.lit("• Roof "), F.col("roof_age_yr").cast("string"),
                                                   F.lit("yr → water intrusion risk"))),
        F.when(F.col("coverage_amount") > F.col("home_value") * 1.25,
               F.concat(F.lit("• Over-insured $"), _money(F.col("coverage_amount")), F.lit(" vs $"),
                        _money(F.col("home_value")))),
    )
    allr = F.concat(head, ix, tail)
    return F.when(F.size(allr) > 0, allr).otherwise(F.array(F.lit("*No significant elevated drivers.*")))


def mitigants() -> Column:
    """V3: protective features."""
    ded = F.col("deductible")
    ded_pct = F.when(ded == 2500, F.lit("25")).when(ded == 5000, F.lit("38"))
    items = _list(
        F.when(F.col("sprinkler_system") == 1, F.lit("• Sprinkler system → severity −38%")),
        F.when(F.col("security_system") == 1, F.lit("• Security system → theft freq −10%")),
        F.when(F.col("smoke_detectors") == 1, F.lit("• Smoke detectors → fire severity −13%")),
        F.when(F.col("gated_community") == 1, F.lit("• Gated community → frequency −9%")),
        F.when(ded >= 2500, F.concat(F.lit("• $"), F.format_number(ded.cast("double"), 0),
                                     F.lit(" deductible → freq −"), ded_pct, F.lit("%"))),
        F.when(F.col("roof_material") == "Metal", F.lit("• Metal roof → wildfire ignition resistance")),
        F.when(F.col("construction_type").isin("Masonry", "Superior"),
               F.concat(F.lit("• "), F.col("construction_type"), F.lit(" → lower freq/severity"))),
    )
    return F.when(F.size(items) > 0, items).otherwise(F.array(F.lit("*No significant protective features.*")))


def recommendations(m_hat: str = "M_true", band: str = "risk_band") -> Column:
    """V4: underwriter recommendations (some depend on the band)."""
    hi = F.col(band).isin("High", "Very High")
    items = _list(
        F.when(F.col("roof_material") == "Wood Shake",
               F.concat(F.lit("→ Require roof replacement to Asphalt or Metal — reduces M&#x0302; from ×"),
                        F.format_string("%.2f", rnd(F.col(m_hat), 2)), F.lit(" toward baseline"))),
        F.when(F.col("prior_claims_3yr") >= 2, F.lit("→ Apply surcharge or require loss-prevention inspection")),
        F.when(F.col("smoke_detectors") != 1, F.lit("→ Require smoke detectors — severity −13%")),
        F.when((F.col("sprinkler_system") != 1) & hi, F.lit("→ Sprinkler system credit available: −38% on severity")),
        F.when((F.col("deductible") < 1000) & hi, F.lit("→ Recommend $2,500 deductible — frequency load −25%")),
    )
    return F.when(F.size(items) > 0, items).otherwise(
        F.array(F.lit("→ Standard terms applicable. No specific conditions required.")))


def risk_narrative(score: str = "risk_score_true", band: str = "risk_band", el: str = "expected_loss_true",
                   lam: str = "lambda_true", mu: str = "mu_true", m_hat: str = "M_true",
                   premium: str = "indicated_premium", target_lr: float = 0.67) -> Column:
    """V5: one text summary per policy."""
    ix = active_interactions()
    top = F.when(F.size(ix) > 0, F.concat(F.lit("The dominant Tier 3 interaction is "), ix[0]["label"],
                                          F.lit(" (M̂ ×"), F.format_string("%.2f", rnd(ix[0]["mult"], 2)), F.lit(").")))\
        .otherwise(F.lit("No Tier 3 interactions active — clean attritional risk profile."))
    n = F.col("prior_claims_3yr")
    prior = F.when(n > 0, F.concat(n.cast("string"), F.lit(" prior claim"), F.when(n != 1, F.lit("s")).otherwise(F.lit("")),
                                   F.lit(" (frequency ×"), F.format_string("%.2f", rnd(F.pow(lit_d(1.32), n.cast("double")), 2)), F.lit(")")))\
        .otherwise(F.lit("No prior claims (preferred frequency)"))
    cs = F.col("credit_score")
    credit = F.when(cs < 650, "sub-prime (elevated frequency)").when(cs < 750, "standard tier").otherwise("preferred tier")
    t3 = rnd((F.col(m_hat) - 1) / F.greatest(F.col(m_hat), lit_d(0.01)) * 100, 0).cast("long")
    return F.concat(
        F.lit("Risk Summary — "), F.col("state"), F.lit(", "), F.col("construction_type"), F.lit(" Construction. "),
        F.lit("This property scores "), F.col(band), F.lit(" risk ("), rnd(F.col(score), 0).cast("long").cast("string"),
        F.lit("/1000). Expected annual loss: $"), _money(F.col(el)),
        F.lit(", driven by claim probability "), F.format_string("%.1f", rnd(F.col(lam) * 100, 1)),
        F.lit("% and expected severity $"), _money(F.col(mu)), F.lit(". "), top,
        F.lit(" Interaction effects raise expected loss by "), t3.cast("string"),
        F.lit("% above the Tier 1+2 base estimate. Key drivers: "), prior, F.lit("; credit score "), cs.cast("string"),
        F.lit(" ("), credit, F.lit("); protection class "), F.col("protection_class").cast("string"),
        F.lit(". Indicated premium: $"), _money(F.col(premium)), F.lit(f"/year (target LR: {int(target_lr * 100)}%)."))


def over_insurance() -> tuple[Column, Column, Column]:
    """V6: coverage overstatement flags at 1.15x / 1.25x / 1.30x of home value."""
    ratio = F.col("coverage_amount").cast("double") / F.col("home_value").cast("double")
    ca, hv = F.col("coverage_amount"), F.col("home_value")
    return ((ca > hv * 1.15).cast("int"), (ca > hv * 1.25).cast("int"), (ca > hv * 1.30).cast("int"))
