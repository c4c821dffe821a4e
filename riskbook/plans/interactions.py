"""Display interaction rules and attributions.

Per-policy lists are arrays of structs built by ``array`` + ``filter`` (no UDF);
reports explode them and aggregate with partial aggregation.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbook.functions.columns import lit_d, rnd
from riskbook.plans.rating import EXPOSURES, PricingConfig

# Display multipliers (overridable) of the interaction rules.
DISPLAY_MULTIPLIERS = {
    "wood_wf_high": 3.50, "wood_wf_mod": 2.10, "flood_coast": 2.20, "nonwood_wf": 1.80,
    "eq_high": 1.50, "old_frame": 1.35, "metal_wf_sprinkler": 0.82, "defensible_high": 0.88,
    "new_superior": 0.85, "frame_pc_high": 1.18, "knob_tube_fire": 1.20,
    "polybutylene_water": 1.22, "slope_burn_rain": 1.45, "slope_burn_only": 1.18,
}
# Colour -> severity class of a rule.
SEVERE, MODERATE, MILD, PROTECTIVE = "severe", "moderate", "mild", "protective"


def _rule_groups(ov: dict) -> list[list[tuple[Column, str, float, str]]]:
    """Groups of (condition, label, multiplier, class); first match within a group wins.
    Fixed values: labels, limits and multipliers of the display rules, in the order of display."""
    c = F.col
    wood, coast, old_r, frame = (EXPOSURES[x]() for x in ("wood roof", "coast", "aged roof", "frame"))
    metal = c("roof_material") == "Metal"
    wf, fl, eq = c("wildfire_zone"), c("flood_zone"), c("earthquake_zone")
    new_r = c("roof_age_yr") <= 5
    sup = c("construction_type") == "Superior"
    hail, can = c("hail_zone"), c("vegetation_risk_composite")
    prior = c("prior_claims_3yr")
    spk = c("sprinkler_system") == 1
    ds = F.coalesce(c("defensible_space_score"), lit_d(0.0))
    pc = c("protection_class")
    slope, pbr = c("slope_steepness_pct"), c("post_burn_rainfall_intensity")
    wf_any = wf.isin("Moderate", "High")
    return [
        [(wood & (wf == "High"), "Wood Shake × High Wildfire", ov["wood_wf_high"], SEVERE),
         (wood & (wf == "Moderate"), "Wood Shake × Mod Wildfire", ov["wood_wf_mod"], MODERATE),
         (wf == "High", "Non-Wood × High Wildfire", ov["nonwood_wf"], MODERATE),
         (wood, "Wood Shake (base fire exposure)", 1.40, MILD)],
        [((fl == "High") & coast, "High Flood × Coastal Surge <5mi", ov["flood_coast"], SEVERE),
         (fl == "High", "High Flood Zone", 1.60, MODERATE),
         (fl == "Moderate", "Moderate Flood Zone", 1.20, MILD)],
        [(eq == "High", "High Earthquake Zone", ov["eq_high"], MODERATE),
         (eq == "Moderate", "Moderate Earthquake Zone", 1.15, MILD)],
        [(old_r & frame, "Old Roof (>20yr) × Frame", ov["old_frame"], MODERATE),
         (old_r, "Aged Roof > 20 years", 1.15, MILD)],
        [(old_r & (hail == "High"), "Old Roof × High Hail Zone", 1.30, MODERATE),
         (old_r & (hail == "Moderate"), "Old Roof × Mod Hail Zone", 1.20, MODERATE)],
        [((prior >= 2) & (can == "High"), "Water Claims × High Vegetation Density", 1.25, MODERATE),
         ((prior >= 2) & (can == "Moderate"), "Water Claims × Moderate Vegetation", 1.15, MILD)],
        [(c("has_knob_tube_wiring") == 1, "Knob-and-Tube Wiring (interior)", ov["knob_tube_fire"], MODERATE)],
        [(c("has_polybutylene_pipe") == 1, "Polybutylene Plumbing (interior)", ov["polybutylene_water"], SEVERE)],
        [(frame & (pc >= 8), "Frame Construction × PC ≥ 8", ov["frame_pc_high"], MODERATE)],
        [(metal & wf_any & spk, "Metal Roof + Sprinkler × WF Zone (protective)", ov["metal_wf_sprinkler"], PROTECTIVE)],
        [((ds >= 80) & wf_any, "High Defensible Space (≥80) in WUI (protective)", ov["defensible_high"], PROTECTIVE)],
        [(sup & new_r, "New Superior Construction ≤5yr (protective)", ov["new_superior"], PROTECTIVE)],
        [((wf == "High") & (slope > 55) & (pbr > 60), "Slope >55% × High WF × Post-burn Rain >60 (3-way)",
          ov["slope_burn_rain"], SEVERE),
         ((wf == "High") & (slope > 55), "Steep Slope >55% × High Wildfire Zone", ov["slope_burn_only"], MODERATE)],
    ]


def _entry(label: str, mult: float, cls: str) -> Column:
    return F.struct(F.lit(label).alias("label"), lit_d(mult).alias("mult"), F.lit(cls).alias("severity"))


def active_interactions(overrides: dict | None = None) -> Column:
    """Ordered array<struct<label, mult, severity>> of the active display rules."""
    ov = {**DISPLAY_MULTIPLIERS, **(overrides or {})}
    items = []
    for group in _rule_groups(ov):
        expr = None
        for cond, label, mult, cls in group:
            expr = F.when(cond, _entry(label, mult, cls)) if expr is None else expr.when(cond, _entry(label, mult, cls))
        items.append(expr)
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def rule_based_m(arr: Column) -> Column:
    """Product of the active multipliers (1.0 when none)."""
    return F.aggregate(arr, lit_d(1.0), lambda acc, x: acc * x["mult"])


def interaction_rows(book: DataFrame, lam: str = "lambda_true", mu: str = "mu_true",
                     premium: str = "indicated_premium", cfg: PricingConfig = PricingConfig()) -> DataFrame:
    """R13 detail: one row per (policy, active interaction) with E and premium added."""
    base_el = F.col(lam) * F.col(mu)
    load = lit_d(1.0 + cfg.expense_load) if cfg.expense_load > 0 else lit_d(1.0)
    ex = book.select("policy_id", base_el.alias("base_el"), F.col(premium).alias("premium"),
                     F.posexplode(active_interactions(cfg.m_overrides or None)).alias("pos", "ix"))
    el_added = F.col("base_el") * (F.col("ix.mult") - 1)
    prem_added = el_added / lit_d(cfg.target_lr) * load
    return ex.select("policy_id", "pos", F.col("ix.label").alias("label"), F.col("ix.mult").alias("mult"),
                     el_added.alias("el_added"), prem_added.alias("premium_added"),
                     (prem_added / F.col("premium") * 100).alias("share_of_premium_pct"))


def interaction_contribution(book: DataFrame, **kw) -> DataFrame:
    """R13 report: per interaction label, policies, E added and premium added over the book."""
    rows = interaction_rows(book, **kw)
    return (rows.groupBy("label").agg(
        F.count("*").alias("policies"),
        rnd(F.sum("el_added"), 2).alias("el_added"),
        rnd(F.sum("premium_added"), 2).alias("premium_added"),
        rnd(F.avg("share_of_premium_pct"), 4).alias("mean_share_pct")))


def premium_drivers(lam: Column, el: Column, cfg: PricingConfig = PricingConfig()) -> Column:
    """array<struct<driver, value, seq>> of signed dollar contributions, capped."""
    c = F.col
    lr, exp = lit_d(cfg.target_lr), lit_d(1.0 + cfg.expense_load)

    def item(cond, name, value, seq):
        return F.when(cond, F.struct(name.alias("driver"), value.cast("double").alias("value"), F.lit(seq).alias("seq")))

    n = c("prior_claims_3yr")
    cs = c("credit_score")
    pc = c("protection_class")
    age = c("home_age")
    fd = c("dist_to_fire_station_mi")
    hv, ca = c("home_value").cast("double"), c("coverage_amount").cast("double")
    fixed = [
        item(n > 0, F.format_string("Prior Claims (×%d)", n), F.least(n * lit_d(0.28) * lam / lr * exp, lit_d(1800.0)), 1),
        item(cs < 680, F.format_string("Low Credit (%d)", cs),
             F.least((F.lit(680) - cs) / lit_d(100.0) * lit_d(0.18) * lam / lr * exp, lit_d(900.0)), 2),
        item(pc >= 7, F.format_string("Protection Class %d", pc), F.least((pc - 5) * lit_d(0.07) * lam / lr * exp, lit_d(600.0)), 3),
        item(c("occupancy") == "Vacant", F.lit("Vacant Occupancy"), lit_d(520.0), 4),
        item(c("security_system") == 1, F.lit("Security System (credit)"), lit_d(-180.0), 5),
        item(c("gated_community") == 1, F.lit("Gated Community (credit)"), lit_d(-120.0), 6),
        item(age > 30, F.format_string("Older Home (%dyr)", age), F.least((age - 25) * lit_d(8.0), lit_d(500.0)), 7),
        item(fd > 5, F.format_string("Fire Station Dist (%.1fmi)", fd), F.least((fd - 3) * lit_d(60.0), lit_d(600.0)), 8),
        item(c("sprinkler_system") == 1, F.lit("Sprinkler System (credit)"), lit_d(-450.0), 9),
        item(c("smoke_detectors") == 1, F.lit("Smoke Detectors (credit)"), lit_d(-130.0), 10),
    ]
    ix = F.transform(active_interactions(cfg.m_overrides or None), lambda x, i: F.struct(
        F.concat(F.lit("⚡ "), x["label"]).alias("driver"),
        F.least((x["mult"] - 1) * el / lr * exp * lit_d(0.7), lit_d(3000.0)).alias("value"),
        (i + 11).alias("seq")))
    cov = F.array(item(ca > hv * lit_d(1.15), F.lit("Coverage Overstatement"),
                       F.least((ca - hv) * lit_d(0.002), lit_d(600.0)), 30))
    return F.filter(F.concat(F.array(*fixed), ix, cov), lambda x: x.isNotNull())


def premium_attribution(book: DataFrame, lam: str = "lambda_true", el: str = "expected_loss_true",
                        premium: str = "indicated_premium", top: int = 10,
                        cfg: PricingConfig = PricingConfig()) -> DataFrame:
    """Top ``top`` drivers per policy by |value| with a running total from the
    portfolio average premium (one scalar aggregate).

    A policy's drivers live in one row, so ranking is a built-in ``sort_array`` on
    (-|value|, seq) and a ``slice`` inside the row: no shuffle, no window.
    """
    avg_prem = book.agg(F.avg(premium)).first()[0] or 0.0

    keyed = F.transform(premium_drivers(F.col(lam), F.col(el), cfg), lambda d: F.struct(
        (-F.abs(d["value"])).alias("k"), d["seq"].alias("seq"), d["driver"].alias("driver"), d["value"].alias("value")))
    ranked = F.slice(F.sort_array(keyed), 1, top)      # natural struct order = (-|value|, seq)
    # one pass over a policy's drivers: each step appends (driver, value, total so far)
    out_type = "array<struct<driver:string,value:double,run:double>>"
    start = F.struct(lit_d(0.0).alias("run"), F.array().cast(out_type).alias("out"))

    def step(acc, d):
        run = acc["run"] + d["value"]
        return F.struct(run.alias("run"), F.concat(acc["out"], F.array(F.struct(
            d["driver"].alias("driver"), d["value"].alias("value"), run.alias("run")))).alias("out"))

    ex = book.select("policy_id", F.posexplode(F.aggregate(ranked, start, step, lambda acc: acc["out"])).alias("i", "d"))
    return ex.select("policy_id", (F.col("i") + 1).alias("rank"), "d.driver", rnd(F.col("d.value"), 4).alias("value"),
                     rnd(lit_d(avg_prem) + F.col("d.run"), 2).alias("running_total"))
