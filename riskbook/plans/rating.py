"""Rating plan as column algebra over a policy book.

Every step is a projection of built-in expressions (whole-stage codegen, no UDF).
Book-wide constants (frequency normaliser, score anchors) are computed by one
partial aggregation and broadcast back as literals; nothing row-level reaches the
driver.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbook.functions.columns import clip, lit_d, rnd
from riskbook.functions.bands import risk_band

# Fixed values of the rating plan (must equal the reference).
BASE_CLAIM_RATE = 0.058
SEVERITY_BASE_PCT = 0.048
CONSTRUCTION_FREQ = {"Frame": 1.28, "Masonry": 0.86, "Superior": 0.72, "Mixed": 1.08}
CONSTRUCTION_SEV = {"Frame": 1.10, "Masonry": 0.90, "Superior": 0.80, "Mixed": 1.00}
ROOF_FIRE = {"Asphalt Shingle": 1.00, "Wood Shake": 1.80, "Metal": 0.70, "Tile": 0.80,
             "Flat/Built-Up": 1.20}
OCCUPANCY_FREQ = {"Owner Occupied": 1.00, "Tenant Occupied": 1.22, "Vacant": 1.65}
DEDUCTIBLE_FREQ = {500: 1.00, 1000: 0.90, 2500: 0.75, 5000: 0.62}
VINTAGE_CAT_M = {2020: 1.18, 2021: 1.15, 2022: 1.05, 2023: 1.02, 2024: 1.00}
# frequency flag factors: column -> factor when the flag is 1
FREQ_FLAGS = [("swimming_pool", 1.10), ("trampoline", 1.14), ("dog", 1.08),
              ("security_system", 0.90), ("smoke_detectors", 0.93),
              ("sprinkler_system", 0.82), ("gated_community", 0.91),
              ("has_knob_tube_wiring", 1.20), ("has_polybutylene_pipe", 1.25)]
SEV_FLAGS = [("smoke_detectors", 0.87), ("sprinkler_system", 0.62),
             ("has_knob_tube_wiring", 1.15), ("has_polybutylene_pipe", 1.18)]
FIRE_STATION_MEAN_MI = 3.2
LAMBDA_CLIP = (0.005, 0.18)
MU_CLIP = (1500.0, 400000.0)
M_CLIP = (0.70, 3.5)
RENEWAL_CREDIT = 0.95
REF_YEAR = 2024


@dataclass(frozen=True)
class PricingConfig:
    """Pricing parameters (defaults of the scoring API)."""
    target_lr: float = 0.67
    expense_load: float = 0.0
    score_wf: float = 0.45
    score_ws: float = 0.55
    lam_cap: float = 0.30
    sev_cap: float = 600_000.0
    alpha: float = 0.8
    m_overrides: dict = field(default_factory=dict)


BOOK_A2 = PricingConfig(lam_cap=0.15, sev_cap=500_000.0)


def _lookup(col: str, table: dict) -> Column:
    expr = F.lit(None).cast("double")
    for key, val in reversed(list(table.items())):
        expr = F.when(F.col(col) == F.lit(key), lit_d(val)).otherwise(expr)
    return expr


def _flag(col: str, factor: float) -> Column:
    return F.when(F.col(col) == 1, lit_d(factor)).otherwise(lit_d(1.0))


# ── R1 frequency ──────────────────────────────────────────────────────────
def frequency_raw(base: float = BASE_CLAIM_RATE) -> Column:
    """Unnormalised lambda: base x construction x age x PC x occupancy x claims x credit
    x deductible x nine flag factors."""
    credit = F.when(F.col("credit_restricted") == 1, lit_d(1.0)).otherwise(
        F.pow(lit_d(750.0) / clip(F.col("credit_score").cast("double"), 500, 850), lit_d(0.55)))
    lam = (lit_d(base) * _lookup("construction_type", CONSTRUCTION_FREQ)
           * (lit_d(1.0) + lit_d(0.0025) * F.greatest(F.col("home_age") - 10, F.lit(0)))
           * (lit_d(0.82) + lit_d(0.036) * (F.col("protection_class") - 1))
           * _lookup("occupancy", OCCUPANCY_FREQ)
           * F.pow(lit_d(1.32), F.col("prior_claims_3yr").cast("double"))
           * credit
           * _lookup("deductible", DEDUCTIBLE_FREQ))
    for c, f in FREQ_FLAGS:
        lam = lam * _flag(c, f)
    return lam


def renewal_credit(ref_year: int = REF_YEAR) -> Column:
    """1 if tenure >= 3 years and no prior claims."""
    return ((F.lit(ref_year) - F.col("policy_year") >= 3) & (F.col("prior_claims_3yr") == 0)).cast("int")


def frequency_normaliser(df: DataFrame, base: float = BASE_CLAIM_RATE) -> float:
    """Portfolio mean of the unnormalised lambda (one partial aggregate, one row out)."""
    mean_raw = df.select(frequency_raw(base).alias("r")).agg(F.avg("r")).first()[0]
    return base if mean_raw is None or mean_raw == 0 else float(mean_raw)


def frequency_plan(df: DataFrame, base: float = BASE_CLAIM_RATE, out: str = "_lam",
                   mean_raw: float | None = None) -> DataFrame:
    """Lambda normalised to a portfolio mean of ``base``, clipped, renewal credit.

    ``mean_raw`` defaults to this book's own normaliser; pass the original book's to
    re-rate edited rows (what-if) on the same scale. Adds ``renewal_credit`` and the
    unrounded lambda ``out``.
    """
    if mean_raw is None:
        mean_raw = frequency_normaliser(df, base)
    lam = clip(frequency_raw(base) / lit_d(mean_raw) * lit_d(base), *LAMBDA_CLIP)
    rc = renewal_credit()
    return df.select("*", rc.alias("renewal_credit"),
                     (lam * F.when(rc > 0, lit_d(RENEWAL_CREDIT)).otherwise(lit_d(1.0))).alias(out))


# ── R2 severity ───────────────────────────────────────────────────────────
def severity_expr() -> Column:
    fst = F.when(F.col("dist_to_fire_station_mi") < 0, lit_d(FIRE_STATION_MEAN_MI)) \
        .otherwise(F.col("dist_to_fire_station_mi"))
    mu = (F.col("home_value").cast("double") * lit_d(SEVERITY_BASE_PCT)
          * (lit_d(1.0) + (F.col("square_footage") - 2000) / lit_d(28000.0))
          * (lit_d(1.0) + lit_d(0.04) * (F.col("stories") - 1))
          * (lit_d(0.87) + lit_d(0.025) * (F.col("protection_class") - 1))
          * (lit_d(1.0) + lit_d(0.018) * fst))
    for c, f in SEV_FLAGS:
        mu = mu * _flag(c, f)
    ds = F.col("defensible_space_score")
    mu = mu * (F.when(ds.isNotNull() & (ds >= 70), lit_d(0.88))
               .when(ds.isNotNull() & (ds <= 30), lit_d(1.08)).otherwise(lit_d(1.0)))
    mu = F.least(mu, F.col("coverage_amount").cast("double") * lit_d(0.80))
    return clip(mu, *MU_CLIP)


def severity_plan(df: DataFrame, out: str = "_mu") -> DataFrame:
    """R2: conditional severity mu (unrounded in ``out``)."""
    return df.select("*", severity_expr().alias(out))


# ── R3 interaction multiplier ─────────────────────────────────────────────
def _zone(col: str) -> Column:
    """High, Moderate or Low (any other value); null stays null."""
    c = F.col(col)
    return F.when(c.isin("High", "Moderate"), c).when(c.isNotNull(), F.lit("Low"))


#: What a policy is exposed to: a level (text) or a yes / no, by name.
EXPOSURES = {
    "wildfire": lambda: _zone("wildfire_zone"), "flood": lambda: _zone("flood_zone"), "earthquake": lambda: _zone("earthquake_zone"),
    "hail": lambda: _zone("hail_zone"), "vegetation": lambda: _zone("vegetation_risk_composite"),
    "wood roof": lambda: F.col("roof_material") == "Wood Shake", "aged roof": lambda: F.col("roof_age_yr") > 20,
    "frame": lambda: F.col("construction_type") == "Frame", "coast": lambda: F.col("dist_to_coast_mi") < 5,
    "far from help": lambda: F.col("protection_class") >= 8, "claims": lambda: F.col("prior_claims_3yr") >= 2,
    "cleared land": lambda: F.coalesce(F.col("defensible_space_score"), lit_d(50.0)) >= 70,
    "steep": lambda: F.col("slope_steepness_pct") > 55, "heavy rain": lambda: F.col("post_burn_rainfall_intensity") > 60,
}
YES, NO, ANY = True, False, None
#: Factor of the multiplier by the levels of exposures that meet; other levels count 1.
CO_EXPOSURE = [
    (("wildfire", "wood roof"), {("High", YES): 3.50, ("High", NO): 1.80, ("Moderate", YES): 2.10, ("Low", YES): 1.40}),
    (("flood", "coast"), {("High", YES): 2.20, ("High", NO): 1.60, ("Moderate", ANY): 1.20}),
    (("earthquake",), {("High",): 1.50, ("Moderate",): 1.15}),
    (("aged roof", "frame"), {(YES, YES): 1.35, (YES, NO): 1.15}),
    (("frame", "far from help"), {(YES, YES): 1.18}),
    (("vegetation", "claims"), {("High", YES): 1.55, ("High", NO): 1.10, ("Moderate", YES): 1.25}),
    (("hail", "aged roof"), {("High", YES): 1.45, ("High", NO): 1.15, ("Moderate", YES): 1.20}),
    (("wildfire", "cleared land"), {("High", YES): 0.72, ("Moderate", YES): 0.82}),
    (("wildfire", "steep", "heavy rain"), {("High", YES, YES): 1.65, ("High", YES, NO): 1.18}),
]


def co_exposure_factor(names: tuple[str, ...], table: dict[tuple, float]) -> Column:
    """The table's factor for a policy's levels of the named exposures, 1 where none is given or known."""
    levels = [EXPOSURES[n]() for n in names]
    out = lit_d(1.0)
    for wanted, factor in table.items():
        fits = F.lit(True)
        for level, w in zip(levels, wanted, strict=True):
            fits = fits if w is ANY else fits & (level == F.lit(w))
        out = F.when(fits, lit_d(factor)).otherwise(out)
    return out


def interaction_expr() -> Column:
    m = lit_d(1.0)
    for names, table in CO_EXPOSURE[:-1]:
        m = m * co_exposure_factor(names, table)
    m = m * F.col("vintage_cat_multiplier") * co_exposure_factor(*CO_EXPOSURE[-1])
    return clip(m, *M_CLIP)


def interaction_plan(df: DataFrame, out: str = "_m") -> DataFrame:
    """Product of the co-exposure rules, clipped to [0.70, 3.5]."""
    return df.select("*", interaction_expr().alias(out))


# ── R4-R10 ────────────────────────────────────────────────────────────────
def expected_loss(lam: str = "_lam", mu: str = "_mu", m: str = "_m") -> Column:
    """Lambda x mu x M, 2 decimals."""
    return rnd(F.col(lam) * F.col(mu) * F.col(m), 2)


def score_a1(el: Column, lo_log: float, hi_log: float) -> Column:
    """clip(50 + 900 (log1p(E) - lo) / (hi - lo), 50, 950).

    ``lo_log`` / ``hi_log`` are log1p of the anchors (book min/max for R5, stored
    percentiles for R6). A degenerate range maps everything to 50.
    """
    span = hi_log - lo_log
    if span == 0:
        return F.when(el.isNotNull(), lit_d(50.0))
    return clip(lit_d(50.0) + lit_d(900.0) * (F.log1p(el) - lit_d(lo_log)) / lit_d(span), 50, 950)


def minmax_log_anchors(df: DataFrame, el: str) -> tuple[float, float]:
    """Book-wide min and max of log1p(E) (one partial aggregate)."""
    r = df.agg(F.min(F.log1p(F.col(el))).alias("lo"), F.max(F.log1p(F.col(el))).alias("hi")).first()
    return (r["lo"] or 0.0, r["hi"] or 0.0)


def score_a2(lam: Column, mu_m: Column, cfg: PricingConfig = PricingConfig()) -> Column:
    """Power mean of capped frequency and severity sub-scores."""
    f_sc = F.least(lit_d(500.0), lam / lit_d(cfg.lam_cap) * lit_d(500.0))
    s_sc = F.least(lit_d(500.0), mu_m / lit_d(cfg.sev_cap) * lit_d(500.0))
    a = cfg.alpha
    pm = F.pow(lit_d(cfg.score_wf) * F.pow(f_sc + 1, lit_d(a)) + lit_d(cfg.score_ws) * F.pow(s_sc + 1, lit_d(a)),
               lit_d(1.0 / a)) - 1
    return clip(pm, 0, 1000)


def sub_scores(lam: Column, mu_m: Column, cfg: PricingConfig = PricingConfig()) -> tuple[Column, Column]:
    f_sc = F.least(lit_d(500.0), lam / lit_d(cfg.lam_cap) * lit_d(500.0))
    s_sc = F.least(lit_d(500.0), mu_m / lit_d(cfg.sev_cap) * lit_d(500.0))
    return f_sc, s_sc


def premium(el: Column, cfg: PricingConfig = PricingConfig(), mode: str = "divisor") -> Column:
    """E / target_lr; optional divisor lr/(1+load) or multiplier (1+load)."""
    if mode == "divisor":
        return el / lit_d(cfg.target_lr / (1.0 + cfg.expense_load))
    return el / lit_d(cfg.target_lr) * lit_d(1.0 + cfg.expense_load)


def tier3_share(m_hat: Column) -> Column:
    """Share of E attributable to the multiplier, in percent."""
    return (m_hat - 1) / F.greatest(m_hat, lit_d(0.01)) * 100


def impact_class(m: Column, band_base: Column, band_full: Column) -> Column:
    """Compounding class from M: severe (>2 or band changed), moderate (>1.3), minimal."""
    return (F.when((m > 2.0) | (band_base != band_full), "severe")
            .when(m > 1.3, "moderate").otherwise("minimal"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["risk_band"]
