"""DuckDB text of the fixture book, written independently of the Spark rating plan.

Only the stage-A fixture table (FIXTURES.md section 3) is shared with the Spark
side; the rating plan, outcomes, cap and scores below are plain SQL.
"""
from __future__ import annotations

from riskbook.sources.fixture import FEATURE_COLUMNS, LAYERS, STATE_COLS, STATE_DIM, render


def _r(x: str, d: int) -> str:
    s = float(10 ** d)
    return f"(floor(({x})*{s!r}e0+0.5e0)/{s!r}e0)".replace(".0e0", "e0")


def _state_values() -> str:
    rows = []
    for r in STATE_DIM:
        vals = [str(r[0]), f"'{r[1]}'"] + [f"{float(v)!r}e0".replace("e0", "") + "e0" for v in r[2:9]] \
            + [str(v) for v in r[9:]]
        rows.append("(" + ", ".join(vals) + ")")
    return "(VALUES " + ", ".join(rows) + ") AS d(" + ", ".join(STATE_COLS) + ")"


def features_sql() -> str:
    layers = []
    prev = "src"
    carry = ["o_orderkey"] + STATE_COLS[1:]
    done: list[str] = []
    for i, layer in enumerate(LAYERS, 1):
        names = [n for n, _ in layer]
        keep = [c for c in carry + done if c not in names]
        exprs = ", ".join(f"{render(e, 'duckdb')} AS {n}" for n, e in layer)
        layers.append(f"l{i} AS (SELECT {', '.join(keep)}, {exprs} FROM {prev})")
        prev = f"l{i}"
        done += [n for n in names if n not in done]
    src = ("src AS (SELECT o.o_orderkey, d.* FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
           f"JOIN {_state_values()} ON d.k = c.c_nationkey % 10)")
    feats = f"feat AS (SELECT o_orderkey, {', '.join(FEATURE_COLUMNS)} FROM {prev})"
    return ",\n".join([src] + layers + [feats])


LAM_RAW = """0.058e0
 * CASE construction_type WHEN 'Frame' THEN 1.28e0 WHEN 'Masonry' THEN 0.86e0 WHEN 'Superior' THEN 0.72e0 WHEN 'Mixed' THEN 1.08e0 END
 * (1e0 + 0.0025e0 * greatest(home_age - 10, 0))
 * (0.82e0 + 0.036e0 * (protection_class - 1))
 * CASE occupancy WHEN 'Owner Occupied' THEN 1.00e0 WHEN 'Tenant Occupied' THEN 1.22e0 WHEN 'Vacant' THEN 1.65e0 END
 * power(1.32e0, prior_claims_3yr::double)
 * CASE WHEN credit_restricted = 1 THEN 1e0 ELSE power(750e0 / least(greatest(credit_score::double, 500e0), 850e0), 0.55e0) END
 * CASE deductible WHEN 500 THEN 1.00e0 WHEN 1000 THEN 0.90e0 WHEN 2500 THEN 0.75e0 WHEN 5000 THEN 0.62e0 END
 * CASE WHEN swimming_pool = 1 THEN 1.10e0 ELSE 1e0 END
 * CASE WHEN trampoline = 1 THEN 1.14e0 ELSE 1e0 END
 * CASE WHEN dog = 1 THEN 1.08e0 ELSE 1e0 END
 * CASE WHEN security_system = 1 THEN 0.90e0 ELSE 1e0 END
 * CASE WHEN smoke_detectors = 1 THEN 0.93e0 ELSE 1e0 END
 * CASE WHEN sprinkler_system = 1 THEN 0.82e0 ELSE 1e0 END
 * CASE WHEN gated_community = 1 THEN 0.91e0 ELSE 1e0 END
 * CASE WHEN has_knob_tube_wiring = 1 THEN 1.20e0 ELSE 1e0 END
 * CASE WHEN has_polybutylene_pipe = 1 THEN 1.25e0 ELSE 1e0 END"""

MU_RAW = """home_value::double * 0.048e0
 * (1e0 + (square_footage - 2000) / 28000e0)
 * (1e0 + 0.04e0 * (stories - 1))
 * (0.87e0 + 0.025e0 * (protection_class - 1))
 * (1e0 + 0.018e0 * CASE WHEN dist_to_fire_station_mi < 0 THEN 3.2e0 ELSE dist_to_fire_station_mi END)
 * CASE WHEN smoke_detectors = 1 THEN 0.87e0 ELSE 1e0 END
 * CASE WHEN sprinkler_system = 1 THEN 0.62e0 ELSE 1e0 END
 * CASE WHEN has_knob_tube_wiring = 1 THEN 1.15e0 ELSE 1e0 END
 * CASE WHEN has_polybutylene_pipe = 1 THEN 1.18e0 ELSE 1e0 END"""

M_RAW = """1e0
 * CASE WHEN roof_material = 'Wood Shake' AND wildfire_zone = 'High' THEN 3.50e0 ELSE 1e0 END
 * CASE WHEN roof_material = 'Wood Shake' AND wildfire_zone = 'Moderate' THEN 2.10e0 ELSE 1e0 END
 * CASE WHEN roof_material <> 'Wood Shake' AND wildfire_zone = 'High' THEN 1.80e0 ELSE 1e0 END
 * CASE WHEN roof_material = 'Wood Shake' AND wildfire_zone NOT IN ('High', 'Moderate') THEN 1.40e0 ELSE 1e0 END
 * CASE WHEN flood_zone = 'High' AND dist_to_coast_mi < 5 THEN 2.20e0 ELSE 1e0 END
 * CASE WHEN flood_zone = 'High' AND NOT dist_to_coast_mi < 5 THEN 1.60e0 ELSE 1e0 END
 * CASE WHEN flood_zone = 'Moderate' THEN 1.20e0 ELSE 1e0 END
 * CASE WHEN earthquake_zone = 'High' THEN 1.50e0 ELSE 1e0 END
 * CASE WHEN earthquake_zone = 'Moderate' THEN 1.15e0 ELSE 1e0 END
 * CASE WHEN roof_age_yr > 20 AND construction_type = 'Frame' THEN 1.35e0 ELSE 1e0 END
 * CASE WHEN roof_age_yr > 20 AND construction_type <> 'Frame' THEN 1.15e0 ELSE 1e0 END
 * CASE WHEN construction_type = 'Frame' AND protection_class >= 8 THEN 1.18e0 ELSE 1e0 END
 * CASE WHEN prior_claims_3yr >= 2 AND vegetation_risk_composite = 'High' THEN 1.55e0 ELSE 1e0 END
 * CASE WHEN prior_claims_3yr >= 2 AND vegetation_risk_composite = 'Moderate' THEN 1.25e0 ELSE 1e0 END
 * CASE WHEN prior_claims_3yr < 2 AND vegetation_risk_composite = 'High' THEN 1.10e0 ELSE 1e0 END
 * CASE WHEN roof_age_yr > 20 AND hail_zone = 'High' THEN 1.45e0 ELSE 1e0 END
 * CASE WHEN roof_age_yr > 20 AND hail_zone = 'Moderate' THEN 1.20e0 ELSE 1e0 END
 * CASE WHEN roof_age_yr <= 20 AND hail_zone = 'High' THEN 1.15e0 ELSE 1e0 END
 * CASE WHEN wildfire_zone = 'High' AND coalesce(defensible_space_score, 50e0) >= 70 THEN 0.72e0 ELSE 1e0 END
 * CASE WHEN wildfire_zone = 'Moderate' AND coalesce(defensible_space_score, 50e0) >= 70 THEN 0.82e0 ELSE 1e0 END
 * vintage_cat_multiplier
 * CASE WHEN wildfire_zone = 'High' AND slope_steepness_pct > 55 AND post_burn_rainfall_intensity > 60 THEN 1.65e0 ELSE 1e0 END
 * CASE WHEN wildfire_zone = 'High' AND slope_steepness_pct > 55 AND NOT post_burn_rainfall_intensity > 60 THEN 1.18e0 ELSE 1e0 END"""


def _u(salt: str) -> str:
    return f"(('0x'||substr(md5(o_orderkey::varchar||':{salt}'),1,8))::bigint/4294967296.0::double)"


def book_ctes() -> str:
    """CTE chain ending in ``book`` (61 columns, same names as the Spark book)."""
    mu = f"""least(400000e0, greatest(1500e0, least(
      CASE WHEN defensible_space_score IS NOT NULL AND defensible_space_score >= 70 THEN ({MU_RAW}) * 0.88e0
           WHEN defensible_space_score IS NOT NULL AND defensible_space_score <= 30 THEN ({MU_RAW}) * 1.08e0
           ELSE ({MU_RAW}) END,
      coverage_amount * 0.80e0)))"""
    ctes = [features_sql()]
    ctes.append(f"r1 AS (SELECT *, {LAM_RAW} AS lam_raw FROM feat)")
    ctes.append("r1n AS (SELECT *, least(0.18e0, greatest(0.005e0, lam_raw / (SELECT avg(lam_raw) FROM r1) * 0.058e0)) AS lam_c, "
                "CASE WHEN 2024 - policy_year >= 3 AND prior_claims_3yr = 0 THEN 1 ELSE 0 END AS renewal_credit FROM r1)")
    ctes.append(f"r2 AS (SELECT *, CASE WHEN renewal_credit = 1 THEN lam_c * 0.95e0 ELSE lam_c END AS lam_u, {mu} AS mu_u, "
                f"least(3.5e0, greatest(0.70e0, {M_RAW})) AS m_u FROM r1n)")
    ctes.append(f"r3 AS (SELECT *, {_r('lam_u', 5)} AS lambda_true, {_r('mu_u', 0)} AS mu_true, {_r('m_u', 4)} AS M_true, "
                f"{_r('lam_u * mu_u * m_u', 2)} AS expected_loss_true FROM r2)")
    occ = f"CASE WHEN {_u('occd')} < lambda_true THEN 1 ELSE 0 END"
    ctes.append(f"r4 AS (SELECT *, {occ} AS claim_occurred, {_u('cnt')} AS u_cnt, {_u('cat')} AS u_cat, {_u('sev')} AS u_sev FROM r3)")
    cat = "(claim_occurred = 1 AND u_cat < least(0.30e0, greatest(0.015e0, 0.015e0 * M_true)))"
    raw = (f"CASE WHEN {cat} THEN 85000e0 + 0.55e0 * mu_true * (power(1e0 - u_sev, -0.25e0) - 1e0) / 0.25e0 "
           "ELSE mu_true * M_true * (-ln(1e0 - u_sev)) END")
    ctes.append("r5 AS (SELECT *, claim_occurred * (1 + CASE WHEN u_cnt < 0.10e0 THEN 1 ELSE 0 END + CASE WHEN u_cnt < 0.02e0 THEN 1 ELSE 0 END) AS claim_count, "
                f"CASE WHEN {cat} THEN 1 ELSE 0 END AS is_cat_event, "
                f"CASE WHEN claim_occurred = 1 THEN greatest(least(({raw}) * trend_factor, coverage_amount), 100e0) ELSE 0e0 END AS pre_loss FROM r4)")
    ctes.append("anch AS (SELECT (SELECT quantile_cont(pre_loss, 0.995) FROM r5 WHERE pre_loss > 0) AS cap, "
                "min(ln(1e0 + expected_loss_true)) AS lo, max(ln(1e0 + expected_loss_true)) AS hi FROM r5)")
    score = "least(950e0, greatest(50e0, 50e0 + 900e0 * (ln(1e0 + expected_loss_true) - lo) / (hi - lo)))"
    ctes.append(f"r6 AS (SELECT r5.*, {_r('least(pre_loss, coalesce(cap, pre_loss))', 2)} AS total_loss, {_r(score, 1)} AS risk_score_true FROM r5, anch)")
    f_sc = "least(500e0, lam_u / 0.15e0 * 500e0)"
    s_sc = "least(500e0, mu_u * m_u / 500000e0 * 500e0)"
    a2 = f"least(1000e0, greatest(0e0, power(0.45e0 * power({f_sc} + 1, 0.8e0) + 0.55e0 * power({s_sc} + 1, 0.8e0), 1e0 / 0.8e0) - 1))"
    band = ("CASE WHEN risk_score_true < 200 THEN 'Very Low' WHEN risk_score_true < 400 THEN 'Low' "
            "WHEN risk_score_true < 600 THEN 'Moderate' WHEN risk_score_true < 800 THEN 'High' ELSE 'Very High' END")
    ctes.append("book AS (SELECT " + ", ".join(FEATURE_COLUMNS) + ", renewal_credit, lambda_true, mu_true, M_true, "
                "expected_loss_true, claim_occurred, claim_count, total_loss AS claim_amount, total_loss, is_cat_event, "
                f"risk_score_true, {band} AS risk_band, {_r(a2, 1)} AS risk_score_a2, "
                f"{_r('expected_loss_true / 0.67e0', 2)} AS indicated_premium, 0.67e0 AS expected_loss_ratio, "
                "o_orderkey, lam_u, mu_u, m_u FROM r6)")
    return "WITH " + ",\n".join(ctes)


def with_book(select_sql: str) -> str:
    """Prefix an oracle query with the book CTE chain."""
    return book_ctes() + "\n" + select_sql
