"""Oracle SQL per query key (DuckDB dialect; the driver tables are views).

Each statement is written from the operator's definition, independently of the
Spark code; only the fixture book CTE chain (``oracles.book``) is shared by all.
Decimal literals carry an exponent so they are DOUBLE, as on the Spark side.
"""
from __future__ import annotations

from oracles.book import with_book
from riskbook.sources.book import BOOK_COLUMNS

ORACLES: dict = {}


def oracle(name: str):
    def deco(fn):
        ORACLES[name] = fn
        return fn
    return deco


# Texts, limits and factors in the statements below are those that the output must equal.


def R(x: str, d: int) -> str:
    """Round half up, as floor(x*10^d + 0.5)/10^d (same IEEE steps as the Spark side)."""
    s = 10 ** d
    return f"(floor(({x})*{s}e0+0.5e0)/{s}e0)"


def U(key: str, salt: str) -> str:
    return f"(('0x'||substr(md5(({key})::varchar||':{salt}'),1,8))::bigint/4294967296.0::double)"


def XMEAN(c: str, decimals: int, out: int, scale: int = 1) -> str:
    """Exact half-up rounded mean (same integer arithmetic as the Spark side)."""
    k = scale * 10 ** (out - decimals)
    s = f"sum(floor({c}::double * {10 ** decimals}e0 + 0.5e0)::HUGEINT)"
    n = f"count({c})"
    return f"(CASE WHEN {n} > 0 THEN ((2 * {s} * {k} + {n}) // (2 * {n}))::double / {10 ** out}e0 END)"


def XSHARE(cond: str, out: int, scale: int = 1) -> str:
    k = scale * 10 ** out
    s = f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END)::HUGEINT"
    return f"(CASE WHEN count(*) > 0 THEN ((2 * {s} * {k} + count(*)) // (2 * count(*)))::double / {10 ** out}e0 END)"


SPLIT = f"CASE WHEN {U('policy_id', 'split')} < 0.6e0 THEN 'train' WHEN {U('policy_id', 'split')} < 0.8e0 THEN 'val' ELSE 'test' END"
BAND = ("CASE WHEN {s} < 200 THEN 'Very Low' WHEN {s} < 400 THEN 'Low' WHEN {s} < 600 THEN 'Moderate' "
        "WHEN {s} < 800 THEN 'High' ELSE 'Very High' END")
SCORE = "least(950e0, greatest(50e0, 50e0 + 900e0 * (ln(1e0 + ({e})) - lo) / (hi - lo)))"
ANCH = "(SELECT min(ln(1e0 + expected_loss_true)) AS lo, max(ln(1e0 + expected_loss_true)) AS hi FROM book) an"
PAIR = f"""pair AS (
  SELECT policy_id, elb AS el_baseline, expected_loss_true AS el_full, M_true AS m_hat,
         {R(SCORE.format(e='elb'), 1)} AS score_baseline, {R(SCORE.format(e='expected_loss_true'), 1)} AS score_full,
         {R(f"elb / 0.67e0", 2)} AS premium_baseline, indicated_premium AS premium_full, total_loss AS actual
  FROM (SELECT *, {R('lambda_true * mu_true', 2)} AS elb FROM book) b, {ANCH}),
pairb AS (SELECT *, {BAND.format(s='score_baseline')} AS band_baseline, {BAND.format(s='score_full')} AS band_full FROM pair)"""


def with_pair(sql: str) -> str:
    return with_book("").rstrip() + ",\n" + PAIR + "\n" + sql


def with_ctes(extra: str, sql: str) -> str:
    return with_book("").rstrip() + ",\n" + extra + "\n" + sql


ENC_COLS = ["construction_type", "occupancy", "wildfire_zone", "flood_zone", "earthquake_zone",
            "roof_material", "state", "hail_zone", "vegetation_risk_composite"]

SPLIT_CTES = (f"sp AS (SELECT *, {SPLIT} AS split FROM book),\n"
              "enc AS (SELECT col, val, (dense_rank() OVER (PARTITION BY col ORDER BY val) - 1)::INTEGER AS code FROM ("
              + " UNION ".join(f"SELECT DISTINCT '{c}' AS col, coalesce({c}, 'None') AS val FROM sp WHERE split = 'train'"
                               for c in ENC_COLS) + "))")


def enc_code(col: str, src: str | None = None) -> str:
    src = src or col
    return f"coalesce((SELECT code FROM enc WHERE enc.col = '{col}' AND enc.val = coalesce({src}, 'None')), 0)"


CELL = ("concat_ws('|', " + ", ".join(f"{enc_code(c)}::varchar" for c in
                                     ["wildfire_zone", "roof_material", "flood_zone", "earthquake_zone"])
        + ", (CASE WHEN slope_steepness_pct > 55 THEN 1 ELSE 0 END)::varchar)")


# ── S ─────────────────────────────────────────────────────────────────────
@oracle("fixture_book")
def o_fixture_book():
    return with_book("SELECT " + ", ".join(BOOK_COLUMNS) + " FROM book")


@oracle("read_policies")
def o_s1():
    return with_book(f"""SELECT count(*) AS policies, {R('sum(indicated_premium)', 2)} AS total_premium,
  {R('sum(total_loss)', 2)} AS total_loss, sum(home_value)::BIGINT AS total_value,
  sum(CASE WHEN defensible_space_score IS NULL THEN 1 ELSE 0 END)::BIGINT AS null_defensible FROM book""")


@oracle("holdout_or_sample")
def o_s2():
    return with_book("SELECT policy_id, expected_loss_true FROM book ORDER BY md5(policy_id || '42'), policy_id LIMIT 20000")


@oracle("write_policies")
def o_s3():
    return with_book(f"SELECT state, count(*) AS policies, {R('sum(indicated_premium)', 2)} AS premium FROM book GROUP BY state")


@oracle("cached_scores")
def o_s5():
    return with_book(f"""SELECT 'kpi' AS report, 'all' AS key, {R('sum(indicated_premium)', 2)} AS value FROM book
UNION ALL
SELECT 'loss_ratio', risk_band, {R('sum(expected_loss_true) / sum(indicated_premium) * 100', 4)} FROM book GROUP BY risk_band""")


# ── P ─────────────────────────────────────────────────────────────────────
@oracle("home_age_year_built")
def o_p1():
    return with_book("SELECT policy_id, least(2022, greatest(1950, 2024 - home_age))::INTEGER AS year_built_calc, "
                     "(2026 - year_built)::INTEGER AS home_age_submission FROM book")


@oracle("coverage_ratio")
def o_p2():
    return with_book(f"""SELECT policy_id,
  CASE WHEN home_value > 0 THEN {R('coverage_amount::double / home_value', 3)} ELSE 1e0 END AS ratio_single,
  {R('least(2.0e0, greatest(0.5e0, coverage_amount::double / greatest(home_value::double, 1e0)))', 8)} AS ratio_batch FROM book""")


@oracle("credit_restricted")
def o_p3():
    return with_book("""SELECT policy_id,
  CASE WHEN state IN ('CA') THEN 1 ELSE 0 END AS flag_data,
  CASE WHEN state IN ('CA','MA','HI','MD','MI') THEN 1 ELSE 0 END AS flag_inference,
  CASE WHEN state IN ('CA','MA','HI') THEN 1 ELSE 0 END AS flag_form,
  CASE WHEN state IN ('CA','MA','HI') THEN 720 ELSE credit_score END AS form_credit_score FROM book""")


@oracle("trend_factor")
def o_p4():
    return with_book(f"SELECT policy_id, {R('power(1e0 + trend_rate_annual, (2024 - policy_year)::double)', 4)} AS trend_factor FROM book")


@oracle("vintage_multiplier")
def o_p5():
    return with_book("""SELECT policy_id, policy_year, v.m AS vintage_mult FROM book
LEFT JOIN (VALUES (2020, 1.18e0), (2021, 1.15e0), (2022, 1.05e0), (2023, 1.02e0), (2024, 1.00e0)) v(y, m) ON v.y = policy_year""")


@oracle("permit_score")
def o_p6():
    return with_book(f"SELECT policy_id, {R('least(100e0, greatest(0e0, permit_score * (1e0 + 0.008e0 * greatest(home_age - 20, 0))))', 1)} AS permit_adjusted FROM book")


@oracle("renewal_credit")
def o_p7():
    return with_book("SELECT policy_id, CASE WHEN 2024 - policy_year >= 3 AND prior_claims_3yr = 0 THEN 1 ELSE 0 END AS renewal_credit FROM book")


@oracle("label_encode")
def o_p8():
    return with_ctes(SPLIT_CTES, "SELECT col AS column, val AS value, code FROM enc")


@oracle("label_encode_large")
def o_p8_large():
    return with_book("""SELECT policy_id AS key, dense_rank() OVER (ORDER BY policy_id) - 1 AS policy_code,
  dense_rank() OVER (ORDER BY state) - 1 AS state_code FROM book""")


@oracle("mean_impute")
def o_p9():
    return with_ctes(SPLIT_CTES, f"""SELECT policy_id, {R("coalesce(defensible_space_score, (SELECT avg(defensible_space_score) FROM sp WHERE split = 'train'))", 8)} AS defensible_space_score
FROM sp""")


T12 = ["construction_type", "home_age", "home_value", "coverage_amount", "coverage_ratio",
       "square_footage", "stories", "protection_class", "occupancy",
       "prior_claims_3yr", "credit_score", "credit_restricted", "deductible",
       "swimming_pool", "trampoline", "dog",
       "security_system", "smoke_detectors", "sprinkler_system", "gated_community",
       "has_knob_tube_wiring", "has_polybutylene_pipe",
       "permit_score", "dist_to_fire_station_mi"]


def _t12_encoded(src: str) -> str:
    cols = [f"{enc_code(c)}::double AS {c}" if c in ENC_COLS else f"{c}::double AS {c}" for c in T12]
    return f"SELECT policy_id, split, {', '.join(cols)} FROM {src}"


@oracle("standard_scale")
def o_p10():
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in T12)
    sel = ", ".join(f"{R(f'({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1e0 END', 6)} AS {c}" for c in T12)
    extra = SPLIT_CTES + f",\nx AS ({_t12_encoded('sp')}),\nst AS (SELECT {stats} FROM x WHERE split = 'train')"
    return with_ctes(extra, f"SELECT policy_id, {sel} FROM x, st")


@oracle("sentinel_neutralise")
def o_p11():
    return with_book("SELECT policy_id, CASE WHEN dist_to_fire_station_mi < 0 THEN 3.2e0 ELSE dist_to_fire_station_mi END AS fire_dist, "
                     "coalesce(defensible_space_score, 50e0) AS defensible_m_rule FROM book")


@oracle("risk_band")
def o_p12():
    return with_book(f"SELECT policy_id, {BAND.format(s='risk_score_true')} AS band FROM book")


@oracle("uw_action")
def o_p13():
    return with_book("""SELECT policy_id, CASE risk_band WHEN 'Very Low' THEN '✅ Accept — Best Terms'
  WHEN 'Low' THEN '✅ Accept — Standard Terms' WHEN 'Moderate' THEN '🔶 Accept with Conditions'
  WHEN 'High' THEN '🔴 Refer to Senior Underwriter' WHEN 'Very High' THEN '🚫 Decline / Surplus Lines Market' END AS uw_action FROM book""")


@oracle("decision_tier")
def o_p14():
    return with_book("""SELECT policy_id,
  CASE WHEN risk_score_true <= 300 THEN 'Preferred' WHEN risk_score_true <= 500 THEN 'Standard'
       WHEN risk_score_true <= 700 THEN 'Non-Standard' ELSE 'High Risk' END AS tier,
  CASE WHEN risk_score_true <= 500 THEN 'Auto-Bind (instant)' WHEN risk_score_true <= 700 THEN 'Manual Review (2 min)'
       ELSE 'Auto-Decline / Override' END AS action FROM book""")


@oracle("credit_tier_note")
def o_p15():
    return with_book("SELECT policy_id, CASE WHEN credit_score < 650 THEN 'sub-prime' WHEN credit_score < 750 THEN 'standard' ELSE 'preferred' END AS credit_tier FROM book")


@oracle("winsorize_loss")
def o_p16():
    pre = "CASE WHEN claim_amount > 0 THEN greatest(least(claim_amount, coverage_amount), 100e0) ELSE 0e0 END"
    return with_ctes(f"w AS (SELECT claim_amount, {pre} AS pre FROM book), c AS (SELECT quantile_cont(pre, 0.99) AS cap FROM w WHERE pre > 0)",
                     f"""SELECT count(*) AS policies, sum(CASE WHEN claim_amount > 0 THEN 1 ELSE 0 END)::BIGINT AS positives,
  sum(CASE WHEN least(pre, cap) < claim_amount THEN 1 ELSE 0 END)::BIGINT AS capped_rows,
  {R('sum(least(pre, cap))', 2)} AS total_capped, {R('max(cap)', 4)} AS cap FROM w, c""")


@oracle("cell_key")
def o_p17():
    return with_ctes(SPLIT_CTES, f"SELECT policy_id, {CELL} AS cell FROM sp")


# ── R ─────────────────────────────────────────────────────────────────────
@oracle("frequency_plan")
def o_r1():
    return with_book("SELECT policy_id, renewal_credit, lambda_true FROM book")


@oracle("severity_plan")
def o_r2():
    return with_book("SELECT policy_id, mu_true FROM book")


@oracle("interaction_plan")
def o_r3():
    return with_book("SELECT policy_id, M_true FROM book")


@oracle("expected_loss")
def o_r4():
    return with_book("SELECT policy_id, expected_loss_true FROM book")


@oracle("score_a1_minmax")
def o_r5():
    return with_book(f"SELECT policy_id, {R(SCORE.format(e='expected_loss_true'), 1)} AS score FROM book, {ANCH}")


@oracle("score_a1_anchored")
def o_r6():
    sc = "least(950e0, greatest(50e0, 50e0 + 900e0 * (ln(1e0 + el_full) - ln(1e0 + el_min)) / (ln(1e0 + el_max) - ln(1e0 + el_min))))"
    return with_pair(f"""SELECT policy_id, {R(sc, 1)} AS score, {R('el_min', 4)} AS el_min, {R('el_max', 4)} AS el_max
FROM pair, (SELECT quantile_cont(el_baseline, 0.01) AS el_min, quantile_cont(el_full, 0.99) AS el_max FROM pair) a""")


@oracle("score_a1_percentile")
def o_r7():
    return with_book(f"""SELECT policy_id, {R('pr', 8)} AS percent_rank, {R('50e0 + 900e0 * pr', 4)} AS score_rank
FROM (SELECT policy_id, CASE WHEN count(*) OVER () > 1 THEN (rank() OVER (ORDER BY expected_loss_true) - 1)::double / (count(*) OVER () - 1) ELSE 0e0 END AS pr FROM book) t""")


@oracle("score_a2")
def o_r8():
    f = "least(500e0, lambda_true / 0.30e0 * 500e0)"
    s = "least(500e0, mu_true * M_true / 600000e0 * 500e0)"
    a2 = f"least(1000e0, greatest(0e0, power(0.45e0 * power({f} + 1, 0.8e0) + 0.55e0 * power({s} + 1, 0.8e0), 1e0 / 0.8e0) - 1))"
    return with_book(f"SELECT policy_id, {R(f, 4)} AS f_score, {R(s, 4)} AS s_score, {R(a2, 4)} AS score_a2 FROM book")


@oracle("indicated_premium")
def o_r9():
    return with_book(f"""SELECT policy_id, {R('expected_loss_true / 0.67e0', 2)} AS premium,
  {R('expected_loss_true / (0.67e0 / 1.18e0)', 2)} AS premium_divisor,
  {R('expected_loss_true / 0.67e0 * 1.18e0', 2)} AS premium_multiplier FROM book""")


@oracle("pct_from_tier3")
def o_r10():
    return with_pair(f"SELECT policy_id, {R('(m_hat - 1) / greatest(m_hat, 0.01e0) * 100', 4)} AS pct_from_tier3, "
                     f"{R('premium_full - premium_baseline', 2)} AS premium_added FROM pair")


# R11 display rules: (group, order in group, condition, label, multiplier, class)
IX_RULES = [
    (1, 1, "roof_material = 'Wood Shake' AND wildfire_zone = 'High'", "Wood Shake × High Wildfire", 3.50, "severe"),
    (1, 2, "roof_material = 'Wood Shake' AND wildfire_zone = 'Moderate'", "Wood Shake × Mod Wildfire", 2.10, "moderate"),
    (1, 3, "wildfire_zone = 'High'", "Non-Wood × High Wildfire", 1.80, "moderate"),
    (1, 4, "roof_material = 'Wood Shake'", "Wood Shake (base fire exposure)", 1.40, "mild"),
    (2, 1, "flood_zone = 'High' AND dist_to_coast_mi < 5", "High Flood × Coastal Surge <5mi", 2.20, "severe"),
    (2, 2, "flood_zone = 'High'", "High Flood Zone", 1.60, "moderate"),
    (2, 3, "flood_zone = 'Moderate'", "Moderate Flood Zone", 1.20, "mild"),
    (3, 1, "earthquake_zone = 'High'", "High Earthquake Zone", 1.50, "moderate"),
    (3, 2, "earthquake_zone = 'Moderate'", "Moderate Earthquake Zone", 1.15, "mild"),
    (4, 1, "roof_age_yr > 20 AND construction_type = 'Frame'", "Old Roof (>20yr) × Frame", 1.35, "moderate"),
    (4, 2, "roof_age_yr > 20", "Aged Roof > 20 years", 1.15, "mild"),
    (5, 1, "roof_age_yr > 20 AND hail_zone = 'High'", "Old Roof × High Hail Zone", 1.30, "moderate"),
    (5, 2, "roof_age_yr > 20 AND hail_zone = 'Moderate'", "Old Roof × Mod Hail Zone", 1.20, "moderate"),
    (6, 1, "prior_claims_3yr >= 2 AND vegetation_risk_composite = 'High'", "Water Claims × High Vegetation Density", 1.25, "moderate"),
    (6, 2, "prior_claims_3yr >= 2 AND vegetation_risk_composite = 'Moderate'", "Water Claims × Moderate Vegetation", 1.15, "mild"),
    (7, 1, "has_knob_tube_wiring = 1", "Knob-and-Tube Wiring (interior)", 1.20, "moderate"),
    (8, 1, "has_polybutylene_pipe = 1", "Polybutylene Plumbing (interior)", 1.22, "severe"),
    (9, 1, "construction_type = 'Frame' AND protection_class >= 8", "Frame Construction × PC ≥ 8", 1.18, "moderate"),
    (10, 1, "roof_material = 'Metal' AND wildfire_zone IN ('Moderate', 'High') AND sprinkler_system = 1",
     "Metal Roof + Sprinkler × WF Zone (protective)", 0.82, "protective"),
    (11, 1, "coalesce(defensible_space_score, 0e0) >= 80 AND wildfire_zone IN ('Moderate', 'High')",
     "High Defensible Space (≥80) in WUI (protective)", 0.88, "protective"),
    (12, 1, "construction_type = 'Superior' AND roof_age_yr <= 5", "New Superior Construction ≤5yr (protective)", 0.85, "protective"),
    (13, 1, "wildfire_zone = 'High' AND slope_steepness_pct > 55 AND post_burn_rainfall_intensity > 60",
     "Slope >55% × High WF × Post-burn Rain >60 (3-way)", 1.45, "severe"),
    (13, 2, "wildfire_zone = 'High' AND slope_steepness_pct > 55", "Steep Slope >55% × High Wildfire Zone", 1.18, "moderate"),
]


def ix_rows_sql(src: str = "book", cols: str = "*") -> str:
    """One row per (policy, active rule): first matching rule per group, ordered by group."""
    parts = []
    for g, o, cond, label, mult, cls in IX_RULES:
        parts.append(f"SELECT policy_id, {g} AS grp, {o} AS ord, '{label}' AS label, {mult}e0 AS mult, '{cls}' AS severity "
                     f"FROM {src} WHERE {cond}")
    allr = " UNION ALL ".join(parts)
    return (f"ixr AS (SELECT policy_id, grp, label, mult, severity, "
            f"(row_number() OVER (PARTITION BY policy_id ORDER BY grp) - 1)::INTEGER AS pos FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY policy_id, grp ORDER BY ord) AS rk FROM ({allr})) WHERE rk = 1)")


@oracle("active_interactions")
def o_r11():
    return with_ctes(ix_rows_sql(), "SELECT policy_id, pos, label, mult, severity FROM ixr")


@oracle("rule_based_m")
def o_r12():
    return with_ctes(ix_rows_sql(), f"""SELECT b.policy_id, coalesce(n, 0)::INTEGER AS n_rules, {R('coalesce(pm, 1e0)', 6)} AS rule_m, b.M_true AS m_hat
FROM book b LEFT JOIN (SELECT policy_id, count(*) AS n, product(mult) AS pm FROM ixr GROUP BY policy_id) i ON i.policy_id = b.policy_id""")


@oracle("interaction_contribution")
def o_r13():
    return with_ctes(ix_rows_sql(), f"""SELECT label, count(*) AS policies, {R('sum(el_added)', 2)} AS el_added,
  {R('sum(prem_added)', 2)} AS premium_added, {R('avg(prem_added / indicated_premium * 100)', 4)} AS mean_share_pct
FROM (SELECT i.label, b.lambda_true * b.mu_true * (i.mult - 1) AS el_added,
             b.lambda_true * b.mu_true * (i.mult - 1) / 0.67e0 * 1e0 AS prem_added, b.indicated_premium
      FROM ixr i JOIN book b ON b.policy_id = i.policy_id) t GROUP BY label""")


@oracle("premium_attribution")
def o_r14():
    lam, el = "b.lambda_true", "b.expected_loss_true"
    items = [
        (1, "prior_claims_3yr > 0", "printf('Prior Claims (×%d)', prior_claims_3yr)", f"least(prior_claims_3yr * 0.28e0 * {lam} / 0.67e0 * 1e0, 1800e0)"),
        (2, "credit_score < 680", "printf('Low Credit (%d)', credit_score)", f"least((680 - credit_score) / 100e0 * 0.18e0 * {lam} / 0.67e0 * 1e0, 900e0)"),
        (3, "protection_class >= 7", "printf('Protection Class %d', protection_class)", f"least((protection_class - 5) * 0.07e0 * {lam} / 0.67e0 * 1e0, 600e0)"),
        (4, "occupancy = 'Vacant'", "'Vacant Occupancy'", "520e0"),
        (5, "security_system = 1", "'Security System (credit)'", "-180e0"),
        (6, "gated_community = 1", "'Gated Community (credit)'", "-120e0"),
        (7, "home_age > 30", "printf('Older Home (%dyr)', home_age)", "least((home_age - 25) * 8e0, 500e0)"),
        (8, "dist_to_fire_station_mi > 5", "printf('Fire Station Dist (%.1fmi)', dist_to_fire_station_mi)", "least((dist_to_fire_station_mi - 3) * 60e0, 600e0)"),
        (9, "sprinkler_system = 1", "'Sprinkler System (credit)'", "-450e0"),
        (10, "smoke_detectors = 1", "'Smoke Detectors (credit)'", "-130e0"),
        (30, "coverage_amount > home_value * 1.15e0", "'Coverage Overstatement'", "least((coverage_amount - home_value) * 0.002e0, 600e0)"),
    ]
    parts = [f"SELECT b.policy_id, {seq} AS seq, {name} AS driver, ({val})::double AS value FROM book b WHERE {cond}"
             for seq, cond, name, val in items]
    parts.append(f"SELECT b.policy_id, 11 + i.pos AS seq, '⚡ ' || i.label AS driver, least((i.mult - 1) * {el} / 0.67e0 * 1e0 * 0.7e0, 3000e0) AS value "
                 "FROM ixr i JOIN book b ON b.policy_id = i.policy_id")
    drivers = " UNION ALL ".join(parts)
    return with_ctes(ix_rows_sql(), f"""SELECT policy_id, rank::INTEGER AS rank, driver, {R('value', 4)} AS value,
  {R('(SELECT avg(indicated_premium) FROM book) + sum(value) OVER (PARTITION BY policy_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 2)} AS running_total
FROM (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY abs(value) DESC, seq) AS rank FROM ({drivers})) t WHERE rank <= 10""")


@oracle("plan_vs_tier")
def o_r15():
    return with_pair(f"""SELECT policy_id,
  CASE WHEN m_hat > 2.0e0 OR band_baseline <> band_full THEN 'severe' WHEN m_hat > 1.3e0 THEN 'moderate' ELSE 'minimal' END AS impact,
  {R('score_full - score_baseline', 1)} AS delta_score, {R('premium_full - premium_baseline', 2)} AS delta_premium,
  CASE WHEN band_baseline <> band_full THEN 1 ELSE 0 END AS band_changed FROM pairb""")


# ── V ─────────────────────────────────────────────────────────────────────
def _texts(items: list[tuple[str, str]], default: str | None = None, src: str = "book b") -> str:
    parts = [f"SELECT b.policy_id, {i} AS k, {txt} AS text FROM {src} WHERE {cond}" for i, (cond, txt) in enumerate(items)]
    return " UNION ALL ".join(parts)


def _money(x: str) -> str:
    return f"format('{{:,}}', ({R(x + '::double', 0)})::BIGINT)"


def _positions(union_sql: str, default: str | None) -> str:
    base = f"SELECT policy_id, (row_number() OVER (PARTITION BY policy_id ORDER BY k) - 1)::INTEGER AS pos, text FROM ({union_sql})"
    if default is None:
        return base
    return (f"{base} UNION ALL SELECT policy_id, 0, '{default}' FROM book WHERE policy_id NOT IN "
            f"(SELECT policy_id FROM ({union_sql}))")


@oracle("input_warnings")
def o_v1():
    items = [
        ("coverage_amount < home_value * 0.70e0", f"'⚠️ Coverage ($' || {_money('coverage_amount')} || ') is below 70% of home value — underinsurance risk'"),
        ("coverage_amount > home_value * 1.30e0", f"'⚠️ Coverage ($' || {_money('coverage_amount')} || ') exceeds 130% of home value — over-insurance / moral hazard signal'"),
        ("coalesce(year_built, 2000) > 2024", "'⚠️ Year built is in the future'"),
        ("coalesce(year_built, 2000) < 1900", "'⚠️ Year built before 1900 — unusual for active policy'"),
        ("deductible > home_value * 0.06e0", f"'⚠️ Deductible ($' || {_money('deductible')} || ') exceeds 6% of home value — high self-retention'"),
        ("protection_class = 10 AND coalesce(dist_to_fire_station_mi, 3e0) < 1", "'⚠️ PC=10 but fire station distance < 1mi — data inconsistency'"),
    ]
    return with_book(_positions(_texts(items), None))


@oracle("reason_codes")
def o_v2():
    head = [
        ("prior_claims_3yr >= 2", f"'• ' || prior_claims_3yr || ' prior claims → freq ×' || printf('%.2f', {R('power(1.32e0, prior_claims_3yr::double)', 2)})"),
        ("credit_score < 650", "'• Credit ' || credit_score || ' → sub-prime frequency load'"),
        ("protection_class >= 8", "'• PC ' || protection_class || ' → limited fire coverage'"),
    ]
    tail = [
        ("occupancy = 'Vacant'", "'• Vacant → +65% frequency load'"),
        ("roof_age_yr > 20", "'• Roof ' || roof_age_yr || 'yr → water intrusion risk'"),
        ("coverage_amount > home_value * 1.25e0", f"'• Over-insured $' || {_money('coverage_amount')} || ' vs $' || {_money('home_value')}"),
    ]
    parts = [f"SELECT b.policy_id, {i} AS k, {t} AS text FROM book b WHERE {c}" for i, (c, t) in enumerate(head)]
    parts.append(f"SELECT policy_id, 10 + pos AS k, '• ' || label || ' → ×' || printf('%.2f', {R('mult', 2)}) || ' (Tier 3)' FROM ixr")
    parts += [f"SELECT b.policy_id, {100 + i} AS k, {t} AS text FROM book b WHERE {c}" for i, (c, t) in enumerate(tail)]
    return with_ctes(ix_rows_sql(), _positions(" UNION ALL ".join(parts), "*No significant elevated drivers.*"))


@oracle("mitigants")
def o_v3():
    items = [
        ("sprinkler_system = 1", "'• Sprinkler system → severity −38%'"),
        ("security_system = 1", "'• Security system → theft freq −10%'"),
        ("smoke_detectors = 1", "'• Smoke detectors → fire severity −13%'"),
        ("gated_community = 1", "'• Gated community → frequency −9%'"),
        ("deductible >= 2500", "'• $' || format('{:,}', deductible) || ' deductible → freq −' || CASE deductible WHEN 2500 THEN '25' WHEN 5000 THEN '38' END || '%'"),
        ("roof_material = 'Metal'", "'• Metal roof → wildfire ignition resistance'"),
        ("construction_type IN ('Masonry', 'Superior')", "'• ' || construction_type || ' → lower freq/severity'"),
    ]
    return with_book(_positions(_texts(items), "*No significant protective features.*"))


@oracle("recommendations")
def o_v4():
    items = [
        ("roof_material = 'Wood Shake'", f"'→ Require roof replacement to Asphalt or Metal — reduces M&#x0302; from ×' || printf('%.2f', {R('M_true', 2)}) || ' toward baseline'"),
        ("prior_claims_3yr >= 2", "'→ Apply surcharge or require loss-prevention inspection'"),
        ("smoke_detectors <> 1", "'→ Require smoke detectors — severity −13%'"),
        ("sprinkler_system <> 1 AND risk_band IN ('High', 'Very High')", "'→ Sprinkler system credit available: −38% on severity'"),
        ("deductible < 1000 AND risk_band IN ('High', 'Very High')", "'→ Recommend $2,500 deductible — frequency load −25%'"),
    ]
    return with_book(_positions(_texts(items), "→ Standard terms applicable. No specific conditions required."))


@oracle("risk_narrative")
def o_v5():
    top = ("coalesce('The dominant Tier 3 interaction is ' || t.label || ' (M̂ ×' || printf('%.2f', " + R("t.mult", 2)
           + ") || ').', 'No Tier 3 interactions active — clean attritional risk profile.')")
    prior = ("CASE WHEN prior_claims_3yr > 0 THEN prior_claims_3yr || ' prior claim' || CASE WHEN prior_claims_3yr <> 1 THEN 's' ELSE '' END"
             f" || ' (frequency ×' || printf('%.2f', {R('power(1.32e0, prior_claims_3yr::double)', 2)}) || ')' ELSE 'No prior claims (preferred frequency)' END")
    credit = "CASE WHEN credit_score < 650 THEN 'sub-prime (elevated frequency)' WHEN credit_score < 750 THEN 'standard tier' ELSE 'preferred tier' END"
    t3 = f"({R('(M_true - 1) / greatest(M_true, 0.01e0) * 100', 0)})::BIGINT"
    txt = (f"'Risk Summary — ' || state || ', ' || construction_type || ' Construction. This property scores ' || risk_band || ' risk (' || "
           f"({R('risk_score_true', 0)})::BIGINT || '/1000). Expected annual loss: $' || {_money('expected_loss_true')} || "
           f"', driven by claim probability ' || printf('%.1f', {R('lambda_true * 100', 1)}) || '% and expected severity $' || {_money('mu_true')} || "
           f"'. ' || {top} || ' Interaction effects raise expected loss by ' || {t3} || '% above the Tier 1+2 base estimate. Key drivers: ' || "
           f"{prior} || '; credit score ' || credit_score || ' (' || {credit} || '); protection class ' || protection_class || "
           f"'. Indicated premium: $' || {_money('indicated_premium')} || '/year (target LR: 67%).'")
    return with_ctes(ix_rows_sql(), f"SELECT b.policy_id, {txt} AS narrative FROM book b LEFT JOIN (SELECT * FROM ixr WHERE pos = 0) t ON t.policy_id = b.policy_id")


@oracle("over_insurance_flag")
def o_v6():
    return with_book("""SELECT policy_id, CASE WHEN coverage_amount > home_value * 1.15e0 THEN 1 ELSE 0 END AS over_115,
  CASE WHEN coverage_amount > home_value * 1.25e0 THEN 1 ELSE 0 END AS over_125,
  CASE WHEN coverage_amount > home_value * 1.30e0 THEN 1 ELSE 0 END AS over_130 FROM book""")


# ── J ─────────────────────────────────────────────────────────────────────
@oracle("state_dimension_join")
def o_j1():
    from riskbook.sources.fixture import STATE_DIM
    vals = ", ".join("('{1}', {2}e0, {3}e0, {4}e0, {5}e0, {6}e0, {7}e0, {8}e0, {9}, {10}, {11})".format(*[
        (f"{v!r}" if isinstance(v, float) else str(v)) for v in r]) for r in STATE_DIM)
    return with_book(f"""SELECT policy_id, b.state, d.wf, d.fl, d.eq, d.val_med, d.hail_p, d.canopy_p, d.slope_p, d.coastal, d.wui, d.rural
FROM book b LEFT JOIN (VALUES {vals}) d(state, wf, fl, eq, val_med, hail_p, canopy_p, slope_p, coastal, wui, rural) ON d.state = b.state""")


def _oe_ctes(min_group: int = 10) -> str:
    return (SPLIT_CTES + f""",
oe_in AS (SELECT policy_id, split, claim_amount, {CELL} AS cell, {R('lambda_true * mu_true', 2)} AS glm_el FROM sp),
cells AS (SELECT cell, count(*) AS n_policies, sum(claim_amount) AS total_claim, sum(glm_el) AS total_expected,
                 sum(claim_amount) / greatest(sum(glm_el), 50e0) AS oe_raw,
                 CASE WHEN count(*) >= {min_group} THEN least(8.0e0, greatest(0.10e0, sum(claim_amount) / greatest(sum(glm_el), 50e0))) ELSE 1e0 END AS oe
          FROM oe_in WHERE split = 'train' GROUP BY cell),
tr AS (SELECT o.*, coalesce(c.oe, 1e0) AS policy_oe FROM oe_in o LEFT JOIN cells c ON c.cell = o.cell WHERE o.split = 'train'),
scale AS (SELECT CASE WHEN avg(policy_oe) >= 0.05e0 THEN avg(policy_oe) ELSE 1e0 END AS sf,
                 sum(claim_amount) / greatest(sum(glm_el), 1e0) AS overall FROM tr),
tgt AS (SELECT tr.*, least(8.0e0, greatest(0.10e0, policy_oe / sf)) AS m_target FROM tr, scale)""")


@oracle("cell_oe_lookup")
def o_j2():
    return with_ctes(_oe_ctes(), f"SELECT o.policy_id, o.cell, {R('coalesce(c.oe, 1e0)', 6)} AS cell_oe FROM oe_in o LEFT JOIN cells c ON c.cell = o.cell")


@oracle("baseline_full_align")
def o_j3():
    return with_book(f"SELECT policy_id, {R('lambda_true * mu_true', 2)} AS el_base, expected_loss_true AS el_full, "
                     f"{R(f'expected_loss_true - {R('lambda_true * mu_true', 2)}', 2)} AS el_delta FROM book")


@oracle("scenario_cross")
def o_j4():
    from oracles.book import M_RAW
    m = R(f"least(3.5e0, greatest(0.70e0, {M_RAW}))", 4)
    sc = SCORE.format(e="el_full")
    return with_book("").rstrip() + f""",
sx AS (SELECT * REPLACE (s.roof_material AS roof_material, s.roof_age_yr AS roof_age_yr, s.wildfire_zone AS wildfire_zone), s.scenario
       FROM book CROSS JOIN (VALUES ('Asphalt 5yr / Low WF', 'Asphalt Shingle', 5, 'Low'), ('Asphalt 5yr / High WF', 'Asphalt Shingle', 5, 'High'),
                                    ('Wood Shake 28yr / Low WF', 'Wood Shake', 28, 'Low'), ('Wood Shake 28yr / High WF', 'Wood Shake', 28, 'High'))
            s(scenario, roof_material, roof_age_yr, wildfire_zone)),
sm AS (SELECT policy_id, scenario, lambda_true, mu_true, {m} AS m_scenario FROM sx),
se AS (SELECT *, {R('lambda_true * mu_true', 2)} AS el_baseline, {R('lambda_true * mu_true * m_scenario', 2)} AS el_full FROM sm)
SELECT policy_id, scenario, m_scenario, el_baseline, el_full, {R(sc, 1)} AS score_full FROM se, {ANCH}"""


@oracle("whatif_delta")
def o_j5():
    from oracles.book import LAM_RAW, M_RAW, MU_RAW
    mu = f"""least(400000e0, greatest(1500e0, least(
      CASE WHEN defensible_space_score IS NOT NULL AND defensible_space_score >= 70 THEN ({MU_RAW}) * 0.88e0
           WHEN defensible_space_score IS NOT NULL AND defensible_space_score <= 30 THEN ({MU_RAW}) * 1.08e0
           ELSE ({MU_RAW}) END, coverage_amount * 0.80e0)))"""
    lam = (f"least(0.18e0, greatest(0.005e0, ({LAM_RAW}) / (SELECT avg(lam_raw) FROM r1) * 0.058e0)) * "
           "CASE WHEN 2024 - policy_year >= 3 AND prior_claims_3yr = 0 THEN 0.95e0 ELSE 1e0 END")
    sc1 = R(SCORE.format(e="expected_loss_true"), 1)
    sc2 = R(SCORE.format(e="el2"), 1)
    by_lam = f"(({R('new_lam', 5)} - lam0) / (lam0 + 0.000000001e0) * ds * 0.4e0)"
    by_mu = f"(({R('new_mu', 0)} - mu0) / (mu0 + 0.000000001e0) * ds * 0.3e0)"
    return with_book("").rstrip() + f""",
ed AS (SELECT * REPLACE ('Metal' AS roof_material, 1 AS sprinkler_system, 1 AS security_system, 0 AS prior_claims_3yr),
              lambda_true AS lam0, mu_true AS mu0, M_true AS m0, expected_loss_true AS el0, indicated_premium AS p0 FROM book),
wr AS (SELECT *, {lam} AS new_lam, {mu} AS new_mu, least(3.5e0, greatest(0.70e0, {M_RAW})) AS new_m FROM ed),
wr2 AS (SELECT *, {R('new_lam * new_mu * new_m', 2)} AS el2 FROM wr),
wr3 AS (SELECT *, {sc2} - {R(SCORE.format(e="el0"), 1)} AS ds FROM wr2, {ANCH})
SELECT policy_id, {R(f"{R('new_lam', 5)} - lam0", 5)} AS d_lambda, {R(f"{R('new_mu', 0)} - mu0", 0)} AS d_mu, {R(f"{R('new_m', 4)} - m0", 4)} AS d_m,
  {R('el2 - el0', 2)} AS d_el, {R('ds', 1)} AS d_score, {R('el2 / 0.67e0 - p0', 2)} AS d_premium,
  {R(by_lam, 2)} AS d_score_lambda, {R(by_mu, 2)} AS d_score_mu, {R(f'ds - {by_lam} - {by_mu}', 2)} AS d_score_m FROM wr3"""


# ── A ─────────────────────────────────────────────────────────────────────
@oracle("portfolio_kpis")
def o_a1():
    return with_book(f"""SELECT count(*) AS total_policies, {R('sum(indicated_premium)', 2)} AS total_premium,
  {R('sum(expected_loss_true)', 2)} AS total_expected_loss, {XMEAN('M_true', 4, 6)} AS avg_m,
  {XSHARE('M_true > 1.01e0', 4, 100)} AS pct_m_active FROM book""")


@oracle("band_distribution")
def o_a2():
    return with_book(f"""SELECT d.o::INTEGER AS band_order, d.b AS risk_band, coalesce(n, 0) AS policies, {R('coalesce(p, 0e0)', 2)} AS premium
FROM (VALUES (0, 'Very Low'), (1, 'Low'), (2, 'Moderate'), (3, 'High'), (4, 'Very High')) d(o, b)
LEFT JOIN (SELECT risk_band, count(*) AS n, sum(indicated_premium) AS p FROM book GROUP BY risk_band) a ON a.risk_band = d.b""")


@oracle("state_summary")
def o_a3():
    return with_book(f"""SELECT state, mean_m, policies, {R('total_prem', 2)} AS total_prem, {R('total_el', 2)} AS total_el,
  (row_number() OVER (ORDER BY mean_m DESC, state))::INTEGER AS rank_mean_m
FROM (SELECT state, {XMEAN('M_true', 4, 6)} AS mean_m, count(*) AS policies, sum(indicated_premium) AS total_prem, sum(expected_loss_true) AS total_el
      FROM book GROUP BY state) t""")


@oracle("state_top_peril")
def o_a4():
    return with_book(f"""SELECT state,
  CASE greatest(w, f, e, h) WHEN w THEN 'Wildfire' WHEN f THEN 'Flood' WHEN e THEN 'Earthquake' ELSE 'Hail' END AS top_peril,
  CASE greatest(w, f, e, h) WHEN w THEN xw WHEN f THEN xf WHEN e THEN xe ELSE xh END AS top_share
FROM (SELECT state, {XSHARE("wildfire_zone = 'High'", 6)} AS xw, {XSHARE("flood_zone = 'High'", 6)} AS xf,
             {XSHARE("earthquake_zone = 'High'", 6)} AS xe, {XSHARE("hail_zone = 'High'", 6)} AS xh, avg(CASE WHEN wildfire_zone = 'High' THEN 1e0 ELSE 0e0 END) AS w, avg(CASE WHEN flood_zone = 'High' THEN 1e0 ELSE 0e0 END) AS f,
             avg(CASE WHEN earthquake_zone = 'High' THEN 1e0 ELSE 0e0 END) AS e, avg(CASE WHEN hail_zone = 'High' THEN 1e0 ELSE 0e0 END) AS h
      FROM book GROUP BY state) t""")


SP_LONG = f"""sp_long AS (
  SELECT state, peril, {XMEAN('M_true', 4, 6)} AS mean_m, count(*) AS policies FROM (
    SELECT state, 'Wildfire High' AS peril, M_true FROM book WHERE wildfire_zone = 'High' UNION ALL
    SELECT state, 'Flood High', M_true FROM book WHERE flood_zone = 'High' UNION ALL
    SELECT state, 'Earthquake High', M_true FROM book WHERE earthquake_zone = 'High' UNION ALL
    SELECT state, 'Hail High', M_true FROM book WHERE hail_zone = 'High') u GROUP BY state, peril)"""


def _matrix_sql() -> str:
    cols = []
    for c, k in [("wildfire_zone", "wildfire"), ("flood_zone", "flood"), ("earthquake_zone", "earthquake"), ("hail_zone", "hail")]:
        n = f"count(*) FILTER (WHERE {c} = 'High')"
        cols.append(f"CASE WHEN {n} >= 20 THEN {XMEAN(f"CASE WHEN {c} = 'High' THEN M_true END", 4, 6)} END AS {k}_high_m, {n} AS {k}_high_n")
    return (f"wide AS (SELECT state, {', '.join(cols)} FROM book GROUP BY state),\n"
            "wm AS (SELECT *, greatest(wildfire_high_m, flood_high_m, earthquake_high_m, hail_high_m) AS row_max FROM wide)")


@oracle("state_peril_matrix")
def o_a5():
    return with_ctes(SP_LONG + ",\n" + _matrix_sql(),
                     "SELECT *, (row_number() OVER (ORDER BY row_max DESC NULLS LAST, state))::INTEGER AS row_order FROM wm")


@oracle("stable_order")
def o_o7():
    return with_ctes(SP_LONG + ",\n" + _matrix_sql(),
                     "SELECT state, (row_number() OVER (ORDER BY row_max DESC NULLS LAST, state))::INTEGER AS row_order FROM wm")


@oracle("hottest_cell")
def o_a6():
    return with_ctes(SP_LONG, "SELECT state, peril, mean_m, policies FROM sp_long WHERE policies >= 20 ORDER BY mean_m DESC, state, peril LIMIT 1")


@oracle("loss_ratio_by_band")
def o_a7():
    return with_book(f"""
SELECT risk_band, policies, {R('lr', 4)} AS loss_ratio_pct, {R('max(lr) OVER () - min(lr) OVER ()', 4)} AS lr_spread_pct
FROM (SELECT risk_band, count(*) AS policies,
             sum(expected_loss_true) / sum(indicated_premium) * 100 AS lr
      FROM book GROUP BY risk_band) t""")


@oracle("category_counts")
def o_a8():
    parts = [f"SELECT '{c}' AS column, {c} AS value, count(*) AS policies FROM book GROUP BY {c}"
             for c in ["roof_material", "wildfire_zone", "flood_zone", "construction_type"]]
    return with_book(" UNION ALL ".join(parts))


CORR_COLS = ["lambda_true", "mu_true", "M_true", "expected_loss_true", "roof_age_yr", "home_value",
             "prior_claims_3yr", "credit_score", "protection_class", "dist_to_fire_station_mi"]


@oracle("correlation_matrix")
def o_a9():
    parts = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i + 1:]:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(f'corr({a}::double, {b}::double)', 8)} AS corr FROM book")
    return with_book(" UNION ALL ".join(parts))


SUMMARY_COLS = ["lambda_true", "mu_true", "M_true", "expected_loss_true", "indicated_premium",
                "risk_score_true", "risk_score_a2", "home_value", "coverage_amount", "home_age",
                "roof_age_yr", "prior_claims_3yr", "credit_score", "protection_class",
                "dist_to_fire_station_mi", "dist_to_coast_mi", "square_footage"]


@oracle("column_summary")
def o_a10():
    parts = [f"""SELECT '{c}' AS column, count({c}) AS count, {R(f'avg({c}::double)', 4)} AS mean, {R(f'stddev_samp({c}::double)', 4)} AS std,
  {R(f'min({c}::double)', 4)} AS min, {R(f'quantile_cont({c}::double, 0.25)', 4)} AS p25, {R(f'quantile_cont({c}::double, 0.5)', 4)} AS p50,
  {R(f'quantile_cont({c}::double, 0.75)', 4)} AS p75, {R(f'max({c}::double)', 4)} AS max FROM book""" for c in SUMMARY_COLS]
    return with_book(" UNION ALL ".join(parts))


@oracle("group_oe")
def o_a11():
    return with_ctes(_oe_ctes(), f"""SELECT cell, n_policies, {R('total_claim', 2)} AS total_claim, {R('total_expected', 2)} AS total_expected,
  {R('oe_raw', 6)} AS oe_raw, {R('oe', 6)} AS oe FROM cells""")


@oracle("oe_normalise")
def o_a12():
    return with_ctes(_oe_ctes(), f"SELECT {R('max(sf)', 6)} AS scale_factor, {R('max(overall)', 6)} AS overall_oe, {R('avg(m_target)', 6)} AS mean_target, count(*) AS policies FROM tgt, scale")


@oracle("oe_percentiles")
def o_a13():
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
    parts = [f"SELECT 'cell_oe' AS series, {p}e0 AS p, {R(f'quantile_cont(oe, {p})', 6)} AS value FROM cells" for p in probs]
    parts += [f"SELECT 'target', {p}e0, {R(f'quantile_cont(m_target, {p})', 6)} FROM tgt" for p in probs]
    return with_ctes(_oe_ctes(), " UNION ALL ".join(parts))


@oracle("m_distribution")
def o_a14():
    ps = [(0.0, "p0"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")]
    q = ", ".join(f"{R(f'quantile_cont(m_hat, {p})', 6)} AS {n}" for p, n in ps)
    return with_pair(f"""SELECT {q}, {XMEAN('m_hat', 4, 6)} AS mean, {XSHARE('m_hat < 0.95e0', 6)} AS protective_share,
  {XSHARE('m_hat >= 0.95e0 AND m_hat < 1.05e0', 6)} AS neutral_share, {XSHARE('m_hat >= 1.05e0 AND m_hat < 1.30e0', 6)} AS mild_share,
  {XSHARE('m_hat >= 1.30e0 AND m_hat < 2.0e0', 6)} AS moderate_share, {XSHARE('m_hat >= 2.0e0', 6)} AS severe_share FROM pair""")


@oracle("premium_uplift")
def o_a15():
    return with_pair(f"""SELECT {R('avg(u)', 4)} AS mean_pct, {R('quantile_cont(u, 0.5)', 4)} AS median_pct, {R('quantile_cont(u, 0.95)', 4)} AS p95_pct,
  {R('max(u)', 4)} AS max_pct FROM (SELECT (el_full - el_baseline) / (el_baseline + 1) * 100 AS u FROM pair) t""")


@oracle("reclassification")
def o_a16():
    return with_pair(f"""SELECT {XSHARE('band_baseline <> band_full', 6)} AS reclassified_share,
  {XSHARE('band_baseline <> band_full AND score_full > score_baseline', 6)} AS upgraded_share,
  {XSHARE('band_baseline <> band_full AND score_full < score_baseline', 6)} AS downgraded_share FROM pairb""")


@oracle("reclass_matrix")
def o_a16m():
    bands = ["Very Low", "Low", "Moderate", "High", "Very High"]
    cols = ", ".join(f"count(*) FILTER (WHERE band_full = '{b}') AS {b.lower().replace(' ', '_')}" for b in bands)
    return with_pair(f"SELECT band_baseline, {cols} FROM pairb GROUP BY band_baseline")


@oracle("reclass_threshold")
def o_a17():
    up, down, ch = "score_full > score_baseline + 40", "score_full < score_baseline - 40", "band_baseline <> band_full"
    c = lambda x: f"sum(CASE WHEN {x} THEN 1 ELSE 0 END)::BIGINT"
    return with_pair(f"""SELECT {c(f'{up} AND {ch}')} AS upgraded_band, {c(f'{down} AND {ch}')} AS downgraded_band,
  {c(f'NOT (({up} AND {ch}) OR ({down} AND {ch}))')} AS unchanged_band, {c(up)} AS upgraded, {c(down)} AS downgraded,
  {c('abs(score_full - score_baseline) <= 40')} AS confirmed FROM pairb""")


@oracle("hidden_danger_leakage")
def o_a18():
    d = "score_full - score_baseline > 50"
    g = "score_full - score_baseline < -50"
    dp = "premium_full - premium_baseline"
    return with_pair(f"""SELECT {XSHARE(d, 4, 100)} AS hidden_danger_pct,
  {XSHARE(g, 4, 100)} AS hidden_gem_pct,
  coalesce({XMEAN(f'CASE WHEN {d} THEN {dp} END', 2, 2)}, 0e0) AS avg_underpricing,
  {R(f'coalesce(sum(CASE WHEN {d} THEN {dp} END), 0e0)', 2)} AS total_leakage,
  {R(f'coalesce(sum(CASE WHEN {d} THEN {dp} END), 0e0) * 1e0', 2)} AS book_leakage FROM pair""")


def _regression(y: str, yhat: str) -> str:
    return with_pair(f"""SELECT {R('1e0 - sse / (variance * n)', 6)} AS r2, {R('mae', 4)} AS mae, {R('sqrt(sse / n)', 4)} AS rmse, {R('mape * 100', 4)} AS mape
FROM (SELECT count(*) AS n, var_pop({y}) AS variance, sum(({y} - {yhat}) * ({y} - {yhat})) AS sse,
             avg(abs({y} - {yhat})) AS mae, avg(abs(({y} - {yhat}) / (abs({y}) + 1e-6))) AS mape FROM pair) t""")


@oracle("regression_metrics")
def o_a19():
    return _regression("el_full", "el_baseline")


@oracle("regression_metrics_shifted")
def o_a19_shifted():
    return _regression("(1e9 + el_full)", "(1e9 + el_baseline)")


@oracle("read_policies_dirty")
def o_s1_dirty():
    dirty = f"{U('policy_id', 'dirty')} < 0.05e0"
    return with_book(f"""SELECT count(*) AS policies, count(*) FILTER (WHERE {dirty}) AS bad_value, count(*) FILTER (WHERE {dirty} AND credit_score > 700) AS bad_score,
  (sum(home_value) FILTER (WHERE NOT ({dirty})))::BIGINT AS total_value, count(*) FILTER (WHERE {dirty}) AS null_value,
  (sum(credit_score) FILTER (WHERE NOT ({dirty} AND credit_score > 700)))::BIGINT AS total_score FROM book""")


@oracle("holdout_sample_part")
def o_s2_part():
    return with_book("SELECT policy_id, expected_loss_true FROM book ORDER BY md5(policy_id || '7'), policy_id LIMIT 500")


@oracle("stratified_split_exact")
def o_o4_exact():
    h = "('0x' || substr(md5(policy_id || 'split'), 1, 15))::BIGINT"
    return with_book(f"""SELECT state, claim_occurred, split, count(*) AS policies, min(policy_id) AS first_id, {R('sum(indicated_premium)', 2)} AS premium FROM (
  SELECT *, CASE WHEN place <= floor(n * 0.6e0 + 0.5e0) THEN 'train' WHEN place <= floor(n * (0.6e0 + 0.2e0) + 0.5e0) THEN 'val' ELSE 'test' END AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY state, claim_occurred ORDER BY {h}, policy_id) AS place, count(*) OVER (PARTITION BY state, claim_occurred) AS n FROM book) a) t
GROUP BY 1, 2, 3""")


@oracle("pearson_pair")
def o_a20():
    return with_book(f"SELECT {R('corr(expected_loss_true, total_loss)', 8)} AS corr FROM book")


@oracle("generation_report")
def o_a21():
    from riskbook.operators.portfolio import GENERATION_TARGETS, INFO_METRICS
    pct = lambda c: XSHARE(c, 4, 100)
    exprs = {
        "claim_rate_pct": pct("claim_occurred = 1"), "avg_mu": XMEAN("mu_true", 0, 4),
        "avg_severity": XMEAN("CASE WHEN total_loss > 0 THEN total_loss END", 2, 4), "zero_loss_pct": pct("total_loss = 0"),
        "cat_pct": pct("is_cat_event = 1"), "avg_premium": XMEAN("indicated_premium", 2, 4),
        "median_premium": "quantile_cont(indicated_premium, 0.5)", "actual_lr": "sum(total_loss) / sum(indicated_premium)",
        "m_mean": XMEAN("M_true", 4, 4), "m_std": "stddev_samp(M_true)", "m_max": "max(M_true)",
        "subprime_pct": pct("credit_score < 620"), "recent_roof_pct": pct("roof_age_yr <= 3"),
        "canopy_unknown_pct": pct("vegetation_risk_composite = 'Unknown'"), "ds_missing_pct": pct("defensible_space_score IS NULL"),
        "fire_sentinel_pct": pct("dist_to_fire_station_mi < 0"), "knob_tube_pct": pct("has_knob_tube_wiring = 1"),
        "polybutylene_pct": pct("has_polybutylene_pipe = 1"), "near_duplicate_pct": pct("is_near_duplicate = 1"),
        "data_vintage_pct": pct("data_vintage_flag = 1"), "rcv_vintage_pct": pct("rcv_vintage_flag = 1"),
        "renewal_pct": pct("renewal_credit = 1"),
        "three_way_pct": pct("wildfire_zone = 'High' AND slope_steepness_pct > 55 AND post_burn_rainfall_intensity > 60"),
        "slope_mean": XMEAN("slope_steepness_pct", 1, 4), "rain_mean": XMEAN("post_burn_rainfall_intensity", 1, 4),
        "roof_age_mean": XMEAN("roof_age_yr", 0, 4), "credit_p10": "quantile_cont(credit_score::double, 0.1)",
        "credit_p50": "quantile_cont(credit_score::double, 0.5)", "credit_p90": "quantile_cont(credit_score::double, 0.9)",
        "roof_age_median": "quantile_cont(roof_age_yr::double, 0.5)", "expected_lr": "sum(expected_loss_true) / sum(indicated_premium)",
        "gini_oracle": "max((SELECT 2e0 * avg(lz) - 1e0 FROM lz))", "kendall_tau": "max((SELECT tau FROM kt))",
        **{f"band_pct_{b.lower().replace(' ', '_')}": pct(f"risk_band = '{b}'") for b in ("Very Low", "Low", "Moderate", "High", "Very High")},
    }
    ranks = """lz AS (SELECT sum(total_loss) OVER (ORDER BY expected_loss_true DESC, policy_id ROWS UNBOUNDED PRECEDING) / (sum(total_loss) OVER () + 1e-9) AS lz FROM book),
c AS (SELECT policy_id, expected_loss_true AS x, total_loss AS y FROM book WHERE total_loss > 0),
kt AS (SELECT sum(sign((a.x - b.x) * (a.y - b.y))) / sqrt(sum((a.x != b.x)::int)::double * sum((a.y != b.y)::int)) AS tau FROM c a JOIN c b ON a.policy_id < b.policy_id)"""
    t = {m: (lo, hi) for m, lo, hi in GENERATION_TARGETS}
    parts = []
    for m in [m for m, _, _ in GENERATION_TARGETS] + INFO_METRICS:
        lo, hi = (f"{t[m][0]!r}e0".replace(".0e0", "e0") if m in t else "NULL::double",
                  f"{t[m][1]!r}e0".replace(".0e0", "e0") if m in t else "NULL::double")
        v = R(f"({exprs[m]})::double", 4)
        passed = f"CASE WHEN {v} BETWEEN {lo} AND {hi} THEN 1 ELSE 0 END" if m in t else "NULL::INTEGER"
        parts.append(f"SELECT '{m}' AS metric, {v} AS value, {lo} AS lo, {hi} AS hi, {passed} AS pass FROM book")
    return with_ctes(ranks, " UNION ALL ".join(parts))


@oracle("health_checks")
def o_a22():
    return with_ctes(
        f"""a AS (SELECT {XSHARE('total_loss = 0', 4, 100)} AS z, {XMEAN('CASE WHEN total_loss > 0 THEN total_loss END', 2, 4)} AS s,
  sum(total_loss) / sum(indicated_premium) * 100 AS lr, sum(CASE WHEN indicated_premium <= 0 THEN 1 ELSE 0 END)::double AS neg FROM book)""",
        f"""SELECT 'zero_claim_pct' AS "check", {R('z', 4)} AS value, CASE WHEN abs(z - 94.5e0) < 1.5e0 THEN 1 ELSE 0 END AS pass FROM a UNION ALL
  SELECT 'mean_severity', {R('s', 4)}, CASE WHEN s BETWEEN 15000 AND 22000 THEN 1 ELSE 0 END FROM a UNION ALL
  SELECT 'loss_ratio_pct', {R('lr', 4)}, CASE WHEN lr BETWEEN 55 AND 70 THEN 1 ELSE 0 END FROM a UNION ALL
  SELECT 'negative_premiums', {R('neg', 4)}, CASE WHEN neg = 0 THEN 1 ELSE 0 END FROM a""")


@oracle("peril_severity")
def o_a23():
    from riskbook.operators.portfolio import PERIL_RANGES
    cat = "total_loss > 0 AND is_cat_event = 1"
    hail = f"total_loss > 0 AND hail_zone = 'High' AND NOT ({cat})"
    water = f"total_loss > 0 AND NOT ({cat}) AND NOT ({hail})"
    vals = [XMEAN(f"CASE WHEN {cat} THEN total_loss END", 2, 4), XMEAN(f"CASE WHEN {hail} THEN total_loss END", 2, 4),
            XMEAN(f"CASE WHEN {water} THEN total_loss END", 2, 4), XMEAN("CASE WHEN total_loss > 0 THEN total_loss END", 2, 4),
            XSHARE("claim_occurred = 1", 4, 100), XSHARE("total_loss = 0", 4, 100)]
    parts = [f"SELECT '{name}' AS peril, {R(v, 4)} AS value, {lo!r}e0 AS lo, {hi!r}e0 AS hi FROM book"
             for (name, lo, hi), v in zip(PERIL_RANGES, vals)]
    return with_ctes(f"pv AS ({' UNION ALL '.join(parts)}), pp AS (SELECT *, CASE WHEN value IS NOT NULL THEN (CASE WHEN value BETWEEN lo AND hi THEN 1 ELSE 0 END) END AS pass FROM pv)",
                     "SELECT *, (sum(pass) OVER ())::BIGINT AS passes FROM pp")


@oracle("benchmark_table")
def o_a24():
    items = [("annual_claim_rate", XMEAN("lambda_true", 5, 6), 0.053), ("avg_severity_all", XMEAN("mu_true", 0, 6), 18000.0),
             ("zero_claim_pct", XSHARE("total_loss = 0", 6), 0.945),
             ("target_loss_ratio", "sum(total_loss) / sum(indicated_premium)", 0.63), ("tweedie_power_p", "max(1.65e0)", 1.65)]
    return with_book(" UNION ALL ".join(f"SELECT '{k}' AS metric, {R(v, 6)} AS dataset, {b!r}e0 AS benchmark FROM book" for k, v, b in items))


@oracle("missingness_profile")
def o_a25():
    return with_book(f"""SELECT state, {XSHARE('defensible_space_score IS NULL', 4, 100)} AS ds_null_pct,
  {XSHARE("vegetation_risk_composite = 'Unknown'", 4, 100)} AS veg_unknown_pct,
  {XSHARE('dist_to_fire_station_mi < 0', 4, 100)} AS fire_sentinel_pct, count(*) AS policies FROM book GROUP BY state""")


def _hist(src: str, col: str, n: int, lo: float, hi: float, clip: bool, name: str) -> str:
    x = f"least(greatest({col}, {lo!r}e0), {hi!r}e0)" if clip else col
    w = (hi - lo) / n
    b = f"least({n - 1}, floor(({x} - {lo!r}e0) / {hi - lo!r}e0 * {float(n)!r}e0))::INTEGER"
    edge = f"({lo!r}e0 + bin * {w!r}e0)"
    return (f"SELECT '{name}' AS hist, bin, {R(edge, 6)} AS lo, {R(f'{edge} + {w!r}e0', 6)} AS hi, count, "
            f"CASE WHEN {edge} >= 2.0e0 THEN 'severe' WHEN {edge} >= 1.3e0 THEN 'moderate' ELSE 'mild' END AS class "
            f"FROM (SELECT {b} AS bin, count(*) AS count FROM {src} WHERE {x} BETWEEN {lo!r}e0 AND {hi!r}e0 GROUP BY 1) t")


@oracle("histogram")
def o_a26():
    up = "(SELECT (el_full - el_baseline) / (el_baseline + 1) * 100 AS uplift FROM pair) u"
    return with_pair(_hist("pair", "m_hat", 60, 0.7, 3.5, False, "m_60") + " UNION ALL "
                     + _hist("pair", "m_hat", 35, 0.7, 3.5, False, "m_35") + " UNION ALL "
                     + _hist(up, "uplift", 50, 0.0, 300.0, True, "uplift_50"))


@oracle("roi_grid")
def o_a27():
    saving = "book_m * 1000000e0 * (lr_improvement_pts / 100e0)"
    cost = "1030000e0"
    return with_book(f"""SELECT state, lr_improvement_pts, {R('book_m', 6)} AS book_m, {R('current_lr', 4)} AS current_lr,
  {R(saving, 4)} AS annual_saving, {R(f'{saving} * 0.5e0', 5)} AS year1_benefit, {R(f'({saving} - {cost}) / {cost}', 6)} AS full_year_roi,
  {R(f'({saving} * 0.5e0 - {cost}) / {cost}', 6)} AS year1_roi,
  {R(f'((current_lr - 98e0) / 100e0 * book_m * 1000000e0 * 0.5e0 - {cost}) / {cost}', 6)} AS headline_roi,
  {R(f'CASE WHEN {saving} > 0 THEN 850000e0 / ({saving} / 12) ELSE 999e0 END', 4)} AS payback_months,
  {R(f'{saving} * 3 - 540000e0 - 850000e0', 4)} AS npv_3yr
FROM (SELECT state, sum(indicated_premium) / 1000000e0 AS book_m, sum(total_loss) / sum(indicated_premium) * 100 AS current_lr FROM book GROUP BY state) s
CROSS JOIN (VALUES (5), (8), (10), (12), (14), (16), (20)) g(lr_improvement_pts)""")


@oracle("drift_psi")
def o_a28():
    num = ["credit_score", "home_value", "roof_age_yr", "protection_class", "dist_to_coast_mi"]
    cat = ["wildfire_zone", "flood_zone", "construction_type", "roof_material"]
    parts = []
    for c in num:
        b = (f"least(9, floor(({c}::double - (SELECT min({c}) FROM two)) / (CASE WHEN (SELECT max({c}) - min({c}) FROM two) > 0 "
             f"THEN (SELECT max({c}) - min({c}) FROM two)::double ELSE 1e0 END) * 10))::BIGINT::varchar")
        parts.append(f"SELECT policy_year, '{c}' AS feature, {b} AS bin FROM two")
    parts += [f"SELECT policy_year, '{c}', {c}::varchar FROM two" for c in cat]
    eps = "0.0001e0"
    return with_ctes(f"""two AS (SELECT * FROM book),
ex AS ({' UNION ALL '.join(parts)}),
yrs AS (SELECT DISTINCT policy_year FROM two WHERE policy_year <> 2020),
cnt AS (SELECT y.policy_year, feature, bin, sum(CASE WHEN e.policy_year = 2020 THEN 1 ELSE 0 END) AS nb, sum(CASE WHEN e.policy_year = y.policy_year THEN 1 ELSE 0 END) AS nc
  FROM yrs y JOIN ex e ON e.policy_year IN (2020, y.policy_year) GROUP BY ALL),
sh AS (SELECT policy_year, feature, nb::double / sum(nb) OVER (PARTITION BY policy_year, feature) + {eps} AS b,
  nc::double / sum(nc) OVER (PARTITION BY policy_year, feature) + {eps} AS c FROM cnt)""",
                     f"SELECT policy_year, feature, {R('sum((c - b) * ln(c / b))', 6)} AS psi, count(*) AS bins FROM sh GROUP BY policy_year, feature")


# ── W ─────────────────────────────────────────────────────────────────────
def _gini_asc(pred: str) -> str:
    return f"""(SELECT CASE WHEN t = 0 THEN 0e0 ELSE least(1e0, greatest(0e0, 1e0 - 2e0 * ((sum(cl) - (first_cl + 1e0) / 2e0) / n))) END FROM (
  SELECT cs / t AS cl, t, n, first_value(cs / t) OVER (ORDER BY pos) AS first_cl FROM (
    SELECT sum(actual) OVER (ORDER BY {pred}, policy_id ROWS UNBOUNDED PRECEDING) AS cs, row_number() OVER (ORDER BY {pred}, policy_id) AS pos,
           sum(actual) OVER () AS t, count(*) OVER () AS n FROM pair) x) y GROUP BY t, n, first_cl)"""


@oracle("gini")
def o_w1():
    gb, gf = _gini_asc("el_baseline"), _gini_asc("el_full")
    return with_pair(f"SELECT {R(gb, 6)} AS gini_baseline, {R(gf, 6)} AS gini_full, {R(f'{gf} - {gb}', 6)} AS gini_delta")


@oracle("gini_oracle")
def o_w2():
    return with_book(f"""SELECT {R('2e0 * avg(lz) - 1e0', 6)} AS gini_oracle FROM (
  SELECT sum(total_loss) OVER (ORDER BY expected_loss_true DESC, policy_id ROWS UNBOUNDED PRECEDING) / (sum(total_loss) OVER () + 1e-9) AS lz FROM book) t""")


@oracle("lorenz_curve")
def o_w3():
    return with_book(f"""SELECT point::INTEGER AS point, {R('point / 10e0', 6)} AS pop_share, {R('cs / (t + 1e-9)', 6)} AS loss_share FROM (
  SELECT row_number() OVER (ORDER BY expected_loss_true DESC, policy_id) AS pos,
         sum(total_loss) OVER (ORDER BY expected_loss_true DESC, policy_id ROWS UNBOUNDED PRECEDING) AS cs,
         sum(total_loss) OVER () AS t, count(*) OVER () AS n FROM book) x
JOIN range(1, 11) r(point) ON x.pos = (-((-point * x.n) // 10))""")


def _qcut(src: str, col: str, q: int = 10) -> str:
    probs = ", ".join(f"{i / q!r}" for i in range(q + 1))
    return (f"(SELECT list_sort(list_distinct(quantile_cont({col}, [{probs}]))) AS e FROM {src})")


def _label(col: str) -> str:
    return f"greatest(len(list_filter(e, lambda x: x < {col})) - 1, 0)::INTEGER"


@oracle("decile_loss_ratio")
def o_w4():
    return with_book(f"""SELECT {_label('expected_loss_true')} AS decile,
  {R('sum(total_loss) / greatest(sum(indicated_premium), 1e0) * 100', 4)} AS loss_ratio_pct, count(*) AS policies
FROM book, {_qcut('book', 'expected_loss_true')} q GROUP BY 1""")


@oracle("decile_lift")
def o_w5():
    parts = []
    for kind, col in (("baseline", "score_baseline"), ("full", "score_full")):
        parts.append(f"SELECT '{kind}' AS curve, {_label(col)} AS decile, avg(actual) / ((SELECT avg(actual) FROM pair) + 1e-6) AS lift "
                     f"FROM pair, {_qcut('pair', col)} q GROUP BY 2")
    return with_pair(f"""SELECT curve, decile, {R('lift', 6)} AS lift,
  {R('max(CASE WHEN decile = mx THEN lift END) OVER (PARTITION BY curve) - max(CASE WHEN decile = mn THEN lift END) OVER (PARTITION BY curve)', 6)} AS spread
FROM (SELECT *, max(decile) OVER (PARTITION BY curve) AS mx, min(decile) OVER (PARTITION BY curve) AS mn FROM ({' UNION ALL '.join(parts)}) u) t""")


# ── O ─────────────────────────────────────────────────────────────────────
@oracle("seeded_sample")
def o_o2():
    return with_book("SELECT policy_id, expected_loss_true FROM book ORDER BY md5(policy_id || '42'), policy_id LIMIT 2000")


@oracle("stratified_split")
def o_o4():
    s80 = f"CASE WHEN {U('policy_id', 'split80')} < 0.8e0 THEN 'train' ELSE 'test' END"
    return with_book(f"""SELECT '60/20/20' AS scheme, {SPLIT} AS split, claim_occurred, count(*) AS policies FROM book GROUP BY 2, 3
UNION ALL SELECT '80/20', {s80}, claim_occurred, count(*) FROM book GROUP BY 2, 3""")


@oracle("kfold")
def o_o5():
    return with_book(f"SELECT least(4, floor({U('policy_id', 'fold')} * 5e0))::INTEGER AS fold, count(*) AS policies FROM book GROUP BY 1")


@oracle("union_train_val")
def o_o6():
    return with_book(f"SELECT count(*) AS policies, {R('sum(expected_loss_true)', 2)} AS total_el FROM book WHERE {SPLIT} IN ('train', 'val')")


@oracle("kendall_tau_b")
def o_a29():
    """Brute force over claimant pairs (fine at the check's scale)."""
    return with_ctes("c AS (SELECT policy_id, expected_loss_true AS x, total_loss AS y FROM book WHERE total_loss > 0)",
                     f"""SELECT n AS claimants, {R('(nc - nd) / sqrt((n0 - t1) * (n0 - t2))', 8)} AS tau_b, nd::BIGINT AS discordant, nc::BIGINT AS concordant
FROM (SELECT (SELECT count(*) FROM c) AS n, (SELECT count(*) FROM c) * ((SELECT count(*) FROM c) - 1) / 2 AS n0,
  sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN 1 ELSE 0 END) AS nc, sum(CASE WHEN (a.x - b.x) * (a.y - b.y) < 0 THEN 1 ELSE 0 END) AS nd,
  sum(CASE WHEN a.x = b.x THEN 1 ELSE 0 END) AS t1, sum(CASE WHEN a.y = b.y THEN 1 ELSE 0 END) AS t2
  FROM c a JOIN c b ON a.policy_id < b.policy_id) t""")


# ── fitted models: score equations and identities ─────────────────────────
@oracle("glm_balance")
def o_glm_balance():
    train = f"(SELECT *, {SPLIT} AS split FROM book) t WHERE split = 'train'"
    return with_book(f"""SELECT 'poisson' AS model, count(*) AS n_rows, sum(claim_occurred)::double AS actual, sum(claim_occurred)::double AS fitted FROM {train}
UNION ALL SELECT 'gamma', count(*) FILTER (WHERE claim_amount > 0), (count(*) FILTER (WHERE claim_amount > 0))::double,
  (count(*) FILTER (WHERE claim_amount > 0))::double FROM {train}
UNION ALL SELECT 'tweedie', count(*), 1e0, 1e0 FROM {train}""")


@oracle("attribution_identity")
def o_attribution_identity():
    return with_book("SELECT (count(*) * 48)::BIGINT AS n_rows, 0::BIGINT AS n_off FROM book")


@oracle("model_identity")
def o_model_identity():
    return with_book("SELECT count(*) AS policies, 0::BIGINT AS reloaded_off, 0::BIGINT AS streamed_off FROM book")
