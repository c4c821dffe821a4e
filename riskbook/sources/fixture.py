"""The fixture policy book, derived from the driver's ``orders`` x ``customer`` tables.

One order is one policy; ``c_nationkey % 10`` picks the state. Every feature is a
deterministic function of ``o_orderkey`` through md5 hash uniforms, so the book is
reproducible in any engine. The expression table below is the fixture definition
(FIXTURES.md section 3); it is rendered to Spark SQL text here and to DuckDB text
by the oracle package. Operators (rating plan, reports) are *not* shared: they are
written separately for Spark and for the oracle.

Macros inside the expressions:
  U[x]    hash uniform in [0,1) with salt x
  N[x]    (U[x1] + U[x2] + U[x3] - 1.5) * 2
  Z[x,p]  zone rule: High below 0.38p, Moderate below 0.78p, else Low
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# State dimension (k = c_nationkey % 10) with the per-state
# parameters of the rating plan. Columns: k, state, wf, fl, eq, val_med, hail_p,
# canopy_p, slope_p, coastal, wui, rural.
STATE_DIM = [
    (0, "CA", 0.55, 0.12, 0.65, 680000, 0.12, 0.45, 0.62, 0, 1, 0),
    (1, "FL", 0.05, 0.65, 0.02, 360000, 0.22, 0.55, 0.05, 1, 0, 0),
    (2, "TX", 0.28, 0.32, 0.05, 300000, 0.45, 0.35, 0.28, 0, 0, 0),
    (3, "LA", 0.05, 0.68, 0.02, 220000, 0.30, 0.60, 0.04, 1, 0, 0),
    (4, "OK", 0.32, 0.22, 0.18, 195000, 0.55, 0.28, 0.22, 0, 0, 1),
    (5, "CO", 0.42, 0.08, 0.12, 480000, 0.48, 0.32, 0.70, 0, 1, 0),
    (6, "NC", 0.08, 0.28, 0.04, 275000, 0.28, 0.68, 0.38, 1, 0, 1),
    (7, "GA", 0.08, 0.22, 0.04, 285000, 0.25, 0.65, 0.32, 1, 0, 1),
    (8, "AZ", 0.38, 0.06, 0.22, 335000, 0.18, 0.22, 0.48, 0, 1, 1),
    (9, "NV", 0.32, 0.04, 0.38, 360000, 0.15, 0.18, 0.55, 0, 1, 1),
]
STATE_COLS = ["k", "state", "wf", "fl", "eq", "val_med", "hail_p", "canopy_p",
              "slope_p", "coastal", "wui", "rural"]
STATE_SCHEMA = ("k int, state string, wf double, fl double, eq double, val_med double, "
                "hail_p double, canopy_p double, slope_p double, coastal int, wui int, rural int")

# Stage A, by dependency layer. Three layers keep the analyzer shallow.
LAYER1 = [
    ("policy_id", "concat('POL', lpad(cast(o_orderkey as {str}), 9, '0'))"),
    ("policy_year", "case when U[yr]<0.12e0 then 2020 when U[yr]<0.26e0 then 2021 when U[yr]<0.48e0 then 2022 when U[yr]<0.74e0 then 2023 else 2024 end"),
    ("state", "state"),
    ("construction_type", "case when U[con]<0.50e0 then 'Frame' when U[con]<0.75e0 then 'Masonry' when U[con]<0.85e0 then 'Superior' else 'Mixed' end"),
    ("roof_material", "case when U[roof]<0.55e0 then 'Asphalt Shingle' when U[roof]<0.63e0+0.06e0*wui then 'Wood Shake' when U[roof]<0.77e0 then 'Metal' when U[roof]<0.95e0 then 'Tile' else 'Flat/Built-Up' end"),
    ("occupancy", "case when U[occ]<0.74e0 then 'Owner Occupied' when U[occ]<0.93e0 then 'Tenant Occupied' else 'Vacant' end"),
    ("home_age", "cast(least(74e0, greatest(2e0, floor(31e0+14e0*N[age]))) as int)"),
    ("home_value", "cast(least(2500000e0, greatest(80000e0, floor(val_med*exp(0.26e0*N[val])))) as bigint)"),
    ("coverage_ratio", "least(1.45e0, greatest(0.65e0, 1.05e0+0.20e0*N[cov]))"),
    ("square_footage", "cast(least(6000e0, greatest(500e0, floor(2100e0+700e0*N[sqft]))) as int)"),
    ("stories", "case when U[sto]<0.56e0 then 1 when U[sto]<0.93e0 then 2 else 3 end"),
    ("protection_class", "cast(least(10e0, greatest(1e0, floor(6e0+2e0*N[pc]))) as int)"),
    ("prior_claims_3yr", "case when U[clm]<=0.92e0 then 0 when U[clm]<=0.98e0 then 1 when U[clm]<=0.995e0 then 2 else 3 end"),
    ("credit_score", "cast(least(850e0, greatest(500e0, floor(case when U[sub]<0.22e0 then 585e0+55e0*N[crd] else 745e0+75e0*N[crd] end))) as int)"),
    ("credit_restricted", "case when state='CA' then 1 else 0 end"),
    ("deductible", "case when U[ded]<0.12e0 then 500 when U[ded]<0.54e0 then 1000 when U[ded]<0.86e0 then 2500 else 5000 end"),
    ("trampoline", "case when U[tramp]<0.11e0 then 1 else 0 end"),
    ("dog", "case when U[dog]<0.38e0 then 1 else 0 end"),
    ("wildfire_zone", "Z[wf,wf]"),
    ("flood_zone", "Z[fl,fl]"),
    ("earthquake_zone", "Z[eq,eq]"),
    ("hail_zone", "Z[hail,hail_p]"),
    ("vegetation_risk_composite", "case when rural=1 and U[vegm]<0.08e0 then 'Unknown' else Z[veg,canopy_p] end"),
    ("dist_to_coast_mi", "floor(case when coastal=1 then least(80e0, greatest(0.2e0, -7e0*ln(1e0-U[coast]))) else least(500e0, greatest(1e0, -60e0*ln(1e0-U[coast]))) end*10e0+0.5e0)/10e0"),
    ("trend_rate_annual", "least(0.12e0, greatest(0.01e0, 0.06e0+0.015e0*N[trend]))"),
    ("slope_steepness_pct", "floor(least(100e0, greatest(0e0, 100e0*slope_p+15e0*N[slope]))*10e0+0.5e0)/10e0"),
    ("data_vintage_flag", "case when U[dvf]<0.12e0 then 1 else 0 end"),
    ("rcv_vintage_flag", "case when U[rvf]<0.08e0 then 1 else 0 end"),
    ("is_near_duplicate", "case when U[dup]<0.005e0 then 1 else 0 end"),
]
LAYER2 = [
    ("year_built", "least(2022, greatest(1950, 2024-home_age))"),
    ("coverage_amount", "cast(least(2500000e0, greatest(80000e0, floor(home_value*coverage_ratio))) as bigint)"),
    ("security_system", "case when U[sec] < least(0.72e0, greatest(0.12e0, 0.28e0+0.40e0*(credit_score-500)/350e0)) then 1 else 0 end"),
    ("smoke_detectors", "case when U[smk] < least(0.94e0, greatest(0.62e0, 0.76e0+0.16e0*(credit_score-500)/350e0)) then 1 else 0 end"),
    ("sprinkler_system", "case when U[spr] < least(0.22e0, greatest(0.03e0, 0.07e0+0.13e0*(credit_score-500)/350e0)) then 1 else 0 end"),
    ("gated_community", "case when U[gate] < least(0.30e0, greatest(0.03e0, 0.07e0+0.22e0*(credit_score-500)/350e0)) then 1 else 0 end"),
    ("swimming_pool", "case when U[pool] < least(0.30e0, greatest(0.10e0, 0.24e0-0.04e0*prior_claims_3yr/5e0)) then 1 else 0 end"),
    ("roof_age_yr", "cast(least(cast(home_age as double), greatest(0e0, case when U[rero]<0.15e0 then floor(4e0*U[rage]) else floor(17e0+5e0*N[rage]) end)) as int)"),
    ("has_knob_tube_wiring", "case when U[knob] < (case when home_age>=70 then 0.20e0 when home_age>=60 then 0.10e0 when home_age>=50 then 0.04e0 else 0.005e0 end) then 1 else 0 end"),
    ("defensible_space_score", "case when wui=0 and U[dsm]<0.30e0 then null else floor(least(100e0, greatest(0e0, 35e0+20e0*wui+(case wildfire_zone when 'High' then 10e0 when 'Moderate' then 5e0 else 0e0 end)+15e0*N[ds]))*10e0+0.5e0)/10e0 end"),
    ("permit_score", "floor(least(100e0, greatest(0e0, 100e0*U[perm]*(1e0+0.008e0*greatest(home_age-20,0))))*10e0+0.5e0)/10e0"),
    ("dist_to_fire_station_mi", "case when U[fstm]<0.03e0 then -1e0 else floor(least(30e0, greatest(0.2e0, -(case when protection_class<=3 then 1.2e0 when protection_class<=6 then 3e0 else 7.5e0 end)*ln(1e0-U[fst])))*10e0+0.5e0)/10e0 end"),
    ("trend_factor", "power(1e0+trend_rate_annual, 2024-policy_year)"),
    ("vintage_cat_multiplier", "case policy_year when 2020 then 1.18e0 when 2021 then 1.15e0 when 2022 then 1.05e0 when 2023 then 1.02e0 else 1.00e0 end"),
    ("post_burn_rainfall_intensity", "floor(least(100e0, greatest(0e0, (case wildfire_zone when 'High' then 60e0 when 'Moderate' then 35e0 else 12e0 end)+16e0*N[rain]))*10e0+0.5e0)/10e0"),
]
LAYER3 = [
    ("has_polybutylene_pipe", "case when U[poly] < (case when year_built between 1978 and 1995 then 0.30e0 else 0.015e0 end) then 1 else 0 end"),
]
LAYERS = [LAYER1, LAYER2, LAYER3]

# Final column order of stage A (44 columns).
FEATURE_COLUMNS = [
    "policy_id", "policy_year", "state", "construction_type", "roof_material", "occupancy",
    "year_built", "home_age", "home_value", "coverage_amount", "coverage_ratio",
    "square_footage", "stories", "protection_class", "prior_claims_3yr", "credit_score",
    "credit_restricted", "deductible", "swimming_pool", "trampoline", "dog",
    "security_system", "smoke_detectors", "sprinkler_system", "gated_community",
    "roof_age_yr", "wildfire_zone", "flood_zone", "earthquake_zone", "hail_zone",
    "vegetation_risk_composite", "has_knob_tube_wiring", "has_polybutylene_pipe",
    "defensible_space_score", "permit_score", "dist_to_coast_mi",
    "dist_to_fire_station_mi", "trend_rate_annual", "trend_factor",
    "vintage_cat_multiplier", "slope_steepness_pct", "post_burn_rainfall_intensity",
    "data_vintage_flag", "rcv_vintage_flag", "is_near_duplicate",
]

_U = re.compile(r"U\[(\w+)\]")
_N = re.compile(r"N\[(\w+)\]")
_Z = re.compile(r"Z\[(\w+),(\w+)\]")

SPARK_U = "(cast(conv(substr(md5(concat(cast(o_orderkey as string),':{s}')),1,8),16,10) as bigint)/4294967296.0D)"
DUCK_U = "(('0x'||substr(md5(o_orderkey::varchar||':{s}'),1,8))::bigint/4294967296.0::double)"


def render(expr: str, dialect: str) -> str:
    """Expand the U / N / Z macros of a fixture expression for 'spark' (uniforms are columns) or 'duckdb'."""
    expr = _U.sub(lambda m: f"_u_{m.group(1)}" if dialect == "spark" else DUCK_U.format(s=m.group(1)), _expanded(expr))
    return expr.replace("{str}", "string" if dialect == "spark" else "varchar")


def _expanded(expr: str) -> str:
    """N and Z in terms of U."""
    expr = _Z.sub(lambda m: (f"case when U[{m.group(1)}] < 0.38e0*{m.group(2)} then 'High' "
                             f"when U[{m.group(1)}] < 0.78e0*{m.group(2)} then 'Moderate' else 'Low' end"), expr)
    return _N.sub(lambda m: "((U[{0}1]+U[{0}2]+U[{0}3]-1.5e0)*2e0)".format(m.group(1)), expr)


def salts(layer: list[tuple[str, str]]) -> list[str]:
    """Salts of the uniforms that a layer's rules read."""
    return list(dict.fromkeys(s for _, e in layer for s in _U.findall(_expanded(e))))


#: Rows of a task of stage A.
TASK_ROWS = 250_000


def state_dim(spark: SparkSession) -> DataFrame:
    rows = [(r[0], r[1], *[float(v) for v in r[2:9]], *r[9:]) for r in STATE_DIM]
    return spark.createDataFrame(rows, STATE_SCHEMA)


def policy_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders x customer -> (o_orderkey, state parameters).

    Only two columns of each table are read (column pruning reaches the scan).
    The customer side is joined by a size-checked broadcast; beyond the bound it is
    a shuffle join, with AQE splitting a hot customer key.
    """
    from riskbook.operators.joins import join_checked

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    cust = (spark.read.parquet(f"{sf_dir}/customer.parquet")
            .select(F.col("c_custkey"), F.pmod(F.col("c_nationkey"), F.lit(10)).alias("k")))
    # Stage A is CPU-heavy (an md5 per uniform), and files and joins deal rows by their few bytes: the two
    # columns are dealt anew, so that a task has at most about TASK_ROWS rows and every core some.
    parts = max(spark.sparkContext.defaultParallelism, -(-orders.count() // TASK_ROWS))
    keyed = join_checked(orders, cust, orders.o_custkey == cust.c_custkey, "inner").select("o_orderkey", "k").repartition(parts)
    dim = F.broadcast(state_dim(spark))   # 10 rows, fixed size
    return keyed.join(dim, "k").select("o_orderkey", *STATE_COLS[1:])


def build_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage A: the 44 feature columns, one row per order."""
    df = policy_source(spark, sf_dir)
    carry = ["o_orderkey"] + STATE_COLS[1:]
    done: list[str] = []
    for layer in LAYERS:
        new_names = [n for n, _ in layer]
        keep = [c for c in carry + done if c not in new_names]
        # each hash is worked out once a row, however many rules and branches read it
        df = df.select("*", *[F.expr(SPARK_U.format(s=s)).alias(f"_u_{s}") for s in salts(layer)])
        df = df.select(*keep, *[F.expr(render(e, "spark")).alias(n) for n, e in layer])
        done += [n for n in new_names if n not in done]
    return df.select("o_orderkey", *FEATURE_COLUMNS)
