"""Feature projections and fitted encoders.

Fitted state (encoder codes, imputation means, scaler moments) is a handful of
numbers per column: it is computed by one partial aggregate on the fitting split,
collected (bounded by column cardinality) and applied as literal maps / constants,
so applying it needs no join and no shuffle.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskbook.functions.columns import clip, lit_d, rnd

# Feature lists of the models (fixed values).
T12 = [
    "construction_type", "home_age", "home_value", "coverage_amount", "coverage_ratio",
    "square_footage", "stories", "protection_class", "occupancy",
    "prior_claims_3yr", "credit_score", "credit_restricted", "deductible",
    "swimming_pool", "trampoline", "dog",
    "security_system", "smoke_detectors", "sprinkler_system", "gated_community",
    "has_knob_tube_wiring", "has_polybutylene_pipe",
    "permit_score", "dist_to_fire_station_mi",
]
T3 = [
    "wildfire_zone", "flood_zone", "earthquake_zone", "roof_material",
    "hail_zone", "vegetation_risk_composite",
    "defensible_space_score",
    "dist_to_coast_mi", "dist_to_fire_station_mi",
    "roof_age_yr", "construction_type", "state",
    "slope_steepness_pct", "post_burn_rainfall_intensity",
]
SEV_FEATS = list(dict.fromkeys(T12 + T3))
CAT_COLS = ["construction_type", "occupancy", "wildfire_zone", "flood_zone", "earthquake_zone",
            "roof_material", "state", "hail_zone", "vegetation_risk_composite"]
NULLABLE_FLOATS = ["defensible_space_score"]

# Restricted-credit state sets (fixed values): in the data, at inference, in the form.
CREDIT_STATES = {"data": ["CA"], "inference": ["CA", "MA", "HI", "MD", "MI"], "form": ["CA", "MA", "HI"]}
FORM_NEUTRAL_CREDIT = 720


def with_age(df: DataFrame, ref_year: int = 2024, submission_year: int = 2026) -> DataFrame:
    """year_built = clip(ref - home_age, 1950, 2022); submission home_age = 2026 - year_built."""
    return df.select("*",
                     F.least(F.lit(2022), F.greatest(F.lit(1950), F.lit(ref_year) - F.col("home_age"))).alias("year_built_calc"),
                     (F.lit(submission_year) - F.col("year_built")).alias("home_age_submission"))


def coverage_ratio(mode: str = "batch") -> Column:
    """Single-row: round(cov/value, 3), 1.0 if value <= 0; batch: cov/max(value,1) in [0.5, 2]."""
    hv = F.col("home_value").cast("double")
    cv = F.col("coverage_amount").cast("double")
    if mode == "single":
        return F.when(hv > 0, rnd(cv / hv, 3)).otherwise(lit_d(1.0))
    return clip(cv / F.greatest(hv, lit_d(1.0)), 0.5, 2.0)


def credit_flag(states: str = "inference") -> Column:
    """1 when the state restricts credit scoring."""
    return F.col("state").isin(CREDIT_STATES[states]).cast("int")


def form_credit_score() -> Column:
    """P3 (form): credit score forced to the neutral 720 in restricted form states."""
    return F.when(credit_flag("form") == 1, F.lit(FORM_NEUTRAL_CREDIT)).otherwise(F.col("credit_score"))


def trend_factor(ref_year: int = 2024) -> Column:
    """(1 + annual rate)^(ref - policy_year), 4 decimals."""
    return rnd(F.pow(lit_d(1.0) + F.col("trend_rate_annual"), (F.lit(ref_year) - F.col("policy_year")).cast("double")), 4)


def with_vintage(df: DataFrame) -> DataFrame:
    """P5: policy_year -> CAT multiplier by a broadcast join of the 5-row vintage dimension."""
    from riskbook.plans.rating import VINTAGE_CAT_M
    dim = df.sparkSession.createDataFrame([(k, float(v)) for k, v in VINTAGE_CAT_M.items()],
                                          "policy_year int, vintage_mult double")
    return df.join(F.broadcast(dim), "policy_year", "left")


def permit_adjusted(raw: str = "permit_score") -> Column:
    """clip(raw x (1 + 0.008 max(age - 20, 0)), 0, 100), 1 decimal."""
    return rnd(clip(F.col(raw) * (lit_d(1.0) + lit_d(0.008) * F.greatest(F.col("home_age") - 20, F.lit(0))), 0, 100), 1)


def neutralised_fire_distance() -> Column:
    """-1 sentinel -> portfolio mean 3.2 mi."""
    return F.when(F.col("dist_to_fire_station_mi") < 0, lit_d(3.2)).otherwise(F.col("dist_to_fire_station_mi"))


def neutralised_defensible_space() -> Column:
    """NULL defensible space -> 50 (the M rule's neutral value)."""
    return F.coalesce(F.col("defensible_space_score"), lit_d(50.0))


# ── fitted encoder / imputer / scaler ─────────────────────────────────────
@dataclass
class Encoder:
    """Alphabetical label codes per column; unseen values map to code 0."""
    classes: dict

    @staticmethod
    def fit(df: DataFrame, cols: list[str] = CAT_COLS) -> "Encoder":
        present = [c for c in cols if c in df.columns]
        stacked = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val")) for c in present])).alias("s"))
        rows = stacked.select("s.col", "s.val").distinct().collect()   # bounded by cardinality
        classes: dict = {c: [] for c in present}
        for r in rows:
            classes[r["col"]].append("None" if r["val"] is None else r["val"])
        return Encoder({c: sorted(v) for c, v in classes.items()})

    def code(self, col: str, src: Column | None = None) -> Column:
        src = F.col(col) if src is None else src
        values = self.classes[col]
        m = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(i))])
        return F.coalesce(F.element_at(m, F.coalesce(src.cast("string"), F.lit("None"))), F.lit(0))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.code(c).alias(c) if c in self.classes else F.col(c) for c in df.columns])

    def to_rows(self) -> list[tuple]:
        return [(c, v, i) for c, vals in self.classes.items() for i, v in enumerate(vals)]


def fit_dictionary(df: DataFrame, cols: list[str]) -> DataFrame:
    """P8 for columns of any cardinality: (column, value, code) with the alphabetical codes of
    ``Encoder``, as a table; values are ordered by ranges and never come to the driver."""
    from riskbook.operators.curves import ordered_positions
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("value")) for c in cols]))
    placed = ordered_positions(df.select(each.alias("s")).select("s.*").distinct(), [("column", False), ("value", False)])
    first = placed.groupBy("column").agg(F.min("_pos").alias("first"))  # one row a column
    return placed.join(F.broadcast(first), "column").select("column", "value", (F.col("_pos") - F.col("first")).alias("code"))


def encode_by(df: DataFrame, dictionary: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with ``cols`` replaced by their codes, unseen values by 0; a column's part of the dictionary
    is broadcast only behind a check of its size."""
    from riskbook.operators.joins import join_checked
    for c in cols:
        codes = dictionary.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        joined = join_checked(df.withColumn("_value", F.coalesce(F.col(c).cast("string"), F.lit("None"))), codes, "_value", "left")
        df = joined.select(*[F.coalesce("_code", F.lit(0)).alias(x) if x == c else F.col(x) for x in df.columns])
    return df


@dataclass
class Imputer:
    """Train means of nullable float columns; text that does not parse counts as missing."""
    means: dict

    @staticmethod
    def fit(df: DataFrame, cols: list[str] = NULLABLE_FLOATS) -> "Imputer":
        r = df.agg(*[F.avg(F.col(c).try_cast("double")).alias(c) for c in cols]).first()
        return Imputer({c: (r[c] if r[c] is not None else 0.0) for c in cols})

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.means:
                out.append(F.coalesce(F.col(c).try_cast("double"), lit_d(self.means[c])).alias(c))
            else:
                out.append(F.col(c))
        missing = [F.lit(v).alias(c) for c, v in self.means.items() if c not in df.columns]
        return df.select(*out, *missing)


@dataclass
class Scaler:
    """P10: (x - mean) / population std, fitted on the training split."""
    mean: dict
    std: dict

    @staticmethod
    def fit(df: DataFrame, cols: list[str]) -> "Scaler":
        aggs = []
        for c in cols:
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias("m_" + c), F.stddev_pop(x).alias("s_" + c)]
        r = df.agg(*aggs).first()
        return Scaler({c: r["m_" + c] for c in cols}, {c: r["s_" + c] for c in cols})

    def col(self, c: str) -> Column:
        s = self.std[c] or 0.0
        # a constant column scales to 0 (sklearn uses std 1 for zero variance)
        return (F.col(c).cast("double") - lit_d(self.mean[c])) / lit_d(s if s > 0 else 1.0)


def cell_key(wf: Column, roof: Column, flood: Column, eq: Column, slope: Column) -> Column:
    """Encoded wf | roof | flood | eq | (slope > 55)."""
    return F.concat_ws("|", wf.cast("string"), roof.cast("string"), flood.cast("string"),
                       eq.cast("string"), (slope > 55).cast("int").cast("string"))


def encoded_cell_key(enc: Encoder) -> Column:
    return cell_key(enc.code("wildfire_zone"), enc.code("roof_material"), enc.code("flood_zone"),
                    enc.code("earthquake_zone"), F.col("slope_steepness_pct"))


def cell_bound(enc: Encoder) -> int:
    """Number of possible cell keys: product of the four encoded cardinalities x 2."""
    n = 2
    for c in ("wildfire_zone", "roof_material", "flood_zone", "earthquake_zone"):
        n *= max(1, len(enc.classes.get(c, [])))
    return n
