"""Observed-to-expected experience study by co-exposure cell.

Cells are a ``groupBy`` with partial aggregation: a hot cell holding a third of the
book only costs its map-side combine. The cell table (one row per cell, bounded by
the product of the encoded cardinalities) is joined back with a size-checked broadcast.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskbook.functions.columns import clip, lit_d, rnd
from riskbook.operators.joins import apply_cell_oe
from riskbook.operators.quantiles import exact_quantiles

# Fixed values of the O/E study.
OE_CLIP = (0.10, 8.00)
GLM_EL_FLOOR = 50.0
MIN_GROUP_TRAIN = 10
MIN_GROUP_TEST = 5


def group_oe(df: DataFrame, claim: str = "claim_amount", expected: str = "glm_el", cell: str = "cell",
             min_group: int = MIN_GROUP_TRAIN) -> DataFrame:
    """Per cell sum claims / max(sum expected, 50), clipped to [0.10, 8.0];
    1.0 for cells with fewer than ``min_group`` policies."""
    agg = df.groupBy(cell).agg(F.sum(claim).alias("total_claim"), F.sum(expected).alias("total_expected"),
                               F.count("*").alias("n_policies"))
    raw = F.col("total_claim") / F.greatest(F.col("total_expected"), lit_d(GLM_EL_FLOOR))
    return agg.select(cell, "n_policies", "total_claim", "total_expected", raw.alias("oe_raw"),
                      F.when(F.col("n_policies") >= min_group, clip(raw, *OE_CLIP)).otherwise(lit_d(1.0)).alias("oe"))


@dataclass
class OEStudy:
    cells: DataFrame          # A11 table on the fitting split
    scale_factor: float       # A12 policy-weighted mean O/E (1.0 if < 0.05)
    overall_oe: float
    rows_bound: int | None = None   # proven bound on the number of cells


def oe_normalise(train: DataFrame, cells: DataFrame, claim: str = "claim_amount",
                 expected: str = "glm_el", cell: str = "cell", rows_bound: int | None = None) -> OEStudy:
    """Scale factor = policy-weighted mean of the cell O/E over the fitting rows."""
    mapped = apply_cell_oe(train, cells, cell_col=cell, oe_col="oe", out="policy_oe", rows_bound=rows_bound)
    r = mapped.agg(F.avg("policy_oe").alias("m"), F.sum(claim).alias("c"), F.sum(expected).alias("e")).first()
    scale = r["m"] if r["m"] is not None and r["m"] >= 0.05 else 1.0
    overall = (r["c"] or 0.0) / max(r["e"] or 0.0, 1.0)
    return OEStudy(cells, float(scale), float(overall), rows_bound)


def normalised_target(df: DataFrame, study: OEStudy, cell: str = "cell", out: str = "m_target") -> DataFrame:
    """Map cell O/E onto rows (1.0 for unseen cells), divide by the scale factor, clip."""
    mapped = apply_cell_oe(df, study.cells, cell_col=cell, oe_col="oe", out="_policy_oe", rows_bound=study.rows_bound)
    return mapped.withColumn(out, clip(F.col("_policy_oe") / lit_d(study.scale_factor), *OE_CLIP)).drop("_policy_oe")


OE_PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]


def oe_percentiles(cells: DataFrame, targets: DataFrame, target_col: str = "m_target") -> DataFrame:
    """Percentiles of the cell O/E values and of the normalised policy target."""
    qc = exact_quantiles(cells, "oe", OE_PROBS)
    qt = exact_quantiles(targets, target_col, OE_PROBS)
    rows = [("cell_oe", float(p), qc[("", p)]) for p in OE_PROBS] + \
           [("target", float(p), qt[("", p)]) for p in OE_PROBS]
    df = cells.sparkSession.createDataFrame(rows, "series string, p double, value double")
    return df.select("series", "p", rnd(F.col("value"), 6).alias("value"))


def reg_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """R2, MAE, RMSE, MAPE (denominator |y| + 1e-6) in one aggregate. The total sum of squares comes
    from a centred state (n, mean, M2) that partitions keep and merge, so a large mean doesn't cancel it."""
    yy, pp = F.col(y).cast("double"), F.col(yhat).cast("double")
    a = df.agg(F.count("*").alias("n"), F.var_pop(yy).alias("variance"),
               F.sum((yy - pp) * (yy - pp)).alias("sse"), F.avg(F.abs(yy - pp)).alias("mae"),
               F.avg(F.abs((yy - pp) / (F.abs(yy) + lit_d(1e-6)))).alias("mape"))
    sst = F.col("variance") * F.col("n")
    return a.select(rnd(F.lit(1.0) - F.col("sse") / sst, 6).alias("r2"), rnd(F.col("mae"), 4).alias("mae"),
                    rnd(F.sqrt(F.col("sse") / F.col("n")), 4).alias("rmse"), rnd(F.col("mape") * 100, 4).alias("mape"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of two columns."""
    return df.agg(rnd(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 8).alias("corr"))
