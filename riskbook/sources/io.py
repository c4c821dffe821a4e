"""Policy files and scratch locations.

Reads always use the fixed policy schema (no inference pass over the data). Scratch
output goes under the shared ``spark.checkpoint.dir`` folder, never a machine-local
temp folder.
"""
from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskbook.session import ensure_checkpoint_dir, leased

_INT = T.IntegerType()
_LONG = T.LongType()
_DBL = T.DoubleType()
_STR = T.StringType()

POLICY_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in [
    ("policy_id", _STR), ("policy_year", _INT), ("state", _STR), ("construction_type", _STR),
    ("roof_material", _STR), ("occupancy", _STR), ("year_built", _INT), ("home_age", _INT),
    ("home_value", _LONG), ("coverage_amount", _LONG), ("coverage_ratio", _DBL), ("square_footage", _INT),
    ("stories", _INT), ("protection_class", _INT), ("prior_claims_3yr", _INT), ("credit_score", _INT),
    ("credit_restricted", _INT), ("deductible", _INT), ("swimming_pool", _INT), ("trampoline", _INT),
    ("dog", _INT), ("security_system", _INT), ("smoke_detectors", _INT), ("sprinkler_system", _INT),
    ("gated_community", _INT), ("roof_age_yr", _INT), ("wildfire_zone", _STR), ("flood_zone", _STR),
    ("earthquake_zone", _STR), ("hail_zone", _STR), ("vegetation_risk_composite", _STR),
    ("has_knob_tube_wiring", _INT), ("has_polybutylene_pipe", _INT), ("defensible_space_score", _DBL),
    ("permit_score", _DBL), ("dist_to_coast_mi", _DBL), ("dist_to_fire_station_mi", _DBL),
    ("trend_rate_annual", _DBL), ("trend_factor", _DBL), ("vintage_cat_multiplier", _DBL),
    ("slope_steepness_pct", _DBL), ("post_burn_rainfall_intensity", _DBL), ("data_vintage_flag", _INT),
    ("rcv_vintage_flag", _INT), ("is_near_duplicate", _INT), ("renewal_credit", _INT),
    ("lambda_true", _DBL), ("mu_true", _DBL), ("M_true", _DBL), ("expected_loss_true", _DBL),
    ("claim_occurred", _INT), ("claim_count", _INT), ("claim_amount", _DBL), ("total_loss", _DBL),
    ("is_cat_event", _INT), ("risk_score_true", _DBL), ("risk_band", _STR), ("risk_score_a2", _DBL),
    ("indicated_premium", _DBL), ("expected_loss_ratio", _DBL),
]])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return leased(f"{base}/riskbook-io/{name}-{uuid.uuid4().hex[:12]}")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_policies(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame | None:
    """Read a policy file into the fixed schema; None when the path is absent.

    Columns are taken by name, in any order; further columns are left out, and a missing one
    raises. CSV fields are read as text and cast, so there is no inference pass; a field that can't be
    read is null, its row stays (``bad_fields`` lists such fields).
    """
    if not path_exists(spark, path):
        return None
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt != "csv":
        return spark.read.schema(POLICY_SCHEMA).parquet(path)
    raw = _raw_csv(spark, path)
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in POLICY_SCHEMA.fields])


def bad_fields(spark: SparkSession, path: str) -> DataFrame:
    """(file, policy_id, column, text) of every CSV field under ``path`` that doesn't fit its type."""
    typed = [f for f in POLICY_SCHEMA.fields if f.dataType != _STR]
    bad = [F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("text"))) for f in typed]
    return (_raw_csv(spark, path).select(F.input_file_name().alias("file"), "policy_id", F.explode(F.array_compact(F.array(*bad))).alias("b"))
            .select("file", "policy_id", "b.column", "b.text"))


def _raw_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    missing = [f.name for f in POLICY_SCHEMA.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return raw


def write_policies(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """S3: write (overwrite) a policy book, optionally partitioned (e.g. by state).

    A partitioned write sorts each task's rows by partition. Rebalanced, a task holds rows of about
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` (a large state becomes several), however large the
    book or its input splits are."""
    w = (df.hint("rebalance", *partition_by) if partition_by else df).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def cached_scores(df: DataFrame) -> DataFrame:
    """Persist the heavy intermediate once; the caller unpersists when done."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
