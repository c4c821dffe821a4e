"""Joins: size-checked broadcast, dimension joins, scenario and what-if joins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Broadcast only what is proven small: 32 MiB of estimated plan size by default
# (Catalyst estimates scans from compressed file sizes, so keep head-room).
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimized plan (no job is run)."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # pragma: no cover - defensive: py4j / connect
        return None


BROADCAST_MAX_ROWS = 1_000_000


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner",
                 limit: int = BROADCAST_LIMIT_BYTES, rows_bound: int | None = None) -> DataFrame:
    """Broadcast ``right`` only when its size is proven small.

    Proof is either a caller-supplied row bound (fixed dimensions, tables bounded by
    category cardinalities) or, when Catalyst's size estimate is under ``limit``, an
    actual row count of the small side under ``BROADCAST_MAX_ROWS`` (the estimate
    alone comes from compressed file sizes and is not a bound; DataFrames made from
    local Python data carry no usable estimate at all). Otherwise the join stays a
    shuffle join chosen by Catalyst; AQE's skew-join handling splits a hot key.
    """
    if rows_bound is not None and rows_bound <= BROADCAST_MAX_ROWS:
        right = F.broadcast(right)
    else:
        size = estimated_bytes(right)
        if size is not None and size <= limit and right.count() <= BROADCAST_MAX_ROWS:
            right = F.broadcast(right)
    return left.join(right, on, how)


def join_dim(df: DataFrame, dim: DataFrame, on, how: str = "left", rows_bound: int | None = None) -> DataFrame:
    """Attach a small dimension table (state parameters, rating factors)."""
    return join_checked(df, dim, on, how, rows_bound=rows_bound)


def apply_cell_oe(df: DataFrame, cells: DataFrame, cell_col: str = "cell", oe_col: str = "oe",
                  out: str = "cell_oe", rows_bound: int | None = None) -> DataFrame:
    """Cell O/E lookup, 1.0 for cells unseen in the fitting set. ``rows_bound`` is
    the number of possible cells (product of the encoded cardinalities x 2)."""
    c = cells.select(F.col(cell_col).alias("_cell"), F.col(oe_col).alias("_oe"))
    joined = join_checked(df, c, df[cell_col] == c["_cell"], "left", rows_bound=rows_bound)
    return joined.withColumn(out, F.coalesce(F.col("_oe"), F.lit(1.0))).drop("_cell", "_oe")


def align(base: DataFrame, full: DataFrame, key: str = "policy_id",
          base_suffix: str = "_base", full_suffix: str = "_full") -> DataFrame:
    """Align baseline and full scores per policy by an equi-join on the key.

    For inputs from different sources; two score sets of one scan belong in one projection.
    """
    b = base.select(key, *[F.col(c).alias(c + base_suffix) for c in base.columns if c != key])
    f = full.select(key, *[F.col(c).alias(c + full_suffix) for c in full.columns if c != key])
    return b.join(f, key, "inner")


def scenario_cross(df: DataFrame, scenarios: list[dict], override_cols: list[str],
                   label: str = "scenario") -> DataFrame:
    """Every policy x every scenario override; a missing override keeps the policy's value.

    The scenarios are a table by number; a policy's rows are numbered by ``explode``, and both meet in an
    equi-join whose small side is bounded by the number of scenarios. No shuffle while that bound allows
    a broadcast, a shuffle join beyond it.
    """
    kinds = ", ".join(f"_ov_{c} {df.schema[c].dataType.simpleString()}" for c in override_cols)
    rows = [(i, str(s[label]), *[s.get(c) for c in override_cols]) for i, s in enumerate(scenarios)]
    cards = df.sparkSession.createDataFrame(rows, f"_no int, {label} string, {kinds}")
    numbered = df.withColumn("_no", F.explode(F.sequence(F.lit(0), F.lit(len(scenarios) - 1)) if scenarios else F.array().cast("array<int>")))
    joined = join_checked(numbered, cards, "_no", rows_bound=len(scenarios))
    return joined.select(*[c for c in df.columns if c not in override_cols], label,
                         *[F.coalesce(F.col("_ov_" + c), F.col(c)).alias(c) for c in override_cols])


def with_overrides(df: DataFrame, changes: dict) -> DataFrame:
    """Replace columns by literal values (the 'what-if' edit of a submission)."""
    cols: list[Column] = []
    for c in df.columns:
        if c in changes:
            v = changes[c]
            cols.append(F.lit(v).cast(df.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)
