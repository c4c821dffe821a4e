"""Exact, linearly interpolated quantiles without a global sort.

Spark's exact ``percentile`` keeps every value of a group in one aggregation buffer,
which for a book-wide quantile means one task holds the whole column. Here the
order statistic is found by iterative histogram narrowing instead:

1. one pass: count / min / max per group;
2. each further pass buckets only the values inside the current interval of every
   wanted rank into ``bins`` equal-width buckets (of the values or their logarithms) (partial aggregation, map-side
   combine; the driver receives at most ``targets x bins`` rows) and keeps the bucket
   that holds the rank, using that bucket's own min and max as the new interval;
3. once an interval holds at most ``leaf`` values (or a single distinct value) the
   few remaining values are fetched and the rank is read off directly.

Bucketing is monotone in the value, so buckets are contiguous runs of the sorted
order and counts stay exact; ties collapse to min == max and stop the refinement.
The result equals the linear-interpolation definition (NumPy / pandas default,
DuckDB ``quantile_cont``, Spark ``percentile``): v[r] + (p(n-1) - r)(v[r+1] - v[r]).
"""
from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _long_values(df: DataFrame, col: str, by: str | None) -> DataFrame:
    g = F.col(by).cast("string") if by else F.lit("")
    v = F.col(col).cast("double")
    return df.select(g.alias("g"), v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))


def _log_scale(v):
    """Monotone in v and finite for every finite double: sign x (log2 |v| + 1075), 0 for 0."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1075.0))


def exact_quantiles(df: DataFrame, col: str, probs: list[float], by: str | None = None,
                    bins: int = 2048, leaf: int = 4096) -> dict:
    """Return {(group, p): value} (group is '' when ``by`` is None; value None if empty).

    An interval that spans more than a factor of 4 is cut on a logarithmic scale, others evenly:
    at most two logarithmic passes and then 52 / 11 even ones resolve any range of doubles.
    """
    spark = df.sparkSession
    data = _long_values(df, col, by)
    stats = {r["g"]: (r["n"], r["lo"], r["hi"]) for r in
             data.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"),
                                   F.max("v").alias("hi")).collect()}
    result: dict = {}
    # rank targets per group: (g, r) -> [lo, hi, below, resolved value]
    state: dict = {}
    wanted: dict = {}
    for g, (n, lo, hi) in stats.items():
        for p in probs:
            pos = p * (n - 1)
            r0 = int(math.floor(pos))
            r1 = min(r0 + 1, n - 1)
            wanted[(g, p)] = (r0, r1, pos - r0)
            for r in (r0, r1):
                known = lo if r == 0 else hi if r == n - 1 else lo if lo == hi else None
                state.setdefault((g, r), [lo, hi, 0, known, n])
    passes = 0
    while open_keys := [k for k, s in state.items() if s[3] is None]:
        passes += 1
        if passes > 64:
            raise RuntimeError(f"quantiles of {col} don't resolve: {open_keys[:5]}")
        # distinct intervals still open
        intervals = {}
        for k in open_keys:
            lo, hi, below, _, cnt = state[k]
            intervals.setdefault((k[0], lo, hi, below), cnt)
        small = {iv for iv, cnt in intervals.items() if cnt <= leaf}
        big = [iv for iv in intervals if iv not in small]
        iv_list = list(intervals)
        iv_id = {iv: i for i, iv in enumerate(iv_list)}
        iv_df = spark.createDataFrame(
            [(iv_id[iv], iv[0], float(iv[1]), float(iv[2]), iv in small) for iv in iv_list],
            T.StructType([T.StructField("iid", T.IntegerType()), T.StructField("ig", T.StringType()),
                          T.StructField("ilo", T.DoubleType()), T.StructField("ihi", T.DoubleType()),
                          T.StructField("leaf", T.BooleanType())]))
        # tiny interval table: broadcast (bounded by 2 x len(probs) x groups rows)
        inside = data.join(F.broadcast(iv_df), (data.g == iv_df.ig) & (data.v >= iv_df.ilo)
                           & (data.v <= iv_df.ihi))
        leaves: dict = defaultdict(list)
        if small:
            for row in inside.where("leaf").select("iid", "v").collect():
                leaves[row["iid"]].append(row["v"])
        hist: dict = defaultdict(list)
        if big:
            wide = (F.signum("ilo") != F.signum("ihi")) | (F.greatest(F.abs("ilo"), F.abs("ihi")) > 4 * F.least(F.abs("ilo"), F.abs("ihi")))
            at = lambda c: F.when(wide, _log_scale(F.col(c))).otherwise(F.col(c))
            bucket = F.least(F.lit(bins - 1), F.floor((at("v") - at("ilo")) / (at("ihi") - at("ilo")) * F.lit(float(bins))))
            agg = (inside.where(~F.col("leaf")).groupBy("iid", bucket.alias("b"))
                   .agg(F.count("*").alias("c"), F.min("v").alias("mn"), F.max("v").alias("mx")))
            for row in agg.collect():
                hist[row["iid"]].append((row["b"], row["c"], row["mn"], row["mx"]))
        for k in open_keys:
            lo, hi, below, _, cnt = state[k]
            iid = iv_id[(k[0], lo, hi, below)]
            r = k[1]
            if iid in leaves:
                vals = sorted(leaves[iid])
                state[k][3] = vals[r - below]
                continue
            acc = below
            for b, c, mn, mx in sorted(hist[iid]):
                if acc + c > r:
                    state[k] = [mn, mx, acc, mn if mn == mx else None, c]
                    break
                acc += c
    for (g, p), (r0, r1, frac) in wanted.items():
        v0 = state[(g, r0)][3]
        v1 = state[(g, r1)][3]
        result[(g, p)] = v0 if frac == 0 or v1 == v0 else v0 + (v1 - v0) * frac
    for g in stats:
        for p in probs:
            result.setdefault((g, p), None)
    if not stats:
        for p in probs:
            result[("", p)] = None
    return result


def quantile_table(df: DataFrame, col: str, probs: list[float], by: str | None = None,
                   names: list[str] | None = None) -> DataFrame:
    """Small long-form DataFrame (group, p, value) of exact quantiles."""
    q = exact_quantiles(df, col, probs, by)
    rows = [(g, float(p), (None if v is None else float(v))) for (g, p), v in q.items()]
    return df.sparkSession.createDataFrame(
        rows, "grp string, p double, value double")
