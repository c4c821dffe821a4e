"""Isotonic regression over ranges of the prediction: pool adjacent violators, merged block by block.

Equal predictions are summed first, so a value that a third of the rows have is one row. Ranges of the
prediction are pooled apart; what is left of a range is a list of blocks (first and last value, sum,
weight). Pooling a list of pooled blocks gives the same as pooling their rows, so lists of neighbouring
ranges are merged in rounds until one is left: the result is exact. A list has as many blocks as its part
of the fitted function has steps; the last is the model.

Defined cases: null predictions or targets are left out; without rows the function is empty.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "part int, lo double, hi double, total double, weight double"
#: Lists of blocks that one task merges.
FAN_IN = 8


def pooled(blocks: Iterator[tuple[float, float, float, float]]) -> list[list[float]]:
    """Blocks (lo, hi, total, weight) in order of lo to blocks of rising means."""
    out: list[list[float]] = []
    for lo, hi, total, weight in blocks:
        out.append([lo, hi, total, weight])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            lo2, hi2, total2, weight2 = out.pop()
            out[-1][1:] = [hi2, out[-1][2] + total2, out[-1][3] + weight2]
    return out


def fit_isotonic(df: DataFrame, x: str, y: str, parts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(points, values) of the rising function of ``x`` nearest to ``y``; linear between the points, level
    beyond them."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = (df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
            .groupBy("x").agg(F.sum("y").alias("total"), F.count(F.lit(1)).cast("double").alias("weight")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[list[float]] = []
        for frame in frames:
            rows = zip(frame["x"], frame["x"], frame["total"], frame["weight"], strict=True)
            found = pooled([*found, *rows])
        yield pd.DataFrame(found, columns=["lo", "hi", "total", "weight"])

    lists = (sums.repartitionByRange(parts, "x").sortWithinPartitions("x").mapInPandas(run, "lo double, hi double, total double, weight double")
             .withColumn("part", F.spark_partition_id()).select("part", "lo", "hi", "total", "weight"))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("lo")
        found = pd.DataFrame(pooled(frame[["lo", "hi", "total", "weight"]].itertuples(index=False)), columns=["lo", "hi", "total", "weight"])
        return found.assign(part=int(frame["part"].iloc[0]) // FAN_IN)[["part", "lo", "hi", "total", "weight"]]

    while parts > 1:
        lists = lists.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, _SCHEMA)
        parts = -(-parts // FAN_IN)
    rows = lists.toPandas().sort_values("lo")
    mean = (rows["total"] / rows["weight"]).to_numpy()
    points = rows[["lo", "hi"]].to_numpy().ravel()
    values = np.repeat(mean, 2)
    distinct = np.concatenate([[True], points[1:] > points[:-1]]) if len(points) else np.empty(0, dtype=bool)
    return points[distinct], values[distinct]


def apply_isotonic(points: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.interp(x, points, values) if len(points) else np.asarray(x, dtype=float)
