"""Helpers shared by the operators of this package."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``id`` and ``text`` alone (null text: empty), so further columns never clash."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def remainder_is(id_col: str, modulus: int, value: int) -> Column:
    """crc32 of the id as text leaves ``value``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == value, F.lit(False))


def slices(lengths: Iterable[int], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` characters each, one row at least: bounds the
    memory of a task without cutting a text."""
    start, total, i = 0, 0, -1
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if i >= start:
        yield start, i + 1
