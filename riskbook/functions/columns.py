"""Small numeric column helpers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_d(x: float) -> Column:
    """Double literal (a bare decimal in SQL text would be DECIMAL)."""
    return F.lit(float(x))


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """``c`` held between ``lo`` and ``hi``; NULL stays NULL (``greatest`` / ``least`` skip it)."""
    out = c
    if lo is not None:
        out = F.greatest(out, lit_d(lo))
    if hi is not None:
        out = F.least(out, lit_d(hi))
    return F.when(c.isNotNull(), out)


def rnd(c: Column, digits: int) -> Column:
    """Round half up, written as floor(x*10^d + 0.5)/10^d.

    Engines disagree on ties of ``round`` (decimal vs binary view of the double);
    this form is plain IEEE arithmetic and gives the same bits everywhere.
    """
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def safe_div(num: Column, den: Column) -> Column:
    """NULL instead of an ANSI division-by-zero error."""
    return F.when(den != 0, num / den)


def hash_uniform(key: Column, salt: str) -> Column:
    """Deterministic uniform in [0,1) from md5(key || ':' || salt)."""
    h = F.md5(F.concat(key.cast("string"), F.lit(":" + salt)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_normal(key: Column, salt: str) -> Column:
    """Approximate standard normal: (U1 + U2 + U3 - 1.5) * 2."""
    s = hash_uniform(key, salt + "1") + hash_uniform(key, salt + "2") + hash_uniform(key, salt + "3")
    return (s - F.lit(1.5)) * F.lit(2.0)


# ── exact rounded means and shares ────────────────────────────────────────
# A mean of fixed-decimal values (or a count ratio) is a rational with a small
# denominator and can land exactly on a rounding tie, where floating-point noise
# would decide the result. These helpers sum scaled integers and round with an
# integer division, so every engine returns the same digits.
def mean_parts(name: str, c: Column, decimals: int) -> list[Column]:
    """Aggregate parts of an exact mean of ``c`` (at most ``decimals`` decimals)."""
    scaled = F.floor(c.cast("double") * F.lit(float(10 ** decimals)) + F.lit(0.5))
    return [F.sum(scaled.cast("decimal(38,0)")).alias(f"{name}__s"), F.count(c).alias(f"{name}__n")]


def share_parts(name: str, cond: Column) -> list[Column]:
    """Aggregate parts of an exact share of rows where ``cond`` holds."""
    return [F.sum(F.when(cond, 1).otherwise(0).cast("decimal(38,0)")).alias(f"{name}__s"),
            F.count(F.lit(1)).alias(f"{name}__n")]


def exact_round(name: str, decimals: int, out_decimals: int, scale: int = 1) -> Column:
    """Half-up rounding of scale x S / (n 10^decimals) to ``out_decimals``, in integers."""
    k = scale * 10 ** (out_decimals - decimals) if out_decimals >= decimals else None
    if k is None:
        raise ValueError("out_decimals must be >= decimals")
    s, n = f"`{name}__s`", f"`{name}__n`"
    return F.expr(f"CASE WHEN {n} > 0 THEN cast((2 * {s} * {k} + {n}) div (2 * {n}) AS double) / {float(10 ** out_decimals)!r}D END")
