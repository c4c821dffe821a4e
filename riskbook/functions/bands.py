"""Risk bands, underwriting actions and routing tiers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: band edges (left-closed) and the
# underwriting action text per band.
BANDS = [
    # (band, lo, hi, action)
    ("Very Low", 0.0, 200.0, "✅ Accept — Best Terms"),
    ("Low", 200.0, 400.0, "✅ Accept — Standard Terms"),
    ("Moderate", 400.0, 600.0, "🔶 Accept with Conditions"),
    ("High", 600.0, 800.0, "🔴 Refer to Senior Underwriter"),
    ("Very High", 800.0, 1000.0, "🚫 Decline / Surplus Lines Market"),
]
BAND_ORDER = [b[0] for b in BANDS]


def risk_band(score: Column) -> Column:
    """Five bands at 200/400/600/800, left-closed."""
    return (F.when(score < 200, "Very Low").when(score < 400, "Low")
            .when(score < 600, "Moderate").when(score < 800, "High")
            .otherwise("Very High"))


def band_rank(band: Column) -> Column:
    """0..4 position of a band label (for up/down comparisons)."""
    expr = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(BAND_ORDER))):
        expr = F.when(band == name, i).otherwise(expr)
    return expr


def uw_action(band: Column) -> Column:
    """Band -> underwriting action text."""
    expr = F.lit(None).cast("string")
    for name, _, _, action in reversed(BANDS):
        expr = F.when(band == name, action).otherwise(expr)
    return expr


# Decision tiers (upper score bound, tier, action).
DECISION_TIERS = [
    (300, "Preferred", "Auto-Bind (instant)"),
    (500, "Standard", "Auto-Bind (instant)"),
    (700, "Non-Standard", "Manual Review (2 min)"),
    (None, "High Risk", "Auto-Decline / Override"),
]


def decision_tier(score: Column, field: str = "tier") -> Column:
    """Alternative routing 0-300 / 301-500 / 501-700 / 701+ (tier or action)."""
    idx = 1 if field == "tier" else 2
    expr = F.lit(DECISION_TIERS[-1][idx])
    for row in reversed(DECISION_TIERS[:-1]):
        expr = F.when(score <= row[0], row[idx]).otherwise(expr)
    return expr


def credit_tier(score: Column) -> Column:
    """<650 sub-prime, <750 standard, else preferred."""
    return (F.when(score < 650, "sub-prime").when(score < 750, "standard")
            .otherwise("preferred"))
