"""Column-expression helpers shared by every job (all JVM-side, no Python UDFs)."""
from riskbook.functions.columns import (  # noqa: F401
    clip, rnd, hash_uniform, hash_normal, lit_d, safe_div,
)
from riskbook.functions.bands import (  # noqa: F401
    BANDS, risk_band, uw_action, decision_tier, credit_tier, band_rank,
)
