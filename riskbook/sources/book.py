"""The full fixture policy book: stage A features + rating plan + outcomes + scores.

Jobs: one aggregate for the frequency normaliser, the exact p99.5 of positive
losses (histogram narrowing, see ``operators.quantiles``) and one aggregate for the
score anchors. Stage A with the raw rating plan is persisted (MEMORY_AND_DISK) for
the duration of those passes, so the hash features are computed once.
"""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskbook.functions.bands import risk_band
from riskbook.functions.columns import clip, hash_uniform, lit_d, rnd
from riskbook.operators.quantiles import exact_quantiles
from riskbook.plans import rating as R
from riskbook.session import compiled_methods
from riskbook.sources.fixture import FEATURE_COLUMNS, build_features

CAT_THRESHOLD = 85_000.0
LOSS_CAP_Q = 0.995

OUTCOME_COLUMNS = [
    "renewal_credit", "lambda_true", "mu_true", "M_true", "expected_loss_true",
    "claim_occurred", "claim_count", "claim_amount", "total_loss", "is_cat_event",
    "risk_score_true", "risk_band", "risk_score_a2", "indicated_premium", "expected_loss_ratio",
]
BOOK_COLUMNS = FEATURE_COLUMNS + OUTCOME_COLUMNS


def winsorize(df: DataFrame, col: str, q: float = LOSS_CAP_Q, floor_pos: float = 100.0,
              cap_col: str | None = None, out: str | None = None) -> tuple[DataFrame, float | None]:
    """Floor positive losses at ``floor_pos``, cap by ``cap_col`` (coverage), then
    cap at the exact ``q`` quantile of the positive losses. Returns (df, cap)."""
    out = out or col
    x = F.col(col)
    pos = F.when(x > 0, F.greatest(F.least(x, F.col(cap_col)) if cap_col else x, lit_d(floor_pos))) \
        .otherwise(lit_d(0.0))
    staged = df.withColumn("_pre", pos)
    values = staged.where(F.col("_pre") > 0).select("_pre").persist(StorageLevel.MEMORY_AND_DISK)  # read by several passes
    cap = exact_quantiles(values, "_pre", [q])[("", q)]
    values.unpersist()
    capped = F.least(F.col("_pre"), lit_d(cap)) if cap is not None else F.col("_pre")
    return staged.withColumn(out, capped).drop("_pre"), cap


def build_book(spark: SparkSession, sf_dir: str, keep_internal: bool = False) -> DataFrame:
    """Return the scored policy book (one row per order)."""
    compiled_methods(spark)
    feats = build_features(spark, sf_dir)
    # One pass over the hash features: unnormalised lambda, mu and M are materialised
    # in the cache; the frequency normaliser and every later pass read the cache.
    base = feats.select("*", R.frequency_raw().alias("_lam_raw"), R.severity_expr().alias("_mu"),
                        R.interaction_expr().alias("_m"),
                        *[hash_uniform(F.col("o_orderkey"), s).alias(f"_u_{s}") for s in ("occd", "cat", "sev", "cnt")]) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    _PERSISTED.append(base)
    mean_raw = base.agg(F.avg("_lam_raw")).first()[0] or R.BASE_CLAIM_RATE
    lam = clip(F.col("_lam_raw") / lit_d(mean_raw) * lit_d(R.BASE_CLAIM_RATE), *R.LAMBDA_CLIP)
    rc = R.renewal_credit()
    planned = base.select("*", rc.alias("renewal_credit"),
                          (lam * F.when(rc > 0, lit_d(R.RENEWAL_CREDIT)).otherwise(lit_d(1.0))).alias("_lam"))
    u = lambda s: F.col(f"_u_{s}")
    lam_t = rnd(F.col("_lam"), 5)
    mu_t = rnd(F.col("_mu"), 0)
    m_t = rnd(F.col("_m"), 4)
    staged = planned.select(
        "*", lam_t.alias("lambda_true"), mu_t.alias("mu_true"), m_t.alias("M_true"),
        R.expected_loss().alias("expected_loss_true"))
    occurred = (u("occd") < F.col("lambda_true")).cast("int")
    cat = (occurred == 1) & (u("cat") < clip(lit_d(0.015) * F.col("M_true"), 0.015, 0.30))
    usev = u("sev")
    raw = F.when(cat, lit_d(CAT_THRESHOLD) + lit_d(0.55) * F.col("mu_true")
                 * (F.pow(lit_d(1.0) - usev, lit_d(-0.25)) - 1) / lit_d(0.25)) \
        .otherwise(F.col("mu_true") * F.col("M_true") * (-F.log(lit_d(1.0) - usev)))
    ucnt = u("cnt")
    staged = staged.select(
        "*", occurred.alias("claim_occurred"),
        (occurred * (1 + (ucnt < 0.10).cast("int") + (ucnt < 0.02).cast("int"))).alias("claim_count"),
        cat.cast("int").alias("is_cat_event"),
        F.when(occurred == 1, raw * F.col("trend_factor")).otherwise(lit_d(0.0)).alias("_raw_loss"),
    )
    capped, _ = winsorize(staged, "_raw_loss", cap_col="coverage_amount", out="total_loss")
    lo, hi = R.minmax_log_anchors(staged, "expected_loss_true")
    el = F.col("expected_loss_true")
    score = rnd(R.score_a1(el, lo, hi), 1)
    book = capped.select(
        *[c for c in capped.columns if c not in ("_raw_loss", "total_loss")],
        rnd(F.col("total_loss"), 2).alias("claim_amount"),
        rnd(F.col("total_loss"), 2).alias("total_loss"),
        score.alias("risk_score_true"),
        risk_band(score).alias("risk_band"),
        rnd(R.score_a2(F.col("_lam"), F.col("_mu") * F.col("_m"), R.BOOK_A2), 1).alias("risk_score_a2"),
        rnd(el / lit_d(0.67), 2).alias("indicated_premium"),
        lit_d(0.67).alias("expected_loss_ratio"),
    )
    # the result is lazily defined on the cached `base`, which stays cached until the
    # caller has materialised what it needs (see release_cached)
    cols = BOOK_COLUMNS + (["o_orderkey", "_lam", "_mu", "_m"] if keep_internal else [])
    return book.select(*cols)


_PERSISTED: list[DataFrame] = []


def release_cached() -> None:
    """Unpersist intermediates cached by ``build_book``."""
    while _PERSISTED:
        _PERSISTED.pop().unpersist()
