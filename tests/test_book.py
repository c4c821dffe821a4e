"""Fixture book and rating-plan invariants."""
from pyspark.sql import functions as F

from riskbook.sources.book import BOOK_COLUMNS


def test_shape_and_keys(book):
    assert book.columns == BOOK_COLUMNS
    assert len(BOOK_COLUMNS) == 60          # reference has 61: the frailty draw is not built
    r = book.agg(F.count("*").alias("n"), F.countDistinct("policy_id").alias("k")).first()
    assert r["n"] == 1500 and r["k"] == 1500


def test_plan_ranges(book):
    r = book.agg(F.min("lambda_true"), F.max("lambda_true"), F.min("M_true"), F.max("M_true"),
                 F.min("mu_true"), F.max("mu_true"), F.min("risk_score_true"), F.max("risk_score_true")).first()
    assert 0.005 * 0.95 - 1e-9 <= r[0] and r[1] <= 0.18 + 1e-9
    assert 0.70 <= r[2] and r[3] <= 3.5
    assert 1500 <= r[4] and r[5] <= 400000
    assert r[6] == 50.0 and r[7] == 950.0


def test_losses_and_bands(book):
    bad = book.where(((F.col("claim_occurred") == 0) & (F.col("total_loss") != 0))
                     | ((F.col("claim_occurred") == 1) & (F.col("total_loss") < 100))
                     | (F.col("total_loss") > F.col("coverage_amount"))).count()
    assert bad == 0
    mism = book.where(F.col("risk_band") != F.when(F.col("risk_score_true") < 200, "Very Low")
                      .when(F.col("risk_score_true") < 400, "Low").when(F.col("risk_score_true") < 600, "Moderate")
                      .when(F.col("risk_score_true") < 800, "High").otherwise("Very High")).count()
    assert mism == 0


def test_premium_identity(book):
    d = book.select(F.max(F.abs(F.col("indicated_premium") - F.col("expected_loss_true") / 0.67))).first()[0]
    assert d < 0.01
