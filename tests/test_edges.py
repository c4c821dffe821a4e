"""Edge cases: empty book, unseen categories, unparsable numbers, sparse cells."""
from pyspark.sql import functions as F

from riskbook.operators import experience as X
from riskbook.operators import portfolio as P
from riskbook.plans.features import Encoder, Imputer


def test_empty_book_reports(book):
    empty = book.limit(0)
    assert P.kpis(empty).first()["total_policies"] == 0
    bd = P.band_distribution(empty).collect()
    assert len(bd) == 5 and all(r["policies"] == 0 for r in bd)


def test_unseen_category_maps_to_first_class(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "state string")
    enc = Encoder.fit(train, ["state"])
    assert enc.classes["state"] == ["a", "b", "c"]
    test = spark.createDataFrame([("c",), ("zz",), (None,)], "state string")
    assert [r[0] for r in enc.transform(test).collect()] == [2, 0, 0]


def test_text_in_numeric_field_imputed(spark):
    train = spark.createDataFrame([("10",), ("20",), (None,)], "defensible_space_score string")
    imp = Imputer.fit(train)
    assert imp.means["defensible_space_score"] == 15.0
    test = spark.createDataFrame([("abc",), ("30",)], "defensible_space_score string")
    assert [r[0] for r in imp.transform(test).collect()] == [15.0, 30.0]


def test_all_null_defensible_space(book):
    from riskbook.plans.rating import interaction_expr, severity_expr
    nulls = book.withColumn("defensible_space_score", F.lit(None).cast("double"))
    r = nulls.select(severity_expr().alias("mu"), interaction_expr().alias("m")).agg(F.count("mu"), F.count("m")).first()
    assert r[0] == book.count() and r[1] == book.count()


def test_sparse_cells_fall_back_to_one(spark):
    rows = [("A", 100.0, 10.0)] * 9 + [("B", 100.0, 10.0)] * 10
    df = spark.createDataFrame(rows, "cell string, claim_amount double, glm_el double")
    cells = {r["cell"]: r["oe"] for r in X.group_oe(df, min_group=10).collect()}
    assert cells["A"] == 1.0                       # 9 policies: neutral
    assert cells["B"] == 8.0                       # 1000 / max(100, 50) = 10, clipped to 8


def test_coverage_ratio_value_not_positive(spark):
    from riskbook.plans.features import coverage_ratio
    df = spark.createDataFrame([(0, 100000), (-5, 100000), (200000, 250000)], "home_value long, coverage_amount long")
    got = [r[0] for r in df.select(coverage_ratio("single")).collect()]
    assert got == [1.0, 1.0, 1.25]
    batch = [r[0] for r in df.select(coverage_ratio("batch")).collect()]
    assert batch == [2.0, 2.0, 1.25]          # max(value, 1), clipped to [0.5, 2]


def test_submission_with_missing_optional_fields(spark, bundle):
    from riskbook.api import predict
    minimal = {"state": "FL", "construction_type": "Masonry", "occupancy": "Owner Occupied",
               "home_value": 300000, "coverage_amount": 320000, "square_footage": 1800, "stories": 1,
               "protection_class": 4, "roof_material": "Tile", "roof_age_yr": 10, "credit_score": 760,
               "deductible": 1000, "wildfire_zone": "Low", "flood_zone": "High", "earthquake_zone": "Low",
               "hail_zone": "Low", "vegetation_risk_composite": "Moderate", "dist_to_coast_mi": 2.0,
               "dist_to_fire_station_mi": 2.0}
    r = predict(spark, bundle, minimal)
    assert r["expected_loss"] > 0 and 50 <= r["risk_score_a1"] <= 950
    assert r["interactions"][0][0] == "High Flood × Coastal Surge <5mi"
    from riskbook.plans.features import SEV_FEATS
    absent = [c for c in [*SEV_FEATS, "defensible_space_score"] if c not in minimal and c not in bundle.prep.encoder.classes]
    filled = {c: bundle.prep.imputer.means.get(c, 0.0) for c in absent if c not in ("home_age", "coverage_ratio", "credit_restricted")}
    full = predict(spark, bundle, {**minimal, **filled})
    assert all(r[c] == full[c] for c in ("lambda_pred", "mu_pred", "m_hat", "expected_loss", "premium", "risk_score_a1"))


def test_null_gives_no_clipped_value(spark):
    from riskbook.functions.columns import clip
    row = spark.sql("select cast(null as double) x, 7.0D y").select(
        clip(F.col("x"), 1, 5).alias("x"), clip(F.col("y"), 1, 5).alias("y"), clip(F.col("y"), lo=9).alias("z")).first()
    assert row["x"] is None and row["y"] == 5.0 and row["z"] == 9.0


def test_csv_is_read_by_name(spark, book):
    import pytest
    from riskbook.sources.io import POLICY_SCHEMA, read_policies, scratch_path
    names = [f.name for f in POLICY_SCHEMA.fields]
    part = book.select(*names).where(F.col("state") == "CA").limit(50)
    path = scratch_path(spark, "moved") + ".csv"
    moved = [*names[2:4], *names[:2], *names[4:]]
    part.withColumn("frailty_term", F.lit(1.5)).select("frailty_term", *moved).write.option("header", True).csv(path)
    got = read_policies(spark, path)
    assert got.columns == names and got.where("state = 'CA' and policy_year is not null").count() == part.count()
    short = scratch_path(spark, "short") + ".csv"
    part.drop("state").write.option("header", True).csv(short)
    with pytest.raises(ValueError, match="state"):
        read_policies(spark, short)


def test_whatif_split_by_hand(spark):
    """d_score 100, lambda 0.05 -> 0.06, mu 10000 -> 9000: 0.2 x 100 x 0.4 = 8, -0.1 x 100 x 0.3 = -3, rest 95."""
    ds, lam0, lam1, mu0, mu1 = 100.0, 0.05, 0.06, 10_000.0, 9_000.0
    by_lam, by_mu = (lam1 - lam0) / (lam0 + 1e-9) * ds * 0.4, (mu1 - mu0) / (mu0 + 1e-9) * ds * 0.3
    assert round(by_lam, 2) == 8.0 and round(by_mu, 2) == -3.0 and round(ds - by_lam - by_mu, 2) == 95.0
    from riskbook.catalog import QUERIES
    rows = QUERIES["whatif_delta"](spark, "/root/testdata/sf0.001").collect()
    still = [r for r in rows if r["d_lambda"] == 0]
    assert all(r["d_score_lambda"] == 0 for r in still)
    assert all(abs(r["d_score_lambda"] + r["d_score_mu"] + r["d_score_m"] - r["d_score"]) < 0.04 for r in rows)


def test_state_without_high_zone_keeps_its_row(spark, book):
    from riskbook.operators.portfolio import state_peril_matrix
    changed = book.withColumns({c: F.when(F.col("state") == "CA", F.lit("Low")).otherwise(F.col(c))
                                for c in ("wildfire_zone", "flood_zone", "earthquake_zone", "hail_zone")})
    rows = {r["state"]: r for r in state_peril_matrix(changed).collect()}
    assert len(rows) == book.select("state").distinct().count()
    assert rows["CA"]["wildfire_high_n"] == 0 and rows["CA"]["row_max"] is None


def test_long_scenario_list_equals_short_ones(spark, book):
    from riskbook.operators import joins as J
    cards = [{"scenario": f"s{i}", "roof_age_yr": i % 40} for i in range(205)]
    some = book.select("policy_id", "roof_age_yr").limit(7)
    long = J.scenario_cross(some, cards, ["roof_age_yr"])
    short = J.scenario_cross(some, cards[:9], ["roof_age_yr"])
    key = lambda d: sorted((r["policy_id"], r["scenario"], r["roof_age_yr"]) for r in d.collect())
    assert long.columns == short.columns and key(long.where(F.col("scenario").isin([c["scenario"] for c in cards[:9]]))) == key(short)


def test_holdout_file_preferred_over_sample(spark, book):
    from riskbook.operators.sampling import holdout_or_sample
    from riskbook.sources.io import read_policies, scratch_path, write_policies
    path = scratch_path(spark, "holdout")
    assert read_policies(spark, path) is None                  # absent file -> nothing
    part = book.where(F.col("state") == "CA")
    write_policies(part, path)
    got = holdout_or_sample(spark, book, path, n=10)
    assert got.count() == part.count()                         # the file, not a 10-row sample
    assert holdout_or_sample(spark, book, None, n=10).count() == 10


def test_single_cell_study(spark):
    rows = [("A", float(i % 3) * 100.0, 50.0) for i in range(30)]
    df = spark.createDataFrame(rows, "cell string, claim_amount double, glm_el double")
    cells = X.group_oe(df, min_group=10)
    assert cells.count() == 1
    study = X.oe_normalise(df, cells, rows_bound=1)
    tgt = X.normalised_target(df, study).select("m_target").distinct().collect()
    assert len(tgt) == 1 and tgt[0][0] == 1.0               # one cell: normalised to the mean


def test_zero_premium_band_is_null_not_error(spark):
    df = spark.createDataFrame([("Low", 10.0, 0.0), ("High", 20.0, 40.0)],
                               "risk_band string, expected_loss_true double, indicated_premium double")
    got = {r["risk_band"]: r["loss_ratio_pct"] for r in P.loss_ratio_by_band(df).collect()}
    assert got["Low"] is None and got["High"] == 50.0
