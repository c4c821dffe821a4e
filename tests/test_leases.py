"""Scratch folders go with the last that holds them."""
from pyspark.sql import functions as F

from riskbook import session as S
from riskbook.operators import joins as J
from riskbook.operators.curves import gini_desc
from riskbook.plans import features as FE


def exists(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def test_folders_go_at_the_end_of_the_lease_unless_held(spark, book):
    with S.lease(spark) as outer:
        with S.lease(spark) as inner:
            assert gini_desc(book, "total_loss", "expected_loss_true") > 0
            df = S.materialize(spark.range(5), "kept")
            kept = S.hold(inner[-1])
            assert inner and all(exists(spark, p) for p in inner) and df.count() == 5
        assert not any(exists(spark, p) for p in inner if p != kept) and exists(spark, kept) and not outer
        S.release(spark, kept)
        assert not exists(spark, kept)
        try:
            with S.lease(spark) as failed:
                S.materialize(spark.range(3), "lost")
                raise OSError
        except OSError:
            assert not exists(spark, failed[0])


def test_book_outlives_the_report_that_asked_first(spark):
    from riskbook import catalog
    key = (spark.sparkContext.applicationId, "/root/testdata/sf0.001")
    catalog._BOOKS.pop(key, None)
    old = catalog._FOLDERS.pop(key, None)
    with S.lease(spark):
        n = catalog.book(spark, key[1]).count()
    assert catalog.book(spark, key[1]).count() == n
    path = catalog._FOLDERS[key]
    if old:  # other tests read the first book
        S.release(spark, path)
        catalog._FOLDERS[key] = old
        catalog._BOOKS[key] = spark.read.parquet(old)
    else:
        assert exists(spark, path)


def test_dictionary_codes_equal_the_encoder(spark):
    rows = [(k, f"v{(k * 7) % 900}" if k % 50 else None, "x") for k in range(2_000)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    table = FE.fit_dictionary(df, ["a", "b"])
    enc = FE.Encoder.fit(df, ["a", "b"])
    assert sorted(map(tuple, table.collect())) == sorted((c, v, i) for c, v, i in enc.to_rows())
    other = df.unionByName(spark.createDataFrame([(9_999, "unseen", "y")], df.schema))
    got = {r["id"]: (r["a"], r["b"]) for r in FE.encode_by(other, table, ["a", "b"]).collect()}
    want = {r["id"]: (r["a"], r["b"]) for r in enc.transform(other).collect()}
    assert got == want and got[9_999] == (0, 0)


def test_scenarios_of_any_number_join_by_number(spark, book):
    some = book.limit(20).select("policy_id", "roof_age_yr")
    assert J.scenario_cross(some, [], ["roof_age_yr"]).count() == 0
    cards = [{"scenario": f"s{i}", "roof_age_yr": i if i else None} for i in range(300)]
    out = J.scenario_cross(some, cards, ["roof_age_yr"])
    assert out.count() == 6_000 and out.where("scenario = 's0'").join(some, ["policy_id", "roof_age_yr"]).count() == 20
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.where(F.col("scenario") == "s7").select(F.max("roof_age_yr")).first()[0] == 7
