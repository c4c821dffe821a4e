"""The book build: compiled methods, each hash once a row, tasks of bounded rows."""
import re

from riskbook import session
from riskbook.sources import fixture


def test_generated_methods_stay_compiled(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "65535")
        session.compiled_methods(spark)
        assert int(spark.conf.get(key)) == session.COMPILED_BYTES
        spark.conf.set(key, "20000")      # the session's own value stays
        session.compiled_methods(spark)
        assert spark.conf.get(key) == "20000"
    finally:
        spark.conf.set(key, before)


def test_stage_a_hashes_once_and_bounds_its_tasks(spark, tmp_path, monkeypatch):
    spark.range(50).selectExpr("id as o_orderkey", "id % 5 as o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(5).selectExpr("id as c_custkey", "cast(id as int) as c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(fixture, "TASK_ROWS", 2)
    features = fixture.build_features(spark, str(tmp_path))
    spark.conf.set("spark.sql.debug.maxToStringFields", "5000")
    try:
        plan = features._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    wanted = {s for layer in fixture.LAYERS for s in fixture.salts(layer)}
    assert len(re.findall(r"md5\(", plan)) == len(wanted)
    assert features.rdd.getNumPartitions() >= 25
    assert features.count() == 50


def test_partitioned_write_bounds_a_tasks_rows(spark, tmp_path):
    from riskbook.sources import io
    key, path = "spark.sql.adaptive.advisoryPartitionSizeInBytes", str(tmp_path / "book")
    df = spark.range(40_000, numPartitions=8).selectExpr("id", "sha2(cast(id as string), 512) as text", "if(id % 100 = 0, 'NV', 'CA') as state")
    spark.conf.set(key, "200000")
    try:
        io.write_policies(df, path, partition_by=["state"])
    finally:
        spark.conf.unset(key)
    files = {s: [f for f in (tmp_path / "book" / f"state={s}").iterdir() if f.suffix == ".parquet"] for s in ("CA", "NV")}
    assert len(files["CA"]) >= 4 and len(files["NV"]) == 1     # a large state in several tasks, a small one in one
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "text", "state").collect())) == sorted(map(tuple, df.collect()))
