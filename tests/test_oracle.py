"""Every SQL-checkable query against its DuckDB oracle on the smallest tables."""
import math

import duckdb
import pandas as pd
import pytest

from tests.conftest import SF_SMALL

import __spark_entry__ as E

from riskbook.catalog import QUERIES

ORACLES = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    out = []
    for rec in df.itertuples(index=False):
        row = []
        for v in rec:
            if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
                row.append(None)
            elif hasattr(v, "item") and not isinstance(v, (str, bytes)):
                x = v.item()
                row.append(round(x, 6) if isinstance(x, float) else x)
            elif isinstance(v, float):
                row.append(round(v, 6))
            else:
                row.append(v)
        out.append(tuple(row))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


FAMILY = {"IntegerType()": "int32", "LongType()": "int64", "DoubleType()": "double", "StringType()": "string",
          "INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "double", "VARCHAR": "string"}


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, con, key):
    sdf = E.queries()[key](spark, SF_SMALL)
    spark_types = {f.name.lower(): FAMILY.get(str(f.dataType), str(f.dataType)) for f in sdf.schema.fields}
    duck_types = {r[0].lower(): FAMILY.get(r[1], r[1]) for r in con.execute(f"DESCRIBE ({ORACLES[key]})").fetchall()}
    assert spark_types == duck_types
    s = sdf.toPandas()
    d = con.execute(ORACLES[key]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert len(s) == len(d)
    assert _norm(s) == _norm(d)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 1 and "loss_ratio_pct" in df.columns
