import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("riskbook-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="riskbook-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def book(spark):
    from riskbook.catalog import book as cached_book
    return cached_book(spark, SF_SMALL)


@pytest.fixture(scope="session", autouse=True)
def small_ensemble():
    """Registered model queries fit a small ensemble in tests."""
    from riskbook import catalog_ml
    from riskbook.ml.ensemble import EnsembleParams
    catalog_ml.PARAMS = EnsembleParams(rf_trees=8, gbt_iter=5, et_trees=8, oof_rf_trees=4, oof_gbt_iter=3, oof_et_trees=4,
                                       display_iter=4, max_bins=16, forest_bins=16)
    return catalog_ml.PARAMS


@pytest.fixture(scope="session")
def bundle(book, small_ensemble):
    """One small fitted model bundle shared by the model and API tests."""
    from riskbook.ml.score import train_all
    return train_all(book, small_ensemble)
