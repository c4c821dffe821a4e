"""Models grown each by itself from broadcast rows are those of the passes."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskbook.ml import trees as T

NAMES = ["a", "b", "c"]
JOBS = [T.Job("rf", "forest", "y", ("b", "a", "c"), 11, 6, 8, train_only=True, seed=4), T.Job("rf1", "forest", "y", ("c", "b"), 5, 3, 5, fold=1, seed=9),
        T.Job("et", "extra", "y", ("a", "b", "c"), 9, 6, 8, seed=2), T.Job("none", "extra", "y", ("a",), 0, 3, 5),
        T.Job("gbt", "boost", "y", tuple(NAMES), 40, 4, 12, 0.5, 1.0, 6, train_only=True, seed=3), T.Job("gbt0", "boost", "z", ("b", "c"), 6, 3, 20, 0.5, 0.0, fold=0, seed=1)]


@pytest.fixture(scope="module")
def fit(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"a": rng.integers(0, 4, 900).astype(float), "b": rng.normal(size=900), "c": rng.integers(0, 300, 900).astype(float),
                          "fold": rng.integers(0, 3, 900), "train": rng.random(900) < 0.7, "h": rng.integers(-2**62, 2**62, 900)})
    frame["y"] = np.where(frame["b"] > 0.3, 2.0, 0.0) + 0.5 * frame["a"] + rng.normal(size=900) / 5
    frame["z"] = frame["c"] / 100 + rng.normal(size=900)
    made = T.Fit(spark.createDataFrame(frame).withColumn("fold", F.col("fold").cast("int")).repartition(3), NAMES, ["y", "z"], fine=200, coarse=20)
    yield made
    made.close()


@pytest.mark.parametrize("stop_rows", [100, 10_000])
def test_the_same_models_without_passes(fit, monkeypatch, stop_rows):
    monkeypatch.setattr(T, "STOP_ROWS", stop_rows)
    monkeypatch.setattr(T, "FOREST_TREES", 4)
    monkeypatch.setattr(T, "WHOLE_BYTES", 0)
    want = fit.models(JOBS)
    monkeypatch.setattr(T, "WHOLE_BYTES", fit.n * fit.row_bytes)
    passes = []
    monkeypatch.setattr(T.Fit, "added", lambda self, work: passes.append(work))
    got = fit.models(JOBS)
    assert not passes and got.keys() == want.keys()
    for job in JOBS:
        a, b = want[job.name], got[job.name]
        assert (a.features, a.kind, a.feature.shape) == (b.features, b.kind, b.feature.shape)
        assert (a.feature == b.feature).all() and np.array_equal(a.threshold, b.threshold)
        assert a.base == b.base and np.array_equal(a.value, b.value) and np.array_equal(a.gain, b.gain)
    if stop_rows == 100:
        assert len(got["gbt"].feature) < 40                       # stopped early
    assert len(got["none"].feature) == 0


def test_bytes_of_the_rows_are_those_that_are_broadcast(fit):
    assert sum(len(x) for row in fit.blocks.collect() for x in row[1:]) == fit.n * fit.row_bytes


def test_rows_are_summed_by_block():
    rows = T._Rows((4, bytes(4), bytes(4), np.arange(4.0).tobytes(), bytes(32), b"\1" * 4, bytes(32)), ["y"])
    assert [x.tolist() for x in rows.by_block(np.array([0, 2, 3]))] == [[0, 2, 3]]
    rows.starts = np.array([0, 2, 2, 3])
    assert [x.tolist() for x in rows.by_block(np.array([0, 2, 3]))] == [[0], [2], [3]]
    assert rows.by_block(np.array([], dtype=int)) == []
