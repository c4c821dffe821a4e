"""What passes of the tree fits send to the driver."""
import numpy as np
import pandas as pd

from riskbook.ml import trees


def test_sums_reach_the_driver_exactly():
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=1000), np.zeros(0), np.array([[1.5, -0.0], [np.inf, 5e-324]]), np.array([np.nan])):
        got = trees._received(trees._sent(x))
        assert got.shape == x.shape and got.tobytes() == x.tobytes()


def test_histograms_take_less_than_their_bytes():
    rng = np.random.default_rng(4)
    count = np.floor(rng.exponential(20, 100_000)) * (rng.random(100_000) < 0.7)
    x = np.concatenate([np.where(count > 0, rng.normal(size=100_000), 0.0), count])
    assert len(trees._sent(x)[1]) < 0.55 * x.nbytes


def test_sample_comes_in_small_pieces():
    frame = pd.DataFrame(np.arange(3000.0).reshape(1000, 3))
    pieces = [x for f in trees._packed(iter([frame, frame.iloc[:0]])) for x in f["x"]]
    assert max(map(len, pieces)) <= trees.PACKED_ROWS * 3 * 8
    assert np.array_equal(np.frombuffer(b"".join(pieces)).reshape(-1, 3), frame.to_numpy())
