"""Trees, ridge and isotonic regression against plain NumPy on the same draws."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskbook.ml import trees as T
from riskbook.ml.ensemble import fit_ridge
from riskbook.ml.isotonic import apply_isotonic, fit_isotonic, pooled

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": rng.integers(0, 4, 500).astype(float), "b": rng.normal(size=500).round(2), "c": rng.integers(0, 60, 500).astype(float),
                          "fold": rng.integers(0, 3, 500), "train": rng.random(500) < 0.7, "h": rng.integers(-2**62, 2**62, 500)})
    frame["y"] = np.where(frame["b"] > 0.3, 2.0, 0.0) + 0.5 * frame["a"] + 0.01 * frame["c"] + rng.normal(size=500) / 5
    fit = T.Fit(spark.createDataFrame(frame).withColumns({"fold": F.col("fold").cast("int")}).repartition(3), NAMES, ["y"], fine=40, coarse=12)
    yield frame, fit
    fit.close()


def plain_tree(job, bins, x, y, weights, number):
    """One tree by loops over nodes, features and bins; rows of weight 0 don't count."""
    codes = bins.codes(x)
    tree = T.Tree.empty(job.depth)

    def grow(node, rows, level):
        w = weights[rows]
        g, n = (w * y[rows]).sum(), w.sum()
        tree.value[node] = -job.step * g / (n + job.l2) if job.kind == "boost" else g / n
        if level == job.depth or len(rows) < 2 * job.min_leaf:
            return
        best = (1e-12 * max(1.0, abs(g)), None)
        for j, name in enumerate(job.features):
            code = codes[rows, NAMES.index(name)].astype(int)
            tried = range(len(bins.edges[name]))
            if job.kind == "extra":
                lo, hi = code.min(), code.max()
                value = bins.typical[name]
                u = float(T.uniform(job.seed, number, np.array([node]), j)[0])
                at = np.searchsorted(bins.edges[name], value[lo] + u * (value[hi] - value[lo]), side="left")
                tried = [int(np.clip(at, lo, max(hi - 1, lo)))] if hi > lo else []
            for b in tried:
                left = rows[code <= b]
                right = rows[code > b]
                if min(len(left), len(right)) < job.min_leaf:
                    continue
                score = lambda r: (weights[r] * y[r]).sum() ** 2 / (weights[r].sum() + job.l2)
                gain = score(left) + score(right) - score(rows)
                if gain > best[0] + 1e-9:
                    best = (gain, (j, b, left, right))
        if best[1]:
            j, b, left, right = best[1]
            tree.feature[node], tree.bin[node], tree.gain[node] = j, b, best[0]
            grow(2 * node + 1, left, level + 1)
            grow(2 * node + 2, right, level + 1)

    grow(0, np.flatnonzero(weights > 0), 0)
    return tree


def same(model, k, tree, bins, job):
    assert model.feature[k].tolist() == tree.feature.tolist()
    edges = [np.append(bins.edges[f], np.inf) for f in job.features]
    split = np.flatnonzero(tree.feature >= 0)
    assert model.threshold[k][split].tolist() == [edges[tree.feature[n]][tree.bin[n]] for n in split]
    leaf = [n for n in range(len(tree.feature)) if tree.feature[n] < 0 and (n == 0 or tree.feature[(n - 1) // 2] >= 0)]
    assert np.allclose(model.value[k][leaf], tree.value[leaf], atol=1e-9)


@pytest.mark.parametrize("kind", ["forest", "extra"])
def test_forests_equal_plain_numpy(data, kind, monkeypatch):
    frame, fit = data
    monkeypatch.setattr(T, "PASS_BYTES", 60_000)  # several batches
    jobs = [T.Job("m", kind, "y", ("b", "a", "c"), 12, 7, 10, train_only=True, seed=4), T.Job("f1", kind, "y", ("c", "b"), 5, 3, 5, fold=1, seed=9)]
    models = fit.forests(jobs)
    for job in jobs:
        usable = ((frame["fold"] != job.fold) & (frame["train"] | (not job.train_only))).to_numpy()
        for k in range(job.trees):
            weights = T.bootstrap(frame["h"].to_numpy(), job.seed, k) * usable if kind == "forest" else usable.astype(float)
            same(models[job.name], k, plain_tree(job, fit.bins[kind], frame[NAMES], frame["y"].to_numpy(), weights.astype(float), k), fit.bins[kind], job)
        x = frame[list(job.features)].to_numpy()
        codes = fit.bins[kind].codes(frame[NAMES])[:, [NAMES.index(f) for f in job.features]]
        m = models[job.name]
        tree = T.Tree(m.feature[0], np.array([np.searchsorted(fit.bins[kind].edges[job.features[f]], t) if f >= 0 else 0 for f, t in zip(m.feature[0], m.threshold[0])]), m.value[0], m.gain[0])
        one = T.Model(m.features, m.kind, 0.0, m.feature[:1], m.threshold[:1], m.value[:1], m.gain[:1])
        assert np.allclose(one.predict(x), tree.value[tree.node_of(codes, job.depth)])


@pytest.mark.parametrize("stop", [False, True])
def test_boosting_equals_plain_numpy(data, stop, monkeypatch):
    frame, fit = data
    monkeypatch.setattr(T, "SNAPSHOT", 4)
    monkeypatch.setattr(T, "STOP_ROWS", 100 if stop else 10_000)
    jobs = [T.Job("m", "boost", "y", tuple(NAMES), 14, 4, 12, 0.2, 1.0, 9, train_only=True, seed=3), T.Job("f0", "boost", "y", ("b", "c"), 40 if stop else 6, 2, 20, 0.5, 0.0, fold=0, seed=1)]
    models = fit.boosted(jobs)
    for job in jobs:
        usable = ((frame["fold"] != job.fold) & (frame["train"] | (not job.train_only))).to_numpy()
        held = T.held_out(frame["h"].to_numpy(), job.seed) & usable & stop
        usable &= ~held
        y, codes = frame["y"].to_numpy(), fit.bins["boost"].codes(frame[NAMES])[:, [NAMES.index(f) for f in job.features]]
        pred, losses, k = np.full(len(y), y[usable].mean()), [], 0
        assert np.isclose(models[job.name].base, y[usable].mean())
        while k < job.trees:
            if stop:
                losses.append(-0.5 * ((pred - y)[held] ** 2).mean())
                if T._should_stop(losses):
                    break
            tree = plain_tree(job, fit.bins["boost"], frame[NAMES], pred - y, usable.astype(float), k)
            if (tree.feature >= 0).sum() >= job.leaves:
                order, front = [], [0]
                while front and len(order) < job.leaves - 1:
                    node = max(front, key=lambda n: (tree.gain[n], -n))
                    front.remove(node)
                    order.append(node)
                    front += [c for c in (2 * node + 1, 2 * node + 2) if c < len(tree.feature) and tree.feature[c] >= 0]
                cut = [n for n in range(len(tree.feature)) if n not in order]
                tree.feature[cut] = -1
            same(models[job.name], k, tree, fit.bins["boost"], job)
            pred = pred + tree.value[tree.node_of(codes, job.depth)]
            k += 1
        assert len(models[job.name].feature) == k
        assert np.allclose(models[job.name].predict(frame[list(job.features)].to_numpy()), pred)
        assert models[job.name].importances().sum() == pytest.approx(1)


def test_a_worker_without_its_cache_gets_the_same_predictions(data):
    frame, fit = data
    job = T.Job("m", "boost", "y", tuple(NAMES), 9, 3, 12, 0.2, 1.0, train_only=True)
    layout = T.Layout.of(job, fit.bins["boost"])
    rows = T._Rows(fit.blocks.first(), ["y"])
    found = fit.boosted([job])["m"]
    trees = [T.Tree(f, np.array([np.searchsorted(fit.bins["boost"].edges[NAMES[j]], t) if j >= 0 else 0 for j, t in zip(f, h)]), v, g)
             for f, h, v, g in zip(found.feature, found.threshold, found.value, found.gain)]
    whole = T._predictions(("x", 0, 0), rows, job, layout, found.base, trees[:4], 4, trees[4:])
    T._predictions(("y", 0, 0), rows, job, layout, found.base, [], 0, trees[:6])
    grown = T._predictions(("y", 0, 0), rows, job, layout, found.base, trees[:4], 4, trees[4:])
    assert np.allclose(whole, grown)


def test_ridge_and_isotonic_equal_numpy(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.normal(size=(300, 2)), columns=["u", "v"])
    frame["y"] = 2 * frame["u"] - frame["v"] + 5 + rng.normal(size=300)
    w, a = fit_ridge(spark.createDataFrame(frame), ["u", "v"], "y", 3.0)
    x, y = frame[["u", "v"]].to_numpy(), frame["y"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 3.0 * np.eye(2), xc.T @ yc)
    assert np.allclose(w, want) and np.isclose(a, y.mean() - x.mean(0) @ want)
    frame["p"] = (frame["u"] * 4).round() / 4
    for parts in (1, 3, 20):
        points, values = fit_isotonic(spark.createDataFrame(frame), "p", "y", parts)
        kinds = np.unique(frame["p"])
        level = {k: frame["y"][frame["p"] == k].to_numpy() for k in kinds}
        # min-max formula of the isotonic fit
        mean = lambda i, j: np.concatenate([level[k] for k in kinds[i:j + 1]]).mean()
        best = [max(min(mean(i, j) for j in range(m, len(kinds))) for i in range(m + 1)) for m in range(len(kinds))]
        assert np.allclose(apply_isotonic(points, values, kinds), best)
        assert apply_isotonic(points, values, np.array([-99.0, 99.0])).tolist() == [values[0], values[-1]]
    empty = fit_isotonic(spark.createDataFrame(frame).limit(0), "p", "y", 3)
    assert len(empty[0]) == 0 and pooled([]) == []


def test_empty_and_constant_rows(spark):
    schema = "a double, b double, c double, y double, fold int, train boolean, h long"
    empty = T.Fit(spark.createDataFrame([], schema), NAMES, ["y"])
    jobs = [T.Job("f", "forest", "y", ("a",), 2, 3, 1), T.Job("e", "extra", "y", ("a",), 2, 3, 1)]
    assert empty.forests(jobs)["f"].predict(np.zeros((2, 1))).tolist() == [0.0, 0.0]
    assert empty.boosted([T.Job("b", "boost", "y", ("a",), 2, 3, 1)])["b"].predict(np.zeros((2, 1))).tolist() == [0.0, 0.0]
    same_rows = T.Fit(spark.createDataFrame([(1.0, 1.0, 1.0, 5.0, 0, True, k) for k in range(40)], schema), NAMES, ["y"])
    assert np.allclose(same_rows.boosted([T.Job("b", "boost", "y", ("a",), 2, 3, 1)])["b"].predict(np.ones((2, 1))), 5.0)
    assert np.allclose(same_rows.forests(jobs)["e"].predict(np.ones((1, 1))), 5.0)


def test_a_forest_pass_sends_the_driver_no_more_from_many_tasks(spark, data, monkeypatch):
    """Histograms of all tasks together stay within PASS_BYTES; the trees don't depend on it."""
    frame, small = data
    rows = pd.concat([frame] * 60, ignore_index=True).assign(h=lambda x: x["h"] + x.index)
    fit = T.Fit(spark.createDataFrame(rows).withColumns({"fold": F.col("fold").cast("int")}).repartition(7), NAMES, ["y"], fine=40, coarse=12)
    jobs = [T.Job("m", "forest", "y", ("a", "b", "c"), 12, 4, 10, seed=4)]
    want = fit.forests(jobs)["m"]
    one = 24 * T.Layout.of(jobs[0], fit.bins["forest"]).width * 4      # a tree's histograms
    sent, added = [], T.Fit.added
    monkeypatch.setattr(T, "PASS_BYTES", 3 * fit.n_parts * one)
    monkeypatch.setattr(T.Fit, "added", lambda self, work: sent.append(added(self, work)) or sent[-1])
    got = fit.forests(jobs)["m"]
    fit.close()
    assert fit.n_parts > 1 and max(x.nbytes for x in sent) * fit.n_parts <= T.PASS_BYTES
    assert max(x.nbytes for x in sent) > one                            # several trees at once all the same
    assert (got.feature == want.feature).all() and np.array_equal(got.threshold, want.threshold) and np.allclose(got.value, want.value)
