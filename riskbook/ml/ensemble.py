"""M-hat ensemble (M6, M7) and display frequency / severity models.

Three learners on the tier 3 features (random forest, boosted trees, extremely randomised trees), the same
three lighter on each fold's complement, a ridge over the out-of-fold predictions and an isotonic
calibration. All trees come from ``riskbook.ml.trees``: one binning, boosted models of all folds and the
display models grow side by side, forests of all folds together, or each apart where rows are few. Ridge is solved from one aggregate of
second moments; isotonic regression is pooled over ranges.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from riskbook.functions.columns import clip
from riskbook.ml.isotonic import apply_isotonic, fit_isotonic
from riskbook.ml.trees import Fit, Job, Model
from riskbook.plans.features import SEV_FEATS, T3, T12

M_CLIP = (0.10, 8.00)
LEARNERS = ("rf", "gbt", "et")


@dataclass
class EnsembleParams:
    """Sizes of the learners (fixed values: those of the reference's models)."""
    rf_trees: int = 300
    rf_depth: int = 7
    min_leaf: int = 30
    gbt_iter: int = 400
    gbt_depth: int = 5
    gbt_step: float = 0.04
    gbt_l2: float = 1.0
    et_trees: int = 300
    oof_rf_trees: int = 150
    oof_gbt_iter: int = 200
    oof_gbt_depth: int = 4
    oof_gbt_step: float = 0.06
    oof_gbt_leaf: int = 20
    oof_et_trees: int = 150
    display_iter: int = 500
    display_depth: int = 5
    display_step: float = 0.03
    display_l2: float = 1.5
    freq_leaf: int = 30
    sev_leaf: int = 25
    leaves: int = 31
    folds: int = 5
    ridge_alpha: float = 1.0
    max_bins: int = 255
    forest_bins: int = 64
    seed: int = 42


@dataclass
class MHatModel:
    base: dict[str, Model]
    weights: np.ndarray            # ridge, in the order of LEARNERS
    intercept: float
    points: np.ndarray             # isotonic
    values: np.ndarray
    params: EnsembleParams = field(default_factory=EnsembleParams)

    def predict(self, x: np.ndarray) -> np.ndarray:
        base = np.stack([self.base[k].predict(x) for k in LEARNERS], axis=1)
        return np.clip(apply_isotonic(self.points, self.values, base @ self.weights + self.intercept), *M_CLIP)

    def transform(self, encoded: DataFrame, out: str = "m_hat") -> DataFrame:
        """Add ``out`` = clip(isotonic(ridge(rf, gbt, et)), 0.10, 8.0), in Arrow batches."""
        return encoded.withColumn(out, _column(encoded, self, T3))

    def base_learners(self, encoded: DataFrame) -> DataFrame:
        """Add p_rf, p_gbt, p_et."""
        return encoded.withColumns({f"p_{k}": _column(encoded, self.base[k], T3) for k in LEARNERS})

    def swapped(self, encoded: DataFrame, values: dict[str, float], out: str = "swapped") -> DataFrame:
        """Add ``out``: M-hat of the row, then with each T3 feature replaced by its entry of ``values``."""
        shared = encoded.sparkSession.sparkContext.broadcast((self, [float(values[f] or 0.0) for f in T3]))

        @pandas_udf("array<double>")
        def every(*columns: pd.Series) -> pd.Series:
            model, given = shared.value
            x = np.stack([c.to_numpy(dtype=np.float64) for c in columns], axis=1)
            found = [model.predict(x)]
            for j, v in enumerate(given):
                other = x.copy()
                other[:, j] = v
                found.append(model.predict(other))
            return pd.Series(list(np.stack(found, axis=1)))

        return encoded.withColumn(out, every(*[F.col(f).cast("double") for f in T3]))


def _column(df: DataFrame, model, features):
    shared = df.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def value(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(dtype=np.float64) for c in columns], axis=1)
        return pd.Series(shared.value.predict(x))

    return value(*[F.col(f).cast("double") for f in features])


@dataclass
class DisplayModels:
    """Boosted trees for lambda (T12) and mu (all features), feeding score A2 only."""
    freq: Model
    sev: Model

    def transform(self, encoded: DataFrame, lam_cap: float = 0.30) -> DataFrame:
        return encoded.withColumns({"lambda_disp": clip(_column(encoded, self.freq, T12), 0.005, lam_cap),
                                    "mu_disp": clip(_column(encoded, self.sev, SEV_FEATS), 1000.0, 500000.0)})


def jobs_of(p: EnsembleParams) -> tuple[list[Job], list[Job]]:
    """(forests, boosted models)."""
    t3, m = tuple(T3), "m_target"
    forests = [Job("rf", "forest", m, t3, p.rf_trees, p.rf_depth, p.min_leaf, train_only=True, seed=p.seed),
               Job("et", "extra", m, t3, p.et_trees, p.rf_depth, p.min_leaf, train_only=True, seed=p.seed)]
    boosted = [Job("gbt", "boost", m, t3, p.gbt_iter, p.gbt_depth, p.min_leaf, p.gbt_step, p.gbt_l2, p.leaves, train_only=True, seed=p.seed)]
    for f in range(p.folds):
        forests += [Job(f"rf{f}", "forest", m, t3, p.oof_rf_trees, p.rf_depth, p.min_leaf, fold=f, seed=f),
                    Job(f"et{f}", "extra", m, t3, p.oof_et_trees, p.rf_depth, p.min_leaf, fold=f, seed=f)]
        boosted.append(Job(f"gbt{f}", "boost", m, t3, p.oof_gbt_iter, p.oof_gbt_depth, p.oof_gbt_leaf, p.oof_gbt_step, 0.0, p.leaves, fold=f, seed=f))
    boosted += [Job("freq", "boost", "lambda_true", tuple(T12), p.display_iter, p.display_depth, p.freq_leaf, p.display_step, p.display_l2, p.leaves, train_only=True, seed=p.seed),
                Job("sev", "boost", "mu_true", tuple(SEV_FEATS), p.display_iter, p.display_depth, p.sev_leaf, p.display_step, p.display_l2, p.leaves, train_only=True, seed=p.seed)]
    return forests, boosted


def out_of_fold(stack: DataFrame, models: dict[str, Model], folds: int) -> DataFrame:
    """(p_rf, p_gbt, p_et, m_target): each row's predictions by the models that haven't seen its fold."""
    shared = stack.sparkSession.sparkContext.broadcast({(k, f): models[f"{k}{f}"] for k in LEARNERS for f in range(folds)})

    def run(frames):
        for frame in frames:
            x, fold = frame[T3].to_numpy(dtype=np.float64), frame["fold"].to_numpy()
            out = np.zeros((len(frame), len(LEARNERS)))
            for f in np.unique(fold):
                out[fold == f] = np.stack([shared.value[k, int(f)].predict(x[fold == f]) for k in LEARNERS], axis=1)
            yield pd.DataFrame(out, columns=[f"p_{k}" for k in LEARNERS]).assign(m_target=frame["m_target"].to_numpy())

    rows = stack.select(*[F.col(c).cast("double").alias(c) for c in T3], "fold", F.col("m_target").cast("double").alias("m_target"))
    return rows.mapInPandas(run, "p_rf double, p_gbt double, p_et double, m_target double")


def fit_ridge(df: DataFrame, columns: list[str], label: str, alpha: float) -> tuple[np.ndarray, float]:
    """(weights, intercept) that minimise |y - a - Xw|^2 + alpha |w|^2, from one aggregate."""
    cols = [*columns, label]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in cols], *[F.covar_pop(a, b) for a, b in pairs]).first()
    n, means = row[0], np.array(row[1:1 + len(cols)], dtype=float)
    cov = np.zeros((len(cols), len(cols)))
    for (a, b), v in zip(pairs, row[1 + len(cols):], strict=True):
        cov[cols.index(a), cols.index(b)] = cov[cols.index(b), cols.index(a)] = v or 0.0
    w = np.linalg.solve(n * cov[:-1, :-1] + alpha * np.eye(len(columns)), n * cov[:-1, -1])
    return w, float(means[-1] - means[:-1] @ w)


def fit_ensemble(stack: DataFrame, p: EnsembleParams = EnsembleParams()) -> tuple[MHatModel, DisplayModels]:
    """M6, M7 and M10 from train and validation rows: T3 and T12 features, ``m_target``, ``lambda_true``,
    ``mu_true``, ``fold`` (0..k-1), ``train`` (boolean) and ``h`` (hash of the key)."""
    forests, boosted = jobs_of(p)
    fit = Fit(stack, SEV_FEATS, ["m_target", "lambda_true", "mu_true"], p.max_bins, p.forest_bins)
    try:
        models = fit.models(forests + boosted)
    finally:
        fit.close()
    oof = out_of_fold(stack, models, p.folds).persist(StorageLevel.MEMORY_AND_DISK)
    weights, intercept = fit_ridge(oof, [f"p_{k}" for k in LEARNERS], "m_target", p.ridge_alpha)
    line = F.lit(intercept)
    for k, w in zip(LEARNERS, weights, strict=True):
        line = line + F.lit(float(w)) * F.col(f"p_{k}")
    points, values = fit_isotonic(oof.select(line.alias("x"), "m_target"), "x", "m_target")
    oof.unpersist()
    return MHatModel({k: models[k] for k in LEARNERS}, weights, intercept, points, values, p), DisplayModels(models["freq"], models["sev"])


def tree_importances(model: MHatModel) -> list[tuple[str, str, float]]:
    """M14 (trees): share of the gain per T3 feature for each base learner."""
    return [(name, f, float(v)) for name in LEARNERS for f, v in zip(T3, model.base[name].importances(), strict=True)]
