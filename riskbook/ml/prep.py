"""Feature preparation shared by fitting and scoring.

Fitted state is small (encoder codes, imputation means, scaler moments) and is
applied as literal column expressions, so a scored row never leaves the JVM.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskbook.plans.features import CAT_COLS, SEV_FEATS, T3, T12, Encoder, Imputer, Scaler


@dataclass
class Prep:
    encoder: Encoder
    imputer: Imputer
    scaler: Scaler

    @staticmethod
    def fit(train: DataFrame) -> "Prep":
        enc = Encoder.fit(train, CAT_COLS)
        imp = Imputer.fit(train)
        base = enc.transform(imp.transform(train.select(*set(T12) | set(T3) | {"defensible_space_score"})))
        return Prep(enc, imp, Scaler.fit(base, T12))

    def encoded(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """Imputed + label-encoded model columns (+ ``keep`` pass-through columns)."""
        feats = list(dict.fromkeys(SEV_FEATS + ["defensible_space_score"]))
        cols = []
        for c in feats:
            x = F.col(c)
            if c in self.imputer.means:
                x = F.coalesce(x.try_cast("double"), F.lit(float(self.imputer.means[c])))
            if c in self.encoder.classes:
                x = self.encoder.code(c)
            else:  # absent: the fitted mean where there is one, else 0
                x = F.coalesce(x.cast("double"), F.lit(0.0))
            cols.append(x.cast("double").alias(c))
        return df.select(*[k for k in keep if k not in feats], *cols)

    def scaled(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """Encoded frame plus ``z_<feature>`` standardised T12 columns."""
        enc = self.encoded(df, keep)
        return enc.select("*", *[self.scaler.col(c).alias("z_" + c) for c in T12])


def assemble(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)
