"""One classifier at a time with MLlib (M1, M2, M5).

The studies' runs train many models on the same rows and use
:mod:`.batched`; this is the plain form for a single model, and what the
batched solver is tested against:

* M1: ``StandardScaler(withMean, withStd)`` fit on the training rows.
* M2: ``LinearSVC`` with weight ``n / (2 n_c)`` per class (``balanced``) times any
  sample weight; the C-parameterised hinge objective maps to
  ``regParam = 1 / (C * sum(weights))``.
* M5: probability = logistic regression on the SVM margin (Platt scaling).

The data is never collected; the standardised rows are cached once for all fits on them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import LinearModel, _dot, _numbers

# The C grids of the two study configurations.
C_GRID = (0.01, 0.1, 1.0, 10.0)
C_GRID_STUDY1 = (0.01, 0.1, 1.0, 10.0, 100.0)

TOLERANCE = 1e-3  # the usual default of SVM libraries; MLlib's own is 1e-6


@dataclass(frozen=True)
class TrainingRows:
    """Standardised, weighted rows of one training set, cached while fits share them."""

    rows: DataFrame            # _zv, _y, _w
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weight_sum: float

    def fit(self, c: float, keep: Sequence[int] | None = None, max_iter: int = 100, tol: float = TOLERANCE) -> LinearModel:
        """M2: the SVM of one C; with ``keep`` only those features, the others get coefficient 0.

        Dropping a feature leaves the others' scale as it is, so one cached copy
        serves every step of a remove-and-retrain run.
        """
        z, col = self.rows, "_zv"
        idx = list(range(len(self.mean))) if keep is None else list(keep)
        if keep is not None:
            z, col = VectorSlicer(inputCol="_zv", outputCol="_zs", indices=idx).transform(z), "_zs"
        svm = LinearSVC(featuresCol=col, labelCol="_y", weightCol="_w", regParam=1.0 / (c * self.weight_sum),
                        standardization=False, maxIter=max_iter, tol=tol).fit(z)
        coef = [0.0] * len(self.mean)
        for i, b in zip(idx, svm.coefficients.toArray()):
            coef[i] = float(b)
        return LinearModel(c, self.mean, self.scale, tuple(coef), float(svm.intercept))

    def calibrated(self, model: LinearModel) -> LinearModel:
        """M5: the sigmoid of the training rows' margins."""
        margin = _dot(vector_to_array("_zv"), _numbers(model.coef)) + F.lit(model.intercept)
        cal = LogisticRegression(featuresCol="_mv", labelCol="_y", regParam=0.0, maxIter=100).fit(
            self.rows.select("_y", array_to_vector(F.array(margin)).alias("_mv")))
        return replace(model, slope=float(cal.coefficients[0]), offset=float(cal.intercept))


@contextmanager
def training_rows(train: DataFrame, label: str = "label", weight: str | None = None,
                  features: str = "features", balanced: bool = True) -> Iterator[TrainingRows]:
    """M1 / M2: fit the standardiser once and cache the standardised rows with their weights."""
    base = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = train.select(F.col(label).alias("_label"), base.alias("_base"), array_to_vector(F.col(features)).alias("_fv"))
    # per-class count and sample-weight sum: one aggregate of (#labels) rows
    cls = {r[0]: (r[1], r[2]) for r in x.groupBy("_label").agg(F.count(F.lit(1)), F.sum("_base")).collect()}
    n = sum(k for k, _ in cls.values())
    cw = {y: n / (2.0 * k) if balanced else 1.0 for y, (k, _) in cls.items()}
    weight_sum = sum(cw[y] * sw for y, (_, sw) in cls.items()) or 1.0
    class_weight = F.create_map(*[F.lit(v) for y in cw for v in (y, cw[y])])[F.col("_label")]
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="_fv", outputCol="_zv").fit(x)
    z = scaler.transform(x).select("_zv", F.col("_label").cast("double").alias("_y"),
                                   (class_weight * F.col("_base")).alias("_w")).cache()
    try:
        yield TrainingRows(z, tuple(map(float, scaler.mean)),
                           tuple(1.0 / s if s > 0 else 0.0 for s in map(float, scaler.std)), weight_sum)
    finally:
        z.unpersist()


def fit_linear(train: DataFrame, c: float, label: str = "label", weight: str | None = None,
               features: str = "features", max_iter: int = 100, balanced: bool = True) -> LinearModel:
    with training_rows(train, label, weight, features, balanced) as t:
        return t.calibrated(t.fit(c, max_iter=max_iter))
