"""A fitted linear model and its use (M1, M5, M6, M8).

A model is a standardiser, a coefficient per feature, an intercept and a
calibration line: a few d-sized vectors, so the models of all folds, groups and
steps are one small table, and their rows are scored in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _dot(vector: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(vector, weights, lambda x, w: x.cast("double") * w), F.lit(0.0),
                       lambda acc, t: acc + t)


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _decisions(df: DataFrame, margin: Column, slope: Column, offset: Column, preds: str, probability: str,
               drop: Sequence[str] = ()) -> DataFrame:
    keep = [c for c in df.columns if c not in (preds, probability, "margin", *drop)]
    m = df.withColumn("margin", margin)
    return m.select(*keep, (F.col("margin") > 0).cast("int").alias(preds), "margin",
                    (F.lit(1.0) / (F.lit(1.0) + F.exp(-(slope * F.col("margin") + offset)))).alias(probability))


@dataclass(frozen=True)
class LinearModel:
    """One fitted model: coefficients on standardised features and the calibration line."""

    c: float
    mean: tuple[float, ...]
    scale: tuple[float, ...]   # 1 / standard deviation, 0 for a constant feature
    coef: tuple[float, ...]
    intercept: float
    slope: float = 1.0         # probability = sigmoid(slope * margin + offset)
    offset: float = 0.0

    @property
    def weights(self) -> list[float]:
        """Coefficients on the raw features."""
        return [b * s for b, s in zip(self.coef, self.scale)]

    @property
    def bias(self) -> float:
        return self.intercept - sum(m * w for m, w in zip(self.mean, self.weights))

    def margin(self, features: str = "features") -> Column:
        return _dot(F.col(features), _numbers(self.weights)) + F.lit(self.bias)

    def standardise(self, df: DataFrame, features: str = "features", out: str = "z") -> DataFrame:
        """M1: the features on the scale of the training rows."""
        centred = F.zip_with(F.col(features), _numbers(self.mean), lambda x, m: x.cast("double") - m)
        return df.withColumn(out, F.zip_with(centred, _numbers(self.scale), lambda x, s: x * s))

    def transform(self, df: DataFrame, preds: str = "preds", probability: str = "probability",
                  features: str = "features") -> DataFrame:
        """M6: add preds (0/1), the SVM margin and the calibrated probability."""
        return _decisions(df, self.margin(features), F.lit(self.slope), F.lit(self.offset), preds, probability)


MODEL_COLUMNS = "weights array<double>, bias double, slope double, offset double"


def model_table(spark: SparkSession, models: dict[tuple, LinearModel], keys: str) -> DataFrame:
    """The models as a table: the key columns declared by ``keys`` (such as ``"fold int"``) and MODEL_COLUMNS."""
    rows = [(*k, m.weights, m.bias, m.slope, m.offset) for k, m in models.items()]
    return spark.createDataFrame(rows, f"{keys}, {MODEL_COLUMNS}")


def score_by_table(models: DataFrame, df: DataFrame, keys: Sequence[str], features: str = "features",
                   preds: str = "preds", probability: str = "probability") -> DataFrame:
    """M6 / M8: every row scored by the models of its key; key columns that only ``models`` has multiply the rows."""
    inner = [f.split()[0] for f in MODEL_COLUMNS.split(", ")]
    m = models.withColumnsRenamed({c: f"_{c}" for c in inner})
    j = df.join(m, list(keys))
    return _decisions(j, _dot(F.col(features), F.col("_weights")) + F.col("_bias"), F.col("_slope"), F.col("_offset"),
                      preds, probability, drop=[f"_{c}" for c in inner])


def score(models: dict[tuple, LinearModel], df: DataFrame, keys: Sequence[str], extra: str = "",
          features: str = "features", preds: str = "preds", probability: str = "probability") -> DataFrame:
    """M6 / M8: every row scored by the model of its key, in one pass.

    ``models`` maps (keys..., extra...) to a model; ``extra`` declares key columns
    that ``df`` lacks (for instance ``"step int"``): a row then gets one output
    row per model of its key.  The broadcast table has one d-sized row per model.
    """
    declared = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ([extra] if extra else []))
    table = F.broadcast(model_table(df.sparkSession, models, declared))
    return score_by_table(table, df, keys, features, preds, probability)


def group_routed(models: dict[str, LinearModel], test: DataFrame, group: str = "gender") -> DataFrame:
    """M8: each row scored by the model of its (possibly counterfactual) group."""
    return score({(g,): m for g, m in models.items()}, test, [group])
