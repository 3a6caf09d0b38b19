"""Scoring a stream of rows by a versioned table of models (M6, M8).

A model table has a row per key (group, fold, ...) and version.  A stream scores
with one version, fixed when it starts, so a batch that is replayed after a
failure gives the same rows.  Each micro-batch replaces the folder named by its
number: replaying one adds no row.  Scoring keeps no state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import linear as LI


def latest_version(spark: SparkSession, path: str) -> int:
    """The newest version of the model table, 0 if there is none."""
    try:
        return spark.read.parquet(path).agg(F.max("version")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing published yet
            return 0
        raise


def publish_models(models: DataFrame, path: str) -> int:
    """Add models (keys and ``linear.MODEL_COLUMNS``) as the next version; earlier ones stay."""
    version = latest_version(models.sparkSession, path) + 1
    models.write.parquet(f"{path}/version={version}")
    return version


def read_models(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("version") == version)


def write_scored_batch(rows: DataFrame, batch: int, models: DataFrame, keys: Sequence[str], path: str) -> None:
    """One micro-batch: score and put in the place of what the batch wrote before."""
    scored = LI.score_by_table(models, rows, keys).drop("features")
    scored.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def score_keyed_stream(features: DataFrame, models_path: str, keys: Sequence[str], path: str, checkpoint: str,
                       version: int | None = None, available_now: bool = False) -> StreamingQuery:
    """Rows of ``features`` scored by the model of their key; rows of a key without a model give none.

    ``version``: the newest one when the stream starts, unless given.  Give it
    when a stream is restarted with a batch under way.
    """
    spark = features.sparkSession
    version = version or latest_version(spark, models_path)
    if not version:
        raise ValueError(f"no models in {models_path}")

    def sink(rows: DataFrame, batch: int) -> None:
        # a batch has a session of its own
        write_scored_batch(rows, batch, read_models(rows.sparkSession, models_path, version), keys, path)

    w = features.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
