"""Structured Streaming entry points.

Only stateless operators are promised on streams: text cleaning, counterfactual
rewriting (T1-T4) and group flips and codes (P6-P8); scoring (M6) is in
:mod:`equilibra.streaming.scoring`.  None of them keeps state, so no watermark
is needed and a restarted query resumes from its checkpoint without reprocessing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import counterfactual as CF

NOTES_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("gender", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType()),
    T.StructField("none_mental", T.IntegerType())])


def read_notes_stream(spark: SparkSession, path: str, schema: T.StructType = NOTES_SCHEMA,
                      max_files_per_trigger: int = 64) -> DataFrame:
    """New parquet files of notes arriving in ``path``."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def counterfactual_stream(notes: DataFrame, flip_neutral: bool = False) -> DataFrame:
    """U1 / U2 on a stream: every arriving note becomes its three variants."""
    return CF.counterfactual_variants(notes, flip_neutral=flip_neutral)


def write_stream(df: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ("variant",),
                 available_now: bool = False) -> StreamingQuery:
    """Append parquet files; the checkpoint must live in shared storage on a cluster."""
    w = (df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
         .partitionBy(*partition_by))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(path)
