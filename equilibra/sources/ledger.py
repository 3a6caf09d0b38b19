"""What a run has finished, and its scores as an append-only log.

A run is a table of work items (rows of the key columns).  An item counts as
finished once it is listed in ``done``, which happens after its results are
written; a run that was stopped, or is started again, works on the items that
are not listed.  Results of an item that was half written are replaced, since
result tables are written by partition.

Scores are never rewritten: each write appends rows with the next ``seq``, and
reading takes the row of the largest ``seq`` per key with one aggregate.  All
tables are Parquet in the run's folder, which all executors share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RunLedger:
    """The ledger of the run in ``folder``; items are told apart by ``keys``."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str]):
        self.spark, self.folder, self.keys = spark, folder, list(keys)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}")

    def _there(self, table: str) -> DataFrame | None:
        try:
            return self.read(table)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing written yet
                return None
            raise

    def pending(self, spec: DataFrame) -> DataFrame:
        """The rows of ``spec`` whose item is not finished."""
        done = self._there("done")
        return spec if done is None else spec.join(done.select(*self.keys).distinct(), self.keys, "left_anti")

    def finish(self, items: DataFrame) -> None:
        """List items as finished."""
        items.select(*self.keys).write.mode("append").parquet(f"{self.folder}/done")

    def append_scores(self, scores: DataFrame) -> None:
        """Append score rows with the next sequence number."""
        log = self._there("scores")
        last = None if log is None else log.agg(F.max("seq")).first()[0]
        scores.withColumn("seq", F.lit((last or 0) + 1).cast("bigint")).write.mode("append").parquet(f"{self.folder}/scores")

    def latest_scores(self, keys: Sequence[str]) -> DataFrame:
        """The last written row per key."""
        log, keys = self.read("scores"), list(keys)
        rest = [c for c in log.columns if c not in (*keys, "seq")]
        last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_last"))
        return last.select(*keys, "_last.*")
