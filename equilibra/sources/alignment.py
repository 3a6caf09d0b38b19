"""Rows of two tables put side by side, one to one, by key.

One grouped pass over both tables finds the pairs and what breaks the
contract: a key that one side lacks or holds more than once.  Nothing is
aligned by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row per key: the number of rows and one row of each side."""
    def side(df: DataFrame, own: str, name: str) -> DataFrame:
        body = F.struct(*[c for c in df.columns if c != key]) if len(df.columns) > 1 else F.struct(F.lit(1).alias("_"))
        return df.select(key, body.alias(own)).withColumn("_side", F.lit(name))
    both = side(left, "_left", "left").unionByName(side(right, "_right", "right"), allowMissingColumns=True)
    # a side's rows of a key come down to a count and one of them, map-side
    return both.groupBy(key).agg(*[F.sum(F.when(F.col("_side") == s, 1).otherwise(0)).alias(f"_{s[0]}") for s in ("left", "right")],
                                 F.max("_left").alias("_left"), F.max("_right").alias("_right"))


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows whose key both sides hold exactly once."""
    ok = _sides(left, right, key).filter((F.col("_l") == 1) & (F.col("_r") == 1) & F.col(key).isNotNull())
    return ok.select(key, *[F.col(f"_left.{c}").alias(c) for c in left.columns if c != key],
                     *[F.col(f"_right.{c}").alias(c) for c in right.columns if c != key])


def violations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, left_rows, right_rows, problem) of all other keys."""
    s = _sides(left, right, key).filter((F.col("_l") != 1) | (F.col("_r") != 1) | F.col(key).isNull())
    problem = (F.when(F.col(key).isNull(), "null key").when(F.col("_l") == 0, "missing left").when(F.col("_r") == 0, "missing right")
               .otherwise("duplicate"))
    return s.select(key, F.col("_l").alias("left_rows"), F.col("_r").alias("right_rows"), problem.alias("problem"))
