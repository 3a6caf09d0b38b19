"""Label encoding (P8): sorted distinct values -> 0..k-1.

The code table has one row per class (a label column has few), so the window
over it is bounded by the number of classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_codes(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """(value, code) for the distinct non-null values of ``col`` in ascending order."""
    out = out or f"{col}_code"
    values = df.select(col).filter(F.col(col).isNotNull()).distinct()
    return values.select(col, (F.dense_rank().over(Window.orderBy(col)) - 1).cast("int").alias(out))


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Add the class code of ``col`` (null stays null)."""
    # broadcast or not is left to the size that the optimizer sees
    return df.join(label_codes(df, col, out), col, "left")
