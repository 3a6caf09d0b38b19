"""equilibra: group-fairness analytics for text classifiers, written as Spark jobs.

Every operator is a DataFrame -> DataFrame function.  Positional contracts of
row-wise tools become explicit keys (``row_id``, ``variant``, ``fold``) so that
the work can be partitioned and shuffled by Spark.
"""

__version__ = "0.1.0"
