"""Portable input views derived from the driver tables (see FIXTURES.md §2).

Each function returns a DataFrame; nothing is collected, and only the vocabulary
of ``word_vectors`` is written when it is built.  The same views
are written as SQL in :mod:`equilibra.plans.oracle_views` so a second engine can
check the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import row_number_within, string_prefix_number
from ..session import cut_lineage

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# The note prefixes of the test view (FIXTURES.md §2, `notes`).
FEMALE_PREFIX = "Sex:  F. She said her mood is low, the woman is 98 F. "
MALE_PREFIX = "Sex:  M. He said his mood is low, the man is with him. "
MENTION_SENTENCE = "History of Depression. "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_count(spark: SparkSession, sf_dir: str) -> Column:
    """Number of embedding rows (their ids run from 0), as a scalar subquery: part of the plan, no job."""
    return table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1))).scalar()


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`notes`: row_id, gender, text, lang, label, none_mental (labelled documents)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    even = (F.col("doc_id") % 2) == 0
    return (d.join(lab, "doc_id")
            .select(F.col("doc_id").alias("row_id"),
                    F.when(even, "F").otherwise("M").alias("gender"),
                    F.concat(F.when(even, F.lit(FEMALE_PREFIX)).otherwise(F.lit(MALE_PREFIX)),
                             F.when(F.col("doc_id") % 7 == 0, F.lit(MENTION_SENTENCE)).otherwise(F.lit("")),
                             F.col("text")).alias("text"),
                    F.col("lang"),
                    F.when(F.col("quality") == 0, 1).otherwise(0).alias("label"),
                    F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
                    .alias("none_mental")))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`features`: row_id, gender, label, none_mental, features array<float>."""
    n = notes(spark, sf_dir).select("row_id", "gender", "label", "none_mental")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = n.withColumn("_v", F.col("row_id") % vector_count(spark, sf_dir))
    return (n.join(e, F.col("_v") == F.col("vec_id"))
            .select("row_id", "gender", "label", "none_mental", F.col("embedding").alias("features")))


def _flip_rows() -> Column:
    # the two halves of a counterfactual prediction table, as a generator
    # (no join): the original and its gender-flipped counterpart
    return F.explode(F.array(
        F.struct(F.lit("orig").alias("variant"), F.lit(0).alias("flip")),
        F.struct(F.lit("swapped").alias("variant"), F.lit(1).alias("flip"))))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`predictions`: row_id, fold, embedding, variant, gender, label, probability, preds."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    x = e.select("*", _flip_rows().alias("v"))
    shifted = F.col("value") + F.col("v.flip") * (F.col("event_id") % 11)
    t = x.select(
        F.col("event_id").alias("row_id"),
        (F.col("event_id") % 5).cast("int").alias("fold"),
        F.when(F.col("event_id") % 3 == 0, "emb_a").otherwise("emb_b").alias("embedding"),
        F.col("v.variant").alias("variant"),
        F.when((F.col("user_id") + F.col("v.flip")) % 2 == 0, "F").otherwise("M").alias("gender"),
        F.when(F.col("event_type").isin("error", "purchase"), 1).otherwise(0).alias("label"),
        (shifted / (shifted + F.lit(50.0))).alias("probability"))
    return t.withColumn("preds", F.when(F.col("probability") >= 0.35, 1).otherwise(0))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`tokens`: row_id, word (all documents split on single spaces)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.explode(F.split("text", " ")).alias("word"))


def word_vectors(spark: SparkSession, sf_dir: str, write_numbers: bool = False) -> DataFrame:
    """`word_vectors`: word, vector; every third word (by sorted position) is left out.

    The vocabulary is numbered with a distributed row number (buckets of the
    leading UTF-8 bytes plus offsets), so no single task sees the whole vocabulary.
    The numbering reads the vocabulary several times, so it is written once;
    ``write_numbers``: the numbers too, for a caller that reads the view in more than one job.
    """
    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # repeats go before they become rows
            yield pa.RecordBatch.from_arrays([pc.split_pattern(b.column("_low").drop_null(), " ").flatten().unique()], names=["word"])

    low = table(spark, sf_dir, "documents").select(F.lower("text").alias("_low"))
    vocab = cut_lineage(low.mapInArrow(words_of, "word string").filter(F.length("word") > 0).distinct())
    numbered = (row_number_within(vocab, [], ["word"], coarse=string_prefix_number(F.col("word")), out="k")
                .withColumn("k", F.col("k") - 1))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    numbered = numbered.filter(F.col("k") % 3 != 0).withColumn("_v", F.col("k") % vector_count(spark, sf_dir))
    numbered = cut_lineage(numbered.select("word", "_v")) if write_numbers else numbered
    return (numbered.join(e, F.col("_v") == F.col("vec_id"))
            .select("word", "vector"))
