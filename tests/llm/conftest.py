import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, an extra column with a clashing name."""
    long = " ".join(f"word{i % 977} the of and ing" for i in range(6000))
    rows = [(1, "the cat sat on the mat and the dog", "en", "a", 1), (1, "the cat sat on the mat and the dog", "en", "a", 1),
            (2, None, "en", "a", None), (3, "", None, None, 0), (4, long, "en", "b", len(long)),
            (5, long + " end", "en", "b", None), (None, "der hund und die katze sind im haus", "de", None, 5),
            (None, None, None, None, None), (6, "12 34 !!", "de", "c", 8), (7, "der hund und die katze sind im haus", "de", "c", 5),
            (8, "x", "en", "a", 1), (9, "日本語 ﬁ \U0001F600 <|im_end|>", "de", "c", 3)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F
    return df.withColumn("score", F.lit("kept")).withColumn("fp", F.lit(7)).withColumn("draw", F.lit(8))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
