"""Sources and sinks.

Readers take explicit schemas (no inference) and return lazy DataFrames;
writers are partitioned parquet (the partition columns replace the file-name
templates of row-wise tools, so later reads prune partitions).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOTE_SCHEMA = T.StructType([
    T.StructField("TEXT", T.StringType()), T.StructField("GENDER", T.StringType()),
    T.StructField("DEPRESSION_majority", T.IntegerType()), T.StructField("None-mental", T.IntegerType())])


def _write_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace the partitions that ``df`` holds rows of; all others stay."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))


def read_notes_csv(spark: SparkSession, path: str, schema: T.StructType = NOTE_SCHEMA,
                   key: str = "row_id") -> DataFrame:
    """Quoted, multi-line CSV notes -> (row_id, gender, text, label, none_mental).

    The row id hashes the record's content, the file's name and a count of equal
    records, so it depends neither on file packing nor on partitions: later
    stages pair rows by key, not by position.
    """
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
          .option("quote", '"').option("escape", '"').csv(path))
    from pyspark.sql import Window
    record = F.xxhash64(F.element_at(F.split(F.input_file_name(), "/"), -1), *[F.col(f"`{c}`") for c in df.columns])
    df = df.withColumn("_record", record)
    nth = F.row_number().over(Window.partitionBy("_record").orderBy("_record"))  # equal records only
    df = df.withColumn(key, F.xxhash64("_record", nth)).drop("_record")
    return df.select(key, F.col("GENDER").alias("gender"), F.col("TEXT").alias("text"),
                     F.col("DEPRESSION_majority").alias("label"), F.col("None-mental").alias("none_mental"))


def read_wide_features(spark: SparkSession, path: str, dim: int, keep: Sequence[str] = (),
                       drop: Sequence[str] = ("Unnamed: 0", "_c0")) -> DataFrame:
    """Wide CSV with vector columns '0'..'d-1' -> ``features array<float>`` plus ``keep`` columns."""
    df = spark.read.option("header", True).csv(path)
    for d in drop:
        if d in df.columns:
            df = df.drop(d)
    vec = F.array(*[F.col(f"`{i}`").cast("float") for i in range(dim)])
    return df.select(*keep, vec.alias("features"))


def write_features(df: DataFrame, path: str, partition_by: Sequence[str] = ("embedding", "variant")) -> None:
    """S2 sink: parquet partitioned by embedding and variant."""
    _write_partitions(df, path, partition_by)


def read_split(spark: SparkSession, path: str, split: str, variant: str, phenotype: str, fold: int) -> DataFrame:
    """S3: one pre-split set = a filter on partition columns (pruned at the scan)."""
    df = spark.read.parquet(path)
    return df.filter((F.col("split") == split) & (F.col("variant") == variant)
                     & (F.col("phenotype") == phenotype) & (F.col("fold") == fold))


def write_predictions(df: DataFrame, path: str,
                      partition_by: Sequence[str] = ("method", "embedding", "fold", "split")) -> None:
    """S4 sink."""
    _write_partitions(df, path, partition_by)


def write_scores(df: DataFrame, path: str, partition_by: Sequence[str] = ("split", "method")) -> None:
    """S5 / S12 sink."""
    _write_partitions(df, path, partition_by)


def write_if_absent(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Keep an existing result (``mode('ignore')``)."""
    df.write.mode("ignore").format(fmt).save(path)


RANKING_SCHEMA = T.StructType([
    T.StructField("_c0", T.IntegerType()), T.StructField("Feature", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("Absolute_Score", T.DoubleType())])


def read_ranking_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ranking CSV (first column unnamed = original feature index) -> (feature_idx, score, rank)."""
    df = spark.read.schema(RANKING_SCHEMA).option("header", True).csv(path)
    idx = F.regexp_extract("Feature", r"Feature_(\d+)", 1).cast("int") - 1
    from pyspark.sql import Window
    w = Window.orderBy(F.col("Absolute_Score").desc(), idx)  # one ranking: d rows
    return df.select(idx.alias("feature_idx"), "score", F.col("Absolute_Score").alias("abs_score"),
                     F.row_number().over(w).alias("rank"))


RANKING_KEYS = ("explainer", "fold", "embedding")


def write_rankings(df: DataFrame, path: str) -> None:
    """S6 / S10 sink: rankings by explainer, fold and embedding; a key that is there already stays as it is."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(*RANKING_KEYS).distinct()
        df = df.join(F.broadcast(done), list(RANKING_KEYS), "left_anti")  # a row per ranking
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    df.write.mode("append").partitionBy(*RANKING_KEYS).parquet(path)


def read_rankings(spark: SparkSession, path: str, **keys) -> DataFrame:
    """The rankings of the given keys (explainer=..., fold=..., embedding=...), partitions pruned."""
    df = spark.read.parquet(path)
    for k, v in keys.items():
        df = df.filter(F.col(k) == v)
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header (word-bias table, bias summary)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_symptom_lexicon(spark: SparkSession, path: str, category: str = "depression") -> DataFrame:
    """JSON lexicon -> (category, subtype, term, context).

    ``category`` holds either a list of terms or a dict of lists (subtype -> terms).
    """
    raw = spark.read.option("multiLine", True).text(path, wholetext=True)
    j = raw.select(F.get_json_object("value", "$.context").alias("context"),
                   F.get_json_object("value", f"$.{category}").alias("body"))
    as_list = F.from_json("body", "array<string>")
    as_map = F.from_json("body", "map<string,array<string>>")
    lst = j.select("context", F.lit(None).cast("string").alias("subtype"), F.explode(as_list).alias("term")) \
        .filter(F.col("term").isNotNull())
    mp = j.select("context", F.explode(as_map).alias("subtype", "terms")) \
        .select("context", "subtype", F.explode("terms").alias("term"))
    both = lst.unionByName(mp)
    return both.select(F.lit(category).alias("category"), "subtype", "term", "context")


def read_gender_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Two-section term list of quoted 'a': 'b' lines (typographic or plain quotes)
    -> (from_term, to_term, direction, line_no)."""
    lines = spark.read.text(path).select(F.col("value").alias("line"),
                                         F.monotonically_increasing_id().alias("line_no"))
    q = "[‘’'\"]"
    pat = f"^\\s*{q}([^‘’'\"]+){q}\\s*:\\s*{q}([^‘’'\"]+){q}"
    from pyspark.sql import Window
    is_header = ~F.col("line").rlike(pat) & F.col("line").contains(":")
    w = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a short file
    sec = lines.withColumn("_hdr", F.when(is_header, F.col("line"))) \
        .withColumn("_section", F.last("_hdr", ignorenulls=True).over(w))
    pairs = sec.filter(F.col("line").rlike(pat))
    direction = F.when(F.lower("_section").contains("neutral"), "neutral").otherwise("female_to_male")
    return pairs.select(F.regexp_extract("line", pat, 1).alias("from_term"),
                        F.regexp_extract("line", pat, 2).alias("to_term"), direction.alias("direction"), "line_no")


def read_word_vectors(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(word, vector array<float>) from parquet, or from text lines 'word v1 v2 ...'."""
    if fmt == "parquet":
        return spark.read.parquet(path).select("word", F.col("vector").cast("array<float>"))
    parts = F.split(F.trim(F.col("value")), " ")
    return spark.read.text(path).select(F.element_at(parts, 1).alias("word"),
                                        F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.cast("float"))
                                        .alias("vector"))
