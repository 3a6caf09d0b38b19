"""A corpus pipeline from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``; the last returns each document's ids.

Defined results: null texts, empty texts and texts without letters are
rejected by language ID; extra columns travel with their rows; an empty table
stays empty through every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equilibra.llm import byte_bpe, language, mixing, simhash, toxicity
from equilibra.llm.common import fresh, read_table
from equilibra.llm.queries import tokenizer
from equilibra.session import ensure_checkpoint_dir

LEAST_LANGUAGE = 0.3   # share of a text's n-grams that its language must explain


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; the others go."""
    model = language.train(docs, ~language.held_out(F.col("doc_id")))
    if model is None:
        return docs.where(F.lit(False))
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    out = language.predict(docs, model, "text", lang, score)
    return out.where((F.col(lang) != language.UND) & (F.col(score) >= LEAST_LANGUAGE)).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    score = fresh(docs, "toxic_score")
    return toxicity.score(docs, model, "text", score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every document of the mix."""
    path, pattern = tokenizer()
    out = byte_bpe.round_trip(docs.select("doc_id", "text"), path, pattern)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids",
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

# trained models, SimHash's XXH64 and the tokenizer have no SQL form
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        at = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
