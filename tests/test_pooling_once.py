"""Texts are rewritten and shuffled once for pooling; a task reads one block (F6, F8, F16 and the models' features)."""

from pyspark.sql import functions as F

from equilibra.operators import counterfactual as CF
from equilibra.operators import embeddings as E


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_variants_without_text_rewrite_nothing(spark):
    notes = spark.createDataFrame([(1, "F", "She said her"), (2, "M", "he is a man"), (3, None, "x"), (4, "F", None)],
                                  "row_id long, gender string, text string")
    v = CF.counterfactual_variants(notes)
    assert "regexp_replace" not in _plan(v.select("row_id", "variant", "gender"))
    got = {(r.row_id, r.variant): (r.gender, r.text) for r in v.collect()}
    assert len(got) == 12 and got[1, "swapped"] == ("M", "he said his") and got[2, "swapped"] == ("F", "she is a woman")
    assert got[3, "orig"] == (None, "x") and got[3, "swapped"][0] == "F" and got[4, "neutr"] == ("F", None)
    blind = {(r.row_id, r.variant): r.gender for r in CF.counterfactual_variants(notes, flip_neutral=True).collect()}
    assert blind[1, "neutr"] == "M" and blind[1, "orig"] == "F"


def test_pooling_works_a_text_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def low(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    docs = spark.createDataFrame([(i, f"aa w{i} bb") for i in range(40)], "row_id long, text string").mapInArrow(low, "row_id long, text string")
    words = spark.createDataFrame([("aa", [1.0, 0.0]), ("bb", [0.0, 2.0])], "word string, vector array<float>")
    assert {(r.n, *r.vector) for r in E.mean_pool(docs, words, size=400).collect()} == {(2, 0.5, 1.0)}
    # the shuffle of the texts and the list of keys: the words are taken from the first
    assert seen.value == 80


def test_blocks_are_dealt_evenly_and_together(spark):
    docs = spark.range(4000).select((F.col("id") % 500).alias("row_id"), F.concat(F.lit("k"), "id").alias("key"), F.lit("aa bb").alias("text"))
    p = E.string_pieces(docs, "key", F.col("text"), 8, together="row_id").withColumn("_part", F.col("_block")).repartitionById(8, F.col("_part"))
    assert p.rdd.glom().map(lambda rows: len({r._block for r in rows})).collect() == [1] * 8
    near = p.select(F.regexp_replace("_key", "k", "").cast("long").alias("id"), "_block").groupBy(F.col("id") % 500).agg(F.countDistinct("_block").alias("n"))
    assert near.filter("n > 1").count() == 0
    assert E.block_counts(spark, 0) == (1, 1)
    blocks, tasks = E.block_counts(spark, 6 << 30)
    assert blocks == tasks == (6 << 30) // E.BLOCK_BYTES
