"""Sources, sinks and the streaming rewrite on small files written by the tests."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from equilibra.functions import text as T
from equilibra.sources import io
from equilibra.streaming import rewrite


def _tmp():
    return tempfile.mkdtemp(prefix="equilibra-test-", dir="/tmp")


def test_symptom_lexicon_list_and_dict(spark):
    d = _tmp()
    p1, p2 = os.path.join(d, "a.json"), os.path.join(d, "b.json")
    with open(p1, "w") as f:
        json.dump({"context": "[depression] is a synonym of depression.", "depression": ["low mood", "apathy"]}, f)
    with open(p2, "w") as f:
        json.dump({"context": "[depression] is x.", "depression": {"mood": ["sad"], "drive": ["apathy", "tired"]}}, f)
    a = io.read_symptom_lexicon(spark, p1)
    assert sorted(r.term for r in a.collect()) == ["apathy", "low mood"]
    s = a.select(T.context_sentence("term", "context").alias("s")).orderBy("s").first().s
    assert s == "apathy is a synonym of depression."
    b = io.read_symptom_lexicon(spark, p2)
    assert sorted((r.subtype, r.term) for r in b.collect()) == [("drive", "apathy"), ("drive", "tired"), ("mood", "sad")]


def test_gender_lexicon_sections(spark):
    d = _tmp()
    p = os.path.join(d, "terms.txt")
    with open(p, "w", encoding="utf-8") as f:
        f.write("Female: Male\n‘zij’: ‘hij’\n‘ze’: ‘hij’\n\n"
                "Gendered: Genderneutral\n‘hij’: ‘diegene’\n")
    rows = io.read_gender_lexicon(spark, p).orderBy("line_no").collect()
    assert [(r.from_term, r.to_term, r.direction) for r in rows] == [
        ("zij", "hij", "female_to_male"), ("ze", "hij", "female_to_male"), ("hij", "diegene", "neutral")]


def test_wide_features_and_word_vectors(spark):
    d = _tmp()
    p = os.path.join(d, "wide.csv")
    with open(p, "w") as f:
        f.write(",outcome,GENDER,0,1,2\n0,1,0,0.5,1.5,2.5\n1,0,1,1.0,2.0,3.0\n")
    df = io.read_wide_features(spark, p, 3, keep=["outcome", "GENDER"])
    assert "Unnamed: 0" not in df.columns and "_c0" not in df.columns
    assert [list(r.features) for r in df.orderBy("outcome").collect()] == [[1.0, 2.0, 3.0], [0.5, 1.5, 2.5]]
    t = os.path.join(d, "wv.txt")
    with open(t, "w") as f:
        f.write("he 0.1 0.2\nshe 0.3 0.4\n")
    wv = io.read_word_vectors(spark, t, fmt="text").orderBy("word").collect()
    assert wv[0].word == "he" and abs(wv[1].vector[1] - 0.4) < 1e-6


def test_write_if_absent_keeps_first(spark):
    d = os.path.join(_tmp(), "out")
    io.write_if_absent(spark.range(3), d)
    io.write_if_absent(spark.range(10), d)
    assert spark.read.parquet(d).count() == 3


def test_counterfactual_stream_available_now(spark):
    src, out, ck = _tmp(), _tmp(), _tmp()
    spark.createDataFrame([(1, "F", "She is here", 1, 0), (2, "M", "He saw him", 0, 1)],
                          rewrite.NOTES_SCHEMA).write.mode("overwrite").parquet(os.path.join(src, "b1"))
    stream = rewrite.counterfactual_stream(rewrite.read_notes_stream(spark, os.path.join(src, "b1")))
    q = rewrite.write_stream(stream, out, ck, available_now=True)
    q.awaitTermination(120)
    res = spark.read.parquet(out)
    assert res.count() == 6
    sw = {r.row_id: r.text for r in res.filter(F.col("variant") == "swapped").collect()}
    assert sw == {1: "he is here", 2: "she saw her"}


def test_notes_csv_multiline(spark):
    d = _tmp()
    p = os.path.join(d, "notes.csv")
    with open(p, "w") as f:
        f.write('TEXT,GENDER,DEPRESSION_majority,None-mental\n"Line one\nline ""two""",F,1,0\n"x",M,0,1\n')
    rows = io.read_notes_csv(spark, p).orderBy("gender").collect()
    assert rows[0].text == 'Line one\nline "two"' and rows[0].label == 1 and rows[1].none_mental == 1
    assert len({r.row_id for r in rows}) == 2


def test_partitioned_predictions_and_split_read(spark):
    d = os.path.join(_tmp(), "preds")
    df = spark.createDataFrame([("orig", "e", 0, "test", 1, "orig", "x", 0.3),
                                ("orig", "e", 1, "test", 2, "orig", "x", 0.6)],
                               "method string, embedding string, fold int, split string, row_id long,"
                               " variant string, phenotype string, probability double")
    io.write_predictions(df, d, ("method", "embedding", "fold", "split"))
    back = io.read_split(spark, d, "test", "orig", "x", 1)
    assert [r.row_id for r in back.collect()] == [2]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_ranking_csv(spark):
    d = _tmp()
    p = os.path.join(d, "shap.csv")
    with open(p, "w") as f:
        f.write(",Feature,score,Absolute_Score\n4,Feature_5,0.2,0.2\n1,Feature_2,0.5,0.5\n")
    rows = io.read_ranking_csv(spark, p).orderBy("rank").collect()
    assert [(r.feature_idx, r.rank) for r in rows] == [(1, 1), (4, 2)]


def test_alignment_names_every_violation(spark):
    from equilibra.sources import alignment
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (None, "e")], "k int, x string")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0), (4, 4.0)], "k int, y double")
    assert [tuple(r) for r in alignment.aligned(a, b, "k").collect()] == [(1, "a", 1.0)]
    got = {r.k: (r.left_rows, r.right_rows, r.problem) for r in alignment.violations(a, b, "k").collect()}
    assert got == {2: (2, 1, "duplicate"), 3: (1, 0, "missing right"), 4: (0, 1, "missing left"), None: (1, 0, "null key")}


def test_ledger_lists_items_and_keeps_the_last_score(spark, tmp_path):
    from equilibra.sources.ledger import RunLedger
    led = RunLedger(spark, str(tmp_path / "run"), ["method", "fold"])
    spec = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "method string, fold int")
    assert led.pending(spec).count() == 3
    led.finish(spec.filter("method = 'a' and fold = 0"))
    led.finish(spec.filter("method = 'a' and fold = 0"))
    assert sorted(tuple(r) for r in led.pending(spec).collect()) == [("a", 1), ("b", 0)]
    score = lambda f, v: spark.createDataFrame([("a", f, v)], "method string, fold int, f1 double")
    for f, v in ((0, 0.1), (1, 0.2), (0, 0.3), (1, None)):
        led.append_scores(score(f, v))
    assert sorted(tuple(r) for r in led.latest_scores(["method", "fold"]).collect()) == [("a", 0, 0.3), ("a", 1, None)]
    assert led.read("scores").count() == 4


def test_rankings_that_are_there_stay(spark, tmp_path):
    at = str(tmp_path / "rank")
    row = lambda fold, score: spark.createDataFrame([("pearson", fold, "e", 0, score, 1)], "explainer string, fold int, embedding string, feature_idx int, score double, rank int")
    io.write_rankings(row(0, 0.5), at)
    io.write_rankings(row(0, 0.9).unionByName(row(1, 0.7)), at)
    assert [r.score for r in io.read_rankings(spark, at, fold=0).collect()] == [0.5] and io.read_rankings(spark, at).count() == 2
