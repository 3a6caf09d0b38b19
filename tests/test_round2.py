"""Caps removed, sinks that keep other partitions, stable ids, gates for any number of folds."""

import types

import pytest
from pyspark.sql import functions as F

from equilibra import session
from equilibra.functions.stats import t_pvalue
from equilibra.operators import mitigation as MI
from equilibra.plans.mitigation_queries import T_TABLE
from equilibra.sources import io, views

SF = "/root/testdata/sf0.001"


def test_every_embedding_is_used(spark):
    sf = "/root/testdata/sf0.1"
    n = views.table(spark, sf, "embeddings").count()
    used = views.word_vectors(spark, sf).select(F.xxhash64("vector")).distinct().count()
    assert used == views.table(spark, sf, "embeddings").select(F.xxhash64("embedding")).distinct().count() > 500 and n > 500
    assert views.features(spark, sf).join(views.table(spark, sf, "embeddings").filter("vec_id >= 500"),
                                          F.col("features") == F.col("embedding")).count() > 0


def test_sinks_keep_other_partitions(spark, tmp_path):
    p = str(tmp_path / "pred")
    rows = lambda m, v: spark.createDataFrame([(m, "e", 0, "test", v)], "method string, embedding string, fold int, split string, v int")
    io.write_predictions(rows("orig", 1), p)
    io.write_predictions(rows("neutr", 2), p)
    io.write_predictions(rows("neutr", 3), p)
    assert {(r.method, r.v) for r in spark.read.parquet(p).collect()} == {("orig", 1), ("neutr", 3)}


def test_note_ids_do_not_depend_on_packing(spark, tmp_path):
    (tmp_path / "n.csv").write_text("TEXT,GENDER,DEPRESSION_majority,None-mental\n" + "".join(
        f'"note {i % 7}\nline",F,0,1\n' for i in range(40)))
    a = io.read_notes_csv(spark, str(tmp_path / "n.csv"))
    ids = [r.row_id for r in a.collect()]
    assert len(set(ids)) == 40
    assert sorted(ids) == sorted(r.row_id for r in io.read_notes_csv(spark, str(tmp_path / "n.csv")).repartition(5).collect())


def test_t_table_and_p_values_agree(spark):
    rows = [(t, float(df), 0.05) for df, t in enumerate(T_TABLE, 1)] + [(1.96, 1e6, 0.05), (0.0, 3.0, 1.0), (1.0, 1.0, 0.5), (None, 2.0, None), (1.0, 0.0, None),
                                                                        (float("inf"), 2.0, 0.0)]
    for r in spark.createDataFrame(rows, "t double, df double, p double").withColumn("got", t_pvalue("t", "df")).collect():
        assert r.got is None if r.p is None else abs(r.got - r.p) < 1e-4, r


def test_gate_with_300_folds(spark):
    rows = [(m, "e", f, 0.5 + 0.1 * (m == "b") + (f % 7) * 0.01 * (1 + (m == "b")), 0.5) for m in ("orig", "b") for f in range(300)]
    s = spark.createDataFrame(rows, "method string, embedding string, fold int, f1_f double, f1_m double")
    got = {r.gender: (r.best_method, r.chosen) for r in MI.participatory_choice(s, ["orig", "b"]).collect()}
    assert got["F"] == ("b", "b") and got["M"][1] == "orig"


def test_no_local_checkpoint_folder_on_a_cluster():
    fake = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None),
                                 sparkContext=types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(fake)
