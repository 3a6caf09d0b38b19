"""Phrases from a table, term vectors, principal directions per encoder, counted medians, keyed stream scoring."""

import random

import numpy as np
import pytest

from equilibra.operators import embeddings as E
from equilibra.operators import linear as LI
from equilibra.operators import ordered
from equilibra.operators import phrases as PH
from equilibra.streaming import scoring

LEX = "from_term string, to_term string, line_no int"


def _rewritten(text, rules):
    """The longest phrase at every word, from left to right."""
    first = {}
    for source, target, _ in sorted(rules, key=lambda r: r[2]):
        if source:
            first.setdefault(source.lower(), target or "")
    words, out, i = text.split(" "), [], 0
    while i < len(words):
        for n in range(len(words) - i, 0, -1):
            if " ".join(words[i:i + n]).lower() in first:
                out.append(first[" ".join(words[i:i + n]).lower()])
                i += n
                break
        else:
            out.append(words[i])
            i += 1
    return " ".join(out)


def test_rewrite_equals_brute_force_in_one_and_in_many_blocks(spark):
    rnd = random.Random(3)
    rules = [(" ".join(rnd.choice("abCd") for _ in range(rnd.randint(1, 4))), f"<{i}>", i) for i in range(25)]
    rules += [("z z", None, 90), ("", "never", 91), (None, "never", 92)]
    texts = [" ".join(rnd.choice(["a", "B", "c", "d", "e", "", "z"]) for _ in range(rnd.randint(1, 40))) for _ in range(150)]
    texts += ["", " ", "a b", "a b", "z z z", "a " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "row_id long, text string")
    lex = spark.createDataFrame(rules, LEX)
    want = {i: _rewritten(t, rules) for i, t in enumerate(texts)} | {999: None}
    for size, small in ((PH.BLOCK_BYTES, 0), (200, 0), (PH.BLOCK_BYTES, 1000)):
        got = {r.row_id: r.rewritten for r in PH.rewrite_phrases(docs, lex, block_bytes=size, small=small).collect()}
        assert got == want


def test_rewrite_with_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "row_id long, text string")
    none = spark.createDataFrame([], LEX)
    for small in (-1, 0):
        assert {tuple(r) for r in PH.rewrite_phrases(docs, none, small=small).collect()} == {(1, "a b"), (2, None)}
    assert PH.rewrite_phrases(docs.limit(0), spark.createDataFrame([("a", "x", 1)], LEX)).count() == 0


def test_the_first_listed_target_wins(spark):
    docs = spark.createDataFrame([(1, "Hij zag de Oude Man staan")], "row_id long, text string")
    lex = spark.createDataFrame([("hij", "zij", 1), ("hij", "ze", 2), ("oude man", "oude vrouw", 3), ("man", "vrouw", 4)], LEX)
    assert PH.rewrite_phrases(docs, lex).first().rewritten == "zij zag de oude vrouw staan"


def _term_inputs(spark):
    chunks = spark.createDataFrame([(1, 0, 0, "low mood and Low", 4), (1, 1, 0, "low mood low mood", 4), (2, 0, 0, None, 0)],
                                   "row_id long, para int, chunk int, chunk_text string, n_words int")
    v = {"low": [1.0, 0.0], "mood": [0.0, 3.0]}
    rows = [(r.row_id, r.para, r.chunk, i + 1, v[w.lower()]) for r in chunks.collect()
            for i, w in enumerate((r.chunk_text or "").split(" ")) if w.lower() in v]
    rows += [(1, 0, 0, 0, [50.0, 50.0]), (1, 1, 0, 0, [50.0, 50.0])]  # opening tokens never count
    tv = spark.createDataFrame(rows, "row_id long, para int, chunk int, pos int, vector array<double>")
    terms = spark.createDataFrame([("s", "low"), ("s", "Low Mood"), ("t", "low"), ("t", "mood low mood"), ("t", "and"), ("t", None)],
                                  "category string, term string")
    return chunks, tv, terms


def test_term_vectors_by_span(spark):
    got = {(r.category, r.term): (r.n, r.vector) for r in PH.term_vectors(*_term_inputs(spark)).collect()}
    assert got == {("s", "low"): (4, [1.0, 0.0]), ("t", "low"): (4, [1.0, 0.0]), ("s", "Low Mood"): (3, [0.5, 1.5]),
                   ("t", "mood low mood"): (1, [pytest.approx(1 / 3), 2.0])}


def test_one_word_terms_may_take_the_whole_chunk(spark):
    got = {(r.category, r.term): r.vector for r in PH.term_vectors(*_term_inputs(spark), first_token_if_single=False).collect()}
    assert got[("s", "low")] == pytest.approx([(2 / 3 * 2 + 0.5 * 2) / 4, (1.0 * 2 + 1.5 * 2) / 4]) and got[("s", "Low Mood")] == [0.5, 1.5]
    assert ("t", "and") in got  # a word without a vector has its chunk's


def test_principal_directions_of_encoders_of_different_sizes(spark):
    rng = np.random.default_rng(4)
    data = {"a": rng.normal(size=(60, 7)) * np.arange(1, 8) + 5, "b": rng.normal(size=(40, 3)) * [3, 2, 1]}
    rows = [(e, v.tolist()) for e, m in data.items() for v in m] + [("a", None), ("flat", [2.0, 2.0]), ("flat", [2.0, 2.0])]
    got = E.principal_directions(spark.createDataFrame(rows, "encoder string, diff array<double>"), ["encoder"], 5).collect()
    assert {e: sum(r.encoder == e for r in got) for e in ("a", "b", "flat")} == {"a": 5, "b": 3, "flat": 2}
    for e, m in data.items():
        cov = np.cov(m.T, bias=True)
        values = np.linalg.eigvalsh(cov)[::-1]
        for r in (r for r in got if r.encoder == e):
            v = np.array(r.direction)
            assert np.abs(cov @ v - values[r.component - 1] * v).max() < 1e-9 and abs(v @ v - 1) < 1e-12
            assert v[np.abs(v).argmax()] > 0 and r.explained_variance == pytest.approx(values[r.component - 1] / values.sum())
    assert all(r.explained_variance is None for r in got if r.encoder == "flat")


def test_principal_direction_agrees_with_one_pca(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("x", v.tolist()) for v in rng.normal(size=(20, 6))], "encoder string, diff array<double>")
    pc, share = E.gender_direction(df, k=3)
    got = E.principal_directions(df, ["encoder"], 3).orderBy("component").collect()
    assert got[0].direction == pytest.approx(pc) and [r.explained_variance for r in got] == pytest.approx(share)


def test_median_of_a_hot_value_counts_it_once(spark):
    rows = [("k", 0.0)] * 3000 + [("k", float(i)) for i in range(1, 3002)] + [(None, 4.0), (None, 8.0), ("n", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.median for r in ordered.median_by(df, ["k"], "v", buckets=8).collect()}
    assert got == {"k": 1.0, None: 6.0}
    assert ordered.median_by(df, [], "v").first().median == 2.0  # 6003 values in all


def _models(spark, w):
    return spark.createDataFrame([("F", w, 0.5, 1.0, 0.0), ("M", [-x for x in w], 0.0, 1.0, 0.0)], "gender string, " + LI.MODEL_COLUMNS)


def test_stream_equals_batch_and_a_replayed_batch_adds_no_row(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("models", "in", "out", "ck", "ck2", "out2")}
    rows = spark.createDataFrame([(i, "FMX"[i % 3], [float(i), 1.0]) for i in range(30)], "row_id long, gender string, features array<double>")
    rows.repartition(4).write.parquet(at["in"])
    assert scoring.latest_version(spark, at["models"]) == 0
    with pytest.raises(ValueError):
        scoring.score_keyed_stream(rows, at["models"], ["gender"], at["out"], at["ck"])
    assert scoring.publish_models(_models(spark, [1.0, -5.0]), at["models"]) == 1
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at["in"])
    scoring.score_keyed_stream(stream(), at["models"], ["gender"], at["out"], at["ck"], available_now=True).awaitTermination(120)
    first = scoring.read_models(spark, at["models"], 1)
    cols = ["row_id", "gender", "margin", "preds", "probability"]
    want = sorted(tuple(r) for r in LI.score_by_table(first, rows, ["gender"]).select(*cols).collect())
    got = lambda p: sorted(tuple(r) for r in spark.read.parquet(p).select(*cols).collect())
    assert len(want) == 20 and got(at["out"]) == want  # no model for X
    batch = spark.read.parquet(at["out"]).groupBy("batch").count().orderBy("batch").first().batch
    again = [r.row_id for r in spark.read.parquet(at["out"]).filter(f"batch = {batch}").collect()]
    scoring.write_scored_batch(rows.filter(rows.row_id.isin(again)), batch, first, ["gender"], at["out"])
    assert got(at["out"]) == want
    assert scoring.publish_models(_models(spark, [2.0, 0.0]), at["models"]) == 2
    scoring.score_keyed_stream(stream(), at["models"], ["gender"], at["out2"], at["ck2"], version=1, available_now=True).awaitTermination(120)
    assert got(at["out2"]) == want
