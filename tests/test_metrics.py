"""Metric edge cases and properties (A3, A4, A9, A10, H1/H2, ordered prefix)."""

import random

from pyspark.sql import functions as F

from equilibra.functions.stats import t_pvalue
from equilibra.operators import metrics, ordered, summary


def test_f1_macro_when_label_one_absent(spark):
    df = spark.createDataFrame([("a", "F", 0, 0), ("a", "F", 0, 0)], "k string, gender string, label int, preds int")
    r = metrics.group_metrics(df, ["k"]).filter("gender = 'ALL'").first()
    assert r.f1_pos == 0.0 and r.f1_neg == 1.0 and r.f1 == 1.0
    assert r.tpr is None


def _auc_ref(labels, scores):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y != 1]
    if not pos or not neg:
        return None
    u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return u / (len(pos) * len(neg))


def test_auc_matches_pairwise_definition(spark):
    rnd = random.Random(7)
    rows = [("g%d" % (i % 3), rnd.randint(0, 1), round(rnd.random(), 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, label int, probability double")
    got = {r.k: r.auc for r in metrics.auc(df, ["k"], buckets=5).collect()}
    for k in ("g0", "g1", "g2"):
        sub = [(y, s) for kk, y, s in rows if kk == k]
        assert abs(got[k] - _auc_ref([y for y, _ in sub], [s for _, s in sub])) < 1e-12


def test_auc_one_class_is_null_and_negation(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.3)], "k string, label int, probability double")
    assert metrics.auc(df, ["k"]).first().auc is None
    rows = [("a", i % 2, (i * 37 % 11) / 11.0) for i in range(50)]
    d = spark.createDataFrame(rows, "k string, label int, probability double")
    a = metrics.auc(d, ["k"]).first().auc
    b = metrics.auc(d.withColumn("probability", -F.col("probability")), ["k"]).first().auc
    assert abs(a + b - 1) < 1e-12


def test_mismatch_direction_ties_to_f(spark):
    rows = [("a", 1, "orig", "F", 1), ("a", 1, "swapped", "M", 0),
            ("a", 2, "orig", "M", 1), ("a", 2, "swapped", "F", 0)]
    df = spark.createDataFrame(rows, "k string, row_id long, variant string, gender string, preds int")
    r = metrics.counterfactual_mismatch(df, ["k"]).first()
    assert (r.mismatch, r.mismatch_f, r.mismatch_m, r.mismatch_direction) == (2, 1, 1, "F")
    assert r.mismatch_ratio == 1.0


def test_measure_ratio(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.5, 1.0), (None, 1.0)], "a double, b double")
    got = [r.x for r in df.select(summary.measure_ratio(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [None, 0.5, None]


def test_row_number_within_is_exact(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), i, rnd.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id long, h double")
    got = {(r.k, r.id): r.rn for r in ordered.row_number_within(df, ["k"], ["h", "id"], buckets=7).collect()}
    for k in "ab":
        sub = sorted([(h, i) for kk, i, h in rows if kk == k])
        for rank, (_, i) in enumerate(sub, 1):
            assert got[(k, i)] == rank


def test_t_pvalue_known_values(spark):
    rows = spark.createDataFrame([(2.0, 10.0), (1.0, 1.0), (None, 3.0)], "t double, df double").select(t_pvalue("t", "df").alias("p")).collect()
    assert abs(rows[0].p - 0.07338803477074) < 1e-10 and abs(rows[1].p - 0.5) < 1e-11 and rows[2].p is None


def test_median_by_matches_python(spark):
    import statistics
    rnd = random.Random(9)
    rows = [(rnd.choice("abc"), i, round(rnd.random(), 2)) for i in range(301)]
    df = spark.createDataFrame(rows, "k string, id long, v double")
    got = {r.k: r.median for r in ordered.median_by(df, ["k"], "v", buckets=6).collect()}
    for k in "abc":
        assert abs(got[k] - statistics.median([v for kk, _, v in rows if kk == k])) < 1e-12


def test_auc_probability_domain_with_crowded_scores(spark):
    rnd = random.Random(4)
    scores = [0.0, 1.0, 1e-12, 1e-6, 0.5] + [rnd.random() ** 8 for _ in range(200)]
    rows = [("k", rnd.randint(0, 1), s) for s in scores]
    df = spark.createDataFrame(rows, "k string, label int, probability double")
    got = metrics.auc(df, ["k"], buckets=16, domain=metrics.PROBABILITY).first().auc
    assert abs(got - _auc_ref([y for _, y, _ in rows], [s for _, _, s in rows])) < 1e-12
