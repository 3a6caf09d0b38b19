"""Plans that must hold at scale: buckets by counts, block-wise pooling, one histogram per evaluation."""

import math
import random
import re

from pyspark.sql import functions as F

from equilibra.operators import attribution as AT
from equilibra.operators import embeddings as E
from equilibra.operators import metrics, ordered


def test_one_outlier_leaves_buckets_even(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.gauss(0, 1)) for i in range(20000)] + [(-1, 1e6), (-2, float("inf")), (-3, float("nan")), (-4, None)]
    df = spark.createDataFrame(rows, "id long, v double")
    sizes = [r["count"] for r in ordered.with_bucket(df, [], F.col("v"), 32).groupBy("_bucket").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 2 * len(rows) / 32
    rn = {r.id: r.rn for r in ordered.row_number_within(df, [], ["v", "id"], buckets=32).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] is not None and math.isnan(r[1]),
                                        0 if r[1] is None or math.isnan(r[1]) else r[1], r[0]))
    assert [rn[i] for i, _ in order] == list(range(1, len(rows) + 1))


def test_narrow_values_far_from_zero_are_split(spark):
    rows = [(i, 1e9 + i / 1000) for i in range(5000)] + [(-1, 0.0)]
    df = spark.createDataFrame(rows, "id long, v double")
    sizes = [r["count"] for r in ordered.with_bucket(df, [], F.col("v"), 16).groupBy("_bucket").count().collect()]
    assert max(sizes) <= 2 * len(rows) / 16


def test_block_pooling_equals_plain_mean(spark):
    texts = [(i, " ".join(random.Random(i).choices(["aa", "bb", "cc", "zz"], k=1 + i % 9))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "zz zz"), (103, "aa " * 70000)]
    lexicon = {"aa": [1.0, 0.0], "bb": [0.0, 2.0], "cc": [4.0, 4.0]}
    docs = spark.createDataFrame(texts, "row_id long, text string")
    words = spark.createDataFrame(list(lexicon.items()), "word string, vector array<float>")
    got = {r.row_id: r for r in E.mean_pool(docs, words, block_bytes=64).collect()}
    assert len(got) == len(texts)
    for key, text in texts:
        known = [lexicon[w] for w in (text or "").split(" ") if w in lexicon]
        if not known:
            assert got[key].vector is None and got[key].n is None
        else:
            assert got[key].n == len(known)
            assert all(abs(a - sum(b) / len(known)) < 1e-9 for a, b in zip(got[key].vector, zip(*known)))
    assert E.mean_pool(docs.limit(0), words).count() == 0
    assert all(r.vector is None for r in E.mean_pool(docs, words.limit(0)).collect())


def test_pooling_shuffles_no_vector_per_text_and_word(spark):
    docs = spark.createDataFrame([(1, "aa bb")], "row_id long, text string")
    words = spark.createDataFrame([("aa", [1.0])], "word string, vector array<float>")
    plan = E.mean_pool(docs, words)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Summarizer" not in plan


def test_evaluate_with_ties_and_a_third_group(spark):
    rnd = random.Random(9)
    rows = [(i, "orig", rnd.choice("FMX"), rnd.randint(0, 1), rnd.choice([0.1, 0.3, 0.5, 0.9])) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, variant string, gender string, label int, probability double") \
        .withColumn("k", F.lit(1)).withColumn("preds", (F.col("probability") > 0.4).cast("int"))
    got = metrics.evaluate(df, ["k"]).first()

    def auc(pos, neg):
        return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))

    def scores(label, of):
        return [r[4] for r in rows if r[3] == label and of(r[2])]
    cases = {"auc": (lambda g: True, lambda g: True), "auc_f": (lambda g: g == "F",) * 2, "auc_m": (lambda g: g == "M",) * 2,
             "auc_fm": (lambda g: g == "F", lambda g: g != "F"), "auc_mf": (lambda g: g != "F", lambda g: g == "F")}
    for name, (p, n) in cases.items():
        assert abs(got[name] - auc(scores(1, p), scores(0, n))) < 1e-12, name
    assert got["pos_f"] == len(scores(1, lambda g: g == "F"))
    hits = [r for r in rows if r[3] == 1 and r[4] > 0.4]
    assert abs(got["tpr"] - len(hits) / len(scores(1, lambda g: True))) < 1e-12


def test_muting_shuffles_no_step_rows(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0, 2.0, 0.0])], "row_id long, z array<double>")
    steps = AT.iterative_mute(df, AT.random_ranking(spark, 4), AT.fixed_weights(4))
    plan = steps._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan.split("Generate")[0]
    assert steps.count() == 3


def test_pooling_blocks_keep_their_budget(spark):
    rnd = random.Random(4)
    words = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(50)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for i in range(2000)] + [(9000, " ".join(rnd.choices(words, k=40_000))), (9001, None)]
    docs = spark.createDataFrame(rows, "row_id long, text string")
    vectors = spark.createDataFrame([(w, [float(i), 1.0]) for i, w in enumerate(words) if i % 3], "word string, vector array<float>")
    budget, before = 20_000, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            p = E.text_pieces(docs, "row_id", "text", F.split("text", " "), budget, piece=100)
            sizes = p.groupBy("_block").agg(F.sum(F.length(F.array_join("_words", " "))).alias("n")).collect()
            assert len(sizes) > 10 and max(r.n for r in sizes) <= 2 * budget
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    cut = {r.row_id: (r.n, r.vector) for r in E.mean_pool(docs, vectors, block_bytes=budget, piece=100).collect()}
    whole = {r.row_id: (r.n, r.vector) for r in E.mean_pool(docs, vectors).collect()}
    assert len(cut) == len(rows) and cut[9001] == (None, None)
    for key, text in rows:
        hits = [words.index(w) for w in (text or "").split(" ") if w in words and words.index(w) % 3]
        for n, v in (cut[key], whole[key]):
            assert (n, v) == (None, None) if not hits else n == len(hits) and abs(v[0] - sum(hits) / len(hits)) < 1e-9


def test_evaluate_runs_no_job_while_it_is_built(spark):
    df = spark.range(10).selectExpr("id as row_id", "'orig' as variant", "'F' as gender", "cast(id % 2 as int) as label",
                                    "cast(id / 10 as double) as probability", "1 / 0 as preds", "1 as k")
    metrics.evaluate(df, ["k"])  # a job would divide by zero


def test_permutation_moves_every_vector_once(spark):
    df = spark.createDataFrame([(i, i % 2, [float(i % 5), float(i % 3)]) for i in range(50)], "row_id long, label int, z array<double>")
    out = AT.permutation_importance(df, [1.0, -1.0], repeats=3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and sorted(r.rank for r in out.collect()) == [1, 2]


def test_token_attribution_counts_words_where_the_text_lies(spark):
    """No row per text and word is shuffled, joined or ranked by a window; odd rows are as in a plain calculation."""
    from collections import Counter

    from equilibra.operators import attribution as AT
    long = " ".join(f"w{chr(97 + i % 70 // 26)}{chr(97 + i % 26)}" for i in range(70 * 2000)) + " wad"  # more than one piece
    texts = [(1, "The cat the waa unknown"), (1, "cat"), (2, None), (3, ""), (4, long), (None, "the dog"), (5, "unknown"), (6, "dog none")]
    docs = spark.createDataFrame(texts, "row_id long, text string")
    lex = [("the", [1.0, 2.0]), ("cat", [0.5, -3.0]), ("cat", [0.25, 1.0]), ("dog", [0.0, 0.0]), ("none", None)]
    lex += [(f"w{a}{chr(97 + i)}", [float(i % 9), -1.0]) for a in "abc" for i in range(26)]
    words = spark.createDataFrame(lex, "word string, vector array<double>")
    got = AT.token_attribution(docs, words, [1.0, 0.5])
    plan = got._jdf.queryExecution().toString()
    assert "CoGroup" in plan and "row_number" not in plan
    known, counts = {}, {}
    for w, v in lex:
        known.setdefault(w, []).append(None if v is None else v[0] + 0.5 * v[1])
    for k, t in texts:
        counts.setdefault(k, Counter()).update(re.sub("[0-9]", "", (t or "").lower()).split(" "))
    want = set()
    for k, c in counts.items():
        hits = [(w, n, b) for w, n in c.items() for b in known.get(w, [])]
        total = sum(n for _, n, _ in hits)
        shares = [(w, None if b is None else n * b / total) for w, n, b in hits]
        shares.sort(key=lambda e: (e[1] is None, -round(abs(e[1] or 0.0), 9), e[0]))
        want |= {(k, w, x, i + 1) for i, (w, x) in enumerate(shares[:50])}
    assert {tuple(r) for r in got.collect()} == want
