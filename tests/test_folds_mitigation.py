
import random
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from equilibra.operators import attribution as AT
from equilibra.operators import folds as FO
from equilibra.operators import mitigation as MI


def _notes(spark, n=230, seed=5):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice("FM"), rnd.randint(0, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, gender string, label int").withColumn("stratum", FO.stratum())


def test_each_row_in_one_test_fold_per_seed_and_balanced(spark):
    a = FO.stratified_folds(_notes(spark), seeds=2, n_splits=10).collect()
    per = Counter((r.seed, r.row_id) for r in a)
    assert set(per.values()) == {1} and len(per) == 2 * 230
    sizes = Counter((r.seed, r.stratum, r.k) for r in a)
    for seed in (0, 1):
        for s in {r.stratum for r in a}:
            v = [sizes[(seed, s, k)] for k in range(10)]
            assert max(v) - min(v) <= 1


def test_roles_closed_form_equals_window(spark):
    a = FO.stratified_folds(_notes(spark), seeds=1)
    roles = {(r.fold, r.row_id): r.role for r in FO.fold_roles(a).collect()}
    x = a.select("row_id", "stratum", "rn", "k", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("kx"))
    nt = x.filter("k <> kx").withColumn("rn2", F.row_number().over(Window.partitionBy("kx", "stratum").orderBy("rn")))
    for r in nt.collect():
        assert roles[(r.kx, r.row_id)] == ("val" if (r.rn2 - 1) % 10 == 0 else "train")
    assert all(roles[(r.k, r.row_id)] == "test" for r in a.collect())


def test_reweighing_mass(spark):
    df = _notes(spark)
    w = MI.reweighing(df).collect()
    n = len(w)
    ng, ny = Counter(r.gender for r in w), Counter(r.label for r in w)
    mass = Counter()
    for r in w:
        mass[(r.gender, r.label)] += r.weight
    for (g, y), m in mass.items():
        assert abs(m - ng[g] * ny[y] / n) < 1e-9


def test_reject_option_matches_brute_force(spark):
    rnd = random.Random(11)
    rows = [("k", rnd.choice("FM"), rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "key string, gender string, label int, probability double")
    grid = MI.roc_grid(num_thresh=7, num_margin=4)
    got = {r.gid: (r.balanced_accuracy, r.avg_odds_diff)
           for r in MI.reject_option_grid(df, ["key"], grid=grid).collect()}
    for gid, t, m in grid:
        c = Counter()
        for _, g, y, s in rows:
            pred = s > t + m if g == "F" else s > t - m
            c[(g == "F", y, pred)] += 1
        tp = c[(True, 1, True)] + c[(False, 1, True)]
        p = sum(v for (a, y, _), v in c.items() if y == 1)
        fp = c[(True, 0, True)] + c[(False, 0, True)]
        n = sum(v for (a, y, _), v in c.items() if y == 0)
        bal = (tp / p + (n - fp) / n) / 2

        def rate(priv, y):
            tot = c[(priv, y, True)] + c[(priv, y, False)]
            return c[(priv, y, True)] / tot
        aod = ((rate(False, 0) - rate(True, 0)) + (rate(False, 1) - rate(True, 1))) / 2
        assert abs(got[gid][0] - bal) < 1e-12 and abs(got[gid][1] - aod) < 1e-12


def test_mute_step_zero_is_full_margin_and_last_keeps_one(spark):
    rows = [(i, "F" if i % 2 else "M", i % 3 % 2, [float((i * j) % 5 - 2) for j in range(6)]) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, gender string, label int, features array<double>")
    z = AT.standardize(df, AT.feature_stats(df))
    beta = AT.fixed_weights(6)
    rk = AT.random_ranking(spark, 6)
    steps = {(r.row_id, r.step): r.margin for r in AT.iterative_mute(z.select("row_id", "z"), rk, beta).collect()}
    zs = {r.row_id: r.z for r in z.collect()}
    order = [r.feature_idx for r in rk.orderBy("rank").collect()]
    for i, zv in zs.items():
        full = sum(b * x for b, x in zip(beta, zv))
        assert abs(steps[(i, 0)] - full) < 1e-9
        for s in range(1, 5):
            kept = sum(beta[j] * zv[j] for j in order[s:])
            assert abs(steps[(i, s)] - kept) < 1e-9
    assert max(s for _, s in steps) == 4


def test_sampled_shapley_efficiency(spark):
    """Per row, the sampled values sum to f(all features) - f(no feature)."""
    rows = [(i, [float(((i + 1) * (j + 2)) % 7 - 3) for j in range(5)]) for i in range(12)]
    df = spark.createDataFrame(rows, "row_id long, z array<double>")
    beta = AT.fixed_weights(5)
    c = df.select("row_id", F.posexplode(F.zip_with("z", F.array(*[F.lit(b) for b in beta]), lambda a, b: a * b))
                  .alias("feature_idx", "_c"))
    c = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("_p"))
    order = F.md5(F.concat_ws(":", F.col("row_id").cast("string"), F.col("_p").cast("string"),
                              F.col("feature_idx").cast("string")))
    w = Window.partitionBy("row_id", "_p").orderBy(order, "feature_idx").rowsBetween(Window.unboundedPreceding, 0)
    run = c.withColumn("_cum", F.sum("_c").over(w))
    marg = F.when(F.col("_cum") > 0, 1).otherwise(0) - F.when(F.col("_cum") - F.col("_c") > 0, 1).otherwise(0)
    phi = run.groupBy("row_id", "feature_idx").agg(F.avg(marg).alias("phi")).groupBy("row_id").agg(F.sum("phi").alias("s"))
    got = {r.row_id: r.s for r in phi.collect()}
    for i, z in rows:
        full = 1 if sum(b * x for b, x in zip(beta, z)) > 0 else 0
        assert abs(got[i] - full) < 1e-12
    ranked = AT.sampled_shapley(df, beta, permutations=4).collect()
    assert sorted(r.rank for r in ranked) == [1, 2, 3, 4, 5]
