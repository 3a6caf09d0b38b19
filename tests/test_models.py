"""Models trained together equal models trained alone; scoring by key; what each study's run asks for."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilibra.operators import batched as BA
from equilibra.operators import folds as FO
from equilibra.operators import linear as LI
from equilibra.operators import models as MO
from equilibra.plans import experiment_queries as EQ
from equilibra.plans import model_queries as MQ

SMALL = "/root/testdata/sf0.001"


def _rows(spark):
    x = [[(i * 7 % 11) / 5.0, (i * 5 % 13) / 3.0, 1.0] for i in range(60)]
    rows = [(i, "F" if i % 3 else "M", i % 2, int(v[0] + 0.3 * v[1] > 2), v) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "row_id int, gender string, fold int, label int, features array<double>")


@pytest.fixture(scope="module")
def noisy(spark):
    """Rows that no plane separates: sets 0 (all), 1 (gender F), 2 (odd ids); set 1 validates set 0."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(500, 6)) * [1, 5, 0.2, 1, 1, 1] + [0, 3, 0, 0, 9, 0]
    x[:, 5] = 2.0  # constant
    y = (x[:, 0] + 0.2 * x[:, 1] + rnd.normal(size=500) > 1.0).astype(int)
    g = (x[:, 3] + rnd.normal(size=500) > 0).astype(int)
    rows = [(i, int(y[i]), int(g[i]), "M" if g[i] else "F", x[i].tolist(), [0, *([1] if g[i] == 0 else []), *([2] if i % 2 else [])],
             [0] if i % 5 == 0 else []) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id int, y int, g int, gender string, x array<double>, train array<int>, val array<int>")
    return df.withColumns({"label": F.col("y"), "features": F.col("x")}).coalesce(1).cache()


def objective(df, m, weight, c):
    rows = df.select("y", "g", "x").collect()
    x, y = np.array([r.x for r in rows]), np.array([2 * r.y - 1 for r in rows])
    w = np.array([weight[r.g][r.y] for r in rows])
    margin = x @ np.array(m.weights) + m.bias
    return (w * np.maximum(0, 1 - y * margin)).sum() / w.sum() + (np.array(m.coef) ** 2).sum() / (2 * c * w.sum())


@pytest.mark.parametrize("balanced", [True, False])
def test_batched_models_agree_with_mllib(spark, noisy, balanced):
    stats = BA.set_stats(noisy)
    tasks = [BA.Task((s, c), s, c, balanced=balanced) for s, c in ((0, 0.01), (1, 10.0), (2, 1.0))]
    models = BA.calibrate(noisy, tasks, BA.train(noisy, tasks, stats))
    for t in tasks:
        own = noisy.filter(F.array_contains("train", t.rows)).coalesce(1)
        with MO.training_rows(own, balanced=balanced) as rows:
            alone = rows.fit(t.c, max_iter=150, tol=1e-6)
            line = rows.calibrated(models[t.key])
        mine, w = models[t.key], BA.cell_weights(t, stats[t.rows])
        assert np.allclose(mine.mean, alone.mean) and np.allclose(mine.scale, alone.scale)
        assert objective(own, mine, w, t.c) <= objective(own, alone, w, t.c) * 1.01
        assert np.allclose(mine.coef, alone.coef, atol=0.05 * np.abs(alone.coef).max())
        assert abs(mine.slope - line.slope) < 1e-3 * (1 + abs(line.slope)) and abs(mine.offset - line.offset) < 1e-3 * (1 + abs(line.offset))


def test_passes_do_not_grow_with_models(noisy, monkeypatch):
    passes = []
    plain = BA.Pass.sums
    monkeypatch.setattr(BA.Pass, "sums", lambda self, *a, **k: (passes.append(1), plain(self, *a, **k))[1])
    BA.train(noisy, [BA.Task((s, c, k), s, c) for s in (0, 1, 2) for c in (0.1, 1.0, 10.0) for k in range(10)])
    assert len(passes) <= BA.MAX_PASSES


def test_group_target_reweighing_and_missing_classes(spark, noisy):
    m = BA.train(noisy, [BA.Task(("g",), 0, 1.0, target="group"), BA.Task(("w",), 0, 1.0, reweighed=True), BA.Task(("u",), 0, 1.0),
                         BA.Task(("one",), 1, 1.0, target="group"), BA.Task(("none",), 9, 1.0)])
    assert set(m) == {("g",), ("w",), ("u",)} and m["g",].weights[3] > 0.1 > abs(m["u",].weights[3]) and m["w",].coef != m["u",].coef
    s = BA.set_stats(noisy)[0]
    w = BA.cell_weights(BA.Task((), 0, 1.0, balanced=False, reweighed=True), s)
    assert np.allclose((w * s.cells).sum(axis=1), s.cells.sum(axis=1)) and np.allclose((w * s.cells)[0] / (w * s.cells)[1], s.cells[0].sum() / s.cells[1].sum())


def test_grid_search_takes_the_best_and_smallest(noisy):
    tasks = [BA.Task(("a",), 0, 1.0)]
    models, results = BA.grid_search(noisy, tasks, (1.0, 0.1, 1.0001))
    best = max(f for _, f in results["a",])
    assert models["a",].c == min(c for c, f in results["a",] if f == best) and [c for c, _ in results["a",]] == [0.1, 1.0, 1.0001]
    rows = [(r.y, int(np.dot(r.x, models["a",].weights) + models["a",].bias > 0)) for r in noisy.filter("size(val) > 0").collect()]
    counts = [sum(r == k for r in rows) for k in ((0, 0), (0, 1), (1, 0), (1, 1))]
    assert BA.macro_f1(*counts) == pytest.approx(best)


def test_removed_features_have_no_weight(noisy):
    task = BA.Task((7,), 0, 1.0)
    full = BA.train(noisy, [task])
    steps = BA.remove_and_retrain(noisy, [task], {(7,): [1, 0, 2, 3, 4, 5]}, full)
    assert sorted(steps) == [(7, i) for i in range(5)]
    assert steps[7, 0].coef[1] != 0.0 and steps[7, 1].coef[1] == 0.0 and steps[7, 1].coef[0] != 0.0
    assert steps[7, 2].coef[:2] == (0.0, 0.0)
    again = BA.train(noisy, [BA.Task((1,), 0, 1.0, drop=frozenset([1]))])  # without the warm start
    assert np.allclose(again[1,].coef, steps[7, 1].coef, atol=0.05)


def test_score_by_key_equals_each_model(spark):
    df = _rows(spark)
    a, b = (MO.fit_linear(df.filter(F.col("fold") == k), 1.0) for k in (0, 1))
    got = {r.row_id: (r.preds, round(r.margin, 8), round(r.probability, 8)) for r in LI.score({(0,): a, (1,): b}, df, ["fold"]).collect()}
    want = {r.row_id: (r.preds, round(r.margin, 8), round(r.probability, 8)) for k, m in ((0, a), (1, b))
            for r in m.transform(df.filter(F.col("fold") == k)).collect()}
    assert got == want and len(got) == 60 and a.scale[2] == 0.0
    steps = LI.score({(0, i): a for i in range(2)}, df.filter("fold = 0"), ["fold"], extra="step int")
    assert steps.groupBy("step").count().orderBy("step").collect() == [(0, 30), (1, 30)]


def test_no_test_row_trains_in_its_fold(spark):
    notes = _rows(spark).withColumn("stratum", FO.stratum()).drop("fold")
    roles = FO.fold_roles(FO.stratified_folds(notes))
    variants = notes.drop("stratum").crossJoin(spark.createDataFrame([("orig",), ("swapped",), ("neutr",)], "variant string"))
    b = FO.fold_bundle(roles, variants, "neutr")
    train, test = b.filter("slot = 0").select("fold", "row_id"), b.filter("slot in (1, 2)").select("fold", "row_id")
    assert train.join(test, ["fold", "row_id"]).count() == 0
    assert {r.variant for r in b.filter("slot = 2").select("variant").distinct().collect()} == {"neutr", "neutr_flipped"}


def test_memberships_equal_the_fold_bundles(spark):
    sets = [MQ.TrainingSet(1), MQ.TrainingSet(1, "augmented"), MQ.TrainingSet(0, "neutr"), MQ.TrainingSet(1, gender="F"),
            *[MQ.TrainingSet(1, without_part=p) for p in range(3)], MQ.TrainingSet(1, balanced=True)]
    with MQ.batch_rows(spark, SMALL, sets) as rows:
        got = {(u, r.id): r["count"] for u in ("train", "val")
               for r in rows.select(F.explode(u).alias("id")).groupBy("id").count().collect()}
    for i, s in enumerate(sets[:4]):
        b = MQ.fold_sets(spark, SMALL, s.treatment, s.fold)
        for use in ("train", "val"):
            own = b[use].filter("gender = 'F'") if s.gender else b[use]
            assert got.get((use, i), 0) == own.count(), (s, use)
    assert sum(got[("val", i)] for i in (4, 5, 6)) == got[("train", 0)] and all(got[("train", i)] + got[("val", i)] == got[("train", 0)] for i in (4, 5, 6))
    assert 0 < got[("train", 7)] <= got[("train", 0)]


class Enough(Exception):
    pass


def stop(*args, **kwargs):
    raise Enough


def test_study1_asks_for_every_fold_without_class_weights(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(BA, "cross_validated", lambda rows, tasks, parts, grid: asked.append((tasks, parts, grid)) or stop())
    with pytest.raises(Enough):
        EQ.study1_experiment(spark, SMALL)
    tasks, parts, grid = asked[0]
    assert {t.key for t in tasks} == {(tr, k) for tr in EQ.STUDY1_TREATMENTS for k in range(10)} and not any(t.balanced for t in tasks)
    assert grid == (0.01, 0.1, 1.0, 10.0, 100.0) and all(len(p) == 3 for p in parts.values())
    with pytest.raises(Enough):
        MQ.cv_select(spark, SMALL)
    assert [t.key for t in asked[1][0]] == [(k,) for k in range(5)]


def test_pearson_reads_the_validation_slot(monkeypatch):
    seen = []
    monkeypatch.setattr(EQ.AT, "pcc_ranking", lambda df: seen.append(df))
    sets = {name: SimpleNamespace(withColumn=lambda c, v, name=name: name) for name in ("train", "val", "test")}
    monkeypatch.setattr(EQ.T, "gender_code", lambda c: None)
    EQ.proxy_ranking(sets, 0, "pearson", None)
    assert seen == ["val"]


def test_roar_refits_every_step_of_every_fold(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(BA, "grid_search", lambda rows, tasks, grid: ({t.key: None for t in tasks}, {}))
    monkeypatch.setattr(BA, "remove_and_retrain", lambda rows, tasks, orders, full: asked.append(orders) or stop())
    with pytest.raises(Enough):
        MQ.roar(spark, SMALL)
    assert sorted(asked[0]) == [(k,) for k in range(5)] and all(sorted(o) == list(range(64)) for o in asked[0].values())


def test_run_is_taken_up_where_it_stopped(spark, monkeypatch, tmp_path):
    fitted = []
    plain = BA.grid_search
    monkeypatch.setattr(BA, "LEVEL_PASSES", 3)
    monkeypatch.setattr(BA, "NEWTON_STEPS", 3)
    monkeypatch.setattr(BA, "grid_search", lambda rows, tasks, grid: (fitted.extend(t.key[0] for t in tasks), plain(rows, tasks, (0.1,)))[1])
    methods = ("orig", "neutr", "augmented", "gender_specific")
    plain_scores = MQ.metrics.evaluate
    monkeypatch.setattr(MQ.metrics, "evaluate", stop)  # stopped after the predictions were written
    with pytest.raises(Enough):
        MQ.run_mitigation(spark, SMALL, str(tmp_path), ("orig",))
    monkeypatch.setattr(MQ.metrics, "evaluate", plain_scores)
    assert MQ.run_mitigation(spark, SMALL, str(tmp_path), ("orig",)).select("method").distinct().collect() == [("orig",)]
    assert set(fitted) == {"orig"}
    fitted.clear()
    scores = MQ.run_mitigation(spark, SMALL, str(tmp_path), methods).cache()
    assert set(fitted) == set(methods) - {"orig"}
    assert {r.method for r in scores.select("method").distinct().collect()} == {*methods, "participatory"}
    fitted.clear()
    again = MQ.run_mitigation(spark, SMALL, str(tmp_path), methods)
    assert not fitted and sorted(again.collect()) == sorted(scores.collect())


def test_a_pass_holds_few_margins_at_a_time(spark):
    rng = random.Random(5)
    data = [([0, 1], [], rng.randint(0, 1), rng.randint(0, 1), [rng.gauss(0, 1) for _ in range(3)]) for _ in range(3000)]
    rows = spark.createDataFrame(data, "train array<int>, val array<int>, y int, g int, x array<double>").coalesce(1)
    tasks = [BA.Task((k,), k % 2, 1.0, target="group" if k % 3 else "label") for k in range(60)]
    w, bias = np.array([[rng.gauss(0, 1) for _ in range(3)] for _ in tasks]), np.zeros(60)
    cells = np.array([[[rng.random(), rng.random()], [rng.random(), rng.random()]] for _ in tasks])
    by_group, width = np.array([t.target == "group" for t in tasks]), np.full(60, 0.5)
    sums = BA.hinge_sums(cells, by_group, width)

    def add(i, x, m, y, g):
        assert m.size <= 1 << 16
        return sums(i, x, m, y, g)
    got = BA.Pass(rows, tasks).sums("train", range(60), w, bias, 5, add)
    x, y, g = (np.array([r[k] for r in data]) for k in (4, 2, 3))
    for k in range(60):
        t = 2.0 * (g if by_group[k] else y) - 1.0
        short, of = 1.0 - t * (x @ w[k]), cells[k][g, y]
        inner = np.clip(short, 0.0, 0.5)
        loss, slope = of * (inner * inner + np.maximum(short - 0.5, 0.0)), -of * t * inner / 0.5
        assert np.allclose(got[k], [loss.sum(), slope.sum(), *(slope @ x)])
