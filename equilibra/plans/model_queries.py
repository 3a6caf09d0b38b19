"""Model training and the mitigation dispatcher (M1-M8, M12, M18, M20, F8, W8; rows-only checks).

Features per note variant are produced the way the studies do it: rewrite the
notes into counterfactual variants (U1), then mean-pool word vectors (E1).
Every fold has its own models, trained on that fold's rows only.  All models of
a query are trained in one batch (:mod:`..operators.batched`): each feature row
is kept once, with the ids of the training and validation sets it belongs to,
and the models of all folds then score their rows in one pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attribution as AT
from ..operators import batched as BA
from ..operators import counterfactual as CF
from ..operators import embeddings as E
from ..operators import folds as FO
from ..operators import linear as LI
from ..operators import metrics
from ..operators import mitigation as MI
from ..operators.models import C_GRID, C_GRID_STUDY1
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import io, views
from ..sources.ledger import RunLedger
from .fold_queries import assignments, cohort_notes
from .registry import register

FOLDS = 5  # Fixed value: the folds that the studies run
CV_PARTS = 3  # Fixed value: the parts of study 1's model selection
EMBEDDING = "word_mean"


def variant_features(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, variant, gender, label, features) for orig / swapped / neutr notes."""
    notes = cohort_notes(spark, sf)
    v = CF.counterfactual_variants(notes)
    v = v.withColumn("_vk", F.concat_ws(":", F.col("row_id").cast("string"), "variant"))
    # the variants of a note share most words, so they go to one block; three of them are about three times the note
    pooled = E.mean_pool(v.select("_vk", "row_id", "text"), views.word_vectors(spark, sf), key="_vk",
                         size=3 * E.text_bytes(notes, "text"), together="row_id")
    f = v.select("_vk", "row_id", "variant", "gender", "label").join(pooled, "_vk")
    # a row goes with all its variants or not at all, so that pairs stay whole
    whole = F.min(F.col("vector").isNotNull()).over(Window.partitionBy("row_id"))
    return f.withColumn("_whole", whole).filter("_whole").select(
        "row_id", "variant", "gender", "label", F.col("vector").alias("features"))


def fold_roles_run(spark: SparkSession, sf: str, n_folds: int = FOLDS) -> DataFrame:
    """(seed, fold, role, row_id) of the folds run."""
    return FO.fold_roles(assignments(spark, sf, mention=True)).filter(F.col("fold") < n_folds)


_KEPT: dict[tuple, DataFrame] = {}


def _kept(spark: SparkSession, sf: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A checkpointed table, made once per session and input: the last input's only."""
    session = (spark.sparkContext.applicationId, sf)
    for key in [k for k in _KEPT if k[:2] != session]:
        del _KEPT[key]
    if (*session, name) not in _KEPT:
        _KEPT[(*session, name)] = cut_lineage(make(spark, sf))
    return _KEPT[(*session, name)]


def note_features(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf, "features", variant_features)


def run_roles(spark: SparkSession, sf: str, n_folds: int) -> DataFrame:
    return _kept(spark, sf, f"roles {n_folds}", lambda s, d: fold_roles_run(s, d, n_folds))


def fold_sets(spark: SparkSession, sf: str, treatment: str = "orig", fold: int | None = None,
              n_folds: int = FOLDS) -> dict[str, DataFrame]:
    """Training / validation / paired test sets (F6 slots 0, 3, 1, 4, 2) of one fold, or of
    all of them with the fold as a column."""
    b = FO.fold_bundle(run_roles(spark, sf, n_folds), note_features(spark, sf), treatment)
    if fold is not None:
        b = b.filter(F.col("fold") == fold)
    return {"train": b.filter("slot = 0"), "test": b.filter("slot = 1"), "blind": b.filter("slot = 2"),
            "val": b.filter("slot = 3"), "val_pairs": b.filter("slot = 4")}


# ---------------------------------------------------------------- training sets of a batch

@dataclass(frozen=True)
class TrainingSet:
    """Which rows train a model: a fold's, of one treatment; perhaps of one gender, without one of the
    parts of a cross validation, or under-sampled (F5)."""

    fold: int
    treatment: str = "orig"
    gender: str | None = None
    without_part: int | None = None
    balanced: bool = False


def _rules(sets: Sequence[TrainingSet]) -> Iterator[tuple]:
    """(id, use, fold, role, variant, gender, part, other parts) of the rows that each set trains and validates."""
    for i, s in enumerate(sets):
        layout = FO.slot_rules(s.treatment)
        train = [v for r, v, slot, _, _ in layout if slot == 0]
        val = [v for r, v, slot, _, _ in layout if slot == 3]
        role = "balanced" if s.balanced else "train"
        for v in train:
            yield i, "train", s.fold, role, v, s.gender, s.without_part, True
            if s.without_part is not None:
                yield i, "val", s.fold, role, v, s.gender, s.without_part, False
        if s.without_part is None:
            for v in val:
                yield i, "val", s.fold, "val", v, s.gender, None, True


def balanced_sets(spark: SparkSession, sf: str) -> DataFrame:
    """(fold, row_id) of the under-sampled training rows."""
    return FO.balanced_train(fold_roles_run(spark, sf), cohort_notes(spark, sf)).select("fold", "row_id")


@contextmanager
def batch_rows(spark: SparkSession, sf: str, sets: Sequence[TrainingSet], n_folds: int = FOLDS) -> Iterator[DataFrame]:
    """Every feature row once, with the sets it trains and validates; cached while models are trained.

    The rule table has a few rows per set and is broadcast; memberships are slim
    rows; features cross the network once.
    """
    roles = run_roles(spark, sf, n_folds).select("fold", "role", "row_id")
    if any(s.balanced for s in sets):
        roles = roles.unionByName(balanced_sets(spark, sf).withColumn("role", F.lit("balanced")))
    rules = spark.createDataFrame(list(_rules(sets)), "id int, use string, fold int, role string, variant string, "
                                                      "_gender string, _part int, _others boolean")
    f = note_features(spark, sf)
    part = F.pmod(F.xxhash64(F.col("row_id").cast("string"), F.lit("cv")), F.lit(CV_PARTS))
    m = roles.join(F.broadcast(rules), ["fold", "role"]).join(f.select("row_id", "variant", "gender"), ["row_id", "variant"])
    m = m.filter((F.col("_gender").isNull() | (F.col("_gender") == F.col("gender")))
                 & (F.col("_part").isNull() | ((part != F.col("_part")) == F.col("_others"))))
    lists = m.groupBy("row_id", "variant").agg(*[F.collect_list(F.when(F.col("use") == u, F.col("id"))).alias(u)
                                                 for u in ("train", "val")])  # at most the number of sets
    rows = f.join(lists, ["row_id", "variant"]).select(
        "train", "val", F.col("label").alias("y"), T.gender_code("gender").alias("g"), F.col("features").alias("x"))
    rows = rows.filter("x is not null and y in (0, 1) and g is not null").cache()
    try:
        yield rows
    finally:
        rows.unpersist()


def tasks_of(named: Iterable[tuple[tuple, TrainingSet]], **kw) -> tuple[list[BA.Task], list[TrainingSet]]:
    """One task per (key, set), and the list of sets behind their numbers."""
    named = list(named)
    return [BA.Task(key, i, 1.0, **kw) for i, (key, _) in enumerate(named)], [s for _, s in named]


def grid_rows(spark: SparkSession, models: dict, results: dict) -> DataFrame:
    """(fold, c, val_macro_f1, chosen) of one grid search per fold."""
    rows = [(key[0], c, f1, c == models[key].c) for key, found in results.items() for c, f1 in found]
    return spark.createDataFrame(rows, "fold int, c double, val_macro_f1 double, chosen boolean")


def _grid_per_fold(spark: SparkSession, sf: str, **kw) -> DataFrame:
    tasks, sets = tasks_of((((k,), TrainingSet(k)) for k in range(FOLDS)), **kw)
    with batch_rows(spark, sf, sets) as rows:
        return grid_rows(spark, *BA.grid_search(rows, tasks, C_GRID))


@register("svm_grid", "M1 M2 M3 M5 W8 F7")
def svm_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _grid_per_fold(spark, sf)


@register("proxy_classifier", "M12 P10")
def proxy_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return _grid_per_fold(spark, sf, target="group")


# ---------------------------------------------------------------- mitigation

# The mitigation methods of the study-2 dispatchers.
METHODS = ("orig", "neutr", "augmented", "gender_specific", "reweighing", "postprocessing", "balanced")


def method_sets(method: str, fold: int) -> list[tuple[tuple, TrainingSet]]:
    """The models of a method on a fold, by (method, fold[, gender]), and what they train on."""
    if method == "gender_specific":
        return [((method, fold, g), TrainingSet(fold, gender=g)) for g in ("F", "M")]
    return [((method, fold), TrainingSet(fold, method if method in ("neutr", "augmented") else "orig",
                                         balanced=method == "balanced"))]


def fit_methods(spark: SparkSession, sf: str, methods: Sequence[str]) -> dict[tuple, LI.LinearModel]:
    """The chosen models of all methods and folds: one batch."""
    fitted = [m for m in dict.fromkeys("orig" if m == "postprocessing" else m for m in methods)]
    named = [e for m in fitted for k in range(FOLDS) for e in method_sets(m, k)]
    tasks, sets = tasks_of(named)
    tasks = [BA.replace(t, reweighed=t.key[0] == "reweighing") for t in tasks]
    with batch_rows(spark, sf, sets) as rows:
        return BA.grid_search(rows, tasks, C_GRID)[0]


def halves(df: DataFrame) -> DataFrame:
    """A paired slot holds one original half (orig / neutr) and one counterfactual half."""
    return df.withColumn("variant", F.when(F.col("variant").isin("orig", "neutr"), "orig").otherwise("swapped"))


def method_predictions(spark: SparkSession, sf: str, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(method, split, embedding, fold, variant, row_id, gender, label, preds, margin, probability)
    of the test and validation pairs of every method and fold."""
    fitted, out = fit_methods(spark, sf, methods), None
    for method in methods:
        # post-processing decides anew on the scores of the untreated models
        of = "orig" if method == "postprocessing" else method
        models = {key[1:]: m for key, m in fitted.items() if key[0] == of}
        keys = ["fold", "gender"] if method == "gender_specific" else ["fold"]
        s = fold_sets(spark, sf, method if method in ("neutr", "augmented") else "orig")
        # the neutralised method is tested blind: neutral notes and their gender-flipped copies
        split = {"test": s["blind" if method == "neutr" else "test"], "val": s["val_pairs"]}
        scored = {name: LI.score(models, df, keys) for name, df in split.items()}
        if method == "postprocessing":
            chosen = MI.reject_option_fit(scored["val"], ["fold"])
            scored = {name: MI.reject_option_apply(df.drop("preds"), chosen, ["fold"]) for name, df in scored.items()}
        for name, df in scored.items():
            part = halves(df).select(F.lit(method).alias("method"), F.lit(name).alias("split"),
                                     F.lit(EMBEDDING).alias("embedding"), "fold", "variant", "row_id", "gender",
                                     "label", "preds", "margin", "probability")
            out = part if out is None else out.unionByName(part)
    return out


# The methods that the participatory choice is made among, on F1
CHOSEN_AMONG = ("orig", "neutr", "augmented", "gender_specific")
SCORE_KEYS = ["method", "split", "embedding", "fold"]


def participatory_predictions(preds: DataFrame, scores: DataFrame) -> DataFrame:
    """Each group's rows from the method that served it best on the validation sets."""
    choice = MI.participatory_choice(scores.filter((F.col("split") == "val") & F.col("method").isin(*CHOSEN_AMONG)),
                                     CHOSEN_AMONG, "f1")
    return MI.gather_by_group(preds, choice).withColumn("method", F.lit("participatory"))


def run_mitigation(spark: SparkSession, sf: str, folder: str, methods: Sequence[str] = METHODS) -> DataFrame:
    """The scores of every method and fold, from a run that can be taken up again.

    What the ledger in ``folder`` lists as finished is not trained again; predictions and scores of the
    rest are written method by method, then listed.  The participatory method reads the predictions and
    validation scores back.
    """
    ledger = RunLedger(spark, folder, ["method"])
    spec = spark.createDataFrame([(m,) for m in (*methods, "participatory")], "method string")
    todo = [r.method for r in ledger.pending(spec).collect()]  # a row per method
    fit = [m for m in methods if m in todo]
    if fit:
        preds = method_predictions(spark, sf, tuple(fit))
        io.write_predictions(preds, f"{folder}/predictions")
        done = ledger.read("predictions").filter(F.col("method").isin(*fit))
        ledger.append_scores(metrics.evaluate(done, SCORE_KEYS))
        ledger.finish(spec.filter(F.col("method").isin(*fit)))
    if "participatory" in todo and set(CHOSEN_AMONG) <= set(methods):
        preds = ledger.read("predictions").filter(F.col("method").isin(*CHOSEN_AMONG))
        io.write_predictions(cut_lineage(participatory_predictions(preds, ledger.latest_scores(SCORE_KEYS))), f"{folder}/predictions")
        done = ledger.read("predictions").filter(F.col("method") == "participatory")
        ledger.append_scores(metrics.evaluate(done, SCORE_KEYS))
        ledger.finish(spec.filter(F.col("method") == "participatory"))
    return ledger.latest_scores(SCORE_KEYS)


@register("mitigation_run", "M20 M6 M9 M10 M11 A7 F5 U7 S4 S5 S10 W1")
def mitigation_run(spark: SparkSession, sf: str) -> DataFrame:
    """Every method on every fold, in a folder of its own."""
    return run_mitigation(spark, sf, f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}")


@register("group_specific", "M7 M8")
def group_specific(spark: SparkSession, sf: str) -> DataFrame:
    preds = cut_lineage(method_predictions(spark, sf, ("gender_specific",)).filter("split = 'test'"))
    return metrics.evaluate(preds, ["embedding", "fold"])


# ---------------------------------------------------------------- model selection, removal

def study1_models(spark: SparkSession, sf: str, named: Sequence[tuple[tuple, int, str]],
                  n_folds: int) -> dict[tuple, LI.LinearModel]:
    """F8 / M4: for every (key, fold, treatment) the model of the C that cross validation on its training rows
    chooses.  No class weights: study 1 sets none."""
    sets, tasks, parts = [], [], {}
    for key, fold, treatment in named:
        tasks.append(BA.Task(key, len(sets), 1.0, balanced=False))
        sets.append(TrainingSet(fold, treatment))
        parts[key] = range(len(sets), len(sets) + CV_PARTS)
        sets += [TrainingSet(fold, treatment, without_part=p) for p in range(CV_PARTS)]
    with batch_rows(spark, sf, sets, n_folds) as rows:
        return BA.cross_validated(rows, tasks, parts, C_GRID_STUDY1)[0]


def macro_f1_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A3 of all rows per key."""
    conf = metrics.confusion_by_group(df.withColumn("_all", F.lit("rows")), keys, "_all")
    return conf.filter(F.col("_all") == metrics.ALL).select(*keys, metrics.f1_columns()[2].alias("f1"))


@register("cv_select", "F8 M4")
def cv_select(spark: SparkSession, sf: str, folds: Sequence[int] = range(FOLDS)) -> DataFrame:
    models = study1_models(spark, sf, [((k,), k, "orig") for k in folds], FOLDS)
    scored = LI.score(models, fold_sets(spark, sf)["test"], ["fold"])
    c = spark.createDataFrame([(k, m.c) for (k,), m in models.items()], "fold int, c double")  # a row per fold
    return c.join(macro_f1_by(scored, ["fold"]), "fold", "left").select("fold", "c", F.col("f1").alias("test_macro_f1"))


def ranked_features(ranking: DataFrame) -> list[int]:
    """The feature order of a ranking: d entries, a parameter-size list."""
    return [r.feature_idx for r in ranking.orderBy("rank").collect()]


def roar_predictions(spark: SparkSession, sf: str, orders: dict[int, list[int]], splits: dict[str, str]) -> DataFrame:
    """Per fold and step i = 0 .. d - 2 a model without the fold's top-i features (the C chosen with
    all of them), applied to the pairs of ``splits`` (name -> set).  The steps of all folds are one batch."""
    tasks, sets = tasks_of(((k,), TrainingSet(k)) for k in sorted(orders))
    with batch_rows(spark, sf, sets) as rows:
        full, _ = BA.grid_search(rows, tasks, C_GRID)
        models = BA.remove_and_retrain(rows, tasks, {(k,): o for k, o in orders.items()}, full)
    s, out = fold_sets(spark, sf), None
    for name, which in splits.items():
        part = LI.score(models, halves(s[which]), ["fold"], extra="step int").drop("features")
        part = part.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@register("roar", "M18 P11")
def roar(spark: SparkSession, sf: str, folds: Sequence[int] = range(FOLDS)) -> DataFrame:
    """Remove-and-retrain in a random feature order, every step (d - 1 refits a fold)."""
    order = ranked_features(AT.random_ranking_of(fold_sets(spark, sf)["train"], seed=0))
    preds = cut_lineage(roar_predictions(spark, sf, {k: order for k in folds}, {"test": "test"}))
    return metrics.evaluate(preds.withColumn("embedding", F.lit(EMBEDDING)), ["embedding", "fold", "step"])
