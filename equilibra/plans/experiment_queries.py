"""Composed experiments (M22, M23, M24; rows-only checks).

Each composes operators that are oracle-checked elsewhere; what is new here is
the wiring: trained models feed the fairness tables, fold by fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attribution as AT
from ..operators import batched as BA
from ..operators import embeddings as E
from ..operators import linear as LI
from ..operators import metrics, summary
from ..operators.models import C_GRID
from ..session import cut_lineage
from ..sources import views
from .embedding_queries import pair_diffs
from .model_queries import (FOLDS, TrainingSet, batch_rows, fold_sets, halves, ranked_features, roar_predictions,
                            study1_models, tasks_of)
from .registry import register

# The four training treatments of the study-1 experiment.
STUDY1_TREATMENTS = ("orig", "swapped", "neutr", "augmented")
STUDY1_FOLDS = 10  # Fixed value: the splits that study 1 runs


@register("study1_experiment", "M22 M4 A14 A15")
def study1_experiment(spark: SparkSession, sf: str, folds: Sequence[int] = range(STUDY1_FOLDS)) -> DataFrame:
    """Per treatment and fold: 3-fold model selection on the training rows, scored on the paired
    test set; rates, ratios, mismatch (A15) and mean probabilities (A14) over both halves."""
    named = [((tr, k), k, tr) for tr in STUDY1_TREATMENTS for k in folds]
    models = study1_models(spark, sf, named, STUDY1_FOLDS)  # all treatments, folds, parts and C: two batches
    pred = None
    for tr in STUDY1_TREATMENTS:
        own = {key[1:]: m for key, m in models.items() if key[0] == tr}
        part = halves(LI.score(own, fold_sets(spark, sf, tr, n_folds=STUDY1_FOLDS)["test"], ["fold"]))
        part = part.withColumn("treatment", F.lit(tr))
        pred = part if pred is None else pred.unionByName(part)
    pred = cut_lineage(pred.drop("features"))
    ratio = summary.fold_ratio(pred, ["treatment", "fold"])
    probs = summary.prob_by_group_label(pred, ["treatment", "fold"]).filter(F.col("label").isNull())
    wide = probs.groupBy("treatment", "fold").agg(
        *[F.max(F.when(F.col("gender") == g, F.col("mean_prob"))).alias(f"prob_{g.lower()}") for g in ("F", "M")])
    return ratio.join(wide, ["treatment", "fold"], "left")


@register("embedding_bias_experiment", "M23 E6 E7 E8 E9")
def embedding_bias_experiment(spark: SparkSession, sf: str) -> DataFrame:
    """Gender direction = first principal component of the definitional-pair differences;
    direct bias of every term against it, summarised per category."""
    pc, _ = E.gender_direction(pair_diffs(spark, sf))
    direction = spark.createDataFrame([(pc,)], "direction array<double>")  # one d-sized row
    terms = views.table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("category"),
                                                        F.col("embedding").alias("vector"))
    scored = E.direct_bias(terms, direction)
    return E.direct_bias_summary(scored)


EXPLAINERS = ("linear", "permutation", "pearson", "random")


def proxy_ranking(s: dict[str, DataFrame], fold: int, explainer: str, proxy: LI.LinearModel | None) -> DataFrame:
    """The fold's features ranked by what they tell about gender.

    ``linear`` explains the gender classifier on training and validation rows
    together, ``permutation`` on the validation rows; ``pearson`` correlates the
    validation features with gender; ``random`` is a control.
    """
    s = {name: df.withColumn("gcode", T.gender_code("gender")) for name, df in s.items()}
    if explainer == "random":
        return AT.random_ranking_of(s["train"], seed=fold)
    if explainer == "pearson":
        return AT.pcc_ranking(s["val"])
    if explainer == "permutation":
        return AT.permutation_importance(proxy.standardise(s["val"]), proxy.coef, proxy.intercept, label="gcode")
    if explainer != "linear":
        raise ValueError(f"explainer must be one of {EXPLAINERS}")
    z = proxy.standardise(s["train"].unionByName(s["val"]))
    return AT.linear_attribution(z, z, proxy.coef)


def proxy_pipeline(spark: SparkSession, sf: str, explainer: str = "linear", method: str = "mute") -> DataFrame:
    """Per fold, rank features by a proxy explanation, take them out step by step (``mute``: their
    training mean, same model; ``roar``: refitted without them) on validation and test pairs, and
    select a step on validation (M19).  The gender and label models of all folds are one batch."""
    if method not in ("mute", "roar"):
        raise ValueError("method must be mute or roar")
    splits = {"val": "val_pairs", "test": "test"}
    folds = range(FOLDS)
    asked = [*([("proxy", "group")] if explainer in ("linear", "permutation") else []), *([("label", "label")] if method == "mute" else [])]
    tasks, sets = tasks_of(((name, k), TrainingSet(k)) for name, _ in asked for k in folds)
    tasks = [BA.replace(t, target=dict(asked)[t.key[0]]) for t in tasks]
    models: dict[tuple, LI.LinearModel] = {}
    if tasks:
        with batch_rows(spark, sf, sets) as rows:
            models = BA.grid_search(rows, tasks, C_GRID)[0]
    rankings = {k: cut_lineage(proxy_ranking(fold_sets(spark, sf, fold=k), k, explainer, models.get(("proxy", k)))) for k in folds}
    if method == "roar":
        steps = roar_predictions(spark, sf, {k: ranked_features(r) for k, r in rankings.items()}, splits)
    else:
        s, pairs = fold_sets(spark, sf), None
        for name, which in splits.items():
            part = halves(s[which]).withColumn("split", F.lit(name))
            pairs = part if pairs is None else pairs.unionByName(part)
        ranking = None
        for k, r in rankings.items():
            r = r.select(F.lit(k).alias("fold"), "feature_idx", "rank")
            ranking = r if ranking is None else ranking.unionByName(r)
        own = {k: models["label", k] for k in folds if ("label", k) in models}
        weights = spark.createDataFrame([(k, list(m.mean), [1 / v if v else 0.0 for v in m.scale], list(m.coef), m.intercept)
                                         for k, m in own.items()],
                                        "fold int, mu array<double>, sd array<double>, beta array<double>, intercept double")
        z = AT.standardize(pairs, weights.select("fold", "mu", "sd"), by=["fold"]).select(
            "fold", "split", "row_id", "variant", "gender", "label", "z")
        steps = AT.iterative_mute(z, ranking, weights.select("fold", "beta", "intercept"), key="row_id",
                                  keys=["fold", "split", "variant"], by=["fold"])
        steps = steps.withColumnRenamed("margin", "probability")  # AUC needs the order only
    scores = metrics.evaluate(cut_lineage(steps), ["fold", "split", "step"])
    return AT.select_step(scores, ["fold"])


@register("proxy_mute_pipeline", "M24 M12 M13 M17 M19")
def proxy_mute_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return proxy_pipeline(spark, sf, "linear", "mute")


@register("proxy_pearson_mute", "M24 M15 M17 M19")
def proxy_pearson_mute(spark: SparkSession, sf: str) -> DataFrame:
    return proxy_pipeline(spark, sf, "pearson", "mute")
