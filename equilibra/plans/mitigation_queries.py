"""Reweighing, reject-option post-processing and participatory selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds as FO
from ..operators import metrics
from ..operators import mitigation as MI
from ..sources import views
from .fold_queries import _ROLES_SQL, _assign_sql, assignments, cohort_notes
from .oracle_views import with_views
from .registry import register
from .fairness_queries import sql_evaluate
from .summary_queries import METHODS, method_predictions, scores, sql_scores

KEYS = ["embedding", "fold"]


@register("reweighing", "M9",
          with_views(_assign_sql(2, True) + _ROLES_SQL +
                     ", tr AS (SELECT r.seed, r.fold, r.row_id, c.gender, c.label FROM roles r JOIN co c"
                     " ON r.row_id = c.row_id WHERE r.role = 'train')\n"
                     ", cell AS (SELECT seed, fold, gender, label, count(*) AS ngy FROM tr GROUP BY ALL)\n"
                     ", bg AS (SELECT seed, fold, gender, sum(ngy) AS ng FROM cell GROUP BY ALL)\n"
                     ", byy AS (SELECT seed, fold, label, sum(ngy) AS ny FROM cell GROUP BY ALL)\n"
                     ", tot AS (SELECT seed, fold, sum(ngy) AS n FROM cell GROUP BY ALL)\n"
                     "SELECT t.seed, t.fold, t.row_id, t.gender, t.label,"
                     " CAST(bg.ng * byy.ny AS DOUBLE) / (tot.n * cell.ngy) AS weight FROM tr t"
                     " JOIN cell USING (seed, fold, gender, label) JOIN bg USING (seed, fold, gender)"
                     " JOIN byy USING (seed, fold, label) JOIN tot USING (seed, fold)", "notes"))
def reweighing(spark: SparkSession, sf: str) -> DataFrame:
    roles = FO.fold_roles(assignments(spark, sf, mention=True))
    tr = roles.filter(F.col("role") == "train").join(cohort_notes(spark, sf).select("row_id", "gender", "label"),
                                                     "row_id")
    w = MI.reweighing(tr, ["seed", "fold"])
    return w.select("seed", "fold", "row_id", "gender", "label", "weight")


def _grid_sql(num_t: int = 100, num_m: int = 50) -> str:
    lo, hi = "CAST(0.01 AS DOUBLE)", "CAST(0.99 AS DOUBLE)"
    return (f", gi AS (SELECT CAST(t.i AS INTEGER) AS i, CASE WHEN t.i = {num_t - 1} THEN {hi}"
            f" ELSE t.i * (({hi} - {lo}) / {num_t - 1}) + {lo} END AS t FROM range(0, {num_t}) t(i))\n"
            ", gh AS (SELECT i, t, CASE WHEN t <= 0.5 THEN t ELSE 1.0 - t END AS hm FROM gi)\n"
            f", grid AS (SELECT CAST(i * {num_m} + j.j AS INTEGER) AS gid, t, CASE WHEN j.j = {num_m - 1} THEN hm"
            f" ELSE j.j * (hm / {num_m - 1}) END AS m FROM gh, range(0, {num_m}) j(j))\n")


_ROC_GRID_SQL = _grid_sql() + (
    ", cn AS (SELECT p.embedding, p.fold, g.gid, g.t, g.m,"
    " sum(CASE WHEN p.gender = 'F' AND p.label = 1 AND p.probability > g.t + g.m THEN 1 ELSE 0 END) AS pp_gt,"
    " sum(CASE WHEN p.gender = 'F' AND p.label <> 1 AND p.probability > g.t + g.m THEN 1 ELSE 0 END) AS pn_gt,"
    " sum(CASE WHEN p.gender <> 'F' AND p.label = 1 AND p.probability > g.t - g.m THEN 1 ELSE 0 END) AS up_gt,"
    " sum(CASE WHEN p.gender <> 'F' AND p.label <> 1 AND p.probability > g.t - g.m THEN 1 ELSE 0 END) AS un_gt,"
    " sum(CASE WHEN p.gender = 'F' AND p.label = 1 THEN 1 ELSE 0 END) AS pp_all,"
    " sum(CASE WHEN p.gender = 'F' AND p.label <> 1 THEN 1 ELSE 0 END) AS pn_all,"
    " sum(CASE WHEN p.gender <> 'F' AND p.label = 1 THEN 1 ELSE 0 END) AS up_all,"
    " sum(CASE WHEN p.gender <> 'F' AND p.label <> 1 THEN 1 ELSE 0 END) AS un_all"
    " FROM predictions p, grid g WHERE p.probability IS NOT NULL GROUP BY p.embedding, p.fold, g.gid, g.t, g.m)\n"
    ", mt AS (SELECT embedding, fold, gid, t, m,"
    " (CASE WHEN pp_all + up_all <> 0 THEN CAST(pp_gt + up_gt AS DOUBLE) / (pp_all + up_all) END"
    " + CASE WHEN pn_all + un_all <> 0 THEN CAST((pn_all + un_all) - (pn_gt + un_gt) AS DOUBLE) / (pn_all + un_all)"
    " END) / 2 AS balanced_accuracy,"
    " ((CASE WHEN un_all <> 0 THEN CAST(un_gt AS DOUBLE) / un_all END"
    " - CASE WHEN pn_all <> 0 THEN CAST(pn_gt AS DOUBLE) / pn_all END)"
    " + (CASE WHEN up_all <> 0 THEN CAST(up_gt AS DOUBLE) / up_all END"
    " - CASE WHEN pp_all <> 0 THEN CAST(pp_gt AS DOUBLE) / pp_all END)) / 2 AS avg_odds_diff FROM cn)\n"
    ", ok AS (SELECT *, coalesce(avg_odds_diff >= -0.05 AND avg_odds_diff <= 0.05, false) AS within_bound FROM mt)\n"
    ", ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY embedding, fold ORDER BY within_bound DESC,"
    " CASE WHEN within_bound THEN -balanced_accuracy ELSE abs(avg_odds_diff) END ASC NULLS LAST, gid) AS rn"
    " FROM ok) WHERE rn = 1)\n")


def chosen(spark: SparkSession, sf: str) -> DataFrame:
    return MI.reject_option_fit(views.predictions(spark, sf), KEYS)


@register("reject_option_grid", "M10 J8 W5 Q13",
          with_views(_ROC_GRID_SQL + "SELECT embedding, fold, gid, t, m, balanced_accuracy, avg_odds_diff,"
                     " within_bound FROM ch", "predictions"))
def reject_option_grid(spark: SparkSession, sf: str) -> DataFrame:
    return chosen(spark, sf)


@register("reject_option_apply", "M10",
          with_views(_ROC_GRID_SQL + "SELECT p.row_id, p.embedding, p.fold, p.variant, p.gender, p.label,"
                     " p.probability, CASE WHEN (CASE WHEN p.gender = 'F' THEN p.probability > c.t + c.m"
                     " ELSE p.probability > c.t - c.m END) THEN 1 ELSE 0 END AS preds"
                     " FROM predictions p LEFT JOIN ch c USING (embedding, fold)", "predictions"))
def reject_option_apply(spark: SparkSession, sf: str) -> DataFrame:
    p = views.predictions(spark, sf).drop("preds")
    return MI.reject_option_apply(p, chosen(spark, sf), KEYS)


# The study chooses among four methods, on F1; here they are four decision rules
PARTICIPATORY_RULES = (*METHODS, ("threshold_20", 0.2), ("threshold_65", 0.65))
PARTICIPATORY_METHODS = [m for m, _ in PARTICIPATORY_RULES]
MEASURE = "f1"

# fixed values: published two-sided 5 % points of Student t for 1 to 30 degrees of freedom
T_TABLE = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
           2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)


def _crit_sql() -> str:
    return "[" + ", ".join(map(str, T_TABLE)) + "]"


_CHOICE_SQL = sql_scores(PARTICIPATORY_RULES) + (
    ", lg AS (SELECT method, embedding, fold, 'F' AS gender, CAST(f1_f AS DOUBLE) AS v FROM ev"
    " UNION ALL SELECT method, embedding, fold, 'M', CAST(f1_m AS DOUBLE) FROM ev)\n"
    ", mo AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {i})" for i, m in enumerate(PARTICIPATORY_METHODS))
    + ") t(method, ord))\n"
    ", mn AS (SELECT method, embedding, gender, avg(v) AS mean FROM lg GROUP BY ALL)\n"
    ", bt AS (SELECT embedding, gender, method AS best_method FROM (SELECT mn.*, row_number() OVER (PARTITION BY"
    " embedding, gender ORDER BY round(mean, 9) DESC NULLS LAST, mo.ord) AS rn FROM mn JOIN mo USING (method)) WHERE rn = 1)\n"
    ", bs AS (SELECT embedding, fold, gender, v AS b FROM lg WHERE method = 'orig')\n"
    ", cd AS (SELECT l.method AS best_method, l.gender, bs.b - l.v AS d FROM lg l JOIN bs USING (embedding, fold, gender))\n"
    ", st AS (SELECT best_method, gender, count(d) AS n, avg(d) AS md, stddev_samp(d) AS sd FROM cd GROUP BY ALL)\n"
    ", st2 AS (SELECT best_method, gender, CASE WHEN n >= 2 AND sd > 0 THEN md / (sd / sqrt(n)) END AS t,"
    " CASE WHEN n >= 2 AND sd > 0 THEN CAST(n - 1 AS DOUBLE) END AS df FROM st)\n"
    ", choice AS (SELECT bt.embedding, bt.gender, bt.best_method, st2.t, st2.df,"
    " coalesce(abs(st2.t) > (" + _crit_sql() + ")[CAST(st2.df AS INTEGER)], false) AS significant"
    " FROM bt LEFT JOIN st2 USING (best_method, gender))\n"
    ", choice2 AS (SELECT *, CASE WHEN best_method <> 'orig' AND significant THEN best_method ELSE 'orig' END"
    " AS chosen FROM choice)\n")


def choice(spark: SparkSession, sf: str) -> DataFrame:
    return MI.participatory_choice(scores(spark, sf, PARTICIPATORY_RULES), PARTICIPATORY_METHODS, MEASURE)


@register("participatory_choice", "M11 H3 W4",
          with_views(_CHOICE_SQL + "SELECT embedding, gender, best_method, round(t, 6) AS t, df, significant, chosen"
                     " FROM choice2", "predictions"))
def participatory_choice(spark: SparkSession, sf: str) -> DataFrame:
    c = choice(spark, sf)
    return c.select("embedding", "gender", "best_method", F.round("t", 6).alias("t"), "df", "significant", "chosen")


@register("participatory", "M11 J6",
          with_views(_CHOICE_SQL + "SELECT mp.row_id, mp.embedding, mp.fold, mp.variant, mp.gender, mp.label,"
                     " mp.probability, mp.method, mp.preds FROM mp JOIN choice2 c ON c.embedding = mp.embedding"
                     " AND c.gender = mp.gender AND c.chosen = mp.method", "predictions"))
def participatory(spark: SparkSession, sf: str) -> DataFrame:
    g = MI.gather_by_group(method_predictions(spark, sf, PARTICIPATORY_RULES), choice(spark, sf))
    return g.select("row_id", "embedding", "fold", "variant", "gender", "label", "probability", "method", "preds")


_GATHERED_SQL = (_CHOICE_SQL + ", ga AS (SELECT mp.* FROM mp JOIN choice2 c ON c.embedding = mp.embedding"
                 " AND c.gender = mp.gender AND c.chosen = mp.method)\n")


@register("participatory_scores", "M11 A7",
          with_views(_GATHERED_SQL + "SELECT * FROM (WITH own AS (SELECT * FROM ga)" + sql_evaluate(KEYS, "own")
                     + "SELECT * FROM ev)", "predictions"))
def participatory_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the gathered predictions."""
    g = MI.gather_by_group(method_predictions(spark, sf, PARTICIPATORY_RULES), choice(spark, sf))
    return metrics.evaluate(g, KEYS, score_domain=metrics.PROBABILITY)
