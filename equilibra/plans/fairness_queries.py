"""Group and counterfactual fairness over the `predictions` view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources import views
from .oracle_views import with_views
from .registry import register

KEYS = ["embedding", "fold"]

# ------------------------------------------------------------------ SQL parts

SQL_CONFUSION_T = """
, o AS (SELECT * FROM {src} WHERE variant = 'orig')
, per AS (SELECT {k}, gender,
    CAST(sum(CASE WHEN label = 0 AND preds = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(sum(CASE WHEN label = 0 AND preds = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN label = 1 AND preds = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(sum(CASE WHEN label = 1 AND preds = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp
  FROM o GROUP BY {k}, gender)
, conf AS (SELECT {k}, gender, tn, fp, fn, tp FROM per
  UNION ALL
  SELECT {k}, 'ALL' AS gender, CAST(sum(tn) AS BIGINT), CAST(sum(fp) AS BIGINT),
    CAST(sum(fn) AS BIGINT), CAST(sum(tp) AS BIGINT) FROM per GROUP BY {k})
, gm AS (SELECT *, tp + fn AS pos, tn + fp AS neg,
    CASE WHEN fn + tp <> 0 THEN CAST(fn AS DOUBLE) / (fn + tp) END AS fnr,
    CASE WHEN fp + tn <> 0 THEN CAST(fp AS DOUBLE) / (fp + tn) END AS fpr,
    CASE WHEN tp + fn <> 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END AS tpr,
    CASE WHEN tp + fp <> 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
    coalesce(CASE WHEN 2 * tp + fp + fn <> 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 0.0) AS f1_pos,
    coalesce(CASE WHEN 2 * tn + fp + fn <> 0 THEN CAST(2 * tn AS DOUBLE) / (2 * tn + fp + fn) END, 0.0) AS f1_neg,
    CASE WHEN tp + fn + fp > 0 THEN 1 ELSE 0 END AS has_pos,
    CASE WHEN tn + fp + fn > 0 THEN 1 ELSE 0 END AS has_neg
  FROM conf)
, gmf AS (SELECT *, CASE WHEN has_pos + has_neg <> 0
    THEN (f1_pos * has_pos + f1_neg * has_neg) / (has_pos + has_neg) END AS f1 FROM gm)
"""

SQL_AUC_T = """
, o2 AS (SELECT * FROM {src} WHERE variant = 'orig')
, sl AS (SELECT {k}, gender AS slice, label, probability FROM o2
  UNION ALL SELECT {k}, 'ALL', label, probability FROM o2
  UNION ALL SELECT {k},
    CASE WHEN (gender = 'F') = (label = 1) THEN 'fm' ELSE 'mf' END, label, probability FROM o2)
, rk AS (SELECT *, rank() OVER (PARTITION BY {k}, slice ORDER BY probability)
    + (count(*) OVER (PARTITION BY {k}, slice, probability) - 1) / 2.0 AS mr FROM sl)
, au AS (SELECT {k}, slice,
    CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN
      (sum(CASE WHEN label = 1 THEN mr ELSE 0 END)
       - CAST(sum(label) AS DOUBLE) * (CAST(sum(label) AS DOUBLE) + 1) / 2.0)
      / (CAST(sum(label) AS DOUBLE) * CAST(sum(1 - label) AS DOUBLE)) END AS auc
  FROM rk GROUP BY {k}, slice)
, aw AS (SELECT {k},
    max(CASE WHEN slice = 'F' THEN auc END) AS auc_f, max(CASE WHEN slice = 'M' THEN auc END) AS auc_m,
    max(CASE WHEN slice = 'ALL' THEN auc END) AS auc, max(CASE WHEN slice = 'fm' THEN auc END) AS auc_fm,
    max(CASE WHEN slice = 'mf' THEN auc END) AS auc_mf FROM au GROUP BY {k})
, awm AS (SELECT *, CASE WHEN auc_f IS NOT NULL AND auc_m IS NOT NULL AND auc_fm IS NOT NULL
    AND auc_mf IS NOT NULL AND greatest(auc_f, auc_m, auc_fm, auc_mf) <> 0
    THEN least(auc_f, auc_m, auc_fm, auc_mf) / greatest(auc_f, auc_m, auc_fm, auc_mf) END AS auc_minmax
  FROM aw)
"""

SQL_MISMATCH_T = """
, pr AS (SELECT {k}, row_id,
    max(CASE WHEN variant = 'orig' THEN preds END) AS p0, max(CASE WHEN variant = 'swapped' THEN preds END) AS p1,
    max(CASE WHEN variant = 'orig' THEN gender END) AS g0, max(CASE WHEN variant = 'swapped' THEN gender END) AS g1
  FROM {src} WHERE variant IN ('orig', 'swapped') GROUP BY {k}, row_id)
, pd AS (SELECT *, (p0 IS NOT NULL AND p1 IS NOT NULL AND p0 <> p1) AS diff FROM pr)
, ma AS (SELECT {k}, CAST(count(p0) AS BIGINT) AS total_num,
    CAST(sum(CASE WHEN diff THEN 1 ELSE 0 END) AS BIGINT) AS mismatch,
    CAST(sum(CASE WHEN diff THEN (CASE WHEN g0 = 'F' THEN p0 ELSE 0 END) + (CASE WHEN g1 = 'F' THEN p1 ELSE 0 END)
             ELSE 0 END) AS BIGINT) AS mismatch_f,
    CAST(sum(CASE WHEN diff THEN (CASE WHEN g0 <> 'F' THEN p0 ELSE 0 END) + (CASE WHEN g1 <> 'F' THEN p1 ELSE 0 END)
             ELSE 0 END) AS BIGINT) AS mismatch_m
  FROM pd GROUP BY {k})
, mm AS (SELECT {k}, total_num, mismatch,
    CASE WHEN mismatch_m > mismatch_f THEN 'M' ELSE 'F' END AS mismatch_direction, mismatch_f, mismatch_m,
    CASE WHEN total_num <> 0 THEN CAST(mismatch AS DOUBLE) / total_num END AS mismatch_ratio FROM ma)
"""


def sql_parts(keys: list[str], src: str) -> tuple[str, str, str]:
    """Confusion / AUC / mismatch CTE chains over ``src`` grouped by ``keys``."""
    k = ", ".join(keys)
    return tuple(t.replace("{k}", k).replace("{src}", src)
                 for t in (SQL_CONFUSION_T, SQL_AUC_T, SQL_MISMATCH_T))


def sql_evaluate(keys: list[str], src: str) -> str:
    """CTE chain ending in ``ev``: one score row per key."""
    conf, auc, mism = sql_parts(keys, src)
    sel = ", ".join(f"mm.{c}" for c in keys)
    return (conf + auc + mism + _wide_sql(keys)
            + f", ev AS (SELECT {sel}, " + ", ".join(metrics.SCORE_COLUMNS)
            + f" FROM mm LEFT JOIN wd USING ({', '.join(keys)}) LEFT JOIN awm USING ({', '.join(keys)}))\n")


SQL_CONFUSION, SQL_AUC, SQL_MISMATCH = sql_parts(KEYS, "predictions")


def _wide_sql(keys: list[str] = KEYS) -> str:
    cols = []
    for g in ("F", "M"):
        for m in metrics.GROUP_MEASURES:
            cols.append(f"max(CASE WHEN gender = '{g}' THEN {m} END) AS {m}_{g.lower()}")
    for m in ("tpr", "precision", "f1"):
        cols.append(f"max(CASE WHEN gender = 'ALL' THEN {m} END) AS {m}")
    k = ", ".join(keys)
    return (f", wd AS (SELECT {k}, " + ", ".join(cols) + f" FROM gmf GROUP BY {k})\n")


SQL_EVALUATE = with_views(sql_evaluate(KEYS, "predictions") + "SELECT * FROM ev", "predictions")


def _orig(spark: SparkSession, sf: str) -> DataFrame:
    return views.predictions(spark, sf).filter(F.col("variant") == "orig")


@register("group_confusion", "A1 A6 P3 P5",
          with_views(SQL_CONFUSION + "SELECT embedding, fold, gender, tn, fp, fn, tp, pos, neg FROM gmf",
                     "predictions"))
def group_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_by_group(_orig(spark, sf), KEYS)


@register("group_rates", "A2",
          with_views(SQL_CONFUSION + "SELECT embedding, fold, gender, fnr, fpr, tpr, precision FROM gmf",
                     "predictions"))
def group_rates(spark: SparkSession, sf: str) -> DataFrame:
    gm = metrics.group_metrics(_orig(spark, sf), KEYS)
    return gm.select(*KEYS, "gender", "fnr", "fpr", "tpr", "precision")


@register("group_f1", "A3",
          with_views(SQL_CONFUSION + "SELECT embedding, fold, gender, f1_pos, f1_neg, f1 FROM gmf",
                     "predictions"))
def group_f1(spark: SparkSession, sf: str) -> DataFrame:
    gm = metrics.group_metrics(_orig(spark, sf), KEYS)
    return gm.select(*KEYS, "gender", "f1_pos", "f1_neg", "f1")


@register("group_auc", "A4 W7",
          with_views(SQL_AUC + "SELECT embedding, fold, slice AS gender, auc FROM au "
                     "WHERE slice IN ('F', 'M', 'ALL')", "predictions"))
def group_auc(spark: SparkSession, sf: str) -> DataFrame:
    s = metrics.auc_by_slice(_orig(spark, sf), KEYS, domain=metrics.PROBABILITY)
    return s.filter(F.col("slice").isin("F", "M", "ALL")).select(*KEYS, F.col("slice").alias("gender"), "auc")


@register("cross_group_auc", "A5",
          with_views(SQL_AUC + "SELECT embedding, fold, auc_fm, auc_mf FROM awm", "predictions"))
def cross_group_auc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auc_wide(_orig(spark, sf), KEYS, domain=metrics.PROBABILITY).select(*KEYS, "auc_fm", "auc_mf")


@register("auc_minmax", "A11",
          with_views(SQL_AUC + "SELECT embedding, fold, auc_f, auc_m, auc_fm, auc_mf, auc_minmax FROM awm",
                     "predictions"))
def auc_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auc_wide(_orig(spark, sf), KEYS, domain=metrics.PROBABILITY).select(*KEYS, "auc_f", "auc_m", "auc_fm", "auc_mf",
                                                           "auc_minmax")


@register("counterfactual_mismatch", "A8 A9 J2",
          with_views(SQL_MISMATCH + "SELECT * FROM mm", "predictions"))
def counterfactual_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.counterfactual_mismatch(views.predictions(spark, sf), KEYS)


@register("evaluate", "A7", SQL_EVALUATE)
def evaluate(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.evaluate(views.predictions(spark, sf), KEYS, score_domain=metrics.PROBABILITY)
