"""Score tables -> summaries.

A score table has one row per (method, split, embedding, fold) with the
columns of :data:`equilibra.operators.metrics.SCORE_COLUMNS`.  Score tables are
small (methods x embeddings x folds); prediction-level inputs (A14, A15, A17)
are aggregated with map-side combine first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import t_pvalue
from .metrics import ALL, _div, _ind, confusion_by_group, counterfactual_mismatch, f1_columns, rate_columns

RATIO_MEASURES = ("tpr", "fpr", "auc", "f1", "f1_pos", "f1_neg")
AVG_RATIO_MEASURES = ("tpr", "fpr", "f1", "f1_pos", "f1_neg")
PAIRED_MEASURES = ("tpr_r", "fpr_r", "f1_r", "f1", "mismatch_ratio",
                   "tpr_f", "tpr_m", "fpr_f", "fpr_m", "f1_f", "f1_m")
SUMMARY_COLUMNS = ("mismatch_ratio", "avg_tpr_r", "avg_fpr_r", "avg_f1_r", "avg_f1_pos_r", "avg_f1_neg_r",
                   "tpr_r", "fpr_r", "f1_r", "tpr_f", "tpr_m", "fpr_f", "fpr_m", "f1_f", "f1_m",
                   "f1_pos_r", "f1_neg_r", "auc_r", "auc_minmax", "f1", "auc")


def measure_ratio(a: Column, b: Column, digits: int = 3) -> Column:
    """min / max rounded; null if either is null or the max is 0 (A10)."""
    hi = F.greatest(a, b)
    return F.when(a.isNotNull() & b.isNotNull() & (hi != 0), F.round(F.least(a, b) / hi, digits))


def direction_label(v: Column) -> Column:
    """Ratio > 1 -> '<round(1/v, 2)>_F', else '<v>_M'."""
    return F.when(v > 1, F.concat(F.format_string("%.2f", F.round(1 / v, 2)), F.lit("_F"))) \
        .otherwise(F.concat(F.when(v.isNotNull(), F.format_string("%.6f", v)), F.lit("_M")))


def last_per_fold(scores: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Keep the last row per key when a ``seq`` column records write order."""
    if seq not in scores.columns:
        return scores
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return scores.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def with_ratios(scores: DataFrame) -> DataFrame:
    """Per-row F/M ratios ``<m>_r`` (A10)."""
    return scores.select("*", *[measure_ratio(F.col(f"{m}_f"), F.col(f"{m}_m")).alias(f"{m}_r")
                                for m in RATIO_MEASURES])


def summarize(scores: DataFrame, by: Sequence[str], fold: str = "fold") -> DataFrame:
    """A16 numeric core: means over folds (A12), ratio of means (A13), 21 columns."""
    r = with_ratios(last_per_fold(scores, [*by, fold]))
    numeric = [c for c, t in r.dtypes if c not in (*by, fold) and t in ("double", "bigint", "int")]
    means = r.groupBy(*by).agg(*[F.avg(c).alias(c) for c in numeric])
    means = means.select("*", *[measure_ratio(F.col(f"{m}_f"), F.col(f"{m}_m")).alias(f"avg_{m}_r")
                                for m in AVG_RATIO_MEASURES])
    return means.select(*by, *SUMMARY_COLUMNS)


def _long(scores: DataFrame, keys: Sequence[str], measures: Sequence[str], pair: bool) -> DataFrame:
    if pair:
        items = [F.struct(F.lit(m).alias("measure"), F.col(f"{m}_f").alias("a"), F.col(f"{m}_m").alias("b"))
                 for m in measures]
    else:
        items = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("a")) for m in measures]
    return scores.select(*keys, F.explode(F.array(*items)).alias("x")).select(*keys, "x.*")


def welch_stats(scores: DataFrame, by: Sequence[str], measures: Sequence[str] = RATIO_MEASURES) -> DataFrame:
    """H1: Welch t and degrees of freedom, F vs M across folds, per (by, measure)."""
    long = _long(with_ratios(scores), by, measures, pair=True)
    agg = long.groupBy(*by, "measure").agg(
        F.count("a").alias("n_f"), F.count("b").alias("n_m"), F.avg("a").alias("mean_f"),
        F.avg("b").alias("mean_m"), F.var_samp("a").alias("var_f"), F.var_samp("b").alias("var_m"))
    qf = F.col("var_f") / F.col("n_f")
    qm = F.col("var_m") / F.col("n_m")
    se2 = qf + qm
    ok = (F.col("n_f") >= 2) & (F.col("n_m") >= 2) & (se2 > 0)
    t = F.when(ok, (F.col("mean_f") - F.col("mean_m")) / F.sqrt(se2))
    df = F.when(ok, se2 * se2 / (qf * qf / (F.col("n_f") - 1) + qm * qm / (F.col("n_m") - 1)))
    return agg.select(*by, "measure", F.col("n_f").cast("bigint").alias("n_f"),
                      F.col("n_m").cast("bigint").alias("n_m"), t.alias("t"), df.alias("df"))


def paired_stats(scores: DataFrame, method: str = "method", baseline: str = "orig",
                 by: Sequence[str] = ("embedding",), fold: str = "fold",
                 measures: Sequence[str] = PAIRED_MEASURES) -> DataFrame:
    """Paired t (baseline - method) across folds per (method, by, measure)."""
    r = with_ratios(scores)
    base = r.filter(F.col(method) == baseline).select(*by, fold, *[F.col(m).alias(f"_b_{m}") for m in measures])
    other = r.filter(F.col(method) != baseline)
    j = other.join(base, [*by, fold])
    diffs = [F.struct(F.lit(m).alias("measure"), (F.col(f"_b_{m}") - F.col(m)).cast("double").alias("d"))
             for m in measures]
    long = j.select(method, *by, F.explode(F.array(*diffs)).alias("x")).select(method, *by, "x.*")
    agg = long.groupBy(method, *by, "measure").agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"),
                                                   F.stddev_samp("d").alias("sd_diff"))
    ok = (F.col("n") >= 2) & (F.col("sd_diff") > 0)
    t = F.when(ok, F.col("mean_diff") / (F.col("sd_diff") / F.sqrt(F.col("n"))))
    return agg.select(method, *by, "measure", F.col("n").cast("bigint").alias("n"), "mean_diff",
                      t.alias("t"), F.when(ok, F.col("n") - 1).cast("double").alias("df"))


def with_pvalues(stats: DataFrame, alpha: float = 0.05) -> DataFrame:
    p = t_pvalue("t", "df")
    return stats.withColumn("p_value", p).withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def formatted_summary(summary: DataFrame, welch: DataFrame, paired: DataFrame | None,
                      by: Sequence[str], method: str = "method") -> DataFrame:
    """Summary values as strings with '*' (F vs M) and '+' (vs baseline) marks (long form)."""
    long = _long(summary, by, SUMMARY_COLUMNS, pair=False).withColumnRenamed("a", "value")
    star = (welch.filter("significant").select(*by, F.concat(F.col("measure"), F.lit("_r")).alias("measure"),
                                               F.lit("*").alias("star")))
    out = long.join(star, [*by, "measure"], "left")
    if paired is not None:
        keys = list(dict.fromkeys([*by, method]))
        plus = paired.filter("significant").select(*keys, "measure", F.lit("+").alias("plus"))
        out = out.join(plus, [*keys, "measure"], "left")
    else:
        out = out.withColumn("plus", F.lit(None).cast("string"))
    text = F.concat(F.coalesce(F.when(F.col("value").isNotNull(), F.format_string("%.6f", "value")), F.lit("nan")),
                    F.coalesce(F.col("star"), F.lit("")), F.coalesce(F.col("plus"), F.lit("")))
    return out.select(*by, "measure", "value", text.alias("text"))


# ---------------------------------------------------------------- prediction-level

def prob_by_group_label(df: DataFrame, keys: Sequence[str], group: str = "gender",
                        label: str = "label", score: str = "probability") -> DataFrame:
    """Mean score per (keys, group) and (keys, group, label), both halves."""
    fine = df.groupBy(*keys, group, label).agg(F.sum(score).alias("_s"), F.count(score).alias("_n"))
    coarse = (fine.groupBy(*keys, group).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
              .select(*keys, group, F.lit(None).cast("int").alias(label), "_s", "_n"))
    both = fine.unionByName(coarse)
    return both.select(*keys, group, label, _div(F.col("_s"), F.col("_n")).alias("mean_prob"),
                       F.col("_n").cast("bigint").alias("n"))


def fold_ratio(df: DataFrame, keys: Sequence[str], groups: tuple[str, str] = ("F", "M"),
               variant: str = "variant") -> DataFrame:
    """A15 (study 1): rates over both halves rounded to 2, F/M ratio folded below 1."""
    conf = confusion_by_group(df, keys).select("*", *rate_columns(), *f1_columns())
    g0, g1 = groups
    cols = []
    for m in ("fnr", "fpr", "tpr"):
        for g in groups:
            cols.append(F.round(F.max(F.when(F.col("gender") == g, F.col(m))), 2).alias(f"{m}_{g.lower()}"))
    cols.append(F.round(F.max(F.when(F.col("gender") == ALL, F.col("f1"))), 2).alias("f1"))
    wide = conf.groupBy(*keys).agg(*cols)
    out = []
    for m in ("fnr", "fpr", "tpr"):
        r = _div(F.col(f"{m}_{g0.lower()}"), F.col(f"{m}_{g1.lower()}"))
        out.append(F.when(r < 1, F.round(r, 2)).otherwise(F.round(1 / r, 2)).alias(f"{m}_r"))
    wide = wide.select("*", *out)
    mm = counterfactual_mismatch(df, keys, variant=variant).select(*keys, "mismatch", "total_num")
    return wide.join(mm, list(keys), "left")


def classification_report(df: DataFrame, keys: Sequence[str], label: str = "label",
                          pred: str = "preds") -> DataFrame:
    """Per-class precision / recall / F1 / support, plus macro and weighted averages."""
    y, p = F.col(label), F.col(pred)
    c = df.groupBy(*keys).agg(
        F.sum(_ind((y == 0) & (p == 0))).alias("tn"), F.sum(_ind((y == 0) & (p == 1))).alias("fp"),
        F.sum(_ind((y == 1) & (p == 0))).alias("fn"), F.sum(_ind((y == 1) & (p == 1))).alias("tp"))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))

    def row(cls: str, hit: Column, pred_n: Column, true_n: Column) -> Column:
        prec = F.coalesce(_div(hit, pred_n), F.lit(0.0))
        rec = F.coalesce(_div(hit, true_n), F.lit(0.0))
        f1 = F.coalesce(_div(2 * hit, pred_n + true_n), F.lit(0.0))
        return F.struct(F.lit(cls).alias("class"), prec.alias("precision"), rec.alias("recall"),
                        f1.alias("f1"), true_n.cast("bigint").alias("support"),
                        pred_n.cast("bigint").alias("_pred_n"))

    per = c.select(*keys, F.explode(F.array(row("0", tn, tn + fn, tn + fp), row("1", tp, tp + fp, tp + fn)))
                   .alias("r")).select(*keys, "r.*")
    # labels present in the truth or the predictions
    present = per.filter(F.col("support") + F.col("_pred_n") > 0)
    per = per.drop("_pred_n")
    avg = present.groupBy(*keys).agg(
        F.avg("precision").alias("p_m"), F.avg("recall").alias("r_m"), F.avg("f1").alias("f_m"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("p_w"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("r_w"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f_w"),
        F.sum("support").cast("bigint").alias("n"))
    avgs = avg.select(*keys, F.explode(F.array(
        F.struct(F.lit("macro avg").alias("class"), F.col("p_m").alias("precision"), F.col("r_m").alias("recall"),
                 F.col("f_m").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("p_w").alias("precision"),
                 F.col("r_w").alias("recall"), F.col("f_w").alias("f1"), F.col("n").alias("support"))))
        .alias("r")).select(*keys, "r.*")
    return per.unionByName(avgs)
