"""Summaries over score tables of two decision rules.

The score table is built by ``evaluate`` over the `predictions` view under two
methods: ``orig`` (the given decisions) and ``threshold_50`` (decision at 0.5),
so the paired comparison (H2) has a baseline and a treatment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, summary
from ..sources import views
from .fairness_queries import sql_evaluate
from .oracle_views import with_views
from .registry import register

MKEYS = ["method", "embedding", "fold"]
BY = ["method", "embedding"]
# The two decision rules compared in the summary queries.
METHODS = (("orig", 0.35), ("threshold_50", 0.5))


def method_predictions(spark: SparkSession, sf: str, methods: Sequence[tuple[str, float]] = METHODS) -> DataFrame:
    """Predictions under each decision rule (a generator, one scan)."""
    p = views.predictions(spark, sf)
    rules = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(t).alias("thr")) for m, t in methods]))
    x = p.select("*", rules.alias("_m"))
    return x.select(*[c for c in p.columns if c != "preds"], F.col("_m.method").alias("method"),
                    F.when(F.col("probability") >= F.col("_m.thr"), 1).otherwise(0).alias("preds"))


def scores(spark: SparkSession, sf: str, methods: Sequence[tuple[str, float]] = METHODS) -> DataFrame:
    return metrics.evaluate(method_predictions(spark, sf, methods), MKEYS, score_domain=metrics.PROBABILITY)


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sql_scores(methods: Sequence[tuple[str, float]]) -> str:
    """CTEs mp (predictions by decision rule) and ev (their scores)."""
    return (", mp AS (SELECT p.row_id, p.fold, p.embedding, p.variant, p.gender, p.label, p.probability, m.method,"
            " CASE WHEN p.probability >= m.thr THEN 1 ELSE 0 END AS preds FROM predictions p CROSS JOIN ("
            + " UNION ALL ".join(f"SELECT '{m}' AS method, CAST({t} AS DOUBLE) AS thr" for m, t in methods)
            + ") m)\n" + sql_evaluate(MKEYS, "mp"))


SQL_SCORES = sql_scores(METHODS)


def _ratio_sql(a: str, b: str, digits: int = 3) -> str:
    return (f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL AND greatest({a}, {b}) <> 0 "
            f"THEN round(least({a}, {b}) / greatest({a}, {b}), {digits}) END")


SQL_RATIOS = (", rr AS (SELECT *, " + ", ".join(f"{_ratio_sql(m + '_f', m + '_m')} AS {m}_r"
                                               for m in summary.RATIO_MEASURES) + " FROM ev)\n")


def _summary_sql() -> str:
    numeric = [c for c in metrics.SCORE_COLUMNS if c != "mismatch_direction"] + [f"{m}_r" for m in
                                                                                 summary.RATIO_MEASURES]
    me = ", me AS (SELECT method, embedding, " + ", ".join(f"avg({c}) AS {c}" for c in numeric) \
         + " FROM rr GROUP BY method, embedding)\n"
    avg_r = {f"avg_{m}_r": _ratio_sql(f"{m}_f", f"{m}_m") for m in summary.AVG_RATIO_MEASURES}
    sel = [f"round({avg_r.get(c, c)}, 6) AS {c}" for c in summary.SUMMARY_COLUMNS]
    return me + "SELECT method, embedding, " + ", ".join(sel) + " FROM me"


@register("scores", "A7",
          with_views(SQL_SCORES + "SELECT * FROM ev", "predictions"))
def scores_query(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf)


@register("fairness_summary", "A16 A10 A12 A13",
          with_views(SQL_SCORES + SQL_RATIOS + _summary_sql(), "predictions"))
def fairness_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _round(summary.summarize(scores(spark, sf), BY))


def _ratio_of_means_sql() -> str:
    me = _summary_sql().split("SELECT method, embedding, round(")[0]
    sel = [f"round({_ratio_sql(f'{m}_f', f'{m}_m')}, 6) AS avg_{m}_r" for m in summary.AVG_RATIO_MEASURES]
    sel += [f"round({m}_r, 6) AS {m}_r" for m in summary.RATIO_MEASURES]
    return me + "SELECT method, embedding, " + ", ".join(sel) + " FROM me"


@register("ratio_of_means", "A13 A10",
          with_views(SQL_SCORES + SQL_RATIOS + _ratio_of_means_sql(), "predictions"))
def ratio_of_means(spark: SparkSession, sf: str) -> DataFrame:
    sc = scores(spark, sf)
    s = summary.summarize(sc, BY)
    r = summary.with_ratios(sc).groupBy(*BY).agg(
        *[F.avg(f"{m}_r").alias(f"{m}_r") for m in summary.RATIO_MEASURES])
    out = s.select(*BY, *[f"avg_{m}_r" for m in summary.AVG_RATIO_MEASURES]).join(r, BY)
    return _round(out)


def _welch_sql() -> str:
    """CTE ws: Welch t and df per method, embedding and measure."""
    lw = " UNION ALL ".join(f"SELECT method, embedding, '{m}' AS measure, {m}_f AS a, {m}_m AS b FROM rr"
                            for m in summary.RATIO_MEASURES)
    return (f", lw AS ({lw})\n"
            ", wa AS (SELECT method, embedding, measure, count(a) AS n_f, count(b) AS n_m, avg(a) AS mf,"
            " avg(b) AS mm, var_samp(a) AS vf, var_samp(b) AS vm FROM lw GROUP BY method, embedding, measure)\n"
            ", wq AS (SELECT *, vf / n_f AS qf, vm / n_m AS qm, vf / n_f + vm / n_m AS se2,"
            " (n_f >= 2 AND n_m >= 2 AND vf / n_f + vm / n_m > 0) AS ok FROM wa)\n"
            ", ws AS (SELECT method, embedding, measure, CAST(n_f AS BIGINT) AS n_f, CAST(n_m AS BIGINT) AS n_m,"
            " CASE WHEN ok THEN (mf - mm) / sqrt(se2) END AS t,"
            " CASE WHEN ok THEN se2 * se2 / (qf * qf / (n_f - 1) + qm * qm / (n_m - 1)) END AS df FROM wq)\n")


def _stat_sql(cte: str, cols: str) -> str:
    return f"SELECT method, embedding, measure, {cols}, round(t, 6) AS t, round(df, 6) AS df FROM {cte}"


@register("welch_stat", "H1", with_views(SQL_SCORES + SQL_RATIOS + _welch_sql() + _stat_sql("ws", "n_f, n_m"), "predictions"))
def welch_stat(spark: SparkSession, sf: str) -> DataFrame:
    return _round(summary.welch_stats(scores(spark, sf), BY))


def _paired_sql() -> str:
    """CTE ps: paired t and df per method, embedding and measure."""
    ms = summary.PAIRED_MEASURES
    base = "SELECT embedding, fold, " + ", ".join(f"{m} AS b_{m}" for m in ms) + " FROM rr WHERE method = 'orig'"
    lp = " UNION ALL ".join(
        f"SELECT o.method, o.embedding, '{m}' AS measure, CAST(b.b_{m} - o.{m} AS DOUBLE) AS d "
        f"FROM rr o JOIN bs b ON o.embedding = b.embedding AND o.fold = b.fold WHERE o.method <> 'orig'"
        for m in ms)
    return (f", bs AS ({base})\n, lp AS ({lp})\n"
            ", pa AS (SELECT method, embedding, measure, count(d) AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd"
            " FROM lp GROUP BY method, embedding, measure)\n"
            ", ps AS (SELECT method, embedding, measure, CAST(n AS BIGINT) AS n, mean_diff,"
            " CASE WHEN n >= 2 AND sd > 0 THEN mean_diff / (sd / sqrt(n)) END AS t,"
            " CASE WHEN n >= 2 AND sd > 0 THEN CAST(n - 1 AS DOUBLE) END AS df FROM pa)\n")


@register("paired_stat", "H2 J5", with_views(SQL_SCORES + SQL_RATIOS + _paired_sql()
                                      + _stat_sql("ps", "n, round(mean_diff, 6) AS mean_diff"), "predictions"))
def paired_stat(spark: SparkSession, sf: str) -> DataFrame:
    return _round(summary.paired_stats(scores(spark, sf), by=["embedding"]))


def p_value_sql(t: str, df: str) -> str:
    """The two-sided p-value in SQL: the incomplete beta's fraction as a list reduction, the beta by lgamma."""
    x, z = f"({df} / ({df} + {t} * {t}))", f"({t} * {t} / ({df} + {t} * {t}))"

    def side(a: str, b: str, v: str) -> str:
        coefs = (f"list_transform(range(CAST(64 + 4 * ceil(sqrt({df})) AS BIGINT), 0, -1), lambda n: CASE WHEN n % 2 = 0"
                 f" THEN (n // 2) * ({b} - n // 2) * {v} / (({a} + n - 1) * ({a} + n))"
                 f" ELSE -({a} + n // 2) * ({a} + {b} + n // 2) * {v} / (({a} + n - 1) * ({a} + n)) END)")
        front = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({v}) + {b} * ln(1 - {v}))"
        return f"{front} / {a} / list_reduce(list_prepend(CAST(1 AS DOUBLE), {coefs}), lambda r, c: 1 + c / r)"
    a, b = f"({df} / 2)", "0.5::DOUBLE"
    return (f"CASE WHEN {t} IS NULL OR {df} IS NULL THEN NULL WHEN {t} = 0 THEN 1.0::DOUBLE"
            f" WHEN {x} < ({a} + 1) / ({a} + 2.5) THEN {side(a, b, x)} ELSE 1 - {side(b, a, z)} END")


_TESTS_SQL = (SQL_SCORES + SQL_RATIOS + _welch_sql() + _paired_sql()
              + f", wp AS (SELECT *, {p_value_sql('t', 'df')} AS p_value FROM ws)\n"
              + f", pp AS (SELECT *, {p_value_sql('t', 'df')} AS p_value FROM ps)\n")


@register("significance", "H1 H2",
          with_views(_TESTS_SQL + " UNION ALL ".join(
              f"SELECT '{name}' AS test, method, embedding, measure, round(t, 6) AS t, round(df, 6) AS df,"
              f" round(p_value, 6) AS p_value, coalesce(p_value < 0.05, false) AS significant FROM {cte}"
              for name, cte in (("welch", "wp"), ("paired", "pp"))), "predictions"))
def significance(spark: SparkSession, sf: str) -> DataFrame:
    """p-values (t distribution) and marks for both tests."""
    sc = scores(spark, sf)
    w = summary.with_pvalues(summary.welch_stats(sc, BY)).withColumn("test", F.lit("welch"))
    p = summary.with_pvalues(summary.paired_stats(sc, by=["embedding"])).withColumn("test", F.lit("paired"))
    cols = ["test", "method", "embedding", "measure", "t", "df", "p_value", "significant"]
    return _round(w.select(*cols).unionByName(p.select(*cols)))


def _formatted_sql() -> str:
    table = _summary_sql()
    cut = table.index("SELECT method, embedding, round(")
    # a + mark is the method's own comparison; the baseline has none
    return (_TESTS_SQL + table[:cut] + f", sm AS ({table[cut:]})\n, lo AS (" + " UNION ALL ".join(
        f"SELECT method, embedding, '{c}' AS measure, {c} AS value FROM sm" for c in summary.SUMMARY_COLUMNS) + ")\n"
        "SELECT l.method, l.embedding, l.measure, l.value, coalesce(printf('%.6f', l.value), 'nan')"
        " || CASE WHEN w.measure IS NOT NULL THEN '*' ELSE '' END || CASE WHEN p.measure IS NOT NULL THEN '+' ELSE '' END AS text,"
        " CASE WHEN l.value > 1 THEN printf('%.2f', round(1 / l.value, 2)) || '_F' ELSE printf('%.6f', l.value) || '_M' END AS direction"
        " FROM lo l LEFT JOIN (SELECT * FROM wp WHERE p_value < 0.05) w ON w.method = l.method AND w.embedding = l.embedding"
        " AND w.measure || '_r' = l.measure LEFT JOIN (SELECT * FROM pp WHERE p_value < 0.05) p ON p.method = l.method"
        " AND p.embedding = l.embedding AND p.measure = l.measure")


@register("formatted_summary", "T8 T9 A16", with_views(_formatted_sql(), "predictions"))
def formatted_summary(spark: SparkSession, sf: str) -> DataFrame:
    sc = scores(spark, sf)
    s = _round(summary.summarize(sc, BY))
    w = summary.with_pvalues(summary.welch_stats(sc, BY))
    p = summary.with_pvalues(summary.paired_stats(sc, by=["embedding"]))
    out = summary.formatted_summary(s, w, p, BY)
    return out.withColumn("direction", summary.direction_label(F.col("value")))


@register("prob_by_group_label", "A14",
          with_views(", f AS (SELECT embedding, fold, gender, label, sum(probability) AS s, count(probability) AS n"
                     " FROM predictions GROUP BY embedding, fold, gender, label)\n"
                     "SELECT embedding, fold, gender, label, round(CASE WHEN n <> 0 THEN s / n END, 6) AS mean_prob,"
                     " CAST(n AS BIGINT) AS n FROM f UNION ALL SELECT embedding, fold, gender, CAST(NULL AS INT),"
                     " round(CASE WHEN sum(n) <> 0 THEN sum(s) / sum(n) END, 6), CAST(sum(n) AS BIGINT)"
                     " FROM f GROUP BY embedding, fold, gender", "predictions"))
def prob_by_group_label(spark: SparkSession, sf: str) -> DataFrame:
    return _round(summary.prob_by_group_label(views.predictions(spark, sf), ["embedding", "fold"]))


def _fold_ratio_sql() -> str:
    conf = ("SELECT embedding, fold, gender,"
            " sum(CASE WHEN label = 0 AND preds = 0 THEN 1 ELSE 0 END) AS tn,"
            " sum(CASE WHEN label = 0 AND preds = 1 THEN 1 ELSE 0 END) AS fp,"
            " sum(CASE WHEN label = 1 AND preds = 0 THEN 1 ELSE 0 END) AS fn,"
            " sum(CASE WHEN label = 1 AND preds = 1 THEN 1 ELSE 0 END) AS tp FROM predictions"
            " GROUP BY embedding, fold, gender")
    rates = ("SELECT *, CASE WHEN fn + tp <> 0 THEN CAST(fn AS DOUBLE) / (fn + tp) END AS fnr,"
             " CASE WHEN fp + tn <> 0 THEN CAST(fp AS DOUBLE) / (fp + tn) END AS fpr,"
             " CASE WHEN tp + fn <> 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END AS tpr FROM c")
    allf1 = ("SELECT embedding, fold, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM c"
             " GROUP BY embedding, fold")
    f1 = ("SELECT embedding, fold,"
          " coalesce(CASE WHEN 2 * tp + fp + fn <> 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 0.0) AS fp1,"
          " coalesce(CASE WHEN 2 * tn + fp + fn <> 0 THEN CAST(2 * tn AS DOUBLE) / (2 * tn + fp + fn) END, 0.0) AS fn1,"
          " CASE WHEN tp + fn + fp > 0 THEN 1 ELSE 0 END AS hp, CASE WHEN tn + fp + fn > 0 THEN 1 ELSE 0 END AS hn"
          " FROM a")
    wide = ", ".join(f"round(max(CASE WHEN gender = '{g}' THEN {m} END), 2) AS {m}_{g.lower()}"
                     for m in ("fnr", "fpr", "tpr") for g in ("F", "M"))
    fold_r = ", ".join(
        f"CASE WHEN {m}_m <> 0 THEN (CASE WHEN {m}_f / {m}_m < 1 THEN round({m}_f / {m}_m, 2)"
        f" ELSE round(1 / ({m}_f / {m}_m), 2) END) END AS {m}_r" for m in ("fnr", "fpr", "tpr"))
    _, _, mism = sql_parts_for_fold()
    return (f", c AS ({conf}), r AS ({rates}), a AS ({allf1}), f AS ({f1})"
            f", w AS (SELECT embedding, fold, {wide} FROM r GROUP BY embedding, fold)"
            ", ff AS (SELECT embedding, fold, round(CASE WHEN hp + hn <> 0 THEN (fp1 * hp + fn1 * hn) / (hp + hn) END, 2)"
            " AS f1 FROM f)\n" + mism +
            f"SELECT w.*, {fold_r}, ff.f1, mm.mismatch, mm.total_num FROM w JOIN ff USING (embedding, fold)"
            " LEFT JOIN mm USING (embedding, fold)")


def sql_parts_for_fold():
    from .fairness_queries import sql_parts
    return sql_parts(["embedding", "fold"], "predictions")


@register("fold_ratio", "A15", with_views(_fold_ratio_sql(), "predictions"))
def fold_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return summary.fold_ratio(views.predictions(spark, sf), ["embedding", "fold"])


def _report_sql() -> str:
    c = ("SELECT embedding, fold, sum(CASE WHEN label = 0 AND preds = 0 THEN 1 ELSE 0 END) AS tn,"
         " sum(CASE WHEN label = 0 AND preds = 1 THEN 1 ELSE 0 END) AS fp,"
         " sum(CASE WHEN label = 1 AND preds = 0 THEN 1 ELSE 0 END) AS fn,"
         " sum(CASE WHEN label = 1 AND preds = 1 THEN 1 ELSE 0 END) AS tp FROM predictions WHERE variant = 'orig'"
         " GROUP BY embedding, fold")

    def row(cls, hit, pred_n, true_n):
        return (f"SELECT embedding, fold, '{cls}' AS class,"
                f" coalesce(CASE WHEN {pred_n} <> 0 THEN CAST({hit} AS DOUBLE) / ({pred_n}) END, 0.0) AS precision,"
                f" coalesce(CASE WHEN {true_n} <> 0 THEN CAST({hit} AS DOUBLE) / ({true_n}) END, 0.0) AS recall,"
                f" coalesce(CASE WHEN {pred_n} + {true_n} <> 0 THEN CAST(2 * {hit} AS DOUBLE) / ({pred_n} + {true_n})"
                f" END, 0.0) AS f1, CAST({true_n} AS BIGINT) AS support, CAST({pred_n} AS BIGINT) AS pn FROM c")
    per = row("0", "tn", "tn + fn", "tn + fp") + " UNION ALL " + row("1", "tp", "tp + fp", "tp + fn")
    return (f", c AS ({c}), per AS ({per})"
            ", pres AS (SELECT * FROM per WHERE support + pn > 0)"
            ", av AS (SELECT embedding, fold, avg(precision) AS pm, avg(recall) AS rm, avg(f1) AS fm,"
            " sum(precision * support) / sum(support) AS pw, sum(recall * support) / sum(support) AS rw,"
            " sum(f1 * support) / sum(support) AS fw, CAST(sum(support) AS BIGINT) AS n FROM pres"
            " GROUP BY embedding, fold)\n"
            "SELECT embedding, fold, class, round(precision, 6) AS precision, round(recall, 6) AS recall,"
            " round(f1, 6) AS f1, support FROM per"
            " UNION ALL SELECT embedding, fold, 'macro avg', round(pm, 6), round(rm, 6), round(fm, 6), n FROM av"
            " UNION ALL SELECT embedding, fold, 'weighted avg', round(pw, 6), round(rw, 6), round(fw, 6), n FROM av")


@register("classification_report", "A17", with_views(_report_sql(), "predictions"))
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    p = views.predictions(spark, sf).filter(F.col("variant") == "orig")
    return _round(summary.classification_report(p, ["embedding", "fold"]))
