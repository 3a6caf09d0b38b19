"""Mitigation without model training.

* Reweighing (M9): weights from small count tables, joined back.
* Reject-option post-processing (M10, Kamiran et al. 2012): inside the margin
  around threshold t the unprivileged group is predicted favourable and the
  privileged group unfavourable, so at grid point (t, m) the privileged
  prediction is ``score > t + m`` and the unprivileged one ``score > t - m``.
  Every row is bucketed once against the sorted grid cut points (binary search
  in the JVM); per-bucket counts become suffix counts over at most
  ``#cuts + 1`` buckets per key; each grid point reads its confusion counts
  with two equi-joins.  Cost: one pass over the rows plus keys x grid,
  independent of the number of distinct scores.
* Participatory selection (M11): best method per (embedding, group) on mean
  validation scores, kept only if a paired t-test against the baseline is
  significant (H3), then each group's rows take that method's predictions (J6).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import t_pvalue
from .metrics import _div, _ind

COUNTS = ("pp", "pn", "up", "un")  # privileged / unprivileged x positive / negative label


# ---------------------------------------------------------------- M9

def reweighing(df: DataFrame, keys: Sequence[str] = (), group: str = "gender",
               label: str = "label") -> DataFrame:
    """Instance weight n_g * n_y / (n * n_gy) per (keys, group, label) (Kamiran & Calders 2012)."""
    keys = list(keys)
    base = df if keys else df.withColumn("_k", F.lit(1))
    kk = keys or ["_k"]
    cells = base.groupBy(*kk, group, label).agg(F.count(F.lit(1)).alias("_ngy"))
    by_g = cells.groupBy(*kk, group).agg(F.sum("_ngy").alias("_ng"))
    by_y = cells.groupBy(*kk, label).agg(F.sum("_ngy").alias("_ny"))
    tot = cells.groupBy(*kk).agg(F.sum("_ngy").alias("_n"))
    w = cells.join(by_g, [*kk, group]).join(by_y, [*kk, label]).join(tot, kk)
    weight = (F.col("_ng") * F.col("_ny")).cast("double") / (F.col("_n") * F.col("_ngy"))
    table = w.select(*kk, group, label, weight.alias("weight"))
    # keys x groups x labels rows: broadcast
    out = base.join(F.broadcast(table), [*kk, group, label], "left")
    return out.drop("_k") if not keys else out


# ---------------------------------------------------------------- M10

def roc_grid(low: float = 0.01, high: float = 0.99, num_thresh: int = 100,
             num_margin: int = 50) -> list[tuple[int, float, float]]:
    """(gid, threshold, margin) in search order; margins run from 0 to min(t, 1 - t)."""
    out = []
    step = (high - low) / (num_thresh - 1)
    for i in range(num_thresh):
        t = high if i == num_thresh - 1 else i * step + low
        hm = t if t <= 0.5 else 1.0 - t
        mstep = hm / (num_margin - 1)
        for j in range(num_margin):
            m = hm if j == num_margin - 1 else j * mstep
            out.append((i * num_margin + j, t, m))
    return out


def reject_option_grid(df: DataFrame, keys: Sequence[str], group: str = "gender", label: str = "label",
                       score: str = "probability", privileged: str = "F",
                       grid: list[tuple[int, float, float]] | None = None) -> DataFrame:
    """Balanced accuracy and average odds difference for every (key, grid point)."""
    spark = df.sparkSession
    keys = list(keys)
    grid = grid or roc_grid()
    cuts = sorted({t + m for _, t, m in grid} | {t - m for _, t, m in grid})
    index = {c: k for k, c in enumerate(cuts)}
    rows = (df.filter(F.col(score).isNotNull())
            .select(*keys, group, label, (-F.col(score).cast("double")).alias("_ns")))
    # bucketing -s against the negated cuts counts the cuts >= s (binary search in
    # the JVM); the decision needs the cuts strictly below s: #cuts - that count
    neg = sorted(-c for c in cuts)
    b = Bucketizer(splits=[float("-inf"), *neg, float("inf")], inputCol="_ns", outputCol="_b").transform(rows)
    below = F.lit(len(cuts)) - F.col("_b").cast("int")
    priv = F.col(group) == privileged
    pos = F.col(label) == 1
    hist = b.groupBy(*keys, below.alias("_j")).agg(
        F.sum(_ind(priv & pos)).alias("pp"), F.sum(_ind(priv & ~pos)).alias("pn"),
        F.sum(_ind(~priv & pos)).alias("up"), F.sum(_ind(~priv & ~pos)).alias("un"))
    ks = hist.select(*keys).distinct()
    dense = (ks.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("_j"))
             .join(hist, [*keys, "_j"], "left").fillna(0, subset=list(COUNTS)))
    # rows above cut k are those with more than k cuts below them: total minus the
    # running sum up to bucket k (a growing frame is incremental; a shrinking
    # "following" frame would be recomputed per row)
    w_run = Window.partitionBy(*keys).orderBy("_j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_all = Window.partitionBy(*keys)
    cum = dense.select(*keys, "_j", *[(F.sum(c).over(w_all) - F.sum(c).over(w_run)).alias(f"{c}_gt")
                                      for c in COUNTS],
                       *[F.sum(c).over(w_all).alias(f"{c}_all") for c in COUNTS])
    grid_rows = [(g, t, m, index[t + m], index[t - m]) for g, t, m in grid]
    grid_df = spark.createDataFrame(grid_rows, "gid int, t double, m double, j_hi int, j_lo int")
    # keys x grid: the grid is a literal-size parameter table, broadcast
    kg = ks.withColumn("_one", F.lit(1)).join(F.broadcast(grid_df.withColumn("_one", F.lit(1))), "_one")
    hi = cum.select(*keys, F.col("_j").alias("j_hi"), "pp_gt", "pn_gt", *[f"{c}_all" for c in COUNTS])
    lo = cum.select(*keys, F.col("_j").alias("j_lo"), "up_gt", "un_gt")
    j = kg.join(hi, [*keys, "j_hi"]).join(lo, [*keys, "j_lo"])
    tp = F.col("pp_gt") + F.col("up_gt")
    fp = F.col("pn_gt") + F.col("un_gt")
    p_all = F.col("pp_all") + F.col("up_all")
    n_all = F.col("pn_all") + F.col("un_all")
    bal = (_div(tp, p_all) + _div(n_all - fp, n_all)) / 2
    aod = ((_div(F.col("un_gt"), F.col("un_all")) - _div(F.col("pn_gt"), F.col("pn_all")))
           + (_div(F.col("up_gt"), F.col("up_all")) - _div(F.col("pp_gt"), F.col("pp_all")))) / 2
    return j.select(*keys, "gid", "t", "m", bal.alias("balanced_accuracy"), aod.alias("avg_odds_diff"))


def reject_option_fit(df: DataFrame, keys: Sequence[str], bound: float = 0.05, **kw) -> DataFrame:
    """Chosen (t, m) per key: best balanced accuracy with |AOD| <= bound, else the
    smallest |AOD|; the earliest grid point wins ties (W4 / W5)."""
    keys = list(keys)
    g = reject_option_grid(df, keys, **kw)
    aod = F.col("avg_odds_diff")
    ok = F.coalesce((aod >= -bound) & (aod <= bound), F.lit(False))
    w = Window.partitionBy(*keys).orderBy(
        ok.desc(), F.when(ok, -F.col("balanced_accuracy")).otherwise(F.abs(aod)).asc_nulls_last(), F.col("gid"))
    best = g.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return best.select(*keys, "gid", "t", "m", "balanced_accuracy", "avg_odds_diff", ok.alias("within_bound"))


def reject_option_apply(df: DataFrame, chosen: DataFrame, keys: Sequence[str], group: str = "gender",
                        score: str = "probability", privileged: str = "F", out: str = "preds") -> DataFrame:
    """Decisions with the chosen (t, m): privileged ``score > t + m``, others ``score > t - m``."""
    c = chosen.select(*keys, "t", "m")
    j = df.join(F.broadcast(c), list(keys), "left")  # one row per key
    s = F.col(score)
    dec = F.when(F.col(group) == privileged, s > F.col("t") + F.col("m")).otherwise(s > F.col("t") - F.col("m"))
    return j.withColumn(out, F.when(dec, 1).otherwise(0)).drop("t", "m")


# ---------------------------------------------------------------- M11, H3, J6

def significant_t(t: Column, df: Column, alpha: float = 0.05) -> Column:
    """Two-sided p-value under ``alpha``, for any df (false when t or df is null); for aggregate rows."""
    return F.coalesce(t_pvalue(t, df) < alpha, F.lit(False))


def participatory_choice(scores: DataFrame, methods: Sequence[str], measure: str = "f1",
                         groups: Sequence[str] = ("F", "M"), baseline: str = "orig",
                         method: str = "method", embedding: str = "embedding", fold: str = "fold",
                         per_embedding: bool = False) -> DataFrame:
    """(embedding, gender, best_method, t, df, significant, chosen) per embedding and group."""
    order = F.create_map(*[F.lit(x) for i, m in enumerate(methods) for x in (m, i)])
    long = scores.select(method, embedding, fold, F.explode(F.array(*[
        F.struct(F.lit(g).alias("gender"), F.col(f"{measure}_{g.lower()}").cast("double").alias("v"))
        for g in groups])).alias("x")).select(method, embedding, fold, "x.*")
    means = long.groupBy(method, embedding, "gender").agg(F.avg("v").alias("mean"))
    # means compared at 9 decimals so that equal means tie in any summation order
    w = Window.partitionBy(embedding, "gender").orderBy(F.round("mean", 9).desc_nulls_last(),
                                                        F.element_at(order, F.col(method)))
    best = (means.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .select(embedding, "gender", F.col(method).alias("best_method")))
    # paired differences baseline - candidate on every (embedding, fold) (pooled: the reference gate)
    base = long.filter(F.col(method) == baseline).select(embedding, fold, "gender", F.col("v").alias("_b"))
    cand = long.join(base, [embedding, fold, "gender"]).select(
        F.col(method).alias("best_method"), embedding, "gender", (F.col("_b") - F.col("v")).alias("d"))
    gk = ["best_method", "gender"] + ([embedding] if per_embedding else [])
    st = cand.groupBy(*gk).agg(F.count("d").alias("n"), F.avg("d").alias("md"), F.stddev_samp("d").alias("sd"))
    ok = (F.col("n") >= 2) & (F.col("sd") > 0)
    st = st.select(*gk, F.when(ok, F.col("md") / (F.col("sd") / F.sqrt("n"))).alias("t"),
                   F.when(ok, F.col("n") - 1).cast("double").alias("df"))
    out = best.join(st, gk, "left")
    sig = significant_t(F.col("t"), F.col("df"))
    chosen = F.when((F.col("best_method") != baseline) & sig, F.col("best_method")).otherwise(F.lit(baseline))
    return out.select(embedding, "gender", "best_method", "t", "df", sig.alias("significant"),
                      chosen.alias("chosen"))


def gather_by_group(predictions: DataFrame, choice: DataFrame, method: str = "method",
                    embedding: str = "embedding", group: str = "gender") -> DataFrame:
    """Each row takes the predictions of the method chosen for its (embedding, group)."""
    c = choice.select(embedding, F.col("gender").alias(group), F.col("chosen").alias(method))
    # the choice table has embeddings x groups rows
    return predictions.join(F.broadcast(c), [embedding, group, method], "left_semi")
