"""Group fairness metrics over prediction tables.

Input rows: ``keys..., row_id, variant, gender, label, preds, probability``.
``keys`` name one evaluation (e.g. method, split, embedding, fold).  Every
metric is a partial aggregate per key (map-side combine), so a key holding a
third of all rows costs one row per map task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import prefix_before

ALL = "ALL"
PROBABILITY = (0.0, 1.0)  # score domain of calibrated probabilities


def _ind(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def _div(a: Column, b: Column) -> Column:
    # null when the denominator is 0 (ANSI division would raise)
    return F.when(b != 0, a.cast("double") / b)


# ---------------------------------------------------------------- A1, A6

def confusion_by_group(df: DataFrame, keys: Sequence[str], group: str = "gender",
                       label: str = "label", pred: str = "preds") -> DataFrame:
    """tn, fp, fn, tp, pos, neg per (keys, group) plus an ``ALL`` row per key."""
    y, p = F.col(label), F.col(pred)
    per = df.groupBy(*keys, group).agg(
        F.sum(_ind((y == 0) & (p == 0))).cast("bigint").alias("tn"),
        F.sum(_ind((y == 0) & (p == 1))).cast("bigint").alias("fp"),
        F.sum(_ind((y == 1) & (p == 0))).cast("bigint").alias("fn"),
        F.sum(_ind((y == 1) & (p == 1))).cast("bigint").alias("tp"))
    # overall from the per-group counts: one extra pass over a tiny table
    overall = per.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("tn", "fp", "fn", "tp")])
    overall = overall.select(*keys, F.lit(ALL).alias(group), "tn", "fp", "fn", "tp")
    out = per.unionByName(overall)
    return out.select("*", (F.col("tp") + F.col("fn")).alias("pos"),
                      (F.col("tn") + F.col("fp")).alias("neg"))


# ---------------------------------------------------------------- A2, A3

def rate_columns() -> list[Column]:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return [_div(fn, fn + tp).alias("fnr"), _div(fp, fp + tn).alias("fpr"),
            _div(tp, tp + fn).alias("tpr"), _div(tp, tp + fp).alias("precision")]


def f1_columns() -> list[Column]:
    """F1 of each label (0 when undefined) and the macro mean over labels present."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    f1_pos = F.coalesce(_div(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    f1_neg = F.coalesce(_div(2 * tn, 2 * tn + fp + fn), F.lit(0.0))
    has_pos = _ind(tp + fn + fp > 0)
    has_neg = _ind(tn + fp + fn > 0)
    macro = _div(f1_pos * has_pos + f1_neg * has_neg, has_pos + has_neg)
    return [f1_pos.alias("f1_pos"), f1_neg.alias("f1_neg"), macro.alias("f1")]


def group_metrics(df: DataFrame, keys: Sequence[str], group: str = "gender") -> DataFrame:
    conf = confusion_by_group(df, keys, group)
    return conf.select("*", *rate_columns(), *f1_columns())


# ---------------------------------------------------------------- A4, A5, A11

def auc(df: DataFrame, keys: Sequence[str], label: str = "label", score: str = "probability",
        buckets: int | None = None, domain: tuple[float, float] | None = None) -> DataFrame:
    """ROC AUC per key (Mann-Whitney, ties count one half); null with one class only.

    Rows are first collapsed to (keys, score) -> (n_pos, n_neg); a distributed
    prefix sum gives the negatives below each score.
    """
    y = F.col(label)
    hist = (df.filter(F.col(score).isNotNull())
            .groupBy(*keys, score)
            .agg(F.sum(_ind(y == 1)).cast("bigint").alias("_pos"),
                 F.sum(_ind(y != 1)).cast("bigint").alias("_neg")))
    ranked = _ranked(hist, keys, score, ["_neg"], buckets, domain)
    u = F.col("_pos").cast("double") * (F.col("_neg_before") + F.col("_neg") * 0.5)
    agg = ranked.groupBy(*keys).agg(F.sum(u).alias("_u"), F.sum("_pos").alias("_p"),
                                    F.sum("_neg").alias("_n"))
    value = F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                   F.col("_u") / (F.col("_p").cast("double") * F.col("_n")))
    return agg.select(*keys, value.alias("auc"))


def _ranked(hist: DataFrame, keys: Sequence[str], score: str, values: Sequence[str], buckets: int | None,
            domain: tuple[float, float] | None) -> DataFrame:
    coarse = None
    if domain == PROBABILITY:
        # buckets equal-width in logit space: probabilities crowded near 0 or 1
        # still spread over many buckets (any monotone map keeps the sums exact)
        p = F.least(F.greatest(F.col(score).cast("double"), F.lit(1e-9)), F.lit(1 - 1e-9))
        coarse, domain = F.log(p / (1 - p)), (-21.0, 21.0)
    return prefix_before(hist, keys, [score], values, coarse=coarse, buckets=buckets, domain=domain)


def cross_tag(group: str = "gender", label: str = "label", first: str = "F") -> Column:
    """'fm' = first-group positives with other-group negatives; 'mf' the rest."""
    return F.when((F.col(group) == first) == (F.col(label) == 1), F.lit("fm")).otherwise(F.lit("mf"))


def auc_by_slice(df: DataFrame, keys: Sequence[str], group: str = "gender",
                 label: str = "label", score: str = "probability", first: str = "F",
                 domain: tuple[float, float] | None = None) -> DataFrame:
    """AUC per (keys, slice) for slice in {each group, ALL, fm, mf} in one job."""
    sliced = df.select(*keys, label, score,
                       F.explode(F.array(F.col(group).cast("string"), F.lit(ALL),
                                         cross_tag(group, label, first))).alias("slice"))
    return auc(sliced, [*keys, "slice"], label, score, domain=domain)


def auc_wide(df: DataFrame, keys: Sequence[str], group: str = "gender", label: str = "label",
             score: str = "probability", groups: tuple[str, str] = ("F", "M"),
             domain: tuple[float, float] | None = None) -> DataFrame:
    """auc_f, auc_m, auc, auc_fm, auc_mf and the min/max ratio (A11) per key."""
    return _auc_of(score_histogram(df, keys, group, label, score, groups), keys, score, groups, domain)


def score_histogram(df: DataFrame, keys: Sequence[str], group: str, label: str, score: str,
                    groups: tuple[str, str], pred: str | None = None) -> DataFrame:
    """Per (keys, score) the labels 1 and 0 (``pos``, ``neg``) of the first group (``_0``), the second
    (``_1``) and any other (``_2``); with ``pred`` also those predicted 1 (``tp``, ``fp``).

    Every AUC and confusion count follows from it.  A score shared by many rows
    costs one row per map task.
    """
    first, second = (F.coalesce(F.col(group) == g, F.lit(False)) for g in groups)
    y = F.col(label)
    cells = {}
    for i, of in enumerate((first, second, ~first & ~second)):
        cells |= {f"pos_{i}": of & (y == 1), f"neg_{i}": of & (y == 0)}
        if pred:
            cells |= {f"tp_{i}": of & (y == 1) & (F.col(pred) == 1), f"fp_{i}": of & (y == 0) & (F.col(pred) == 1)}
    return df.groupBy(*keys, score).agg(*[F.sum(_ind(c)).cast("bigint").alias(n) for n, c in cells.items()])


def _auc_of(hist: DataFrame, keys: Sequence[str], score: str, groups: tuple[str, str],
            domain: tuple[float, float] | None) -> DataFrame:
    names = [f"{kind}_{i}" for kind in ("pos", "neg") for i in range(3)]
    slim = hist.filter(F.col(score).isNotNull()).select(*keys, score, *names)
    ranked = _ranked(slim, keys, score, [f"neg_{i}" for i in range(3)], None, domain)
    slices = {f"auc_{groups[0].lower()}": ((0,), (0,)), f"auc_{groups[1].lower()}": ((1,), (1,)),
              "auc": ((0, 1, 2), (0, 1, 2)), "auc_fm": ((0,), (1, 2)), "auc_mf": ((1, 2), (0,))}

    def total(names: Sequence[str]) -> Column:
        return sum((F.col(n) for n in names[1:]), F.col(names[0]))
    sums = []
    for name, (pos, neg) in slices.items():
        p = total([f"pos_{i}" for i in pos])
        u = p.cast("double") * (total([f"neg_{i}_before" for i in neg]) + total([f"neg_{i}" for i in neg]) * 0.5)
        sums += [F.sum(u).alias(f"_u_{name}"), F.sum(p).alias(f"_p_{name}"),
                 F.sum(total([f"neg_{i}" for i in neg])).alias(f"_n_{name}")]
    agg = ranked.groupBy(*keys).agg(*sums)
    wide = agg.select(*keys, *[_div(F.col(f"_u_{n}"), F.col(f"_p_{n}").cast("double") * F.col(f"_n_{n}")).alias(n)
                               for n in slices])
    four = [F.col(f"auc_{groups[0].lower()}"), F.col(f"auc_{groups[1].lower()}"),
            F.col("auc_fm"), F.col("auc_mf")]
    return wide.withColumn("auc_minmax", minmax_ratio(four))


def minmax_ratio(cols: Sequence[Column]) -> Column:
    """min / max over the columns; null if any is null or the max is 0."""
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | c.isNull()
    hi = F.greatest(*cols)
    return F.when(~any_null & (hi != 0), F.least(*cols) / hi)


# ---------------------------------------------------------------- A8, A9, J2

def counterfactual_mismatch(df: DataFrame, keys: Sequence[str], pair: str = "row_id",
                            variant: str = "variant", original: str = "orig",
                            counterfactual: str = "swapped", group: str = "gender",
                            pred: str = "preds", first: str = "F") -> DataFrame:
    """Pairs whose predictions differ, the direction of the difference and the ratio.

    The pair is an explicit key: one shuffle on (keys, pair) pivots both halves
    into one row (two rows per group at most), no self-join.
    """
    return mismatch_of_pairs(pair_rows(df, keys, pair, variant, original, counterfactual, group, pred), keys, first)


def pair_rows(df: DataFrame, keys: Sequence[str], pair: str, variant: str, original: str, counterfactual: str,
              group: str, pred: str) -> DataFrame:
    """One row per pair with predictions p0, p1 and groups g0, g1 of original and counterfactual."""
    v = F.col(variant)
    return (df.filter(v.isin(original, counterfactual))
             .groupBy(*keys, pair)
             .agg(F.max(F.when(v == original, F.col(pred))).alias("p0"),
                  F.max(F.when(v == counterfactual, F.col(pred))).alias("p1"),
                  F.max(F.when(v == original, F.col(group))).alias("g0"),
                  F.max(F.when(v == counterfactual, F.col(group))).alias("g1")))


def mismatch_of_pairs(pairs: DataFrame, keys: Sequence[str], first: str = "F") -> DataFrame:
    """Mismatch counts per key from pair rows (p0, p1, g0, g1): a partial aggregate only."""
    diff = F.col("p0").isNotNull() & F.col("p1").isNotNull() & (F.col("p0") != F.col("p1"))

    def preds_of(is_first: bool) -> Column:
        def side(g: str, p: str) -> Column:
            hit = (F.col(g) == first) if is_first else (F.col(g) != first)
            return F.when(hit, F.col(p)).otherwise(F.lit(0))
        return F.when(diff, side("g0", "p0") + side("g1", "p1")).otherwise(F.lit(0))

    agg = pairs.groupBy(*keys).agg(
        F.count("p0").cast("bigint").alias("total_num"),
        F.sum(_ind(diff)).cast("bigint").alias("mismatch"),
        F.sum(preds_of(True)).cast("bigint").alias("mismatch_f"),
        F.sum(preds_of(False)).cast("bigint").alias("mismatch_m"))
    return agg.select(*keys, "total_num", "mismatch",
                      F.when(F.col("mismatch_m") > F.col("mismatch_f"), "M").otherwise("F")
                      .alias("mismatch_direction"),
                      "mismatch_f", "mismatch_m",
                      _div(F.col("mismatch"), F.col("total_num")).alias("mismatch_ratio"))


# ---------------------------------------------------------------- A7

GROUP_MEASURES = ("fnr", "fpr", "tpr", "precision", "f1", "f1_pos", "f1_neg", "pos", "neg")
SCORE_COLUMNS = (
    "mismatch", "mismatch_direction", "mismatch_f", "mismatch_m", "mismatch_ratio",
    "auc_fm", "auc_mf",
    "fnr_f", "fpr_f", "tpr_f", "precision_f", "f1_f", "f1_pos_f", "f1_neg_f", "auc_f", "pos_f", "neg_f",
    "fnr_m", "fpr_m", "tpr_m", "precision_m", "f1_m", "f1_pos_m", "f1_neg_m", "auc_m", "pos_m", "neg_m",
    "tpr", "precision", "f1", "auc", "auc_minmax", "total_num")


def evaluate(df: DataFrame, keys: Sequence[str], variant: str = "variant",
             original: str = "orig", counterfactual: str = "swapped",
             groups: tuple[str, str] = ("F", "M"), score_domain: tuple[float, float] | None = None,
             pairs: DataFrame | None = None, write_histogram: bool = False) -> DataFrame:
    """One score row per key: group metrics on the originals, mismatch on the pairs.

    Lazy; with ``write_histogram`` the score histogram is written to the shared
    folder first, for inputs that are dear to compute.

    Two reads of ``df``: one for the score histogram, which gives confusion
    counts and every AUC, one for the pairs (none where pair rows p0, p1, g0,
    g1 are given).  Labels and predictions are 0 or 1.
    """
    keys = list(keys)
    g0, g1 = groups
    hist = score_histogram(df.filter(F.col(variant) == original), keys, "gender", "label", "probability", groups, "preds")
    hist = cut_lineage(hist) if write_histogram else hist
    cells = [f"{kind}_{i}" for kind in ("pos", "neg", "tp", "fp") for i in range(3)]
    sums = hist.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cells])

    def counts(of: Sequence[int], tag: str) -> Column:
        pos, neg, tp, fp = (sum((F.col(f"{kind}_{i}") for i in of[1:]), F.col(f"{kind}_{of[0]}"))
                            for kind in ("pos", "neg", "tp", "fp"))
        return F.struct(F.lit(tag).alias("tag"), (neg - fp).alias("tn"), fp.alias("fp"), (pos - tp).alias("fn"),
                        tp.alias("tp"), pos.alias("pos"), neg.alias("neg"))
    long = sums.select(*keys, F.explode(F.array(counts([0], g0), counts([1], g1), counts([0, 1, 2], ALL))).alias("c"))
    gm = long.select(*keys, "c.*").filter(F.col("pos") + F.col("neg") > 0).select(
        "*", *rate_columns(), *f1_columns())
    wide = gm.groupBy(*keys).agg(
        *[F.max(F.when(F.col("tag") == g, F.col(m))).alias(f"{m}_{g.lower()}")
          for g in (g0, g1) for m in GROUP_MEASURES],
        *[F.max(F.when(F.col("tag") == ALL, F.col(m))).alias(m) for m in ("tpr", "precision", "f1")])
    aucs = _auc_of(hist, keys, "probability", groups, score_domain)
    mm = (counterfactual_mismatch(df, keys, variant=variant, original=original, counterfactual=counterfactual, first=g0)
          if pairs is None else mismatch_of_pairs(pairs, keys, g0))
    out = mm.join(wide, keys, "left").join(aucs, keys, "left")
    return out.select(*keys, *SCORE_COLUMNS)
