"""Repeated stratified folds, nested validation, under-sampling and fold bundles.

Fold membership is reproducible: within each (seed, stratum) rows are ordered
by ``md5(row_id ':' seed)`` and dealt round-robin into ``n_splits`` folds.  The
exact rank inside a stratum comes from :func:`row_number_within` (bucketed by
the hash prefix, so a stratum holding a third of all rows is still spread over
many tasks).  The nested validation split has a closed form in that rank, so
it needs no second window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import hex_prefix_number, row_number_within


def stratum(label: str = "label", gender: str = "gender") -> Column:
    """label || gender as a string, e.g. '1F'."""
    return F.concat(F.col(label).cast("string"), F.col(gender).cast("string"))


def order_hash(key: str, *salts: Column | str) -> Column:
    parts = [F.col(key).cast("string")]
    for s in salts:
        parts += [F.lit(":"), (F.col(s) if isinstance(s, str) else s).cast("string")]
    return F.md5(F.concat(*parts))


def stratified_folds(df: DataFrame, key: str = "row_id", strata: Sequence[str] = ("stratum",),
                     n_splits: int = 10, seeds: int = 1) -> DataFrame:
    """(seed, key, strata..., rn, k, fold) — every row is in one test fold per seed.

    ``fold = seed * n_splits + k``.  Add the mention flag to ``strata`` for F4.
    """
    base = df.select(key, *strata)
    x = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    x = x.withColumn("_h", order_hash(key, "seed"))
    r = row_number_within(x, ["seed", *strata], ["_h", key], coarse=hex_prefix_number(F.col("_h")), out="rn",
                          domain=(0, 16 ** 12))  # a hash fills its known domain evenly
    k = ((F.col("rn") - 1) % n_splits).cast("int")
    return r.select("seed", key, *strata, "rn", k.alias("k"),
                    (F.col("seed") * n_splits + k).cast("int").alias("fold"))


def fold_roles(assign: DataFrame, key: str = "row_id", n_splits: int = 10,
               validation_split: float = 0.1) -> DataFrame:
    """(seed, fold, role, key) with role in test / val / train.

    For fold k the non-test rows of a stratum keep their hash order; a row of
    overall rank rn has rank ``rn - floor((rn + n - 2 - k) / n)`` among them and
    is validation when that rank is 1 modulo ``1 / validation_split``.
    """
    inner = int(round(1 / validation_split))
    x = assign.select("seed", key, "rn", F.col("k").alias("_kt"),
                      F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("k"))
    before = F.floor((F.col("rn") + (n_splits - 2) - F.col("k")) / n_splits)
    r2 = F.col("rn") - before
    role = (F.when(F.col("_kt") == F.col("k"), F.lit("test"))
            .when((r2 - 1) % inner == 0, F.lit("val")).otherwise(F.lit("train")))
    return x.select("seed", (F.col("seed") * n_splits + F.col("k")).cast("int").alias("fold"),
                    role.alias("role"), key)


def balanced_train(roles: DataFrame, notes: DataFrame, key: str = "row_id", label: str = "label",
                   gender: str = "gender", groups: tuple[str, str] = ("F", "M")) -> DataFrame:
    """inside each fold's train rows and each label, keep min(count by gender) rows per gender.

    Rows are chosen by hash order (reproducible); an absent gender keeps 0 rows.
    """
    tr = (roles.filter(F.col("role") == "train").join(notes.select(key, label, gender), key)
          .withColumn("_h", order_hash(key, "fold", F.lit("balance"))))
    ranked = row_number_within(tr, ["seed", "fold", label, gender], ["_h", key],
                               coarse=hex_prefix_number(F.col("_h")), out="_rb", domain=(0, 16 ** 12))
    counts = tr.groupBy("seed", "fold", label).agg(
        F.least(*[F.sum(F.when(F.col(gender) == g, 1).otherwise(0)) for g in groups]).alias("_keep"))
    out = ranked.join(counts, ["seed", "fold", label]).filter(F.col("_rb") <= F.col("_keep"))
    return out.select("seed", "fold", key, label, gender)


def slot_rules(treatment: str) -> list[tuple[str, str, int, bool, str]]:
    """F6 bundle layout: (role, source variant, slot, flip gender, output variant).

    0 train, 1 test + swapped, 2 blind test (neutral + gender flipped),
    3 validation, 4 validation + counterfactual.
    """
    rules = []
    if treatment == "augmented":
        rules += [("train", "orig", 0, False, "orig"), ("train", "swapped", 0, False, "swapped")]
        val_variant = "orig"
    else:
        rules += [("train", treatment, 0, False, treatment)]
        val_variant = treatment
    rules += [("test", "orig", 1, False, "orig"), ("test", "swapped", 1, False, "swapped"),
              ("test", "neutr", 2, False, "neutr"), ("test", "neutr", 2, True, "neutr_flipped"),
              ("val", val_variant, 3, False, val_variant), ("val", val_variant, 4, False, val_variant)]
    if treatment == "neutr":
        rules.append(("val", "neutr", 4, True, "neutr_flipped"))
    else:
        rules.append(("val", "swapped", 4, False, "swapped"))
    return rules


def fold_bundle(roles: DataFrame, variants: DataFrame, treatment: str, key: str = "row_id",
                gender: str = "gender") -> DataFrame:
    """(fold, slot, variant, key, gender, ...) for one treatment.

    One equi-join of roles and note variants on the key; slots are assigned by
    a literal rule list inside the expression (no join against a rule table).
    """
    rules = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(v).alias("src"), F.lit(s).alias("slot"),
                               F.lit(fl).alias("flip"), F.lit(o).alias("out"))
                      for r, v, s, fl, o in slot_rules(treatment)])
    j = roles.join(variants, key)
    match = F.filter(rules, lambda x: (x["role"] == F.col("role")) & (x["src"] == F.col("variant")))
    x = j.select("*", F.explode(match).alias("_r"))
    g = F.when(F.col("_r.flip"), T.flip_gender(F.col(gender))).otherwise(F.col(gender))
    rest = [c for c in variants.columns if c not in (key, gender, "variant")]
    return x.select("seed", "fold", F.col("_r.slot").alias("slot"), F.col("_r.out").alias("variant"),
                    key, g.alias(gender), *rest)


def difference(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of ``a`` whose key is not in ``b`` (set difference on keys)."""
    return a.join(b.select(key), key, "left_anti")


def intersection(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows of ``a`` whose key is in ``b``."""
    return a.join(b.select(key), key, "left_semi")
