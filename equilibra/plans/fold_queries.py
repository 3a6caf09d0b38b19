"""Fold assignment, nested validation, under-sampling and bundles over `notes`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import counterfactual as CF
from ..operators import folds as FO
from ..sources import views
from .oracle_views import with_views
from .registry import register
from .text_queries import duck_flip, duck_rules, duck_swap

N_SPLITS = 10
SEEDS = 2  # repeated CV: folds 0-9 from seed 0, 10-19 from seed 1


def cohort_notes(spark: SparkSession, sf: str) -> DataFrame:
    n = views.notes(spark, sf)
    return n.filter((F.col("label") == 1) | (F.col("none_mental") == 1))


def assignments(spark: SparkSession, sf: str, mention: bool = False, seeds: int = SEEDS) -> DataFrame:
    n = cohort_notes(spark, sf).withColumn("stratum", FO.stratum())
    strata = ["stratum"]
    if mention:
        n = n.withColumn("mention", T.mentions("text"))
        strata = ["mention", "stratum"]
    return FO.stratified_folds(n, strata=strata, n_splits=N_SPLITS, seeds=seeds)


def _assign_sql(seeds: int, mention: bool) -> str:
    m_col = ", coalesce(contains(lower(text), 'depression'), false) AS mention" if mention else ""
    m_key = "mention, " if mention else ""
    return (
        ", co AS (SELECT * FROM notes WHERE label = 1 OR none_mental = 1)\n"
        f", s AS (SELECT row_id, CAST(label AS VARCHAR) || gender AS stratum{m_col}, CAST(t.seed AS INTEGER) AS seed"
        f" FROM co, range(0, {seeds}) t(seed))\n"
        f", r AS (SELECT *, row_number() OVER (PARTITION BY seed, {m_key}stratum ORDER BY"
        " md5(CAST(row_id AS VARCHAR) || ':' || CAST(seed AS VARCHAR)), row_id) AS rn FROM s)\n"
        f", asg AS (SELECT seed, row_id, {m_key}stratum, rn, CAST((rn - 1) % {N_SPLITS} AS INTEGER) AS k,"
        f" CAST(seed * {N_SPLITS} + (rn - 1) % {N_SPLITS} AS INTEGER) AS fold FROM r)\n")


@register("stratified_folds", "F1 F2 P1",
          with_views(_assign_sql(SEEDS, False) + "SELECT * FROM asg", "notes"))
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return assignments(spark, sf)


@register("mention_folds", "F4 P2 U8",
          with_views(_assign_sql(SEEDS, True) + "SELECT * FROM asg", "notes"))
def mention_folds(spark: SparkSession, sf: str) -> DataFrame:
    return assignments(spark, sf, mention=True)


# the oracle numbers the non-test rows with a second window (the Spark side uses the closed form)
_ROLES_SQL = (
    f", kk AS (SELECT a.*, CAST(t.k AS INTEGER) AS kx FROM asg a, range(0, {N_SPLITS}) t(k))\n"
    ", nt AS (SELECT *, row_number() OVER (PARTITION BY seed, kx, mention, stratum ORDER BY rn) AS rn2"
    " FROM kk WHERE k <> kx)\n"
    ", roles AS (SELECT seed, CAST(seed * 10 + kx AS INTEGER) AS fold,"
    " CASE WHEN (rn2 - 1) % 10 = 0 THEN 'val' ELSE 'train' END AS role, row_id FROM nt"
    " UNION ALL SELECT seed, fold, 'test', row_id FROM asg)\n")


@register("fold_roles", "F3 F7", with_views(_assign_sql(SEEDS, True) + _ROLES_SQL + "SELECT * FROM roles", "notes"))
def fold_roles(spark: SparkSession, sf: str) -> DataFrame:
    return FO.fold_roles(assignments(spark, sf, mention=True), n_splits=N_SPLITS)


_BALANCED_SQL = (
    ", tr AS (SELECT r.seed, r.fold, r.row_id, c.label, c.gender,"
    " md5(CAST(r.row_id AS VARCHAR) || ':' || CAST(r.fold AS VARCHAR) || ':balance') AS h"
    " FROM roles r JOIN co c ON r.row_id = c.row_id WHERE r.role = 'train')\n"
    ", rb AS (SELECT *, row_number() OVER (PARTITION BY seed, fold, label, gender ORDER BY h, row_id) AS rb FROM tr)\n"
    ", cnt AS (SELECT seed, fold, label, least(sum(CASE WHEN gender = 'F' THEN 1 ELSE 0 END),"
    " sum(CASE WHEN gender = 'M' THEN 1 ELSE 0 END)) AS keep FROM tr GROUP BY seed, fold, label)\n"
    "SELECT rb.seed, rb.fold, rb.row_id, rb.label, rb.gender FROM rb JOIN cnt USING (seed, fold, label)"
    " WHERE rb.rb <= cnt.keep")


@register("balanced_train", "F5 Q24 Q25",
          with_views(_assign_sql(SEEDS, True) + _ROLES_SQL + _BALANCED_SQL, "notes"))
def balanced_train(spark: SparkSession, sf: str) -> DataFrame:
    roles = FO.fold_roles(assignments(spark, sf, mention=True), n_splits=N_SPLITS)
    return FO.balanced_train(roles, cohort_notes(spark, sf))


def _bundle_sql(treatment: str) -> str:
    cols = "row_id, label, none_mental, lang"
    variants = (
        f", va AS (SELECT {cols}, 'orig' AS variant, gender, text FROM co UNION ALL "
        f"SELECT {cols}, 'swapped', {duck_flip('gender')}, {duck_swap('text', 'gender')} FROM co UNION ALL "
        f"SELECT {cols}, 'neutr', gender, {duck_rules('text', T.NEUTRALIZE_RULES)} FROM co)\n")
    rules = " UNION ALL ".join(
        f"SELECT '{r}' AS role, '{v}' AS src, {s} AS slot, {str(fl).upper()} AS flip, '{o}' AS out"
        for r, v, s, fl, o in FO.slot_rules(treatment))
    return (variants + f", ru AS ({rules})\n"
            "SELECT ro.seed, ro.fold, ru.slot, ru.out AS variant, ro.row_id,"
            f" CASE WHEN ru.flip THEN {duck_flip('va.gender')} ELSE va.gender END AS gender,"
            " va.label, va.none_mental, va.lang, va.text"
            " FROM roles ro JOIN va ON ro.row_id = va.row_id JOIN ru ON ru.role = ro.role AND ru.src = va.variant")


def _bundle(spark: SparkSession, sf: str, treatment: str) -> DataFrame:
    roles = FO.fold_roles(assignments(spark, sf, mention=True), n_splits=N_SPLITS)
    variants = CF.counterfactual_variants(cohort_notes(spark, sf))
    return FO.fold_bundle(roles, variants, treatment)


@register("fold_bundle", "F6 U3 U4 U5 U6 J4",
          with_views(_assign_sql(SEEDS, True) + _ROLES_SQL + _bundle_sql("augmented"), "notes"))
def fold_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return _bundle(spark, sf, "augmented")


@register("fold_bundle_neutr", "F6 U5 U6",
          with_views(_assign_sql(SEEDS, True) + _ROLES_SQL + _bundle_sql("neutr"), "notes"))
def fold_bundle_neutr(spark: SparkSession, sf: str) -> DataFrame:
    return _bundle(spark, sf, "neutr")


@register("remaining_rows", "U7",
          with_views("SELECT row_id, gender, label FROM notes WHERE (label = 1 OR none_mental = 1)"
                     " AND row_id NOT IN (SELECT row_id FROM notes WHERE (label = 1 OR none_mental = 1)"
                     " AND coalesce(contains(lower(text), 'depression'), false))", "notes"))
def remaining_rows(spark: SparkSession, sf: str) -> DataFrame:
    co = cohort_notes(spark, sf)
    mentioned = co.filter(T.mentions("text"))
    return FO.difference(co, mentioned).select("row_id", "gender", "label")
