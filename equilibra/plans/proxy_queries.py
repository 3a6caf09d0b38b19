"""Proxy-feature rankings, muting and step selection over `features`.

The model is the fixed linear model of :func:`attribution.fixed_weights_of`
(deterministic weights), so the Spark algebra of the explainers is checked
against SQL without a training step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attribution as AT
from ..operators import folds as FO
from ..operators import metrics
from ..sources import views
from .fairness_queries import sql_evaluate
from .fold_queries import _ROLES_SQL, _assign_sql, assignments
from .oracle_views import with_views
from .registry import register
from .text_queries import duck_clean

REPEATS = 20


def _beta_sql(i: str) -> str:
    return f"(CAST(((7 * ({i})) % 13) - 6 AS DOUBLE) / 6.0)"


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --------------------------------------------------------------------- SQL building blocks

def _stats_sql(src: str, name: str) -> str:
    # element-wise mean and population std of src.features
    return (f", {name}_el AS (SELECT unnest(features) AS x, unnest(range(len(features))) AS i FROM {src})\n"
            f", {name} AS (SELECT i, avg(x) AS mu, stddev_pop(x) AS sd FROM {name}_el GROUP BY i)\n")


def _z_sql(src: str, stats: str, out: str, cols: str) -> str:
    return (f", {out}_el AS (SELECT {cols}, unnest(features) AS x, unnest(range(len(features))) AS i FROM {src})\n"
            f", {out}_zl AS (SELECT e.*, CASE WHEN s.sd <> 0 THEN (e.x - s.mu) / s.sd ELSE 0.0 END AS z"
            f" FROM {out}_el e JOIN {stats} s USING (i))\n")


_ALL_Z_SQL = (", fa AS (SELECT * FROM features)\n" + _stats_sql("fa", "st")
              + _z_sql("fa", "st", "za", "row_id, gender, label"))


@register("pcc_rank", "H4 M15 W2",
          with_views(", el AS (SELECT unnest(features) AS x, unnest(range(len(features))) AS i,"
                     " CASE WHEN gender = 'F' THEN 0.0 ELSE 1.0 END AS g FROM features)\n"
                     ", mo AS (SELECT i, avg(x) AS mx, avg(x * x) AS mxx, avg(x * g) AS mxg, avg(g) AS mg,"
                     " avg(g * g) AS mgg FROM el GROUP BY i)\n"
                     ", pr AS (SELECT CAST(i AS INTEGER) AS feature_idx, CASE WHEN mxx - mx * mx > 0 AND mgg - mg * mg > 0"
                     " THEN (mxg - mx * mg) / sqrt((mxx - mx * mx) * (mgg - mg * mg)) END AS score FROM mo)\n"
                     "SELECT feature_idx, round(score, 6) AS score, round(abs(score), 6) AS abs_score,"
                     " 'Feature_' || CAST(feature_idx + 1 AS VARCHAR) AS feature,"
                     " CAST(row_number() OVER (ORDER BY round(abs(score), 9) DESC, feature_idx) AS INTEGER) AS rank FROM pr",
                     "features"))
def pcc_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _round(AT.pcc_ranking(views.features(spark, sf)))


_RANDOM_SQL = (f", rr AS (SELECT CAST(unnest(range(0, (SELECT max(len(features)) FROM features))) AS INTEGER) AS feature_idx)\n"
               ", rrk AS (SELECT feature_idx, 'Feature_' || CAST(feature_idx + 1 AS VARCHAR) AS feature,"
               " CAST(row_number() OVER (ORDER BY md5('Feature_' || CAST(feature_idx + 1 AS VARCHAR) || ':0'),"
               " feature_idx) AS INTEGER) AS rank FROM rr)\n")


@register("random_rank", "M16 Q2", with_views(_RANDOM_SQL + "SELECT * FROM rrk", "features"))
def random_rank(spark: SparkSession, sf: str) -> DataFrame:
    return AT.random_ranking_of(views.features(spark, sf))


def standardized_features(spark: SparkSession, sf: str) -> DataFrame:
    f = views.features(spark, sf)
    return AT.standardize(f, AT.feature_stats(f))


@register("linear_attribution", "M13",
          with_views(_ALL_Z_SQL +
                     ", bg AS (SELECT i, avg(z) AS bz FROM za_zl GROUP BY i)\n"
                     ", lat AS (SELECT CAST(z.i AS INTEGER) AS feature_idx, avg(abs(z.z - bg.bz)) * abs("
                     + _beta_sql("z.i") + ") AS score FROM za_zl z JOIN bg USING (i) GROUP BY z.i)\n"
                     "SELECT feature_idx, round(score, 6) AS score, round(abs(score), 6) AS abs_score,"
                     " 'Feature_' || CAST(feature_idx + 1 AS VARCHAR) AS feature,"
                     " CAST(row_number() OVER (ORDER BY round(abs(score), 9) DESC, feature_idx) AS INTEGER) AS rank FROM lat",
                     "features"))
def linear_attribution(spark: SparkSession, sf: str) -> DataFrame:
    z = standardized_features(spark, sf)
    return _round(AT.linear_attribution(z, z, None))


_PERM_SQL = (_ALL_Z_SQL +
             ", zr AS (SELECT row_id, label, list(z ORDER BY i) AS zv, sum(z * " + _beta_sql("i") + ") AS m"
             " FROM za_zl GROUP BY row_id, label)\n"
             f", zb AS (SELECT *, ('0x' || substr(md5(CAST(row_id AS VARCHAR) || ':block'), 1, 8))::BIGINT"
             f" % greatest(count(*) OVER () // {AT.BLOCK}, 1) AS blk FROM zr)\n"
             f", rp AS (SELECT zb.*, CAST(t.r AS INTEGER) AS r FROM zb, range(0, {REPEATS}) t(r))\n"
             ", rn AS (SELECT *, row_number() OVER (PARTITION BY r, blk ORDER BY md5(CAST(row_id AS VARCHAR) || ':'"
             " || CAST(r AS VARCHAR) || ':perm'), row_id) AS k, count(*) OVER (PARTITION BY r, blk) AS n FROM rp)\n"
             ", pa AS (SELECT a.r, a.label, a.m, a.zv, b.zv AS zp FROM rn a JOIN rn b ON a.r = b.r"
             " AND a.blk = b.blk AND b.k = a.k % a.n + 1)\n"
             f", pj AS (SELECT r, label, CAST(j.j AS INTEGER) AS feature_idx,"
             " m - " + _beta_sql("j.j") + " * zv[j.j + 1] + " + _beta_sql("j.j") + " * zp[j.j + 1] AS pm"
             " FROM pa, range(0, (SELECT max(len(features)) FROM features)) j(j))\n"
             ", cf AS (SELECT r, feature_idx, sum(CASE WHEN label = 0 AND NOT pm > 0 THEN 1 ELSE 0 END) AS tn,"
             " sum(CASE WHEN label = 0 AND pm > 0 THEN 1 ELSE 0 END) AS fp,"
             " sum(CASE WHEN label = 1 AND NOT pm > 0 THEN 1 ELSE 0 END) AS fn,"
             " sum(CASE WHEN label = 1 AND pm > 0 THEN 1 ELSE 0 END) AS tp FROM pj GROUP BY r, feature_idx)\n"
             ", bc AS (SELECT sum(CASE WHEN label = 0 AND NOT m > 0 THEN 1 ELSE 0 END) AS tn,"
             " sum(CASE WHEN label = 0 AND m > 0 THEN 1 ELSE 0 END) AS fp,"
             " sum(CASE WHEN label = 1 AND NOT m > 0 THEN 1 ELSE 0 END) AS fn,"
             " sum(CASE WHEN label = 1 AND m > 0 THEN 1 ELSE 0 END) AS tp FROM zr)\n")


def _f1_sql(t: str) -> str:
    fp = (f"coalesce(CASE WHEN 2 * {t}.tp + {t}.fp + {t}.fn <> 0 THEN CAST(2 * {t}.tp AS DOUBLE) /"
          f" (2 * {t}.tp + {t}.fp + {t}.fn) END, 0.0)")
    fn = (f"coalesce(CASE WHEN 2 * {t}.tn + {t}.fp + {t}.fn <> 0 THEN CAST(2 * {t}.tn AS DOUBLE) /"
          f" (2 * {t}.tn + {t}.fp + {t}.fn) END, 0.0)")
    hp = f"(CASE WHEN {t}.tp + {t}.fn + {t}.fp > 0 THEN 1 ELSE 0 END)"
    hn = f"(CASE WHEN {t}.tn + {t}.fp + {t}.fn > 0 THEN 1 ELSE 0 END)"
    return f"CASE WHEN {hp} + {hn} <> 0 THEN ({fp} * {hp} + {fn} * {hn}) / ({hp} + {hn}) END"


@register("permutation_importance", "M14 Q3",
          with_views(_PERM_SQL +
                     f", dr AS (SELECT cf.feature_idx, {_f1_sql('bc')} - {_f1_sql('cf')} AS d FROM cf, bc)\n"
                     ", im AS (SELECT feature_idx, avg(d) AS score, stddev_pop(d) AS std FROM dr GROUP BY feature_idx)\n"
                     "SELECT feature_idx, round(score, 6) AS score, round(std, 6) AS std,"
                     " round(abs(score), 6) AS abs_score, 'Feature_' || CAST(feature_idx + 1 AS VARCHAR) AS feature,"
                     " CAST(row_number() OVER (ORDER BY round(abs(score), 9) DESC, feature_idx) AS INTEGER) AS rank FROM im",
                     "features"))
def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    return _round(AT.permutation_importance(standardized_features(spark, sf), AT.fixed_weights_of(), repeats=REPEATS))


# the muted / dropped positions of the two P queries: the first three features
MUTED = [0, 1, 2]


@register("mute_features", "P12",
          with_views(_stats_sql("features", "st") +
                     ", el AS (SELECT row_id, unnest(features) AS x, unnest(range(len(features))) AS i FROM features)\n"
                     ", mv AS (SELECT e.row_id, e.i, CASE WHEN e.i IN (0, 1, 2) THEN s.mu ELSE CAST(e.x AS DOUBLE) END"
                     " AS v FROM el e JOIN st s USING (i))\n"
                     "SELECT row_id, round(max(CASE WHEN i = 0 THEN v END), 6) AS first,"
                     " round(sqrt(sum(v * v)), 6) AS l2 FROM mv GROUP BY row_id", "features"))
def mute_features(spark: SparkSession, sf: str) -> DataFrame:
    f = views.features(spark, sf)
    muted, _ = AT.mute_features(f, f, MUTED)
    return muted.select("row_id", F.round(F.col("features")[0], 6).alias("first"),
                        F.round(F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("l2"))


@register("drop_features", "P11",
          with_views(", el AS (SELECT row_id, unnest(features) AS x, unnest(range(len(features))) AS i FROM features)\n"
                     "SELECT row_id, CAST(count(*) AS INTEGER) AS dim,"
                     " round(max(CASE WHEN i = 3 THEN CAST(x AS DOUBLE) END), 6) AS first,"
                     " round(sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS l2"
                     " FROM el WHERE i NOT IN (0, 1, 2) GROUP BY row_id", "features"))
def drop_features(spark: SparkSession, sf: str) -> DataFrame:
    d = AT.drop_features(views.features(spark, sf), MUTED)
    return d.select("row_id", F.size("features").alias("dim"), F.round(F.col("features")[0].cast("double"), 6)
                    .alias("first"),
                    F.round(F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), 6)
                    .alias("l2"))


# --------------------------------------------------------------------- M17 / M19

MUTE_FOLDS = 5  # Fixed value: the folds that the study runs


def mute_steps(spark: SparkSession, sf: str) -> DataFrame:
    """(fold, split, step, row_id, gender, label, probability = margin, preds) on the folds run."""
    roles = FO.fold_roles(assignments(spark, sf, mention=True)).filter(F.col("fold") < MUTE_FOLDS)
    f = views.features(spark, sf).select("row_id", "gender", "label", "features")
    d = roles.join(f, "row_id")
    stats = AT.feature_stats(d.filter(F.col("role") == "train"), by=["fold"])
    z = AT.standardize(d.filter(F.col("role").isin("val", "test")), stats, by=["fold"]).select(
        "fold", F.col("role").alias("split"), "row_id", "gender", "label", "z")
    ranking = AT.random_ranking_of(f, seed=0)
    return AT.iterative_mute(z, ranking, AT.fixed_weights_of(), keys=["fold", "split"]).withColumnRenamed("margin", "probability")


_STEPS_SQL = (_assign_sql(2, True) + _ROLES_SQL +
              f", rl AS (SELECT * FROM roles WHERE fold < {MUTE_FOLDS})\n"
              ", fd AS (SELECT rl.fold, rl.role, f.row_id, f.gender, f.label, f.features FROM rl JOIN features f USING (row_id))\n"
              ", fel AS (SELECT fold, unnest(features) AS x, unnest(range(len(features))) AS i FROM fd WHERE role = 'train')\n"
              ", st AS (SELECT fold, i, avg(x) AS mu, stddev_pop(x) AS sd FROM fel GROUP BY fold, i)\n"
              ", ze AS (SELECT fold, role, row_id, gender, label, unnest(features) AS x, unnest(range(len(features))) AS i"
              " FROM fd WHERE role IN ('val', 'test'))\n"
              ", zz AS (SELECT e.*, CASE WHEN s.sd <> 0 THEN (e.x - s.mu) / s.sd ELSE 0.0 END AS z"
              " FROM ze e JOIN st s USING (fold, i))\n" + _RANDOM_SQL +
              ", ct AS (SELECT z.fold, z.role AS split, z.row_id, z.gender, z.label, r.rank, z.z * " + _beta_sql("z.i")
              + " AS c FROM zz z JOIN rrk r ON r.feature_idx = z.i)\n"
              ", cs AS (SELECT *, sum(c) OVER (PARTITION BY fold, split, row_id) - sum(c) OVER (PARTITION BY fold, split, row_id"
              " ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rest,"
              " sum(c) OVER (PARTITION BY fold, split, row_id) AS tot FROM ct)\n"
              ", sp AS (SELECT fold, split, row_id, gender, label, rank AS step, rest AS mg FROM cs"
              " WHERE rank <= (SELECT max(rank) - 2 FROM rrk)"
              " UNION ALL SELECT fold, split, row_id, gender, label, 0, tot FROM cs WHERE rank = 1)\n"
              ", ms AS (SELECT fold, split, step, row_id, 'orig' AS variant, gender, label, mg AS probability,"
              " CASE WHEN mg > 0 THEN 1 ELSE 0 END AS preds FROM sp UNION ALL"
              " SELECT fold, split, step, row_id, 'swapped', CASE WHEN gender = 'F' THEN 'M' ELSE 'F' END, label, mg,"
              " CASE WHEN mg > 0 THEN 1 ELSE 0 END FROM sp)\n")
MUTE_KEYS = ["fold", "split", "step"]


def mute_scores(spark: SparkSession, sf: str) -> DataFrame:
    # blind pairs: each row and its gender-flipped copy (the group is not a feature), so a
    # row is its own pair and no shuffle by row is needed
    steps = mute_steps(spark, sf)
    pairs = steps.select(*MUTE_KEYS, F.col("preds").alias("p0"), F.col("preds").alias("p1"),
                         F.col("gender").alias("g0"), T.flip_gender("gender").alias("g1"))
    return metrics.evaluate(steps.withColumn("variant", F.lit("orig")), MUTE_KEYS, pairs=pairs, write_histogram=True)


_SCORE_ROUND = [c for c in metrics.SCORE_COLUMNS]


@register("iterative_mute", "M17 W3 J7",
          with_views(_STEPS_SQL + sql_evaluate(MUTE_KEYS, "ms") + "SELECT fold, split, step, "
                     + ", ".join(f"round({c}, 6) AS {c}" if c not in ("mismatch_direction",) else c
                                 for c in metrics.SCORE_COLUMNS) + " FROM ev", "notes", "features"))
def iterative_mute(spark: SparkSession, sf: str) -> DataFrame:
    s = mute_scores(spark, sf)
    return s.select(*MUTE_KEYS, *[F.round(c, 6).alias(c) if t == "double" else F.col(c)
                                  for c, t in s.dtypes if c not in MUTE_KEYS])


def _ratio_sql(m: str) -> str:
    a, b = f"{m}_f", f"{m}_m"
    return (f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL AND greatest({a}, {b}) <> 0"
            f" THEN round(least({a}, {b}) / greatest({a}, {b}), 3) END AS {m}_r")


_SELECT_SQL = (
    ", rr2 AS (SELECT *, " + ", ".join(_ratio_sql(m) for m in ("tpr", "fpr", "f1")) + " FROM ev)\n"
    ", vv AS (SELECT * FROM rr2 WHERE split = 'val' AND step < 10)\n"
    ", cr AS (SELECT fold, step, 'mismatch_ratio' AS criterion, -mismatch_ratio AS value FROM vv"
    " UNION ALL SELECT fold, step, 'tpr_r', tpr_r FROM vv UNION ALL SELECT fold, step, 'fpr_r', fpr_r FROM vv"
    " UNION ALL SELECT fold, step, 'f1_r', f1_r FROM vv"
    + "".join(f" UNION ALL SELECT fold, step, 'func_{lam}', {lam} * abs(tpr_r) + {1 - lam} * f1 FROM vv"
              for lam in AT.SELECTION_LAMBDAS) + ")\n"
    ", bst AS (SELECT fold, criterion, step FROM (SELECT *, row_number() OVER (PARTITION BY fold, criterion ORDER BY"
    " value DESC NULLS LAST, step) AS rn FROM cr) WHERE rn = 1)\n")


@register("select_step", "M19 W5 W6 J9 Q26",
          with_views(_STEPS_SQL + sql_evaluate(MUTE_KEYS, "ms") + _SELECT_SQL
                     + "SELECT b.fold, b.criterion, b.step, round(t.mismatch_ratio, 6) AS mismatch_ratio,"
                     " round(t.tpr_r, 6) AS tpr_r, round(t.fpr_r, 6) AS fpr_r, round(t.f1_r, 6) AS f1_r,"
                     " round(t.f1, 6) AS f1, round(t.auc, 6) AS auc FROM bst b"
                     " LEFT JOIN (SELECT * FROM rr2 WHERE split = 'test') t USING (fold, step)", "notes", "features"))
def select_step(spark: SparkSession, sf: str) -> DataFrame:
    s = AT.select_step(mute_scores(spark, sf), ["fold"])
    return s.select("fold", "criterion", "step", *[F.round(c, 6).alias(c) for c in
                                           ("mismatch_ratio", "tpr_r", "fpr_r", "f1_r", "f1", "auc")])


@register("token_attribution", "M21",
          with_views(f", dc AS (SELECT row_id, {duck_clean('text')} AS ct FROM notes)\n"
                     ", tk AS (SELECT row_id, lower(unnest(string_split(ct, ' '))) AS word FROM dc)\n"
                     ", cn AS (SELECT row_id, word, count(*) AS n FROM tk GROUP BY row_id, word)\n"
                     ", wb AS (SELECT word, list_sum(list_transform(range(len(vector)), lambda i: CAST(vector[i + 1]"
                     " AS DOUBLE) * " + _beta_sql("i") + ")) AS bv FROM word_vectors)\n"
                     ", hc AS (SELECT c.row_id, c.word, c.n * w.bv / sum(c.n) OVER (PARTITION BY c.row_id) AS contribution"
                     " FROM cn c JOIN wb w USING (word))\n"
                     ", rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY round(abs(contribution), 9) DESC, word)"
                     " AS INTEGER) AS rank FROM hc)\n"
                     "SELECT row_id, word, round(contribution, 6) AS contribution, rank FROM rk WHERE rank <= 50",
                     "notes", "word_vectors"))
def token_attribution(spark: SparkSession, sf: str) -> DataFrame:
    n = views.notes(spark, sf).select("row_id", "text")
    t = AT.token_attribution(n, views.word_vectors(spark, sf), AT.fixed_weights_of("vector"))
    return t.select("row_id", "word", F.round("contribution", 6).alias("contribution"), "rank")


SHAPLEY_PERMUTATIONS = 10


@register("sampled_shapley", "M13",
          with_views(_ALL_Z_SQL +
                     f", pp AS (SELECT z.row_id, CAST(z.i AS INTEGER) AS feature_idx, z.z * {_beta_sql('z.i')} AS c,"
                     f" CAST(t.p AS INTEGER) AS p FROM za_zl z, range(0, {SHAPLEY_PERMUTATIONS}) t(p))\n"
                     ", ru AS (SELECT *, sum(c) OVER (PARTITION BY row_id, p ORDER BY md5(CAST(row_id AS VARCHAR) || ':'"
                     " || CAST(p AS VARCHAR) || ':' || CAST(feature_idx AS VARCHAR)), feature_idx"
                     " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 0.0 AS cum FROM pp)\n"
                     ", ph AS (SELECT row_id, feature_idx, avg((CASE WHEN cum > 0 THEN 1 ELSE 0 END)"
                     " - (CASE WHEN cum - c > 0 THEN 1 ELSE 0 END)) AS phi FROM ru GROUP BY row_id, feature_idx)\n"
                     ", sc AS (SELECT feature_idx, avg(abs(phi)) AS score FROM ph GROUP BY feature_idx)\n"
                     "SELECT feature_idx, round(score, 6) AS score, round(abs(score), 6) AS abs_score,"
                     " 'Feature_' || CAST(feature_idx + 1 AS VARCHAR) AS feature,"
                     " CAST(row_number() OVER (ORDER BY round(abs(score), 9) DESC, feature_idx) AS INTEGER) AS rank FROM sc",
                     "features"))
def sampled_shapley(spark: SparkSession, sf: str) -> DataFrame:
    return _round(AT.sampled_shapley(standardized_features(spark, sf), AT.fixed_weights_of(), permutations=SHAPLEY_PERMUTATIONS))
