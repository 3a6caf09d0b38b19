"""Sources, sinks and the run ledger over tables that Spark derives from the given ones.

Each query writes a derived table with a sink into the shared folder, reads it
back with the reader and returns what was read, so the SQL side (which never
leaves the engine) checks the round trip.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attribution as AT
from ..operators import embeddings as E
from ..operators import folds as FO
from ..operators import metrics
from ..session import ensure_checkpoint_dir
from ..sources import io, views
from ..sources.alignment import aligned
from ..sources.ledger import RunLedger
from ..streaming import scoring
from .fairness_queries import KEYS, sql_evaluate
from .fold_queries import _ROLES_SQL, _assign_sql, assignments
from .oracle_views import with_views
from .registry import register


def folder(spark: SparkSession) -> str:
    """A folder of its own for one query's files, shared by all executors."""
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- S1, S2, S3

@register("notes_csv", "S1",
          with_views("SELECT gender, text, CAST(label AS INTEGER) AS label, CAST(none_mental AS INTEGER) AS none_mental,"
                     " count(*) AS n FROM notes GROUP BY ALL", "notes"))
def notes_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Quoted notes of several lines through CSV; the read ids are distinct."""
    n, at = views.notes(spark, sf), folder(spark)
    out = n.select(F.col("text").alias("TEXT"), F.col("gender").alias("GENDER"), F.col("label").alias("DEPRESSION_majority"),
                   F.col("none_mental").alias("None-mental"))
    out.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(at)
    back = io.read_notes_csv(spark, at)
    return back.groupBy("gender", "text", "label", "none_mental").agg(F.countDistinct("row_id").alias("n"))


@register("wide_features", "S2",
          with_views("SELECT row_id, gender, label, CAST(len(features) AS INTEGER) AS dim, round(CAST(features[1] AS DOUBLE), 6) AS first,"
                     " round(CAST(features[len(features)] AS DOUBLE), 6) AS last FROM features", "features"))
def wide_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features as wide CSV columns, read as one array, kept as Parquet by embedding and variant."""
    f, at = views.features(spark, sf), folder(spark)
    dim = f.agg(F.max(F.size("features"))).first()[0] or 0  # the number of CSV columns
    wide = f.select("row_id", "gender", "label", *[F.col("features")[i].alias(str(i)) for i in range(dim)])
    wide.write.option("header", True).csv(f"{at}/csv")
    read = io.read_wide_features(spark, f"{at}/csv", dim, keep=("row_id", "gender", "label"))
    io.write_features(read.withColumns({"embedding": F.lit("test"), "variant": F.lit("orig")}), f"{at}/parquet")
    x = spark.read.parquet(f"{at}/parquet").filter("embedding = 'test' and variant = 'orig'")
    return x.select(F.col("row_id").cast("bigint").alias("row_id"), "gender", F.col("label").cast("int").alias("label"),
                    F.size("features").alias("dim"), F.round(F.col("features")[0].cast("double"), 6).alias("first"),
                    F.round(F.element_at("features", -1).cast("double"), 6).alias("last"))


@register("split_scan", "S3",
          with_views(_assign_sql(2, True) + _ROLES_SQL +
                     "SELECT r.row_id, n.gender, n.label FROM roles r JOIN notes n USING (row_id)"
                     " WHERE r.fold = 3 AND r.role = 'test'", "notes"))
def split_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The test rows of one fold out of a store of all splits: a filter on partition columns."""
    at = folder(spark)
    rows = FO.fold_roles(assignments(spark, sf, mention=True)).join(views.notes(spark, sf).select("row_id", "gender", "label"), "row_id")
    store = rows.select("row_id", "gender", "label", "fold", F.col("role").alias("split"), F.lit("orig").alias("variant"),
                        F.lit("depression").alias("phenotype"))
    store.write.partitionBy("split", "variant", "phenotype", "fold").parquet(at)
    return io.read_split(spark, at, "test", "orig", "depression", 3).select("row_id", "gender", "label")


# ---------------------------------------------------------------- S6, S10

_RANK_SQL = (_assign_sql(2, True) + _ROLES_SQL +
             ", el AS (SELECT r.fold, unnest(f.features) AS x, unnest(range(len(f.features))) AS i,"
             " CASE WHEN f.gender = 'F' THEN 0.0 ELSE 1.0 END AS g FROM roles r JOIN features f USING (row_id)"
             " WHERE r.fold < 5 AND r.role = 'val')\n"
             ", mo AS (SELECT fold, i, avg(x) AS mx, avg(x * x) AS mxx, avg(x * g) AS mxg, avg(g) AS mg, avg(g * g) AS mgg"
             " FROM el GROUP BY fold, i)\n"
             ", pr AS (SELECT fold, CAST(i AS INTEGER) AS feature_idx, CASE WHEN mxx - mx * mx > 0 AND mgg - mg * mg > 0"
             " THEN (mxg - mx * mg) / sqrt((mxx - mx * mx) * (mgg - mg * mg)) END AS score FROM mo)\n")


@register("ranking_store", "S6 S10 M15",
          with_views(_RANK_SQL + "SELECT 'pearson' AS explainer, fold, 'test' AS embedding, feature_idx, round(score, 6) AS score,"
                     " CAST(row_number() OVER (PARTITION BY fold ORDER BY round(abs(score), 9) DESC NULLS LAST, feature_idx) AS INTEGER) AS rank"
                     " FROM pr", "notes", "features"))
def ranking_store(spark: SparkSession, sf: str) -> DataFrame:
    """Rankings of every fold in one store by explainer, fold and embedding; what is there already stays."""
    at = folder(spark)
    rows = FO.fold_roles(assignments(spark, sf, mention=True)).filter("fold < 5 and role = 'val'").select("fold", "row_id")
    ranked = AT.pcc_ranking(rows.join(views.features(spark, sf), "row_id"), by=["fold"])
    ranked = ranked.select(F.lit("pearson").alias("explainer"), "fold", F.lit("test").alias("embedding"), "feature_idx", "score", "rank")
    io.write_rankings(ranked.filter("fold < 3"), at)
    io.write_rankings(ranked.withColumn("score", F.when(F.col("fold") < 3, -9.0).otherwise(F.col("score"))), at)  # folds 0 to 2 stay
    back = io.read_rankings(spark, at)
    return back.select("explainer", "fold", "embedding", "feature_idx", F.round("score", 6).alias("score"), "rank")


# ---------------------------------------------------------------- S5, S12, W1

RULES = (("given", 0.35), ("again", 0.5))

_LATEST_SQL = (
    ", lp AS (SELECT row_id, embedding, fold, variant, gender, label, probability,"
    f" CASE WHEN probability >= CASE WHEN fold % 2 = 0 THEN {RULES[1][1]} ELSE {RULES[0][1]} END THEN 1 ELSE 0 END AS preds"
    " FROM predictions)\n" + sql_evaluate(KEYS, "lp") + "SELECT * FROM ev")


@register("latest_scores", "W1 S5 S12", with_views(_LATEST_SQL, "predictions"))
def latest_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all folds, then of the even folds again under another rule: the log's last row per fold counts."""
    log, p = RunLedger(spark, folder(spark), ["fold"]), views.predictions(spark, sf)
    for i, (_, threshold) in enumerate(RULES):
        decided = p.withColumn("preds", F.when(F.col("probability") >= threshold, 1).otherwise(0))
        log.append_scores(metrics.evaluate(decided.filter(F.col("fold") % 2 == 0) if i else decided, KEYS, score_domain=metrics.PROBABILITY))
    return log.latest_scores(KEYS)


# ---------------------------------------------------------------- J3

@register("aligned_rows", "J3",
          with_views("SELECT f.row_id, f.label, p.preds, round(CAST(f.features[1] AS DOUBLE), 6) AS first FROM features f"
                     " JOIN (SELECT row_id, min(preds) AS preds FROM predictions WHERE variant = 'orig' GROUP BY row_id) p"
                     " ON p.row_id = f.row_id", "features", "predictions"))
def aligned_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Features, labels and predictions of the same rows, one to one."""
    f = views.features(spark, sf).select("row_id", "label", F.round(F.col("features")[0].cast("double"), 6).alias("first"))
    p = views.predictions(spark, sf).filter("variant = 'orig'").groupBy("row_id").agg(F.min("preds").alias("preds"))
    return aligned(f, p, "row_id").select("row_id", "label", "preds", "first")


# ---------------------------------------------------------------- P9

# Label columns as the files of the study spell them
LABELS = ("DEPRESSION_majority", "alcohol.abuse", "Chronic.Pain", "Chronic.Neurological", "None-mental")


@register("label_names", "P9",
          with_views(", ln AS (SELECT row_id, [" + ", ".join(f"'{x}'" for x in LABELS)
                     + f"][CAST(row_id % {len(LABELS)} AS INTEGER) + 1] AS raw FROM notes)\nSELECT row_id, raw, CASE "
                     + " ".join(f"WHEN starts_with(raw, '{a}') THEN '{b}'" for a, b in T.PHENOTYPE_PREFIXES)
                     + " END AS name FROM ln", "notes"))
def label_names(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical names of label columns by prefix; null where none matches."""
    raw = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("row_id") % len(LABELS) + 1).cast("int"))
    return views.notes(spark, sf).select("row_id", raw.alias("raw"), T.phenotype_name(raw).alias("name"))


# ---------------------------------------------------------------- S7, T7, E8, E9, S11

CONTEXT = "[depression] is what the note says"  # a template: the bracketed head gives way to the term
FILE_TERMS = 500  # terms of one lexicon file, on average

_TERMS_SQL = (
    ", te AS (SELECT CAST(label AS VARCHAR) AS category, CAST(vec_id AS VARCHAR) AS term, embedding FROM embeddings)\n"
    ", di AS (SELECT embedding AS d FROM embeddings ORDER BY vec_id LIMIT 1)\n"
    ", co AS (SELECT te.category, te.term, list_sum(list_transform(list_zip(te.embedding, di.d), lambda p: CAST(p[1] AS DOUBLE) * p[2])) AS ab,"
    " list_sum(list_transform(te.embedding, lambda x: CAST(x AS DOUBLE) * x)) AS aa,"
    " list_sum(list_transform(di.d, lambda x: CAST(x AS DOUBLE) * x)) AS bb FROM te, di)\n")


@register("term_bias_csv", "S7 T7 E8 S11",
          with_views(_TERMS_SQL + "SELECT category, term, term || ' is what the note says' AS sentence,"
                     " CASE WHEN aa * bb <> 0 THEN round(ab / (sqrt(aa) * sqrt(bb)), 3) + 0.0 END AS score FROM co"))
def term_bias_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Terms from JSON lexicon files, put into the context template, scored against a direction, kept as CSV."""
    at = folder(spark)
    e = views.table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("category"),
                                                    F.col("vec_id").cast("string").alias("term"), "vec_id", F.col("embedding").alias("vector"))
    files = e.agg(F.ceil(F.count(F.lit(1)) / FILE_TERMS).alias("files")).withColumn("_one", F.lit(1))  # one row
    dealt = e.select("term").withColumn("_one", F.lit(1)).join(F.broadcast(files), "_one").select(
        "term", F.pmod(F.xxhash64("term"), F.col("files")).alias("file"))
    body = dealt.groupBy("file").agg(F.to_json(F.struct(F.lit(CONTEXT).alias("context"), F.collect_list("term").alias("terms"))).alias("value"))
    body.write.partitionBy("file").text(f"{at}/terms")
    lexicon = io.read_symptom_lexicon(spark, f"{at}/terms", "terms").select("term", T.context_sentence("term", "context").alias("sentence"))
    direction = e.orderBy("vec_id").limit(1).select(F.col("vector").alias("direction"))
    terms = lexicon.join(e.select("term", "category", "vector"), "term")
    io.write_csv(E.direct_bias(terms, direction).select("category", "term", "sentence", "score"), f"{at}/bias")
    return spark.read.schema("category string, term string, sentence string, score double").option("header", True).csv(f"{at}/bias")


# ---------------------------------------------------------------- M6, M8 on a stream

_STREAM_SQL = (
    ", el AS (SELECT gender, label, unnest(features) AS x, unnest(range(len(features))) AS i FROM features)\n"
    ", mu AS (SELECT gender, label, i, avg(CAST(x AS DOUBLE)) AS m FROM el GROUP BY ALL)\n"
    ", ce AS (SELECT gender, label, list(m ORDER BY i) AS m FROM mu GROUP BY gender, label)\n"
    ", md AS (SELECT a.gender, list_transform(list_zip(a.m, b.m), lambda p: p[1] - p[2]) AS w,"
    " (list_inner_product(b.m, b.m) - list_inner_product(a.m, a.m)) / 2 AS bias FROM ce a JOIN ce b ON a.gender = b.gender"
    " AND a.label = 1 AND b.label = 0)\n"
    ", sc AS (SELECT f.row_id, f.gender, f.label, list_inner_product(CAST(f.features AS DOUBLE[]), md.w) + md.bias AS margin"
    " FROM features f JOIN md USING (gender))\n"
    "SELECT row_id, gender, label, CAST(margin > 0 AS INTEGER) AS preds, round(margin, 6) AS margin,"
    " round(1 / (1 + exp(-margin)), 6) AS probability FROM sc")


@register("stream_scores", "M6 M8", with_views(_STREAM_SQL, "features"))
def stream_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Features that arrive as files, scored by the published model of their group (the nearer class mean)."""
    at, f = folder(spark), views.features(spark, sf).select("row_id", "gender", "label", "features")
    centre = E.weighted_mean_vectors(f, ["gender", "label"], "features").groupBy("gender").agg(
        *[F.max(F.when(F.col("label") == k, F.col("vector"))).alias(f"m{k}") for k in (0, 1)])
    models = centre.filter("m0 is not null and m1 is not null").select(
        "gender", E.vsub("m1", "m0").alias("weights"), ((E.dot("m0", "m0") - E.dot("m1", "m1")) / 2).alias("bias"),
        F.lit(1.0).alias("slope"), F.lit(0.0).alias("offset"))
    scoring.publish_models(models, f"{at}/models")
    f.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 64).parquet(f"{at}/in")
    scoring.score_keyed_stream(stream, f"{at}/models", ["gender"], f"{at}/out", f"{at}/progress", available_now=True).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("row_id", "gender", "label", "preds", F.round("margin", 6).alias("margin"),
                                                  F.round("probability", 6).alias("probability"))
