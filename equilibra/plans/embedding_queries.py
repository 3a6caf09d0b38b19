"""Embedding queries over `documents`, `notes`, `embeddings` and `word_vectors`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counterfactual as CF
from ..operators import embeddings as E
from ..sources import views
from .oracle_views import with_views
from .registry import register
from .text_queries import _CHUNK_SQL, duck_clean

N_PAIRS = 10  # definitional pairs (2i, 2i + 1) of the embeddings table
DIM = 64      # vector size of the test tables


def _summary(df: DataFrame, key: str, vector: str = "vector", n: str | None = "n") -> DataFrame:
    """Scalar fingerprint of pooled vectors: first component and L2 norm (rounded)."""
    cols = [key] + ([F.col(n)] if n else [])
    return df.select(*cols, F.round(F.col(vector)[0], 6).alias("first"),
                     F.round(E.norm(vector), 6).alias("l2"))


def _pool_sql(hits_cte: str, base: str) -> str:
    # hits: (row_id, vector, w); base: (row_id) of every text
    return (hits_cte
            + ", el AS (SELECT row_id, w, unnest(vector) AS v, unnest(range(len(vector))) AS i FROM hits)\n"
            ", mv AS (SELECT row_id, i, sum(w * v) / sum(w) AS m FROM el GROUP BY row_id, i)\n"
            ", pooled AS (SELECT row_id, sum(m * m) AS ss, max(CASE WHEN i = 0 THEN m END) AS first"
            " FROM mv GROUP BY row_id)\n"
            ", cnt AS (SELECT row_id, sum(w) AS n FROM hits GROUP BY row_id)\n"
            f"SELECT b.row_id, CAST(c.n AS BIGINT) AS n, round(p.first, 6) AS first, round(sqrt(p.ss), 6) AS l2"
            f" FROM ({base}) b LEFT JOIN pooled p USING (row_id) LEFT JOIN cnt c USING (row_id)")


def mean_pooled(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    return E.mean_pool(docs, views.word_vectors(spark, sf))


@register("mean_pool", "E1 J1 T1 T5",
          with_views(_pool_sql(
              f", dc AS (SELECT doc_id AS row_id, {duck_clean('text')} AS ct FROM documents)\n"
              ", tk AS (SELECT row_id, lower(unnest(string_split(ct, ' '))) AS word FROM dc)\n"
              ", hits AS (SELECT t.row_id, w.vector, 1.0 AS w FROM tk t JOIN word_vectors w ON t.word = w.word)\n",
              "SELECT doc_id AS row_id FROM documents"), "word_vectors"))
def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(mean_pooled(spark, sf), "row_id")


def token_vectors(spark: SparkSession, sf: str, lexicon: DataFrame | None = None, of: Column | None = None,
                  chunks: DataFrame | None = None, named: bool = False) -> DataFrame | E.NamedVectors:
    """Contextual token-vector table: words of each chunk with their word vectors,
    an opening token (pos 0) and a closing token of ones after the last word.
    ``of``: a condition on chunks (a filter of the table's rows does not pass the vectors' look-up).
    ``chunks``: those of the notes, where the caller has them; ``named``: every vector once."""
    chunks = CF.chunk_notes(views.notes(spark, sf)) if chunks is None else chunks
    ones = F.array_repeat(F.lit(1.0), DIM)
    lexicon = views.word_vectors(spark, sf) if lexicon is None else lexicon
    return E.chunk_token_vectors(chunks if of is None else chunks.filter(of), lexicon, opening=ones, closing=ones, named=named)


_TOKEN_VECTORS_SQL = (
    _CHUNK_SQL.replace("SELECT row_id, CAST(para AS INTEGER)", ", ch AS (SELECT row_id, CAST(para AS INTEGER)")
    .rstrip() + ")\n"
    ", tw AS (SELECT row_id, para, chunk, unnest(string_split(chunk_text, ' ')) AS word,"
    " unnest(range(len(string_split(chunk_text, ' ')))) + 1 AS pos FROM ch)\n"
    ", tv AS (SELECT t.row_id, t.para, t.chunk, t.pos, CAST(w.vector AS DOUBLE[]) AS vector FROM tw t"
    " JOIN word_vectors w ON lower(t.word) = w.word WHERE length(t.word) > 0"
    f" UNION ALL SELECT row_id, para, chunk, 0, list_transform(range({DIM}), lambda x: 1.0) FROM ch"
    f" UNION ALL SELECT row_id, para, chunk, n_words + 1, list_transform(range({DIM}), lambda x: 1.0) FROM ch)\n")


@register("context_pool", "E2 T6",
          with_views(_TOKEN_VECTORS_SQL + _pool_sql(", hits AS (SELECT row_id, vector, 1.0 AS w FROM tv WHERE pos >= 1)\n",
                                 "SELECT row_id FROM notes"), "notes", "word_vectors"))
def context_pool(spark: SparkSession, sf: str) -> DataFrame:
    pooled = E.context_pool(token_vectors(spark, sf))
    return views.notes(spark, sf).select("row_id").join(_summary(pooled, "row_id"), "row_id", "left")


@register("first_token", "E3",
          with_views(_TOKEN_VECTORS_SQL + "SELECT row_id, round(vector[1], 6) AS first, round(sqrt(list_inner_product(vector, vector)),"
                     " 6) AS l2 FROM tv WHERE para = 0 AND chunk = 0 AND pos = 10", "notes", "word_vectors"))
def first_token(spark: SparkSession, sf: str) -> DataFrame:
    first_chunk = (F.col("para") == 0) & (F.col("chunk") == 0)
    return _summary(E.first_token(token_vectors(spark, sf, of=first_chunk), 10), "row_id", n=None)


@register("cosine", "E4",
          with_views("SELECT a.vec_id, round(CASE WHEN sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]),"
                     " CAST(a.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]),"
                     " CAST(b.embedding AS DOUBLE[]))) <> 0 THEN list_inner_product(CAST(a.embedding AS DOUBLE[]),"
                     " CAST(b.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]),"
                     " CAST(a.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]),"
                     " CAST(b.embedding AS DOUBLE[])))) END, 6) AS cosine"
                     " FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"))
def cosine(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "embeddings")
    a = e.select("vec_id", F.col("embedding").alias("va"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("vb"))
    return a.join(b, "vec_id").select("vec_id", F.round(E.cosine("va", "vb"), 6).alias("cosine"))


def pairs(spark: SparkSession) -> DataFrame:
    """Definitional pairs (pair_id, a, b) = (i, 2i, 2i + 1): a parameter, not data."""
    r = spark.range(N_PAIRS)
    return r.select(F.col("id").alias("pair_id"), (2 * F.col("id")).alias("a"), (2 * F.col("id") + 1).alias("b"))


def pair_diffs(spark: SparkSession, sf: str) -> DataFrame:
    return E.pair_differences(views.table(spark, sf, "embeddings"), pairs(spark))


_PAIRS_SQL = (
    f", pr AS (SELECT t.i AS pair_id, 2 * t.i AS a, 2 * t.i + 1 AS b FROM range(0, {N_PAIRS}) t(i))\n"
    ", pv AS (SELECT p.pair_id, CAST(ea.embedding AS DOUBLE[]) AS va, CAST(eb.embedding AS DOUBLE[]) AS vb"
    " FROM pr p JOIN embeddings ea ON ea.vec_id = p.a JOIN embeddings eb ON eb.vec_id = p.b)\n"
    ", pe AS (SELECT pair_id, unnest(va) AS x, unnest(vb) AS y, unnest(range(len(va))) AS i FROM pv)\n")


@register("pair_differences", "E6",
          with_views(_PAIRS_SQL
                     + ", dd AS (SELECT pair_id, i, x - (x + y) / 2 AS da, y - (x + y) / 2 AS db FROM pe)\n"
                     "SELECT pair_id, 'a' AS side, round(max(CASE WHEN i = 0 THEN da END), 6) AS first,"
                     " round(sqrt(sum(da * da)), 6) AS l2 FROM dd GROUP BY pair_id UNION ALL "
                     "SELECT pair_id, 'b', round(max(CASE WHEN i = 0 THEN db END), 6),"
                     " round(sqrt(sum(db * db)), 6) FROM dd GROUP BY pair_id"))
def pair_differences(spark: SparkSession, sf: str) -> DataFrame:
    d = pair_diffs(spark, sf)
    return d.select("pair_id", "side", F.round(F.col("diff")[0], 6).alias("first"),
                    F.round(E.norm("diff"), 6).alias("l2"))


def mean_direction(spark: SparkSession, sf: str) -> DataFrame:
    """Direction = element-wise mean over pairs of (a - b): one row, ``direction``."""
    e = views.table(spark, sf, "embeddings")
    va = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"))
    vb = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    d = pairs(spark).join(va, "a").join(vb, "b").select(F.lit(1).alias("_all"), E.vsub("va", "vb").alias("d"))
    m = E.weighted_mean_vectors(d, ["_all"], "d")
    return m.select(F.col("vector").alias("direction"))


_DIR_SQL = _PAIRS_SQL + (
    ", dir AS (SELECT list(d ORDER BY i) AS direction FROM (SELECT i, avg(x - y) AS d FROM pe GROUP BY i))\n")


@register("projection", "E5",
          with_views(_DIR_SQL + ", pj AS (SELECT e.vec_id, list_transform(d.direction, lambda g: g *"
                     " list_inner_product(CAST(e.embedding AS DOUBLE[]), d.direction)"
                     " / list_inner_product(d.direction, d.direction)) AS p FROM embeddings e, dir d)\n"
                     "SELECT vec_id, round(p[1], 6) AS first, round(sqrt(list_inner_product(p, p)), 6) AS l2 FROM pj"))
def projection(spark: SparkSession, sf: str) -> DataFrame:
    e = views.table(spark, sf, "embeddings").select("vec_id", "embedding", F.lit(1).alias("_one"))
    d = mean_direction(spark, sf).withColumn("_one", F.lit(1))
    j = e.join(F.broadcast(d), "_one")
    p = E.projection("direction", "embedding")
    return j.select("vec_id", F.round(p[0], 6).alias("first"), F.round(E.norm(p), 6).alias("l2"))


def bias_scores(spark: SparkSession, sf: str) -> DataFrame:
    terms = views.table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("category"),
                                                        F.col("embedding").alias("vector"))
    return E.direct_bias(terms, mean_direction(spark, sf))


_BIAS_SQL = _DIR_SQL + (
    ", cs AS (SELECT e.vec_id, e.label AS category, CASE WHEN sqrt(list_inner_product(CAST(e.embedding AS"
    " DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_inner_product(d.direction, d.direction)) <> 0"
    " THEN list_inner_product(CAST(e.embedding AS DOUBLE[]), d.direction) / (sqrt(list_inner_product("
    "CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_inner_product(d.direction,"
    " d.direction))) END AS cosine FROM embeddings e, dir d)\n")


@register("direct_bias", "E8 E4", with_views(_BIAS_SQL + "SELECT vec_id, category, round(cosine, 6) AS cosine,"
                                             " round(cosine, 3) AS score FROM cs"))
def direct_bias(spark: SparkSession, sf: str) -> DataFrame:
    return bias_scores(spark, sf).select("vec_id", "category", F.round("cosine", 6).alias("cosine"), "score")


_BIAS_SUMMARY_SQL = _BIAS_SQL + (
    ", bs AS (SELECT category, avg(cosine) AS mean, max(abs(cosine)) AS max, median(abs(cosine)) AS median"
    " FROM cs GROUP BY category)\n")


@register("direct_bias_summary", "E9",
          with_views(_BIAS_SUMMARY_SQL + "SELECT category, round(mean, 6) AS mean, round(max, 6) AS max,"
                     " round(median, 6) AS median FROM bs"))
def direct_bias_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = E.direct_bias_summary(bias_scores(spark, sf))
    return s.select("category", *[F.round(c, 6).alias(c) for c in ("mean", "max", "median")])


@register("bias_long", "E10",
          with_views(_BIAS_SUMMARY_SQL + "SELECT category, 'mean' AS summary, round(mean, 6) AS bias_score FROM bs"
                     " UNION ALL SELECT category, 'max', round(max, 6) FROM bs"
                     " UNION ALL SELECT category, 'median', round(median, 6) FROM bs"))
def bias_long(spark: SparkSession, sf: str) -> DataFrame:
    s = E.bias_long(E.direct_bias_summary(bias_scores(spark, sf)))
    return s.select("category", "summary", F.round("bias_score", 6).alias("bias_score"))


@register("gender_direction", "E7 M23")
def gender_direction(spark: SparkSession, sf: str) -> DataFrame:
    """PCA on the pair differences: explained-variance ratios and the first component (rows-only)."""
    pc, ev = E.gender_direction(pair_diffs(spark, sf))
    rows = [(i + 1, float(v), pc if i == 0 else None) for i, v in enumerate(ev)]
    return spark.createDataFrame(rows, "component int, explained_variance double, direction array<double>")


@register("dim_check", "E11 P4",
          with_views("SELECT CAST(len(features) = 64 AS BOOLEAN) AS dim_ok, CAST(count(*) AS BIGINT) AS n"
                     " FROM features GROUP BY len(features) = 64", "features"))
def dim_check(spark: SparkSession, sf: str) -> DataFrame:
    f = E.dims_check(views.features(spark, sf), {"test": DIM}, "test")
    return f.groupBy("dim_ok").agg(F.count(F.lit(1)).alias("n"))


_MULTI_SQL = (
    _TOKEN_VECTORS_SQL
    + f", dn AS (SELECT row_id, {duck_clean('text')} AS ct FROM notes)\n"
    ", tn AS (SELECT row_id, lower(unnest(string_split(ct, ' '))) AS word FROM dn)\n"
    + "SELECT 'word_mean' AS embedding, row_id, n, first, l2 FROM (WITH one AS (SELECT 1)"
    + _pool_sql(", hits AS (SELECT t.row_id, w.vector, 1.0 AS w FROM tn t JOIN word_vectors w ON t.word = w.word)\n",
                "SELECT row_id FROM notes") + ")"
    " UNION ALL SELECT 'context_mean', row_id, n, first, l2 FROM (WITH one AS (SELECT 1)"
    + _pool_sql(", hits AS (SELECT row_id, vector, 1.0 AS w FROM tv WHERE pos >= 1)\n", "SELECT row_id FROM notes") + ")")


@register("multi_embedding", "E12", with_views(_MULTI_SQL, "notes", "word_vectors"))
def multi_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Word-vector and contextual pooling of the same notes, stacked by embedding name."""
    n = views.notes(spark, sf)
    lexicon = views.word_vectors(spark, sf)
    wv = E.mean_pool(n.select("row_id", "text"), lexicon)
    cp = n.select("row_id").join(E.context_pool(token_vectors(spark, sf, lexicon)), "row_id", "left")
    a = _summary(wv, "row_id").withColumn("embedding", F.lit("word_mean"))
    b = _summary(cp, "row_id").withColumn("embedding", F.lit("context_mean"))
    return a.unionByName(b)
