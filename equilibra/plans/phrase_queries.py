"""Phrases of a table in notes, vectors of terms, principal directions per encoder.

The tables of phrases are taken from the documents: what a document begins with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counterfactual as CF
from ..operators import embeddings as E
from ..operators import phrases as PH
from ..session import cut_lineage
from ..sources import views
from .embedding_queries import _DIR_SQL, _TOKEN_VECTORS_SQL, mean_direction, token_vectors
from .oracle_views import with_views
from .registry import register


def openings(spark: SparkSession, sf: str, longest: int, *keep: Column | str) -> DataFrame:
    """The first one to ``longest`` words of every document (``words``)."""
    w = F.split(F.substring_index("text", " ", longest), " ")  # the words behind them are not split
    heads = F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.slice(w, F.lit(1), n))
    return views.table(spark, sf, "documents").select(*keep, F.explode(heads).alias("words"))


# ---------------------------------------------------------------- T4, S8

_REWRITE_SQL = (
    ", he AS (SELECT doc_id AS line_no, string_split(text, ' ') AS w, unnest([1, 2, 3]) AS k FROM documents)\n"
    ", lx AS (SELECT lower(array_to_string(w[1:k], ' ')) AS phrase, arg_min('<' || array_to_string(w[1:k], '_') || '>', line_no)"
    " AS target FROM he GROUP BY 1 HAVING length(phrase) > 0)\n"
    ", po AS (SELECT row_id, unnest(string_split(text, ' ')) AS w, unnest(string_split(lower(text), ' ')) AS a,"
    " unnest(range(len(string_split(text, ' ')))) AS i FROM notes)\n"
    ", pn AS (SELECT *, lead(a, 1) OVER x AS b, lead(a, 2) OVER x AS c FROM po WINDOW x AS (PARTITION BY row_id ORDER BY i))\n"
    ", mt AS (SELECT row_id, i, CASE WHEN l3.target IS NOT NULL THEN 3 WHEN l2.target IS NOT NULL THEN 2 ELSE 1 END AS n,"
    " coalesce(l3.target, l2.target, l1.target, w) AS t FROM pn LEFT JOIN lx l1 ON l1.phrase = a"
    " LEFT JOIN lx l2 ON l2.phrase = a || ' ' || b LEFT JOIN lx l3 ON l3.phrase = a || ' ' || b || ' ' || c)\n"
    "SELECT row_id, array_to_string(list(t ORDER BY i), ' ') AS rewritten FROM (\n"
    "WITH RECURSIVE walk AS (SELECT row_id, i, n, t FROM mt WHERE i = 0 UNION ALL SELECT mt.row_id, mt.i, mt.n, mt.t"
    " FROM walk JOIN mt ON mt.row_id = walk.row_id AND mt.i = walk.i + walk.n) SELECT * FROM walk) GROUP BY row_id")


@register("phrase_rewrite", "T4 S8", with_views(_REWRITE_SQL, "notes"))
def phrase_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Notes rewritten by a table of phrases of one to three words, the longest first."""
    o = openings(spark, sf, 3, F.col("doc_id").alias("line_no"))
    lexicon = o.select(F.array_join("words", " ").alias("from_term"),
                       F.concat(F.lit("<"), F.array_join("words", "_"), F.lit(">")).alias("to_term"), "line_no")
    return PH.rewrite_phrases(views.notes(spark, sf).select("row_id", "text"), lexicon)


# ---------------------------------------------------------------- T7, E3, E8, J1

def _cos_sql(a: str, b: str) -> str:
    size = f"(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
    return f"CASE WHEN {size} <> 0 THEN list_inner_product({a}, {b}) / {size} END"


_TERM_SQL = (
    _DIR_SQL + _TOKEN_VECTORS_SQL
    + ", he AS (SELECT lang AS category, string_split(text, ' ') AS w, unnest([1, 2]) AS k FROM documents)\n"
    ", te AS (SELECT DISTINCT category, lower(array_to_string(w[1:k], ' ')) AS term FROM he WHERE length(array_to_string(w[1:k], ' ')) > 0)\n"
    ", ph AS (SELECT DISTINCT term FROM te)\n"
    ", nx AS (SELECT *, lower(word) AS lo, lead(lower(word)) OVER (PARTITION BY row_id, para, chunk ORDER BY pos) AS nw FROM tw)\n"
    ", rn AS (SELECT row_id, para, chunk, pos, 0 AS more, lo AS term FROM nx UNION ALL"
    " SELECT row_id, para, chunk, pos, 1, lo || ' ' || nw FROM nx WHERE nw IS NOT NULL)\n"
    ", sp AS (SELECT rn.* FROM rn JOIN ph USING (term))\n"
    ", el AS (SELECT s.*, unnest(t.vector) AS v, unnest(range(len(t.vector))) AS i FROM sp s JOIN tv t ON t.row_id = s.row_id"
    " AND t.para = s.para AND t.chunk = s.chunk AND t.pos >= s.pos AND t.pos <= s.pos + s.more)\n"
    ", oc AS (SELECT row_id, para, chunk, pos, term, i, avg(v) AS v FROM el GROUP BY ALL)\n"
    ", me AS (SELECT term, i, avg(v) AS v, count(*) AS n FROM oc GROUP BY term, i)\n"
    ", ve AS (SELECT term, list(v ORDER BY i) AS vector, max(n) AS n FROM me GROUP BY term)\n"
    f"SELECT te.category, te.term, ve.n, round({_cos_sql('ve.vector', 'dir.direction')}, 6) AS cosine FROM te JOIN ve USING (term), dir")


@register("term_vectors", "T7 E3 E8 J1 Q17", with_views(_TERM_SQL, "notes", "word_vectors"))
def term_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of one- and two-word terms from their occurrences in notes, and their bias by category."""
    terms = openings(spark, sf, 2, F.col("lang").alias("category"))
    # terms and chunks are read several times, the lexicon once for the words and once for the vectors
    terms = cut_lineage(terms.select("category", F.lower(F.array_join("words", " ")).alias("term")).distinct())
    chunks = cut_lineage(CF.chunk_notes(views.notes(spark, sf)))
    lexicon = views.word_vectors(spark, sf, write_numbers=True)
    v = PH.term_vectors(chunks, token_vectors(spark, sf, lexicon, chunks=chunks, named=True), terms)
    return E.direct_bias(v, mean_direction(spark, sf)).select("category", "term", "n", F.round("cosine", 6).alias("cosine"))


# ---------------------------------------------------------------- E7, M23 per encoder

COMPONENTS = 5  # Fixed value: the components that the study looks at
SQUARINGS = 24  # the SQL's matrix to the power 2^24 holds one direction only

# two encoders of different vector sizes over the same items
_ENCODERS_SQL = ", en AS (SELECT vec_id, label AS category, unnest([{'e': 'wide', 'v': CAST(embedding AS DOUBLE[])}," \
    " {'e': 'narrow', 'v': CAST(embedding[1:len(embedding) // 2] AS DOUBLE[])}], recursive := true) FROM embeddings)\n"


def encoders(vectors: DataFrame, vector: str, *keep: str) -> DataFrame:
    """Every vector as its whole (``wide``) and its first half (``narrow``)."""
    both = F.array(F.struct(F.lit("wide").alias("encoder"), F.col(vector).alias("v")),
                   F.struct(F.lit("narrow").alias("encoder"), F.slice(vector, F.lit(1), F.floor(F.size(vector) / 2).cast("int")).alias("v")))
    return vectors.select(*keep, F.explode(both).alias("_e")).select(*keep, "_e.encoder", F.col("_e.v").alias(vector))


def _component_sql(c: int) -> str:
    """The leading eigenvector of ``cv<c>`` by repeated squaring, and the matrix without it."""
    trace = "list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i]))"
    unit = f"list_transform(m, lambda r: list_transform(r, lambda x: x / {trace}))"
    square = "list_transform(m, lambda r: list_transform(m, lambda q: list_inner_product(r, q)))"
    return (
        f", sq{c} AS (WITH RECURSIVE s AS (SELECT e, 0 AS t, m FROM cv{c} UNION ALL"
        f" SELECT e, t + 1, {square} FROM (SELECT e, t, {unit} AS m FROM s WHERE t < {SQUARINGS})) SELECT e, m FROM s WHERE t = {SQUARINGS})\n"
        f", ro{c} AS (SELECT e, unnest(m) AS r, unnest(range(1, len(m) + 1)) AS i FROM sq{c})\n"
        f", ve{c} AS (SELECT e, list_transform(r, lambda x: x / sqrt(list_inner_product(r, r))) AS v"
        f" FROM (SELECT e, arg_max(r, r[i]) AS r FROM ro{c} GROUP BY e))\n"
        f", va{c} AS (SELECT e, v, m, list_inner_product(v, list_transform(m, lambda r: list_inner_product(r, v))) AS l FROM ve{c} JOIN cv{c} USING (e))\n"
        f", cv{c + 1} AS (SELECT e, list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - l * v[i] * v[j])) AS m FROM va{c})\n")


_COV_SQL = _ENCODERS_SQL + (
    ", pd AS (SELECT a.e, a.vec_id, unnest([1.0, -1.0]) AS s, list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) / 2) AS d"
    " FROM en a JOIN en b ON b.e = a.e AND b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)\n"
    ", dx AS (SELECT e, vec_id, s, unnest(d) * s AS x, unnest(range(len(d))) AS i FROM pd)\n"
    ", cx AS (SELECT a.e, a.i, b.i AS j, avg(a.x * b.x) - avg(a.x) * avg(b.x) AS c FROM dx a JOIN dx b ON a.e = b.e AND a.vec_id = b.vec_id"
    " AND a.s = b.s GROUP BY ALL)\n"
    ", cr AS (SELECT e, i, list(c ORDER BY j) AS r FROM cx GROUP BY e, i)\n"
    ", cv1 AS (SELECT e, list(r ORDER BY i) AS m FROM cr GROUP BY e)\n")

_DIRECTIONS_SQL = (
    _COV_SQL + "".join(_component_sql(c) for c in range(1, COMPONENTS + 1))
    + ", tr AS (SELECT e, sum(c) AS total FROM cx WHERE i = j GROUP BY e)\n"
    + " UNION ALL ".join(f"SELECT e AS encoder, {c} AS component, round(l / total, 6) AS explained_variance, round(v[1], 6) AS first,"
                         f" round(v[len(v)], 6) AS last, len(v) AS dim FROM va{c} JOIN tr USING (e)" for c in range(1, COMPONENTS + 1)))


def encoder_components(spark: SparkSession, sf: str, k: int) -> DataFrame:
    e = views.table(spark, sf, "embeddings")
    half = F.floor(F.col("vec_id") / 2)
    pairs = e.select(half.alias("pair_id"), (2 * half).alias("a"), (2 * half + 1).alias("b")).distinct()
    diffs = E.pair_differences(e, pairs)
    return E.principal_directions(encoders(diffs, "diff", "pair_id", "side"), ["encoder"], k)


@register("encoder_directions", "E7", with_views(_DIRECTIONS_SQL))
def encoder_directions(spark: SparkSession, sf: str) -> DataFrame:
    """The leading components of all pair differences, per encoder."""
    d = encoder_components(spark, sf, COMPONENTS)
    return d.select("encoder", "component", F.round("explained_variance", 6).alias("explained_variance"),
                    F.round(F.col("direction")[0], 6).alias("first"), F.round(F.element_at("direction", -1), 6).alias("last"),
                    F.size("direction").alias("dim"))


_ENCODER_BIAS_SQL = _COV_SQL + _component_sql(1) + (
    f", cs AS (SELECT en.e AS encoder, en.category, {_cos_sql('en.v', 'va1.v')} AS x FROM en JOIN va1 ON va1.e = en.e)\n"
    "SELECT encoder, category, round(avg(x), 6) AS mean, round(max(abs(x)), 6) AS max, round(median(abs(x)), 6) AS median"
    " FROM cs GROUP BY encoder, category")


@register("encoder_bias", "M23 E6 E7 E8 E9", with_views(_ENCODER_BIAS_SQL))
def encoder_bias(spark: SparkSession, sf: str) -> DataFrame:
    """Direct bias of every item against its encoder's gender direction, by encoder and category."""
    # a row per encoder, read twice
    direction = cut_lineage(encoder_components(spark, sf, 1).select("encoder", "direction"))
    terms = views.table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("category"), F.col("embedding").alias("vector"))
    scored = E.direct_bias(encoders(terms, "vector", "vec_id", "category"), direction, by=["encoder"])
    s = E.direct_bias_summary(scored, by=["encoder"])
    return s.select("encoder", "category", *[F.round(c, 6).alias(c) for c in ("mean", "max", "median")])
