"""Feature rankings, muting and removal for a linear model.

The model is ``margin = b + sum_j beta_j z_j`` on standardised features
``z = (x - mean) / std`` (population std, fit on training rows).  Because a
muted feature is set to its training mean, its standardised value is 0, so
muting the top-i ranked features gives ``margin_i = b + sum_{rank > i} beta_j z_j``:
every step of the iterative analysis is one cumulative sum over the ranked
contributions of a row (an array of the dimension's length), not a refit.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions import text as T
from . import metrics
from .folds import order_hash
from .ordered import hex_prefix_number

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

Weights = Sequence[float] | Column


def fixed_weights(dim: int) -> list[float]:
    """Deterministic weights of the fixed reference model: ((7 j) mod 13 - 6) / 6."""
    return [((7 * j) % 13 - 6) / 6.0 for j in range(dim)]


def fixed_weights_of(vector: str = "z") -> Column:
    """The same weights, as many as the vector has entries."""
    return F.transform(vector, lambda x, j: ((7 * j) % 13 - 6) / F.lit(6.0))


def _lit_array(values: Weights) -> Column:
    return values if isinstance(values, Column) else F.array(*[F.lit(float(v)) for v in values])


def feature_stats(train: DataFrame, features: str = "features", by: Sequence[str] = ()) -> DataFrame:
    """One row (per key of ``by``): element-wise mean and population std of the training vectors."""
    v = array_to_vector(F.col(features))
    s = train.groupBy(*by).agg(Summarizer.mean(v).alias("_m"), Summarizer.variance(v).alias("_v"),
                  F.count(F.lit(1)).alias("_n"))
    n = F.col("_n").cast("double")
    return s.select(*by, vector_to_array("_m").alias("mu"),
                    F.transform(vector_to_array("_v"), lambda x: F.sqrt(x * (n - 1) / n)).alias("sd"))


def _with_stats(df: DataFrame, stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    # one d-sized row (per fold): broadcast, joined on the keys or a constant
    if by:
        return df.join(F.broadcast(stats), list(by))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one").drop("_one")


def standardize(df: DataFrame, stats: DataFrame, features: str = "features", out: str = "z",
                by: Sequence[str] = ()) -> DataFrame:
    """M1 (population std): z = (x - mu) / sd, 0 where sd = 0; the stats of each row's ``by`` keys."""
    j = _with_stats(df, stats, by)
    z = F.transform(F.arrays_zip(F.col(features).alias("x"), F.col("mu").alias("m"), F.col("sd").alias("s")),
                    lambda e: F.when(e["s"] != 0, (e["x"].cast("double") - e["m"]) / e["s"]).otherwise(F.lit(0.0)))
    return j.withColumn(out, z).drop("mu", "sd")


def margin(z: Column | str, beta: Weights, intercept: float = 0.0) -> Column:
    zc = F.col(z) if isinstance(z, str) else z
    return F.aggregate(F.zip_with(zc, _lit_array(beta), lambda a, b: a * b), F.lit(float(intercept)),
                       lambda acc, x: acc + x)


# ---------------------------------------------------------------- rankings

def rank_features(scores: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Rank 1 = largest |score|, ties by feature index (d rows per key: one small window).

    Scores are compared at 9 decimals: averages that are equal in exact
    arithmetic may differ in the last bits with summation order, and must tie.
    """
    w = Window.partitionBy(*by).orderBy(F.round(F.abs(F.col(score)), 9).desc(), F.col("feature_idx"))
    return scores.select("*", F.abs(F.col(score)).alias("abs_score"),
                         F.concat(F.lit("Feature_"), (F.col("feature_idx") + 1).cast("string")).alias("feature"),
                         F.row_number().over(w).alias("rank"))


def pearson_scores(df: DataFrame, group: str = "gender", features: str = "features", by: Sequence[str] = ()) -> DataFrame:
    """H4: Pearson r of every feature with the group code (F -> 0, else 1), per key of ``by``; null for constant columns."""
    by = list(by)
    g = T.gender_code(group).cast("double")
    x = F.col(features)
    v = df.select(*by, array_to_vector(x).alias("_x"),
                  array_to_vector(F.transform(x, lambda e: e.cast("double") * e)).alias("_xx"),
                  array_to_vector(F.transform(x, lambda e: e.cast("double") * g)).alias("_xg"),
                  g.alias("_g"))
    s = v.groupBy(*by).agg(Summarizer.mean(F.col("_x")).alias("mx"), Summarizer.mean(F.col("_xx")).alias("mxx"),
                           Summarizer.mean(F.col("_xg")).alias("mxg"), F.avg("_g").alias("mg"),
                           F.avg(F.col("_g") * F.col("_g")).alias("mgg"))
    s = s.select(*by, vector_to_array("mx").alias("mx"), vector_to_array("mxx").alias("mxx"),
                 vector_to_array("mxg").alias("mxg"), "mg", "mgg")
    e = s.select(*by, "mg", "mgg", F.posexplode(F.arrays_zip("mx", "mxx", "mxg")).alias("feature_idx", "m"))
    cov = F.col("m.mxg") - F.col("m.mx") * F.col("mg")
    vx = F.col("m.mxx") - F.col("m.mx") * F.col("m.mx")
    vg = F.col("mgg") - F.col("mg") * F.col("mg")
    r = F.when((vx > 0) & (vg > 0), cov / F.sqrt(vx * vg))
    return e.select(*by, F.col("feature_idx").cast("int").alias("feature_idx"), r.alias("score"))


def pcc_ranking(df: DataFrame, by: Sequence[str] = (), **kw) -> DataFrame:
    """Pearson ranking (one per key of ``by``)."""
    return rank_features(pearson_scores(df, by=by, **kw), by=by)


def random_ranking(spark: SparkSession, dim: int, seed: int = 0) -> DataFrame:
    """A reproducible random order of the features (md5 of name and seed)."""
    return _random_order(spark.range(dim).select(F.col("id").cast("int").alias("feature_idx")), seed)


def random_ranking_of(df: DataFrame, vector: str = "features", seed: int = 0) -> DataFrame:
    """M16 over the features that the rows of ``df`` have (the longest vector's)."""
    dim = df.agg(F.max(F.size(vector)).alias("d")).filter("d > 0")
    return _random_order(dim.select(F.explode(F.sequence(F.lit(0), F.col("d") - 1)).alias("feature_idx")), seed)


def _random_order(r: DataFrame, seed: int) -> DataFrame:
    h = F.md5(F.concat(F.lit("Feature_"), (F.col("feature_idx") + 1).cast("string"), F.lit(":"), F.lit(str(seed))))
    w = Window.orderBy(h, F.col("feature_idx"))
    return r.select("feature_idx", F.concat(F.lit("Feature_"), (F.col("feature_idx") + 1).cast("string"))
                    .alias("feature"), F.row_number().over(w).alias("rank"))


def linear_attribution(explain: DataFrame, background: DataFrame, beta: Sequence[float] | None,
                       z: str = "z") -> DataFrame:
    """M13 (re-aimed): mean |beta_j (z_j - E_background[z_j])| per feature, ranked (the fixed weights if none are given)."""
    bg = background.agg(Summarizer.mean(array_to_vector(F.col(z))).alias("_m")) \
        .select(vector_to_array("_m").alias("_bg"))
    j = _with_stats(explain, bg)
    dev = F.zip_with(F.col(z), F.col("_bg"), lambda a, b: F.abs(a - b))
    s = j.agg(Summarizer.mean(array_to_vector(dev)).alias("_d")).select(vector_to_array("_d").alias("d"))
    weights = fixed_weights_of("d") if beta is None else _lit_array(beta)
    e = s.select(F.posexplode(F.zip_with(F.col("d"), weights, lambda a, b: a * F.abs(b)))
                 .alias("feature_idx", "score"))
    return rank_features(e.select(F.col("feature_idx").cast("int").alias("feature_idx"), "score"))


def sampled_shapley(df: DataFrame, beta: Weights, intercept: float = 0.0, permutations: int = 10,
                    key: str = "row_id", z: str = "z") -> DataFrame:
    """M13 (b): sampled Shapley values of the hard prediction ``1[margin > 0]``.

    Absent features take the background value (0 after standardisation).  For
    each row and permutation p the features are ordered by
    ``md5(row_id:p:j)``; walking that order, a feature's marginal is the change
    of the indicator when its term joins the running margin.  The walks stay
    inside the row (arrays of the dimension's length); the score of a feature
    is the mean over rows of |mean over permutations|, so only sums of one
    value per feature are shuffled.
    """
    b = F.lit(float(intercept))
    terms = F.zip_with(F.col(z), _lit_array(beta), lambda a, w: a * w)

    def on(m: Column) -> Column:
        return F.when(m > 0, 1.0).otherwise(0.0)

    def walk(p: Column) -> Column:
        ordered = F.array_sort(F.transform(terms, lambda x, j: F.struct(
            F.md5(F.concat_ws(":", F.col(key).cast("string"), p.cast("string"), j.cast("string"))).alias("h"),
            j.alias("j"), x.alias("x"))))
        start = F.struct(F.expr("cast(array() as array<struct<j:int,m:double>>)").alias("seen"), F.lit(0.0).alias("sum"))

        def add(acc: Column, e: Column) -> Column:
            m = acc["sum"] + e["x"] + b
            step = F.struct(e["j"].alias("j"), (on(m) - on(m - e["x"])).alias("m"))
            return F.struct(F.concat(acc["seen"], F.array(step)).alias("seen"), (acc["sum"] + e["x"]).alias("sum"))
        return F.aggregate(ordered, start, add,
                           lambda acc: F.transform(F.array_sort(acc["seen"]), lambda e: e["m"]))

    total = F.aggregate(F.sequence(F.lit(0), F.lit(permutations - 1)), F.transform(z, lambda x: F.lit(0.0)),
                        lambda acc, p: F.zip_with(acc, walk(p), lambda x, y: x + y))
    phi = df.select(F.transform(total, lambda x: F.abs(x) / permutations).alias("_phi"))
    mean = phi.agg(Summarizer.mean(array_to_vector("_phi")).alias("_m"))
    score = mean.select(F.posexplode(vector_to_array("_m")).alias("feature_idx", "score"))
    return rank_features(score.select(F.col("feature_idx").cast("int").alias("feature_idx"), "score"))


BLOCK = 4096  # rows that are permuted among themselves, on average


def permutation_importance(df: DataFrame, beta: Weights, intercept: float = 0.0, repeats: int = 20,
                           key: str = "row_id", label: str = "label", z: str = "z") -> DataFrame:
    """Macro-F1 drop when one feature is permuted across rows, 20 repeats.

    With a linear margin only one term changes: ``m - beta_j z_ij + beta_j z_pj``
    where p is the partner row of i in repeat r.  A hash of the key deals the rows
    into random blocks, the only shuffle of the vectors; in a block, each
    repeat puts the rows in an order of its own (``md5(key:r:perm)``) and a row's
    partner is the next one, the last row's the first.  A block returns
    confusion counts per repeat and feature, never a row.
    """
    terms = F.zip_with(F.col(z), _lit_array(beta), lambda a, w: a * w)
    base = df.select(F.col(key).cast("string").alias("_key"), F.col(key).alias("_tie"), F.col(label).cast("int").alias("_y"),
                     terms.alias("_c"), margin(z, beta, intercept).alias("_m"))
    n = df.agg(F.greatest(F.floor(F.count(F.lit(1)) / BLOCK), F.lit(1)).alias("_blocks"))
    dealt = _with_stats(base, n).withColumn("_block", F.pmod(hex_prefix_number(order_hash("_key", F.lit("block")), 8), F.col("_blocks")))

    def count(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_tie")
        keys, y, m = rows.column("_key").to_pylist(), rows.column("_y").to_numpy(), rows.column("_m").to_numpy()
        c = rows.column("_c").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
        found = []

        def add(r: int, preds: np.ndarray) -> None:
            for j, p in enumerate(preds.T):
                found.append((r, j, *[int(((y == t) & (p == v)).sum()) for t, v in ((0, 0), (0, 1), (1, 0), (1, 1))]))
        add(-1, (m > 0)[:, None])
        for r in range(repeats):
            order = np.argsort([hashlib.md5(f"{k}:{r}:perm".encode()).hexdigest() for k in keys], kind="stable")
            partner = np.empty(len(keys), int)
            partner[order] = np.roll(order, -1)
            add(r, m[:, None] - c + c[partner] > 0)
        return pa.table(dict(zip(("_r", "feature_idx", "tn", "fp", "fn", "tp"), zip(*found))))

    counts = dealt.groupBy("_block").applyInArrow(lambda rows: count(rows).cast(pa.schema(
        [("_r", pa.int32()), ("feature_idx", pa.int32()), *[(x, pa.int64()) for x in ("tn", "fp", "fn", "tp")]])),
        "_r int, feature_idx int, tn bigint, fp bigint, fn bigint, tp bigint")
    f1 = counts.groupBy("_r", "feature_idx").agg(*[F.sum(x).alias(x) for x in ("tn", "fp", "fn", "tp")]).select(
        "_r", "feature_idx", metrics.f1_columns()[2].alias("f1"))
    # repeats x features rows; the one of repeat -1 is the model as it is
    base_f1 = F.max(F.when(F.col("_r") == -1, F.col("f1"))).over(Window.partitionBy(F.lit(0)))
    d = f1.select("*", base_f1.alias("_b")).filter("_r >= 0").withColumn("drop", F.col("_b") - F.col("f1"))
    imp = d.groupBy("feature_idx").agg(F.avg("drop").alias("score"), F.stddev_pop("drop").alias("std"))
    return rank_features(imp.select("feature_idx", "score", "std"))


# ---------------------------------------------------------------- P11, P12

def drop_features(df: DataFrame, drop: Sequence[int], features: str = "features") -> DataFrame:
    """Remove the listed feature positions."""
    d = F.array(*[F.lit(int(i)) for i in drop]) if drop else F.array().cast("array<int>")
    return df.withColumn(features, F.filter(F.col(features), lambda x, i: ~F.array_contains(d, i)))


def mute_features(train: DataFrame, test: DataFrame, mute: Sequence[int],
                  features: str = "features") -> tuple[DataFrame, DataFrame]:
    """Replace the listed features by their training mean in both sets."""
    stats = feature_stats(train, features).select("mu")
    d = F.array(*[F.lit(int(i)) for i in mute]) if mute else F.array().cast("array<int>")

    def apply(df: DataFrame) -> DataFrame:
        j = _with_stats(df, stats)
        v = F.transform(F.col(features), lambda x, i: F.when(F.array_contains(d, i), F.col("mu")[i])
                        .otherwise(x.cast("double")))
        return j.withColumn(features, v).drop("mu")
    return apply(train), apply(test)


# ---------------------------------------------------------------- M17, W3, J7

def iterative_mute(df: DataFrame, ranking: DataFrame, weights: DataFrame | Weights, intercept: float = 0.0,
                   key: str = "row_id", z: str = "z", keys: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Per row and step i = 0..d-2 the margin with the top-i ranked features muted.

    ``ranking`` has one order of the features, or one per key of ``by`` (folds);
    so has ``weights`` if it is a table (by..., beta, intercept).  Output rows
    (keys..., row_id, step, margin, preds) for every input row.  A row's
    contributions are put in rank order and summed inside the row, then
    exploded: nothing is shuffled.
    """
    keys, by = list(keys), list(by)
    row_keys = [*keys, key, *[c for c in df.columns if c not in (*keys, key, z)]]
    ranks = ranking.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(  # d ranks per key
        F.col("feature_idx").cast("int").alias("i"), "rank"))), lambda e: e["rank"]).alias("_ranks"))
    j = _with_stats(df, ranks, by)
    if isinstance(weights, DataFrame):
        j = _with_stats(j, weights.select(*by, F.col("beta").alias("_beta"), F.col("intercept").alias("_intercept")), by)
        beta, offset = F.col("_beta"), F.col("_intercept")
    else:
        beta, offset = _lit_array(weights), F.lit(float(intercept))
    last = F.greatest(F.size(z) - 2, F.lit(0))
    terms = F.zip_with(F.col(z), beta, lambda a, b: a * b)
    ordered = F.array_sort(F.zip_with(F.col("_ranks"), terms, lambda r, c: F.struct(r.alias("r"), c.alias("c"))))
    start = F.struct(F.expr("cast(array() as array<double>)").alias("run"), F.lit(0.0).alias("sum"))

    def add(acc: Column, e: Column) -> Column:
        return F.struct(F.concat(acc["run"], F.array(acc["sum"] + e["c"])).alias("run"),
                        (acc["sum"] + e["c"]).alias("sum"))
    # step 0 is the full model, step i the rest behind rank i
    rest = F.aggregate(ordered, start, add, lambda acc: F.concat(
        F.array(acc["sum"]), F.transform(F.slice(acc["run"], F.lit(1), last), lambda x: acc["sum"] - x)))
    steps = j.withColumn("_offset", offset).select(*row_keys, "_offset", F.posexplode(rest).alias("step", "_rest"))
    m = F.col("_rest") + F.col("_offset")
    return steps.select(*row_keys, "step", m.alias("margin"), F.when(m > 0, 1).otherwise(0).alias("preds"))


# ---------------------------------------------------------------- M19, W5, W6, J9

SELECTION_LAMBDAS = (0.0, 0.25, 0.5, 0.75, 1.0)


def select_step(scores: DataFrame, keys: Sequence[str] = (), split: str = "split", step: str = "step",
                first_steps: int = 10) -> DataFrame:
    """Choose a step on validation steps 0..9 per criterion; report the test row of that step."""
    keys = list(keys)
    r = scores.select("*", *[metrics_ratio(m) for m in ("tpr", "fpr", "f1")])
    val = r.filter((F.col(split) == "val") & (F.col(step) < first_steps))
    crit = [F.struct(F.lit("mismatch_ratio").alias("criterion"), (-F.col("mismatch_ratio")).alias("value"))]
    crit += [F.struct(F.lit(f"{m}_r").alias("criterion"), F.col(f"{m}_r").alias("value")) for m in ("tpr", "fpr", "f1")]
    crit += [F.struct(F.lit(f"func_{lam}").alias("criterion"),
                      (F.lit(lam) * F.abs(F.col("tpr_r")) + F.lit(1 - lam) * F.col("f1")).alias("value"))
             for lam in SELECTION_LAMBDAS]
    long = val.select(*keys, step, F.explode(F.array(*crit)).alias("c")).select(*keys, step, "c.*")
    w = Window.partitionBy(*keys, "criterion").orderBy(F.col("value").desc_nulls_last(), F.col(step))
    best = long.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*keys, "criterion", step)
    test = r.filter(F.col(split) == "test").drop(split)
    return best.join(test, [*keys, step], "left")


def metrics_ratio(m: str) -> Column:
    a, b = F.col(f"{m}_f"), F.col(f"{m}_m")
    hi = F.greatest(a, b)
    return F.when(a.isNotNull() & b.isNotNull() & (hi != 0), F.round(F.least(a, b) / hi, 3)).alias(f"{m}_r")


# ---------------------------------------------------------------- M21

def token_attribution(docs: DataFrame, word_vectors: DataFrame, beta: Weights, key: str = "row_id",
                      text: str = "text", top: int = 50) -> DataFrame:
    """M21 (re-aimed): each token's share of a mean-pooled linear margin, top 50 per text.

    contribution(t) = count(t) * (beta . v(t)) / (in-vocabulary tokens of the text).
    Texts are dealt to blocks as in pooling, all of a text to one block, so words
    are counted where the text lies and only a block's distinct words are joined.
    A block keeps what may be among the top, Spark rounds and ranks it.
    """
    from .embeddings import block_counts, string_pieces, text_bytes, with_block_words
    wv = word_vectors.select("word", F.aggregate(F.zip_with("vector", _lit_array(beta), lambda a, b: a * b),
                                                 F.lit(0.0), lambda acc, x: acc + x).alias("_bv"))
    blocks, tasks = block_counts(docs.sparkSession, text_bytes(docs, text))
    pieces = string_pieces(docs, key, F.lower(T.clean(text)), blocks, spread=False)
    out = StructType([StructField("_key", docs.schema[key].dataType), StructField("_words", ArrayType(StringType())),
                      StructField("_shares", ArrayType(DoubleType()))])

    def shares(left: pa.Table, right: pa.Table) -> pa.Table:
        listed, value = right.column("word").combine_chunks(), right.column("_bv").combine_chunks()
        names = listed.unique()
        of = pc.index_in(listed, value_set=names).to_numpy()
        value, many = value.take(pa.array(np.argsort(of, kind="stable"))), np.bincount(of, minlength=len(names))
        start = np.cumsum(many) - many  # a word listed twice has a row for each of its vectors
        keys = left.column("_key").combine_chunks()
        ids = keys.unique()
        text_of = pc.index_in(keys, value_set=ids).to_numpy()
        found, first = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for batch in left.to_batches(max_chunksize=1000) if len(names) else []:
            tokens = pc.split_pattern(batch.column("_text"), " ")
            at = pc.fill_null(pc.index_in(tokens.flatten(), value_set=names), -1).to_numpy()
            sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
            pair = np.repeat(text_of[first:first + len(batch)].astype(np.int64), sizes) * len(names) + at
            found.append(np.unique(pair[at >= 0], return_counts=True))
            first += len(batch)
        pair, back = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
        n = np.bincount(back, np.concatenate([c for _, c in found]), len(pair)).astype(np.int64)
        row, word = np.divmod(pair, max(len(names), 1))
        times = many[word]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, word, n, entry = np.repeat(row, times), np.repeat(word, times), np.repeat(n, times), np.repeat(start[word], times) + nth
        share_of = value.take(pa.array(entry))
        none = share_of.is_null().to_numpy(zero_copy_only=False)
        with np.errstate(all="ignore"):
            share = n * share_of.fill_null(0.0).to_numpy() / np.bincount(row, n, len(ids))[row]
        size = np.where(none, -1.0, np.where(np.isnan(share), np.inf, np.abs(share)))  # NaN is first, null last
        order = np.lexsort((-size, row))
        row, size = row[order], size[order]
        begin = np.searchsorted(row, np.arange(len(ids)))
        end = np.append(begin[1:], len(row))
        # rounding to nine decimals moves a share by half of the last, so what is this close to the last of the top may be in it
        least = size[np.minimum(begin + top, end)[row] - 1]
        keep = size >= least - 2e-9 - 1e-14 * np.where(np.isfinite(least), np.abs(least), 0.0)
        order, row = order[keep], row[keep]
        some, count = np.unique(row, return_counts=True)
        ends = pa.array(np.append(0, np.cumsum(count)), pa.int32())
        return pa.table([ids.take(pa.array(some)), pa.ListArray.from_arrays(ends, names.take(pa.array(word[order]))),
                         pa.ListArray.from_arrays(ends, pa.array(share[order], mask=none[order]))], names=["_key", "_words", "_shares"])

    hits = with_block_words(pieces, tasks, wv, shares, out)
    c = F.col("_shares")

    def placed(word: Column, c: Column) -> Column:
        return F.struct(F.when(c.isNull(), 2).when(F.isnan(c), 0).otherwise(1).alias("kind"),
                        F.when(c.isNotNull() & ~F.isnan(c), -F.round(F.abs(c), 9)).alias("size"),
                        word.alias("word"), c.alias("contribution"))
    ranked = F.slice(F.sort_array(F.zip_with("_words", c, placed)), 1, top)
    return hits.select(F.col("_key").alias(key), F.posexplode(ranked).alias("_pos", "_e")).select(
        key, "_e.word", "_e.contribution", (F.col("_pos") + 1).alias("rank"))
