"""Exact top-k by block-at-a-time pruning over integer inner products.

A vector's components are its terms, floor(scale * x) their weights.  Vectors
are dealt by id hash into chunks of about ``CHUNK``; inside a chunk they are
put in an order that keeps alike vectors together (median splits along the
widest component) and cut into ranges of ``BLOCK``: the blocks.  A block keeps
a forward index (its vectors' weights) and each term's largest and smallest
weight.  Per query the blocks' bounds are the sums of the term maxima times
the query's weights (minima for negative ones); blocks are taken in falling
order of bound and scored through their forward index until the bound falls
below the query's kth score.  A bound equal to the kth score is still scored,
so ties are exact.

Queries first meet one chunk, whose kth score is a lower bound of the final
one; with it they meet every chunk, in query groups of ``QUERIES``, each pair
of (query group, chunk) being one bounded task group.  A pair returns at most k
rows per query, which meet in a window per query.

Defined results: a vector that is null, empty or holds a null or non-finite
component takes no part; vectors of another length than the query's are no
candidates; rows that share an id count once, as their smallest vector; a row
without id takes no part; an empty table gives an empty result.  Weights and
products are exact integers as long as |score| < 2^53, and in 64 bits beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilibra.session import cut_lineage

CHUNK = 4096
BLOCK = 64
QUERIES = 1024
SCALE = 1024


def weights(vector: Column, scale: int = SCALE) -> Column:
    """Integer weights of a vector, null where the vector takes no part."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & fine, F.transform(v, lambda x: F.floor(x * scale)))


def _order(x: np.ndarray, block: int) -> list[np.ndarray]:
    """Ranges of at most ``block`` rows after median splits along the widest component."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= block:
            out.append(rows)
            continue
        wide = int(np.argmax(x[rows].max(axis=0) - x[rows].min(axis=0)))
        half = max(block, (len(rows) // 2 + block - 1) // block * block)
        part = rows[np.argsort(x[rows, wide], kind="stable")]
        todo += [part[half:], part[:half]] if half < len(rows) else [part[:len(rows) // 2], part[len(rows) // 2:]]
    return out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        near = score >= cut
        score, ids = score[near], ids[near]
    at = np.lexsort((ids, -score))[:k]
    return score[at], ids[at]


def search_chunk(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int,
                 block: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query position, scores, ids) of each query's best k in one chunk that reach its ``floor``."""
    big = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    kind = np.float64 if big < 2 ** 53 else np.int64
    q, x = q.astype(kind), x.astype(kind)
    blocks = _order(x, block)
    forward = [(x[b], ids[b]) for b in blocks]
    high = np.stack([f.max(axis=0) for f, _ in forward])
    low = np.stack([f.min(axis=0) for f, _ in forward])
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    for i in range(len(q)):
        got_s, got_i, kth = np.zeros(0, dtype=kind), np.zeros(0, dtype=np.int64), floor[i]
        for b in np.argsort(-bound[i], kind="stable"):
            if bound[i, b] < kth:
                break
            vectors, owners = forward[b]
            s = vectors @ q[i]
            keep = (s >= kth) & (owners != q_ids[i])
            if keep.any():
                got_s, got_i = _best(np.concatenate([got_s, s[keep]]), np.concatenate([got_i, owners[keep]]), k)
                if len(got_s) == k:
                    kth = max(kth, got_s[-1])
        if len(got_s):
            yield i, got_s, got_i


def _pairs(queries: DataFrame, vectors: DataFrame, groups: int, chunks: int, k: int) -> DataFrame:
    """Every query group against every chunk: (query_id, vec_id, score), at most k rows per query and chunk."""
    # both sides come from one table: new names keep their columns apart
    left = queries.select(F.col("id").alias("q_id"), F.col("w").alias("q_w"), "floor", F.col("_g").alias("q_g"),
                          F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("q_c"))
    right = vectors.select(F.col("id").alias("v_id"), F.col("w").alias("v_w"), F.col("_c").alias("v_c"),
                           F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("v_g"))

    def run(ql: pd.DataFrame, vl: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n in sorted(set(ql["q_w"].map(len)) & set(vl["v_w"].map(len))) if len(ql) and len(vl) else []:
            a, b = ql[ql["q_w"].map(len) == n], vl[vl["v_w"].map(len) == n]
            qi, vi = a["q_id"].to_numpy(np.int64), b["v_id"].to_numpy(np.int64)
            q, x = np.stack(a["q_w"].to_list()).astype(np.int64), np.stack(b["v_w"].to_list()).astype(np.int64)
            for i, s, ids in search_chunk(qi, q, a["floor"].fillna(-np.inf).to_numpy(np.float64), vi, x, k):
                out.append(pd.DataFrame({"query_id": qi[i], "vec_id": ids, "score": s.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    return left.groupBy("q_g", "q_c").cogroup(right.groupBy("v_g", "v_c")).applyInPandas(
        run, "query_id bigint, vec_id bigint, score bigint")


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
          scale: int = SCALE, chunk: int = CHUNK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best other rows."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), weights(F.col(vector_col), scale).alias("w"),
                     is_query.alias("q")).where(F.col("w").isNotNull() & F.col("id").isNotNull())
    rows = cut_lineage(rows.groupBy("id").agg(F.min("w").alias("w"), F.max("q").alias("q")))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    chunks, groups = max(1, -(-n.n // chunk)), max(1, -(-n.q // queries))
    deal = lambda many, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(many)).cast("int")
    vectors = rows.select("id", "w", deal(chunks, 1).alias("_c"))
    asked = rows.where("q").select("id", "w", deal(groups, 2).alias("_g"))
    start = asked.withColumn("floor", F.lit(None).cast("double"))
    if chunks > 1:
        first = _pairs(start, vectors.where(F.col("_c") == 0), groups, 1, k)
        kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("floor"))
        kth = kth.where(F.col("n") == k).select(F.col("query_id").alias("id"), "floor")
        start = asked.join(kth, "id", "left").select("id", "w", "_g", "floor")
    found = _pairs(start, vectors, groups, chunks, k)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
