import math
import random

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from equilibra.llm import topk

NAN = float("nan")


def brute(rows, k=10):
    byid = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(1024 * x) for x in v]
        byid[i] = min(byid.get(i, w), w)
    out = set()
    for q, qw in byid.items():
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(qw, w)), i) for i, w in byid.items() if i != q and len(w) == len(qw))
            out |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])}
    return out


def test_topk_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]                      # one very common vector: ties
    rows += [(2000, None), (2100, []), (2200, [1.0, None]), (2300, [NAN] * 8), (2400, [math.inf] * 8), (None, [1.0] * 8),
             (2500, [1.0, 2.0]), (2501, [1.0, 2.5]), (2501, [1.0, 2.5]), (200, rows[200][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1))
    for chunk, group in ((100, 3), (4096, 1024)):
        got = topk.top_k(df, F.col("vec_id") % 100 == 0, chunk=chunk, queries=group)
        assert {tuple(r) for r in got.collect()} == brute(rows)


def test_topk_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 100 == 0).count() == 0


def test_blocks_are_skipped():
    """Blocks whose bound falls below the kth score are not scored."""
    rnd = np.random.default_rng(0)
    x = np.concatenate([rnd.integers(0, 50, (64, 4)), rnd.integers(900, 1000, (64, 4))])
    order = topk._order(x, 64)
    assert sorted(len(b) for b in order) == [64, 64]
    found = list(topk.search_chunk(np.array([-1]), np.ones((1, 4), int), np.array([3000.0]), np.arange(128), x, 5))
    assert all(i >= 64 for i in found[0][2])


def test_pipeline_small(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen.append(out.count())
        docs = out.checkpoint()
    assert 0 < seen[2] <= seen[1] <= seen[0] <= 200
    assert docs.where(F.col("n_tokens") * 4 != F.octet_length("ids")).count() == 0


def test_pipeline_stages_with_odd_rows(spark, odd_docs, no_docs):
    d = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, d)
            assert docs.count() >= 0, name


def test_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
