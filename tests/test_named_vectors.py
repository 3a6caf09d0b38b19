"""Token vectors by name: a vector is fetched once per phrase and name, never once per token (round 4, F1)."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from equilibra.operators import counterfactual as CF
from equilibra.operators import embeddings as E
from equilibra.operators import phrases as PH
from equilibra.plans import phrase_queries
from equilibra.plans.registry import load_all

from .conftest import SF_SMALL

LEXICON = {"aa": [[1.0, 0.0]], "bb": [[0.0, 2.0], [0.0, 5.0]], "w1": [[4.0, 4.0]], "w2": [[-1.0, 3.0]] * 2}  # some words come twice


def _chunks(spark, many):
    rows = [(k, 0, c, t, len(t.split(" "))) for k in range(many) for c in range(2) for t in [f"aa w{(k + c) % 4} zz Bb w{c % 3} aa bb"]]
    # a place that comes twice, with another text: the shorter one's closing token lies among the longer one's words
    rows += rows[:4] + [(0, 0, 0, "zz aa", 2), (1, 0, 0, " Aa  bb", 4), (many, 0, 0, "", 0), (many, 0, 1, None, None), (None, 0, 0, "aa bb", 2)]
    return spark.createDataFrame(rows, "row_id long, para int, chunk int, chunk_text string, n_words int")


def _tables(spark, chunks):
    words = spark.createDataFrame([(w, x) for w, vs in LEXICON.items() for x in vs] + [("aa bb", [9.0, 9.0])], "word string, vector array<float>")
    ends = F.array(F.lit(7.0), F.lit(-7.0))
    return [E.chunk_token_vectors(chunks, words, ends, ends, **kw) for kw in ({}, {"named": True})]


def _terms(spark):
    listed = ("aa", "zz bb", "w1 zz", "AA bb", "zz", "bb w1 aa", "w2", "zz aa", " aa", "aa  bb", "w1 zz bb", "aa w1 zz bb w1", "bb zz")
    return spark.createDataFrame([("s", t) for t in listed] + [("t", "aa"), ("t", None), ("t", ""), (None, "zz bb")], "category string, term string")


def _close(got, want):
    assert got.keys() == want.keys() and got
    for k, (n, v) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(v, abs=1e-9)


def test_named_tokens_are_the_same_table(spark):
    notes = spark.createDataFrame([(1, "aa zz bb w2 "), (2, ""), (3, None), (4, "aa BB\n\nw1 " * 40), (5, "zz")], "row_id long, text string")
    plain, named = _tables(spark, CF.chunk_notes(notes))
    rows = [sorted((r.row_id, r.para, r.chunk, r.pos, *r.vector) for r in t.collect()) for t in (plain, named.rows())]
    assert rows[0] == rows[1] and len(rows[0]) > 1000
    assert plain.schema.simpleString() == named.rows().schema.simpleString()


@pytest.mark.parametrize("small", [PH.SMALL_TABLE, 0])
@pytest.mark.parametrize("single", [True, False])
def test_term_vectors_of_named_tokens(spark, monkeypatch, small, single):
    chunks, terms = _chunks(spark, 12), _terms(spark)
    plain, named = _tables(spark, chunks)
    vectors = lambda t: {(r.category, r.term): (r.n, r.vector) for r in PH.term_vectors(
        chunks, t, terms, first_token_if_single=single).collect()}
    want = vectors(plain)
    assert ("s", "zz aa") in want and ("s", "zz") in want  # "zz" only by a closing token or its chunk
    monkeypatch.setattr(PH, "SMALL_TABLE", small)
    monkeypatch.setattr(PH, "NAME_BLOCK_BYTES", 200)
    monkeypatch.setattr(PH, "SPANS_TOGETHER", 7)
    _close(vectors(named), want)


def test_occurrences_of_overlapping_and_of_no_phrases():
    texts = pa.record_batch([pa.array(["a b a b c", None, "", "b  c", "c", "x a b c"])], names=["_low"])
    numbers = {"a b": 3, "b a b": 5, "b": 0, "a b c": 7, "b c": 9, "b  c": 8, " c": 6, "c x": 4}
    tree = PH._word_tree(pa.chunked_array([list(numbers)]), pa.chunked_array([[str(n) for n in numbers.values()]]))
    at, (of, start, size) = PH._occurrences(texts, tree)
    got = {i: set(zip(*row)) for i, *row in zip(at, of.to_pylist(), start.to_pylist(), size.to_pylist())}
    want = {}
    for i, t in enumerate(texts.column(0).to_pylist()):
        words = [] if t is None else t.split(" ")
        hits = {(n, k, p.count(" ") + 1) for p, n in numbers.items() for k in range(len(words)) if words[k:k + p.count(" ") + 1] == p.split(" ")}
        want |= {i: hits} if hits else {}
    assert got == want and len(want) == 3
    none = pa.chunked_array([], pa.string())
    assert len(PH._occurrences(texts, PH._word_tree(none, none))[0]) == 0


def test_no_vector_moves_per_token(spark, monkeypatch):
    kept = []
    write = PH.cut_lineage
    monkeypatch.setattr(PH, "cut_lineage", lambda df: kept.append(write(df)) or kept[-1])
    counts = []
    for many in (12, 48):
        chunks = _chunks(spark, many)
        kept.clear()
        assert PH.term_vectors(chunks, _tables(spark, chunks)[1], _terms(spark)).count() > 5
        weights = next(t for t in kept if "_weight" in t.columns)
        assert not any("array" in kind for _, kind in weights.dtypes)
        counts.append(weights.count())
    assert counts[0] == counts[1]  # a row per phrase, and per phrase and name, however many texts


def test_the_query_takes_named_tokens_and_every_operator(spark, monkeypatch):
    seen = []
    make, mean = E.chunk_token_vectors, PH.term_vectors
    monkeypatch.setattr(E, "chunk_token_vectors", lambda *a, **k: seen.append("tokens") or make(*a, **k))
    monkeypatch.setattr(PH, "term_vectors", lambda c, t, *a, **k: seen.append(type(t).__name__) or mean(c, t, *a, **k))
    assert load_all()["term_vectors"].build(spark, SF_SMALL).count() > 0
    assert seen == ["tokens", "NamedVectors"]


def test_openings_split_no_more_than_they_take(spark, tmp_path):
    texts = ["a b c d", "a", "", " a b", "a  b", "A b\nc d", None, "x y "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id, *r.words) for r in phrase_queries.openings(spark, str(tmp_path), 3, "doc_id").collect() if r.words is not None))
    assert got == sorted((i, *t.split(" ")[:k]) for i, t in enumerate(texts) if t is not None for k in (1, 2, 3))
    assert "substring_index" in phrase_queries.openings(spark, str(tmp_path), 3)._jdf.queryExecution().optimizedPlan().toString()
