"""Plans and results that the third review asked for."""

from pyspark.sql import functions as F

from equilibra.operators import counterfactual as CF
from equilibra.operators import embeddings as E
from equilibra.operators import phrases as PH

from .conftest import SF_SMALL


def _chunks(text):
    out = []
    for i, para in enumerate(text.split("\n\n")):
        words = para.replace("\n", " ").split(" ")
        n = round(len(words) / 512) + 15
        q, r = divmod(len(words), n)
        for c in range(n):
            at = c * q + min(c, r)
            piece = words[at:at + q + (c < r)]
            out.append((i, c, len(piece), " ".join(piece)))
    return out


def test_chunks_split_a_paragraph_once(spark):
    texts = ["a b c", "", "one\ntwo  three\n\n" + " ".join(f"w{i}" for i in range(1300)), " ".join(f"v{i}" for i in range(256 + 512))]
    notes = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "row_id long, text string")
    chunks = CF.chunk_notes(notes)
    got = sorted((r.row_id, r.para, r.chunk, r.n_words, r.chunk_text) for r in chunks.collect())
    assert got == sorted((k, *c) for k, t in enumerate(texts) for c in _chunks(t))
    assert chunks.schema["n_words"].dataType.simpleString() == "int"
    # the split stands under one lambda only, not under one for every chunk
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def _token_inputs(spark, many=40):
    texts = [(i, f"aa w{i % 7} zz  BB w{i % 3} aa") for i in range(many)] + [(many, ""), (many + 1, "zz"), (many + 2, "aa " * 3000)]
    notes = spark.createDataFrame(texts + [(many + 3, None)], "row_id long, text string")
    lexicon = {"aa": [[1.0, 0.0]], "bb": [[0.0, 2.0], [0.0, 5.0]], "w1": [[4.0, 4.0]], "w2": [[-1.0, 3.0]] * 2}  # some words come twice
    words = spark.createDataFrame([(w, x) for w, many in lexicon.items() for x in many], "word string, vector array<float>")
    ends = F.array(F.lit(9.0), F.lit(9.0))
    return notes, lexicon, E.chunk_token_vectors(CF.chunk_notes(notes), words, ends, ends)


def test_token_vectors_by_block(spark):
    notes, lexicon, tokens = _token_inputs(spark)
    got = sorted((r.row_id, r.para, r.chunk, r.pos, tuple(r.vector)) for r in tokens.collect())
    want = []
    for key, text in notes.collect():
        for para, chunk, n, piece in _chunks(text) if text is not None else []:
            want += [(key, para, chunk, 0, (9.0, 9.0)), (key, para, chunk, n + 1, (9.0, 9.0))]
            want += [(key, para, chunk, i + 1, tuple(x)) for i, w in enumerate(piece.split(" ")) for x in lexicon.get(w.lower(), [])]
    assert got == sorted(want)
    assert tokens.schema["pos"].dataType.simpleString() == "int" and tokens.schema["vector"].dataType.simpleString() == "array<double>"
    plan = tokens._jdf.queryExecution().optimizedPlan().toString()
    # the lexicon meets the words of a block, no token row is joined
    assert "FlatMapCoGroupsInArrow" in plan and "posexplode" not in plan


def test_context_pool_sums_runs_before_the_shuffle(spark):
    _, _, tokens = _token_inputs(spark)
    pooled = E.context_pool(tokens)
    assert "MapInArrow" in pooled._jdf.queryExecution().optimizedPlan().toString()
    got = {r.row_id: (r.n, r.vector) for r in pooled.collect()}
    want = {r.row_id: (r.n, r.vector) for r in E.weighted_mean_vectors(tokens.filter("pos >= 1"), ["row_id"]).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == n and all(abs(a - b) < 1e-9 for a, b in zip(got[k][1], v)) for k, (n, v) in want.items())


def test_run_means_take_rows_in_any_order(spark):
    rows = [(k, [float(i), 1.0]) for i in range(30) for k in (None, 1, 2)]
    got = {r.k: (r.n, r.vector) for r in E.run_means(spark.createDataFrame(rows, "k long, vector array<double>"), "k").collect()}
    assert got == {k: (30, [14.5, 1.0]) for k in (None, 1, 2)}


def test_vocabulary_is_written_once(spark):
    from equilibra.sources import views
    plan = views.word_vectors(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan  # the words of the documents are not read again by every step of the numbering


def test_term_vectors_move_a_vector_once(spark):
    texts = [(k, 0, c, f"aa w{(k + c) % 4} zz Bb w{c % 3} aa bb") for k in range(30) for c in range(3)]
    texts += texts[:7]  # chunks that come twice: an occurrence counts once
    chunks = spark.createDataFrame(texts, "row_id long, para int, chunk int, chunk_text string")
    v = {"aa": [1.0, 0.0], "bb": [0.0, 2.0], "w1": [4.0, 4.0]}
    tokens = [(k, p, c, i + 1, v[w.lower()]) for k, p, c, t in texts for i, w in enumerate(t.split(" ")) if w.lower() in v]
    tv = spark.createDataFrame(tokens, "row_id long, para int, chunk int, pos int, vector array<double>")
    terms = spark.createDataFrame([("s", t) for t in ("aa", "zz bb", "w1 zz", "aa bb", "zz", "bb w1 aa")], "category string, term string")
    got = PH.term_vectors(chunks, tv, terms)
    want: dict[str, dict] = {}
    for k, p, c, t in texts:
        low = t.lower().split(" ")
        for term in ("aa", "zz bb", "w1 zz", "aa bb", "zz", "bb w1 aa"):
            n = len(term.split(" "))
            for i in range(len(low)):
                hits = [v[w] for w in low[i:i + n] if w in v]
                if " ".join(low[i:i + n]) == term and hits:
                    want.setdefault(term, {})[k, p, c, i] = [sum(x) / len(hits) for x in zip(*hits)]
    rows = {r.term: (r.n, r.vector) for r in got.collect()}
    assert rows.keys() == want.keys()
    for term, each in want.items():
        assert rows[term][0] == len(each)
        assert all(abs(a - sum(b) / len(each)) < 1e-9 for a, b in zip(rows[term][1], zip(*each.values())))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
