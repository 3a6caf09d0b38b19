"""Runs of words are hashed a few texts at a time."""

import numpy as np

from equilibra.operators import phrases as PH


def test_runs_are_hashed_a_few_texts_at_a_time(spark, monkeypatch):
    make = PH._run_hasher

    def watched():
        run = make()

        def counted(words, row, n):
            assert len(np.unique(row)) <= 5, "more texts at once than RUN_ROWS"
            return run(words, row, n)
        return counted
    monkeypatch.setattr(PH, "RUN_ROWS", 5, raising=False)
    monkeypatch.setattr(PH, "_with_hash", lambda phrases: hashed)
    docs = spark.createDataFrame([(i, f"Aa w{i} bb cc" if i % 9 else None) for i in range(83)], "row_id long, text string")
    lexicon = spark.createDataFrame([("aa", "<1>", 1), ("w7 bb", "<2>", 2), ("aa w8", "<3>", 3)], "from_term string, to_term string, line_no int")
    hashed = _hashed(PH.lexicon_table(lexicon))
    monkeypatch.setattr(PH, "_run_hasher", watched)
    got = {r.row_id: r.rewritten for r in PH.rewrite_phrases(docs, lexicon, small=0).collect()}
    want = {i: None if i % 9 == 0 else f"<1> w{i} bb cc" for i in range(83)} | {7: "<1> <2> cc", 8: "<3> bb cc"}
    assert got == want


_hashed = PH._with_hash


def test_a_block_holds_its_text_three_times_within_bounds():
    assert 3 * PH.BLOCK_BYTES <= 32 << 20
