"""Hand-checked cases for the text functions (FIXTURES.md §3)."""

from pyspark.sql import functions as F

from equilibra.functions import text as T
from equilibra.operators import counterfactual as CF


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols.keys()))
    return df.select(expr.alias("x")).first()["x"]


def test_swap_female(spark):
    assert one(spark, T.swap("t", "g"), t="She told her mother. Sex:   F 98 F", g="F") == \
        "he told his mother. Sex: M 98 M"


def test_swap_male(spark):
    assert one(spark, T.swap("t", "g"), t="He said his wife saw him", g="M") == "she said her wife saw her"


def test_neutralize(spark):
    assert one(spark, T.neutralize("t"), t="She and his male nurse") == "patient and its  nurse"


def test_swap_keeps_longer_words(spark):
    s = "herself, theme, shepherd"
    assert one(spark, T.swap("t", "g"), t=s, g="F") == s
    assert one(spark, T.swap("t", "g"), t=s, g="M") == s


def test_swap_unicode_boundary(spark):
    # a letter with an accent is part of the word: no boundary inside "éhe"
    assert one(spark, T.swap("t", "g"), t="éhe he", g="M") == "éhe she"


def test_clean_one_pass(spark):
    assert one(spark, T.clean("t"), t="BP: 120/80,   ok?") == "bp    ok "


def test_flip_and_codes(spark):
    assert one(spark, T.flip_gender("g"), g="F") == "M"
    assert one(spark, T.flip_gender("g"), g="X") == "F"
    assert one(spark, T.gender_code("g"), g="F") == 0
    assert one(spark, T.flip_code("g"), g=0) == 1


def test_mentions_and_phenotype(spark):
    assert one(spark, T.mentions("t"), t="History of DEPRESSION") is True
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(T.mentions("t")).first()[0] is False
    assert one(spark, T.phenotype_name("c"), c="DEPRESSION_majority") == "DEPRESSION"
    assert one(spark, T.phenotype_name("c"), c="ALCOHOL_x") == "ALCOHOL.ABUSE"
    assert one(spark, T.phenotype_name("c"), c="UNKNOWN") is None


def test_lexicon_rewrite_first_listed_wins(spark):
    back = T.lexicon_pairs("male_to_female")
    assert one(spark, T.lexicon_rewrite("t", back), t="Hij zag hem") == "zij zag haar"
    assert one(spark, T.lexicon_rewrite("t", T.lexicon_pairs("neutral")), t="ze en hij") == "diegene en diegene"


def test_context_sentence(spark):
    assert one(spark, T.context_sentence("t", "c"), t="apathy",
               c="[depression] is a synonym of depression.") == "apathy is a synonym of depression."


def test_chunks_match_array_split(spark):
    import numpy as np
    text = " ".join(f"w{i}" for i in range(40)) + "\n\nshort para\nline"
    df = spark.createDataFrame([(1, text)], "row_id long, text string")
    rows = CF.chunk_notes(df).orderBy("para", "chunk").collect()
    expected = []
    for p, para in enumerate(text.split("\n\n")):
        words = para.replace("\n", " ").split(" ")
        n = int(round(len(words) / 512, 0)) + 15
        for c, piece in enumerate(np.array_split(words, n)):
            expected.append((p, c, len(piece), " ".join(piece)))
    assert [(r.para, r.chunk, r.n_words, r.chunk_text) for r in rows] == expected


def test_variants_generator(spark):
    df = spark.createDataFrame([(1, "F", "She is here", 1)], "row_id long, gender string, text string, label int")
    rows = {r.variant: r for r in CF.counterfactual_variants(df).collect()}
    assert rows["swapped"].gender == "M" and rows["swapped"].text == "he is here"
    assert rows["neutr"].gender == "F" and rows["neutr"].text == "patient is here"
    flip = {r.variant: r for r in CF.counterfactual_variants(df, flip_neutral=True).collect()}
    assert flip["neutr"].gender == "M"


def test_salted_lexicon_join_equals_plain_join(spark):
    from equilibra.operators import embeddings as E
    rows = [(i, "the" if i % 3 else f"w{i % 7}", 1 + i % 2) for i in range(200)]
    counts = spark.createDataFrame(rows, "row_id long, word string, _n long")
    lex = spark.createDataFrame([("the", [1.0]), ("w1", [2.0]), ("w2", [3.0])], "word string, vector array<double>")
    hot = spark.createDataFrame([("the",), ("nope",)], "word string")
    salted = E.skew_safe_lexicon_join(counts, lex, hot, salts=5)
    plain = counts.join(lex, "word")
    key = lambda r: (r.row_id, r.word, r._n, tuple(r.vector))
    assert sorted(map(key, salted.collect())) == sorted(map(key, plain.collect()))


def test_passes_rewrite_as_the_single_rules_do(spark):
    import random
    r = random.Random(7)
    parts = ["her", "HIS", "him", "she", "He", "woman", "man", "female", "Male", "F", "m", "Sex:", "sex:", "h\u0131m", "\u017fhe",
             "x", "\u00e9", " ", " ", "  ", "\n", "-", ".", "_", "\u0301", "\u00a0"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(4000)] + ["Sex: female M he", "Sex:  F M", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for rules, passes in ((T.SWAP_MALE_RULES, T.SWAP_MALE_PASSES), (T.NEUTRALIZE_RULES, T.NEUTRALIZE_PASSES)):
        assert len(passes) < len(rules)
        assert df.filter(~T.apply_rules("t", rules).eqNullSafe(T.apply_rules("t", passes))).limit(5).collect() == []
