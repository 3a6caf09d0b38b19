"""Counterfactual note variants and chunking.

Variants are produced by a generator (``explode`` of their names), so one scan
of the notes yields all variants; no union of three scans, no join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def counterfactual_variants(notes: DataFrame, flip_neutral: bool = False, text: str = "text",
                            gender: str = "gender", variants: Sequence[str] = ("orig", "swapped", "neutr"),
                            female: str = "F", male: str = "M") -> DataFrame:
    """One row per (note, variant).

    ``swapped``: T2 text, gender flipped.  ``neutr``: T3 text, gender kept (U1)
    or flipped (U2, ``flip_neutral=True``).
    """
    # names are made into rows first, texts behind them: who takes no text rewrites none
    rest, v = [c for c in notes.columns if c not in (text, gender)], F.col("variant")
    out = notes.select(*rest, F.col(gender).alias("_gender"), F.col(text).alias("_text"),
                       F.explode(F.array(*[F.lit(x) for x in variants])).alias("variant"))
    g, t = F.col("_gender"), F.col("_text")
    flipped = T.flip_gender(g, female, male)
    other = (v == "swapped") | ((v == "neutr") & F.lit(flip_neutral))
    return out.select(*rest, "variant", F.when(other, flipped).otherwise(g).alias(gender),
                      F.when(v == "orig", t).when(v == "swapped", T.swap(t, g, female)).otherwise(T.neutralize(t)).alias(text))


def chunk_words(text: Column | str, words_per_chunk: int = 512, min_chunks: int = 15) -> Column:
    """Array of (para, chunk, n_words, chunk_text) structs for one text.

    Paragraphs split on blank lines, newlines become spaces, words split on
    single spaces; a paragraph of L words gets n = round_half_even(L / 512) + 15
    near-equal chunks, the first L mod n of them one word longer (short
    paragraphs yield empty chunks).
    """
    t = F.col(text) if isinstance(text, str) else text
    paras = F.split(t, "\n\n")

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        # an expression inside a lambda is worked out wherever it is named; a lambda's argument only once
        return F.transform(F.array(value), use)[0]

    def cut(words: Column, i: Column) -> Column:
        n_words = F.size(words)
        n = (F.bround(n_words / F.lit(float(words_per_chunk)), 0).cast("int") + F.lit(min_chunks))
        q = F.floor(n_words / n).cast("int")
        r = (n_words % n).cast("int")

        def chunk(c: Column) -> Column:
            start = c * q + F.least(c, r)
            length = q + F.when(c < r, 1).otherwise(0)
            return F.struct(i.alias("para"), c.alias("chunk"), length.alias("n_words"),
                            F.array_join(F.slice(words, start + 1, length), " ").alias("chunk_text"))
        return F.transform(F.sequence(F.lit(0), n - 1), chunk)

    def per_para(p: Column, i: Column) -> Column:
        return once(F.split(F.regexp_replace(p, "\n", " "), " "), lambda words: cut(words, i))

    return F.flatten(F.transform(paras, per_para))


def chunk_notes(notes: DataFrame, key: str = "row_id", text: str = "text", **kw) -> DataFrame:
    """T6 as rows: (key, para, chunk, n_words, chunk_text)."""
    return notes.select(key, F.explode(chunk_words(text, **kw)).alias("_c")).select(key, "_c.*")
