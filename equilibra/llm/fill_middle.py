"""Fill-in-middle transformation by repeated-capture matching.

A text is a sequence of units (a run of ASCII letters, or any other single code
point).  One fullmatch of ``(unit)*`` with the ``regex`` library keeps every
repetition of the group, so ``match.ends(1)`` is the list of all unit ends: its
length is the number of units n, and its entries at the two cuts are the code
points where prefix and middle end.  Only the text and two hashes go to Python
and three numbers come back; the rearranged text is put together in the JVM.

Cuts, and the share of texts that stay plain or put the suffix first, come
from a hash of the row's id, so reruns agree.

Form ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; form ``spm``:
``<S>`` suffix ``<P>`` prefix ``<M>`` middle; form ``plain``: the text as it is.
A text that holds one of the marks stays plain, so a mark in the output is
always the transformation's own and :func:`restored` is exact.

Defined results: a null text counts as empty; an empty text is plain with n =
0; a null id is hashed as the empty string; repeated rows get equal results; an
empty table stays empty; all other columns pass through, a taken output name
raises ValueError.  A text is matched whole, whatever its length: its task then
holds one number per unit.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from equilibra.llm.common import fresh

UNITS = r"([A-Za-z]+|[^A-Za-z])*+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90     # of 100: ids whose third hash lies from here on stay plain
SUFFIX_FIRST = 20   # of 100: share of the others that put the suffix first
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def unit_ends(text: str) -> list[int]:
    """The code-point end of every unit, in order."""
    return regex.compile(UNITS).fullmatch(text).ends(1)


def cuts(text: str | None, h1: int, h2: int) -> tuple[int, int, int]:
    """(n, end of the prefix, end of the middle)."""
    ends = unit_ends(text or "")
    n = len(ends)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, ends[first - 1] if first else 0, ends[second - 1] if second else 0


@F.arrow_udf(StructType([StructField(c, LongType()) for c in ("n", "first", "second")]))
def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    found = [cuts(t.as_py(), a.as_py(), b.as_py()) for t, a, b in zip(text, h1, h2)]
    cols = zip(*found) if found else ([], [], [])
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], ["n", "first", "second"])


def hashes(doc_id: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of ``seed:id``, as numbers."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def rearranged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """Add n, form, prefix_chars, middle_chars (null if plain) and output to every row."""
    clash = {c.lower() for c in df.columns} & set(ADDED)
    if clash:
        raise ValueError(f"columns already present: {sorted(clash)}")
    cut, text, hash_of = (fresh(df, c) for c in ("fim_cuts", "fim_text", "fim_hash"))
    d = df.withColumns({text: F.coalesce(F.col(text_col), F.lit("")), hash_of: F.array(*hashes(F.col(id_col), seed))})
    d = d.withColumn(cut, _cuts(F.col(text), F.col(hash_of)[0], F.col(hash_of)[1]))
    t, first, second = F.col(text), F.col(f"{cut}.first").cast("int"), F.col(f"{cut}.second").cast("int")
    marked = t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE)
    plain = (t == "") | marked | (F.col(hash_of)[2] % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(F.col(hash_of)[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    prefix, middle = F.substring(t, F.lit(1), first), F.substring(t, first + 1, second - first)
    suffix = F.substring(t, second + 1, F.char_length(t) - second)
    output = (F.when(F.col("form") == "plain", t)
              .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
              .otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)))
    kept = F.col("form") != "plain"
    return d.withColumn("form", form).select(
        *df.columns, F.col(f"{cut}.n").alias("n"), "form",
        F.when(kept, F.col(f"{cut}.first")).alias("prefix_chars"),
        F.when(kept, F.col(f"{cut}.second") - F.col(f"{cut}.first")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The exact text behind an output: the marks are its own, so each stands there once."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring_index(F.substr(head, F.lit(len(PREFIX) + 1)), SUFFIX, 1), middle,
                   F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle,
                   F.substring_index(F.substr(head, F.lit(len(SUFFIX) + 1)), PREFIX, 1))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
