"""Order MinHash document fingerprints, with Spark's built-in functions only.

A text's k-mers are runs of ``K`` words; repeats of a k-mer are numbered in
text order, so a k-mer with its number is unique in its text.  Every numbered
k-mer has one hash, whose leading bits name one of ``BINS`` hash functions
and whose rest is its value there.  Per function the ``TAKE`` smallest k-mers
are kept, put back in text order and hashed as a tuple.  Two texts share an
entry if they share the smallest k-mers and have them in the same order, so
the share of equal entries falls with edit distance: moving text lowers it
where a plain MinHash would not notice.

Everything is array work inside a row (sorts of packed 64-bit values: hash
bits above, position below), so a fingerprint needs no shuffle and its memory
is the text's own.

Defined results: a null text counts as empty; a text without words has no
entry, and likeness of two such texts is 1, of one such text to another 0;
fewer than K words make one k-mer; texts of over 2^23 words keep the order of
their positions in 2^23 steps; repeated rows fingerprint alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilibra.llm.common import fresh

K = 2
TAKE = 2
BIN_BITS = 6
POS_BITS = 23
ENTRY_BITS = 26
MOST_BUCKETS = 4096
SPACES = r"[\x20\x09-\x0D]+"

_POS = (1 << POS_BITS) - 1


def _key(x: Column) -> Column:
    return F.shiftright(x, POS_BITS)


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def _pack(h: Column, pos: Column) -> Column:
    return h.bitwiseAND(F.lit(~_POS).cast("bigint")).bitwiseOR(pos.cast("bigint"))


def _number(key: Column, occurrence: Column, packed: Column) -> Column:
    """A numbered k-mer's hash with the position of ``packed``."""
    return _pack(F.xxhash64(key, occurrence.cast("bigint")), packed.bitwiseAND(F.lit(_POS).cast("bigint")))


def signature(df: DataFrame, text: Column, out: str, k: int = K, take: int = TAKE) -> DataFrame:
    """Append ``out``: the fingerprint's entries (bin and tuple hash in 32 bits), an array in bin order."""
    w, s, first, start, end, e, sel, at = (fresh(df, f"{out}_{n}") for n in ("w", "s", "f", "a", "z", "e", "c", "i"))
    none = F.array().cast("array<bigint>")
    ints = F.array().cast("array<int>")
    words, size = F.col(w), F.size(w)
    df = df.withColumn(w, F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda x: x != ""))

    def kmer(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + j) for j in range(k)])

    def place(i: Column) -> Column:
        return F.when(size <= _POS, i).otherwise(F.floor(i.cast("double") * F.lit(float(_POS)) / size).cast("int"))

    df = df.withColumn(s, F.when(size >= k, F.sort_array(F.transform(
        F.sequence(F.lit(0), size - k), lambda i: _pack(kmer(i), place(i)))))
        .when(size > 0, F.array(_pack(F.xxhash64(words), F.lit(0)))).otherwise(none))
    x = F.col(s)
    same_before = lambda j: (j > 0) & (_key(F.get(x, j)) == _key(F.get(x, j - 1)))
    same_after = lambda j: (j + 1 < F.size(x)) & (_key(F.get(x, j)) == _key(F.get(x, j + 1)))
    df = df.withColumn(first, F.filter(x, lambda v, j: (j == 0) | (_key(v) != _key(F.get(x, j - 1)))))
    repeats = F.size(first) < F.size(x)
    every = F.sequence(F.lit(0), F.size(x) - 1)
    df = df.withColumn(start, F.when(repeats, F.filter(every, lambda j: ~same_before(j) & same_after(j))).otherwise(ints))
    df = df.withColumn(end, F.when(repeats, F.filter(every, lambda j: same_before(j) & ~same_after(j))).otherwise(ints))
    again = F.when(repeats, F.flatten(F.zip_with(start, end, lambda a, z: F.transform(
        F.sequence(a + 1, z), lambda j: _number(_key(F.get(x, j)), j - a, F.get(x, j)))))).otherwise(none)
    df = df.withColumn(e, F.sort_array(F.concat(F.transform(first, lambda v: _number(_key(v), F.lit(0), v)), again)))
    y = F.col(e)
    df = df.withColumn(sel, F.filter(y, lambda v, j: (j < take) | (_bin(v) != _bin(F.get(y, j - take)))))
    c = F.col(sel)
    df = df.withColumn(at, F.when(F.size(c) > 0, F.filter(
        F.sequence(F.lit(0), F.size(c) - 1), lambda j: (j == 0) | (_bin(F.get(c, j)) != _bin(F.get(c, j - 1))))).otherwise(ints))

    def entry(j: Column, n: Column) -> Column:
        last = F.coalesce(F.get(F.col(at), n + 1), F.size(c))
        in_order = F.sort_array(F.transform(F.slice(c, j + 1, last - j), lambda v: F.struct(
            v.bitwiseAND(F.lit(_POS).cast("bigint")).alias("p"), _key(v).alias("g"))))
        tuple_hash = F.xxhash64(F.transform(in_order, lambda v: v["g"]))
        return F.shiftleft(_bin(F.get(c, j)), ENTRY_BITS).bitwiseOR(tuple_hash.bitwiseAND(F.lit((1 << ENTRY_BITS) - 1).cast("bigint")))

    return df.withColumn(out, F.transform(F.col(at), entry)).drop(w, s, first, start, end, e, sel, at)


def as_hex(entries: Column) -> Column:
    """A fingerprint as a string: 8 hex digits per entry."""
    return F.array_join(F.transform(entries, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal entries among the functions for which either text has one; 1 for two texts without entry."""
    bins = lambda x: F.transform(x, lambda v: F.shiftright(v, ENTRY_BITS))
    of = F.size(F.array_union(bins(a), bins(b)))
    return F.when(of == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / of)


def with_next(df: DataFrame, id_col: str, carried: list[str], ties: Column,
              prepare: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Append ``next_<c>`` of the following row in ascending ``id_col`` (nulls first, ties by ``ties``, the
    last row followed by the first) for each carried column, with one shuffle.

    Rows are dealt by ranges of the id whose cut points are approximate quantiles (at most 4096 numbers on
    the driver); each range also gets a copy of the first row of the next one, so no row needs another range.
    ``prepare`` adds columns to the rows before they are dealt.
    """
    spark = df.sparkSession
    parts = min(MOST_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / parts for i in range(1, parts)]
    cuts = df.agg(F.percentile_approx(id_col, F.array(*[F.lit(p) for p in probs]), 100 * parts)).first()[0] or []
    edges = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    num, tie, rng, copy = (fresh(df, n) for n in ("num", "tie", "range", "copy"))
    rows = df.withColumn(num, F.coalesce(F.col(id_col).cast("double"), F.lit(-1e300))).withColumn(tie, ties)
    if len(edges) > 2:
        rows = Bucketizer(splits=edges, inputCol=num, outputCol=rng).transform(rows)
    else:
        rows = rows.withColumn(rng, F.lit(0.0))
    key = F.struct(F.col(id_col).isNotNull().alias("some"), F.col(id_col).alias("id"), F.col(tie).alias("tie"))
    firsts = rows.groupBy(rng).agg(F.min(key).alias("f")).orderBy(rng).collect()  # a row per range
    # each range must see the first row of the next range as well, the last range that of the first
    heads = spark.createDataFrame([(float(firsts[i - 1][rng]), r.f.id, r.f.tie) for i, r in enumerate(firsts)],
                                  "_to double, _id bigint, _first bigint")
    copies = (rows.join(F.broadcast(heads), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(tie) == F.col("_first")))
              .dropDuplicates(["_to"]).withColumn(rng, F.col("_to")).select(*rows.columns).withColumn(copy, F.lit(1)))
    both = prepare(rows.withColumn(copy, F.lit(0)).unionByName(copies))
    w = Window.partitionBy(rng).orderBy(F.col(copy), F.col(id_col).asc_nulls_first(), F.col(tie))
    for c in carried:
        both = both.withColumn(f"next_{c}", F.lead(c).over(w))
    return both.where(F.col(copy) == 0).drop(num, tie, rng, copy)


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, edited, entries, edited_entries, next_entries): every whole text and its edited text,
    whose last half of the code points is replaced by the first as many of the next document's."""
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", ["text", "entries"], F.xxhash64("text"),
                     lambda d: signature(d, F.col("text"), "entries"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half),
                                              F.substring(F.col("next_text"), F.lit(1), half)))
    return signature(rows.drop("next_text"), F.col("edited"), "edited_entries")
