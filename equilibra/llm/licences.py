"""License scans by canonical digests, with Spark's built-in functions only.

A text is brought to a canonical form: lower case, copyright lines dropped,
equivalent spellings made one, punctuation and white space made single
spaces.  The SHA-256 of that form is looked up, by a hash join, among the
digests of the known licence texts; these are canonicalised by the very same
expressions.  The whole text of a document is one lookup; its lines and its
runs of paragraphs, each an entire text again, are the other, so that a notice
or a licence inside other prose is found.  A paragraph is a run of lines with a
non-empty canonical form; a run starts where the first paragraph of a known
text does and has as many paragraphs.

The table of known texts is fixed (hundreds of rows), so it alone is broadcast;
documents are read once and never shuffled.

Defined results: a null text counts as empty; the digest of an empty canonical
form matches nothing; a text equal to several known ones gets the first name;
repeated rows match alike; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equilibra.llm.known_licences import TEXTS, WHOLE

# fixed values: spellings that count as equal (left is written as right); matched after lower-casing
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"), ("non commercial", "noncommercial"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("copyright (c)", "copyright"), ("copyright ©", "copyright"),
    ("©", "copyright"), ("(c)", "copyright"), ("https:", "http:"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("labour", "labor"), ("honour", "honor"), ("judgement", "judgment"),
    ("fulfil ", "fulfill "), ("whilst", "while"), ("wilful", "willful"), ("merchantibility", "merchantability"),
)
COPYRIGHT_LINE = r"(?m)^[\x20\x09*#/;%!-]*(?:copyright|\(c\)|©)(?:[\x20\x09]+(?:copyright|\(c\)|©|[0-9])|[\x20\x09]*$)[^\n]*$"
ALL_RIGHTS = r"(?m)^[\x20\x09*#/;%!-]*all rights reserved\.?[\x20\x09]*$"
OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, " "), ALL_RIGHTS, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, OTHER, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line; no rule of the canonical form looks past a line break."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical)


def paragraphs(lines: Column) -> Column:
    """Canonical paragraphs from canonical lines; joined by spaces they are the canonical form of the text."""
    marked = F.array_join(F.transform(lines, lambda c: F.when(c == "", "\n").otherwise(c)), " ")
    return F.filter(F.transform(F.split(marked, "\n"), lambda c: F.trim(c)), lambda c: c != "")


def _digest_of(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, " "), 256)


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...] = TEXTS,
          whole: tuple[tuple[str, str, int, str], ...] = WHOLE) -> DataFrame:
    """(digest, license, heads) of the known texts; heads are (digest of the first paragraph, paragraphs)."""
    rows = spark.createDataFrame(list(texts), "license string, body string")
    rows = rows.select("license", paragraphs(canonical_lines(F.col("body"))).alias("p")).where(F.size("p") > 0)
    rows = rows.select("license", F.sha2(F.element_at("p", 1), 256).alias("head"), F.size("p").alias("n"),
                       _digest_of(F.col("p")).alias("digest"))
    rows = rows.union(spark.createDataFrame(list(whole), "license string, head string, n int, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.collect_set(F.struct("head", "n")).alias("heads"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: tuple[tuple[str, str], ...] = TEXTS,
         whole: tuple[tuple[str, str, int, str], ...] = WHOLE) -> DataFrame:
    """(doc_id, digest, license, line_licenses) of every row: the licence that the whole text is, if any,
    and the sorted names of those that whole lines or runs of paragraphs of it are."""
    spark = df.sparkSession
    table = known(spark, texts, whole)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    rows = rows.select("doc_id", F.filter("lines", lambda c: c != "").alias("lines"), paragraphs(F.col("lines")).alias("parts"))
    rows = rows.select("doc_id", "lines", "parts", _digest_of(F.col("parts")).alias("digest"))
    names, heads = {}, {}
    for r in table.collect():  # fixed size
        names[r.digest] = r.license
        for h in r.heads:
            heads.setdefault(h.head, set()).add(h.n)
    lookup = F.create_map(*[F.lit(v) for kv in sorted(names.items()) for v in kv])
    sizes = F.create_map(*[c for h in sorted(heads) for c in (F.lit(h), F.array(*[F.lit(n) for n in sorted(heads[h])]))])

    # a hash set rules nearly all lines and paragraphs out; a map is scanned entry by entry, for the rest only
    known_line = lambda d: d.isin(*sorted(names))
    starts = F.filter(F.transform("parts", lambda c, at: F.struct(F.sha2(c, 256).alias("d"), at.alias("at"))),
                      lambda s: s["d"].isin(*sorted(heads)))

    def runs(start: Column) -> Column:
        of = F.transform(F.element_at(sizes, start["d"]), lambda n: _digest_of(F.slice("parts", start["at"] + 1, n)))
        return F.filter(of, known_line)

    found = F.concat(F.filter(F.transform("lines", lambda c: F.sha2(c, 256)), known_line), F.flatten(F.transform(starts, runs)))
    lines = F.array_sort(F.array_distinct(F.transform(F.array_distinct(found), lambda d: F.element_at(lookup, d))))
    out = rows.join(F.broadcast(table.select("digest", "license")), "digest", "left")
    return out.select("doc_id", "digest", "license", F.array_join(lines, ",").alias("line_licenses"))
