"""Filter interaction audit by the Hart-Mas-Colell potential.

Each row gets a 5-bit mask of the filters it fails.  A part (source) is then
described by 32 counts, and every question about any order of the filters is
about coalitions of filters: v(S) is the number of rows that fail at least one
filter of S.  The potential of a game is defined by P(empty) = 0 and
``|S| P(S) = v(S) + sum of P(S without i) over i in S``; it is computed here over
the 32 coalitions in turn.  A filter's Shapley value is P(all) minus P(all but
it); a step of an order is the difference of two coalitions.  Values are kept
as whole numbers, 120 P(S), which are the sums over all 120 orders.

Four of the filters read the text alone.  E (a copy of a smaller id's text)
compares ids across the table: rows are first counted by (text digest, part,
id), then by (digest, part) with the counts at the smallest id apart, so a text
that a third of all rows share costs one row per part.  Texts never move.

Defined results: a null text is empty; words are case-sensitive; a null source
is the part '' (as is an empty source); rows of one id and equal text are no
copies of each other; a null id is not smaller than any id and has no smaller
one, so such rows pass E; a row without label is neither good nor toxic, several
label rows of an id count as one that holds if any does; an empty table gives no
rows.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilibra.session import cut_lineage

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
COPY = 1 << FILTERS.index("E")
ORDERS = 120
WORD = r"[^\x20\x09-\x0D]+"
MARKS = "[#$%&*|]"


def text_mask(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    total, distinct = F.size(words).cast("bigint"), F.size(F.array_distinct(words)).cast("bigint")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("bigint")
    fails = [total < 200, 100 * distinct < 50 * total, 100 * capitals > 2 * F.char_length(text), text.rlike(MARKS)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))


def _known(labels: DataFrame) -> DataFrame:
    good, toxic = (F.max(F.coalesce((F.col(c) == 1).cast("bigint"), F.lit(0))) for c in ("quality", "toxic"))
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(good.alias("_good"), toxic.alias("_toxic"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the set of filters they fail."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"),
                       F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_mask(text).alias("mask"))
    rows = slim.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = _known(labels)
    rows = rows.join(known, rows["id"] == known["_id"], "left").select(
        "id", "part", "digest", "mask", "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c[1:]) for c in ("_good", "_toxic")])
    counts = ("n", "good", "toxic")
    per = rows.groupBy("digest", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in counts],
        *[F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"null_{c}") for c in counts],
        # ids are distinct here, so this is the row group of the smallest id
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", *counts))).alias("low"))
    per = cut_lineage(per)
    first = per.groupBy("digest").agg(F.min("low.id").alias("first")).where(F.col("first").isNotNull())
    j = per.join(first, "digest", "left")
    lowest = F.col("low.id") == F.col("first")
    passes = {c: F.col(f"null_{c}") + F.when(lowest, F.col(f"low.{c}")).otherwise(0) for c in counts}
    sides = F.array(F.struct(F.col("mask"), *[v.alias(c) for c, v in passes.items()]),
                    F.struct((F.col("mask") + COPY).alias("mask"), *[(F.col(c) - v).alias(c) for c, v in passes.items()]))
    return j.select("part", F.explode(sides).alias("s")).groupBy("part", F.col("s.mask").alias("mask")).agg(
        *[F.sum(f"s.{c}").alias(c) for c in counts])


def _over_coalitions(of) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(ALL)), of)


def removed_by(counts: Column) -> Column:
    """v(S) of all 32 coalitions S, from the 32 counts by mask."""
    return _over_coalitions(lambda s: F.aggregate(F.transform(
        counts, lambda n, m: F.when(m.bitwiseAND(s) != 0, n).otherwise(0)), F.lit(0).cast("bigint"), lambda a, x: a + x))


def potential(v: Column) -> Column:
    """120 P(S) of all 32 coalitions, each from the coalitions with one filter less.

    A coalition's number is larger than its subsets', so one walk in order meets
    them first; every division leaves no rest, as 120 / |S|! is whole.
    """
    def add(p: Column, s: Column) -> Column:
        smaller = sum((F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(p, s - (1 << i))).otherwise(0)
                       for i in range(1, len(FILTERS))), F.when(s.bitwiseAND(F.lit(1)) != 0, F.get(p, s - 1)).otherwise(0))
        whole = (ORDERS * F.get(v, s) + smaller) / F.bit_count(s)
        return F.concat(p, F.array(whole.cast("bigint")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("bigint")), add)


def _orders(df: DataFrame) -> DataFrame:
    """Every row once per order of the filters, built letter by letter; ``_seen`` lists the coalition
    before each letter and after the last."""
    choices = F.array(*[F.struct(F.lit(x).alias("letter"), F.lit(1 << i).alias("bit")) for i, x in enumerate(FILTERS)])
    d = df.withColumns({"filter_order": F.lit(""), "_seen": F.array(F.lit(0))})
    for _ in FILTERS:
        left = F.filter(choices, lambda c: F.element_at("_seen", -1).bitwiseAND(c["bit"]) == 0)
        d = d.withColumn("_next", F.explode(left)).withColumns({
            "filter_order": F.concat("filter_order", "_next.letter"),
            "_seen": F.concat("_seen", F.array(F.element_at("_seen", -1) + F.col("_next.bit")))}).drop("_next")
    return d


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley):
    one row per part, order of the filters and step; shapley is the filter's removed summed over all orders."""
    f = failures(docs, labels)
    parts = f.groupBy("part").agg(*[F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0).cast("bigint"))
                                              for m in range(ALL + 1)]).alias(c) for c in ("n", "good", "toxic")])
    games = parts.select("part", F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
                         *[removed_by(F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    games = cut_lineage(games.withColumn("p", potential(F.col("n"))))  # one row per part
    steps = _orders(games).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    before, after = F.get("_seen", F.col("step") - 1), F.get("_seen", F.col("step"))
    own, every = after - before, F.lit(ALL)

    def gain(game: str, s: Column, without: Column) -> Column:
        return F.get(game, s) - F.get(game, without)
    removed = gain("n", after, before)
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - F.get("n", after)).alias("kept"), removed.alias("removed"),
        (F.get("n", own) - removed).alias("redundant"), gain("n", every, every - own).alias("unique_fails"),
        gain("good", after, before).alias("good_lost"), gain("toxic", after, before).alias("toxic_lost"),
        gain("p", every, every - own).alias("shapley"))
