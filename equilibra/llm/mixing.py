"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a target number of words.  A source whose target is f times
its size takes every document floor(f) times and once more the documents whose
id hash lies under the source's threshold.  The threshold is found without
sorting: words are summed by (source, leading hash bits), running sums over
these buckets show where the budget is used up, and only the rows of that one
boundary bucket are summed again by the next bits, until the bucket is a single
hash value.  Thresholds are nested: a larger budget keeps all a smaller one
took.  Documents are then filtered row by row against their source's threshold.

Bounds: a level's histogram has at most 2^12 rows per source, in the task of
that source; the weights need one row per source in one task (a catalogue of
sources, not of documents).  Thresholds are broadcast up to
``BROADCAST_SOURCES`` sources and shuffled beyond.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; rows that share a doc_id share their draw (also a null id);
where a source has no word its target is 0; an empty table gives an empty mix;
reruns agree, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilibra.llm.common import fresh
from equilibra.session import cut_lineage

BITS = 12
LEVELS = 5
CAP = 3.0
BROADCAST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(doc_id: Column) -> Column:
    """A document's place in [0, 2^60): the leading 60 bits of its id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def cycle_weight(order: Column) -> Column:
    """1, 2, 3, repeating, by a source's place from 1."""
    return F.pmod(order - 1, F.lit(3)) + 1


def targets(sizes: DataFrame, weight=cycle_weight, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, none above ``cap`` times
    its size, the excess reshared by weight among the others.

    In order of cap per weight a source is capped exactly if all sources could take its rate and the total
    would still not be used up; the others share what is left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("w", weight(F.row_number().over(by_name)).cast("double")).withColumn(
        "lim", F.col("source_size") * F.lit(cap))
    by_rate = Window.orderBy(F.col("lim") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    t = (t.withColumn("total", F.sum("source_size").over(whole).cast("double"))
         .withColumn("all_w", F.sum("w").over(whole))
         .withColumn("lim_before", F.sum("lim").over(by_rate.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("lim"))
         .withColumn("w_before", F.sum("w").over(by_rate.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("w")))
    full = F.col("lim_before") + F.col("lim") / F.col("w") * (F.col("all_w") - F.col("w_before")) <= F.col("total")
    t = t.withColumn("full", full)
    t = (t.withColumn("left", F.col("total") - F.sum(F.when(F.col("full"), F.col("lim")).otherwise(0.0)).over(whole))
         .withColumn("left_w", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(whole)))
    target = F.when(F.col("full"), F.col("lim")).otherwise(F.col("w") * (F.col("left") / F.col("left_w")))
    return t.select("source", "source_size", target.alias("target"))


def _refine(slim: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, bound, ...): rows of a source whose draw lies under ``bound`` carry its extra budget."""
    shift = 60 - BITS
    cur = goal.withColumn("at", F.lit(0).cast("bigint")).withColumn("before", F.lit(0).cast("bigint"))
    start = _sized(cur.select(F.col("source").alias("_s"), "extra", "at", "before"))
    inside = slim.join(start, F.col("source").eqNullSafe(F.col("_s"))).select("source", "draw", "size", "extra", "at", "before")
    keys = ["source", "extra", "at", "before"]
    for level in range(LEVELS):
        bucket = F.shiftright("draw", shift)
        hist = inside.groupBy(*keys, bucket.alias("bucket")).agg(F.sum("size").alias("mass"))
        run = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("upto", F.col("before") + F.sum("mass").over(run))
        # the first bucket that the budget does not pay whole
        edge = hist.where(F.col("upto") > F.col("extra")).groupBy("source", "extra").agg(
            F.min(F.struct("bucket", "upto", "mass")).alias("e")).select(
            "source", "extra", F.col("e.bucket").alias("at"), (F.col("e.upto") - F.col("e.mass")).alias("before"), F.col("e.mass").alias("mass"))
        edge = cut_lineage(edge)
        if level + 1 < LEVELS:
            inside = inside.select("source", "draw", "size").join(
                _sized(edge.withColumnRenamed("source", "_s")),
                F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("draw", shift) == F.col("at"))
            ).select("source", "draw", "size", "extra", "at", "before")
            shift -= BITS
    # the boundary is one hash value now: take it if the budget ends nearer behind it than before it
    took = 2 * F.col("before") + F.col("mass") <= 2 * F.col("extra")
    return edge.select("source", (F.col("at") + took.cast("bigint")).alias("bound"))


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weight=cycle_weight, cap: float = CAP) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): each row's size and draw, each source's target, whole copies and threshold."""
    slim = cut_lineage(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                 draw(F.col(id_col)).alias("draw"), word_count(F.col(text_col)).alias("size")))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weight, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("copies", F.floor(ratio).cast("int")).withColumn(
        "extra", F.col("target") - F.col("copies") * F.col("source_size"))
    goal = cut_lineage(goal)
    bounds = _refine(slim, goal).withColumnRenamed("source", "_s")
    sources = goal.join(bounds, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "source", "source_size", "target", "copies", F.coalesce("bound", F.lit(1 << 60)).alias("bound"))
    return slim, cut_lineage(sources)


def _sized(sources: DataFrame) -> DataFrame:
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return F.broadcast(sources) if few else sources


def taken(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, times, taken) of every row."""
    rows, sources = plan(df, id_col, text_col, source_col)
    s = _sized(sources.withColumnRenamed("source", "_s"))
    times = F.col("copies") + (F.col("draw") < F.col("bound")).cast("int")
    return rows.join(s, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed table: every row as often as the mix takes it."""
    _, sources = plan(df, id_col, text_col, source_col)
    key, copies, bound = (fresh(df, n) for n in ("mix_source", "mix_copies", "mix_bound"))
    s = _sized(sources.select(F.col("source").alias(key), F.col("copies").alias(copies), F.col("bound").alias(bound)))
    times = F.col(copies) + (draw(F.col(id_col)) < F.col(bound)).cast("int")
    each = fresh(df, "mix_times")
    return (df.join(s, F.col(source_col).eqNullSafe(F.col(key))).withColumn(each, F.explode(F.array_repeat(F.lit(1), times)))
            .select(*df.columns))
