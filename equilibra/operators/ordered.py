"""Ordered prefix sums and row numbers without one task per group.

A window ``partitionBy(keys).orderBy(order)`` sends every row of a key to one
task.  Fairness tables have few keys (embedding x fold) holding all rows, so
that plan does not scale.  Here each row gets a *bucket* from a numeric,
order-preserving ``coarse`` value within its key.  Rows are counted per slice
of ``coarse`` (slices of equal width on a logarithmic scale, so one extreme
value does not stretch them); a row's rank is estimated from the counts of the
lower slices and its place between its slice's smallest and largest value, and
equal shares of the ranks are the buckets.  Counts, minima and maxima are exact,
so every branch of the plan computes the same bucket.  Each bucket computes
local prefix sums, the per-(key, bucket) totals (at most ``keys x buckets``
rows) become offsets, and a join adds the offsets back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "_bucket"
SLICES = 128        # slices per factor e of the coarse value
SMALLEST = 1e-6     # values below it are sliced on a linear scale
DOMAIN_SPLIT = 8    # buckets of a known domain are this much finer, as their shares are not counted


def default_buckets(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hex_prefix_number(hex_col: Column, digits: int = 12) -> Column:
    """Order-preserving number from the leading hex digits of a hash string."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("bigint")


def string_prefix_number(col: Column) -> Column:
    """Order-preserving number from the first six UTF-8 bytes of a string."""
    b = F.hex(F.substring(F.encode(col, "UTF-8").cast("binary"), 1, 6))
    padded = F.rpad(b, 12, "0")
    return F.conv(padded, 16, 10).cast("bigint")


def with_bucket(df: DataFrame, keys: Sequence[str], coarse: Column, buckets: int,
                domain: tuple[float, float] | None = None) -> DataFrame:
    """Add ``_bucket``: a non-decreasing function of ``coarse`` within the keys.

    Any monotone bucket function keeps the prefix sums exact; the slice counts
    only balance the buckets.  With a known ``domain`` of evenly spread values
    (e.g. hash prefixes) buckets are equal-width and nothing is counted; values
    outside clip to the ends.
    """
    keys = list(keys)
    value = coarse.cast("double")
    if domain is not None:
        lo, hi, n = float(domain[0]), float(domain[1]), buckets * DOMAIN_SPLIT
        raw = F.floor((value - F.lit(lo)) / F.lit(hi - lo) * n)
        return df.withColumn(_B, F.least(F.greatest(F.coalesce(raw, F.lit(0)), F.lit(0)), F.lit(n - 1)).cast("int"))
    widest = F.lit(800.0)  # beyond every finite double on this scale
    log = F.signum(value) * F.log1p(F.abs(value) / SMALLEST)
    cut = F.floor(F.least(F.greatest(F.coalesce(log, -widest), -widest), widest) * SLICES)
    tmp = df.withColumn("_coarse", value).withColumn("_slice", cut)
    per = tmp.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"), F.min("_coarse").alias("_lo"),
                                           F.max("_coarse").alias("_hi"))
    below = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("*", F.coalesce(F.sum("_rows").over(below), F.lit(0)).alias("_under"),
                     F.sum("_rows").over(Window.partitionBy(*keys)).alias("_total"))
    cond = [F.col(f"_d.{k}").eqNullSafe(F.col(f"_m.{k}")) for k in keys]
    cond.append(F.col("_d._slice") == F.col("_m._slice"))
    joined = tmp.alias("_d").join(per.alias("_m"), cond, "inner").select(
        "_d.*", "_m._rows", "_m._lo", "_m._hi", "_m._under", "_m._total")
    place = F.when(F.col("_hi") > F.col("_lo"), (F.col("_coarse") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    rank = F.col("_under") + F.nanvl(F.coalesce(place, F.lit(0.0)), F.lit(0.0)) * F.col("_rows")
    bucket = F.least(F.floor(rank * buckets / F.col("_total")), F.lit(buckets - 1)).cast("int")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], bucket.alias(_B))


def prefix_before(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                  values: Sequence[str], coarse: Column | None = None,
                  buckets: int | None = None, suffix: str = "_before",
                  domain: tuple[float, float] | None = None) -> DataFrame:
    """Add ``<v><suffix>`` = sum of ``v`` over rows with the same keys and a smaller order.

    ``order`` must be unique within ``keys`` (aggregate ties away first) and
    ``coarse`` must be a numeric, non-decreasing function of ``order``
    (default: the first order column).
    """
    keys = list(keys)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    coarse = order_cols[0] if coarse is None else coarse
    n = buckets or default_buckets(df)
    bucketed = with_bucket(df, keys, coarse, n, domain)
    w_local = (Window.partitionBy(*keys, _B).orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, -1))
    local = bucketed.select("*", *[F.coalesce(F.sum(v).over(w_local), F.lit(0)).alias(f"_loc_{v}")
                                   for v in values])
    totals = bucketed.groupBy(*keys, _B).agg(*[F.sum(v).alias(f"_tot_{v}") for v in values])
    w_off = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, _B, *[F.coalesce(F.sum(f"_tot_{v}").over(w_off), F.lit(0))
                                         .alias(f"_off_{v}") for v in values])
    lhs, rhs = local.alias("_l"), offsets.alias("_o")
    cond = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_o.{k}")) for k in keys]
    cond.append(F.col(f"_l.{_B}") == F.col(f"_o.{_B}"))
    joined = lhs.join(rhs, cond, "inner")
    out = [F.col(f"_l.`{c}`") for c in df.columns]
    out += [(F.col(f"_l._loc_{v}") + F.col(f"_o._off_{v}")).alias(f"{v}{suffix}") for v in values]
    return joined.select(*out)


def row_number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                      coarse: Column | None = None, out: str = "rn",
                      buckets: int | None = None, domain: tuple[float, float] | None = None) -> DataFrame:
    """Exact ``row_number() over (partition by keys order by order)``, 1-based, scalable.

    ``order`` must be unique within ``keys``; ``coarse`` as in :func:`prefix_before`.
    """
    one = "_one_row"
    numbered = prefix_before(df.withColumn(one, F.lit(1)), keys, order, [one], coarse, buckets, domain=domain)
    return numbered.select(*df.columns, (F.col(f"{one}_before") + 1).alias(out))


def median_by(df: DataFrame, keys: Sequence[str], value: str, buckets: int | None = None, out: str = "median") -> DataFrame:
    """Exact median per key (mean of the two middle values for an even count) without
    holding a key's values in one task.

    Equal values are counted map-side first, so a value that a third of the rows
    share is one row; a distributed prefix sum of the counts gives the ranks that
    each value covers, and only the values over the middle ranks are kept.
    """
    keys = list(keys)
    v = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counted = v.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = prefix_before(counted, keys, ["_v"], ["_c"], buckets=buckets)
    n = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    lhs, rhs = ranked.withColumn("_one", F.lit(1)).alias("_r"), n.withColumn("_one", F.lit(1)).alias("_t")
    j = lhs.join(rhs, [F.col(f"_r.{k}").eqNullSafe(F.col(f"_t.{k}")) for k in [*keys, "_one"]])
    j = j.select(*[F.col(f"_r.{k}").alias(k) for k in keys], "_r._v", "_r._c", "_r._c_before", "_t._n")

    def middle(rank: Column) -> Column:
        return F.max(F.when((F.col("_c_before") < rank) & (rank <= F.col("_c_before") + F.col("_c")), F.col("_v")))
    lo, hi = middle(F.floor((F.col("_n") + 1) / 2)), middle(F.ceil((F.col("_n") + 1) / 2))
    return j.groupBy(*keys).agg(((lo + hi) / 2).alias(out))
