"""Student t p-values as column expressions.

The two-sided p-value of t with ``df`` degrees of freedom is the regularised
incomplete beta ``I_x(df/2, 1/2)`` at ``x = df / (df + t^2)``.  Its continued
fraction (DLMF 8.17.22) is an ``aggregate`` over a ``sequence`` from the far end,
as long as the degrees of freedom ask for; the beta function uses Stirling's
series.  Meant for small aggregate tables (one row per embedding x measure).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 10  # Stirling's series is used from here on


def lgamma(x: Column) -> Column:
    """log Gamma(x) for x > 0: Stirling's series (DLMF 5.11.1) at x + SHIFT, brought back by the recurrence."""
    z = x + SHIFT
    z2 = z * z
    series = (1 / (12 * z)) - 1 / (360 * z * z2) + 1 / (1260 * z * z2 * z2) - 1 / (1680 * z * z2 * z2 * z2)
    product = x
    for k in range(1, SHIFT):
        product = product * (x + k)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - F.log(product)  # log(sqrt(2 pi))


def _beta_fraction(a: Column, b: Column, x: Column, length: Column) -> Column:
    """1 / (1 + d1 / (1 + d2 / ...)) of the incomplete beta, from the far end."""
    def step(tail: Column, n: Column) -> Column:
        m = F.floor(n / 2)
        d = F.when(n % 2 == 0, m * (b - m)).otherwise(-(a + m) * (a + b + m)) * x / ((a + n - 1) * (a + n))
        return 1.0 + d / tail
    return 1.0 / F.aggregate(F.sequence(length, F.lit(1), F.lit(-1)), F.lit(1.0), step)


def _partial(a: Column, b: Column, x: Column, length: Column) -> Column:
    front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.log(x) + b * F.log(1 - x))
    return front * _beta_fraction(a, b, x, length) / a


def t_pvalue(t: Column | str, df: Column | str) -> Column:
    """Two-sided p-value of a t statistic (null when t or df is null, or df is not positive)."""
    t = (F.col(t) if isinstance(t, str) else t).cast("double")
    df = (F.col(df) if isinstance(df, str) else df).cast("double")
    usable = t.isNotNull() & ~F.isnan(t) & (df > 0)
    # the fraction needs about sqrt(df) terms; other rows get a short one that is not read
    length = F.when(usable, F.least(64 + 4 * F.ceil(F.sqrt(df)), F.lit(1 << 20))).otherwise(1).cast("int")
    a, b, x = df / 2, F.lit(0.5), df / (df + t * t)
    # each side of the beta where its fraction converges fast; t^2 / (df + t^2) keeps its digits for small t
    p = F.when(x < (a + 1) / (a + b + 2), _partial(a, b, x, length)).otherwise(1.0 - _partial(b, a, t * t / (df + t * t), length))
    return F.when(usable & (t == 0), 1.0).when(usable & (F.abs(t) == float("inf")), 0.0).when(usable, p)
