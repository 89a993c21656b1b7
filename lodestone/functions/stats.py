"""Statistics as columns over aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b; `empty` where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double"))


def wilson(k: Column, n: Column, upper: bool, edge: str = "whole") -> Column:
    """A bound of the Wilson interval. Where n is 0: [0, 1] for edge "whole", (0, 0) for "zero", null for "null"."""
    z2 = Z95 * Z95
    p = k / n
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    bound = F.least(F.lit(1.0), mid + half) if upper else F.greatest(F.lit(0.0), mid - half)
    none = {"whole": 1.0 if upper else 0.0, "zero": 0.0, "null": None}[edge]
    return F.when(n > 0, bound).otherwise(F.lit(none).cast("double"))


def with_percentile(rows: DataFrame, x: str, out: str) -> DataFrame:
    """rows with the average-rank percentile of x over all of them: ties share the mean of their ranks; one row alone has 0.

    Ranks come from counts per distinct value, so the one window without a key runs over distinct values after
    aggregation, and rows are only joined with their value's percentile.
    """
    per = rows.groupBy(F.col(x).alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    below = F.coalesce(F.sum("__c").over(Window.orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("__c").over(Window.partitionBy())
    per = per.select("__x", F.when(n > 1, (below + (F.col("__c") - 1) / 2) / (n - 1)).otherwise(F.lit(0.0)).alias("__p"))
    return rows.join(per, F.col(x).eqNullSafe(F.col("__x"))).withColumn(out, F.col("__p")).drop("__x", "__p")


def hash_order(seed: int, *keys: str) -> Column:
    """A reproducible shuffle order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_unit(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from seed and keys."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def poisson_weight(u: Column, most: int = 8) -> Column:
    """Poisson(1) draw by inversion of u; its tail above `most` has weight below 1e-6."""
    import math

    cdf = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(i + 1)) for i in range(most)]
    out = F.lit(most)
    for i in reversed(range(most)):
        out = F.when(u < cdf[i], i).otherwise(out)
    return out


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation, null where a side doesn't vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 1e-24, F.covar_pop(x, y) / spread)
