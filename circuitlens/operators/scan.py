"""Running sums and places over large groups, in two passes: totals of buckets, then sums within a bucket.

A window over a group makes one task of it. Here a group is cut into buckets
in its order, the totals of the buckets are summed up (a row for each), and
rows are only ordered within their bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Steps of a bucket, buckets that values are cut into.
STEPS, RANGES = 50_000, 256


def step_bucket(step: str = "step", size: int = STEPS) -> Column:
    """Buckets of rows that are numbered without gaps: ``size`` rows each."""
    return F.floor((F.col(step) - 1) / size)


def value_bucket(df: DataFrame, value: str, ranges: int = RANGES) -> Column:
    """Buckets of about as many rows each, ascending, nulls first; cut at approximate quantiles, so equal values share one."""
    found = df.agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 10_000).alias("cuts")).first().cuts or []
    cuts = F.array(*[F.lit(c) for c in sorted(set(found))]) if found else F.array().cast(f"array<{df.schema[value].dataType.simpleString()}>")
    return F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter(cuts, lambda c: c < F.col(value))))


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column], bucket: Column, descending: bool = False) -> DataFrame:
    """``df`` with a running sum for each entry of ``sums``, in ``order`` within the groups ``by`` (nulls are a group).

    ``bucket`` must rise (or fall, if ``descending``) with the order and never
    part rows that are equal in it. Null terms add nothing; a sum is null up
    to the first term.
    """
    marked = df.withColumns({"__bucket": bucket, **{f"__term_{n}": c for n, c in sums.items()}})
    totals = marked.groupBy(*by, "__bucket").agg(*[F.sum(f"__term_{n}").alias(f"__total_{n}") for n in sums])
    earlier = Window.partitionBy(*by).orderBy(F.desc("__bucket") if descending else F.asc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__bucket").alias("__at"), *[F.sum(f"__total_{n}").over(earlier).alias(f"__before_{n}") for n in sums])
    inside = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumns({f"__inside_{n}": F.sum(f"__term_{n}").over(inside) for n in sums})
    same = F.col("__bucket").eqNullSafe(F.col("__at"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = local.join(before, same)
    zero = F.lit(0)
    total = {n: F.when(F.col(f"__before_{n}").isNull(), F.col(f"__inside_{n}")).otherwise(F.col(f"__before_{n}") + F.coalesce(f"__inside_{n}", zero)) for n in sums}
    return joined.select(*[c for c in df.columns if c not in sums], *[c.alias(n) for n, c in total.items()])


def top_rows(df: DataFrame, value: str, tie: str, n: int) -> DataFrame:
    """The ``n`` rows with the greatest values, the first by ``tie`` among equal ones; null values come last.

    Values are counted, and the counts summed up from the top, until the value at which
    the n-th row lies; rows above it stay as they are. Only rows of that
    value are put in order.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    placed = running_sums(counts, [], [F.desc(value)], {"__upto": F.col("__n")}, value_bucket(counts, value), descending=True)
    last = placed.where(F.col("__upto") >= n).agg(F.max(F.struct(F.col(value).alias("v"), (F.col("__upto") - F.col("__n")).alias("above"))).alias("m")).first().m
    if last is None:  # all that have a value, then some without
        missing = n - df.where(F.col(value).isNotNull()).count()
        return df.where(F.col(value).isNotNull()).union(df.where(F.col(value).isNull()).orderBy(tie).limit(missing))
    ties = df.where(F.col(value) == F.lit(last.v)).orderBy(tie).limit(n - last.above)
    return df.where(F.col(value) > F.lit(last.v)).union(ties)
