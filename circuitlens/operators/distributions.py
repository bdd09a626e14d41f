"""Rank tests, sums of unequal trials and mixtures of posteriors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from circuitlens.functions.tails import normal_sf
from circuitlens.operators.statistics import beta_posterior, binomial_tail
from circuitlens.sources.shared import cut

#: Samples up to this size without ties are tested exactly.
EXACT = 8
#: Distributions that a task convolves in one go; mass that is cut off at either end of one; cells above which a convolution is transformed.
FAN_IN, TRIM, DIRECT = 16, 1e-17, 20_000_000


def _exact_p(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    """Two-sided p of the greater U, from the number of arrangements of each U (a Gaussian binomial, in whole numbers)."""

    def one(n1: int, n2: int, u: float) -> float | None:
        small, large = sorted((int(n1), int(n2)))
        counts = [1] + [0] * (small * large)
        for i in range(1, small + 1):
            for k in range(len(counts) - 1, large + i - 1, -1):
                counts[k] -= counts[k - large - i]
            for k in range(i, len(counts)):
                counts[k] += counts[k - i]
        return min(1.0, 2 * sum(counts[int(u) :]) / comb(small + large, small))

    return pd.Series([one(*r) if r[2] == r[2] and r[2] is not None else None for r in zip(n1, n2, u)], dtype="float64")


def rank_test(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mann-Whitney test of every pair of groups: (g1, g2, n1, n2, u1, u2, z, p, p_corrected), pairs with g1 < g2.

    Two-sided. Samples of which one has at most 8 values and which share no value are tested
    exactly; others by the normal distribution with the variance
    corrected for ties and half a step for continuity, as ``z`` always is. ``p_corrected`` is p times
    the number of pairs (Bonferroni), which isn't capped at 1. Where all values are equal, z is null and p is 1. Rows
    with a null group or value don't count.

    Ranks are taken over distinct values: counts by (group, value), so a frequent value or a hot
    group is one row for each task.
    """
    counts = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    counts = cut(counts)  # pairs read it four times
    sizes = counts.groupBy("g").agg(F.sum("c").alias("n"))
    pairs = sizes.select(F.col("g").alias("g1"), F.col("n").alias("n1")).join(sizes.select(F.col("g").alias("g2"), F.col("n").alias("n2")), F.col("g1") < F.col("g2"))
    none = F.lit(0).cast("bigint")
    one = pairs.join(counts, F.col("g1") == F.col("g")).select("g1", "g2", "n1", "n2", "v", F.col("c").alias("c1"), none.alias("c2"))
    two = pairs.join(counts, F.col("g2") == F.col("g")).select("g1", "g2", "n1", "n2", "v", none.alias("c1"), F.col("c").alias("c2"))
    keys = ["g1", "g2", "n1", "n2"]
    both = one.unionByName(two).groupBy(*keys, "v").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    below = F.sum("c2").over(Window.partitionBy("g1", "g2").orderBy("v")) - F.col("c2")
    tied = (F.col("c1") + F.col("c2")).cast("double")
    sums = both.withColumns({"wins": F.col("c1") * (below + F.col("c2") / 2), "ties": tied * tied * tied - tied}).groupBy(*keys).agg(F.sum("wins").alias("u1"), F.sum("ties").alias("ties"))
    n1, n2, n = F.col("n1"), F.col("n2"), (F.col("n1") + F.col("n2")).cast("double")
    product = n1.cast("double") * n2
    most = F.greatest("u1", "u2")
    spread = F.sqrt(F.greatest(F.lit(0.0), product / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))))
    out = sums.withColumn("u2", product - F.col("u1")).withColumn("z", F.when(spread > 0, (most - product / 2 - 0.5) / spread))
    exact = (F.least(n1, n2) <= EXACT) & (F.col("ties") == 0)
    counted = F.pandas_udf(_exact_p, T.DoubleType())(n1, n2, F.when(exact, most))
    normal = F.when(F.col("z").isNull(), 1.0).otherwise(F.least(F.lit(1.0), 2 * normal_sf(F.col("z"))))
    out = out.withColumn("p", F.when(exact, counted).otherwise(normal))
    tests = pairs.agg(F.count("*").alias("tests"))
    out = out.crossJoin(F.broadcast(tests))  # a row of totals
    return out.select("g1", "g2", "n1", "n2", "u1", "u2", "z", "p", (F.col("p") * F.col("tests")).alias("p_corrected"))


def _trimmed(offset: int, pmf: np.ndarray) -> tuple[int, np.ndarray]:
    """Without the ends that hold less than TRIM together."""
    first = int(np.searchsorted(np.cumsum(pmf), TRIM, side="right"))
    last = len(pmf) - int(np.searchsorted(np.cumsum(pmf[::-1]), TRIM, side="right"))
    return (offset + first, pmf[first:last]) if first < last else (offset, pmf)


def _binomial(n: int, p: float) -> tuple[int, np.ndarray]:
    """Offset and probabilities of a binomial, by ratios from its mode on, as far as they matter."""
    if p <= 0 or p >= 1 or n == 0:
        return (n if p >= 1 else 0), np.ones(1)
    mode, reach = int((n + 1) * p), int(10 * (n * p * (1 - p)) ** 0.5 + 40)
    low, high = max(0, mode - reach), min(n, mode + reach)
    up, down = np.arange(mode, high), np.arange(mode, low, -1)
    rising = np.cumprod((n - up) / (up + 1) * (p / (1 - p)))
    falling = np.cumprod(down / (n - down + 1) * ((1 - p) / p))
    pmf = np.concatenate([falling[::-1], [1.0], rising])
    return _trimmed(low, pmf / pmf.sum())


def _convolved(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    x, y = a[1], b[1]
    if len(x) * len(y) <= DIRECT:
        pmf = np.convolve(x, y)
    else:
        size = 1 << (len(x) + len(y) - 2).bit_length()
        pmf = np.maximum(np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y, size), size)[: len(x) + len(y) - 1], 0)
    return _trimmed(a[0] + b[0], pmf)


def _sum_of(parts: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """The distribution of a sum, the shortest two first."""
    parts = sorted(parts, key=lambda part: len(part[1]))
    while len(parts) > 1:
        parts = sorted([_convolved(parts[k], parts[k + 1]) for k in range(0, len(parts) - 1, 2)] + parts[len(parts) // 2 * 2 :], key=lambda part: len(part[1]))
    return parts[0]


def sum_distribution(trials: DataFrame, by: Sequence[str], p: str = "p", n: str = "n", chunk: int = 256) -> DataFrame:
    """The exact distribution of the successes of each group: (by, offset, pmf), pmf[k] being P(X = offset + k).

    ``trials`` has rows of ``n`` trials with chance ``p`` each; a null p or n counts as none. Equal
    chances of a group are added up first. Then ``chunk`` chances are convolved in a task,
    and the results merged 16 by 16, so that a group of any size is
    spread over tasks. Ends that hold less than 1e-17 are cut off at each step, so the row's length grows
    with the root of the trials.
    """
    keys = list(by)
    rows = trials.where(F.col(p).isNotNull() & F.col(n).isNotNull() & (F.col(n) > 0)).groupBy(*keys, F.col(p).cast("double").alias("p")).agg(F.sum(F.col(n)).cast("bigint").alias("n"))
    rows = cut(rows)
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    most = sizes.agg(F.max("chunks")).first()[0] or 1
    kinds = {f.name: f.dataType.simpleString() for f in trials.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", chunk int, offset bigint, pmf array<double>"

    def packed(table: pa.Table, parts: list[tuple[int, np.ndarray]]) -> pa.Table:
        offset, pmf = _sum_of(parts)
        first = table.slice(0, 1).select([*keys, "chunk"])
        return first.append_column("offset", pa.array([offset], pa.int64())).append_column("pmf", pa.array([pmf], pa.list_(pa.float64())))

    def start(table: pa.Table) -> pa.Table:
        return packed(table, [_binomial(k, q) for k, q in zip(table.column("n").to_pylist(), table.column("p").to_pylist())])

    def merge(table: pa.Table) -> pa.Table:
        return packed(table, [(o, np.asarray(f.values)) for o, f in zip(table.column("offset").to_pylist(), table.column("pmf"))])

    found = rows.join(sizes, keys).withColumn("chunk", F.pmod(F.xxhash64("p"), F.col("chunks")).cast("int")).groupBy(*keys, "chunk").applyInArrow(start, schema)
    while most > 1:
        most = -(-most // FAN_IN)
        found = cut(found).withColumn("chunk", F.floor(F.col("chunk") / FAN_IN).cast("int")).groupBy(*keys, "chunk").applyInArrow(merge, schema)
    return found.drop("chunk")


def _not_above(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """P(X <= Y) of each row, next to its other columns."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            x, y = (np.asarray(batch.column(c)[i].values) if batch.column(c)[i].is_valid else np.ones(1) for c in ("x_pmf", "y_pmf"))
            first, second = (batch.column(c)[i].as_py() or 0 for c in ("x_offset", "y_offset"))
            from_here = np.append(np.cumsum(y[::-1])[::-1], 0.0)  # P(Y >= second + k)
            at = np.clip(np.arange(len(x)) + first - second, 0, len(y))
            out.append(min(1.0, float((x * from_here[at]).sum())))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["key", "p_value"])


def reachability_test(terminals: DataFrame, pairs: DataFrame, threshold: float, node: str = "pattern", terminal: str = "state") -> DataFrame:
    """Whether the terminals that a node reaches hold more successes than the others, for every node of ``pairs``.

    Returns (node, n_reachable, n_other, mean_diff, sd_diff, p_value). ``terminals``
    has (terminal, visits, reward), ``pairs`` (node, terminal). A terminal counts as
    a success with the chance that its rate, measured anew by as many visits, lies above
    ``threshold``. p_value is P(successes reached <= successes elsewhere), from the
    exact distributions of both; without terminals a side has 0.

    Terminals are grouped by their chance, so a node has a row for each
    distinct chance, not for each terminal.
    """
    q = F.when(F.col("visits") > 0, F.col("reward") / F.col("visits")).otherwise(0.0)
    chance = binomial_tail(F.col("visits"), q, F.floor(F.col("visits") * threshold) + 1)
    marked = cut(terminals.select(terminal, "visits", "reward").withColumn("p", chance).select(terminal, "p"))
    total = marked.groupBy("p").agg(F.count("*").alias("all"))
    inside = cut(pairs.select(node, terminal).distinct().join(marked, terminal).groupBy(node, "p").agg(F.count("*").alias("in")))
    grid = pairs.select(node).distinct().join(total)  # every node has each chance on one side or the other
    sides = cut(grid.join(inside, [node, "p"], "left").select(node, "p", F.coalesce("in", F.lit(0)).alias("x"), (F.col("all") - F.coalesce("in", F.lit(0))).alias("y")))
    spread = F.col("p") * (1 - F.col("p"))
    moments = sides.groupBy(node).agg(
        F.sum("x").alias("n_reachable"), F.sum("y").alias("n_other"), F.sum((F.col("x") - F.col("y")) * F.col("p")).alias("mean_diff"), F.sqrt(F.sum((F.col("x") + F.col("y")) * spread)).alias("sd_diff")
    )
    trials = sides.select(node, F.explode(F.array(F.struct(F.lit("x").alias("side"), F.col("x").alias("n")), F.struct(F.lit("y").alias("side"), F.col("y").alias("n")))).alias("s"), "p").select(node, "s.side", "p", "s.n")
    found = cut(sum_distribution(trials, [node, "side"]))
    x, y = (found.where(F.col("side") == s).select(node, F.col("offset").alias(f"{s}_offset"), F.col("pmf").alias(f"{s}_pmf")) for s in "xy")
    joined = moments.select(F.col(node).alias("key")).join(x.withColumnRenamed(node, "key"), "key", "left").join(y.withColumnRenamed(node, "key"), "key", "left")
    kind = moments.schema[node].dataType.simpleString()
    p_values = joined.mapInArrow(_not_above, f"key {kind}, p_value double").withColumnRenamed("key", node)
    return moments.join(p_values, node)


def reachable_mixture(nodes: DataFrame, pairs: DataFrame, cutoff: float) -> DataFrame:
    """Posterior of each node: the equal mixture of Beta(1 + r, 1 + n - r) over the circuits that it reaches.

    ``nodes`` has (node, visits, reward), ``pairs`` (node, target) from
    ``graphs.reachability``. Returns (node, n, mean, variance, cdf, sf) with the distribution function and its
    complement at ``cutoff``; nodes that reach no target are left out.
    """
    posterior = cut(beta_posterior(nodes.select(F.col("node").alias("target"), "visits", "reward"), cutoff).select("target", "mean", "variance", "cdf"))
    square = F.col("variance") + F.col("mean") * F.col("mean")
    out = pairs.join(posterior, "target").groupBy("node").agg(F.count("*").alias("n"), F.avg("mean").alias("mean"), (F.avg(square) - F.avg("mean") * F.avg("mean")).alias("variance"), F.avg("cdf").alias("cdf"))
    return out.withColumn("sf", 1 - F.col("cdf"))
