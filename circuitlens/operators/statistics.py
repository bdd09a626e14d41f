"""Posteriors and exact tests on success counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def binomial_tail(n: Column, p: Column, at_least: Column) -> Column:
    """P(X >= at_least) of a binomial, summed term by term inside the row; n stays a count of visits.

    The terms follow each other by a ratio, started from the first one in
    logarithms, so long runs don't underflow and the work is linear in n.
    """
    n, k0 = n.cast("int"), at_least.cast("int")
    start = F.struct((_log_choose(n, k0) + k0 * F.log(p) + (n - k0) * F.log(1 - p)).alias("term"), F.lit(0.0).alias("total"))
    step = lambda s, k: F.struct((s["term"] + F.when(k < n, F.log((n - k) / (k + 1)) + F.log(p) - F.log(1 - p)).otherwise(0.0)).alias("term"), (s["total"] + F.exp(s["term"])).alias("total"))
    total = F.aggregate(F.when(k0 <= n, F.sequence(k0, n)).otherwise(F.array().cast("array<int>")), start, step)["total"]
    return F.when(at_least <= 0, 1.0).when(p <= 0, 0.0).when(p >= 1, 1.0).otherwise(F.least(F.lit(1.0), total))


def _log_choose(n: Column, k: Column) -> Column:
    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.log((n - k + i) / i))


def beta_posterior(nodes: DataFrame, cutoff: float) -> DataFrame:
    """Beta(1 + r, 1 + n - r) of every node's rate: mean, variance, and the distribution function at the cut-off.

    With whole parameters the latter is a binomial tail: P(Bin(n + 1, x) >= r + 1).
    """
    a, b = F.col("reward") + 1, F.col("visits") - F.col("reward") + 1
    out = nodes.withColumns({"mean": a / (a + b), "variance": a * b / ((a + b) * (a + b) * (a + b + 1))})
    return out.withColumn("cdf", binomial_tail(F.col("visits") + 1, F.lit(cutoff), F.col("reward") + 1))


def mixture(posterior: DataFrame, by: str) -> DataFrame:
    """Equal mixture of the posteriors of a group: mean, variance and distribution function."""
    return posterior.groupBy(by).agg(F.avg("mean").alias("mean"), (F.avg(F.col("variance") + F.col("mean") * F.col("mean")) - F.avg("mean") * F.avg("mean")).alias("variance"), F.avg("cdf").alias("cdf"))


def poisson_binomial(nodes: DataFrame, by: str, threshold: float) -> DataFrame:
    """Number of nodes of a group whose rate exceeds the threshold, if rewards were redrawn: exact mean and variance."""
    q = F.when(F.col("visits") > 0, F.col("reward") / F.col("visits")).otherwise(0.0)
    p = binomial_tail(F.col("visits"), q, F.floor(F.col("visits") * threshold) + 1)
    marked = nodes.withColumn("p", p)
    return marked.groupBy(by).agg(F.count("*").alias("n"), F.sum("p").alias("mean"), F.sum(F.col("p") * (1 - F.col("p"))).alias("variance"))


def edge_significance(edges: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Upper tail of the child's record at the parent's rate, Bonferroni-corrected over all edges."""
    tests = edges.agg(F.count("*").alias("tests"))
    p = binomial_tail(F.col("visits"), F.col("q_parent"), F.col("reward"))
    out = edges.withColumn("pvalue", p).crossJoin(F.broadcast(tests))  # a row of totals
    return out.withColumn("p_corrected", F.col("pvalue") * F.col("tests")).withColumn("significant", F.col("p_corrected") < alpha).drop("tests")


def posterior_compare(groups: DataFrame, n: int, seed: int) -> DataFrame:
    """P(rate without < rate with) per pattern, from ``n`` draws of two Beta posteriors: (pattern, p_less).

    ``groups`` has one row per pattern with the visits and rewards of the
    circuits with and without it.
    """

    def draw(parts):
        for pdf in parts:
            found = []
            for r in pdf.itertuples(index=False):
                rg = np.random.default_rng([seed, *r.pattern.encode()])
                a = rg.beta(1 + r.reward_with, 1 + r.visits_with - r.reward_with, n)
                b = np.sort(rg.beta(1 + r.reward_without, 1 + r.visits_without - r.reward_without, n))
                found.append(float(np.searchsorted(b, a).mean() / n))
            yield pd.DataFrame({"pattern": pdf["pattern"], "p_less": found})

    columns = ["pattern", "reward_with", "visits_with", "reward_without", "visits_without"]
    return groups.select(*columns).mapInPandas(draw, "pattern string, p_less double")
