"""Time series of trajectories: smoothing, autocorrelation, minima, oscillation summaries and spectra.

A series is a group of rows (series_id, t, value) with t = 0, 1, 2, ...; one
series is gathered into an array where an operator needs all of it at once,
as its length is that of a simulation and doesn't grow with their number.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F


def gathered(df: DataFrame, value: str = "value", by: Sequence[str] = ("series_id",)) -> DataFrame:
    """One row per series with its values in order of t, a NaN in it making all of it NaN later on."""
    return df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", F.col(value).cast("double").alias("v")))), lambda p: p["v"]).alias("y"))


def smooth(y: Column, width: int = 9) -> Column:
    """Binomial smoothing over 3, 5, 7 or 9 points; the half width is dropped at either end."""
    weights = [comb(width - 1, k) / 2 ** (width - 1) for k in range(width)]
    total = lambda i: sum((F.get(y, i + k) * w for k, w in enumerate(weights)), F.lit(0.0))
    return F.when(F.size(y) < width, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(y) - width, F.lit(0))), total))


def binomial_smooth(df: DataFrame, width: int = 9, value: str = "value") -> DataFrame:
    """Smoothed values at their own t, in windows over the rows."""
    half, w = width // 2, Window.partitionBy("series_id").orderBy("t")
    weights = [comb(width - 1, k) / 2 ** (width - 1) for k in range(width)]
    total = sum((F.lag(value, half - k).over(w) * x for k, x in enumerate(weights)), F.lit(0.0))
    return df.select("series_id", "t", total.alias("smoothed")).where(F.col("smoothed").isNotNull())


def autocorrelations(series: DataFrame) -> DataFrame:
    """(series_id, acf) of gathered series (series_id, y), a numpy product per lag in batches of series.

    The lag products of a long series are a few vector operations here, where
    nested expressions would build an array for each lag.
    """

    def batch(parts):
        for pdf in parts:
            yield pd.DataFrame({"series_id": pdf["series_id"], "acf": [_acf(np.asarray(y, float)) for y in pdf["y"]]})

    return series.select("series_id", "y").mapInPandas(batch, "series_id string, acf array<double>")


def _acf(y: np.ndarray) -> list[float]:
    if not len(y):
        return []
    x = y - y.mean()
    out = np.array([x[: len(x) - k] @ x[k:] for k in range((len(x) + 1) // 2)])
    return (out / out[0]).tolist() if out[0] > 0 else np.where(np.isnan(out), np.nan, 0.0).tolist()


def local_minima(acf: DataFrame, value: str = "value") -> DataFrame:
    """Interior rows that are no greater than either neighbour."""
    w = Window.partitionBy("series_id").orderBy("t")
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return acf.withColumns({"__b": before, "__a": after}).where((F.col(value) <= F.col("__b")) & (F.col("__a") >= F.col(value))).drop("__b", "__a")


def lowest_minimum(acf: DataFrame, value: str = "value") -> DataFrame:
    """Lowest interior minimum of each series, the first among ties: (series_id, lag, acf_min), (-1, 0) unless below 0."""
    low = local_minima(acf, value).where(F.col(value) < 0).groupBy("series_id").agg(F.min(F.struct(F.col(value).alias("v"), F.col("t").alias("t"))).alias("m"))
    return acf.select("series_id").distinct().join(low, "series_id", "left").select("series_id", F.coalesce("m.t", F.lit(-1)).alias("lag"), F.coalesce("m.v", F.lit(0.0)).alias("acf_min"))


def acf_rows(df: DataFrame, width: int | None = 9, value: str = "value") -> DataFrame:
    """Autocorrelation by (series_id, t = lag), after smoothing."""
    y = gathered(df, value)
    y = y if width is None else y.select("series_id", smooth(F.col("y"), width).alias("y"))
    acf = autocorrelations(y)
    return acf.select("series_id", F.posexplode("acf").alias("t", "value"))


def oscillation_summary(df: DataFrame, dt: float, value: str = "value", absolute: bool = False) -> DataFrame:
    """Per series: lowest autocorrelation minimum, its lag, and frequency 1 / (2 * lag * dt), 0 without a minimum.

    A series with a NaN has NaN figures.
    """
    low = lowest_minimum(acf_rows(df, 9, value))
    failed = df.groupBy("series_id").agg(F.max(F.isnan(F.col(value).cast("double"))).alias("failed"))
    out = low.join(failed, "series_id").withColumn("frequency", F.when(F.col("lag") > 0, 1 / (2 * F.col("lag") * dt)).otherwise(0.0))
    nan = F.lit(float("nan"))
    size = F.abs("acf_min") if absolute else F.col("acf_min")
    return out.select("series_id", "lag", F.when(F.col("failed"), nan).otherwise(size).alias("acf_min"), F.when(F.col("failed"), nan).otherwise(F.col("frequency")).alias("frequency"))


def power_spectrum(df: DataFrame, n_freq: int, value: str = "value") -> DataFrame:
    """Normalised power of the first frequencies of each series, smoothed and centred; flat series have all mass at 0."""
    y = gathered(df, value).select("series_id", smooth(F.col("y")).alias("y"))

    def batch(parts):
        for pdf in parts:
            rows = []
            for name, y in zip(pdf["series_id"], pdf["y"]):
                x = np.asarray(y, float)
                power = np.abs(np.fft.rfft(x - x.mean())) ** 2 if len(x) else np.zeros(1)
                total = power.sum()
                share = power / total if total > 1e-12 else np.eye(1, len(power))[0]
                rows += [(name, k, float(s)) for k, s in enumerate(share[:n_freq])]
            yield pd.DataFrame(rows, columns=["series_id", "k", "power"])

    return y.mapInPandas(batch, "series_id string, k int, power double")


def dominant(df: DataFrame, by: str = "t", value: str = "value") -> DataFrame:
    """Values over their series' greatest, and the series with the greatest share at each time; the first among ties."""
    top = df.groupBy("series_id").agg(F.max(value).alias("top"))
    scaled = df.join(top, "series_id").withColumn("share", F.when(F.col("top") > 0, F.col(value) / F.col("top")).otherwise(0.0))
    best = scaled.groupBy(by).agg(F.min_by("series_id", F.struct((-F.col("share")).alias("s"), "series_id")).alias("dominant"), F.max("share").alias("share"))
    return best


def phase_portrait(df: DataFrame, id_col: str, vec_col: str, k: int = 2) -> DataFrame:
    """Projection of every vector on the first principal components; vectors are centred, as the projection isn't."""
    n = len(df.select(vec_col).first()[0])
    means = df.agg(F.array(*[F.avg(F.col(vec_col)[i]) for i in range(n)]).alias("__mean"))
    centred = df.crossJoin(F.broadcast(means)).select(id_col, array_to_vector(F.zip_with(F.col(vec_col).cast("array<double>"), "__mean", lambda a, b: a - b)).alias("__x"))  # a row of means
    model = PCA(k=k, inputCol="__x", outputCol="__pc").fit(centred)
    return model.transform(centred).select(id_col, *[vector_to_array("__pc")[i].alias(f"pc{i + 1}") for i in range(k)])


def align(df: DataFrame, names: DataFrame, length: int) -> DataFrame:
    """Every series of ``names`` on the full time grid, 0 where it has no value."""
    grid = names.select("series_id").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    return grid.join(df, ["series_id", "t"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
