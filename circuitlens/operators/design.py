"""Design and resampling jobs: parameter tables, bootstrap draws, outcome codes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from circuitlens.functions.digests import digits, equal_digits, heads, padded
from circuitlens.functions.draws import index, uniform

#: Ranges of the eight sampled quantities, by name.
RANGES: dict[str, tuple[float, float]] = {
    "log10_kd_1": (-2.0, 4.0), "kd_2_1_ratio": (0.0, 0.25), "km_unbound": (0.0, 1.0), "km_act": (1.0, 10.0),
    "nlog10_km_rep_unbound_ratio": (0.0, 5.0), "kp": (0.015, 0.25), "gamma_m": (0.001, 0.1), "gamma_p": (0.001, 0.1),
}
#: Fixed value: the sum of the association rate and the first dissociation rate.
RATE_SUM = 100.0


def to_params(df: DataFrame) -> DataFrame:
    """Rate parameters of sampled quantities: k_on and k_off_1 have a fixed sum and the dissociation constant for their ratio.

    The activated-and-repressed rate lies at the unbound one.
    """
    kd = F.pow(F.lit(10.0), F.col("log10_kd_1"))
    out = df.withColumn("k_off_1", RATE_SUM * kd / (1 + kd))
    out = out.withColumn("k_on", RATE_SUM - F.col("k_off_1")).withColumn("k_off_2", F.col("k_off_1") * F.col("kd_2_1_ratio"))
    return out.withColumns({"km_rep": F.col("km_unbound") * F.pow(F.lit(10.0), -F.col("nlog10_km_rep_unbound_ratio")), "km_act_rep": F.col("km_unbound")})


def to_sampled(df: DataFrame) -> DataFrame:
    """Sampled quantities of rate parameters; null where a ratio's base is 0."""
    over = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    return df.withColumns({"log10_kd_1": F.log10(over("k_off_1", "k_on")), "kd_2_1_ratio": over("k_off_2", "k_off_1"), "nlog10_km_rep_unbound_ratio": -F.log10(over("km_rep", "km_unbound"))})


def normalize(c: Column, low: float, high: float) -> Column:
    return (c - low) / (high - low)


def rescale(u: Column, low: float, high: float) -> Column:
    return u * (high - low) + low


def latin_hypercube(ids: DataFrame, id_col: str, n: int, dims: Sequence[str], seed: str) -> DataFrame:
    """A uniform per dimension, one in each of ``n`` equal strata; strata are dealt by the order of a hash.

    Positions are numbered within ranges of the hash, after the counts of the
    ranges before, so no task orders all rows.
    """
    out = ids.select(id_col)
    for dim in dims:
        key = F.md5(F.concat_ws("|", F.lit(f"{seed}.{dim}"), F.col(id_col).cast("string")))
        marked = out.withColumn("__h", key).withColumn("__r", F.substring("__h", 1, 2))
        starts = marked.groupBy("__r").agg(F.count("*").alias("__n")).withColumn("__s", F.sum("__n").over(Window.orderBy("__r")) - F.col("__n")).select("__r", "__s")  # 256 rows at most
        place = F.row_number().over(Window.partitionBy("__r").orderBy("__h", id_col)) - 1
        out = marked.withColumn("__k", place).join(F.broadcast(starts), "__r").withColumn(dim, (F.col("__s") + F.col("__k") + uniform(f"{seed}.{dim}.jitter", id_col)) / n).drop("__h", "__r", "__k", "__s")
    return out


def poisson(u: Column, mean: float, most: int = 40) -> Column:
    """Inverse of the Poisson distribution, up to ``most``."""
    total, term, count = 0.0, exp(-mean), F.lit(0)
    for k in range(most):
        total += term
        term *= mean / (k + 1)
        count = count + F.when(u >= total, 1).otherwise(0)
    return count


def param_design(ids: DataFrame, id_col: str, n: int, components: str, p_mutation: float, seed: str) -> DataFrame:
    """Parameter sets: a hypercube over the sampled quantities, initial counts, and a mutated component for some."""
    cube = latin_hypercube(ids, id_col, n, list(RANGES), seed)
    scaled = cube.withColumns({d: rescale(F.col(d), *RANGES[d]) for d in RANGES})
    counts = {f"{c}_0": poisson(uniform(f"{seed}.{c}", id_col), 10.0) for c in components}
    u = uniform(f"{seed}.mutation", id_col)
    share = p_mutation / len(components)
    mutation = F.lit("(none)")
    for k, c in enumerate(components):
        mutation = F.when((u >= k * share) & (u < (k + 1) * share), c).otherwise(mutation)
    return to_params(scaled).withColumns(counts | {"component_mutation": mutation})


def sequential_resample(q_table: DataFrame, visits: int, seed: str) -> DataFrame:
    """Each state visited ``visits`` times, rewards drawn by its rate: (state, visits, reward, q)."""
    drawn = q_table.select("state", "q", F.explode(F.sequence(F.lit(1), F.lit(visits))).alias("visit"))
    hit = (uniform(seed, "state", "visit") < F.col("q")).cast("int")
    return drawn.groupBy("state").agg(F.count("*").alias("visits"), F.sum(hit).alias("reward")).withColumn("q", F.col("reward") / F.col("visits"))


def binomial_rewards(states: DataFrame, rates: DataFrame, batch: int, seed: str) -> DataFrame:
    """Share of successes in a batch of draws per state; an unknown state's rate is 0."""
    known = states.select("state").distinct().join(rates.select("state", "q"), "state", "left").withColumn("q", F.coalesce("q", F.lit(0.0)))
    drawn = known.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(batch))))
    return drawn.groupBy("state").agg(F.avg((uniform(seed, "state", "k") < F.col("q")).cast("double")).alias("reward"))


def bootstrap_rewards(samples: DataFrame, reward: Column, size: int, seed: str, order: Sequence[str]) -> DataFrame:
    """Mean of ``size`` rewards drawn with replacement from a state's runs that are no failure.

    Runs are numbered per state and draws meet them in a join on (state, number).
    """
    good = samples.where(~F.isnan("acf_min")).withColumn("reward", reward.cast("double"))
    numbered = good.select("state", "reward", (F.row_number().over(Window.partitionBy("state").orderBy(*order)) - 1).cast("bigint").alias("i"))
    draws = good.groupBy("state").agg(F.count("*").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(size)))).select("state", index(seed, F.col("n"), "state", "k").alias("i"))
    return draws.join(numbered, ["state", "i"]).groupBy("state").agg(F.avg("reward").alias("reward"))


def batch_bootstrap(df: DataFrame, by: str, value: str, size: int, n: int, cutoff: float, seed: str, order: Sequence[str]) -> DataFrame:
    """Batches of ``size`` rows drawn with replacement: a batch takes as long as its slowest row below the cut-off.

    Returns per group the mean, sd, median and extremes of a batch's runtime.
    """
    kept = df.where(F.col(value) <= cutoff)
    numbered = kept.select(by, value, (F.row_number().over(Window.partitionBy(by).orderBy(value, *order)) - 1).cast("bigint").alias("i"))
    groups = kept.groupBy(by).agg(F.count("*").alias("n"))
    draws = groups.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(size))))
    drawn = draws.select(by, "b", index(seed, F.col("n"), by, "b", "k").alias("i")).join(numbered, [by, "i"])
    batches = drawn.groupBy(by, "b").agg(F.max(value).alias("t"))
    return batches.groupBy(by).agg(F.avg("t").alias("mean"), F.stddev_samp("t").alias("sd"), F.percentile("t", 0.5).alias("median"), F.min("t").alias("low"), F.max("t").alias("high"), F.percentile("t", 0.05).alias("q5"), F.percentile("t", 0.95).alias("q95"))


#: Distinct values of a group that are looked up in a list, draws of one replicate that make a row, tasks that they are dealt to, draws hashed at once.
LISTED, SPAN, TASKS, AT_ONCE = 4096, 20_000, 256, 32_768


def _drawn(head: bytes, low: int, high: int, size: int, n: int, upto: np.ndarray) -> np.ndarray:
    """How often each place of ``upto`` is drawn in each of ``n`` replicates by the draws ``low`` to ``high`` of ``index(seed, size, by, b, k)``."""
    counts = np.zeros(n * len(upto), np.int64)
    step = max(1, AT_ONCE // n)
    for first in range(low, high + 1, step):
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for ks in equal_digits(first, min(first + step - 1, high)):
            for bs in equal_digits(1, n):
                parts = [np.broadcast_to(np.frombuffer(head, np.uint8), (len(bs), len(ks), len(head))), digits(bs)[:, None, :].repeat(len(ks), 1), np.full((len(bs), len(ks), 1), ord("|"), np.uint8), np.broadcast_to(digits(ks), (len(bs), len(ks), len(str(ks[0]))))]
                texts = np.concatenate(parts, axis=2)
                rows = padded(texts.reshape(-1, texts.shape[2]))
                found.setdefault(rows.shape[1], []).append((rows, (bs - 1).repeat(len(ks))))
        for pieces in found.values():
            place = np.floor(heads(np.concatenate([rows for rows, _ in pieces])) / 4294967296.0 * size).astype(np.int64)
            counts += np.bincount(np.concatenate([b for _, b in pieces]) * len(upto) + np.searchsorted(upto, place, "right"), minlength=len(counts))
    return counts.reshape(n, len(upto))


def _replicates(n: int, seed: str):
    def replicates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rest = batch.column(0), batch.drop_columns([batch.schema.names[0]]).to_pylist()
            for at, row in enumerate(rest):
                values = np.array(row["values"])
                counts = _drawn(f"{seed}|{row['key']}|".encode(), row["low"], row["high"], row["n"], n, np.cumsum(row["counts"]))
                totals = np.where(counts > 0, counts * np.where(counts > 0, values, 0.0), 0.0).sum(axis=1)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([at] * n)), pa.array(np.arange(1, n + 1, dtype=np.int32)), pa.array(totals), pa.array(np.full(n, row["n"], np.int64))], names=[batch.schema.names[0], "b", "total", "n"])

    return replicates


def _numbers(first: Column, last: Column) -> Column:
    """Whole numbers in two steps, so that no row holds all: an array of the starts of spans, to be exploded and filled up by ``_span``."""
    return F.explode(F.sequence(first, last, F.lit(SPAN).cast("bigint")))


def _span(start: str, last: Column) -> Column:
    return F.explode(F.sequence(F.col(start), F.least(F.col(start) + SPAN - 1, last)))


def bootstrap_ci(df: DataFrame, by: str, value: str, level: float, n: int, seed: str) -> DataFrame:
    """Interval of a group's mean over ``n`` bootstrap replicates.

    Draws are over the distinct values of a group, weighted by how often they
    occur: a draw is a place among the group's rows in order of value, found
    by the running counts. A group of up to ``LISTED`` distinct values carries them as
    a list, and the draws of a span are made and looked up in the task, so that
    no draw is a row. In other groups draws meet the places of the values in a join.
    """
    counts = df.where(F.col(value).isNotNull() & F.col(by).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    sizes = counts.groupBy(by).agg(F.sum("c").alias("n"), F.count("*").alias("d"))

    listed = counts.join(sizes.where(F.col("d") <= LISTED), by).groupBy(by, "n").agg(F.array_sort(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), "c"))).alias("l"))
    spans = listed.withColumn("low", _numbers(F.lit(1).cast("bigint"), F.col("n"))).withColumn("high", F.least(F.col("low") + SPAN - 1, F.col("n"))).repartition(TASKS, by, "low")
    rows = spans.select(by, F.col(by).cast("string").alias("key"), "n", "low", "high", F.transform("l", lambda x: x["v"]).alias("values"), F.transform("l", lambda x: x["c"]).alias("counts"))
    totals = rows.mapInArrow(_replicates(n, seed), T.StructType([df.schema[by], T.StructField("b", T.IntegerType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())]))
    means = totals.groupBy(by, "b").agg((F.sum("total") / F.max("n")).alias("m"))

    many = counts.join(sizes.where(F.col("d") > LISTED).select(by, "n"), by)
    upto = many.withColumn("upto", F.sum("c").over(Window.partitionBy(by).orderBy(value))).withColumn("from", F.col("upto") - F.col("c"))
    draws = sizes.where(F.col("d") > LISTED).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("low", _numbers(F.lit(1).cast("bigint"), F.col("n"))).withColumn("k", _span("low", F.col("n")))
    draws = draws.select(by, "b", index(seed, F.col("n"), by, "b", "k").alias("i"))
    places = upto.withColumn("low", _numbers(F.col("from"), F.col("upto") - 1)).select(by, F.col(value).cast("double").alias("v"), _span("low", F.col("upto") - 1).alias("i"))
    joined = draws.join(places, [by, "i"]).groupBy(by, "b").agg(F.avg("v").alias("m"))
    return means.unionByName(joined).groupBy(by).agg(F.percentile("m", (1 - level) / 2).alias("ci_low"), F.percentile("m", (1 + level) / 2).alias("ci_high"))


def knockdown_design(params: DataFrame, components: str, coefficients: Sequence[float], rates: Sequence[str]) -> DataFrame:
    """Per parameter set, component and coefficient: the component's transcription rates scaled by it."""
    grid = F.explode(F.array(*[F.struct(F.lit(c).alias("tf"), F.lit(float(k)).alias("coeff")) for c in components for k in coefficients]))
    return params.withColumn("d", grid).select(*params.columns, "d.tf", "d.coeff").withColumns({r: F.col(r) * F.col("coeff") for r in rates})


def _truncated(location: pd.Series, u: pd.Series, sigma: pd.Series) -> pd.Series:
    from statistics import NormalDist

    d, out = NormalDist(), []
    for x, p, s in zip(location, u, sigma):
        if s < 1e-12:
            out.append(x)
            continue
        low, high = d.cdf((0 - x) / s), d.cdf((1 - x) / s)
        out.append(min(1.0, max(0.0, x + s * d.inv_cdf(min(max(low + p * (high - low), 1e-15), 1 - 1e-15)))))
    return pd.Series(out, dtype=float)


def perturb(df: DataFrame, columns: dict[str, tuple[float, float]], sigma: float, seed: str, id_col: str) -> DataFrame:
    """Columns jittered by a normal deviate truncated to their ranges, in unit space; no jitter leaves them as they are."""
    draw = F.pandas_udf(_truncated, T.DoubleType())
    moved = {c: rescale(draw(normalize(F.col(c), *r), uniform(f"{seed}.{c}", id_col), F.lit(float(sigma))), *r) for c, r in columns.items()}
    return df.withColumns(moved)


def canonical_outcome(column: str, depth: int) -> Column:
    """A tree's leaves in canonical order: sibling blocks sorted from the bottom up."""
    code = F.col(column)
    for level in range(1, depth + 1):
        half = 2 ** (level - 1)
        blocks = []
        for k in range(2 ** (depth - level)):
            a, b = F.substring(code, 2 * half * k + 1, half), F.substring(code, 2 * half * k + half + 1, half)
            blocks += [F.least(a, b), F.greatest(a, b)]
        code = F.concat(*blocks)
    return code


def hamming(a: Column, b: Column) -> Column:
    """Places in which two codes of equal length differ."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, v: s + v)


def sorted_outcome(code: Column) -> Column:
    return F.array_join(F.array_sort(F.split(code, "")), "")


def outcome_design(codes: DataFrame, depth: int, swaps: int, seed: str) -> DataFrame:
    """Outcome codes with ``swaps`` successes and failures of the sorted layout exchanged, canonical and distinct.

    The places are those whose hashes come first among the successes, and
    among the failures, of the code.
    """
    size = 2**depth
    places = codes.select("code", F.posexplode(F.split(sorted_outcome(F.col("code")), "")).alias("place", "digit")).where(F.col("place") < size)
    order = F.row_number().over(Window.partitionBy("code", "digit").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "code", F.col("place").cast("string"))), "place"))
    both = F.least(F.count_if(F.col("digit") == "1").over(Window.partitionBy("code")), F.count_if(F.col("digit") == "0").over(Window.partitionBy("code")))
    moved = places.withColumns({"k": order, "most": both}).withColumn("new", F.when(F.col("k") <= F.least(F.lit(swaps), F.col("most")), F.when(F.col("digit") == "1", "0").otherwise("1")).otherwise(F.col("digit")))
    joined = moved.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "new"))), lambda p: p["new"]), "").alias("outcome"))
    return joined.select(canonical_outcome("outcome", depth).alias("outcome")).distinct()


def design_grid(df: DataFrame, **dims: Sequence) -> DataFrame:
    """Every row with every combination of the values of small dimensions."""
    for name, values in dims.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return df


def perturb_params(params: DataFrame, sigma: float, seed: str, id_col: str, m: int = 1) -> DataFrame:
    """``m`` perturbed versions (``replicate`` from 0) of every set of rate parameters.

    The eight sampled quantities are jittered in unit space by normal deviates
    truncated to their ranges, and the rates computed anew. Without
    jitter (below 1e-12) the parameters stay as they are.
    """
    copies = params.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    if sigma < 1e-12:
        return copies
    sampled = to_sampled(copies).withColumn("__key", F.concat_ws("|", F.col(id_col).cast("string"), F.col("replicate").cast("string")))
    moved = to_params(perturb(sampled, RANGES, sigma, seed, "__key"))
    return moved.select(*params.columns, "replicate")
