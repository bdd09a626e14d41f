"""Searches and means drawn anew, without a row for each draw."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from circuitlens.functions.draws import index, uniform
from circuitlens.operators.scan import running_sums, value_bucket
from circuitlens.operators.search import stable_shuffle

#: Visits of one binomial draw; more are drawn in several.
DRAW = 256


def binomial_draw(n: Column, p: Column, u: Column) -> Column:
    """The binomial variate at ``u`` of [0, 1): the number of values whose distribution function is no greater; n up to DRAW."""
    start = F.struct(F.pow(1 - p, n).alias("term"), F.pow(1 - p, n).alias("upto"), F.lit(0).cast("bigint").alias("k"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * (n - i) / (i + 1) * p / (1 - p)
        return F.struct(term.alias("term"), (s["upto"] + term).alias("upto"), (s["k"] + F.when(s["upto"] <= u, 1).otherwise(0)).alias("k"))

    drawn = F.aggregate(F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>")), start, step)["k"]
    return F.when(p >= 1, n.cast("bigint")).when(p <= 0, F.lit(0).cast("bigint")).otherwise(drawn)


def sequential_search(q_table: DataFrame, steps: int, save_every: int, seed: str) -> DataFrame:
    """A search that visits all states in turn, in one shuffled order: its snapshots (step, state, position, visits, reward, q).

    Every step visits the next state and succeeds with the state's rate ``q``.
    A snapshot is taken every ``save_every`` steps and at the end, with
    all states; q is 0 where a state wasn't visited. Snapshots are nested: a
    state's rewards grow by a binomial draw over the visits since the one before,
    so visits and rewards never fall.

    No step is a row: visits follow from the state's position, and a state
    draws once for a snapshot (or for each ``DRAW`` visits). Null rates count as 0; states must be unique.
    """
    n = q_table.count()
    rows = stable_shuffle(q_table.select("state", F.coalesce(F.col("q").cast("double"), F.lit(0.0)).alias("q")), "state", seed)
    ends = [*range(save_every, steps, save_every), steps] if steps > 0 else []
    if not n or not ends:
        return rows.select(F.lit(0).cast("bigint").alias("step"), "state", "position", F.lit(0).cast("bigint").alias("visits"), F.lit(0).cast("bigint").alias("reward"), "q").limit(0)
    seen = lambda step: F.floor(step / n) + F.when(F.col("position") <= step % n, 1).otherwise(0)
    grid = rows.withColumn("end", F.explode(F.sequence(F.lit(1), F.lit(len(ends)))))  # a state's snapshots
    step = F.least(F.col("end") * save_every, F.lit(steps)).cast("bigint")
    grid = grid.withColumn("step", step).withColumn("visits", seen(F.col("step"))).withColumn("fresh", F.col("visits") - seen((F.col("end") - 1) * save_every))
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("fresh") - 1) / DRAW))
    draw = F.transform(chunks, lambda c: binomial_draw(F.least(F.col("fresh") - c * DRAW, F.lit(DRAW)), F.col("q"), uniform(seed, "state", "end", c)))
    gained = F.when(F.col("fresh") > 0, F.aggregate(draw, F.lit(0).cast("bigint"), lambda s, x: s + x)).otherwise(F.lit(0).cast("bigint"))
    whole = grid.groupBy("state", "position").agg(F.array_sort(F.collect_list(F.struct("step", "visits", gained.alias("gained")))).alias("s"))
    summed = F.aggregate("s", F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<struct<step:bigint,visits:bigint,reward:bigint>>").alias("out")),
                         lambda a, x: F.struct((a["total"] + x["gained"]).alias("total"), F.concat(a["out"], F.array(F.struct(x["step"].alias("step"), x["visits"].alias("visits"), (a["total"] + x["gained"]).alias("reward")))).alias("out")))
    out = whole.select("state", "position", F.explode(summed["out"]).alias("o")).select("o.step", "state", "position", "o.visits", "o.reward")
    return out.withColumn("q", F.when(F.col("visits") > 0, F.col("reward") / F.col("visits")).otherwise(0.0))


#: Distinct values of a group that one task adds up (a larger group is dealt out in pieces), tasks that pieces and groups are dealt to, rows put out at once.
PIECE, TASKS, HELD = 4096, 256, 256


def _added(batches: Iterable[pa.RecordBatch], add: Callable[[str, dict], np.ndarray]) -> Iterator[tuple[str, np.ndarray]]:
    """Sums over the rows of each key, which stand together: one key is held at a time."""
    key, held = None, None
    for batch in batches:
        for slice_at in range(0, batch.num_rows, HELD):
            for row in batch.slice(slice_at, HELD).to_pylist():
                if row["key"] != key and held is not None:
                    yield key, held
                    held = None
                more = add(row["key"], row)
                key, held = row["key"], more if held is None else held + more
    if held is not None:
        yield key, held


def _packed(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == HELD:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _weighted(n: int, seed: str):
    schema = pa.schema([("key", pa.string()), ("totals", pa.list_(pa.float64())), ("weights", pa.list_(pa.float64()))])

    def add(key: str, row: dict) -> np.ndarray:
        draws = np.random.Generator(np.random.Philox(key=int(hashlib.md5(f"{seed}|{key}|{row['value']!r}".encode()).hexdigest(), 16)))
        weights = draws.poisson(row["copies"], n)
        return np.array([weights * row["value"], weights])

    def weighted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(((key, *both) for key, both in _added(batches, add)), schema)

    return weighted


def _ends(level: float):
    schema = pa.schema([("key", pa.string()), ("ci_low", pa.float64()), ("ci_high", pa.float64()), ("se", pa.float64())])

    def end(key: str, both: np.ndarray) -> tuple:
        means = np.sort(both[0][both[1] > 0] / both[1][both[1] > 0])
        if not len(means):
            return key, None, None, None
        places = np.array([(1 - level) / 2, (1 + level) / 2]) * (len(means) - 1)
        low, high = np.floor(places).astype(int), np.ceil(places).astype(int)
        cut = np.where(low == high, means[low], (high - places) * means[low] + (places - low) * means[high])
        return key, float(cut[0]), float(cut[1]), float(np.std(means, ddof=1)) if len(means) > 1 else None

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed((end(key, both) for key, both in _added(batches, lambda _, row: np.array([row["totals"], row["weights"]]))), schema)

    return ends


def bootstrap_mean(df: DataFrame, by: Sequence[str], value: str, level: float = 0.95, n: int = 200, seed: str = "boot") -> DataFrame:
    """Mean of each group with its bootstrap interval and standard error: (by, n, mean, ci_low, ci_high, se).

    A replicate weighs each row by a Poisson variate of mean 1, a value that
    comes c times by one of mean c: so draws are made for each distinct value and replicate.
    A group's values come in order and are added up one by one, those of a group of more than
    ``PIECE`` in pieces, so a task holds the replicates of one group. Weights are a function of
    seed, group and value. Replicates without weight are left out (a group of one row has 37 % of
    them). Null and NaN values don't count; groups without any other are left out. Null keys are a group.
    """
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("__value")).agg(F.count("*").alias("__copies"))
    key = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(by)]), {"ignoreNullFields": "false"})
    keyed = counts.select(key.alias("key"), F.col("__value").alias("value"), F.col("__copies").alias("copies"))
    pieces = keyed.groupBy("key").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    dealt = keyed.join(pieces, "key").select("key", F.pmod(F.xxhash64("value"), "pieces").alias("piece"), "value", "copies").repartition(TASKS, "key", "piece").sortWithinPartitions("key", "piece", "value")
    sums = dealt.select("key", "value", "copies").mapInArrow(_weighted(n, seed), "key string, totals array<double>, weights array<double>")
    ends = sums.repartition(TASKS, "key").sortWithinPartitions("key").mapInArrow(_ends(level), "key string, ci_low double, ci_high double, se double")
    groups = counts.groupBy(*by).agg(F.sum("__copies").alias("n"), (F.sum(F.col("__value") * F.col("__copies")) / F.sum("__copies")).alias("mean")).withColumn("key", key)
    return groups.join(ends, "key", "left").select(*by, "n", "mean", "ci_low", "ci_high", "se")


def batch_metrics(df: DataFrame, by: str, runtime: str, rate: str, size: int, n: int, thresholds: Sequence[float], seed: str, order: Sequence[str]) -> DataFrame:
    """Runtime and sampling rate of batches of ``size`` runs drawn with replacement, for each cut-off of the reaction rate.

    Returns (by, threshold, batches, runtime_*, sampling_*), each with mean, sd (of a whole population), median, low,
    high, q5 and q95. A batch takes as long as its slowest run; runs with a rate above the
    cut-off are stopped at once and take no time. Batches of such runs alone don't count. The sampling rate is in runs
    a minute. The same ``n`` batches serve all cut-offs. Runs are numbered in order of runtime and ``order``.
    """
    runs = df.select(by, F.col(runtime).cast("double").alias("__time"), F.col(rate).cast("double").alias("__rate"), *order).where(F.col("__time").isNotNull())
    numbered = running_sums(runs, [by], ["__time", *order], {"i": F.lit(1)}, value_bucket(runs, "__time")).select(by, "__time", "__rate", (F.col("i") - 1).alias("i"))
    draws = runs.groupBy(by).agg(F.count("*").alias("n")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(size))))
    drawn = draws.select(by, "b", index(seed, F.col("n"), by, "b", "k").alias("i")).join(numbered, [by, "i"])
    slowest = drawn.groupBy(by, "b").agg(*[F.max(F.when(F.col("__rate") <= t, F.col("__time"))).alias(f"t{i}") for i, t in enumerate(thresholds)])
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("runtime"), (size * 60.0 / F.col(f"t{i}")).alias("sampling")) for i, t in enumerate(thresholds)])
    long = slowest.select(by, F.explode(each).alias("e")).select(by, "e.*").where("runtime is not null")
    stats = []
    for c in ("runtime", "sampling"):
        stats += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd"), F.percentile(c, 0.5).alias(f"{c}_median"), F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high"), F.percentile(c, 0.05).alias(f"{c}_q5"), F.percentile(c, 0.95).alias(f"{c}_q95")]
    return long.groupBy(by, "threshold").agg(F.count("*").alias("batches"), *stats)
