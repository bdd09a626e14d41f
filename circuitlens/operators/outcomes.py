"""Operators on tables of simulation outcomes: flags, cleaning, joins, success rates and fault tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from circuitlens.operators.scan import running_sums, value_bucket

#: A sample oscillated if its autocorrelation minimum lies below this.
OSCILLATION = -0.4
TIMED_OUT = (1.0, -1.0)


def flag_outcomes(samples: DataFrame, threshold: float = OSCILLATION) -> DataFrame:
    """Flags per joined sample: oscillated (strictly below), has_mutation, and both. Null figures give null flags."""
    mutated = F.col("component_mutation") != "(none)"
    return samples.withColumns({"oscillated": F.col("acf_min") < threshold, "has_mutation": mutated}).withColumn("oscillated_mutated", F.col("oscillated") & F.col("has_mutation"))


def normalize_columns(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Rename legacy columns if they are there and their new names aren't."""
    for old, new in (names or {"visit": "param_idx", "param_index": "param_idx", "autocorr_min": "acf_min"}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def clean_samples(samples: DataFrame) -> DataFrame:
    """Complete, finite samples; NaN marks a failed run and the sentinel a timed-out one."""
    good = ~F.isnan("acf_min") & ~F.isnan("sim_time") & ~((F.col("acf_min") == TIMED_OUT[0]) & (F.col("sim_time") == TIMED_OUT[1]))
    return samples.dropna(subset=["state", "acf_min", "sim_time"]).where(good)


def is_valid(acf_min: Column, sim_time: Column) -> Column:
    return F.coalesce((acf_min <= 0) & (sim_time >= 0) & ~F.isnan(acf_min), F.lit(False))


def retry_list(samples: DataFrame) -> DataFrame:
    """Samples to run again, failed or missing, recoded to the sentinel."""
    bad = F.col("acf_min").isNull() | F.isnan("acf_min") | (F.col("acf_min") > 0)
    return samples.where(bad).withColumns({"acf_min": F.lit(TIMED_OUT[0]), "sim_time": F.lit(TIMED_OUT[1])})


def batch_reward(samples: DataFrame, by: Sequence[str], reward: Column) -> DataFrame:
    """Mean reward of a batch over the runs that are no failure; null, and so a retry, if all failed."""
    usable = F.when(~F.isnan("acf_min"), reward.cast("double"))
    return samples.groupBy(*by).agg(F.count("*").alias("runs"), F.count(usable).alias("usable"), F.avg(usable).alias("reward"))


def join_params(samples: DataFrame, params: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Samples with some attributes of their parameter set; Spark broadcasts the parameters if they are small."""
    return samples.join(params.select("param_idx", *columns), "param_idx")


def route(samples: DataFrame, threshold: float = OSCILLATION) -> DataFrame:
    """The output a row belongs to: failed, oscillating or quiet."""
    kind = F.when(F.col("acf_min").isNull() | F.isnan("acf_min"), "failed").when(F.col("acf_min") < threshold, "oscillating").otherwise("quiet")
    return samples.withColumn("route", kind)


def q_values(samples: DataFrame, success: Column, by: str = "state") -> DataFrame:
    """Success rate per state."""
    return samples.groupBy(by).agg(F.count("*").alias("visits"), F.avg(success.cast("double")).alias("q"))


def robustness(flagged: DataFrame, min_q: float = 0.0, min_visits: int = 0) -> DataFrame:
    """Counts per state: visits, oscillating, mutated and both; states with enough visits and rate only."""
    counts = flagged.groupBy("state").agg(F.count("*").alias("visits"), F.count_if("oscillated").alias("n_osc"), F.count_if("has_mutation").alias("n_mut"), F.count_if("oscillated_mutated").alias("n_osc_mut"))
    return counts.where((F.col("n_osc") >= min_q * F.col("visits")) & (F.col("visits") >= min_visits))


def fault_tolerance(counts: DataFrame) -> DataFrame:
    """Success rate with and without mutation, their standard errors and their ratio; null where undefined."""
    plain = F.col("visits") - F.col("n_mut")
    q_wt = F.when(plain > 0, (F.col("n_osc") - F.col("n_osc_mut")) / plain)
    q_mut = F.when(F.col("n_mut") > 0, F.col("n_osc_mut") / F.col("n_mut"))
    out = counts.withColumns({"q_wt": q_wt, "q_mut": q_mut})
    se = lambda q, n: F.when(n > 0, F.sqrt(q * (1 - q) / n))
    out = out.withColumns({"se_wt": se(F.col("q_wt"), plain), "se_mut": se(F.col("q_mut"), F.col("n_mut"))})
    return out.withColumn("tolerance", F.when(F.col("q_wt") > 0, F.col("q_mut") / F.col("q_wt")))


def samples_of_successes(samples: DataFrame, success: Column, min_q: float) -> DataFrame:
    """Samples of the states whose success rate reaches ``min_q``."""
    good = q_values(samples, success).where(F.col("q") >= min_q)
    return samples.join(good, "state", "left_semi")


def lookup(df: DataFrame, first: DataFrame, second: DataFrame, key: str, middle: str, value: str, default: float) -> DataFrame:
    """Look ``key`` up in ``first`` (key, middle), that in ``second`` (middle, value); ``default`` where absent."""
    found = df.join(first, key, "left").join(second, middle, "left")
    return found.withColumn(value, F.coalesce(value, F.lit(default)))


def common_successes(samples: DataFrame, states: DataFrame, success: Column) -> DataFrame:
    """Parameter sets that succeed for all given states, best first: relational division."""
    good = samples.where(success).join(states, "state", "left_semi")
    per = good.groupBy("param_idx").agg(F.countDistinct("state").alias("n_states"), F.min("acf_min").alias("best"))
    total = states.agg(F.countDistinct("state").alias("total"))
    return per.join(total, F.col("n_states") == F.col("total")).drop("total")


def tolerance_join(left: DataFrame, right: DataFrame, key: str, column: str, id_col: str, rtol: float = 1e-5, atol: float = 1e-8, width: float = 1.0) -> DataFrame:
    """Rows of ``right`` with the same key and |right - left| <= atol + rtol * |left|: (left row, n_matches, match).

    The value is bucketed by ``width`` on both sides and ``left`` meets only
    the buckets that its tolerance reaches, so the join stays an equi-join. ``match`` is null
    unless exactly one row matches.
    """
    tol = F.lit(atol) + F.lit(rtol) * F.abs(F.col(column))
    bucket = lambda c: F.floor(c / width)
    reached = left.withColumn("__b", F.explode(F.sequence(bucket(F.col(column) - tol), bucket(F.col(column) + tol)))).withColumn("__tol", tol)
    other = right.select(F.col(key), F.col(column).alias("__v"), F.col(id_col).alias("__id"), bucket(F.col(column)).alias("__b"))
    hits = reached.join(other, [key, "__b"]).where(F.abs(F.col("__v") - F.col(column)) <= F.col("__tol"))
    found = hits.groupBy(*left.columns).agg(F.count("*").alias("n_matches"), F.min("__id").alias("match"))
    return found.withColumn("match", F.when(F.col("n_matches") == 1, F.col("match")))


def fallback_lookup(left: DataFrame, right: DataFrame, id_col: str, columns: Sequence[str], value: str) -> DataFrame:
    """The value of the one row of ``right`` that a column identifies, columns tried in order; null if none does."""
    out = left.select(id_col, *columns)
    names = []
    for k, c in enumerate(columns):
        unique = right.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("__n"), F.min(value).alias(f"__{k}")).where("__n = 1").drop("__n")
        out = out.join(unique, c, "left")
        names.append(f"__{k}")
    return out.select(id_col, F.coalesce(*names).alias(value))


def nearest(grid: DataFrame, rows: DataFrame, grid_col: str, value_col: str, id_col: str, width: float) -> DataFrame:
    """For every grid value the row with the nearest value, the least id among ties.

    Only each distinct value's least id can win, and of these only the two
    neighbours of a grid value: both tables are cut into ranges of ``width``,
    each range hands its own greatest and least value to the next ones that
    need them (a window over ranges, not rows), and the rest is an equi-join.
    """
    tagged = rows.where(F.col(value_col).isNotNull()).groupBy(F.col(value_col).alias("v")).agg(F.min(id_col).alias("id")).withColumn("b", F.floor(F.col("v") / width))
    ranges = tagged.groupBy("b").agg(F.min(F.struct("v", "id")).alias("low"), F.max(F.struct("v", F.col("id").alias("id"))).alias("high"))
    wanted = grid.select(F.col(grid_col).alias("g")).distinct().withColumn("b", F.floor(F.col("g") / width))
    bins = ranges.select("b").union(wanted.select("b")).distinct().join(ranges, "b", "left")
    w = Window.orderBy("b")
    near = bins.select("b", F.last("high", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("below"), F.first("low", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("above"))
    ends = wanted.join(near, "b").select("g", F.explode(F.array_compact(F.array("below", "above"))).alias("one")).select("g", "one.v", "one.id")
    inside = wanted.join(tagged, "b").select("g", "v", "id")
    best = ends.union(inside).groupBy("g").agg(F.min(F.struct(F.abs(F.col("v") - F.col("g")).alias("gap"), "id", "v")).alias("best"))
    return best.select(F.col("g").alias(grid_col), F.col("best.id").alias(id_col), F.col("best.v").alias(value_col), F.col("best.gap").alias("gap"))


def merge_samples(base: DataFrame, incoming: DataFrame, mode: str, keys: Sequence[str] = ("state", "param_idx")) -> DataFrame:
    """Restore a sample table: ``full`` replaces it, ``partial`` adds what is absent, ``update`` overwrites.

    ``incoming`` should have one row a key.
    """
    if mode == "full":
        return incoming
    if mode == "partial":
        return base.unionByName(incoming.join(base, list(keys), "left_anti"))
    if mode == "update":
        return base.join(incoming, list(keys), "left_anti").unionByName(incoming)
    raise ValueError(f"no such mode: {mode}")


def exclusion_curve(df: DataFrame, value: str, thresholds: Sequence[float]) -> DataFrame:
    """Fraction of rows above each cut-off: rows fall into the interval between cut-offs, then counts are summed up."""
    cuts = sorted(thresholds)
    place = sum((F.when(F.col(value) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    counts = df.where(F.col(value).isNotNull()).groupBy(place.alias("place")).agg(F.count("*").alias("n"))
    spread = counts.select("n", F.explode(F.array(*[F.struct(F.lit(float(c)).alias("threshold"), F.lit(k).alias("k")) for k, c in enumerate(cuts)])).alias("c"), "place")
    return spread.groupBy(F.col("c.threshold").alias("threshold")).agg((F.sum(F.when(F.col("place") > F.col("c.k"), F.col("n")).otherwise(0)) / F.sum("n")).alias("excluded"))


def quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles per group."""
    return df.groupBy(*by).agg(*[F.percentile(value, q).alias(f"q{round(100 * q)}") for q in qs])


def top_flag(df: DataFrame, value: str, share: float = 0.01) -> DataFrame:
    """Whether a row's value lies above the interpolated quantile that leaves ``share`` above it (``is_top``); null where the value is."""
    cut_off = df.agg(F.percentile(value, 1 - share).alias("__cut"))
    return df.crossJoin(F.broadcast(cut_off)).withColumn("is_top", F.col(value) > F.col("__cut")).drop("__cut")  # one number


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("low"), F.percentile(v, 0.25).alias("q25"), F.percentile(v, 0.5).alias("q50"), F.percentile(v, 0.75).alias("q75"), F.max(v).alias("high"))


def histogram2d(df: DataFrame, x: str, y: str, bins: int, log_x: bool = False, log_y: bool = False) -> DataFrame:
    """Counts in ``bins`` by ``bins`` equal cells between the extremes, on linear or log axes; the top edge is in the last cell."""
    ax = F.log10(x) if log_x else F.col(x).cast("double")
    ay = F.log10(y) if log_y else F.col(y).cast("double")
    pts = df.select(ax.alias("x"), ay.alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    ends = pts.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    cell = lambda c: F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col(f"lo{c}")) / ((F.col(f"hi{c}") - F.col(f"lo{c}")) / bins)).cast("int"))
    return pts.crossJoin(F.broadcast(ends)).groupBy(cell("x").alias("bx"), cell("y").alias("by")).agg(F.count("*").alias("n"))  # one row of extremes


def corner_histograms(df: DataFrame, columns: Sequence[str], bins: int, by: str | None = None, log: Sequence[str] = ()) -> DataFrame:
    """Histograms of all columns and of all pairs of them, for all rows or by class: (class, x, y, bx, by, n).

    A column's cells are ``bins`` equal ones between its extremes over all classes, on a log axis
    for those in ``log`` (values of 0 and less are left out there); the top edge is in the last cell, and a
    constant column has cell 0 only. Pairs come once, in the order of ``columns``; a row with x = y is
    the histogram of one column. Null and NaN values are left out of the histograms of their column. Empty
    cells have no row.

    One pass finds the extremes; in another each row becomes a small array of
    cells, which is counted by one aggregation.
    """
    axis = {c: F.when(F.col(c) > 0, F.log10(c)) if c in log else F.col(c).cast("double") for c in columns}
    points = df.select(*[F.when(~F.isnan(a), a).alias(f"v{i}") for i, a in enumerate(axis.values())], (F.col(by).cast("string") if by else F.lit("all")).alias("class"))
    ends = points.agg(*[f(f"v{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("lo", F.min), ("hi", F.max))])
    cell = [F.when(F.col(f"v{i}").isNotNull() & (F.col(f"hi{i}") > F.col(f"lo{i}")), F.least(F.lit(bins - 1), F.floor((F.col(f"v{i}") - F.col(f"lo{i}")) / ((F.col(f"hi{i}") - F.col(f"lo{i}")) / bins)).cast("int"))).when(F.col(f"v{i}").isNotNull(), 0) for i in range(len(columns))]
    placed = points.crossJoin(F.broadcast(ends)).select("class", *[c.alias(f"b{i}") for i, c in enumerate(cell)])  # one row of extremes
    cells = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"b{i}").alias("bx"), F.col(f"b{j}").alias("by")) for i, x in enumerate(columns) for j, y in enumerate(columns) if i <= j])
    out = placed.select("class", F.explode(cells).alias("c")).where("c.bx is not null and c.by is not null")
    return out.groupBy("class", "c.x", "c.y", "c.bx", "c.by").agg(F.count("*").alias("n"))


def ecdf(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Empirical distribution per group: for each distinct value the share of rows that are no greater.

    Counts of distinct values are summed up range by range, so equal values travel once
    and no task orders all values of a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    sizes = counts.groupBy(*[F.col(c).alias(f"__own_{c}") for c in by]).agg(F.sum("__n").alias("__all"))
    upto = running_sums(counts, by, [value], {"__upto": F.col("__n")}, value_bucket(counts, value))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__own_{c}"))
    return upto.join(sizes, same).select(*by, value, (F.col("__upto") / F.col("__all")).alias("ecdf"))


def safe_log10(c: Column, floor: float) -> Column:
    return F.when(c > 0, F.log10(c)).otherwise(F.lit(floor))


def log_normalize(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """log10(value) over log10(greatest value) of the group, 0 where unvisited or missing."""
    top = df.groupBy(*by).agg(F.max(value).alias("__top"))
    joined = df.join(top, list(by)) if by else df.crossJoin(F.broadcast(top))
    v = F.coalesce(value, F.lit(0))
    return joined.withColumn("traffic", F.when((v > 0) & (F.col("__top") > 1), F.log10(v) / F.log10("__top")).otherwise(0.0)).drop("__top")
