"""Search analytics: regret, running rates, discovery, ranks and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from circuitlens.operators.scan import running_sums, step_bucket, top_rows


def _so_far(by: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def regret(log: DataFrame, best: float = 1.0, by: Sequence[str] = ("replicate",)) -> DataFrame:
    """Cumulative regret, the sum of best - reward up to a step, and the straight line of the replicate's mean."""
    means = log.groupBy(*by).agg(F.avg("reward").alias("__mean"))
    out = running_sums(log, by, ["step"], {"regret": F.lit(best) - F.col("reward")}, step_bucket())
    return out.join(means, list(by)).withColumn("naive", (F.lit(best) - F.col("__mean")) * F.col("step")).drop("__mean")


def running_q(log: DataFrame) -> DataFrame:
    """Visits, reward and success rate of the step's state up to the step."""
    w = _so_far(["replicate", "state"], ["step"])
    out = log.withColumns({"cum_visits": F.count("*").over(w), "cum_reward": F.sum("reward").over(w)})
    return out.withColumn("cum_q", F.col("cum_reward") / F.col("cum_visits"))


def running_success_count(log: DataFrame, threshold: float) -> DataFrame:
    """Number of states whose success rate lies above the threshold after every step.

    Only the step's own state changes, so the set's size is the running sum of
    its entries and exits: the state's flag now less its flag before.
    """
    return running_sums(_moves(log, threshold), ["replicate"], ["step"], {"n_above": F.col("delta")}, step_bucket())


def _moves(log: DataFrame, threshold: float) -> DataFrame:
    """The log with 1 where the step's state gets above the threshold, -1 where it falls back to it, else 0 (``delta``)."""
    visits, reward = F.col("cum_visits") - 1, F.col("cum_reward") - F.col("reward")
    before = F.when(visits > 0, (reward / visits > threshold).cast("int")).otherwise(0)
    flagged = running_q(log).withColumn("above", (F.col("cum_q") > threshold).cast("int"))
    return flagged.withColumn("delta", F.col("above") - before)


def running_top_overlap(log: DataFrame, threshold: float, truth: DataFrame, n: int) -> DataFrame:
    """How many of the ``n`` truly best states (``true_q``, first by name among equals) lie above the threshold after every step."""
    best = top_rows(truth.select("state", "true_q"), "true_q", "state", n).select("state", F.lit(1).alias("__best"))
    moved = _moves(log, threshold).join(best, "state", "left")
    return running_sums(moved, ["replicate"], ["step"], {"n_overlap": F.col("delta") * F.coalesce("__best", F.lit(0))}, step_bucket()).drop("__best")


def running_distinct(log: DataFrame) -> DataFrame:
    """Number of distinct states visited up to every step."""
    first = (F.row_number().over(Window.partitionBy("replicate", "state").orderBy("step")) == 1).cast("int")
    return running_sums(log.withColumn("first", first), ["replicate"], ["step"], {"n_seen": F.col("first")}, step_bucket()).drop("first")


def round_robin(df: DataFrame, size: int, by: str = "state", order: Sequence[str] = ("step",)) -> DataFrame:
    """Batch number of every row: its place in its group, divided by the batch size."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))


def rank_states(df: DataFrame, value: str, by: Sequence[str], tie: str) -> DataFrame:
    """Rank from the greatest value down: average rank of ties cut to an integer, and an ordinal rank."""
    w = Window.partitionBy(*by)
    ties = F.count("*").over(Window.partitionBy(*by, value))
    average = (F.rank().over(w.orderBy(F.desc(value))) + (ties - 1) / 2).cast("int")
    return df.withColumns({"rank_avg": average, "rank_ord": F.row_number().over(w.orderBy(F.desc(value), tie))})


def level_breaks(df: DataFrame, level: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Whether a row's level differs from that of the row before; False for the first."""
    before = F.lag(level).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("is_break", F.coalesce(F.col(level) != before, F.lit(False)))


def flag_group_min(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.withColumn("is_min", F.col(value) == F.min(value).over(Window.partitionBy(by)))


def chunk_steps(df: DataFrame, by: Sequence[str], end: str, order: Sequence[str]) -> DataFrame:
    """Step number of a row from the end step of its chunk and its place in it."""
    w = Window.partitionBy(*by, end)
    return df.withColumn("global_step", F.col(end) - F.count("*").over(w) + F.row_number().over(w.orderBy(*order)))


def assign_param(log: DataFrame, n: int, seed: str) -> DataFrame:
    """Parameter index of every visit: the state's own shuffle of 0 to n - 1, used round and round."""
    place = F.pmod(F.row_number().over(Window.partitionBy("replicate", "state").orderBy("step")) - 1, F.lit(n))
    visits = log.withColumn("place", place)
    index = log.select("state").distinct().withColumn("param_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    order = F.md5(F.concat_ws("|", F.lit(seed), "state", F.col("param_index").cast("string")))
    shuffled = index.withColumn("place", F.row_number().over(Window.partitionBy("state").orderBy(order, "param_index")) - 1)
    return visits.join(shuffled, ["state", "place"])


def union_tagged(tables: dict[str, DataFrame], tag: str) -> DataFrame:
    """All rows of the tables, each with its table's name; columns go by name."""
    tagged = [table.withColumn(tag, F.lit(name)) for name, table in tables.items()]
    out = tagged[0]
    for one in tagged[1:]:
        out = out.unionByName(one)
    return out


def class_share(log: DataFrame, label: Column, width: Column) -> DataFrame:
    """Share of every class within bins of ``width`` steps; the shares of a bin sum to 1."""
    cell = F.floor((F.col("step") - 1) / width).cast("int")
    counts = log.groupBy(cell.alias("bin"), label.alias("class")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("bin")))


def top_n(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def best_row(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The best row of each group: highest reward, then rate, then shortest and first state; no sort of groups."""
    key = F.struct((-F.col("reward")).alias("r"), (-F.col("q")).alias("q"), F.length("state").alias("len"), F.col("state").alias("s"))
    best = F.min_by(F.struct(*[c for c in df.columns if c not in by]), key)
    return df.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def snapshot_summary(snapshots: DataFrame) -> DataFrame:
    """Total reward, and the best state, of each replicate and step."""
    totals = snapshots.groupBy("replicate", "step").agg(F.sum("reward").alias("cum_reward"))
    best = best_row(snapshots.select("replicate", "step", "state", "visits", "reward", "q"), ["replicate", "step"])
    return totals.join(best, ["replicate", "step"]).withColumnsRenamed({"state": "best_state", "reward": "highest_reward", "q": "best_q"})


def discovery_quality(snapshots: DataFrame, truth: DataFrame, found_q: float, true_q: float) -> DataFrame:
    """Precision, recall and false-positive rate of each replicate and step: found are states at or above ``found_q``."""
    marked = snapshots.join(truth, "state").withColumns({"found": F.col("q") >= found_q, "good": F.col("true_q") >= true_q})
    total = truth.agg(F.count_if(F.col("true_q") >= true_q).alias("n_good"), F.count_if(F.col("true_q") < true_q).alias("n_bad"))
    counts = marked.groupBy("replicate", "step").agg(F.count_if(F.col("found") & F.col("good")).alias("tp"), F.count_if(F.col("found") & ~F.col("good")).alias("fp"))
    rate = lambda a, b: F.when(b > 0, a / b)
    tp, fp = F.col("tp"), F.col("fp")
    return counts.crossJoin(F.broadcast(total)).select("replicate", "step", rate(tp, tp + fp).alias("precision"), rate(tp, F.col("n_good")).alias("recall"), rate(fp, F.col("n_bad")).alias("fpr"))  # a row of totals


def discovery_bands(snapshots: DataFrame, truth: DataFrame, found_q: float, true_q: float, share: float = 0.1) -> DataFrame:
    """How precision and recall develop over the replicates: (step, metric, mean, q05, q50, q95, n).

    Metrics are ``precision`` and ``recall`` of the truly good states (``true_q``
    at least the bound), and ``top_precision`` and ``top_recall`` of the best ``share`` of them:
    their number is rounded down, and of equal states at the cut the first by name are in. Found are
    states with a rate of ``found_q`` or more. ``n`` counts the replicates: a
    replicate that has found nothing has no precision and isn't counted there, as recall isn't where no state is
    good.
    """
    good = truth.where(F.col("true_q") >= true_q).select("state", "true_q")
    n_good = good.count()
    n_top = int(n_good * share)
    top = top_rows(good, "true_q", "state", n_top).select("state", F.lit(True).alias("top")) if n_top else good.select("state", F.lit(True).alias("top")).limit(0)
    marked = snapshots.join(good.select("state", F.lit(True).alias("good")), "state", "left").join(top, "state", "left")
    found = F.col("q") >= found_q
    counts = marked.groupBy("replicate", "step").agg(F.count_if(found).alias("found"), *[F.count_if(found & F.coalesce(c, F.lit(False))).alias(f"n_{c}") for c in ("good", "top")])
    rate = lambda a, b: F.when(b > 0, a / b)
    metrics = {"precision": rate(F.col("n_good"), F.col("found")), "recall": rate(F.col("n_good"), F.lit(n_good)), "top_precision": rate(F.col("n_top"), F.col("found")), "top_recall": rate(F.col("n_top"), F.lit(n_top))}
    long = counts.select("step", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), c.alias("value")) for k, c in metrics.items()])).alias("m")).select("step", "m.*")
    return long.groupBy("step", "metric").agg(F.avg("value").alias("mean"), *[F.percentile("value", p / 100).alias(f"q{p:02d}") for p in (5, 50, 95)], F.count("value").alias("n"))


def discovery_by_state(snapshots: DataFrame, truth: DataFrame, found: Column, n_replicates: int) -> DataFrame:
    """Share of replicates that hold a state for found at their last snapshot, for every state of ``truth``: (state, true_q, rate)."""
    last = snapshots.groupBy("replicate").agg(F.max("step").alias("step"))
    held = snapshots.where(found).join(last, ["replicate", "step"], "left_semi").groupBy("state").agg((F.countDistinct("replicate") / F.lit(n_replicates)).alias("rate"))
    return truth.select("state", "true_q").join(held, "state", "left").na.fill(0.0, ["rate"])


def top_found(snapshots: DataFrame, truth: DataFrame, n: int, least_payout: int) -> DataFrame:
    """How many of the ``n`` truly best states have paid at least ``least_payout``, by replicate and step."""
    best = top_rows(truth.select("state", "true_q"), "true_q", "state", n).select("state", F.lit(1).alias("best"))
    return snapshots.join(best, "state", "left").groupBy("replicate", "step").agg(F.count_if((F.col("best") == 1) & (F.col("reward") >= least_payout)).alias("n_top_found"))


def discovery_rate(snapshots: DataFrame, found: Column, n_replicates: int) -> DataFrame:
    """Share of replicates that have found a state, by state and step."""
    return snapshots.where(found).groupBy("state", "step").agg((F.countDistinct("replicate") / F.lit(n_replicates)).alias("rate"))


def explore_exploit(snapshots: DataFrame, winners: DataFrame, least_visits: int, least_payout: int) -> DataFrame:
    """Per replicate and step: states explored, winners among the well-paid states, and total successes."""
    marked = snapshots.join(winners.select("state", F.lit(True).alias("winner")), "state", "left")
    return marked.groupBy("replicate", "step").agg(F.count_if(F.col("visits") >= least_visits).alias("explored"), F.count_if(F.coalesce("winner", F.lit(False)) & (F.col("reward") >= least_payout)).alias("winners_found"), F.sum("reward").alias("successes"))


def snapshot_table(nodes: DataFrame, truth: DataFrame) -> DataFrame:
    """Reward, visits, rate (0 when unvisited) and true rate of each state."""
    q = F.when(F.col("visits") > 0, F.col("reward") / F.col("visits")).otherwise(0.0)
    return nodes.withColumn("q", q).join(truth, "state", "left")


def pattern_consensus(df: DataFrame, n: int) -> DataFrame:
    """Per pattern over replicates: how often true, mean and spread of the rate, share of replicates."""
    return df.groupBy("pattern").agg(F.count_if("is_motif").alias("n_true"), F.avg("q").alias("mean_q"), F.stddev_samp("q").alias("sd_q"), (F.countDistinct("replicate") / F.lit(n)).alias("share"))


def pattern_summary(df: DataFrame, n: int) -> DataFrame:
    """``pattern_consensus`` with the first replicate that has the pattern and its rate there."""
    first = df.groupBy("pattern").agg(F.min("replicate").alias("first_replicate"), F.min_by("q", "replicate").alias("first_q"))
    return pattern_consensus(df, n).join(first, "pattern")


def linear_grid(df: DataFrame, step: str, points: int) -> DataFrame:
    """Rows on a linear grid of ``points`` steps from the first to the last, rounded to whole steps and each once."""
    ends = df.agg(F.min(step).alias("low"), F.max(step).alias("high"))
    at = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    grid = ends.where("low is not null").select("low", "high", at.alias("k")).select(F.round(F.col("low") + F.col("k") * (F.col("high") - F.col("low")) / max(1, points - 1)).cast("bigint").alias(step)).distinct()
    return df.join(F.broadcast(grid), step, "left_semi")  # ``points`` numbers


def stable_shuffle(df: DataFrame, key: str, seed: str) -> DataFrame:
    """Position of every row in a reproducible shuffle, by ranges of the hash, so no task sorts all rows.

    Rows are dealt by the first two hex digits of the hash; positions are
    numbered within each of these 256 ranges after the counts of those before.
    """
    marked = df.withColumn("__h", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))).withColumn("__range", F.substring("__h", 1, 2))
    counts = marked.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = counts.withColumn("__start", F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).select("__range", "__start")  # 256 rows at most
    place = F.row_number().over(Window.partitionBy("__range").orderBy("__h", key))
    return marked.withColumn("__k", place).join(F.broadcast(starts), "__range").withColumn("position", F.col("__start") + F.col("__k")).select(*df.columns, "position")


def top_share(df: DataFrame, value: str, tie: str, p: float) -> DataFrame:
    """The floor(p * rows) rows with the greatest values."""
    n = int(df.count() * p)
    return top_rows(df, value, tie, n) if n else df.limit(0)


def pick_group(df: DataFrame, group: str, seed: str) -> DataFrame:
    """All rows of one group, picked by hash."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col(group).cast("string")))
    picked = df.groupBy(F.lit(1).alias("one")).agg(F.min_by(group, F.struct(key, F.col(group))).alias(group)).select(group)
    return df.join(picked, group, "left_semi")
