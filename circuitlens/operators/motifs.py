"""Motif statistics: containment joins, contingency tables, odds ratios, tests and set combinations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, permutations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from circuitlens.functions import genotype as G
from circuitlens.functions.tails import chi2_sf
from circuitlens.operators.scan import running_sums, value_bucket


#: Patterns (a few numbers each) that may be broadcast; more meet circuits in an inverted index.
BROADCAST_ROWS = 50_000


def mask(ixns: Column, names: str) -> Column:
    """Interactions as bits of a number: source, target and sign; up to five components."""
    codes = [a + b + s for a in names for b in names for s in "ai"]
    return sum((F.when(F.array_contains(ixns, code), F.lit(1 << k)).otherwise(0) for k, code in enumerate(codes)), F.lit(0)).cast("bigint")


def pattern_containment(circuits: DataFrame, patterns: DataFrame, names: str = "ABC", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs (state, pattern) of distinct circuits and the patterns that they contain under some relabelling.

    Circuits and relabelled patterns are bit masks, tested by ``mask & p = p``
    against the counted list of patterns. A list that is too long to be
    broadcast becomes an inverted index: patterns are rows of (pattern,
    relabelling, interaction), circuits rows of (state, interaction), and a
    relabelling is contained if all of its interactions are met. The empty
    pattern is contained in every circuit.
    """
    own = G.interactions(F.col("pattern"))
    orders = ["".join(p) for p in permutations(names)]
    known = patterns.select("pattern").distinct()
    states = circuits.select("state").distinct()
    if known.count() <= broadcast_rows:
        masks = known.select("pattern", *[mask(G.relabel(own, names, p), names).alias(f"__p{k}") for k, p in enumerate(orders)])
        met = F.lit(False)
        for k in range(len(orders)):
            met = met | (F.col("__mask").bitwiseAND(F.col(f"__p{k}")) == F.col(f"__p{k}"))
        coded = states.select("state", mask(G.interactions(F.col("state")), names).alias("__mask"))
        return coded.join(F.broadcast(masks), met).select("state", "pattern")
    labelled = known.select("pattern", F.explode(F.array_distinct(F.array(*[G.relabel(own, names, p) for p in orders]))).alias("ixns"))
    index = labelled.select("pattern", "ixns", F.size("ixns").alias("need"), F.explode("ixns").alias("ixn"))
    parts = states.select("state", F.explode(G.interactions(F.col("state"))).alias("ixn"))
    met = parts.join(index, "ixn").groupBy("state", "pattern", "ixns", "need").agg(F.count("*").alias("n")).where("n = need")
    empty = known.where(F.size(own) == 0).crossJoin(states).select("state", "pattern")  # one pattern at most
    return met.select("state", "pattern").distinct().unionByName(empty)


def contingency(q_table: DataFrame, pairs: DataFrame, success: Column, exclude_self: bool = True) -> DataFrame:
    """Cells per pattern: with it and without it, among successful circuits and among all (the null set).

    With ``exclude_self`` the circuit that is the pattern itself counts in neither. States and patterns must be
    canonical forms (``canonical_state``), as a relabelled twin of the pattern would count.
    """
    marked = q_table.select("state", success.cast("int").alias("ok"))
    total = marked.agg(F.count("*").alias("n_all"), F.sum("ok").alias("n_ok"))
    counts = F.col("state") != F.col("pattern") if exclude_self else F.lit(True)
    cells = pairs.join(marked, "state").groupBy("pattern").agg(
        F.sum("ok").alias("all_in_succ"), F.count("*").alias("all_in_null"), F.sum(F.when(counts, F.col("ok")).otherwise(0)).alias("pattern_in_succ"), F.count_if(counts).alias("pattern_in_null")
    )
    joined = cells.crossJoin(F.broadcast(total))  # a row of totals
    return joined.select("pattern", "pattern_in_succ", (F.col("n_ok") - F.col("all_in_succ")).alias("others_in_succ"), "pattern_in_null", (F.col("n_all") - F.col("all_in_null")).alias("others_in_null"))


def odds_ratio(df: DataFrame, level: float = 0.95, cells: Sequence[str] = ("pattern_in_succ", "others_in_succ", "pattern_in_null", "others_in_null")) -> DataFrame:
    """Odds ratio ad / bc (inf where bc = 0) with a log-normal interval (NaN where a cell is 0)."""
    a, b, c, d = (F.col(x).cast("double") for x in cells)
    z = NormalDist().inv_cdf(0.5 + level / 2)
    ratio = F.when(b * c == 0, F.lit(float("inf"))).otherwise(a * d / (b * c))
    zero = (a == 0) | (b == 0) | (c == 0) | (d == 0)
    half = z * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    nan = F.lit(float("nan"))
    return df.withColumns({"odds_ratio": ratio, "ci_low": F.when(zero, nan).otherwise(F.exp(F.log(ratio) - half)), "ci_high": F.when(zero, nan).otherwise(F.exp(F.log(ratio) + half))})


def chi2_yates(df: DataFrame, cells: Sequence[str] = ("pattern_in_succ", "others_in_succ", "pattern_in_null", "others_in_null")) -> DataFrame:
    """Statistic of independence with the continuity correction; 0 where a margin is empty."""
    a, b, c, d = (F.col(x).cast("double") for x in cells)
    n, margins = a + b + c + d, (a + b) * (c + d) * (a + c) * (b + d)
    excess = F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2)
    return df.withColumn("chi2", F.when(margins > 0, n * excess * excess / margins).otherwise(0.0))


def with_p_values(df: DataFrame) -> DataFrame:
    """p-value and its Bonferroni correction, which isn't capped at 1."""
    tests = df.agg(F.count("*").alias("__tests"))
    out = df.crossJoin(F.broadcast(tests)).withColumn("pvalue", chi2_sf(F.col("chi2")))  # a row of totals
    return out.withColumn("p_corrected", F.col("pvalue") * F.col("__tests")).drop("__tests")


def testable(q_table: DataFrame, pairs: DataFrame, success: Column, least: int = 5) -> DataFrame:
    """Patterns that more than ``least`` successful circuits contain and whose own circuit had more than ``least`` successes."""
    good = pairs.join(q_table.where(success).select("state"), "state", "left_semi").groupBy("pattern").agg(F.count("*").alias("n_matches"))
    own = q_table.select(F.col("state").alias("pattern"), F.round(F.col("q") * F.col("visits")).cast("bigint").alias("n_success"))
    return good.join(own, "pattern").where((F.col("n_matches") > least) & (F.col("n_success") > least))


def verdict(df: DataFrame, alpha: float = 0.05, sufficient: Column | None = None) -> DataFrame:
    """Significance stars and the verdict: sufficient, significant and over-represented.

    A pattern seen in neither set is not over-represented; one unseen in the
    null set counts as significant if it was seen at all.
    """
    p = F.col("p_corrected")
    stars = F.when(p < 0.0001, "****").when(p < 0.001, "***").when(p < 0.01, "**").when(p < alpha, "*").otherwise("ns")
    unseen = (F.col("pattern_in_succ") == 0) & (F.col("pattern_in_null") == 0)
    over = F.when(unseen, False).otherwise(F.col("odds_ratio") > 1)
    significant = F.when(F.col("pattern_in_null") == 0, F.col("pattern_in_succ") > 0).otherwise(p < alpha)
    out = df.withColumns({"stars": stars, "overrepresented": over, "significant": significant, "sufficient": F.lit(True) if sufficient is None else sufficient})
    return out.withColumn("motif", F.col("sufficient") & F.col("significant") & F.col("overrepresented"))


def venn_counts(q_table: DataFrame, flags: dict[str, Column], success: Column) -> DataFrame:
    """Circuits and successes of each exclusive combination of motifs, none included."""
    return q_table.select(*[f.alias(n) for n, f in flags.items()], success.alias("__ok")).groupBy(*flags).agg(F.count("*").alias("n"), F.count_if("__ok").alias("n_success"))


def motif_combinations(q_table: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Circuits per subset of motifs, every subset listed, empty ones with 0."""
    names = list(flags)
    subsets = ["+".join(c) or "(none)" for k in range(len(names) + 1) for c in combinations(names, k)]
    listed = q_table.sparkSession.createDataFrame([(x,) for x in subsets], "combination string")  # 2 ** motifs rows
    counts = q_table.groupBy(G.motif_label(flags).alias("combination")).agg(F.count("*").alias("n"))
    return listed.join(counts, "combination", "left").select("combination", F.coalesce("n", F.lit(0)).alias("n"))


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """U for every pair of groups: (g1, g2, n1, n2, u1), pairs with g1 < g2.

    Ranks aren't taken over rows but over the distinct values of each pair of
    groups: counts per (group, value) are summed up, so ties cost one row.
    """
    counts = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    groups = counts.groupBy("g").agg(F.sum("c").alias("n"))
    pairs = groups.select(F.col("g").alias("g1"), F.col("n").alias("n1")).join(groups.select(F.col("g").alias("g2"), F.col("n").alias("n2")), F.col("g1") < F.col("g2"))
    one = pairs.join(counts, F.col("g1") == F.col("g")).select("g1", "g2", "v", F.col("c").alias("c1"), F.lit(0).cast("bigint").alias("c2"))
    two = pairs.join(counts, F.col("g2") == F.col("g")).select("g1", "g2", "v", F.lit(0).cast("bigint").alias("c1"), F.col("c").alias("c2"))
    both = one.unionByName(two).groupBy("g1", "g2", "v").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    below = F.sum("c2").over(Window.partitionBy("g1", "g2").orderBy("v")) - F.col("c2")
    u = both.withColumn("wins", F.col("c1") * (below + F.col("c2") / 2)).groupBy("g1", "g2").agg(F.sum("wins").alias("u1"))
    return u.join(pairs, ["g1", "g2"])


def prob_less_than(df: DataFrame, group: str, value: str, less: str, than: str) -> DataFrame:
    """P(x < y) for x of group ``less`` and y of group ``than``: one row, from counts of distinct values in order."""
    u = mann_whitney_counts(df, group, value, less, than)
    return u.select((F.col("wins") / (F.col("nx") * F.col("ny"))).alias("p_less"))


def mann_whitney_counts(df: DataFrame, group: str, value: str, less: str, than: str) -> DataFrame:
    x, y = (F.sum(F.when(F.col(group) == g, 1).otherwise(0)) for g in (less, than))
    counts = df.where(F.col(group).isin(less, than) & F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(x.alias("x"), y.alias("y"))
    upto = running_sums(counts, [], ["v"], {"upto": F.col("x")}, value_bucket(counts, "v"))
    return upto.agg(F.sum((F.col("upto") - F.col("x")) * F.col("y")).alias("wins"), F.sum("x").alias("nx"), F.sum("y").alias("ny"))
