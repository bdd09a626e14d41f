"""Queries on designs, resampling and posteriors."""

from __future__ import annotations

from math import exp

from pyspark.sql import functions as F

from circuitlens.functions import genotype as G
from circuitlens.operators import design as D, motifs as M, statistics as B
from circuitlens.plans import views as V

QUERIES, ORACLES = {}, {}
r6 = lambda c: F.round(c, 6)
S, Q, BIN = V.ctes("samples"), V.ctes("circuits", "q_table"), V.ctes("bincodes")
R = V.ctes("runtime")


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def u(seed: str, *keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', " + ", ".join(keys) + ")), 1, 8))::BIGINT / 4294967296.0)"


SAMPLED = "SELECT s_suppkey, s_acctbal / 2500.0 AS log10_kd_1, (s_suppkey % 25) / 100.0 AS kd_2_1_ratio, 0.05 + (s_suppkey % 90) / 100.0 AS km_unbound, (s_suppkey % 50) / 10.0 AS nlog10_km_rep_unbound_ratio FROM {supplier}"


@query("param_transform", f"WITH s AS ({SAMPLED.format(supplier='supplier')}), p AS (SELECT *, 100 * pow(10.0, log10_kd_1) / (1 + pow(10.0, log10_kd_1)) AS k_off_1, 100 / (1 + pow(10.0, log10_kd_1)) AS k_on, 100 * pow(10.0, log10_kd_1) / (1 + pow(10.0, log10_kd_1)) * kd_2_1_ratio AS k_off_2, km_unbound * pow(10.0, -nlog10_km_rep_unbound_ratio) AS km_rep FROM s) SELECT s_suppkey, round(k_on, 6) AS k_on, round(k_off_1, 6) AS k_off_1, round(k_off_2, 6) AS k_off_2, round(km_rep, 6) AS km_rep, round(log10_kd_1, 6) AS back_kd, round(kd_2_1_ratio, 6) AS back_ratio, round((log10_kd_1 + 2) / 6, 6) AS unit_kd FROM p")
def param_transform(spark, d):
    s = spark.sql(SAMPLED, supplier=V.table(spark, d, "supplier"))
    p = D.to_params(s)
    back = D.to_sampled(p.drop("log10_kd_1", "kd_2_1_ratio", "nlog10_km_rep_unbound_ratio"))
    return back.select("s_suppkey", *[r6(c).alias(c) for c in ("k_on", "k_off_1", "k_off_2", "km_rep")], r6("log10_kd_1").alias("back_kd"), r6("kd_2_1_ratio").alias("back_ratio"), r6(D.normalize(F.col("log10_kd_1"), -2.0, 4.0)).alias("unit_kd"))


@query("bin_codes", BIN + " SELECT p_partkey, outcome, ('0b' || outcome)::INT AS number, CAST(list_sum(list_transform(string_split(outcome, ''), lambda x: x::INT)) AS BIGINT) AS n_success, array_to_string(list_filter(range(8), lambda i: substr(outcome, i::INT + 1, 1) = '1'), ',') AS places FROM bincodes")
def bin_codes(spark, d):
    ones = F.filter(F.transform(F.split("outcome", ""), lambda x, i: F.when(x == "1", i)), lambda v: v.isNotNull())
    return V.bincodes(spark, d).select("p_partkey", "outcome", F.conv("outcome", 2, 10).cast("int").alias("number"), F.size(ones).cast("bigint").alias("n_success"), F.array_join(ones.cast("array<string>"), ",").alias("places"))


def _canon(code: str, depth: int) -> str:
    steps = [f"c0 AS (SELECT DISTINCT {code} AS outcome, {code} AS c FROM bincodes)"]
    for level in range(1, depth + 1):
        h = 2 ** (level - 1)
        parts = " || ".join(f"least(substr(c, {2 * h * k + 1}, {h}), substr(c, {2 * h * k + h + 1}, {h})) || greatest(substr(c, {2 * h * k + 1}, {h}), substr(c, {2 * h * k + h + 1}, {h}))" for k in range(2 ** (depth - level)))
        steps.append(f"c{level} AS (SELECT outcome, {parts} AS c FROM c{level - 1})")
    return ", ".join(steps)


@query("canonical_outcome", f"{BIN}, {_canon('outcome', 3)} SELECT outcome, c AS canonical FROM c3")
def canonical_outcome(spark, d):
    return V.bincodes(spark, d).select("outcome").distinct().withColumn("canonical", D.canonical_outcome("outcome", 3))


@query("hamming", f"{BIN}, s AS (SELECT DISTINCT outcome, array_to_string(list_sort(string_split(outcome, '')), '') AS sorted FROM bincodes) SELECT p_partkey, outcome, hamming(outcome, sorted)::INT AS n_swaps FROM bincodes JOIN s USING (outcome)")
def hamming(spark, d):
    codes = V.bincodes(spark, d)
    distinct = codes.select("outcome").distinct().withColumn("n_swaps", D.hamming(F.col("outcome"), D.sorted_outcome(F.col("outcome"))))
    return codes.select("p_partkey", "outcome").join(distinct, "outcome")


@query("design_grid", "SELECT n_nationkey, tf, coeff, r::INT AS replicate FROM nation CROSS JOIN (SELECT unnest(['A', 'B', 'C']) AS tf) CROSS JOIN (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS coeff) CROSS JOIN (SELECT unnest(range(2)) AS r) x")
def design_grid(spark, d):
    return D.design_grid(V.table(spark, d, "nation").select("n_nationkey"), tf=["A", "B", "C"], coeff=[0.25, 0.5, 0.75], replicate=[0, 1])


DIMS = ("log10_kd_1", "kd_2_1_ratio")


def _poisson_steps(mean: float = 10.0, most: int = 40) -> list[float]:
    """Values of the distribution function at 0, 1, ..."""
    total, term, steps = 0.0, exp(-mean), []
    for k in range(most):
        total += term
        steps.append(total)
        term *= mean / (k + 1)
    return steps


@query("param_design", "WITH n AS (SELECT s_suppkey AS id, count(*) OVER () AS n FROM supplier), l AS (SELECT id, " + ", ".join(f"(row_number() OVER (ORDER BY md5(concat_ws('|', 'd1.{x}', id)), id) - 1 + {u(f'd1.{x}.jitter', 'id')}) / n AS {x}" for x in DIMS) + f", {u('d1.A', 'id')} AS ua, {u('d1.mutation', 'id')} AS um FROM n) SELECT id, round(100 * pow(10.0, log10_kd_1 * 6 - 2) / (1 + pow(10.0, log10_kd_1 * 6 - 2)), 6) AS k_off_1, round(kd_2_1_ratio * 0.25, 6) AS kd_2_1_ratio, ({' + '.join(f'(ua >= {t!r})::INT' for t in _poisson_steps())})::INT AS \"A_0\", CASE WHEN um < 0.1 THEN 'A' WHEN um < 0.2 THEN 'B' WHEN um < 0.3 THEN 'C' ELSE '(none)' END AS component_mutation FROM l")
def param_design(spark, d):
    ids = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return D.param_design(ids, "id", ids.count(), "ABC", 0.3, "d1").select("id", r6("k_off_1").alias("k_off_1"), r6("kd_2_1_ratio").alias("kd_2_1_ratio"), "A_0", "component_mutation")


@query("sequential_resample", f"{Q}, d AS (SELECT state, q, unnest(range(1, 51)) AS k FROM q_table) SELECT state, count(*) AS visits, sum(({u('seq', 'state', 'k')} < q)::INT)::BIGINT AS reward, round(avg(({u('seq', 'state', 'k')} < q)::INT), 6) AS q FROM d GROUP BY state")
def sequential_resample(spark, d):
    return D.sequential_resample(V.q_table(spark, d), 50, "seq").withColumn("q", r6("q"))


@query("binomial_rewards", f"{Q}, d AS (SELECT state, CASE WHEN visits >= 3 THEN q ELSE 0 END AS q, unnest(range(1, 21)) AS k FROM q_table) SELECT state, round(avg(({u('bin', 'state', 'k')} < q)::INT), 6) AS reward FROM d GROUP BY state")
def binomial_rewards(spark, d):
    q = V.q_table(spark, d)
    return D.binomial_rewards(q, q.where("visits >= 3"), 20, "bin").withColumn("reward", r6("reward"))


NUMBERED = "row_number() OVER (PARTITION BY state ORDER BY l_orderkey, l_linenumber, l_extendedprice, param_idx) - 1 AS i"


@query("bootstrap_rewards", f"{S}, g AS (SELECT state, CASE WHEN acf_min < -0.4 THEN 1.0 ELSE 0.0 END AS reward, {NUMBERED} FROM samples WHERE sim_time <> 1), c AS (SELECT state, count(*) AS n FROM g GROUP BY state), k AS (SELECT state, n, unnest(range(1, 31)) AS k FROM c), e AS (SELECT state, CAST(floor({u('boot', 'state', 'k')} * n) AS BIGINT) AS i FROM k) SELECT state, round(avg(reward), 6) AS reward FROM e JOIN g USING (state, i) GROUP BY state")
def bootstrap_rewards(spark, d):
    s = V.samples(spark, d).withColumn("acf_min", F.when(F.col("sim_time") == 1, F.lit(float("nan"))).otherwise(F.col("acf_min")))
    return D.bootstrap_rewards(s, F.col("acf_min") < -0.4, 30, "boot", ["l_orderkey", "l_linenumber", "l_extendedprice", "param_idx"]).withColumn("reward", r6("reward"))


@query("batch_bootstrap", f"{R}, g AS (SELECT complexity, runtime_secs, row_number() OVER (PARTITION BY complexity ORDER BY runtime_secs, o_orderkey) - 1 AS i FROM runtime WHERE runtime_secs <= 400), c AS (SELECT complexity, count(*) AS n FROM g GROUP BY 1), e AS (SELECT complexity, b, CAST(floor({u('bb', 'complexity', 'b', 'k')} * n) AS BIGINT) AS i FROM c, (SELECT unnest(range(1, 201)) AS b), (SELECT unnest(range(1, 11)) AS k)), t AS (SELECT complexity, b, max(runtime_secs) AS t FROM e JOIN g USING (complexity, i) GROUP BY ALL) SELECT complexity, round(avg(t), 6) AS mean, round(stddev_samp(t), 6) AS sd, round(quantile_cont(t, 0.5), 6) AS median, round(min(t), 6) AS low, round(max(t), 6) AS high, round(quantile_cont(t, 0.05), 6) AS q5, round(quantile_cont(t, 0.95), 6) AS q95 FROM t GROUP BY complexity")
def batch_bootstrap(spark, d):
    out = D.batch_bootstrap(V.runtime(spark, d), "complexity", "runtime_secs", 10, 200, 400.0, "bb", ["o_orderkey"])
    return out.select("complexity", *[r6(c).alias(c) for c in ("mean", "sd", "median", "low", "high", "q5", "q95")])


@query("bootstrap_ci", f"{S}, c AS (SELECT param_idx, acf_min, row_number() OVER (PARTITION BY param_idx ORDER BY acf_min) - 1 AS i, count(*) OVER (PARTITION BY param_idx) AS n FROM samples), z AS (SELECT DISTINCT param_idx, n FROM c), e AS (SELECT param_idx, b, CAST(floor({u('ci', 'param_idx', 'b', 'k')} * n) AS BIGINT) AS i FROM (SELECT param_idx, n, b, unnest(range(1, n + 1)) AS k FROM z, (SELECT unnest(range(1, 51)) AS b))), m AS (SELECT param_idx, b, avg(acf_min) AS m FROM e JOIN c USING (param_idx, i) GROUP BY ALL) SELECT param_idx, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m GROUP BY param_idx")
def bootstrap_ci(spark, d):
    return D.bootstrap_ci(V.samples(spark, d), "param_idx", "acf_min", 0.95, 50, "ci").select("param_idx", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


@query("knockdown_design", "SELECT s_suppkey, tf, coeff, round(s_acctbal * coeff, 6) AS rate FROM supplier CROSS JOIN (SELECT unnest(['A', 'B', 'C']) AS tf) CROSS JOIN (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS coeff)")
def knockdown_design(spark, d):
    rates = V.table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("rate"))
    return D.knockdown_design(rates, "ABC", [0.0, 0.5, 1.0], ["rate"]).withColumn("rate", r6("rate"))


@query("perturbation_design")
def perturbation_design(spark, d):
    s = spark.sql(SAMPLED, supplier=V.table(spark, d, "supplier"))
    return D.perturb(s, {c: D.RANGES[c] for c in ("log10_kd_1", "kd_2_1_ratio", "km_unbound")}, 0.1, "p1", "s_suppkey")


SWAP = f"{BIN}, p AS (SELECT outcome AS code, i - 1 AS place, substr(array_to_string(list_sort(string_split(outcome, '')), ''), i::INT, 1) AS digit FROM (SELECT DISTINCT outcome FROM bincodes), (SELECT unnest(range(1, 9)) AS i)), k AS (SELECT *, row_number() OVER (PARTITION BY code, digit ORDER BY md5(concat_ws('|', 'swap', code, place)), place) AS k, least(count(*) FILTER (digit = '1') OVER (PARTITION BY code), count(*) FILTER (digit = '0') OVER (PARTITION BY code)) AS most FROM p), s AS (SELECT code, string_agg(CASE WHEN k <= least(2, most) THEN CASE digit WHEN '1' THEN '0' ELSE '1' END ELSE digit END, '' ORDER BY place) AS outcome FROM k GROUP BY code)"


@query("outcome_design", SWAP + ", " + _canon("outcome", 3).replace("FROM bincodes", "FROM s") + " SELECT DISTINCT c AS outcome FROM c3")
def outcome_design(spark, d):
    return D.outcome_design(V.bincodes(spark, d).select(F.col("outcome").alias("code")).distinct(), 3, 2, "swap")


def _choose(n: str, k: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, {k} + 1), lambda i: ln(({n} - {k} + i) / i::DOUBLE))), 0)"


def _tail(n: str, p: str, r: str) -> str:
    return f"CASE WHEN {r} <= 0 THEN 1.0 WHEN {p} <= 0 THEN 0.0 WHEN {p} >= 1 THEN 1.0 ELSE least(1.0, coalesce(list_sum(list_transform(range({r}, {n} + 1), lambda k: exp({_choose(n, 'k')} + k * ln({p}) + ({n} - k) * ln(1 - {p})))), 0)) END"


@query("beta_posterior", f"{Q} SELECT state, round((reward + 1.0) / (visits + 2), 6) AS mean, round((reward + 1.0) * (visits - reward + 1) / (pow(visits + 2, 2) * (visits + 3)), 6) AS variance, round({_tail('(visits + 1)', '0.3', '(reward + 1)')}, 6) AS cdf FROM q_table")
def beta_posterior(spark, d):
    return B.beta_posterior(V.q_table(spark, d), 0.3).select("state", r6("mean").alias("mean"), r6("variance").alias("variance"), r6("cdf").alias("cdf"))


TAILS = f"{Q}, b AS (SELECT len(list_filter(string_split(split_part(state, '::', 2), '_'), lambda x: x <> ''))::INT AS complexity, (reward + 1.0) / (visits + 2) AS m, (reward + 1.0) * (visits - reward + 1) / (pow(visits + 2, 2) * (visits + 3)) AS v, {_tail('(visits + 1)', '0.3', '(reward + 1)')} AS c FROM q_table)"


@query("beta_mixture", f"{TAILS} SELECT complexity, round(avg(m), 6) AS mean, round(avg(v + m * m) - avg(m) * avg(m), 6) AS variance, round(avg(c), 6) AS cdf FROM b GROUP BY complexity")
def beta_mixture(spark, d):
    q = V.q_table(spark, d).withColumn("complexity", G.complexity(F.col("state")))
    return B.mixture(B.beta_posterior(q, 0.3), "complexity").select("complexity", r6("mean").alias("mean"), r6("variance").alias("variance"), r6("cdf").alias("cdf"))


@query("poisson_binomial", f"{Q}, p AS (SELECT len(list_filter(string_split(split_part(state, '::', 2), '_'), lambda x: x <> ''))::INT AS complexity, {_tail('visits', 'q', 'CAST(floor(visits * 0.4) + 1 AS BIGINT)')} AS p FROM q_table) SELECT complexity, count(*) AS n, round(sum(p), 6) AS mean, round(sum(p * (1 - p)), 6) AS variance FROM p GROUP BY complexity")
def poisson_binomial(spark, d):
    q = V.q_table(spark, d).withColumn("complexity", G.complexity(F.col("state")))
    return B.poisson_binomial(q, "complexity", 0.4).select("complexity", "n", r6("mean").alias("mean"), r6("variance").alias("variance"))


@query("edge_significance", V.ctes("edges") + f", e AS (SELECT e.src, e.dst, e.visits, e.reward, p.reward::DOUBLE / p.visits AS q FROM edges e JOIN nodes p ON p.node = e.src WHERE p.visits > 0 AND e.visits > 0) SELECT src, dst, round({_tail('visits', 'q', 'reward')}, 8) AS pvalue FROM e")
def edge_significance(spark, d):
    nodes = V.nodes(spark, d)
    parents = nodes.where("visits > 0").select(F.col("node").alias("src"), (F.col("reward") / F.col("visits")).alias("q_parent"))
    edges = V.edges_of(nodes).where("visits > 0").join(parents, "src")
    return B.edge_significance(edges).select("src", "dst", F.round("pvalue", 8).alias("pvalue"))


@query("posterior_compare")
def posterior_compare(spark, d):
    q = V.q_table(spark, d)
    pairs = M.pattern_containment(q, q.where(G.complexity(F.col("state")) <= 2).select(F.col("state").alias("pattern")))
    per = pairs.join(q, "state").groupBy("pattern").agg(F.sum("visits").alias("visits_with"), F.sum("reward").alias("reward_with"))
    total = q.agg(F.sum("visits").alias("v"), F.sum("reward").alias("r"))
    both = per.crossJoin(F.broadcast(total)).select("*", (F.col("v") - F.col("visits_with")).alias("visits_without"), (F.col("r") - F.col("reward_with")).alias("reward_without"))  # a row of totals
    return B.posterior_compare(both, 2000, 11)
