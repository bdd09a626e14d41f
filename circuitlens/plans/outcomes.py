"""Queries on outcomes: flags, cleaning, joins, success rates, quantiles and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from circuitlens.functions import genotype as G
from circuitlens.operators import outcomes as O
from circuitlens.plans import views as V

r6 = lambda c: F.round(c, 6)
THR = -0.4


def oscillated():
    return F.col("acf_min") < THR


QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


S, SP = V.ctes("samples"), V.ctes("samples", "params")
KEY = "l_orderkey, l_linenumber, state, param_idx"
J = "samples JOIN params USING (param_idx)"
FLAGS = "acf_min < -0.4 AS oscillated, component_mutation <> '(none)' AS has_mutation"


def _flagged(spark, d):
    return O.flag_outcomes(O.join_params(V.samples(spark, d), V.params(spark, d), ["component_mutation"]), THR)


@query("scan_samples", f"{S} SELECT state, count(*) AS n, round(min(acf_min), 6) AS best FROM samples GROUP BY state")
def scan_samples(spark, d):
    return O.normalize_columns(V.samples(spark, d)).select("state", "acf_min").groupBy("state").agg(F.count("*").alias("n"), r6(F.min("acf_min")).alias("best"))


@query("flag_outcomes", f"{SP} SELECT {KEY}, {FLAGS}, (acf_min < -0.4 AND component_mutation <> '(none)') AS oscillated_mutated FROM {J}")
def flag_outcomes(spark, d):
    return _flagged(spark, d).select("l_orderkey", "l_linenumber", "state", "param_idx", "oscillated", "has_mutation", "oscillated_mutated")


@query("join_params", f"{SP} SELECT component_mutation, count(*) AS n, round(avg(acf_min), 6) AS mean_acf FROM {J} GROUP BY 1")
def join_params(spark, d):
    joined = O.join_params(V.samples(spark, d), V.params(spark, d), ["component_mutation"])
    return joined.groupBy("component_mutation").agg(F.count("*").alias("n"), r6(F.avg("acf_min")).alias("mean_acf"))


def _broken(spark, d):
    """Samples of which some failed (NaN) or timed out, by their simulated time."""
    s = V.samples(spark, d)
    return s.withColumn("acf_min", F.when(F.col("sim_time") == 1, F.lit(float("nan"))).when(F.col("sim_time") == 2, F.lit(1.0)).otherwise(F.col("acf_min"))).withColumn("sim_time", F.when(F.col("sim_time") == 2, -1.0).otherwise(F.col("sim_time")))


B = S + ", broken AS (SELECT l_orderkey, l_linenumber, state, param_idx, CASE WHEN sim_time = 1 THEN 'nan'::DOUBLE WHEN sim_time = 2 THEN 1.0 ELSE acf_min END AS acf_min, CASE WHEN sim_time = 2 THEN -1.0 ELSE sim_time END AS sim_time FROM samples)"


@query("clean_samples", f"{B} SELECT state, count(*) AS n, round(avg(acf_min), 6) AS mean_acf FROM broken WHERE NOT isnan(acf_min) AND NOT (acf_min = 1 AND sim_time = -1) GROUP BY state")
def clean_samples(spark, d):
    return O.clean_samples(_broken(spark, d)).groupBy("state").agg(F.count("*").alias("n"), r6(F.avg("acf_min")).alias("mean_acf"))


@query("retry_list", f"{B} SELECT {KEY}, 1.0 AS acf_min, -1.0 AS sim_time FROM broken WHERE isnan(acf_min) OR acf_min > 0")
def retry_list(spark, d):
    return O.retry_list(_broken(spark, d)).select("l_orderkey", "l_linenumber", "state", "param_idx", "acf_min", "sim_time")


@query("batch_reward", f"{B} SELECT state, count(*) AS runs, count(*) FILTER (NOT isnan(acf_min)) AS usable, round(avg(CASE WHEN isnan(acf_min) THEN NULL WHEN acf_min < -0.4 THEN 1.0 ELSE 0.0 END), 6) AS reward FROM broken GROUP BY state")
def batch_reward(spark, d):
    return O.batch_reward(_broken(spark, d), ["state"], oscillated()).withColumn("reward", r6("reward"))


@query("route_rows", f"{B} SELECT CASE WHEN isnan(acf_min) THEN 'failed' WHEN acf_min < -0.4 THEN 'oscillating' ELSE 'quiet' END AS route, count(*) AS n, count(DISTINCT state) AS states FROM broken GROUP BY 1")
def route_rows(spark, d):
    return O.route(_broken(spark, d), THR).groupBy("route").agg(F.count("*").alias("n"), F.countDistinct("state").alias("states"))


@query("robustness", f"{SP}, f AS (SELECT state, {FLAGS} FROM {J}), g AS (SELECT state, count(*) AS visits, count_if(oscillated) AS n_osc, count_if(has_mutation) AS n_mut, count_if(oscillated AND has_mutation) AS n_osc_mut FROM f GROUP BY state) SELECT * FROM g WHERE n_osc >= 0.3 * visits AND visits >= 5")
def robustness(spark, d):
    return O.robustness(_flagged(spark, d), 0.3, 5)


@query("fault_tolerance", f"""{SP}, f AS (SELECT state, {FLAGS} FROM {J}), g AS (SELECT state, count(*) AS visits, count_if(oscillated) AS n_osc, count_if(has_mutation) AS n_mut, count_if(oscillated AND has_mutation) AS n_osc_mut FROM f GROUP BY state),
h AS (SELECT *, CASE WHEN visits > n_mut THEN (n_osc - n_osc_mut)::DOUBLE / (visits - n_mut) END AS q_wt, CASE WHEN n_mut > 0 THEN n_osc_mut::DOUBLE / n_mut END AS q_mut FROM g)
SELECT state, visits, round(q_wt, 6) AS q_wt, round(q_mut, 6) AS q_mut, round(CASE WHEN visits > n_mut THEN sqrt(q_wt * (1 - q_wt) / (visits - n_mut)) END, 6) AS se_wt, round(CASE WHEN n_mut > 0 THEN sqrt(q_mut * (1 - q_mut) / n_mut) END, 6) AS se_mut, round(CASE WHEN q_wt > 0 THEN q_mut / q_wt END, 6) AS tolerance FROM h""")
def fault_tolerance(spark, d):
    out = O.fault_tolerance(O.robustness(_flagged(spark, d)))
    return out.select("state", "visits", *[r6(c).alias(c) for c in ("q_wt", "q_mut", "se_wt", "se_mut", "tolerance")])


@query("semi_success", f"{S} SELECT {KEY} FROM samples WHERE state IN (SELECT state FROM samples GROUP BY state HAVING avg(CASE WHEN acf_min < -0.4 THEN 1.0 ELSE 0.0 END) >= 0.6) AND acf_min < -0.4")
def semi_success(spark, d):
    return O.samples_of_successes(V.samples(spark, d), oscillated(), 0.6).where(oscillated()).select("l_orderkey", "l_linenumber", "state", "param_idx")


@query("anti_states", f"{S} SELECT state, count(*) AS n FROM samples WHERE state NOT IN (SELECT state FROM samples GROUP BY state HAVING avg(CASE WHEN acf_min < -0.4 THEN 1.0 ELSE 0.0 END) >= 0.6) GROUP BY state")
def anti_states(spark, d):
    s = V.samples(spark, d)
    return s.join(O.q_values(s, oscillated()).where("q >= 0.6"), "state", "left_anti").groupBy("state").agg(F.count("*").alias("n"))


@query("lookup_q", f"{S}, a AS (SELECT DISTINCT state, CAST(substr(state, 2) AS BIGINT) % 50 AS fam FROM samples), b AS (SELECT CAST(substr(state, 2) AS BIGINT) % 50 AS fam, avg(acf_min) AS q FROM samples WHERE CAST(substr(state, 2) AS BIGINT) % 50 < 40 GROUP BY 1) SELECT state, round(coalesce(q, 0.0), 6) AS q FROM a LEFT JOIN b USING (fam)")
def lookup_q(spark, d):
    s = V.samples(spark, d).withColumn("fam", F.substring("state", 2, 20).cast("bigint") % 50)
    second = s.where("fam < 40").groupBy("fam").agg(F.avg("acf_min").alias("q"))
    return O.lookup(s.select("state").distinct(), s.select("state", "fam").distinct(), second, "state", "fam", "q", 0.0).select("state", r6("q").alias("q"))


@query("common_successes", f"{S}, k AS (SELECT state FROM samples GROUP BY state ORDER BY count(*) DESC, state LIMIT 3), g AS (SELECT param_idx, count(DISTINCT state) AS n_states, round(min(acf_min), 6) AS best FROM samples WHERE acf_min < -0.01 AND state IN (SELECT state FROM k) GROUP BY param_idx) SELECT * FROM g WHERE n_states = (SELECT count(*) FROM k)")
def common_successes(spark, d):
    s = V.samples(spark, d)
    states = s.groupBy("state").count().orderBy(F.desc("count"), "state").limit(3).select("state")
    return O.common_successes(s, states, F.col("acf_min") < -0.01).withColumn("best", r6("best"))


@query("tolerance_join", f"{S}, l AS (SELECT l_orderkey, l_linenumber, state, l_extendedprice FROM samples WHERE acf_min < -0.9), m AS (SELECT l.*, count(*) AS n_matches, min(r.l_orderkey) AS o FROM l JOIN samples r ON l.state = r.state AND abs(r.l_extendedprice - l.l_extendedprice) <= 1e-8 + 1e-3 * abs(l.l_extendedprice) GROUP BY ALL) SELECT l_orderkey, l_linenumber, state, l_extendedprice, n_matches, CASE WHEN n_matches = 1 THEN o::VARCHAR END AS match FROM m")
def tolerance_join(spark, d):
    s = V.samples(spark, d)
    left = s.where("acf_min < -0.9").select("l_orderkey", "l_linenumber", "state", "l_extendedprice")
    return O.tolerance_join(left, s.select("l_orderkey", "state", "l_extendedprice"), "state", "l_extendedprice", "l_orderkey", rtol=1e-3, width=500.0).withColumn("match", F.col("match").cast("string"))


@query("fallback_lookup", "WITH r AS (SELECT * FROM supplier), a AS (SELECT s_acctbal, min(s_name) AS v FROM r GROUP BY 1 HAVING count(*) = 1), b AS (SELECT s_nationkey, min(s_name) AS v FROM r GROUP BY 1 HAVING count(*) = 1) SELECT s_suppkey, coalesce(a.v, b.v) AS s_name FROM r LEFT JOIN b USING (s_nationkey) LEFT JOIN a USING (s_acctbal)")
def fallback_lookup(spark, d):
    sup = V.table(spark, d, "supplier")
    return O.fallback_lookup(sup, sup, "s_suppkey", ["s_acctbal", "s_nationkey"], "s_name")


@query("nearest_join", "WITH g AS (SELECT DISTINCT round(c_acctbal, -2) + 0.0 AS g FROM customer), v AS (SELECT s_acctbal AS v, min(s_suppkey) AS id FROM supplier GROUP BY 1), x AS (SELECT g, v, id, abs(v - g) AS gap, row_number() OVER (PARTITION BY g ORDER BY abs(v - g), id) AS k FROM g CROSS JOIN v) SELECT g, id AS s_suppkey, v AS s_acctbal, round(gap, 6) AS gap FROM x WHERE k = 1")
def nearest_join(spark, d):
    grid = V.table(spark, d, "customer").select((F.round("c_acctbal", -2) + 0.0).alias("g"))
    return O.nearest(grid, V.table(spark, d, "supplier"), "g", "s_acctbal", "s_suppkey", 500.0).withColumn("gap", r6("gap"))


@query("join_by_index", f"{S}, i AS (SELECT *, row_number() OVER (PARTITION BY param_idx ORDER BY l_orderkey, l_linenumber, l_extendedprice, state) - 1 AS idx FROM samples) SELECT o.param_idx, o.idx, i.state, i.l_orderkey FROM (SELECT param_idx, count(*) // 2 AS idx FROM samples GROUP BY param_idx) o JOIN i ON o.param_idx = i.param_idx AND o.idx = i.idx")
def join_by_index(spark, d):
    from pyspark.sql import Window

    s = V.samples(spark, d)
    w = Window.partitionBy("param_idx").orderBy("l_orderkey", "l_linenumber", "l_extendedprice", "state")
    indexed = s.withColumn("idx", (F.row_number().over(w) - 1).cast("bigint"))
    wanted = s.groupBy("param_idx").agg(F.floor(F.count("*") / 2).alias("idx"))
    return wanted.join(indexed, ["param_idx", "idx"]).select("param_idx", "idx", "state", "l_orderkey")


@query("q_table", V.ctes("circuits", "q_table") + """, m AS (SELECT state, round(q, 6) AS p_oscillation, list_filter(string_split(split_part(state, '::', 2), '_'), lambda x: x <> '') AS x FROM q_table)
SELECT state, p_oscillation, """ + ", ".join("(" + " OR ".join("list_has_all(x, ['" + "','".join(r) + "'])" for r in G.relabellings(m)) + f') AS "{n}"' for n, m in G.MOTIFS.items()) + " FROM m")
def q_table(spark, d):
    q = V.q_table(spark, d)
    return q.select("state", r6("q").alias("p_oscillation"), *[f.alias(n) for n, f in G.flags(F.col("state")).items()])


R = V.ctes("runtime")


@query("quantiles", f"{R} SELECT complexity, round(quantile_cont(runtime_secs, 0.05), 6) AS q5, round(quantile_cont(runtime_secs, 0.5), 6) AS q50, round(quantile_cont(runtime_secs, 0.99), 6) AS q99 FROM runtime GROUP BY complexity")
def quantiles(spark, d):
    return O.quantiles(V.runtime(spark, d), ["complexity"], "runtime_secs", [0.05, 0.5, 0.99]).select("complexity", *[r6(c).alias(c) for c in ("q5", "q50", "q99")])


@query("describe", f"{R} SELECT complexity, count(*) AS n, round(avg(runtime_secs), 6) AS mean, round(stddev_samp(runtime_secs), 6) AS sd, min(runtime_secs) AS low, round(quantile_cont(runtime_secs, 0.25), 6) AS q25, round(quantile_cont(runtime_secs, 0.5), 6) AS q50, round(quantile_cont(runtime_secs, 0.75), 6) AS q75, max(runtime_secs) AS high FROM runtime GROUP BY complexity")
def describe(spark, d):
    return O.describe(V.runtime(spark, d), ["complexity"], "runtime_secs").select("complexity", "n", "low", "high", *[r6(c).alias(c) for c in ("mean", "sd", "q25", "q50", "q75")])


@query("ecdf", f"{R} SELECT DISTINCT complexity, runtime_secs, round(cume_dist() OVER (PARTITION BY complexity ORDER BY runtime_secs), 6) AS ecdf FROM runtime")
def ecdf(spark, d):
    return O.ecdf(V.runtime(spark, d), ["complexity"], "runtime_secs").withColumn("ecdf", r6("ecdf"))


@query("exclusion_curve", f"{R} SELECT t AS threshold, round(avg(CASE WHEN runtime_secs > t THEN 1.0 ELSE 0.0 END), 6) AS excluded FROM runtime CROSS JOIN (SELECT unnest(range(0, 501, 25))::DOUBLE AS t) GROUP BY t")
def exclusion_curve(spark, d):
    return O.exclusion_curve(V.runtime(spark, d), "runtime_secs", [float(t) for t in range(0, 501, 25)]).withColumn("excluded", r6("excluded"))


@query("hist2d", f"""{R}, p AS (SELECT log10(runtime_secs) AS x, complexity::DOUBLE AS y FROM runtime), e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p)
SELECT least(9, floor((x - lx) / ((hx - lx) / 10)))::INT AS bx, least(9, floor((y - ly) / ((hy - ly) / 10)))::INT AS by, count(*) AS n FROM p, e GROUP BY ALL""")
def hist2d(spark, d):
    return O.histogram2d(V.runtime(spark, d), "runtime_secs", "complexity", 10, log_x=True)


@query("safe_log", f"{S} SELECT {KEY}, round(CASE WHEN -acf_min > 0 THEN log10(-acf_min) ELSE -6.0 END, 6) AS log_strength, round(log10(greatest(sim_time, 10.0)), 6) AS log_time FROM samples")
def safe_log(spark, d):
    s = V.samples(spark, d)
    return s.select("l_orderkey", "l_linenumber", "state", "param_idx", r6(O.safe_log10(-F.col("acf_min"), -6.0)).alias("log_strength"), r6(F.log10(F.greatest("sim_time", F.lit(10.0)))).alias("log_time"))


@query("unit_derivations", f"{S} SELECT {KEY}, round(2 * sim_time / 60, 6) AS period_min, round(60 / (2 * sim_time), 6) AS per_minute, round(3600 / (2 * sim_time), 6) AS per_hour, CAST(trunc((1 + acf_min / 10) * 100 + 1e-9) AS INT) AS knockdown_percent FROM samples")
def unit_derivations(spark, d):
    t = F.col("sim_time")
    return V.samples(spark, d).select("l_orderkey", "l_linenumber", "state", "param_idx", r6(2 * t / 60).alias("period_min"), r6(60 / (2 * t)).alias("per_minute"), r6(3600 / (2 * t)).alias("per_hour"), ((1 + F.col("acf_min") / 10) * 100 + 1e-9).cast("int").alias("knockdown_percent"))


@query("log_normalize", V.ctes("nodes") + ", n AS (SELECT node, visits, max(visits) OVER () AS top FROM nodes) SELECT node, visits, round(CASE WHEN visits > 0 AND top > 1 THEN log10(visits) / log10(top) ELSE 0 END, 6) AS traffic FROM n")
def log_normalize(spark, d):
    return O.log_normalize(V.nodes(spark, d).select("node", "visits"), "visits").withColumn("traffic", r6("traffic"))


@query("merge_samples", f"""{S}, a AS (SELECT state, param_idx, min(acf_min) AS acf_min FROM samples WHERE sim_time <= 30 GROUP BY ALL), b AS (SELECT state, param_idx, max(acf_min) AS acf_min FROM samples WHERE sim_time > 20 GROUP BY ALL)
SELECT 'full' AS mode, state, param_idx, acf_min FROM b UNION ALL SELECT 'partial', state, param_idx, coalesce(a.acf_min, b.acf_min) FROM a FULL JOIN b USING (state, param_idx) UNION ALL SELECT 'update', state, param_idx, coalesce(b.acf_min, a.acf_min) FROM a FULL JOIN b USING (state, param_idx)""")
def merge_samples(spark, d):
    s = V.samples(spark, d)
    base = s.where("sim_time <= 30").groupBy("state", "param_idx").agg(F.min("acf_min").alias("acf_min"))
    new = s.where("sim_time > 20").groupBy("state", "param_idx").agg(F.max("acf_min").alias("acf_min"))
    full, partial, update = (O.merge_samples(base, new, m).withColumn("mode", F.lit(m)) for m in ("full", "partial", "update"))
    return full.unionByName(partial).unionByName(update)


@query("runtime_summary", f"{R} SELECT o_orderstatus, count(*) AS n, round(sum(runtime_secs) / count(*), 6) AS mean_secs, round(count(*) / (SELECT count(*) FROM runtime), 6) AS progress FROM runtime GROUP BY 1")
def runtime_summary(spark, d):
    rt = V.runtime(spark, d)
    parts = rt.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("runtime_secs").alias("s"))
    total = rt.agg(F.count("*").alias("all"))
    return parts.crossJoin(F.broadcast(total)).select("o_orderstatus", "n", r6(F.col("s") / F.col("n")).alias("mean_secs"), r6(F.col("n") / F.col("all")).alias("progress"))  # a row of totals


@query("mean_by_params", f"{S} SELECT param_idx, count(*) AS n, round(avg(acf_min), 6) AS acf_min, round(avg(sim_time), 6) AS sim_time FROM samples GROUP BY param_idx")
def mean_by_params(spark, d):
    return V.samples(spark, d).groupBy("param_idx").agg(F.count("*").alias("n"), r6(F.avg("acf_min")).alias("acf_min"), r6(F.avg("sim_time")).alias("sim_time"))


@query("perturbation_summary", f"{S} SELECT sim_time AS level, round(avg(CASE WHEN acf_min < -0.4 THEN 1.0 ELSE 0.0 END), 6) AS success, round(stddev_pop(CASE WHEN acf_min < -0.4 THEN 1.0 ELSE 0.0 END) / sqrt(count(*)), 6) AS sem, round(quantile_cont(acf_min, 0.05), 6) AS q5, round(quantile_cont(acf_min, 0.95), 6) AS q95 FROM samples GROUP BY sim_time")
def perturbation_summary(spark, d):
    hit = oscillated().cast("double")
    return V.samples(spark, d).groupBy(F.col("sim_time").alias("level")).agg(r6(F.avg(hit)).alias("success"), r6(F.stddev_pop(hit) / F.sqrt(F.count("*"))).alias("sem"), r6(F.percentile("acf_min", 0.05)).alias("q5"), r6(F.percentile("acf_min", 0.95)).alias("q95"))


@query("knockdown_summary", f"{S}, o AS (SELECT param_idx, 60 / sim_time AS f FROM samples WHERE acf_min < -0.4), g AS (SELECT param_idx, count(*) AS n, avg(f) AS m, quantile_cont(f, 0.025) AS a, quantile_cont(f, 0.975) AS b FROM o GROUP BY param_idx) SELECT param_idx, n, round(m, 6) AS mean_freq, round(greatest(m - a, 0), 6) AS err_low, round(greatest(b - m, 0), 6) AS err_high FROM g")
def knockdown_summary(spark, d):
    o = V.samples(spark, d).where(oscillated()).select("param_idx", (60 / F.col("sim_time")).alias("f"))
    g = o.groupBy("param_idx").agg(F.count("*").alias("n"), F.avg("f").alias("m"), F.percentile("f", 0.025).alias("a"), F.percentile("f", 0.975).alias("b"))
    return g.select("param_idx", "n", r6("m").alias("mean_freq"), r6(F.greatest(F.col("m") - F.col("a"), F.lit(0.0))).alias("err_low"), r6(F.greatest(F.col("b") - F.col("m"), F.lit(0.0))).alias("err_high"))


@query("group_profile", f"{S} SELECT state, count(*) AS size, count(DISTINCT param_idx) AS params, round(quantile_cont(acf_min, 0.25), 6) AS q25, round(quantile_cont(acf_min, 0.75), 6) AS q75, round(avg(1 - CASE WHEN acf_min < -0.4 THEN 1.0 ELSE 0.0 END), 6) AS regret_rate FROM samples GROUP BY state")
def group_profile(spark, d):
    return V.samples(spark, d).groupBy("state").agg(F.count("*").alias("size"), F.countDistinct("param_idx").alias("params"), r6(F.percentile("acf_min", 0.25)).alias("q25"), r6(F.percentile("acf_min", 0.75)).alias("q75"), r6(F.avg(1 - oscillated().cast("double"))).alias("regret_rate"))


@query("melt_counts", f"{S}, g AS (SELECT param_idx, count_if(acf_min < -0.4) AS oscillating, count_if(acf_min >= -0.4) AS quiet FROM samples GROUP BY param_idx) SELECT param_idx, kind, n FROM g UNPIVOT (n FOR kind IN (oscillating, quiet))")
def melt_counts(spark, d):
    g = V.samples(spark, d).groupBy("param_idx").agg(F.count_if(oscillated()).alias("oscillating"), F.count_if(~oscillated()).alias("quiet"))
    return g.unpivot("param_idx", ["oscillating", "quiet"], "kind", "n")


@query("estimate_ratio", f"{S}, g AS (SELECT state, avg(acf_min) AS truth, avg(acf_min) FILTER (sim_time <= 25) AS estimate FROM samples GROUP BY state) SELECT state, round(CASE WHEN truth <> 0 THEN estimate / truth END, 6) AS ratio FROM g")
def estimate_ratio(spark, d):
    g = V.samples(spark, d).groupBy("state").agg(F.avg("acf_min").alias("truth"), F.avg(F.when(F.col("sim_time") <= 25, F.col("acf_min"))).alias("estimate"))
    return g.select("state", r6(F.when(F.col("truth") != 0, F.col("estimate") / F.col("truth"))).alias("ratio"))
