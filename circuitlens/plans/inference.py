"""Queries on tests, posteriors over search graphs, resampled searches and discovery over replicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from circuitlens.functions import genotype as G
from circuitlens.operators import design as D, distributions as P, graphs as N, motifs as M, outcomes as O, resampling as B, search as W, statistics as S
from circuitlens.plans import views as V
from circuitlens.plans.design import SAMPLED, u
from circuitlens.plans.design import _tail as tail
from circuitlens.plans.graphs import DEPTH, E, QT, ROOT
from circuitlens.plans.motifs import _canonical as canonical
from circuitlens.sources.shared import cut

QUERIES, ORACLES = {}, {}
r6 = lambda c: F.round(c, 6)


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def rounded(df, *exact, digits=6):
    """All columns but ``exact`` to some digits."""
    return df.select(*[F.col(c) if c in exact else F.round(c, digits).alias(c) for c in df.columns])


# --- rank tests

MW = f"""{V.ctes('runtime')}, r AS (SELECT o_orderstatus AS g, complexity AS v FROM runtime), k AS (SELECT g, v, count(*) AS c FROM r GROUP BY ALL), n AS (SELECT g, count(*) AS n FROM r GROUP BY g),
p AS (SELECT a.g AS g1, b.g AS g2, a.n AS n1, b.n AS n2, (a.n + b.n)::DOUBLE AS n FROM n a JOIN n b ON a.g < b.g),
w AS (SELECT g1, g2, sum(a.c * b.c * CASE WHEN b.v < a.v THEN 1 WHEN b.v = a.v THEN 0.5 ELSE 0 END)::DOUBLE AS u1 FROM p JOIN k a ON a.g = g1 JOIN k b ON b.g = g2 GROUP BY ALL),
t AS (SELECT g1, g2, sum(pow(c, 3) - c) AS ties FROM (SELECT g1, g2, v, sum(c)::DOUBLE AS c FROM p JOIN k ON k.g IN (g1, g2) GROUP BY ALL) GROUP BY ALL),
z AS (SELECT *, n1::DOUBLE * n2 - u1 AS u2, (greatest(u1, n1::DOUBLE * n2 - u1) - n1::DOUBLE * n2 / 2 - 0.5) / sqrt(n1::DOUBLE * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM p JOIN w USING (g1, g2) JOIN t USING (g1, g2)),
q AS (SELECT *, least(1.0, CASE WHEN z >= 0 THEN {V.erfc('(z / sqrt(2))')} ELSE 2 - {V.erfc('(-z / sqrt(2))')} END) AS p FROM z)
SELECT g1, g2, n1, n2, u1, u2, round(z, 6) AS z, round(p, 6) AS p, round(p * (SELECT count(*) FROM p), 6) AS p_corrected FROM q"""


@query("rank_test", MW)
def rank_test(spark, d):
    return rounded(P.rank_test(V.runtime(spark, d), "o_orderstatus", "complexity"), "g1", "g2", "n1", "n2", "u1", "u2")


# --- sums of unequal trials


@query("reachability_test")
def reachability_test(spark, d):
    q = cut(V.q_table(spark, d))
    pairs = M.pattern_containment(q, q.where(G.complexity(F.col("state")) <= 2).select(F.col("state").alias("pattern")))
    return P.reachability_test(q, pairs, 0.4)


# --- posteriors and exhausted nodes of a search graph

UP = "r AS (SELECT node, node AS target FROM nodes WHERE visits > 0 UNION SELECT src, target FROM r JOIN edges ON dst = r.node)"


def _graph(spark, d):
    nodes = cut(V.nodes(spark, d))
    return nodes, V.edges_of(nodes), nodes.select("node", G.complexity(F.col("node")).alias("depth"))


@query("reachable_mixture", f"{V.ctes('nodes', 'edges', recursive=True)}, {UP}, b AS (SELECT node AS target, (reward + 1.0) / (visits + 2) AS m, (reward + 1.0) * (visits - reward + 1) / (pow(visits + 2, 2) * (visits + 3)) AS v, {tail('(visits + 1)', '0.371828', '(reward + 1)')} AS c FROM nodes WHERE visits > 0) SELECT node, count(*) AS n, round(avg(m), 6) AS mean, round(avg(v + m * m) - avg(m) * avg(m), 6) AS variance, round(avg(c), 6) AS cdf, round(1 - avg(c), 6) AS sf FROM r JOIN b USING (target) GROUP BY node")
def reachable_mixture(spark, d):
    nodes, edges, _ = _graph(spark, d)
    circuits = nodes.where("visits > 0")
    return rounded(P.reachable_mixture(circuits, N.reachability(edges, circuits), 0.371828), "node", "n")


@query("exhausted_nodes", f"{V.ctes('nodes', 'edges', recursive=True)}, left_over AS (SELECT node FROM nodes WHERE visits < 5 AND (visits > 0 OR node NOT IN (SELECT src FROM edges)) UNION SELECT src FROM left_over JOIN edges ON dst = node) SELECT node, node NOT IN (SELECT node FROM left_over) AS exhausted FROM nodes")
def exhausted_nodes(spark, d):
    return N.exhausted(*_graph(spark, d), 5)


@query("exhausted_edges", f"{QT}, good AS (SELECT node FROM nodes WHERE reward >= 0.4 * greatest(1, visits)) SELECT src, dst, round(q, 6) AS q_tilde, t.visits >= 5 AS exhausted FROM edges JOIN nodes s ON s.node = src JOIN nodes t ON t.node = dst JOIN qt ON qt.node = dst WHERE src IN (FROM good) AND dst IN (FROM good) AND s.visits >= 5 AND (t.visits >= 5 OR q > 0.4)")
def exhausted_edges(spark, d):
    nodes, edges, depths = _graph(spark, d)
    links = N.complexity_graph(edges, N.successful_nodes(nodes, 0.4))
    done = nodes.select("node", (F.col("visits") >= 5).alias("exhausted"))
    return rounded(N.exhausted_edges(links, done, N.q_tilde(nodes, edges, depths), 0.4), "src", "dst", "exhausted")


# --- searches and means drawn anew

FRESH = "CASE WHEN f = 0 THEN 0 ELSE len(list_filter(range(0, f), lambda i: list_sum(list_transform(range(0, i + 1), lambda j: factorial(f::INT) / (factorial(j::INT) * factorial((f - j)::INT)) * pow(q, j) * pow(1 - q, f - j))) <= u)) END"
SEQUENTIAL = f"""{V.ctes('q_table')}, c AS (SELECT count(*) AS n FROM q_table), o AS (SELECT state, q, n, 12 * n + 5 AS steps, 3 * n + 2 AS every, row_number() OVER (ORDER BY md5('seq2|' || state), state) AS position FROM q_table, c),
e AS (SELECT *, least(k * every, steps) AS step, {u('seq2', 'state', 'k', "'0'")} AS u FROM o, (SELECT unnest(range(1, 5)) AS k) WHERE (k - 1) * every < steps),
v AS (SELECT *, step // n + (position <= step % n)::INT AS visits, step // n + (position <= step % n)::INT - ((k - 1) * every // n + (position <= (k - 1) * every % n)::INT) AS f FROM e),
g AS (SELECT *, CASE WHEN q >= 1 THEN f WHEN q <= 0 THEN 0 ELSE {FRESH} END AS gained FROM v), t AS (SELECT step, state, position, visits, sum(gained) OVER (PARTITION BY state ORDER BY k) AS reward FROM g)
SELECT step::BIGINT AS step, state, position::BIGINT AS position, visits::BIGINT AS visits, reward::BIGINT AS reward, round(CASE WHEN visits > 0 THEN reward / visits ELSE 0 END, 6) AS q FROM t"""


@query("sequential_search", SEQUENTIAL)
def sequential_search(spark, d):
    q = cut(V.q_table(spark, d))
    n = q.count()
    return rounded(B.sequential_search(q, 12 * n + 5, 3 * n + 2, "seq2"), "step", "state", "position", "visits", "reward")


@query("bootstrap_mean")
def bootstrap_mean(spark, d):
    return B.bootstrap_mean(V.samples(spark, d), ["param_idx"], "acf_min", 0.95, 200, "ci2")


# --- histograms

CORNER = ("l_quantity", "l_extendedprice", "l_discount")
_value = {"l_quantity": "l_quantity::DOUBLE", "l_extendedprice": "log10(l_extendedprice)", "l_discount": "l_discount::DOUBLE"}
_cell = lambda c: f"least(7, floor(({_value[c]} - lo_{c}) / ((hi_{c} - lo_{c}) / 8)))::INT"


@query("corner_histograms", "WITH e AS (SELECT " + ", ".join(f"min({_value[c]}) AS lo_{c}, max({_value[c]}) AS hi_{c}" for c in CORNER) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT l_linestatus AS class, '{x}' AS x, '{y}' AS y, {_cell(x)} AS bx, {_cell(y)} AS by, count(*) AS n FROM lineitem, e GROUP BY ALL" for i, x in enumerate(CORNER) for y in CORNER[i:]))
def corner_histograms(spark, d):
    return O.corner_histograms(V.table(spark, d, "lineitem"), CORNER, 8, "l_linestatus", ["l_extendedprice"])


# --- discovery over replicates

ST = V.ctes("snapshots", "truth")
BANDS = f"""{ST}, g AS (SELECT state, row_number() OVER (ORDER BY true_q DESC, state) AS k FROM truth WHERE true_q >= 0.2), c AS (SELECT count(*) AS n_good, floor(count(*) * 0.1) AS n_top FROM g),
m AS (SELECT replicate, step, count_if(q >= 0.2) AS found, count_if(q >= 0.2 AND k IS NOT NULL) AS good, count_if(q >= 0.2 AND k <= n_top) AS top, any_value(n_good) AS n_good, any_value(n_top) AS n_top FROM snapshots LEFT JOIN g USING (state), c GROUP BY ALL),
l AS (SELECT step, unnest([{{'metric': 'precision', 'value': good / nullif(found, 0)}}, {{'metric': 'recall', 'value': good / nullif(n_good, 0)}}, {{'metric': 'top_precision', 'value': top / nullif(found, 0)}}, {{'metric': 'top_recall', 'value': top / nullif(n_top, 0)}}], recursive := true) FROM m)
SELECT step, metric, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95, count(value) AS n FROM l GROUP BY step, metric"""


def _snapshots(spark, d):
    return V.snapshots(spark, d), cut(V.truth(spark, d))


@query("discovery_bands", BANDS)
def discovery_bands(spark, d):
    return rounded(W.discovery_bands(*_snapshots(spark, d), 0.2, 0.2), "step", "metric", "n")


@query("discovery_by_state", f"{ST}, f AS (SELECT state, count(DISTINCT replicate) AS n FROM snapshots WHERE s = 10 AND q >= 0.2 GROUP BY state) SELECT state, round(true_q, 6) AS true_q, round(coalesce(n, 0) / 12, 6) AS rate FROM truth LEFT JOIN f USING (state)")
def discovery_by_state(spark, d):
    return rounded(W.discovery_by_state(*_snapshots(spark, d), F.col("q") >= 0.2, 12), "state")


@query("top_found", f"{ST}, b AS (SELECT state FROM truth ORDER BY true_q DESC, state LIMIT 10) SELECT replicate, step, count_if(reward >= 1 AND state IN (FROM b)) AS n_top_found FROM snapshots GROUP BY ALL")
def top_found(spark, d):
    return W.top_found(*_snapshots(spark, d), 10, 1)


RQ = f"{V.ctes('search_log', 'truth')}, b AS (SELECT state FROM truth ORDER BY true_q DESC, state LIMIT 100), r AS (SELECT replicate, step, state, CAST(sum(reward) OVER w AS DOUBLE) / count(*) OVER w > 0.2 AS above FROM search_log WINDOW w AS (PARTITION BY replicate, state ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


@query("running_top_overlap", f"{RQ}, m AS (SELECT replicate, step, (state IN (FROM b))::INT * (above::INT - coalesce(lag(above::INT) OVER (PARTITION BY replicate, state ORDER BY step), 0)) AS delta FROM r) SELECT replicate, step, CAST(sum(delta) OVER (PARTITION BY replicate ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_overlap FROM m")
def running_top_overlap(spark, d):
    return W.running_top_overlap(V.search_log(spark, d), 0.2, V.truth(spark, d), 100).select("replicate", "step", "n_overlap")


# --- further columns of earlier queries

R = V.ctes("runtime")


@query("top_flag", f"{R} SELECT o_orderkey, runtime_secs > (SELECT quantile_cont(runtime_secs, 0.99) FROM runtime) AS is_top FROM runtime")
def top_flag(spark, d):
    return O.top_flag(V.runtime(spark, d), "runtime_secs").select("o_orderkey", "is_top")


_stats = ", ".join(f"round(avg({c}), 9) AS {c}_mean, round(stddev_pop({c}), 9) AS {c}_sd, round(quantile_cont({c}, 0.5), 9) AS {c}_median, round(min({c}), 9) AS {c}_low, round(max({c}), 9) AS {c}_high, round(quantile_cont({c}, 0.05), 9) AS {c}_q5, round(quantile_cont({c}, 0.95), 9) AS {c}_q95" for c in ("runtime", "sampling"))
METRICS = f"""{R}, g AS (SELECT complexity, runtime_secs, o_custkey % 100 AS rate, row_number() OVER (PARTITION BY complexity ORDER BY runtime_secs, o_orderkey) - 1 AS i FROM runtime), c AS (SELECT complexity, count(*) AS n FROM g GROUP BY 1),
e AS (SELECT complexity, b, CAST(floor({u('bm', 'complexity', 'b', 'k')} * n) AS BIGINT) AS i FROM c, (SELECT unnest(range(1, 101)) AS b), (SELECT unnest(range(1, 11)) AS k)),
t AS (SELECT complexity, threshold, b, max(runtime_secs) FILTER (rate <= threshold)::DOUBLE AS runtime FROM e JOIN g USING (complexity, i), (SELECT unnest([5.0, 30.0, 80.0])::DOUBLE AS threshold) GROUP BY ALL), s AS (SELECT *, 600.0::DOUBLE / runtime AS sampling FROM t WHERE runtime IS NOT NULL)
SELECT complexity, threshold, count(*) AS batches, {_stats} FROM s GROUP BY complexity, threshold"""


@query("batch_metrics", METRICS)
def batch_metrics(spark, d):
    runs = V.runtime(spark, d).withColumn("rate", F.col("o_custkey") % 100)
    return rounded(B.batch_metrics(runs, "complexity", "runtime_secs", "rate", 10, 100, [5.0, 30.0, 80.0], "bm", ["o_orderkey"]), "complexity", "threshold", "batches", digits=9)


PATTERN = f"{V.ctes('search_log')}, n AS (SELECT replicate, split_part(state, '_', 2) AS pattern, avg(reward) AS q FROM search_log GROUP BY ALL)"


@query("pattern_summary", f"{PATTERN} SELECT pattern, count_if(q >= 0.05) AS n_true, round(avg(q), 6) AS mean_q, round(stddev_samp(q), 6) AS sd_q, round(count(DISTINCT replicate) / 12, 6) AS share, min(replicate) AS first_replicate, round(arg_min(q, replicate), 6) AS first_q FROM n GROUP BY pattern")
def pattern_summary(spark, d):
    n = V.search_log(spark, d).groupBy("replicate", F.substring_index("state", "_", -1).alias("pattern")).agg(F.avg("reward").alias("q")).withColumn("is_motif", F.col("q") >= 0.05)
    return rounded(W.pattern_summary(n, 12), "pattern", "n_true", "first_replicate")


@query("edge_significance_corrected", V.ctes("edges") + f", e AS (SELECT e.src, e.dst, e.visits, e.reward, p.reward::DOUBLE / p.visits AS q FROM edges e JOIN nodes p ON p.node = e.src WHERE p.visits > 0 AND e.visits > 0), t AS (SELECT src, dst, {tail('visits', 'q', 'reward')} AS p FROM e) SELECT src, dst, round(log10(greatest(p, 1e-300)), 6) AS log10_p, round(least(1.0, p * (SELECT count(*) FROM t)), 9) AS p_corrected, p * (SELECT count(*) FROM t) < 0.05 AS significant FROM t")
def edge_significance_corrected(spark, d):
    nodes = V.nodes(spark, d)
    parents = nodes.where("visits > 0").select(F.col("node").alias("src"), (F.col("reward") / F.col("visits")).alias("q_parent"))
    edges = cut(V.edges_of(nodes).where("visits > 0").join(parents, "src"))
    return S.edge_significance(edges).select("src", "dst", r6(F.log10(F.greatest(F.col("pvalue"), F.lit(1e-300)))).alias("log10_p"), F.round(F.least(F.lit(1.0), F.col("p_corrected")), 9).alias("p_corrected"), "significant")


@query("linear_grid", f"{V.ctes('search_log')}, m AS (SELECT min(step) AS low, max(step) AS high FROM search_log), g AS (SELECT DISTINCT CAST(round(low + k * (high - low) / 50) AS BIGINT) AS step FROM m, (SELECT unnest(range(51)) AS k)) SELECT replicate, step, state FROM search_log WHERE step IN (SELECT step FROM g)")
def linear_grid(spark, d):
    return W.linear_grid(V.search_log(spark, d), "step", 51).select("replicate", "step", "state")


@query("pattern_candidates", f"{E}, {DEPTH} SELECT split_part(node, '::', 2) AS pattern, depth FROM nodes JOIN depths USING (node) WHERE depth BETWEEN 1 AND 4 AND visits > 0 AND reward >= 0.5 * visits")
def pattern_candidates(spark, d):
    nodes, edges, _ = _graph(spark, d)
    return N.pattern_candidates(nodes, edges, ROOT, 4, 0.5)


@query("merge_attributes", f"{V.ctes('search_log')}, n AS (SELECT replicate, state AS node, count(*) AS visits, sum(reward)::BIGINT AS reward, min(step)::BIGINT AS first_step FROM search_log GROUP BY ALL) SELECT node, sum(visits)::BIGINT AS visits, sum(reward)::BIGINT AS reward, arg_min(first_step, replicate) AS first_step FROM n GROUP BY node")
def merge_attributes(spark, d):
    n = V.search_log(spark, d).groupBy("replicate", F.col("state").alias("node")).agg(F.count("*").alias("visits"), F.sum("reward").alias("reward"), F.min("step").alias("first_step"))
    return N.merge_attributes(n, ["node"], "replicate", ["visits", "reward"])


@query("perturb_params")
def perturb_params(spark, d):
    sampled = spark.sql(SAMPLED, supplier=V.table(spark, d, "supplier")).withColumns({"km_act": F.lit(5.0), "kp": F.lit(0.1), "gamma_m": F.lit(0.05), "gamma_p": F.lit(0.02)})
    inside = sampled.withColumn("log10_kd_1", F.greatest(F.lit(-2.0), F.least(F.lit(4.0), F.col("log10_kd_1")))).withColumn("kd_2_1_ratio", F.least(F.lit(0.25), F.col("kd_2_1_ratio")))
    return rounded(D.perturb_params(D.to_params(inside), 0.1, "pp", "s_suppkey", 3), "s_suppkey", "replicate")


# --- designs and lattices from the tables

CODES = "[" + ", ".join(f"'{a}{b}{s}'" for a in "ABC" for b in "ABC" for s in "ai") + "]"
GROWN = f"""{V.ctes('q_table')}, x AS (SELECT state, visits, list_filter(string_split(split_part(state, '::', 2), '_'), lambda i: i <> '') AS own FROM q_table), c AS (SELECT state, visits, own, unnest({CODES}) AS ixn FROM x WHERE len(own) <= 4),
f AS (SELECT state, visits, list_append(own, ixn) AS g FROM c WHERE len(list_filter(own, lambda i: substr(i, 1, 2) = substr(ixn, 1, 2))) = 0), k AS (SELECT DISTINCT state, visits, {canonical('g')} AS grown FROM f)
SELECT grown, count(*) AS n_parents, sum(visits)::BIGINT AS visits FROM k GROUP BY grown"""


@query("grown_circuits", GROWN)
def grown_circuits(spark, d):
    q = cut(V.q_table(spark, d)).where(G.complexity(F.col("state")) <= 4)
    return N.grow_circuits(q, "ABC").join(q.select("state", "visits"), "state").groupBy("grown").agg(F.count("*").alias("n_parents"), F.sum("visits").alias("visits"))


HEX = """WITH p AS (SELECT (sqrt(3.0) / 3 * x - y / 3) / 0.03 AS q, (2.0 / 3 * y) / 0.03 AS r FROM (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)), o AS (SELECT q, r, -q - r AS s, round(q) AS rq, round(r) AS rr, round(-q - r) AS rs FROM p),
w AS (SELECT *, abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs - s) AS worst_q, abs(rr - r) > abs(rs - s) AS worst_r FROM o),
c AS (SELECT CAST(CASE WHEN worst_q THEN -rr - rs ELSE rq END AS BIGINT) AS i, CAST(CASE WHEN NOT worst_q AND worst_r THEN -rq - rs ELSE rr END AS BIGINT) AS j, count(*) AS n FROM w GROUP BY ALL)
SELECT a.i, a.j, b.i AS k, b.j AS l, round(b.n / sum(b.n) OVER (PARTITION BY a.i, a.j), 6) AS w FROM c a JOIN c b ON (b.i - a.i, b.j - a.j) IN ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))"""


@query("hex_neighbours", HEX)
def hex_neighbours(spark, d):
    points = V.table(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return rounded(N.hex_neighbours(N.hex_cells(points, 0.03)), "i", "j", "k", "l")
