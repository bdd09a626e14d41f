"""Queries on search graphs and on circuits as graphs."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from circuitlens.functions import genotype as G
from circuitlens.operators import graphs as N, search as W
from circuitlens.plans import views as V
from circuitlens.sources.shared import cut

QUERIES, ORACLES = {}, {}
r6 = lambda c: F.round(c, 6)
ROOT, DEEPEST = "*ABC::", 9
E, Q = V.ctes("edges"), V.ctes("circuits", "q_table")
NODE_IXNS = "list_filter(string_split(split_part(node, '::', 2), '_'), lambda x: x <> '')"
IXNS = NODE_IXNS.replace("node", "state")
DEPTH = f"depths AS MATERIALIZED (SELECT node, len({NODE_IXNS})::INT AS depth FROM nodes)"
GOOD = "good AS (SELECT node FROM nodes WHERE reward >= 0.6 * greatest(1, visits))"


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def _graph(spark, d):
    """Nodes, edges and depths; the nodes are cut off, as all three start from them."""
    nodes = N.cut(V.nodes(spark, d))
    return nodes, V.edges_of(nodes), nodes.select("node", G.complexity(F.col("node")).alias("depth"))


@query("enumerate_circuits", "WITH RECURSIVE i AS (SELECT a || b || s AS ixn FROM (SELECT unnest(['A', 'B', 'C']) AS a), (SELECT unnest(['A', 'B', 'C']) AS b), (SELECT unnest(['a', 'i']) AS s)), r AS (SELECT [] ::VARCHAR[] AS x, 0 AS k UNION SELECT list_sort(list_append(x, ixn)), k + 1 FROM r JOIN i ON k < 4 AND len(list_filter(x, lambda y: substr(y, 1, 2) = substr(ixn, 1, 2))) = 0), g AS (SELECT DISTINCT p_size % 5 AS n FROM part) SELECT n::INT AS n_ixn, count(DISTINCT list_min([" + ", ".join(f"array_to_string(list_sort(list_transform(x, lambda y: translate(substr(y, 1, 2), 'ABC', '{''.join(p)}') || substr(y, 3, 1))), '_')" for p in permutations("ABC")) + "])) AS n_circuits FROM r JOIN g ON g.n = k GROUP BY n")
def enumerate_circuits(spark, d):
    wanted = V.table(spark, d, "part").select((F.col("p_size") % 5).alias("n_ixn")).distinct()
    found = N.enumerate_circuits(spark, "ABC", 4).groupBy(G.complexity(F.col("state")).alias("n_ixn")).agg(F.count("*").alias("n_circuits"))
    return wanted.join(found, "n_ixn")


@query("binary_tree", "WITH t AS (SELECT substr(bin(i), 2) AS node FROM (SELECT unnest(range(1, 512)) AS i)), b AS (SELECT lpad(bin(p_size), 8, '0') AS outcome, p_partkey FROM part) SELECT node, CASE WHEN node <> '' THEN substr(node, 1, length(node) - 1) END AS parent, length(node)::INT AS depth, count(p_partkey) AS n_success FROM t LEFT JOIN b ON starts_with(outcome, node) AND length(node) <= 8 GROUP BY node")
def binary_tree(spark, d):
    codes = V.bincodes(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))
    prefixes = codes.select("n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.substring("outcome", F.lit(1), k))).alias("node")).groupBy("node").agg(F.sum("n").alias("n_success"))
    return N.binary_tree(spark, 8).join(prefixes, "node", "left").select("node", "parent", "depth", F.coalesce("n_success", F.lit(0)).alias("n_success"))


@query("bfs_layers", f"{E}, {DEPTH} SELECT node, depth FROM depths")
def bfs_layers(spark, d):
    return N.bfs_layers(_graph(spark, d)[1], ROOT)


@query("successful_nodes", f"{E}, {GOOD} SELECT node FROM good")
def successful_nodes(spark, d):
    return N.successful_nodes(V.nodes(spark, d), 0.6).select("node")


QT = f"{E}, {DEPTH}, own AS MATERIALIZED (SELECT node, depth, reward::DOUBLE / greatest(1, visits) AS own FROM nodes JOIN depths USING (node)), q{DEEPEST} AS MATERIALIZED (SELECT node, own AS q FROM own WHERE depth = {DEEPEST})" + "".join(f", q{k} AS MATERIALIZED (SELECT o.node, coalesce((SELECT avg(q) FROM edges e JOIN q{k + 1} c ON c.node = e.dst WHERE e.src = o.node), o.own) AS q FROM own o WHERE o.depth = {k})" for k in range(DEEPEST - 1, -1, -1)) + ", qt AS (" + " UNION ALL ".join(f"SELECT * FROM q{k}" for k in range(DEEPEST + 1)) + ")"


@query("q_tilde", f"{QT} SELECT node, round(q, 9) AS q_tilde, round(1 - q, 9) AS loss FROM qt")
def q_tilde(spark, d):
    return N.q_tilde(*_graph(spark, d)).select("node", F.round("q_tilde", 9).alias("q_tilde"), F.round("loss", 9).alias("loss"))


@query("reachable", f"{E} SELECT node FROM nodes WHERE list_contains({NODE_IXNS}, 'ABa')")
def reachable(spark, d):
    return N.reachable(_graph(spark, d)[1], "*ABC::ABa")


@query("merge_graphs", V.ctes("search_log") + ", n AS (SELECT split_part(state, '_', 2) AS node, split_part(state, '_', 1) AS src, count(*) AS visits, sum(reward)::BIGINT AS reward FROM search_log GROUP BY ALL) SELECT 'node' AS kind, node AS src, node AS dst, sum(visits)::BIGINT AS visits, sum(reward)::BIGINT AS reward FROM n GROUP BY node UNION ALL SELECT 'edge', src, node, sum(visits)::BIGINT, sum(reward)::BIGINT FROM n GROUP BY src, node")
def merge_graphs(spark, d):
    log = V.search_log(spark, d).withColumns({"src": F.substring_index("state", "_", 1), "node": F.substring_index("state", "_", -1)})
    sums = [F.count("*").alias("visits"), F.sum("reward").alias("reward")]
    nodes, edges = N.merge_graphs(log.groupBy("replicate", "node").agg(*sums), log.groupBy("replicate", "src", F.col("node").alias("dst")).agg(*sums))
    return nodes.select(F.lit("node").alias("kind"), F.col("node").alias("src"), F.col("node").alias("dst"), "visits", "reward").unionByName(edges.withColumn("kind", F.lit("edge")))


@query("complexity_graph", f"{E}, {GOOD} SELECT src, dst FROM edges WHERE src IN (SELECT node FROM good) AND dst IN (SELECT node FROM good)")
def complexity_graph(spark, d):
    nodes, edges, _ = _graph(spark, d)
    return N.complexity_graph(edges, N.successful_nodes(nodes, 0.6)).select("src", "dst")


COST = "w AS MATERIALIZED (SELECT e.src, e.dst, 1 - s.reward::DOUBLE / greatest(1, s.visits) AS w FROM edges e JOIN nodes s ON s.node = e.src)"


def _costs(nodes, edges):
    q = nodes.select(F.col("node").alias("src"), (1 - F.col("reward") / F.greatest(F.lit(1), F.col("visits"))).alias("w"))
    return edges.select("src", "dst").join(q, "src")


@query("min_arborescence", f"{E}, {COST}, k AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w, src) AS k FROM w) SELECT src, dst, round(w, 6) AS w FROM k WHERE k = 1")
def min_arborescence(spark, d):
    nodes, edges, _ = _graph(spark, d)
    return N.min_arborescence(_costs(nodes, edges), "w").withColumn("w", r6("w"))


KEPT = "kept AS (SELECT node FROM nodes ORDER BY reward DESC, node LIMIT 20)"


@query("prune_tree", f"{V.ctes('edges', recursive=True)}, {KEPT}, up AS (SELECT node FROM kept UNION SELECT src FROM up JOIN edges ON dst = node) SELECT src, dst FROM edges WHERE dst IN (SELECT node FROM up)")
def prune_tree(spark, d):
    nodes, edges, _ = _graph(spark, d)
    return N.prune_to_leaves(edges, W.top_n(nodes.select("node", "reward"), [F.desc("reward"), "node"], 20)).select("src", "dst")


PATHS = f"{E}, {COST}, p0 AS MATERIALIZED (SELECT '{ROOT}' AS node, 0.0::DOUBLE AS cost, '{ROOT}' AS path)" + "".join(f", p{k} AS MATERIALIZED (SELECT dst AS node, min(row(round(cost + w, 9), path || '>' || dst)) AS m FROM p{k - 1}x JOIN w ON src = node GROUP BY dst), p{k}x AS (SELECT node, m[1] AS cost, m[2] AS path FROM p{k})" for k in range(1, DEEPEST + 1)).replace("p0x", "p0") + ", p AS (SELECT * FROM p0" + "".join(f" UNION ALL SELECT * FROM p{k}x" for k in range(1, DEEPEST + 1)) + ")"


@query("shortest_paths", f"{PATHS}, {KEPT} SELECT node, round(cost, 6) AS cost, path FROM p WHERE node IN (SELECT node FROM kept)")
def shortest_paths(spark, d):
    nodes, edges, depths = _graph(spark, d)
    targets = W.top_n(nodes.select("node", "reward"), [F.desc("reward"), "node"], 20)
    paths = N.shortest_paths(_costs(nodes, edges), ROOT, depths, "w")
    return paths.join(targets, "node", "left_semi").select("node", r6("cost").alias("cost"), "path")


@query("graph_sources", f"{E} SELECT node, (SELECT count(*) FROM edges WHERE dst = node) AS n_in, (SELECT count(*) FROM edges WHERE src = node) AS n_out FROM nodes")
def graph_sources(spark, d):
    return N.degrees(_graph(spark, d)[1])


LINKS = f"x AS MATERIALIZED (SELECT state, {IXNS} AS x FROM q_table)"


@query("components", f"{V.ctes('circuits', 'q_table', recursive=True)}, {LINKS}, l AS MATERIALIZED (SELECT state, substr(i, 1, 1) AS a, substr(i, 2, 1) AS b FROM (SELECT state, unnest(x) AS i FROM x)), s AS MATERIALIZED (SELECT * FROM l UNION SELECT state, b, a FROM l), r AS (SELECT state, a, a AS b FROM s UNION SELECT r.state, r.a, s.b FROM r JOIN s ON r.state = s.state AND r.b = s.a), m AS (SELECT state, a, min(b) AS c FROM r GROUP BY ALL), n AS (SELECT state, count(DISTINCT c) AS n FROM m GROUP BY state) SELECT state, coalesce(n, 1)::INT AS n_components FROM x LEFT JOIN n USING (state)")
def components(spark, d):
    return N.circuit_components(V.q_table(spark, d), "ABC")


@query("feedback_loops", f"{Q}, {LINKS}, e AS MATERIALIZED (SELECT state, substr(i, 1, 1) AS a, substr(i, 2, 1) AS b, (i LIKE '%i')::INT AS n FROM (SELECT state, unnest(x) AS i FROM x) WHERE substr(i, 1, 1) <> substr(i, 2, 1)), c AS (SELECT p.state, p.n + q.n AS n FROM e p JOIN e q ON p.state = q.state AND p.b = q.a AND q.b = p.a AND p.a < p.b UNION ALL SELECT p.state, p.n + q.n + r.n FROM e p JOIN e q ON p.state = q.state AND p.b = q.a JOIN e r ON q.state = r.state AND q.b = r.a AND r.b = p.a WHERE p.a < p.b AND p.a < q.b AND p.b <> q.b) SELECT state, count(n)::INT AS n_loops FROM x LEFT JOIN (SELECT * FROM c WHERE n % 2 = 1) c USING (state) GROUP BY state")
def feedback_loops(spark, d):
    return N.feedback_loops(V.q_table(spark, d), "ABC")


@query("cheeger", f"{Q}, {LINKS}, e AS (SELECT DISTINCT state, least(substr(i, 1, 1), substr(i, 2, 1)) AS a, greatest(substr(i, 1, 1), substr(i, 2, 1)) AS b FROM (SELECT state, unnest(x) AS i FROM x) WHERE substr(i, 1, 1) <> substr(i, 2, 1)), s AS (SELECT unnest(['A', 'B', 'C']) AS c), k AS (SELECT x.state, c, count(a) FILTER (a = c OR b = c) AS n FROM x CROSS JOIN s LEFT JOIN e ON e.state = x.state GROUP BY ALL), v AS (SELECT *, sum(n) OVER (PARTITION BY state) AS total FROM k) SELECT state, min(CASE WHEN n > 0 THEN n / least(n, total - n) END)::DOUBLE AS cheeger FROM v GROUP BY state")
def cheeger(spark, d):
    return N.cheeger(V.q_table(spark, d), "ABC").select("state", F.col("cheeger").cast("double").alias("cheeger"))


CELLS = [a + b for a in "ABC" for b in "ABC" if a != b]
ORDERS = [[CELLS.index(dict(zip("ABC", p))[c[0]] + dict(zip("ABC", p))[c[1]]) for c in CELLS] for p in permutations("ABC")]
VECTOR = "[" + ", ".join(f"CASE WHEN list_contains(x, '{c}a') THEN 1 WHEN list_contains(x, '{c}i') THEN -1 ELSE 0 END" for c in CELLS) + "]"


@query("circuit_distances", f"{Q}, {LINKS}, t AS (SELECT state, {VECTOR} AS v FROM x), k AS (SELECT t.* FROM t JOIN q_table USING (state) WHERE visits >= 20) SELECT a.state AS a, b.state AS b, least(" + ", ".join("+".join(f"abs(a.v[{i + 1}] - b.v[{j + 1}])" for i, j in enumerate(o)) for o in ORDERS) + ")::INT AS distance FROM k a JOIN k b ON a.state < b.state")
def circuit_distances(spark, d):
    k = V.q_table(spark, d).where("visits >= 20").select("state")
    return N.circuit_distances(k, k, "ABC")


@query("cluster_circuits")
def cluster_circuits(spark, d):
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    ixns = G.interactions(F.col("state"))
    sign = lambda c: F.when(F.array_contains(ixns, c + "a"), 1.0).when(F.array_contains(ixns, c + "i"), -1.0).otherwise(0.0)
    canonical = V.q_table(spark, d).groupBy(G.canonical(F.col("state")).alias("state")).agg(F.sum("visits").alias("visits"))
    rows = cut(canonical).select("state", "visits", array_to_vector(F.array(*[sign(c) for c in CELLS])).alias("features"))  # the fit and its use read the circuits, not the lines
    model = BisectingKMeans(k=6, seed=7).fit(rows)
    return model.transform(rows).select("state", "visits", "prediction")


ENDS = f"{E}, {DEPTH}, ends AS MATERIALIZED (SELECT e.src, e.dst, s.reward::DOUBLE / greatest(1, s.visits) AS q_src, t.reward::DOUBLE / greatest(1, t.visits) AS q_dst FROM edges e JOIN nodes s ON s.node = e.src JOIN nodes t ON t.node = e.dst)"
H = "CASE WHEN {0} <= 0 OR {0} >= 1 THEN 0 ELSE -({0}) * log2({0}) - (1 - {0}) * log2(1 - {0}) END"


def _ends(spark, d):
    nodes, edges, depths = _graph(spark, d)
    q = nodes.select("node", (F.col("reward") / F.greatest(F.lit(1), F.col("visits"))).alias("q"))
    return N.edge_endpoints(edges.select("src", "dst"), q).withColumnsRenamed({"src_q": "q_src", "dst_q": "q_dst"}), nodes, edges, depths


@query("edge_endpoints", f"{ENDS} SELECT src, dst, round(q_src, 6) AS q_src, round(q_dst, 6) AS q_dst FROM ends")
def edge_endpoints(spark, d):
    return _ends(spark, d)[0].select("src", "dst", r6("q_src").alias("q_src"), r6("q_dst").alias("q_dst"))


@query("edge_gain", f"{QT}, g AS (SELECT s.q AS qs, t.q AS qd, r.q AS qr, e.src, e.dst FROM edges e JOIN qt s ON s.node = e.src JOIN qt t ON t.node = e.dst, (SELECT q FROM qt WHERE node = '{ROOT}') r) SELECT src, dst, round(qd - qs, 6) AS delta_q, round(CASE WHEN ({H.format('qr')}) > 0 THEN (({H.format('qr')}) - ({H.format('qd')})) / ({H.format('qr')}) END, 6) AS gain FROM g WHERE abs(qd - qs) > 1e-12")
def edge_gain(spark, d):
    nodes, edges, depths = _graph(spark, d)
    return N.edge_gain(edges, N.cut(N.q_tilde(nodes, edges, depths)), ROOT).select("src", "dst", r6("delta_q").alias("delta_q"), r6("gain").alias("gain"))


@query("layer_q", f"{E}, {DEPTH}, l AS (SELECT depth, count(*) AS n, avg(reward::DOUBLE / visits) AS m, stddev_samp(reward::DOUBLE / visits) / sqrt(count(*)) AS se FROM nodes JOIN depths USING (node) WHERE visits > 0 GROUP BY depth), f AS (SELECT m AS f FROM l ORDER BY depth LIMIT 1) SELECT depth, n, round(m, 6) AS mean_q, round(se, 6) AS se, round(CASE WHEN m > 0 AND f > 0 THEN log2(m / f) END, 6) AS log_ratio FROM l, f")
def layer_q(spark, d):
    nodes, _, depths = _graph(spark, d)
    return N.layer_q(nodes, depths).select("depth", "n", *[r6(c).alias(c) for c in ("mean_q", "se", "log_ratio")])


@query("edge_traffic", f"{E}, {DEPTH}, t AS (SELECT src, dst, depth, visits, sum(visits) OVER (PARTITION BY depth) AS s, count(*) OVER (PARTITION BY depth) AS n FROM edges JOIN depths ON node = dst) SELECT src, dst, round(CASE WHEN s > 0 THEN visits * n / s ELSE 0 END, 6) AS traffic FROM t")
def edge_traffic(spark, d):
    _, edges, depths = _graph(spark, d)
    return N.edge_traffic(edges.join(depths, edges.dst == depths.node)).select("src", "dst", r6("traffic").alias("traffic"))


@query("highlight_edges", f"{QT}, g AS (SELECT node, q FROM qt WHERE q > 0.4) SELECT src, dst, round(g.q, 6) AS q_tilde FROM edges JOIN g ON g.node = dst JOIN nodes s ON s.node = src WHERE s.visits >= 5 ORDER BY g.q DESC, src, dst LIMIT 20")
def highlight_edges(spark, d):
    nodes, edges, depths = _graph(spark, d)
    good = N.q_tilde(nodes, edges, depths).where("q_tilde > 0.4").select(F.col("node").alias("dst"), "q_tilde")
    busy = nodes.where("visits >= 5").select(F.col("node").alias("src"))
    out = edges.select("src", "dst").join(good, "dst").join(busy, "src")
    return W.top_n(out, [F.desc("q_tilde"), "src", "dst"], 20).select("src", "dst", r6("q_tilde").alias("q_tilde"))


def _block(start: int, size: int) -> str:
    p = f"(length(replace(substr(outcome, {start + 1}, {size}), '0', ''))::DOUBLE / {size})"
    return "(" + H.format(p) + ")"


@query("tree_modularity", V.ctes("bincodes") + f", o AS (SELECT DISTINCT outcome, {_block(0, 8)} AS h FROM bincodes) SELECT outcome, round(CASE WHEN h > 0 THEN (" + " + ".join("(" + " + ".join(f"(h - {_block(k * 8 // 2**layer, 8 // 2**layer)}) / h" for k in range(2**layer)) + f") / {2**layer}" for layer in (1, 2, 3)) + ") / 4 ELSE 0 END, 6) AS modularity FROM o")
def tree_modularity(spark, d):
    return N.tree_modularity(V.bincodes(spark, d).select("outcome").distinct(), 3).withColumn("modularity", r6("modularity"))


HEX = "WITH n AS (SELECT count(*) % 2 + 6 AS unused, 6 AS r, count(*)::BIGINT AS cols FROM supplier), p AS (SELECT i, i // cols AS r, i % cols AS c, cols FROM n, LATERAL (SELECT unnest(range(6 * cols)) AS i)), s AS (SELECT i, unnest([[r, c - 1], [r, c + 1], [r - 1, c + r % 2 - 1], [r - 1, c + r % 2], [r + 1, c + r % 2 - 1], [r + 1, c + r % 2]]) AS t, cols FROM p) SELECT DISTINCT i, ((t[1] + 6) % 6) * cols + (t[2] + cols) % cols AS j, round(1 / 6, 6) AS w FROM s"


@query("hex_adjacency", HEX)
def hex_adjacency(spark, d):
    return N.hex_adjacency(spark, 6, V.table(spark, d, "supplier").count(), True).withColumn("w", r6("w"))


@query("radius_join", "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), n AS (SELECT a.id AS i, b.id AS j, exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / (2 * 0.01 * 0.01)) AS w FROM p a JOIN p b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.01 * 0.01) SELECT i, j, round(w, 6) AS w, round(w / sum(w) OVER (PARTITION BY i), 6) AS w_row FROM n")
def radius_join(spark, d):
    points = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return N.radius_join(points, 0.01).select("i", "j", r6("w").alias("w"), r6("w_row").alias("w_row"))
