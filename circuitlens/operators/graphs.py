"""Search graphs as tables of nodes and edges, and the graphs that circuits are.

Iterations go layer by layer over the number of interactions, of which a
circuit has a few; each layer is handed on as a checkpoint.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from circuitlens.functions import genotype as G
from circuitlens.sources.shared import cut


def enumerate_circuits(spark: SparkSession, names: str, max_ixn: int, interchangeable: bool = True) -> DataFrame:
    """Every circuit that adding one interaction at a time reaches, one per orbit if components are interchangeable."""
    ixns = F.explode(F.array(*[F.lit(a + b + s) for a in names for b in names for s in "ai"]))
    form = (lambda s: G.canonical(s, names)) if interchangeable else (lambda s: s)
    layer = spark.createDataFrame([(f"*{names}::",)], "state string")
    layers = [layer]
    for _ in range(max_ixn):
        own = G.interactions(F.col("state"))
        fresh = layer.withColumn("ixn", ixns).where(~F.exists(own, lambda x: F.substring(x, 1, 2) == F.substring("ixn", 1, 2)))
        grown = F.concat(F.lit(f"*{names}::"), F.array_join(F.array_sort(F.concat(own, F.array("ixn"))), "_"))
        layer = cut(fresh.select(form(grown).alias("state")).distinct())
        layers.append(layer)
    out = layers[0]
    for one in layers[1:]:
        out = out.union(one)
    return out


def grow_circuits(circuits: DataFrame, names: str, interchangeable: bool = True) -> DataFrame:
    """Every circuit with each one that a further interaction between two components makes of it: (state, grown).

    A pair of components has one interaction in each direction; ``grown`` is
    the canonical form if components are interchangeable, each once. Equal rows
    count once; a circuit with all interactions grows into none.
    """
    own = G.interactions(F.col("state"))
    ixns = F.explode(F.array(*[F.lit(a + b + s) for a in names for b in names for s in "ai"]))
    fresh = circuits.select("state").distinct().withColumn("ixn", ixns).where(~F.exists(own, lambda x: F.substring(x, 1, 2) == F.substring("ixn", 1, 2)))
    grown = F.concat(F.lit(f"*{names}::"), F.array_join(F.array_sort(F.concat(own, F.array("ixn"))), "_"))
    return fresh.select("state", (G.canonical(grown, names) if interchangeable else grown).alias("grown")).distinct()


def binary_tree(spark: SparkSession, depth: int) -> DataFrame:
    """The complete tree of binary prefixes: (node, parent, depth), the root an empty string."""
    level = spark.range(2 ** (depth + 1) - 1).select((F.col("id") + 1).alias("i"))
    node = F.substring(F.bin("i"), 2, depth + 1)  # a heap index without its leading one is the path
    return level.select(node.alias("node"), F.length(node).alias("depth")).select("node", F.when(F.col("depth") > 0, F.expr("substring(node, 1, depth - 1)")).alias("parent"), "depth")


def bfs_layers(edges: DataFrame, root: str, max_depth: int = 64) -> DataFrame:
    """Depth of every node that the root reaches: (node, depth), by frontiers without what was seen."""
    seen = frontier = edges.sparkSession.createDataFrame([(root, 0)], "node string, depth int")
    links = edges.select("src", "dst").distinct()
    for k in range(1, max_depth + 1):
        step = frontier.join(links, frontier.node == links.src).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"deeper than {max_depth}")


def successful_nodes(nodes: DataFrame, cutoff: float) -> DataFrame:
    """Nodes whose mean reward, over max(1, visits), reaches the cut-off."""
    q = F.col("reward") / F.greatest(F.lit(1), F.col("visits"))
    return nodes.withColumn("q", q).where(F.col("q") >= cutoff)


def deepest(depths: DataFrame) -> int:
    return depths.agg(F.max("depth")).first()[0]


def q_tilde(nodes: DataFrame, edges: DataFrame, depths: DataFrame) -> DataFrame:
    """Leaves have their mean reward, inner nodes the mean of their children: (node, q_tilde, loss).

    From the deepest layer up; every edge leads one layer down (``depths``),
    so a layer needs the one below it and no other, and only that is handed on.
    """
    links = edges.select("src", "dst").distinct()
    inner = links.select(F.col("src").alias("node")).distinct()
    own = nodes.select("node", (F.col("reward") / F.greatest(F.lit(1), F.col("visits"))).alias("q_tilde")).join(inner, "node", "left_anti")
    own, links = cut(own.join(depths, "node")), cut(links.join(depths.withColumnRenamed("node", "src"), "src"))
    layer = done = None
    for depth in range(deepest(depths), -1, -1):
        leaves = own.where(F.col("depth") == depth).select("node", "q_tilde")
        if layer is not None:
            at = links.where(F.col("depth") == depth).join(layer, F.col("dst") == layer["node"])
            leaves = leaves.unionByName(at.groupBy(F.col("src").alias("node")).agg(F.avg("q_tilde").alias("q_tilde")))
        layer = cut(leaves)
        done = layer if done is None else done.unionByName(layer)
    return done.withColumn("loss", 1 - F.col("q_tilde"))


def reachable(edges: DataFrame, start: str) -> DataFrame:
    return bfs_layers(edges, start).select("node")


def reachability(edges: DataFrame, targets: DataFrame, max_depth: int = 64) -> DataFrame:
    """Every node with every target that it reaches, a target with itself: (node, target), each pair once.

    All starts at once, from the targets up: a step leads the pairs found last
    to their sources, without the pairs that are known. ``targets`` has a column ``node``.
    Targets that no edge names reach themselves.
    """
    links = cut(edges.select("src", "dst").distinct())
    seen = frontier = cut(targets.select("node", F.col("node").alias("target")).distinct())
    for _ in range(max_depth):
        up = links.join(frontier, links.dst == frontier.node).select(F.col("src").alias("node"), "target").distinct()
        frontier = cut(up.join(seen, ["node", "target"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.union(frontier))
    raise RuntimeError(f"deeper than {max_depth}")


def exhausted(nodes: DataFrame, edges: DataFrame, depths: DataFrame, least: int) -> DataFrame:
    """Whether nothing is left to try below a node: (node, exhausted).

    A circuit that was visited is done after ``least`` visits. A node is
    exhausted when its own circuit is done, if it was ever visited, and all
    of its children are exhausted; a leaf that was never visited is not. From the deepest layer up, with
    the children and those exhausted counted; every edge leads one layer down.
    """
    links = edges.select("src", "dst").distinct()
    children = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("children"))
    own = cut(nodes.select("node", "visits").join(depths, "node").join(children, "node", "left").na.fill(0, ["children"]))
    links = cut(links.join(depths.withColumnRenamed("node", "src"), "src"))
    layer = done = None
    for depth in range(deepest(depths), -1, -1):
        here = own.where(F.col("depth") == depth)
        if layer is None:
            here = here.withColumn("below", F.lit(0).cast("bigint"))
        else:
            spent = links.where(F.col("depth") == depth).join(layer.where("exhausted").select(F.col("node").alias("dst")), "dst", "left_semi")
            here = here.join(spent.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("below")), "node", "left").na.fill(0, ["below"])
        tried = (F.col("visits") >= least) | ((F.col("visits") == 0) & (F.col("children") > 0))
        layer = cut(here.select("node", (tried & (F.col("below") == F.col("children"))).alias("exhausted")))
        done = layer if done is None else done.unionByName(layer)
    return done


def exhausted_edges(edges: DataFrame, done: DataFrame, rates: DataFrame, good: float) -> DataFrame:
    """Edges from exhausted nodes to nodes that are exhausted as well or whose ``q_tilde`` lies above ``good``: (src, dst, q_tilde, exhausted).

    ``done`` has (node, exhausted): from ``exhausted``, or by the visits of a node's own circuit.
    """
    ends = done.join(rates.select("node", "q_tilde"), "node")
    out = edges.select("src", "dst").distinct().join(done.where("exhausted").select(F.col("node").alias("src")), "src", "left_semi")
    out = out.join(ends.withColumnRenamed("node", "dst"), "dst")
    return out.where(F.col("exhausted") | (F.col("q_tilde") > good)).select("src", "dst", "q_tilde", "exhausted")


def merge_graphs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The union of replicate graphs, visits and rewards summed."""
    sums = [F.sum("visits").alias("visits"), F.sum("reward").alias("reward")]
    return nodes.groupBy("node").agg(*sums), edges.groupBy("src", "dst").agg(*sums)


def merge_attributes(rows: DataFrame, keys: list[str], order: str, attributes: list[str] | None = None) -> DataFrame:
    """Nodes or edges of several graphs as one table, each key once.

    Numeric attributes are summed, or those of them that ``attributes`` names;
    others have the value of the first graph by ``order`` that has the key. Missing numbers count
    as 0.
    """
    columns = [f for f in rows.schema.fields if f.name not in (*keys, order)]
    summed = [f.name for f in columns if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") and (attributes is None or f.name in attributes)]
    return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(f.name), F.lit(0)).alias(f.name) if f.name in summed else F.min_by(f.name, order).alias(f.name) for f in columns])


def pattern_candidates(nodes: DataFrame, edges: DataFrame, root: str, to_depth: int, cutoff: float) -> DataFrame:
    """Nodes of the first layers whose own circuit succeeded: (pattern, depth), without the root.

    A circuit succeeded if it was visited and its mean reward reaches the
    cut-off; the pattern is the part of the name behind the components.
    """
    good = successful_nodes(nodes.where("visits > 0"), cutoff).select("node")
    near = bfs_layers(edges, root).where((F.col("depth") > 0) & (F.col("depth") <= to_depth))
    return near.join(good, "node", "left_semi").select(G.edge_code(F.col("node")).alias("pattern"), "depth")


def complexity_graph(edges: DataFrame, successes: DataFrame) -> DataFrame:
    """Edges between successful circuits."""
    good = successes.select("node").distinct()
    return edges.join(good.withColumnRenamed("node", "src"), "src", "left_semi").join(good.withColumnRenamed("node", "dst"), "dst", "left_semi")


def min_arborescence(edges: DataFrame, weight: str) -> DataFrame:
    """Cheapest edge into every node, the first source among ties; in a graph without cycles, the least spanning tree."""
    return edges.groupBy("dst").agg(F.min(F.struct(F.col(weight).alias("w"), F.col("src").alias("s"))).alias("m")).select(F.col("m.s").alias("src"), "dst", F.col("m.w").alias(weight))


def prune_to_leaves(edges: DataFrame, keep: DataFrame, max_depth: int = 64) -> DataFrame:
    """Edges on some path to a kept node: ancestors layer by layer."""
    links = edges.select("src", "dst").distinct()
    seen = frontier = cut(keep.select("node").distinct())
    for _ in range(max_depth):
        up = links.join(frontier, links.dst == frontier.node).select(F.col("src").alias("node")).distinct()
        frontier = cut(up.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return edges.join(seen.withColumnRenamed("node", "dst"), "dst", "left_semi")
        seen = cut(seen.union(frontier))
    raise RuntimeError(f"deeper than {max_depth}")


def shortest_paths(edges: DataFrame, root: str, depths: DataFrame, weight: str) -> DataFrame:
    """Cheapest path from the root, the first in code-point order among ties: (node, cost, path), layer by layer.

    Every edge leads one layer down (``depths``), so a layer needs the edges that leave the one above it and no others.
    """
    links = edges.select("src", "dst", F.col(weight).alias("w")).join(depths.select(F.col("node").alias("src"), "depth"), "src")
    links = cut(links)
    done = frontier = edges.sparkSession.createDataFrame([(root, 0.0, root)], "node string, cost double, path string")
    for depth in range(deepest(depths)):
        step = frontier.join(links.where(F.col("depth") == depth), frontier.node == links.src).select(F.col("dst").alias("node"), F.round(F.col("cost") + F.col("w"), 9).alias("cost"), F.concat_ws(">", "path", "dst").alias("path"))
        frontier = cut(step.groupBy("node").agg(F.min(F.struct("cost", "path")).alias("m")).select("node", "m.cost", "m.path"))
        done = done.union(frontier)
    return done


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree of every node: a source has none in, a leaf none out."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def circuit_components(states: DataFrame, names: str) -> DataFrame:
    """Number of connected components per circuit, isolated components left out; 1 for the root.

    A label per component, in a string, starts as its own letter; every
    interaction replaces the greater of its two labels by the lesser one.
    """
    letters = {c: k + 1 for k, c in enumerate(names)}
    ixns = G.interactions(F.col("state"))

    def of(acc: Column, x: Column, place: int) -> Column:
        found = F.lit("")
        for c, k in letters.items():
            found = F.when(F.substring(x, place, 1) == c, F.substring(acc, k, 1)).otherwise(found)
        return found

    merged = F.aggregate(ixns, F.lit(names), lambda acc, x: F.call_function("translate", acc, F.greatest(of(acc, x, 1), of(acc, x, 2)), F.least(of(acc, x, 1), of(acc, x, 2))))
    rows = states.select("state", merged.alias("label"), F.array_join(F.transform(ixns, lambda x: F.substring(x, 1, 2)), "").alias("used"))
    roots = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(F.col("used"), F.lit(c)), F.substring("label", k, 1)) for c, k in letters.items()])))
    return rows.select("state", F.greatest(F.lit(1), F.size(roots)).alias("n_components"))


def feedback_loops(states: DataFrame, names: str) -> DataFrame:
    """Negative feedback loops per circuit: simple cycles of two or more with an odd number of inhibitions.

    The cycles of the component set, each written once from its first letter,
    are few; each is looked up in the circuit's interactions in every sign.
    """
    ixns = G.interactions(F.col("state"))
    total = F.lit(0)
    for size in range(2, len(names) + 1):
        for chosen in combinations(names, size):
            for rest in permutations(chosen[1:]):
                cycle = [chosen[0], *rest]
                steps = [a + b for a, b in zip(cycle, cycle[1:] + cycle[:1])]
                there = F.lit(True)
                odd = F.lit(0)
                for step in steps:
                    there = there & (F.array_contains(ixns, step + "a") | F.array_contains(ixns, step + "i"))
                    odd = odd + F.array_contains(ixns, step + "i").cast("int")
                total = total + F.when(there & (odd % 2 == 1), 1).otherwise(0)
    return states.select("state", total.alias("n_loops"))


def cheeger(states: DataFrame, names: str) -> DataFrame:
    """Least conductance of a circuit: crossing edges over the lesser volume, over subsets of at most half of its components.

    Edges are undirected and counted once, self-loops and components without
    an edge are left out; the volume of a subset is the sum of its degrees.
    Null for a circuit without edges, 0 for one in several pieces.
    """
    ixns = G.interactions(F.col("state"))
    rows = states.select("state", *[F.exists(ixns, _is_link(a, b)).cast("int").alias(f"__{a}{b}") for a, b in combinations(names, 2)])
    degree = {c: sum((F.col(f"__{a}{b}") for a, b in combinations(names, 2) if c in (a, b)), F.lit(0)) for c in names}
    rows = rows.withColumns({f"__{c}": d for c, d in degree.items()})
    rows = rows.withColumns({"__n": sum((F.when(F.col(f"__{c}") > 0, 1).otherwise(0) for c in names), F.lit(0)), "__all": sum((F.col(f"__{c}") for c in names), F.lit(0))})
    values = []
    for size in range(1, len(names) // 2 + 1):
        for chosen in combinations(names, size):
            crossing = sum((F.col(f"__{a}{b}") for a, b in combinations(names, 2) if (a in chosen) != (b in chosen)), F.lit(0))
            volume = sum((F.col(f"__{c}") for c in chosen), F.lit(0))
            there = F.least(F.lit(9), *[F.col(f"__{c}") for c in chosen]) > 0
            values.append(F.when(there & (F.lit(2 * size) <= F.col("__n")), crossing / F.least(volume, F.col("__all") - volume)))
    return rows.select("state", F.array_min(F.array(*values)).alias("cheeger"))


def _is_link(a: str, b: str):
    return lambda x: F.substring(x, 1, 2).isin(a + b, b + a)


def circuit_distances(left: DataFrame, right: DataFrame, names: str) -> DataFrame:
    """Signed edit distance of all pairs of the two tables with different states: the least over relabellings.

    Distance of fixed components is the sum over ordered pairs of different
    components of |a - b| of their signs (1, -1, 0); self-loops don't count. One side meets the other in blocks: pass distinct
    states, of which there are few next to samples.
    """
    cells = [a + b for a in names for b in names if a != b]
    sign = lambda ixns, cell: F.when(F.array_contains(ixns, cell + "a"), 1).when(F.array_contains(ixns, cell + "i"), -1).otherwise(0)
    vector = lambda df: df.select("state", F.array(*[sign(G.interactions(F.col("state")), c) for c in cells]).alias("v"))
    orders = []
    for p in permutations(names):
        moved = dict(zip(names, p))
        orders.append([cells.index(moved[c[0]] + moved[c[1]]) for c in cells])
    a, b = vector(left).toDF("a", "va"), vector(right).toDF("b", "vb")
    distance = F.least(*[sum((F.abs(F.col("va")[i] - F.col("vb")[j]) for i, j in enumerate(order)), F.lit(0)) for order in orders])
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", distance.alias("distance"))


def edge_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the attributes of both ends, prefixed."""
    a = nodes.select(*[F.col(c).alias(f"src_{c}" if c != "node" else "src") for c in nodes.columns])
    b = nodes.select(*[F.col(c).alias(f"dst_{c}" if c != "node" else "dst") for c in nodes.columns])
    return edges.join(a, "src").join(b, "dst")


def entropy(p: Column) -> Column:
    """Binary entropy, 0 at 0 and 1."""
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def edge_gain(edges: DataFrame, rates: DataFrame, root: str) -> DataFrame:
    """Per edge the change of q_tilde from parent to child, and the child's information gain relative to the root; edges without change go."""
    q = rates.select("node", "q_tilde")
    base = q.where(F.col("node") == root).select(F.col("q_tilde").alias("q_root"))
    ends = edge_endpoints(edges.select("src", "dst"), q).crossJoin(F.broadcast(base))  # the root's row
    delta = F.col("dst_q_tilde") - F.col("src_q_tilde")
    return ends.where(F.abs(delta) > 1e-12).select("src", "dst", delta.alias("delta_q"), information_gain(F.col("dst_q_tilde"), F.col("q_root")).alias("gain"))


def layer_q(nodes: DataFrame, depths: DataFrame) -> DataFrame:
    """Per layer: nodes that were visited, mean rate, its standard error, and log2 of the mean over the first layer's."""
    rates = nodes.where("visits > 0").select("node", (F.col("reward") / F.col("visits")).alias("q")).join(depths, "node")
    layers = rates.groupBy("depth").agg(F.count("*").alias("n"), F.avg("q").alias("mean_q"), (F.stddev_samp("q") / F.sqrt(F.count("*"))).alias("se"))
    first = layers.agg(F.min_by("mean_q", "depth").alias("__first"))
    ratio = F.when((F.col("mean_q") > 0) & (F.col("__first") > 0), F.log2(F.col("mean_q") / F.col("__first")))
    return layers.crossJoin(F.broadcast(first)).withColumn("log_ratio", ratio).drop("__first")  # one rate


def edge_traffic(edges: DataFrame) -> DataFrame:
    """Visits of an edge over the mean visits of the edges at its depth."""
    layers = edges.groupBy("depth").agg(F.sum("visits").alias("__sum"), F.count("*").alias("__n"))
    joined = edges.join(F.broadcast(layers), "depth")  # a row for each layer
    return joined.withColumn("traffic", F.when(F.col("__sum") > 0, F.col("visits") * F.col("__n") / F.col("__sum")).otherwise(0.0)).drop("__sum", "__n")


def information_gain(p: Column, root: Column) -> Column:
    """What is learnt about a success of rate ``root`` by a rate ``p``, in proportion; null where nothing is left to learn."""
    return F.when(entropy(root) > 0, (entropy(root) - entropy(p)) / entropy(root))


def tree_modularity(leaves: DataFrame, depth: int) -> DataFrame:
    """Mean information gain over layers of a binary tree whose leaves have 0/1 rewards: (outcome, modularity).

    ``leaves`` has an ``outcome`` string of 2 ** depth digits. A node's rate is
    that of its leaves; a layer's gain is the mean over its nodes of their gain
    relative to the root, and the layers from the root (gain 0) to the leaves
    (gain 1) count alike. 0 where all leaves are equal. This is the definition
    of the layer loop with rates of leaves, not of all nodes below.
    """
    root = _share("outcome", 0, 2**depth)
    total = F.lit(0.0)
    for layer in range(1, depth + 1):
        size = 2 ** (depth - layer)
        total = total + sum((information_gain(_share("outcome", k * size, size), root) for k in range(2**layer)), F.lit(0.0)) / 2**layer
    return leaves.select("outcome", F.coalesce(total / (depth + 1), F.lit(0.0)).alias("modularity"))


def _share(column: str, start: int, size: int) -> Column:
    return F.length(F.regexp_replace(F.substring(column, start + 1, size), "0", "")) / size


def hex_adjacency(spark: SparkSession, rows: int, cols: int, periodic: bool) -> DataFrame:
    """Neighbours on a hexagonal lattice, weight 1/6: (i, j, w); odd rows lie half a cell to the right.

    Wrapping rows needs an even number of them.
    """
    if periodic and rows % 2:
        raise ValueError("a periodic lattice needs an even number of rows")
    at = spark.range(rows * cols).select(F.col("id").alias("i"), F.floor(F.col("id") / cols).alias("r"), (F.col("id") % cols).alias("c"))
    odd = F.col("r") % 2
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), dc.alias("dc")) for dr, dc in ((0, F.lit(-1)), (0, F.lit(1)), (-1, odd - 1), (-1, odd), (1, odd - 1), (1, odd))])
    near = at.withColumn("s", F.explode(steps)).select("i", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"))
    if periodic:
        near = near.select("i", F.pmod("r", F.lit(rows)).alias("r"), F.pmod("c", F.lit(cols)).alias("c"))
    else:
        near = near.where(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1))
    return near.select("i", (F.col("r") * cols + F.col("c")).cast("bigint").alias("j"), F.lit(1 / 6).alias("w")).distinct()


def radius_join(points: DataFrame, radius: float, id_col: str = "id") -> DataFrame:
    """Ordered pairs of different points within ``radius``, with a Gaussian weight and its share of the row's sum.

    Points fall into square cells of that size and meet those of the nine
    cells around them, so the join is on cells; the distance is checked after.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    a = points.select(F.col(id_col).alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), cell("x").alias("cx"), cell("y").alias("cy"))
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    b = points.select(F.col(id_col).alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), cell("x").alias("bx"), cell("y").alias("by"), F.explode(shifts).alias("s"))
    b = b.select("j", "xj", "yj", (F.col("bx") + F.col("s.dx")).alias("cx"), (F.col("by") + F.col("s.dy")).alias("cy"))
    d2 = (F.col("xi") - F.col("xj")) * (F.col("xi") - F.col("xj")) + (F.col("yi") - F.col("yj")) * (F.col("yi") - F.col("yj"))
    near = a.join(b, ["cx", "cy"]).where((F.col("i") != F.col("j")) & (d2 <= radius * radius)).withColumn("w", F.exp(-d2 / (2 * radius * radius)))
    sums = near.groupBy("i").agg(F.sum("w").alias("total"))
    return near.join(sums, "i").select("i", "j", "w", (F.col("w") / F.col("total")).alias("w_row"))


def hex_cells(points: DataFrame, size: float) -> DataFrame:
    """Points counted by the cells of a lattice of hexagons with the side ``size``: axial coordinates and counts (i, j, n).

    Cells stand on a corner, that of (0, 0) around the origin. Points with a missing coordinate are left out.
    """
    q, r = (F.sqrt(F.lit(3.0)) / 3 * F.col("x") - F.col("y") / 3) / size, (F.lit(2.0) / 3 * F.col("y")) / size
    near = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(q.alias("q"), r.alias("r"), (-q - r).alias("s"))
    whole = near.select("q", "r", "s", *[F.round(c).alias(f"r{c}") for c in "qrs"])
    off = {c: F.abs(F.col(f"r{c}") - F.col(c)) for c in "qrs"}  # of the three rounded coordinates, whose sum is 0, the worst follows from the others
    worst_q, worst_r = (off["q"] > off["r"]) & (off["q"] > off["s"]), off["r"] > off["s"]
    i = F.when(worst_q, -F.col("rr") - F.col("rs")).otherwise(F.col("rq"))
    j = F.when(~worst_q & worst_r, -F.col("rq") - F.col("rs")).otherwise(F.col("rr"))
    return whole.groupBy(i.cast("bigint").alias("i"), j.cast("bigint").alias("j")).agg(F.count("*").alias("n"))


def hex_neighbours(cells: DataFrame) -> DataFrame:
    """Occupied cells with their occupied neighbours, weighted by the neighbour's share of all neighbours' points: (i, j, k, l, w)."""
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)]
    around = F.explode(F.array(*[F.struct((F.col("i") + a).alias("k"), (F.col("j") + b).alias("l")) for a, b in steps]))
    beside = cells.select("i", "j", around.alias("o")).select("i", "j", "o.k", "o.l").join(cells.select(F.col("i").alias("k"), F.col("j").alias("l"), F.col("n").alias("m")), ["k", "l"])
    return beside.withColumn("w", F.col("m") / F.sum("m").over(Window.partitionBy("i", "j"))).select("i", "j", "k", "l", "w")  # six rows a window
