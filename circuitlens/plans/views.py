"""Bindings of the library's tables to the TPC-H-like tables, for Spark and, as CTEs, for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from circuitlens.functions import genotype as G

#: Table SQL that both dialects read; ``{name}`` is a source table.
COMMON = {
    "samples": "SELECT concat('p', l_partkey) AS state, l_suppkey AS param_idx, -10 * l_discount AS acf_min, l_quantity AS sim_time, l_orderkey, l_linenumber, l_extendedprice FROM {lineitem}",
    "params": "SELECT s_suppkey AS param_idx, CASE WHEN s_nationkey % 10 < 5 THEN '(none)' ELSE substr('ABCDE', s_nationkey % 5 + 1, 1) END AS component_mutation, s_acctbal FROM {supplier}",
    "search_log": "SELECT user_id % 12 AS replicate, row_number() OVER (PARTITION BY user_id % 12 ORDER BY ts, event_id) AS step, concat_ws('_', user_id, event_type) AS state, CASE WHEN value > 100 THEN 1 ELSE 0 END AS reward, value, event_id FROM {events}",
    "runtime": "SELECT o_orderkey, o_totalprice / 1000 AS runtime_secs, CAST(substr(o_orderpriority, 1, 1) AS INT) AS complexity, o_custkey, o_orderstatus FROM {orders}",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Views that only DuckDB reads; their Spark versions are functions below.
DUCK = {
    "circuits": """
        SELECT l_orderkey AS circuit_id, '*ABC::' || array_to_string(list_sort(list(xy || z)), '_') AS state, any_value(o_orderstatus = 'F') AS success
        FROM (SELECT l_orderkey, substr('ABC', l_linenumber % 3 + 1, 1) || substr('ABC', CAST(l_suppkey % 3 AS INT) + 1, 1) AS xy, min(CASE WHEN l_linestatus = 'F' THEN 'a' ELSE 'i' END) AS z
              FROM lineitem GROUP BY ALL) JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey""",
    "q_table": "SELECT state, count(*) AS visits, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS reward, avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS q FROM circuits GROUP BY state",
    "series": """
        SELECT event_type AS series_id, t, coalesce(n, 0)::DOUBLE AS value, coalesce(total, 0.0) AS total
        FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN (SELECT unnest(range((SELECT date_diff('hour', min(ts), max(ts)) FROM events) + 1)) AS t) g
        LEFT JOIN (SELECT event_type AS e, date_diff('hour', (SELECT min(ts) FROM events), ts) AS h, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL) ON e = event_type AND h = t""",
    "nodes": """
        SELECT node, coalesce(visits, 0) AS visits, coalesce(reward, 0) AS reward FROM (
            SELECT DISTINCT '*ABC::' || array_to_string(list_sort(list_filter(ixns, lambda x, i: (m >> (i - 1)) & 1 = 1)), '_') AS node
            FROM (SELECT list_filter(string_split(split_part(state, '::', 2), '_'), lambda x: x <> '') AS ixns FROM q_table), (SELECT unnest(range(512)) AS m) k WHERE m < (1 << len(ixns))
        ) LEFT JOIN q_table ON state = node""",
    "edges": """
        SELECT '*ABC::' || array_to_string(list_filter(ixns, lambda x: x <> ixn), '_') AS src, node AS dst, ixn, visits, reward
        FROM (SELECT node, visits, reward, ixns, unnest(ixns) AS ixn FROM (SELECT *, list_filter(string_split(split_part(node, '::', 2), '_'), lambda x: x <> '') AS ixns FROM nodes))""",
    "bincodes": "SELECT p_partkey, lpad(bin(p_size), 8, '0') AS outcome, p_retailprice, CASE WHEN CAST(floor(p_retailprice) AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END AS reward FROM part",
    "snapshots": """
        SELECT replicate, s::INT AS s, s * every AS step, state, count(*) AS visits, CAST(sum(reward) AS BIGINT) AS reward, sum(reward)::DOUBLE / count(*) AS q
        FROM search_log CROSS JOIN stride JOIN (SELECT unnest(range(1, 11)) AS s) g ON step <= s * every GROUP BY replicate, s, every, state""",
    "stride": "SELECT CAST(ceil(max(step) / 10) AS BIGINT) AS every FROM search_log",
    "truth": "SELECT state, avg(reward) AS true_q FROM search_log GROUP BY state",
}
NEEDS = {"q_table": ["circuits"], "nodes": ["circuits", "q_table"], "edges": ["circuits", "q_table", "nodes"], "stride": ["search_log"], "snapshots": ["search_log", "stride"], "truth": ["search_log"]}


def ctes(*names: str, recursive: bool = False) -> str:
    """A WITH clause with the named views and those they need."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in [*NEEDS.get(name, []), name] if n not in wanted]
    plain = {t: t for t in TABLES}
    parts = [f"{n} AS MATERIALIZED ({DUCK[n] if n in DUCK else COMMON[n].format(**plain)})" for n in wanted]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)


def erfc(x: str) -> str:
    """DuckDB SQL of the complementary error function, by the series of the error function."""
    term = f"exp(ln({x}) + n * ln(2 * ({x}) * ({x})) - (n + 1) * ln(2) - lgamma(n + 1.5) + ln(pi()) / 2 - ({x}) * ({x}))"
    return f"(CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} > 12 THEN 0.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 400), lambda n: {term}))) END)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def common(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in COMMON[name]}
    return spark.sql(COMMON[name], **used)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common(spark, sf_dir, "samples")


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common(spark, sf_dir, "params")


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with the step of every row in its replicate, numbered within hours after the counts of the hours before.

    So no task orders all rows of a replicate.
    """
    events = table(spark, sf_dir, "events").withColumns({"replicate": F.col("user_id") % 12, "hour": F.date_trunc("hour", "ts")})
    before = F.sum("n").over(Window.partitionBy("replicate").orderBy("hour")) - F.col("n")
    hours = events.groupBy("replicate", "hour").agg(F.count("*").alias("n")).select("replicate", "hour", before.alias("before"))  # a row an hour
    place = F.row_number().over(Window.partitionBy("replicate", "hour").orderBy("ts", "event_id"))
    placed = events.withColumn("place", place).join(hours, ["replicate", "hour"])
    reward = F.when(F.col("value") > 100, 1).otherwise(0)
    return placed.select("replicate", (F.col("before") + F.col("place")).alias("step"), F.concat_ws("_", "user_id", "event_type").alias("state"), reward.alias("reward"), "value", "event_id")


def runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common(spark, sf_dir, "runtime")


CELLS = [a + b for a in "ABC" for b in "ABC"]


def coded_circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circuits as (circuit_id, code, success): a bit for each pair of components that interacts, and one for each that activates.

    So an order's lines are one number wherever they are added up, and names are made of numbers once they are few.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    cell = F.pmod(F.col("l_linenumber"), F.lit(3)) * 3 + F.pmod(F.col("l_suppkey"), F.lit(3))
    marked = lines.select(F.col("l_orderkey").alias("circuit_id"), cell.cast("int").alias("cell"), (F.col("l_linestatus") == "F").alias("active"))
    bits = marked.select("circuit_id", F.expr(f"shiftleft(CASE WHEN active THEN {1 + 2 ** len(CELLS)} ELSE 1 END, cell)").alias("bits"))
    coded = bits.groupBy("circuit_id").agg(F.coalesce(F.bit_or("bits"), F.lit(0)).alias("code"))
    return coded.join(orders.select(F.col("o_orderkey").alias("circuit_id"), (F.col("o_orderstatus") == "F").alias("success")), "circuit_id")


def decoded(code: Column) -> Column:
    """The genotype of a circuit's number."""
    seen = lambda bit: code.bitwiseAND(F.lit(1 << bit)) != 0
    ixns = [F.when(seen(k + len(CELLS)), c + "a").when(seen(k), c + "i") for k, c in enumerate(CELLS)]
    return F.concat(F.lit("*ABC::"), F.concat_ws("_", *ixns))


def circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_circuits(spark, sf_dir).select("circuit_id", decoded(F.col("code")).alias("state"), "success")


def q_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coded_circuits(spark, sf_dir).groupBy("code").agg(F.count("*").alias("visits"), F.count_if("success").alias("reward"))
    return found.select(decoded(F.col("code")).alias("state"), "visits", "reward", (F.col("reward") / F.col("visits")).alias("q"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and hour, from the first to the last hour of the table."""
    events = table(spark, sf_dir, "events")
    ends = events.agg(*[F.floor(F.unix_timestamp(f("ts")) / 3600).alias(n) for n, f in (("first", F.min), ("last", F.max))])
    hour = (F.floor(F.unix_timestamp("ts") / 3600) - F.col("first")).cast("int")
    counts = events.crossJoin(F.broadcast(ends)).groupBy(F.col("event_type").alias("series_id"), hour.alias("t")).agg(F.count("*").cast("double").alias("value"), F.round(F.sum("value"), 4).alias("total"))  # a row of ends
    hours = F.explode(F.sequence(F.lit(0), (F.col("last") - F.col("first")).cast("int")))
    grid = counts.select("series_id").distinct().crossJoin(F.broadcast(ends)).select("series_id", hours.alias("t"))
    return grid.join(counts, ["series_id", "t"], "left").na.fill(0.0, ["value", "total"])


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every genotype that some observed one contains, with the visits and successes of its own circuits."""
    seen = q_table(spark, sf_dir)
    ixns = seen.select(G.interactions(F.col("state")).alias("ixns"))
    masks = ixns.withColumn("m", F.explode(F.sequence(F.lit(0), F.expr("cast(shiftleft(1, size(ixns)) - 1 as int)"))))
    kept = F.expr("filter(ixns, (x, i) -> shiftright(m, i) & 1 = 1)")
    closed = masks.select(G.genotype(F.lit("ABC"), kept).alias("node")).distinct()
    return closed.join(seen, closed.node == seen.state, "left").select("node", F.coalesce("visits", F.lit(0)).alias("visits"), F.coalesce("reward", F.lit(0)).alias("reward"))


def edges_of(all_nodes: DataFrame) -> DataFrame:
    """One edge to each node from every node with one interaction less."""
    out = all_nodes.withColumn("ixn", F.explode(G.interactions(F.col("node"))))
    parent = F.concat(F.lit("*ABC::"), F.array_join(F.filter(G.interactions(F.col("node")), lambda x: x != F.col("ixn")), "_"))
    return out.select(parent.alias("src"), F.col("node").alias("dst"), "ixn", "visits", "reward")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(nodes(spark, sf_dir))


def bincodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    even = F.floor("p_retailprice") % 2 == 0
    return parts.select("p_partkey", F.lpad(F.bin("p_size"), 8, "0").alias("outcome"), "p_retailprice", F.when(even, 1).otherwise(0).alias("reward"))


def stride(log: DataFrame, count: int = 10) -> DataFrame:
    """Steps between ``count`` checkpoints of which the last lies at or after the log's greatest step: one row."""
    return log.agg(F.ceil(F.max("step") / count).alias("every"))


def snapshots(spark: SparkSession, sf_dir: str, count: int = 10) -> DataFrame:
    """Totals per replicate and state after each of ``count`` checkpoints (``s``) over the whole log: one pass, then running sums."""
    log = search_log(spark, sf_dir)
    parts = log.crossJoin(F.broadcast(stride(log, count))).groupBy("replicate", "state", "every", F.ceil(F.col("step") / F.col("every")).cast("int").alias("s")).agg(F.count("*").alias("v"), F.sum("reward").alias("r"))  # one number
    first = parts.groupBy("replicate", "state", "every").agg(F.min("s").alias("from"))
    grid = first.withColumn("s", F.explode(F.sequence("from", F.lit(count)))).select("replicate", "state", "every", "s")
    w = Window.partitionBy("replicate", "state").orderBy("s")
    filled = grid.join(parts.drop("every"), ["replicate", "state", "s"], "left")
    totals = filled.select("replicate", "s", (F.col("s") * F.col("every")).cast("bigint").alias("step"), "state", F.sum(F.coalesce("v", F.lit(0))).over(w).alias("visits"), F.sum(F.coalesce("r", F.lit(0))).over(w).alias("reward"))
    return totals.withColumn("q", F.col("reward") / F.col("visits"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_log(spark, sf_dir).groupBy("state").agg(F.avg("reward").alias("true_q"))
