"""Queries on search logs, snapshots and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from circuitlens.functions import genotype as G
from circuitlens.operators import search as W
from circuitlens.plans import views as V

QUERIES, ORACLES = {}, {}
r6 = lambda c: F.round(c, 6)
L, SN = V.ctes("search_log"), V.ctes("search_log", "snapshots")
ST, Q = V.ctes("search_log", "snapshots", "truth"), V.ctes("circuits", "q_table")
SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


@query("regret", f"{L} SELECT replicate, step, sum(1 - reward) OVER (PARTITION BY replicate ORDER BY step {SO_FAR})::DOUBLE AS regret, round((1 - avg(reward) OVER (PARTITION BY replicate)) * step, 6) AS naive FROM search_log")
def regret(spark, d):
    return W.regret(V.search_log(spark, d)).select("replicate", "step", "regret", r6("naive").alias("naive"))


RQ = f"{L}, r AS (SELECT replicate, step, state, count(*) OVER w AS cum_visits, sum(reward) OVER w::BIGINT AS cum_reward FROM search_log WINDOW w AS (PARTITION BY replicate, state ORDER BY step {SO_FAR}))".replace("sum(reward) OVER w::BIGINT", "CAST(sum(reward) OVER w AS BIGINT)")


@query("running_q", f"{RQ} SELECT *, round(cum_reward / cum_visits, 6) AS cum_q FROM r")
def running_q(spark, d):
    return W.running_q(V.search_log(spark, d)).select("replicate", "step", "state", "cum_visits", "cum_reward", r6("cum_q").alias("cum_q"))


@query("running_success_count", f"{RQ}, f AS (SELECT *, (cum_reward / cum_visits > 0.2)::INT AS above FROM r), g AS (SELECT *, above - coalesce(lag(above) OVER (PARTITION BY replicate, state ORDER BY step), 0) AS delta FROM f) SELECT replicate, step, CAST(sum(delta) OVER (PARTITION BY replicate ORDER BY step {SO_FAR}) AS BIGINT) AS n_above FROM g")
def running_success_count(spark, d):
    return W.running_success_count(V.search_log(spark, d), 0.2).select("replicate", "step", "n_above")


@query("running_distinct", f"{L}, f AS (SELECT replicate, step, (row_number() OVER (PARTITION BY replicate, state ORDER BY step) = 1)::INT AS first FROM search_log) SELECT replicate, step, CAST(sum(first) OVER (PARTITION BY replicate ORDER BY step {SO_FAR}) AS BIGINT) AS n_seen FROM f")
def running_distinct(spark, d):
    return W.running_distinct(V.search_log(spark, d)).select("replicate", "step", "n_seen")


@query("round_robin", f"{L} SELECT replicate, step, state, (row_number() OVER (PARTITION BY state ORDER BY replicate, step) - 1) // 20 AS batch FROM search_log")
def round_robin(spark, d):
    return W.round_robin(V.search_log(spark, d), 20, order=["replicate", "step"]).select("replicate", "step", "state", "batch")


@query("rank_states", f"{L}, g AS (SELECT replicate, state, sum(reward)::BIGINT AS total FROM search_log GROUP BY ALL) SELECT replicate, state, total, CAST(floor(rank() OVER (PARTITION BY replicate ORDER BY total DESC) + (count(*) OVER (PARTITION BY replicate, total) - 1) / 2) AS INT) AS rank_avg, row_number() OVER (PARTITION BY replicate ORDER BY total DESC, state) AS rank_ord FROM g")
def rank_states(spark, d):
    g = V.search_log(spark, d).groupBy("replicate", "state").agg(F.sum("reward").alias("total"))
    return W.rank_states(g, "total", ["replicate"], "state")


@query("level_breaks", f"{Q}, x AS (SELECT state, visits, len(list_filter(string_split(split_part(state, '::', 2), '_'), lambda i: i <> '')) AS level FROM q_table) SELECT state, visits, coalesce(level <> lag(level) OVER (PARTITION BY visits ORDER BY state), false) AS is_break FROM x")
def level_breaks(spark, d):
    q = V.q_table(spark, d).withColumn("level", G.complexity(F.col("state")))
    return W.level_breaks(q, "level", ["visits"], ["state"]).select("state", "visits", "is_break")


@query("flag_group_min", V.ctes("bincodes") + " SELECT p_partkey, outcome, p_retailprice = min(p_retailprice) OVER (PARTITION BY outcome) AS is_min FROM bincodes")
def flag_group_min(spark, d):
    return W.flag_group_min(V.bincodes(spark, d), "outcome", "p_retailprice").select("p_partkey", "outcome", "is_min")


@query("chunk_steps", f"{L}, c AS (SELECT replicate, step, CAST(ceil(step / 250) AS BIGINT) * 250 AS chunk_end FROM search_log) SELECT replicate, step, chunk_end - count(*) OVER (PARTITION BY replicate, chunk_end) + row_number() OVER (PARTITION BY replicate, chunk_end ORDER BY step) AS global_step FROM c")
def chunk_steps(spark, d):
    c = V.search_log(spark, d).withColumn("chunk_end", F.ceil(F.col("step") / 250) * 250)
    return W.chunk_steps(c, ["replicate"], "chunk_end", ["step"]).select("replicate", "step", "global_step")


@query("assign_param", f"{L}, v AS (SELECT replicate, step, state, (row_number() OVER (PARTITION BY replicate, state ORDER BY step) - 1) % 10 AS place FROM search_log), i AS (SELECT state, k AS param_index, row_number() OVER (PARTITION BY state ORDER BY md5(concat_ws('|', 's1', state, k)), k) - 1 AS place FROM (SELECT DISTINCT state FROM search_log) CROSS JOIN (SELECT unnest(range(10)) AS k) u) SELECT replicate, step, state, param_index::INT AS param_index FROM v JOIN i USING (state, place)")
def assign_param(spark, d):
    return W.assign_param(V.search_log(spark, d), 10, "s1").select("replicate", "step", "state", "param_index")


@query("running_found", f"{L}, f AS (SELECT state, max(reward) AS found, md5('o|' || state) AS h FROM search_log GROUP BY state) SELECT state, CAST(sum(found) OVER (ORDER BY h, state {SO_FAR}) AS BIGINT) AS n_found FROM f")
def running_found(spark, d):
    from pyspark.sql import Window

    found = V.search_log(spark, d).groupBy("state").agg(F.max("reward").alias("found"))
    placed = W.stable_shuffle(found, "state", "o").withColumn("range", F.floor(F.col("position") / 1000))
    parts = placed.groupBy("range").agg(F.sum("found").alias("part"))
    before = parts.withColumn("before", F.sum("part").over(Window.orderBy("range")) - F.col("part")).select("range", "before")  # a row for 1000 states
    inside = F.sum("found").over(Window.partitionBy("range").orderBy("position"))
    return placed.withColumn("inside", inside).join(before, "range").select("state", (F.col("before") + F.col("inside")).alias("n_found"))


@query("class_share", V.ctes("search_log", "stride") + f", c AS (SELECT ((step - 1) // every)::INT AS bin, split_part(state, '_', 2) AS class, count(*) AS n FROM search_log, stride GROUP BY ALL) SELECT bin, class, n, round(n / sum(n) OVER (PARTITION BY bin), 6) AS share FROM c")
def class_share(spark, d):
    log = V.search_log(spark, d)
    return W.class_share(log.crossJoin(F.broadcast(V.stride(log))), F.substring_index("state", "_", -1), F.col("every")).withColumn("share", r6("share"))


@query("top_n", f"{Q} SELECT state, visits, reward FROM q_table ORDER BY reward DESC, visits, state LIMIT 50")
def top_n(spark, d):
    return W.top_n(V.q_table(spark, d).select("state", "visits", "reward"), [F.desc("reward"), "visits", "state"], 50)


BEST = "row_number() OVER (PARTITION BY replicate, step ORDER BY reward DESC, q DESC, length(state), state)"


@query("best_row", f"{SN}, b AS (SELECT *, {BEST} AS k FROM snapshots) SELECT replicate, step, state, visits, reward, round(q, 6) AS q FROM b WHERE k = 1")
def best_row(spark, d):
    return W.best_row(V.snapshots(spark, d), ["replicate", "step"]).select("replicate", "step", "state", "visits", "reward", r6("q").alias("q"))


@query("snapshot_summary", f"{SN}, b AS (SELECT *, {BEST} AS k, sum(reward) OVER (PARTITION BY replicate, step) AS total FROM snapshots) SELECT replicate, step, total::BIGINT AS cum_reward, state AS best_state, visits, reward AS highest_reward, round(q, 6) AS best_q FROM b WHERE k = 1")
def snapshot_summary(spark, d):
    return W.snapshot_summary(V.snapshots(spark, d)).withColumn("best_q", r6("best_q"))


@query("best_per_group", f"{Q}, x AS (SELECT *, len(list_filter(string_split(split_part(state, '::', 2), '_'), lambda i: i <> '')) AS layer FROM q_table), k AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY reward DESC, q DESC, length(state), state) AS k FROM x) SELECT layer::INT AS layer, state, reward FROM k WHERE k = 1")
def best_per_group(spark, d):
    q = V.q_table(spark, d).withColumn("layer", G.complexity(F.col("state")))
    return W.best_row(q, ["layer"]).select("layer", "state", "reward")


@query("top_states", V.ctes("samples") + ", g AS (SELECT state, count_if(acf_min < -0.4) AS n_osc FROM samples GROUP BY state), t AS (SELECT * FROM g ORDER BY n_osc DESC, state LIMIT 20), r AS (SELECT s.*, n_osc, row_number() OVER (PARTITION BY state ORDER BY acf_min, l_orderkey, l_linenumber, l_extendedprice) AS k FROM samples s JOIN t USING (state)) SELECT state, n_osc, param_idx, round(acf_min, 6) AS acf_min FROM r WHERE k = 1")
def top_states(spark, d):
    s = V.samples(spark, d)
    top = s.groupBy("state").agg(F.count_if(F.col("acf_min") < -0.4).alias("n_osc")).orderBy(F.desc("n_osc"), "state").limit(20)
    best = F.min_by(F.struct("param_idx", "acf_min"), F.struct("acf_min", "l_orderkey", "l_linenumber", "l_extendedprice"))
    return s.join(top, "state").groupBy("state", "n_osc").agg(best.alias("b")).select("state", "n_osc", "b.param_idx", r6("b.acf_min").alias("acf_min"))


@query("top_share", f"{Q}, k AS (SELECT state, reward, row_number() OVER (ORDER BY reward DESC, state) AS k FROM q_table) SELECT state, reward FROM k WHERE k <= (SELECT floor(count(*) * 0.1) FROM q_table)")
def top_share(spark, d):
    return W.top_share(V.q_table(spark, d).select("state", "reward"), "reward", "state", 0.1)


@query("stable_shuffle", f"{Q} SELECT state, row_number() OVER (ORDER BY md5('shuffle|' || state), state) AS position FROM q_table")
def stable_shuffle(spark, d):
    return W.stable_shuffle(V.q_table(spark, d).select("state"), "state", "shuffle")


@query("pick_group", f"{L} SELECT replicate, step, state FROM search_log WHERE replicate = (SELECT replicate FROM search_log ORDER BY md5('pick|' || replicate), replicate LIMIT 1)")
def pick_group(spark, d):
    return W.pick_group(V.search_log(spark, d), "replicate", "pick").select("replicate", "step", "state")


@query("pick_snapshots", f"{SN} SELECT replicate, step, state, visits FROM snapshots WHERE replicate = 3 AND s IN (1, 5, 10)")
def pick_snapshots(spark, d):
    return V.snapshots(spark, d).where((F.col("replicate") == 3) & F.col("s").isin(1, 5, 10)).select("replicate", "step", "state", "visits")


@query("downsample", f"{L}, g AS (SELECT DISTINCT CAST(round(pow(10, k / 10.0)) AS BIGINT) AS step FROM (SELECT unnest(range(31)) AS k)) SELECT replicate, step, state FROM search_log WHERE step % 50 = 0 OR step IN (SELECT step FROM g)")
def downsample(spark, d):
    log = V.search_log(spark, d)
    grid = spark.range(31).select(F.round(F.pow(F.lit(10.0), F.col("id") / 10)).cast("bigint").alias("step")).distinct()
    logs = log.join(F.broadcast(grid), "step", "left_semi")  # 31 rows
    return logs.unionByName(log.where("step % 50 = 0").join(F.broadcast(grid), "step", "left_anti")).select("replicate", "step", "state")


@query("discovery_quality", f"{ST}, m AS (SELECT replicate, step, count_if(q >= 0.2 AND true_q >= 0.2) AS tp, count_if(q >= 0.2 AND true_q < 0.2) AS fp FROM snapshots JOIN truth USING (state) GROUP BY ALL), t AS (SELECT count_if(true_q >= 0.2) AS g, count_if(true_q < 0.2) AS b FROM truth) SELECT replicate, step, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN g > 0 THEN tp / g END, 6) AS recall, round(CASE WHEN b > 0 THEN fp / b END, 6) AS fpr FROM m, t")
def discovery_quality(spark, d):
    out = W.discovery_quality(V.snapshots(spark, d), V.truth(spark, d), 0.2, 0.2)
    return out.select("replicate", "step", *[r6(c).alias(c) for c in ("precision", "recall", "fpr")])


@query("discovery_rate", f"{SN} SELECT state, step, round(count(DISTINCT replicate) / 12, 6) AS rate FROM snapshots WHERE reward >= 1 GROUP BY ALL")
def discovery_rate(spark, d):
    return W.discovery_rate(V.snapshots(spark, d), F.col("reward") >= 1, 12).withColumn("rate", r6("rate"))


@query("success_replicates", f"{L}, n AS (SELECT replicate, split_part(state, '_', 2) AS node, avg(reward) AS q FROM search_log GROUP BY ALL) SELECT node, count(DISTINCT replicate) AS n_replicates FROM n WHERE q >= 0.05 GROUP BY node")
def success_replicates(spark, d):
    n = V.search_log(spark, d).groupBy("replicate", F.substring_index("state", "_", -1).alias("node")).agg(F.avg("reward").alias("q"))
    return n.where("q >= 0.05").groupBy("node").agg(F.countDistinct("replicate").alias("n_replicates"))


@query("explore_exploit", f"{ST}, w AS (SELECT state FROM truth WHERE true_q >= 0.1) SELECT replicate, step, count_if(visits >= 5) AS explored, count_if(reward >= 1 AND state IN (SELECT state FROM w)) AS winners_found, sum(reward)::BIGINT AS successes FROM snapshots GROUP BY ALL")
def explore_exploit(spark, d):
    return W.explore_exploit(V.snapshots(spark, d), V.truth(spark, d).where("true_q >= 0.1"), 5, 1)


@query("snapshot_table", ST + ", n AS (SELECT state, count(*) AS visits, sum(reward)::BIGINT AS reward FROM search_log GROUP BY state) SELECT state, visits, reward, round(reward / visits, 6) AS q, round(true_q, 6) AS true_q FROM n LEFT JOIN truth USING (state)")
def snapshot_table(spark, d):
    n = V.search_log(spark, d).groupBy("state").agg(F.count("*").alias("visits"), F.sum("reward").alias("reward"))
    return W.snapshot_table(n, V.truth(spark, d)).select("state", "visits", "reward", r6("q").alias("q"), r6("true_q").alias("true_q"))


@query("pattern_consensus", f"{L}, n AS (SELECT replicate, split_part(state, '_', 2) AS pattern, avg(reward) AS q FROM search_log GROUP BY ALL) SELECT pattern, count_if(q >= 0.05) AS n_true, round(avg(q), 6) AS mean_q, round(stddev_samp(q), 6) AS sd_q, round(count(DISTINCT replicate) / 12, 6) AS share FROM n GROUP BY pattern")
def pattern_consensus(spark, d):
    n = V.search_log(spark, d).groupBy("replicate", F.substring_index("state", "_", -1).alias("pattern")).agg(F.avg("reward").alias("q")).withColumn("is_motif", F.col("q") >= 0.05)
    return W.pattern_consensus(n, 12).select("pattern", "n_true", *[r6(c).alias(c) for c in ("mean_q", "sd_q", "share")])


@query("union_tagged", f"{L} SELECT CASE WHEN replicate % 2 = 0 THEN 'even' ELSE 'odd' END AS run, replicate, state, count(*) AS n FROM search_log GROUP BY ALL")
def union_tagged(spark, d):
    log = V.search_log(spark, d)
    runs = {"even": log.where("replicate % 2 = 0"), "odd": log.where("replicate % 2 = 1")}
    return W.union_tagged({run: one.groupBy("replicate", "state").agg(F.count("*").alias("n")) for run, one in runs.items()}, "run")


@query("state_overlap", f"{L}, a AS (SELECT DISTINCT state FROM search_log WHERE reward = 1), b AS (SELECT DISTINCT state FROM search_log WHERE step <= 300) SELECT 'both' AS kind, state FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first only', state FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def state_overlap(spark, d):
    log = V.search_log(spark, d)
    a, b = log.where("reward = 1").select("state"), log.where("step <= 300").select("state")
    return a.intersect(b).select(F.lit("both").alias("kind"), "state").unionByName(a.subtract(b).select(F.lit("first only").alias("kind"), "state"))


@query("distinct_rows", V.ctes("bincodes") + " SELECT DISTINCT outcome, reward FROM bincodes")
def distinct_rows(spark, d):
    return V.bincodes(spark, d).select("outcome", "reward").dropDuplicates()


@query("center_points", "SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) ORDER BY x * x + y * y, vec_id LIMIT 25")
def center_points(spark, d):
    p = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return W.top_n(p, [F.col("x") * F.col("x") + F.col("y") * F.col("y"), "vec_id"], 25).select("vec_id", r6("x").alias("x"), r6("y").alias("y"))
