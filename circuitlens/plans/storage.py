"""Queries on sources, sinks and streams: tables are written in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from circuitlens.plans import views as V
from circuitlens.sources import tables as T
from circuitlens.sources.shared import scratch
from circuitlens.streaming import online as N

QUERIES, ORACLES = {}, {}
r6 = lambda c: F.round(c, 6)
S, L, SN = V.ctes("samples"), V.ctes("search_log"), V.ctes("search_log", "snapshots")


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


@query("scan_csv", V.ctes("circuits", "q_table") + " SELECT state, visits, round(q, 6) AS q FROM q_table")
def scan_csv(spark, d):
    path = scratch(spark)
    V.q_table(spark, d).select("state", "visits", r6("q").alias("q")).write.csv(path, header=True)
    return T.read_results(spark, path, "state string, visits bigint, q double")


@query("scan_latest", f"{SN} SELECT replicate, state, visits FROM snapshots WHERE s = 10")
def scan_latest(spark, d):
    path = scratch(spark)
    V.snapshots(spark, d).select("replicate", "state", "visits", F.format_string("%015d", "step").alias("name")).write.partitionBy("name").parquet(path)
    return T.read_latest(spark, f"{path}/*", r"name=(\d+)").select("replicate", "state", "visits")


@query("scan_glob", f"{L} SELECT replicate, step, row_number() OVER (PARTITION BY replicate ORDER BY step) - 1 AS batch_idx FROM search_log")
def scan_glob(spark, d):
    path = scratch(spark)
    log = V.search_log(spark, d).select("replicate", "step")
    log.withColumn("rep", F.col("replicate")).repartition("rep").write.partitionBy("rep").parquet(path)
    return T.read_glob(spark, f"{path}/*", ["step"]).select("replicate", "step", F.col("batch_idx").cast("bigint").alias("batch_idx"))


@query("scan_replicates", f"{SN} SELECT replicate::INT AS replicate, step::INT AS step, state, visits FROM snapshots")
def scan_replicates(spark, d):
    path = scratch(spark)
    V.snapshots(spark, d).select("state", "visits", F.col("replicate").alias("rep"), F.concat(F.lit("mcts_"), "step", F.lit("_oscillators")).alias("name")).write.partitionBy("rep", "name").csv(path, header=True)
    found = T.read_replicates(spark, f"{path}/*/*", r"rep=(\d+)/name=mcts_(\d+)_oscillators", ["replicate", "step"], "state string, visits bigint")
    return found.select("replicate", "step", "state", "visits")


@query("file_tags", f"{L}, p AS (SELECT DISTINCT 'runs/log_batch_' || (step % 4 + 1) || '_' || replicate || '.csv' AS path FROM search_log) SELECT path, regexp_extract(path, 'batch_([0-9]+)_', 1)::INT AS batch_size, row_number() OVER (PARTITION BY regexp_extract(path, 'batch_([0-9]+)_', 1)::INT ORDER BY path) - 1 AS replicate FROM p")
def file_tags(spark, d):
    log = V.search_log(spark, d)
    paths = log.select(F.concat(F.lit("runs/log_batch_"), (F.col("step") % 4 + 1).cast("string"), F.lit("_"), F.col("replicate").cast("string"), F.lit(".csv")).alias("path")).distinct()
    return T.file_tags(paths, "path", r"batch_([0-9]+)_", "batch_size").withColumn("replicate", F.col("replicate").cast("bigint"))


@query("scan_log", f"{L} SELECT state, count(*) AS n, sum(reward)::DOUBLE AS reward FROM search_log GROUP BY state")
def scan_log(spark, d):
    path = scratch(spark)
    V.search_log(spark, d).select("state", "reward").write.csv(path)
    return T.read_search_log(spark, path).groupBy("state").agg(F.count("*").alias("n"), F.sum("reward").alias("reward"))


@query("explode_runs", f"{L} SELECT 'run' || replicate AS run, replicate AS seed, row_number() OVER (PARTITION BY replicate ORDER BY step)::INT AS t, reward FROM search_log")
def explode_runs(spark, d):
    path = scratch(spark)
    log = V.search_log(spark, d).withColumn("run", F.concat(F.lit("run"), F.col("replicate").cast("string")))
    log.select("run", F.col("replicate").alias("seed")).distinct().write.json(f"{path}/config")
    T.chunk_runs(log, "run").write.json(f"{path}/runs")
    runs = spark.read.schema("run string, start bigint, rewards array<int>").json(f"{path}/runs")
    config = spark.read.schema("run string, seed bigint").json(f"{path}/config")
    return T.explode_runs(runs, config, "run")


@query("kv_flatten", f"{S}, g AS (SELECT state, param_idx, round(min(acf_min), 6) AS acf_min, max(sim_time) AS sim_time FROM samples GROUP BY ALL) SELECT * FROM g")
def kv_flatten(spark, d):
    rows = V.samples(spark, d).groupBy("state", "param_idx").agg(r6(F.min("acf_min")).alias("acf_min"), F.max("sim_time").alias("sim_time"))
    pair = F.struct(F.col("param_idx").cast("string"), F.to_json(F.array("acf_min", "sim_time")))
    cache = rows.groupBy(F.concat(F.lit("state_"), "state").alias("key")).agg(F.map_from_entries(F.collect_list(pair)).alias("fields"))
    return T.kv_to_samples(cache)


@query("params_json", "SELECT s_suppkey::VARCHAR AS key, s_suppkey AS seed, s_nationkey AS a_0, s_acctbal AS k_on FROM supplier")
def params_json(spark, d):
    kv = T.params_to_kv(V.table(spark, d, "supplier"), "s_suppkey", "s_suppkey", ["s_nationkey"], ["s_acctbal"], 1, 1)
    value = F.from_json("value", "seed bigint, prots0 array<int>, params array<double>")
    return kv.withColumn("v", value).select("key", "v.seed", F.col("v.prots0")[0].alias("a_0"), F.col("v.params")[0].alias("k_on"))


@query("sink_partitioned", f"{L} SELECT replicate::INT AS replicate, state, count(*) AS n FROM search_log GROUP BY ALL")
def sink_partitioned(spark, d):
    path = scratch(spark)
    T.write_samples(V.search_log(spark, d).groupBy("replicate", "state").agg(F.count("*").alias("n")), path, "replicate")
    return spark.read.parquet(path)


@query("split_write", f"{S} SELECT 'long' AS route, count(*) AS n FROM samples WHERE sim_time > 30 UNION ALL SELECT 'oscillating', count(*) FROM samples WHERE acf_min < -0.4")
def split_write(spark, d):
    path = scratch(spark)
    T.split_write(V.samples(spark, d), {"oscillating": F.col("acf_min") < -0.4, "long": F.col("sim_time") > 30}, path)
    return spark.read.parquet(path).groupBy("route").agg(F.count("*").alias("n"))


@query("compact_by_state", f"{S}, n AS (SELECT DISTINCT param_idx, sim_time, param_idx * 100 + sim_time::BIGINT AS sample_num FROM samples) SELECT state, sample_num, count(*) AS n FROM samples JOIN n USING (param_idx, sim_time) GROUP BY ALL")
def compact_by_state(spark, d):
    s = V.samples(spark, d)
    numbers = s.select("param_idx", "sim_time", (F.col("param_idx") * 100 + F.col("sim_time").cast("bigint")).alias("sample_num")).distinct()
    return T.compact_by_state(s.select("state", "param_idx", "sim_time"), numbers, ["param_idx", "sim_time"]).groupBy("state", "sample_num").agg(F.count("*").alias("n"))


def _log_stream(spark, d, batches=4, rows_per_file=200_000):
    """The search log as a table of files, as many as its rows ask for, and as a stream that reads them in a few batches."""
    path = scratch(spark)
    log = V.search_log(spark, d).select("replicate", "step", "state", "reward")
    files = max(batches, -(-V.table(spark, d, "events").count() // rows_per_file))
    log.repartition(files, "replicate", F.floor(F.col("step") / 1000)).write.parquet(f"{path}/in")
    return path, N.read_stream(spark, f"{path}/in", spark.read.parquet(f"{path}/in"), files=-(-files // batches))


@query("stream_append", f"{L} SELECT replicate, step, state, reward FROM search_log")
def stream_append(spark, d):
    path, stream = _log_stream(spark, d)
    N.append(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("stream_dedupe", f"{S} SELECT DISTINCT state, param_idx FROM samples WHERE acf_min <= 0 AND sim_time >= 0")
def stream_dedupe(spark, d):
    path = scratch(spark)
    V.samples(spark, d).select("state", "param_idx", "acf_min", "sim_time").write.parquet(f"{path}/in")
    stream = N.dedupe(N.read_stream(spark, f"{path}/in", spark.read.parquet(f"{path}/in")), ["state", "param_idx"])
    N.append(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("state", "param_idx")


@query("stream_running_q", f"{L} SELECT state, count(*) AS visits, sum(reward)::BIGINT AS reward, round(avg(reward), 6) AS q FROM search_log GROUP BY state")
def stream_running_q(spark, d):
    path, stream = _log_stream(spark, d)
    N.snapshot(N.running_q(stream), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return T.read_latest(spark, f"{path}/out/*", r"snapshot=(\d+)").select("state", "visits", "reward", r6("q").alias("q"))


@query("stream_snapshot", f"{L} SELECT count(DISTINCT state) AS states, count(*) AS visits, sum(reward)::BIGINT AS reward FROM search_log")
def stream_snapshot(spark, d):
    path, stream = _log_stream(spark, d)
    N.snapshot(N.running_q(stream), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    last = T.read_latest(spark, f"{path}/out/*", r"snapshot=(\d+)")
    return last.agg(F.count("*").alias("states"), F.sum("visits").alias("visits"), F.sum("reward").alias("reward"))


@query("stream_timed_snapshot", f"{L} SELECT count(DISTINCT state) AS states, count(*) AS visits, sum(reward)::BIGINT AS reward FROM search_log")
def stream_timed_snapshot(spark, d):
    path, stream = _log_stream(spark, d)
    N.timed_snapshots(N.running_q(stream), f"{path}/out", f"{path}/checkpoint", period=7200.0, drain=True).awaitTermination()
    N.final_snapshot(spark, f"{path}/out")
    last = T.read_latest(spark, f"{path}/out/*", r"snapshot=(\d+)")
    return last.agg(F.count("*").alias("states"), F.sum("visits").alias("visits"), F.sum("reward").alias("reward"))
