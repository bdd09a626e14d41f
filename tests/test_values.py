"""Values of queries that SQL doesn't check, of scans and of streams, against plain versions."""

import math
import re
from collections import Counter
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from circuitlens.operators import design as D, graphs as N, motifs as M, outcomes as O, resampling as B, search as W, series as T
from circuitlens.operators.statistics import posterior_compare
from circuitlens.plans import catalog, views as V
from circuitlens.sources import tables
from circuitlens.streaming import online

FOLDER = "/root/testdata/sf0.001"


def test_verdicts_of_patterns(spark):
    rows = catalog.queries()["motif_verdict"](spark, FOLDER).collect()
    cells = {r.pattern: r for r in catalog.queries()["contingency"](spark, FOLDER).collect()}
    assert len(rows) == len(cells)
    for r in rows:
        c = cells[r.pattern]
        a, b, x, d = c.pattern_in_succ, c.others_in_succ, c.pattern_in_null, c.others_in_null
        n, margins = a + b + x + d, (a + b) * (x + d) * (a + x) * (b + d)
        chi2 = n * max(0, abs(a * d - b * x) - n / 2) ** 2 / margins if margins else 0.0
        p = math.erfc(math.sqrt(chi2 / 2)) * len(cells)
        stars = next((s for s, limit in (("****", 1e-4), ("***", 1e-3), ("**", 0.01), ("*", 0.05)) if p < limit), "ns")
        ratio = a * d / (b * x) if b * x else math.inf
        over, significant = (False if a == 0 == x else ratio > 1), (a > 0 if x == 0 else p < 0.05)
        assert (r.stars, r.overrepresented, r.significant, r.sufficient, r.motif) == (stars, over, significant, True, over and significant)


def test_principal_components_up_to_sign(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x -= x.mean(axis=0)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    found = sorted(catalog.queries()["phase_portrait"](spark, FOLDER).collect(), key=lambda r: r.vec_id)
    for k in range(2):
        want, have = x @ axes[k], np.array([r[f"pc{k + 1}"] for r in found])
        assert np.abs(have - want * np.sign(have @ want)).max() < 1e-6


def test_clusters_hold_every_circuit_and_split_by_signs(spark):
    rows = catalog.queries()["cluster_circuits"](spark, FOLDER).collect()
    total = V.q_table(spark, FOLDER).agg(F.sum("visits")).first()[0]
    assert sum(r.visits for r in rows) == total and len({r.state for r in rows}) == len(rows)
    assert 1 < len({r.prediction for r in rows}) <= 6
    cells = [a + b for a in "ABC" for b in "ABC"]
    vectors = np.array([[(i + "a" in r.state) - (i + "i" in r.state) for i in cells] for r in rows], float)
    labels = np.array([r.prediction for r in rows])
    within = sum(((vectors[labels == k] - vectors[labels == k].mean(axis=0)) ** 2).sum() for k in set(labels))
    assert within < 0.8 * ((vectors - vectors.mean(axis=0)) ** 2).sum()  # nearer to their own centre than to that of all


def test_perturbed_quantities_follow_the_truncated_normal(spark):
    rows = spark.createDataFrame([(k, 0.2, 100.0) for k in range(400)], "id int, a double, b double")
    found = D.perturb(rows, {"a": (0.0, 1.0)}, 0.3, "s", "id").collect()
    d = NormalDist()
    low, high = d.cdf(-0.2 / 0.3), d.cdf(0.8 / 0.3)
    import hashlib

    for r in found:
        u = int(hashlib.md5(f"s.a|{r.id}".encode()).hexdigest()[:8], 16) / 2**32
        assert math.isclose(r.a, 0.2 + 0.3 * d.inv_cdf(low + u * (high - low)), abs_tol=1e-9) and r.b == 100.0


def test_perturbed_parameters_are_restored_within_their_ranges(spark):
    sampled = {"log10_kd_1": 0.5, "kd_2_1_ratio": 0.1, "km_unbound": 0.4, "km_act": 3.0, "nlog10_km_rep_unbound_ratio": 1.5, "kp": 0.1, "gamma_m": 0.02, "gamma_p": 0.05}
    names = ["id", *sampled]
    params = D.to_params(spark.createDataFrame([(k, *sampled.values()) for k in range(60)], names)).select("id", "k_on", "k_off_1", "k_off_2", "km_unbound", "km_act", "km_rep", "km_act_rep", "kp", "gamma_m", "gamma_p")
    same = D.perturb_params(params, 0.0, "s", "id", 2)
    assert same.count() == 120 and same.drop("replicate").distinct().exceptAll(params).count() == 0
    moved = D.perturb_params(params, 0.2, "s", "id", 3)
    assert moved.columns == [*params.columns, "replicate"] and moved.count() == 180
    back = D.to_sampled(moved).collect()
    for name, (low, high) in D.RANGES.items():
        values = [r[name] for r in back]
        assert all(low - 1e-9 <= v <= high + 1e-9 for v in values) and len(set(values)) > 170
        assert abs(np.mean(values) - sampled[name]) < 0.25 * (high - low)
    assert all(math.isclose(r.k_on + r.k_off_1, 100.0) and r.km_act_rep == r.km_unbound for r in moved.collect())


def test_posteriors_are_compared_by_their_densities(spark):
    groups = [("AA", 3, 10, 30, 200), ("AB", 50, 60, 10, 60), ("BB", 0, 0, 5, 9)]
    df = spark.createDataFrame(groups, "pattern string, reward_with bigint, visits_with bigint, reward_without bigint, visits_without bigint")
    found = {r.pattern: r.p_less for r in posterior_compare(df, 4000, 3).collect()}
    grid = (np.arange(20_000) + 0.5) / 20_000

    def density(r, n):
        f = np.exp(r * np.log(grid) + (n - r) * np.log(1 - grid) - (r * math.log(max(r, 1) / max(n, 1)) + (n - r) * math.log(max(n - r, 1) / max(n, 1))))
        return f / f.sum()

    for name, r1, n1, r0, n0 in groups:
        exact = float((np.cumsum(density(r0, n0)) * density(r1, n1)).sum())
        assert abs(found[name] - exact) < 0.02


# --- scans


def test_only_the_newest_file_is_read(spark, tmp_path):
    for k in (3, 20, 100):
        spark.range(k).write.parquet(f"{tmp_path}/snap_{k:04d}")
    spark.range(7).write.parquet(f"{tmp_path}/other")
    df = tables.read_latest(spark, f"{tmp_path}/*", r"snap_(\d+)")
    assert df.count() == 100 and {r.snapshot for r in df.select("snapshot").distinct().collect()} == {"0100"}
    assert all("snap_0100" in f for f in df.inputFiles()) and df.inputFiles()
    with pytest.raises(FileNotFoundError):
        tables.read_latest(spark, f"{tmp_path}/*", r"none_(\d+)")


def test_runs_in_chunks(spark):
    lengths = {"a": 25, "b": 10, "c": 1, "d": 31}
    log = spark.createDataFrame([(r, t, (t * 7) % 3) for r, n in lengths.items() for t in range(1, n + 1)], "run string, step bigint, reward int").repartition(5)
    runs = tables.chunk_runs(log, "run", size=10)
    assert runs.agg(F.max(F.size("rewards"))).first()[0] == 10 and runs.count() == 3 + 1 + 1 + 4
    config = spark.createDataFrame([(r, k) for k, r in enumerate(lengths)], "run string, seed int")
    found = Counter(map(tuple, tables.explode_runs(runs, config, "run").select("run", "t", "reward").collect()))
    assert found == Counter((r, t, (t * 7) % 3) for r, n in lengths.items() for t in range(1, n + 1))
    assert tables.explode_runs(spark.createDataFrame([("a", [5, 6])], "run string, rewards array<int>"), config, "run").orderBy("t").select("t", "reward").collect() == [(1, 5), (2, 6)]


# --- snapshots by the clock


def test_snapshots_once_a_period_and_none_twice_after_a_restart(spark, tmp_path):
    times = iter([100.0, 103.0, 111.0, 112.0, 135.0, 136.0, 150.0])
    schema = "state string, reward int"

    def more(names):
        for name in names:
            spark.createDataFrame([(name, 1), ("s", 0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = online.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema), files=1)
        online.timed_snapshots(online.running_q(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint", 10.0, lambda: next(times), drain=True).awaitTermination()
        return sorted(n for n in online._folders(spark, f"{tmp_path}/out") if n.startswith("snapshot"))

    more("abcd")
    assert run() == ["snapshot=000001"]  # at 111, not at 103 nor 112
    first = spark.read.parquet(f"{tmp_path}/out/snapshot=000001")
    assert first.agg(F.sum("visits")).first()[0] == 6  # what the first three files hold
    assert run() == ["snapshot=000001"]  # nothing new
    more("efg")
    assert run() == ["snapshot=000001", "snapshot=000003", "snapshot=000005"]  # at 135 and 150: the start is still 100
    assert spark.read.parquet(f"{tmp_path}/out/snapshot=000001").agg(F.sum("visits")).first()[0] == 6
    online.final_snapshot(spark, f"{tmp_path}/out")
    last = tables.read_latest(spark, f"{tmp_path}/out/*", r"snapshot=(\d+)")
    assert last.agg(F.sum("visits"), F.sum("reward")).first() == (14, 7)


# --- further columns


def test_attributes_of_merged_graphs(spark):
    rows = [(1, "n", 3, 2.5, "first"), (2, "n", 4, 1.5, "second"), (2, "m", 5, None, "only")]
    df = spark.createDataFrame(rows, "graph int, node string, visits int, loss double, label string")
    found = {r.node: (r.visits, r.loss, r.label) for r in N.merge_attributes(df, ["node"], "graph").collect()}
    assert found == {"n": (7, 4.0, "first"), "m": (5, 0.0, "only")}
    some = {r.node: (r.visits, r.loss) for r in N.merge_attributes(df, ["node"], "graph", ["visits"]).collect()}
    assert some == {"n": (7, 2.5), "m": (5, None)}


def test_batches_that_hold_stopped_runs_only_do_not_count(spark):
    runs = [("g", k, float(k + 1), 1.0 if k else 9.0) for k in range(3)] + [("h", 0, 2.0, 9.0), ("h", 1, None, 0.0)]
    df = spark.createDataFrame(runs, "g string, id int, t double, r double")
    found = {(r.g, r.threshold): r for r in B.batch_metrics(df, "g", "t", "r", 2, 500, [5.0, 10.0], "s", ["id"]).collect()}
    assert set(found) == {("g", 5.0), ("g", 10.0), ("h", 10.0)}
    all_runs, kept = found["g", 10.0], found["g", 5.0]
    assert all_runs.batches == 500 and 400 < kept.batches < 480  # a ninth of the pairs is the stopped run twice
    assert abs(all_runs.runtime_mean - 22 / 9) < 0.1 and kept.runtime_low == 2.0 and all_runs.runtime_low == 1.0
    assert math.isclose(kept.sampling_high, 2 * 60 / 2.0) and found["h", 10.0].runtime_sd == 0.0


def test_grids_flags_and_first_replicates(spark):
    log = spark.createDataFrame([(s,) for s in range(1, 101)], "step bigint")
    assert sorted(r.step for r in W.linear_grid(log, "step", 4).collect()) == [1, 34, 67, 100]
    assert W.linear_grid(log.limit(0), "step", 4).count() == 0 and W.linear_grid(log, "step", 1).count() == 1
    assert [r.step for r in O.top_flag(log, "step", 0.03).where("is_top").orderBy("step").collect()] == [98, 99, 100]
    rows = spark.createDataFrame([("p", 2, 0.5, True), ("p", 1, 0.1, False), ("q", 3, 0.2, True)], "pattern string, replicate int, q double, is_motif boolean")
    assert {r.pattern: (r.first_replicate, r.first_q, r.n_true) for r in W.pattern_summary(rows, 3).collect()} == {"p": (1, 0.1, 1), "q": (3, 0.2, 1)}


def test_candidates_are_shallow_nodes_whose_circuit_succeeded(spark):
    nodes = spark.createDataFrame([("*A::", 5, 5), ("*A::AAa", 4, 3), ("*A::AAi", 0, 0), ("*A::AAa_AAi", 9, 9)], "node string, visits bigint, reward bigint")
    edges = spark.createDataFrame([("*A::", "*A::AAa"), ("*A::", "*A::AAi"), ("*A::AAa", "*A::AAa_AAi")], "src string, dst string")
    assert [tuple(r) for r in N.pattern_candidates(nodes, edges, "*A::", 1, 0.5).collect()] == [("AAa", 1)]
    assert {tuple(r) for r in N.pattern_candidates(nodes, edges, "*A::", 2, 0.8).collect()} == {("AAa_AAi", 2)}


def test_one_replicate_that_holds_all_rows_is_ordered_in_buckets(spark):
    log = spark.createDataFrame([(1, k, f"s{k % 9}", k % 2) for k in range(1, 400)], "replicate int, step bigint, state string, reward int")
    truth = log.groupBy("state").agg(F.avg("reward").alias("true_q"))
    for df in (W.regret(log), W.running_success_count(log, 0.4), W.running_distinct(log), W.running_top_overlap(log, 0.4, truth, 3), O.ecdf(log, ["replicate"], "step"), M.prob_less_than(log, "state", "step", "s1", "s2")):
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        windows = [k for k, line in enumerate(lines) if re.search(r"\bWindow \[", line)]
        assert windows
        for k in windows:  # over rows by bucket or by state; else over the totals of buckets
            keys = re.findall(r"\], \[(.*?)\], \[", lines[k])
            split = keys and ("__bucket" in keys[-1] or "state" in keys[-1])
            assert split or any("Aggregate [" in line for line in lines[k + 1 : k + 4]), lines[k]


def test_grown_circuits(spark):
    df = spark.createDataFrame([("*AB::ABa",), ("*AB::ABa",), ("*AB::AAa_ABa_BAi_BBi",)], "state string")
    found = {r.grown for r in N.grow_circuits(df, "AB", interchangeable=False).collect()}
    assert found == {"*AB::AAa_ABa", "*AB::AAi_ABa", "*AB::ABa_BAa", "*AB::ABa_BAi", "*AB::ABa_BBa", "*AB::ABa_BBi"}
    assert N.grow_circuits(df, "AB").count() == 6  # AB and BA with a sign each are one orbit's circuits, but no two of these are


def test_hexagons_hold_the_points_nearest_to_their_centres(spark):
    rg = np.random.default_rng(8)
    xy = rg.uniform(-3, 3, (500, 2))
    df = spark.createDataFrame([(float(x), float(y)) for x, y in xy] + [(None, 1.0)], "x double, y double")
    cells = {(r.i, r.j): r.n for r in N.hex_cells(df, 0.5).collect()}
    centres = {(i, j): (0.5 * math.sqrt(3) * (i + j / 2), 0.75 * j) for i in range(-15, 16) for j in range(-15, 16)}
    names, places = list(centres), np.array(list(centres.values()))
    want = Counter(names[k] for k in ((xy[:, None] - places[None]) ** 2).sum(axis=2).argmin(axis=1))
    assert cells == dict(want)
    rows = N.hex_neighbours(N.hex_cells(df, 0.5)).collect()
    assert all(math.isclose(np.hypot(*np.subtract(centres[r.i, r.j], centres[r.k, r.l])), 0.5 * math.sqrt(3)) for r in rows)
    sums = Counter()
    for r in rows:
        sums[r.i, r.j] += r.w
    assert all(math.isclose(v, 1.0) for v in sums.values())


def test_circuits_are_added_up_as_numbers_and_read_once_for_clusters(spark, monkeypatch):
    wanted = spark.sql("SELECT explode(array(0, 1, 513, 256, 131328, 131841)) AS code").select("code", V.decoded(F.col("code")).alias("state")).collect()
    assert {r.code: r.state for r in wanted} == {0: "*ABC::", 1: "*ABC::AAi", 513: "*ABC::AAa", 256: "*ABC::CCi", 131328: "*ABC::CCa", 131841: "*ABC::AAa_CCa"}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan(V.q_table(spark, FOLDER)) and "lineitem" in "".join(V.q_table(spark, FOLDER).inputFiles())
    assert catalog.queries()["cluster_circuits"](spark, FOLDER).inputFiles() == []  # from the checkpoint


def test_compacted_states_are_in_as_many_partitions_as_their_rows_ask_for(spark, monkeypatch):
    samples = spark.createDataFrame([(f"p{k % 300}", k % 5, float(k % 3)) for k in range(3000)], "state string, param_idx int, sim_time double")
    numbers = samples.select("param_idx", "sim_time", (F.col("param_idx") * 10 + F.col("sim_time")).cast("int").alias("sample_num")).distinct()
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    out = tables.compact_by_state(samples, numbers, ["param_idx", "sim_time"]).withColumn("at", F.spark_partition_id())
    assert out.rdd.getNumPartitions() == 30
    rows = out.collect()  # partition by partition
    assert len(rows) == 3000 and all(r.sample_num == r.param_idx * 10 + r.sim_time for r in rows)
    assert all((a.state, a.sample_num) <= (b.state, b.sample_num) for a, b in zip(rows, rows[1:]) if a.at == b.at)
    assert max(Counter(state for state, _ in {(r.state, r.at) for r in rows}).values()) == 1
