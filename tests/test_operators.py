"""Known answers and properties of the library's operators on small tables."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from circuitlens.operators import design as D, graphs as N, motifs as M, outcomes as O, search as W, series as T, statistics as B

CELLS = "pattern string, pattern_in_succ bigint, others_in_succ bigint, pattern_in_null bigint, others_in_null bigint"


def test_odds_ratios(spark):
    rows = {r.pattern: r for r in M.odds_ratio(spark.createDataFrame([("p", 10, 20, 5, 40), ("z", 0, 20, 5, 40), ("i", 3, 0, 5, 40)], CELLS)).collect()}
    assert rows["p"].odds_ratio == 4.0 and rows["p"].ci_low < 4 < rows["p"].ci_high
    assert math.isnan(rows["z"].ci_low) and rows["z"].odds_ratio == 0 and math.isinf(rows["i"].odds_ratio)


def test_chi2_and_p_values(spark):
    row = M.with_p_values(M.chi2_yates(spark.createDataFrame([("p", 10, 20, 5, 40)], CELLS))).first()
    assert abs(row.chi2 - 75 * (abs(10 * 40 - 20 * 5) - 37.5) ** 2 / (30 * 45 * 15 * 60)) < 1e-12
    assert abs(row.pvalue - math.erfc(math.sqrt(row.chi2 / 2))) < 1e-12 and row.p_corrected == row.pvalue


def test_verdict_of_unseen_patterns(spark):
    df = spark.createDataFrame([("none", 0, 5, 0, 9), ("new", 3, 5, 0, 9)], CELLS).withColumn("p_corrected", F.lit(1.0))
    rows = {r.pattern: r for r in M.verdict(M.odds_ratio(df)).collect()}
    assert not rows["none"].overrepresented and not rows["none"].motif and rows["new"].motif


def test_best_row_ties(spark):
    df = spark.createDataFrame([(1, s, 3, 0.5) for s in ("*ABC::ABa_BAi", "*ABC::ABa", "*ABC::AAa")], "replicate int, state string, reward int, q double")
    assert W.best_row(df, ["replicate"]).first().state == "*ABC::AAa"


def test_running_success_count_equals_a_set_simulation(spark):
    rg, rows = random.Random(2), []
    for replicate in (0, 1):
        rows += [(replicate, k, f"s{rg.randrange(6)}", int(rg.random() < 0.4)) for k in range(1, 120)]
    log = spark.createDataFrame(rows, "replicate int, step int, state string, reward int")
    found = {(r.replicate, r.step): r.n_above for r in W.running_success_count(log, 0.35).collect()}
    seen = defaultdict(lambda: defaultdict(list))
    for replicate, step, state, reward in rows:
        seen[replicate][state].append(reward)
        assert found[replicate, step] == sum(np.mean(x) > 0.35 for x in seen[replicate].values())


def test_class_shares_sum_to_one(spark):
    log = spark.createDataFrame([(k, "abc"[k % 3]) for k in range(1, 100)], "step int, state string")
    sums = W.class_share(log, F.col("state"), F.lit(20)).groupBy("bin").agg(F.sum("share").alias("s")).collect()
    assert len(sums) == 5 and all(abs(r.s - 1) < 1e-12 for r in sums)


def test_shuffle_and_params_are_permutations(spark):
    df = spark.range(500).withColumn("key", F.col("id").cast("string"))
    assert sorted(r.position for r in W.stable_shuffle(df, "key", "x").collect()) == list(range(1, 501))
    log = spark.createDataFrame([(0, k, "s") for k in range(1, 9)], "replicate int, step int, state string")
    order = [r.param_index for r in W.assign_param(log, 4, "x").orderBy("step").collect()]
    assert sorted(order[:4]) == [0, 1, 2, 3] and order[:4] == order[4:]


@pytest.mark.parametrize("x,y,p", [((1, 3), (2, 4), 0.75), ((5, 5), (5, 5), 0.0)])
def test_prob_less_than(spark, x, y, p):
    df = spark.createDataFrame([("x", v) for v in x] + [("y", v) for v in y], "g string, v int")
    assert M.prob_less_than(df, "g", "v", "x", "y").first().p_less == p


def test_mann_whitney_against_pairs(spark):
    rg = random.Random(4)
    rows = [(g, rg.randrange(6)) for g in "abc" for _ in range(20)]
    found = {(r.g1, r.g2): r.u1 for r in M.mann_whitney(spark.createDataFrame(rows, "g string, v int"), "g", "v").collect()}
    for (g, h), u in found.items():
        assert u == sum((a > b) + (a == b) / 2 for k, a in rows if k == g for m, b in rows if m == h)


def series(spark, **values):
    return spark.createDataFrame([(k, t, float(v)) for k, vs in values.items() for t, v in enumerate(vs)], "series_id string, t int, value double")


def test_impulse_is_smoothed_to_the_kernel(spark):
    y = [0.0] * 8 + [256.0] + [0.0] * 8
    rows = [r.smoothed for r in T.binomial_smooth(series(spark, a=y)).orderBy("t").collect()]
    assert rows == [1, 8, 28, 56, 70, 56, 28, 8, 1]
    assert T.gathered(series(spark, a=y)).select(T.smooth(F.col("y")).alias("y")).first().y == rows
    assert T.gathered(series(spark, a=y[:5])).select(T.smooth(F.col("y")).alias("y")).first().y == []


def test_flat_failed_and_oscillating_series(spark):
    wave = [math.sin(2 * math.pi * t / 20) for t in range(200)]
    df = series(spark, flat=[3.0] * 60, wave=wave, bad=[1.0] * 30 + [math.nan] + [1.0] * 30)
    rows = {r.series_id: r for r in T.oscillation_summary(df, 20.0).collect()}
    assert (rows["flat"].lag, rows["flat"].acf_min, rows["flat"].frequency) == (-1, 0.0, 0.0)
    assert rows["wave"].lag == 10 and rows["wave"].acf_min < -0.8 and abs(rows["wave"].frequency - 1 / 400) < 1e-12
    assert math.isnan(rows["bad"].acf_min) and math.isnan(rows["bad"].frequency)
    acf = T.acf_rows(df.where("series_id = 'wave'"), None).orderBy("t").collect()
    assert acf[0].value == 1.0 and len(acf) == 100


def test_spectrum_has_all_mass(spark):
    df = series(spark, flat=[3.0] * 40, noise=[random.Random(1).random() * (t % 3) for t in range(40)])
    sums = {r.series_id: r.s for r in T.power_spectrum(df, 100).groupBy("series_id").agg(F.sum("power").alias("s")).collect()}
    assert all(abs(s - 1) < 1e-9 for s in sums.values())
    assert T.power_spectrum(df, 3).where("series_id = 'flat' and k = 0").first().power == 1.0


def test_q_tilde_and_paths(spark):
    nodes = spark.createDataFrame([("r", 0, 0), ("u", 10, 2), ("v", 10, 6)], "node string, visits int, reward int")
    edges = spark.createDataFrame([("r", "u", 0.5), ("r", "v", 0.2)], "src string, dst string, w double")
    depths = N.bfs_layers(edges, "r")
    assert {r.node: r.q_tilde for r in N.q_tilde(nodes, edges, depths).collect()} == {"r": 0.4, "u": 0.2, "v": 0.6}
    assert {r.node: r.path for r in N.shortest_paths(edges, "r", depths, "w").collect()}["v"] == "r>v"


def test_merged_visits(spark):
    nodes = spark.createDataFrame([("n", 3, 1), ("n", 4, 0)], "node string, visits int, reward int")
    edges = spark.createDataFrame([("n", "m", 1, 1)], "src string, dst string, visits int, reward int")
    assert N.merge_graphs(nodes, edges)[0].first().visits == 7


def test_canonical_outcomes(spark):
    df = spark.createDataFrame([("1000",), ("0101",), ("1100",)], "o string")
    assert {r.o: r.c for r in df.withColumn("c", D.canonical_outcome("o", 2)).collect()} == {"1000": "0001", "0101": "0101", "1100": "0011"}


def test_periodic_lattice_is_symmetric(spark):
    rows = {(r.i, r.j) for r in N.hex_adjacency(spark, 4, 5, True).collect()}
    assert len(rows) == 120 and all((j, i) in rows for i, j in rows)
    assert len({(r.i, r.j) for r in N.hex_adjacency(spark, 3, 3, False).collect()}) < 54
    with pytest.raises(ValueError):
        N.hex_adjacency(spark, 3, 4, True)


def test_entropy_and_modularity(spark):
    df = spark.createDataFrame([("00001111",), ("01010101",), ("11111111",)], "outcome string")
    rows = {r.outcome: r.modularity for r in N.tree_modularity(df, 3).collect()}
    assert rows["00001111"] == 0.75 and rows["01010101"] == 0.25 and rows["11111111"] == 0.0  # layers from the root to the leaves


def test_nearest_breaks_ties_and_crosses_ranges(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate([0.0, 10.0, 10.0, 999.0, None])], "id int, v double")
    grid = spark.createDataFrame([(5.0,), (400.0,), (2000.0,), (-50.0,)], "g double")
    found = {r.g: r.id for r in O.nearest(grid, rows, "g", "v", "id", 7.0).collect()}
    assert found == {5.0: 0, 400.0: 1, 2000.0: 3, -50.0: 0}


def test_tolerance_join_against_all_pairs(spark):
    rg = random.Random(5)
    left = [(k, "ab"[k % 2], rg.uniform(-3, 3)) for k in range(60)]
    right = [(100 + k, s, v + rg.choice([0, 1e-7, 5e-5, 0.01])) for k, (_, s, v) in enumerate(left)] * 1
    found = {r.k: (r.n_matches, r.match) for r in O.tolerance_join(spark.createDataFrame(left, "k int, s string, v double"), spark.createDataFrame(right, "id int, s string, v double"), "s", "v", "id", width=0.5).collect()}
    for k, s, v in left:
        hits = [i for i, t, w in right if t == s and abs(w - v) <= 1e-8 + 1e-5 * abs(v)]
        assert found.get(k) == ((len(hits), hits[0] if len(hits) == 1 else None) if hits else None)


def test_merge_modes(spark):
    base = spark.createDataFrame([("a", 1, 0.1), ("b", 1, 0.2)], "state string, param_idx int, acf_min double")
    new = spark.createDataFrame([("a", 1, 0.9), ("c", 1, 0.3)], "state string, param_idx int, acf_min double")
    got = {m: {r.state: r.acf_min for r in O.merge_samples(base, new, m).collect()} for m in ("full", "partial", "update")}
    assert got == {"full": {"a": 0.9, "c": 0.3}, "partial": {"a": 0.1, "b": 0.2, "c": 0.3}, "update": {"a": 0.9, "b": 0.2, "c": 0.3}}
    with pytest.raises(ValueError):
        O.merge_samples(base, new, "other")


def test_beta_posterior_against_numerical_integration(spark):
    nodes = spark.createDataFrame([(10, 3), (0, 0), (400, 100)], "visits bigint, reward bigint")
    for r in B.beta_posterior(nodes, 0.3).collect():
        x = (np.arange(200_000) + 0.5) / 200_000
        density = np.exp(r.reward * np.log(x) + (r.visits - r.reward) * np.log(1 - x) - max(0, 0))
        assert abs(r.cdf - density[x < 0.3].sum() / density.sum()) < 1e-4


def test_mutation_design_is_even_and_repeats(spark):
    ids = spark.range(300)
    rows = D.param_design(ids, "id", 300, "ABC", 0.3, "x").collect()
    again = D.param_design(ids.repartition(7), "id", 300, "ABC", 0.3, "x").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    strata = sorted(int((r.log10_kd_1 + 2) / 6 * 300) for r in rows)
    assert strata == list(range(300)) and 40 < 300 - Counter(r.component_mutation for r in rows)["(none)"] < 140


def test_perturbation_stays_in_range(spark):
    df = spark.range(200).withColumn("kp", F.lit(0.24))
    rows = D.perturb(df, {"kp": D.RANGES["kp"]}, 0.5, "x", "id").collect()
    assert all(0.015 <= r.kp <= 0.25 for r in rows) and len({r.kp for r in rows}) > 150
    assert {r.kp for r in D.perturb(df, {"kp": D.RANGES["kp"]}, 0.0, "x", "id").collect()} == {0.24}


def test_conductance_distance_and_modularity_by_hand(spark):
    from circuitlens.operators import graphs as N

    states = ["*ABC::ABa_BCa_CAi", "*ABC::ABa", "*ABC::ABa_BCi", "*ABC::AAa_BBi", "*ABC::", "*ABC::AAa_ABa"]
    df = spark.createDataFrame([(s,) for s in states], "state string")
    assert [r.cheeger for r in sorted(N.cheeger(df, "ABC").collect(), key=lambda r: states.index(r.state))] == [1.0, 1.0, 1.0, None, None, 1.0]
    four = ["*ABCD::ABa_BCa_CDa", "*ABCD::ABa_CDa", "*ABCD::ABa_BCa_CAa_CDi"]  # a chain, two pieces, a triangle with a tail
    values = {r.state: r.cheeger for r in N.cheeger(spark.createDataFrame([(s,) for s in four], "state string"), "ABCD").collect()}
    assert [round(values[s], 6) for s in four] == [round(1 / 3, 6), 0.0, 0.5]  # the tail with its corner: two edges cross, volumes are 4 and 4
    distance = {(r.a, r.b): r.distance for r in N.circuit_distances(df, df, "ABC").collect()}
    assert distance["*ABC::AAa_ABa", "*ABC::ABa"] == 0 and distance["*ABC::", "*ABC::ABa"] == 1 and distance["*ABC::ABa", "*ABC::ABa_BCa_CAi"] == 2
    codes = spark.createDataFrame([("0011",), ("0000",), ("0101",)], "outcome string")
    assert {r.outcome: round(r.modularity, 6) for r in N.tree_modularity(codes, 2).collect()} == {"0011": round(2 / 3, 6), "0000": 0.0, "0101": round(1 / 3, 6)}


def test_pattern_itself_is_left_out(spark):
    from circuitlens.operators import motifs as M
    from pyspark.sql import functions as F

    q = spark.createDataFrame([("*ABC::ABa", 1.0), ("*ABC::ABa_BCi", 1.0), ("*ABC::BCi", 0.0), ("*ABC::AAa", 1.0)], "state string, q double")
    patterns = spark.createDataFrame([("*ABC::ABa",)], "pattern string")
    for limit in (100, 0):  # bit masks and inverted index
        pairs = M.pattern_containment(q, patterns, broadcast_rows=limit)
        assert sorted(r.state for r in pairs.collect()) == ["*ABC::ABa", "*ABC::ABa_BCi"]
        row = M.contingency(q, pairs, F.col("q") >= 0.5).first()
        assert tuple(row) == ("*ABC::ABa", 1, 1, 1, 2)
        assert tuple(M.contingency(q, pairs, F.col("q") >= 0.5, exclude_self=False).first()) == ("*ABC::ABa", 2, 1, 2, 2)


def test_rates_have_a_fixed_sum(spark):
    from circuitlens.operators import design as D

    df = spark.createDataFrame([(0.0, 0.1, 0.5, 1.0), (2.0, 0.25, 0.2, 0.0)], "log10_kd_1 double, kd_2_1_ratio double, km_unbound double, nlog10_km_rep_unbound_ratio double")
    first, second = D.to_params(df).collect()
    assert (first.k_on, first.k_off_1, first.k_off_2) == (50.0, 50.0, 5.0) and abs(second.k_off_1 - 100 * 100 / 101) < 1e-9 and abs(second.k_on - 100 / 101) < 1e-9


def test_snapshots_reach_the_end_of_the_log(spark, tmp_path):
    from circuitlens.plans import views as V
    from pyspark.sql import functions as F

    rows = spark.range(5_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60).alias("ts"), (F.col("id") % 2).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    last = V.snapshots(spark, str(tmp_path)).where("s = 10")
    assert last.agg(F.sum("visits")).first()[0] == 5_000
    assert [r.step for r in V.search_log(spark, str(tmp_path)).where("replicate = 0").orderBy("event_id").collect()] == list(range(1, 2_501))
