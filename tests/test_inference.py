"""Tests, posteriors, resampled searches and prefix sums against plain versions."""

import hashlib
import math
from collections import Counter
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from circuitlens.functions import tails
from circuitlens.functions.digests import heads, padded
from circuitlens.operators import design as D, distributions as P, graphs as N, motifs as M, outcomes as O, resampling as B, scan, search as W


def plain_u(x, y):
    return sum((a > b) + (a == b) / 2 for a in x for b in y)


def plain_p(x, y):
    """Two-sided p as the usual library has it: exact for small samples without ties, else by the normal distribution."""
    u, n1, n2 = max(plain_u(x, y), plain_u(y, x)), len(x), len(y)
    both = x + y
    if min(n1, n2) <= 8 and len(set(both)) == len(both):
        ranks = sorted(both)
        sums = [sum(c) for c in combinations(range(1, n1 + n2 + 1), n1)]
        us = [s - n1 * (n1 + 1) / 2 for s in sums]
        assert u in (sum(ranks.index(a) + 1 for a in x) - n1 * (n1 + 1) / 2, sum(ranks.index(a) + 1 for a in y) - n2 * (n2 + 1) / 2)
        return min(1.0, 2 * sum(v >= u for v in us) / len(us))
    n, ties = n1 + n2, sum(c**3 - c for c in Counter(both).values())
    spread = math.sqrt(max(0.0, n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))))
    return min(1.0, math.erfc((u - n1 * n2 / 2 - 0.5) / spread / math.sqrt(2))) if spread else 1.0


def test_erfc_and_its_tails(spark):
    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.9, 1.999999, 2.0, 2.1, 3.0, 5.0, 10.0, 26.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, e, s, t, c in df.select("x", tails.erfc(F.col("x")), tails.normal_sf(F.col("x")), tails.normal_sf(-F.col("x")), tails.chi2_sf(F.col("x"))).collect():
        assert math.isclose(e, math.erfc(x), rel_tol=1e-11, abs_tol=1e-300)
        assert math.isclose(s, math.erfc(x / math.sqrt(2)) / 2, rel_tol=1e-11) and math.isclose(s + t, 1.0, rel_tol=1e-12)
        assert math.isclose(c, math.erfc(math.sqrt(x / 2)), rel_tol=1e-11)


def test_rank_test_with_ties_small_samples_and_equal_groups(spark):
    rg = np.random.default_rng(1)
    groups = {
        "a": [int(v) for v in rg.integers(0, 9, 40)], "b": [int(v) for v in rg.integers(2, 12, 60)], "c": [100, 103, 109, 107], "d": [101, 102, 115, 120, 130, 141, 99],
        "e": [5] * 12, "f": [5] * 3, "g": [1],
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), (None, 1.0)]
    found = P.rank_test(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()
    assert len(found) == 21 and all(r.g1 < r.g2 for r in found)
    for r in found:
        x, y = groups[r.g1], groups[r.g2]
        assert (r.n1, r.n2, r.u1, r.u2) == (len(x), len(y), plain_u(x, y), plain_u(y, x))
        assert math.isclose(r.p, plain_p(x, y), rel_tol=1e-9), (r.g1, r.g2)
        assert math.isclose(r.p_corrected, 21 * r.p)
    equal = next(r for r in found if (r.g1, r.g2) == ("e", "f"))
    assert equal.p == 1.0 and equal.z is None
    assert P.rank_test(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0


def plain_sum(chances):
    pmf = [1.0]
    for p in chances:
        pmf = [a * (1 - p) + b * p for a, b in zip([*pmf, 0.0], [0.0, *pmf])]
    return pmf


def test_sum_of_unequal_trials(spark):
    rg = np.random.default_rng(2)
    trials = [("x", float(p), int(n)) for p, n in zip(rg.random(150), rg.integers(0, 4, 150))] + [("x", 0.3, 50), ("x", 0.0, 4), ("x", 1.0, 6), ("y", 1.0, 2), ("z", None, 3), ("z", 0.5, None), ("w", 0.25, 1)]
    found = {r.g: r for r in P.sum_distribution(spark.createDataFrame(trials, "g string, p double, n int"), ["g"], chunk=4).collect()}  # two rounds of merging
    assert set(found) == {"x", "y", "w"}
    want = plain_sum([p for g, p, n in trials if g == "x" for _ in range(n)])
    held = np.zeros(len(want))
    held[found["x"].offset : found["x"].offset + len(found["x"].pmf)] = found["x"].pmf
    assert np.abs(held - want).max() < 1e-12 and abs(held.sum() - 1) < 1e-12
    assert (found["y"].offset, found["y"].pmf) == (2, [1.0]) and np.allclose(found["w"].pmf, [0.75, 0.25])


def test_many_equal_trials_stay_short():
    offset, pmf = P._binomial(10**8, 0.3)
    k = np.arange(offset, offset + len(pmf))
    assert len(pmf) < 200_000 and abs((k * pmf).sum() - 3e7) < 1e-3 and abs(((k - 3e7) ** 2 * pmf).sum() / 2.1e7 - 1) < 1e-9
    direct, transformed = P._convolved((0, pmf[:3000]), (0, pmf[:3000])), np.fft.irfft(np.fft.rfft(pmf[:3000], 8192) ** 2, 8192)[:5999]
    assert np.abs(direct[1] - transformed[direct[0] : direct[0] + len(direct[1])]).max() < 1e-12


def test_reachability_test_against_convolutions(spark):
    rg = np.random.default_rng(3)
    terminals = [(f"t{k}", int(n), int(rg.integers(0, n + 1)) if n else 0) for k, n in enumerate(rg.integers(0, 12, 60))]
    pairs = [(f"p{k}", t) for k in range(5) for t, _, _ in terminals if rg.random() < 0.15 * (k + 1)] + [("all", t) for t, _, _ in terminals]
    pairs += pairs[:5]
    found = P.reachability_test(spark.createDataFrame(terminals, "state string, visits bigint, reward bigint"), spark.createDataFrame(pairs, "pattern string, state string"), 0.4)

    def chance(n, r):
        q, least = (r / n if n else 0.0), math.floor(n * 0.4) + 1
        return sum(math.comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(least, n + 1))

    p = {t: chance(n, r) for t, n, r in terminals}
    rows = found.collect()
    assert len(rows) == 6
    for r in rows:
        inside = {t for pattern, t in pairs if pattern == r.pattern}
        x, y = ([p[t] for t in p if (t in inside) == side] for side in (True, False))
        fx, fy = plain_sum(x), plain_sum(y)
        assert (r.n_reachable, r.n_other) == (len(x), len(y))
        assert math.isclose(r.mean_diff, sum(x) - sum(y), abs_tol=1e-9) and math.isclose(r.sd_diff, math.sqrt(sum(v * (1 - v) for v in x + y)), rel_tol=1e-9)
        assert abs(r.p_value - sum(a * b for (i, a), (j, b) in product(enumerate(fx), enumerate(fy)) if i <= j)) < 1e-9


DIAMOND = [("r", "u"), ("r", "v"), ("u", "x"), ("v", "x"), ("v", "y"), ("u", "x")]


def test_reachable_sets_and_mixtures_on_a_diamond(spark):
    edges = spark.createDataFrame(DIAMOND, "src string, dst string")
    leaves = spark.createDataFrame([("x", 4, 3), ("y", 2, 0), ("lone", 1, 1)], "node string, visits bigint, reward bigint")
    pairs = N.reachability(edges, leaves)
    assert sorted(map(tuple, pairs.collect())) == [("lone", "lone"), ("r", "x"), ("r", "y"), ("u", "x"), ("v", "x"), ("v", "y"), ("x", "x"), ("y", "y")]
    found = {r.node: r for r in P.reachable_mixture(leaves, pairs, 0.3).collect()}
    moments = {"x": (4 / 6, 4 * 2 / (36 * 7)), "y": (1 / 4, 3 / (16 * 5))}
    cdf = {"x": sum(math.comb(5, k) * 0.3**k * 0.7 ** (5 - k) for k in range(4, 6)), "y": 1 - 0.7**3}
    mean = (moments["x"][0] + moments["y"][0]) / 2
    variance = sum(v + m * m for m, v in moments.values()) / 2 - mean**2
    for node in "rv":
        r = found[node]
        assert r.n == 2 and math.isclose(r.mean, mean) and math.isclose(r.variance, variance) and math.isclose(r.cdf, sum(cdf.values()) / 2) and math.isclose(r.sf, 1 - r.cdf)
    assert found["u"].n == 1 and math.isclose(found["u"].mean, 4 / 6) and set(found) == {"r", "u", "v", "x", "y", "lone"}


@pytest.mark.parametrize("visits, done", [
    ({"r": 0, "u": 5, "v": 0, "x": 6, "y": 5}, {"r", "u", "v", "x", "y"}),
    ({"r": 0, "u": 5, "v": 0, "x": 6, "y": 4}, {"u", "x"}),
    ({"r": 9, "u": 1, "v": 0, "x": 5, "y": 5}, {"v", "x", "y"}),
    ({"r": 0, "u": 0, "v": 0, "x": 0, "y": 9}, {"y"}),
])
def test_exhausted_nodes_by_recursion(spark, visits, done):
    edges = spark.createDataFrame(DIAMOND, "src string, dst string")
    nodes = spark.createDataFrame(list(visits.items()), "node string, visits bigint")
    depths = spark.createDataFrame([("r", 0), ("u", 1), ("v", 1), ("x", 2), ("y", 2)], "node string, depth int")
    flags = N.exhausted(nodes, edges, depths, 5)
    assert {r.node for r in flags.where("exhausted").collect()} == done and flags.count() == 5
    rates = spark.createDataFrame([(n, 0.5 if n == "y" else 0.1) for n in visits], "node string, q_tilde double")
    found = {(r.src, r.dst) for r in N.exhausted_edges(edges, flags, rates, 0.4).collect()}
    assert found == {(a, b) for a, b in DIAMOND if a in done and (b in done or b == "y")}


def test_sequential_search_is_nested_and_equals_a_plain_loop(spark):
    rates = {"s0": 0.0, "s1": 1.0, "s2": 0.37, "s3": 0.9, "s4": None, "s5": 0.5, "s6": 0.05}
    df = spark.createDataFrame(list(rates.items()), "state string, q double")
    steps, every = 7 * 700 + 3, 2500
    rows = B.sequential_search(df, steps, every, "x").collect()
    order = sorted(rates, key=lambda s: (hashlib.md5(f"x|{s}".encode()).hexdigest(), s))
    assert sorted({r.step for r in rows}) == [2500, 4903] and len(rows) == 14
    visits = Counter()
    held = {}
    for step in range(steps):  # the loop itself
        visits[order[step % 7]] += 1
        if step + 1 in (2500, 4903):
            held[step + 1] = dict(visits)
    last = {}
    for r in sorted(rows, key=lambda r: r.step):
        assert r.visits == held[r.step][r.state] and order[r.position - 1] == r.state
        assert r.reward <= r.visits and r.reward >= last.get(r.state, 0) and r.q == r.reward / r.visits
        last[r.state] = r.reward
    final = {r.state: r for r in rows if r.step == 4903}
    assert final["s0"].reward == 0 == final["s4"].reward and final["s1"].reward == final["s1"].visits
    for s, q in rates.items():
        if q and q < 1:
            assert abs(final[s].reward - 700 * q) < 5 * math.sqrt(700 * q * (1 - q))
    assert B.sequential_search(df, 3, 10, "x").where("visits = 0").count() == 4 and B.sequential_search(df, 0, 10, "x").count() == 0


def test_binomial_draw_follows_the_distribution_function(spark):
    n, p = 9, 0.35
    upto = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
    us = [0.0, 0.01, 0.2, 0.5, 0.8, 0.99, 0.9999999] + [float(c) + d for c in upto[:-1] for d in (-1e-6, 1e-6)]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    found = df.select("u", B.binomial_draw(F.lit(n), F.lit(p), F.col("u")).alias("k")).collect()
    assert [r.k for r in found] == [int((upto <= u).sum()) for u in us]


def test_bootstrap_of_means(spark):
    rg = np.random.default_rng(4)
    values = [float(v) for v in rg.integers(0, 40, 3000)]
    rows = [("a", v) for v in values] + [("b", 7.0)] * 50 + [(None, 1.0), (None, 3.0), ("c", None), ("c", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r.g: r for r in B.bootstrap_mean(df.repartition(7), ["g"], "v", 0.95, 400, "s").collect()}
    again = {r.g: r for r in B.bootstrap_mean(df.coalesce(1), ["g"], "v", 0.95, 400, "s").collect()}
    assert set(found) == {"a", "b", None}
    a, se = found["a"], np.std(values) / math.sqrt(len(values))
    assert a.n == 3000 and math.isclose(a.mean, np.mean(values)) and abs(a.se / se - 1) < 0.15
    assert abs(a.ci_low - (a.mean - 1.96 * se)) < 0.5 * se and abs(a.ci_high - (a.mean + 1.96 * se)) < 0.5 * se
    assert (found["b"].ci_low, found["b"].ci_high, found["b"].se) == (7.0, 7.0, 0.0)
    assert all(math.isclose(found[g][c], again[g][c], rel_tol=1e-12, abs_tol=1e-12) for g in found for c in ("ci_low", "ci_high", "se"))
    counts = Counter(values)
    totals = np.zeros((2, 400))
    for v, c in counts.items():  # the same weights in a plain loop
        w = np.random.Generator(np.random.Philox(key=int(hashlib.md5(f"s|{{\"k0\":\"a\"}}|{v!r}".encode()).hexdigest(), 16))).poisson(c, 400)
        totals += np.array([w * v, w])
    assert math.isclose(a.se, np.std(totals[0] / totals[1], ddof=1), rel_tol=1e-9)


def test_corner_histograms_equal_those_of_each_pair(spark):
    rg = np.random.default_rng(5)
    rows = [(float(a), int(b), 3.0, "xy"[k % 2]) for k, (a, b) in enumerate(zip(rg.normal(size=400), rg.integers(1, 30, 400)))] + [(None, 4, 3.0, "x"), (float("nan"), 5, 3.0, None), (0.1, None, None, "y")]
    df = spark.createDataFrame(rows, "a double, b int, c double, g string")
    found = O.corner_histograms(df, ["a", "b", "c"], 6)
    pair = {(r.bx, r.by): r.n for r in found.where("x = 'a' and y = 'b'").collect()}
    assert pair == {(r.bx, r.by): r.n for r in O.histogram2d(df.where("a is not null and not isnan(a) and b is not null"), "a", "b", 6).collect()}
    assert {(r.bx, r.n) for r in found.where("x = 'c' and y = 'c'").collect()} == {(0, 402)}
    assert found.where("x = 'a' and y = 'a'").agg(F.sum("n")).first()[0] == 401 and all(r.bx == r.by for r in found.where("x = y").collect())
    classes = O.corner_histograms(df, ["a", "b"], 6, "g", log=["b"])
    assert {r[0] for r in classes.select("class").distinct().collect()} == {"x", "y", None}
    whole, split = (t.where("x = 'a' and y = 'a'").groupBy("bx").agg(F.sum("n").alias("n")).orderBy("bx").collect() for t in (found, classes))
    assert whole == split
    assert O.corner_histograms(df.limit(0), ["a", "b"], 6).count() == 0


def test_discovery_bands_with_ties_at_the_cut(spark):
    truth = [(f"g{k:02d}", 0.9 if k < 1 else 0.5) for k in range(20)] + [("bad", 0.1)]  # the best two of 20: g00, and g01 of the equal ones
    snapshots = [(1, 10, "g00", 0.9), (1, 10, "bad", 0.8), (2, 10, "g01", 0.3), (2, 10, "g02", 0.9), (3, 10, "g00", 0.7), (3, 10, "g01", 0.7), (3, 10, "g05", 0.6), (3, 10, "bad", 0.0)]
    args = spark.createDataFrame(snapshots, "replicate int, step int, state string, q double"), spark.createDataFrame(truth, "state string, true_q double")
    found = {r.metric: r for r in W.discovery_bands(*args, 0.5, 0.5).collect()}
    values = {"precision": [0.5, 1.0, 1.0], "recall": [1 / 20, 1 / 20, 3 / 20], "top_precision": [0.5, 0.0, 2 / 3], "top_recall": [0.5, 0.0, 1.0]}
    for metric, v in values.items():
        r = found[metric]
        assert r.n == 3 and math.isclose(r.mean, np.mean(v))
        assert np.allclose([r.q05, r.q50, r.q95], np.percentile(v, [5, 50, 95]))
    none = {r.metric: r for r in W.discovery_bands(*args, 0.95, 0.5).collect()}
    assert none["precision"].n == 0 and none["precision"].mean is None and none["recall"].mean == 0.0


def test_prefix_sums_split_one_group_that_holds_all_rows(spark):
    rg = np.random.default_rng(6)
    rows = [(7 if k % 50 else None, k, int(v)) for k, v in enumerate(rg.integers(-5, 6, 3000), 1)]
    df = spark.createDataFrame(rows, "g int, step bigint, v int")
    summed = scan.running_sums(df, ["g"], ["step"], {"total": F.col("v")}, scan.step_bucket("step", 100))
    plan = summed._jdf.queryExecution().optimizedPlan().toString()
    assert all("__bucket" in line or "__total" in line for line in plan.splitlines() if "Window [" in line)  # rows are ordered within buckets only
    want, totals = {}, Counter()
    for g, step, v in rows:
        totals[g] += v
        want[step] = totals[g]
    assert {r.step: r.total for r in summed.collect()} == want
    ranged = scan.running_sums(df.where("g = 7"), [], [F.desc("v"), "step"], {"place": F.lit(1)}, scan.value_bucket(df, "v", 4), descending=True)
    assert [r.step for r in ranged.orderBy("place").collect()] == [s for g, s, v in sorted(rows, key=lambda r: (-r[2], r[1])) if g == 7]


@pytest.mark.parametrize("n", [1, 3, 5, 6, 7, 8, 20])
def test_top_rows_with_ties_and_nulls(spark, n):
    rows = [("a", 5.0), ("b", 9.0), ("c", 5.0), ("d", 5.0), ("e", None), ("f", 1.0), ("g", 9.0), ("h", None)]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[:n]
    assert {tuple(r) for r in scan.top_rows(spark.createDataFrame(rows, "k string, v double"), "v", "k", n).collect()} == set(want)


def test_p_values_of_patterns_no_longer_leave_the_engine(spark):
    df = M.with_p_values(spark.createDataFrame([(0.0,), (3.84,), (80.0,)], "chi2 double"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert np.allclose([r.pvalue for r in df.orderBy("chi2").collect()], [1.0, math.erfc(math.sqrt(1.92)), math.erfc(math.sqrt(40.0))])


def test_heads_are_those_of_md5():
    for head in (b"", b"s|7|", b"x" * 51, b"y" * 130):  # up to three blocks, and lengths at which the padding takes another
        texts = [np.frombuffer(head + str(k).encode(), np.uint8) for k in range(100, 160)]
        assert heads(padded(np.array(texts))).tolist() == [int(hashlib.md5(t.tobytes()).hexdigest()[:8], 16) for t in texts]


def test_bootstrap_interval_makes_no_row_of_a_draw(spark, monkeypatch):
    rows = [("g" * 50, float(v % 7)) for v in range(1200)] + [("h", 0.1 * v) for v in range(30)] + [("one", 4.0), ("h", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    monkeypatch.setattr(D, "SPAN", 500)
    found = {r.g: (r.ci_low, r.ci_high) for r in D.bootstrap_ci(df, "g", "v", 0.9, 20, "s").collect()}
    plan = D.bootstrap_ci(df, "g", "v", 0.9, 20, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan
    monkeypatch.setattr(D, "LISTED", 10)  # the group of 30 values goes the other way
    again = {r.g: (r.ci_low, r.ci_high) for r in D.bootstrap_ci(df, "g", "v", 0.9, 20, "s").collect()}
    assert set(found) == set(again) == {"g" * 50, "h", "one"} and found["one"] == (4.0, 4.0)
    for g in found:
        values = sorted(v for k, v in rows if k == g and v is not None)
        means = []
        for b in range(1, 21):
            us = [int(hashlib.md5(f"s|{g}|{b}|{k}".encode()).hexdigest()[:8], 16) / 2**32 for k in range(1, len(values) + 1)]
            means.append(np.mean([values[int(u * len(values))] for u in us]))
        want = np.percentile(means, [5, 95])
        assert np.allclose(found[g], want, rtol=0, atol=1e-9) and np.allclose(again[g], want, rtol=0, atol=1e-9)


def test_bootstrap_of_means_holds_one_group_at_a_time(spark, monkeypatch):
    most = []
    rows = (pa.RecordBatch.from_pylist([{"key": f"k{g:04}", "value": float(v), "copies": 1} for v in range(3)]) for g in range(5000))
    for batch in B._weighted(100, "s")(rows):
        most.append(batch.num_rows)
        assert all(len(x) == 100 for x in batch.column("totals").to_pylist())
    assert sum(most) == 5000 and max(most) <= B.HELD  # a row a group, put out as groups end
    df = spark.createDataFrame([("a", float(v % 90)) for v in range(2000)] + [("b", 1.0), ("b", 2.0)], "g string, v double")
    whole = {r.g: r for r in B.bootstrap_mean(df, ["g"], "v", 0.9, 50, "s").collect()}
    monkeypatch.setattr(B, "PIECE", 7)
    pieces = {r.g: r for r in B.bootstrap_mean(df, ["g"], "v", 0.9, 50, "s").collect()}
    assert set(whole) == set(pieces) == {"a", "b"}
    assert all(math.isclose(whole[g][c], pieces[g][c], rel_tol=1e-12) for g in whole for c in ("n", "mean", "ci_low", "ci_high", "se"))
