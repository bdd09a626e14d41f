"""Known answers on genotypes and motifs, and invariants under relabelling."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from circuitlens.functions import genotype as G
from circuitlens.operators import graphs as N, motifs as M


def state():
    return F.col("state")


def states(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "state string")


def one(spark, text, column):
    return states(spark, text).select(column.alias("x")).first().x


def test_known_motifs(spark):
    flags = G.flags(state())
    found = {s: one(spark, s, G.motif_label(flags)) for s in ("*ABC::AAa_ABa_BAi_CBi", "*ABC::ABi_BCi_CAi", "*ABC::", "*ABC::BCa_CBi")}
    assert found == {"*ABC::AAa_ABa_BAi_CBi": "AI", "*ABC::ABi_BCi_CAi": "III", "*ABC::": "(none)", "*ABC::BCa_CBi": "AI"}


@pytest.mark.parametrize("text,n", [("*ABC::", 0), ("*ABC::ABa", 1), ("*ABC::ABa_BAi", 2)])
def test_complexity(spark, text, n):
    assert one(spark, text, G.complexity(state())) == n


def test_null_states_stay_null(spark):
    row = states(spark, None).select(G.canonical(state()).alias("c"), G.edge_code(state()).alias("e")).first()
    assert row.c is None and row.e is None


def test_delete_component(spark):
    assert one(spark, "*ABC::AAa_ABa_BAi_CBi", G.delete_component(state(), "C")) == "*AB::AAa_ABa_BAi"


def test_relabellings_of_a_ring():
    assert len(G.relabellings("ABa_BCa_CAi")) == 6 and len(G.relabellings("ABi_BCi_CAi")) == 2


circuits = st.lists(st.tuples(st.sampled_from([a + b for a in "ABC" for b in "ABC"]), st.sampled_from("ai")), max_size=6, unique_by=lambda x: x[0])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(circuits, st.permutations("ABC"))
def test_relabelling_changes_neither_form_nor_motifs(spark, ixns, order):
    name = lambda xs: "*ABC::" + "_".join(sorted(xs))
    plain = name(a + b for a, b in ixns)
    moved = name(a.translate(str.maketrans("ABC", "".join(order))) + b for a, b in ixns)
    rows = states(spark, plain, moved).select(G.canonical(state()).alias("c"), *[f.alias(n) for n, f in G.flags(state()).items()]).collect()
    assert rows[0] == rows[1]
    assert one(spark, rows[0].c, G.canonical(state())) == rows[0].c


def test_containment_join_equals_subset_test(spark):
    ixns = ["ABa", "BAi", "BCi", "CAi", "ABi", "CCa"]
    all_states = ["*ABC::" + "_".join(sorted(c)) for k in range(5) for c in itertools.combinations(ixns, k) if len({x[:2] for x in c}) == k]
    df = states(spark, *all_states)
    patterns = spark.createDataFrame([(f"*ABC::{m}",) for m in G.MOTIFS.values()] + [("*ABC::",)], "pattern string")
    pairs = {(r.state, r.pattern) for r in M.pattern_containment(df, patterns).collect()}
    for motif in G.MOTIFS.values():
        want = {r.state for r in df.where(G.has_motif(state(), motif)).collect()}
        assert {s for s, p in pairs if p == f"*ABC::{motif}"} == want
    assert {s for s, p in pairs if p == "*ABC::"} == set(all_states)


def test_number_of_circuits(spark):
    assert N.enumerate_circuits(spark, "AB", 4, interchangeable=False).count() == 81
    assert N.enumerate_circuits(spark, "ABC", 9).count() == 3411


def test_negative_feedback(spark):
    rows = {r.state: r.n_loops for r in N.feedback_loops(states(spark, "*ABC::ABi_BAa", "*ABC::ABi_BAi", "*ABC::AAi"), "ABC").collect()}
    assert rows == {"*ABC::ABi_BAa": 1, "*ABC::ABi_BAi": 0, "*ABC::AAi": 0}


def test_components_and_conductance(spark):
    df = states(spark, "*ABCD::ABa_CDi", "*ABCD::", "*ABCD::ABa_BCi_CDa", "*ABCD::ADa")
    assert {r.state: r.n_components for r in N.circuit_components(df, "ABCD").collect()} == {"*ABCD::ABa_CDi": 2, "*ABCD::": 1, "*ABCD::ABa_BCi_CDa": 1, "*ABCD::ADa": 1}
    assert {r.state: r.cheeger for r in N.cheeger(df, "ABCD").collect()}["*ABCD::ABa_BCi_CDa"] == 1 / 3  # cut 1, volumes 3 and 3


def test_distances_are_those_of_the_best_relabelling(spark):
    df = states(spark, "*ABC::ABa", "*ABC::BCa", "*ABC::ABi", "*ABC::")
    found = {(r.a, r.b): r.distance for r in N.circuit_distances(df, df, "ABC").collect()}
    assert len(found) == 6 and found["*ABC::ABa", "*ABC::BCa"] == 0 and found["*ABC::ABa", "*ABC::ABi"] == 2 and found["*ABC::", "*ABC::ABa"] == 1
