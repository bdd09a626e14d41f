"""Queries on genotypes and motifs."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from circuitlens.functions import genotype as G
from circuitlens.operators import motifs as M
from circuitlens.plans import views as V
from circuitlens.sources.shared import cut

QUERIES, ORACLES = {}, {}
r6 = lambda c: F.round(c, 6)
C, Q = V.ctes("circuits"), V.ctes("circuits", "q_table")
IXNS = "list_filter(string_split(split_part(state, '::', 2), '_'), lambda x: x <> '')"


def success():
    return F.col("q") >= 0.5




def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def _has(motif: str, own: str = "x") -> str:
    return "(" + " OR ".join(f"list_has_all({own}, ['" + "','".join(r) + "'])" for r in G.relabellings(motif)) + ")"


FLAGS = {n: _has(m) for n, m in G.MOTIFS.items()}
LABEL = "coalesce(nullif(concat_ws('+', " + ", ".join(f"CASE WHEN {f} THEN '{n}' END" for n, f in FLAGS.items()) + "), ''), '(none)')"
X = f"x AS (SELECT *, {IXNS} AS x FROM q_table)"


@query("complexity", f"{C} SELECT circuit_id, len({IXNS})::INT AS complexity FROM circuits")
def complexity(spark, d):
    return V.circuits(spark, d).select("circuit_id", G.complexity(F.col("state")).alias("complexity"))


@query("parse_genotype", f"{C} SELECT circuit_id, 'ABC' AS components, array_to_string(list_filter({IXNS}, lambda i: i LIKE '%a'), '_') AS activations, array_to_string(list_filter({IXNS}, lambda i: i LIKE '%i'), '_') AS inhibitions, true AS terminal, substr(state, 2) AS open_state FROM circuits")
def parse_genotype(spark, d):
    s = F.col("state")
    signed = lambda z: F.array_join(F.filter(G.interactions(s), lambda x: F.endswith(x, F.lit(z))), "_")
    return V.circuits(spark, d).select("circuit_id", F.array_join(G.components(s), "").alias("components"), signed("a").alias("activations"), signed("i").alias("inhibitions"), G.is_terminal(s).alias("terminal"), F.regexp_replace(s, r"^\*", "").alias("open_state"))


RINGS = ("ABa_BAi", "BCi", "CAa", "AAa")


@query("literal_motifs", f"{C} SELECT circuit_id, split_part(state, '::', 2) AS edge_code, (" + " + ".join(f"contains(state, '{m}')::INT" for m in RINGS) + ") AS n_literal FROM circuits")
def literal_motifs(spark, d):
    return V.circuits(spark, d).select("circuit_id", G.edge_code(F.col("state")).alias("edge_code"), sum((F.contains("state", F.lit(m)).cast("int") for m in RINGS), F.lit(0)).alias("n_literal"))


@query("has_motif", f"{Q}, {X} SELECT state, " + ", ".join(f'{f} AS "{n}"' for n, f in FLAGS.items()) + " FROM x")
def has_motif(spark, d):
    return V.q_table(spark, d).select("state", *[f.alias(n) for n, f in G.flags(F.col("state")).items()])


@query("motif_label", f"{Q}, {X} SELECT state, {LABEL} AS label FROM x")
def motif_label(spark, d):
    return V.q_table(spark, d).select("state", G.motif_label(G.flags(F.col("state"))).alias("label"))


def _canonical(own: str = "x") -> str:
    each = [f"array_to_string(list_sort(list_transform({own}, lambda i: translate(substr(i, 1, 2), 'ABC', '{''.join(p)}') || substr(i, 3, 1))), '_')" for p in permutations("ABC")]
    return f"'*ABC::' || list_min([{', '.join(each)}])"


@query("canonical_state", f"{Q}, {X} SELECT {_canonical()} AS canonical, count(*) AS n_states, sum(visits)::BIGINT AS visits FROM x GROUP BY 1")
def canonical_state(spark, d):
    return V.q_table(spark, d).groupBy(G.canonical(F.col("state")).alias("canonical")).agg(F.count("*").alias("n_states"), F.sum("visits").alias("visits"))


def _deleted(c: str) -> str:
    return f"'*{'ABC'.replace(c, '')}::' || array_to_string(list_filter(x, lambda i: NOT contains(substr(i, 1, 2), '{c}')), '_')"


@query("delete_component", f"{Q}, {X} SELECT state, {_deleted('C')} AS mutant FROM x")
def delete_component(spark, d):
    return V.q_table(spark, d).select("state", G.delete_component(F.col("state"), "C").alias("mutant"))


@query("deletion_mutants", f"{Q}, {X} " + " UNION ALL ".join(f"SELECT state, '{c}' AS deleted, {_deleted(c)} AS mutant FROM x" for c in "ABC") + " UNION ALL SELECT state, '(none)', state FROM x")
def deletion_mutants(spark, d):
    states = V.q_table(spark, d).select("state")
    each = states.withColumn("deleted", F.explode(F.concat(G.components(F.col("state")), F.array(F.lit("(none)")))))
    return each.withColumn("mutant", F.when(F.col("deleted") == "(none)", F.col("state")).otherwise(G.delete_component(F.col("state"), F.col("deleted"))))


@query("adjacency", f"{Q}, {X}, e AS (SELECT state, unnest(x) AS i FROM x), g AS (SELECT state, substr(i, 1, 1) AS a, substr(i, 2, 1) AS b, CASE WHEN i LIKE '%a' THEN 1 ELSE -1 END AS w FROM e WHERE substr(i, 1, 1) <> substr(i, 2, 1)) SELECT state, a, b, sum(w)::BIGINT AS w, count(*) AS n FROM (SELECT * FROM g UNION ALL SELECT state, b, a, w FROM g) GROUP BY ALL")
def adjacency(spark, d):
    e = V.q_table(spark, d).select("state", F.explode(G.interactions(F.col("state"))).alias("i"))
    g = e.select("state", F.substring("i", 1, 1).alias("a"), F.substring("i", 2, 1).alias("b"), F.when(F.endswith("i", F.lit("a")), 1).otherwise(-1).alias("w")).where("a <> b")
    return g.unionByName(g.select("state", F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("state", "a", "b").agg(F.sum("w").alias("w"), F.count("*").alias("n"))


# every circuit of up to two interactions serves as a pattern
PATTERNS = "SELECT DISTINCT state AS pattern FROM q_table WHERE len(string_split(split_part(state, '::', 2), '_')) <= 2"
PAIRS = f"{Q}, {X}, p AS ({PATTERNS}), px AS (SELECT pattern, list_filter(string_split(split_part(pattern, '::', 2), '_'), lambda i: i <> '') AS own FROM p), pl AS (" + " UNION ".join(f"SELECT pattern, list_transform(own, lambda i: translate(substr(i, 1, 2), 'ABC', '{''.join(q)}') || substr(i, 3, 1)) AS own FROM px" for q in permutations("ABC")) + "), pairs AS (SELECT DISTINCT state, pattern FROM x JOIN pl ON list_has_all(x, own))"
CELLS = f"{PAIRS}, t AS (SELECT count(*) AS n_all, count_if(q >= 0.5) AS n_ok FROM q_table), cells AS (SELECT pattern, count_if(q >= 0.5 AND state <> pattern)::BIGINT AS pattern_in_succ, (n_ok - count_if(q >= 0.5))::BIGINT AS others_in_succ, count_if(state <> pattern)::BIGINT AS pattern_in_null, n_all - count(*) AS others_in_null FROM pairs JOIN q_table USING (state), t GROUP BY pattern, n_ok, n_all)"
ODDS = CELLS + ", o AS (SELECT *, CASE WHEN others_in_succ * pattern_in_null = 0 THEN 'inf'::DOUBLE ELSE pattern_in_succ::DOUBLE * others_in_null / (others_in_succ * pattern_in_null) END AS oratio, 1.959963984540054 * sqrt(1.0 / pattern_in_succ + 1.0 / others_in_succ + 1.0 / pattern_in_null + 1.0 / others_in_null) AS half, pattern_in_succ * others_in_succ * pattern_in_null * others_in_null = 0 AS zero FROM cells)"
CHI = CELLS + ", h AS (SELECT *, pattern_in_succ::DOUBLE AS a, others_in_succ::DOUBLE AS b, pattern_in_null::DOUBLE AS c, others_in_null::DOUBLE AS e FROM cells), k AS (SELECT *, CASE WHEN (a + b) * (c + e) * (a + c) * (b + e) > 0 THEN (a + b + c + e) * pow(greatest(0, abs(a * e - b * c) - (a + b + c + e) / 2), 2) / ((a + b) * (c + e) * (a + c) * (b + e)) ELSE 0 END AS chi2 FROM h)"


def _pairs(spark, d):
    q = cut(V.q_table(spark, d))  # three branches start from it
    return q, M.pattern_containment(q, q.where(G.complexity(F.col("state")) <= 2).select(F.col("state").alias("pattern")))


def _cells(spark, d):
    q, pairs = _pairs(spark, d)
    return M.contingency(q, pairs, success())


@query("pattern_containment", f"{PAIRS} SELECT pattern, count(*) AS n FROM pairs GROUP BY pattern")
def pattern_containment(spark, d):
    return _pairs(spark, d)[1].groupBy("pattern").agg(F.count("*").alias("n"))


@query("contingency", f"{CELLS} SELECT * FROM cells")
def contingency(spark, d):
    return _cells(spark, d)


@query("odds_ratio", f"{ODDS} SELECT pattern, round(oratio, 6) AS odds_ratio, round(CASE WHEN zero THEN NULL ELSE exp(ln(oratio) - half) END, 6) AS ci_low, round(CASE WHEN zero THEN NULL ELSE exp(ln(oratio) + half) END, 6) AS ci_high FROM o")
def odds_ratio(spark, d):
    return M.odds_ratio(_cells(spark, d)).select("pattern", r6("odds_ratio").alias("odds_ratio"), r6(F.nanvl("ci_low", F.lit(None).cast("double"))).alias("ci_low"), r6(F.nanvl("ci_high", F.lit(None).cast("double"))).alias("ci_high"))


@query("chi2_pattern", f"{CHI} SELECT pattern, round(chi2, 6) AS chi2 FROM k")
def chi2_pattern(spark, d):
    return M.chi2_yates(_cells(spark, d)).select("pattern", r6("chi2").alias("chi2"))


@query("chi2_pattern_p", f"{CHI} SELECT pattern, round({V.erfc('sqrt(chi2 / 2)')}, 9) AS pvalue, round({V.erfc('sqrt(chi2 / 2)')} * (SELECT count(*) FROM k), 6) AS p_corrected FROM k")
def chi2_pattern_p(spark, d):
    return M.with_p_values(M.chi2_yates(_cells(spark, d))).select("pattern", F.round("pvalue", 9).alias("pvalue"), r6("p_corrected").alias("p_corrected"))


@query("testable_patterns", f"{PAIRS}, g AS (SELECT pattern, count(*) AS n_matches FROM pairs JOIN q_table USING (state) WHERE q >= 0.5 GROUP BY pattern) SELECT pattern, n_matches, round(q * visits)::BIGINT AS n_success FROM g JOIN q_table ON q_table.state = pattern WHERE n_matches > 5 AND round(q * visits) > 5")
def testable_patterns(spark, d):
    q, pairs = _pairs(spark, d)
    return M.testable(q, pairs, success())


@query("motif_verdict")
def motif_verdict(spark, d):
    return M.verdict(M.with_p_values(M.chi2_yates(M.odds_ratio(_cells(spark, d))))).select("pattern", "stars", "overrepresented", "significant", "sufficient", "motif")


@query("venn_counts", f"{Q}, {X} SELECT {FLAGS['AI']} AS \"AI\", {FLAGS['III']} AS \"III\", {FLAGS['toggle']} AS toggle, count(*) AS n, count_if(q >= 0.5)::BIGINT AS n_success FROM x GROUP BY ALL")
def venn_counts(spark, d):
    return M.venn_counts(V.q_table(spark, d), G.flags(F.col("state"), ["AI", "III", "toggle"]), success())


SUBSETS = "SELECT '(none)' AS combination" + "".join(f" UNION ALL SELECT '{c}'" for c in ["AI", "AAI", "III", "toggle", "AI+AAI", "AI+III", "AI+toggle", "AAI+III", "AAI+toggle", "III+toggle", "AI+AAI+III", "AI+AAI+toggle", "AI+III+toggle", "AAI+III+toggle", "AI+AAI+III+toggle"])


@query("motif_combos", f"{Q}, {X}, s AS ({SUBSETS}), g AS (SELECT {LABEL} AS combination, count(*) AS n FROM x GROUP BY 1) SELECT combination, coalesce(n, 0) AS n FROM s LEFT JOIN g USING (combination)")
def motif_combos(spark, d):
    return M.motif_combinations(V.q_table(spark, d), G.flags(F.col("state")))


MW = V.ctes("runtime") + ", r AS (SELECT o_orderstatus AS g, complexity AS v FROM runtime)"


@query("mann_whitney", f"{MW}, k AS (SELECT g, v, count(*) AS c FROM r GROUP BY ALL), n AS (SELECT g, count(*) AS n FROM r GROUP BY g) SELECT a.g AS g1, b.g AS g2, sum(a.c * b.c * CASE WHEN b.v < a.v THEN 1 WHEN b.v = a.v THEN 0.5 ELSE 0 END)::DOUBLE AS u1, m.n AS n1, o.n AS n2 FROM k a JOIN k b ON a.g < b.g JOIN n m ON m.g = a.g JOIN n o ON o.g = b.g GROUP BY ALL")
def mann_whitney(spark, d):
    return M.mann_whitney(V.runtime(spark, d), "o_orderstatus", "complexity")


@query("prob_less_than", f"{MW}, k AS (SELECT g, v, count(*) AS c FROM r WHERE g IN ('F', 'O') GROUP BY ALL) SELECT round(sum(a.c * b.c * CASE WHEN a.v < b.v THEN 1 ELSE 0 END)::DOUBLE / sum(a.c * b.c), 6) AS p_less FROM k a JOIN k b ON a.g = 'F' AND b.g = 'O'")
def prob_less_than(spark, d):
    return M.prob_less_than(V.runtime(spark, d), "o_orderstatus", "complexity", "F", "O").withColumn("p_less", r6("p_less"))
