"""Queries on time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from circuitlens.operators import outcomes as O, series as T
from circuitlens.plans import views as V

QUERIES, ORACLES = {}, {}
r6 = lambda c: F.round(c, 6)
S = V.ctes("series")
WEIGHTS = (1, 8, 28, 56, 70, 56, 28, 8, 1)
SMOOTH = f"{S}, w AS (SELECT series_id, t, (" + " + ".join(f"{k} * lag(value, {4 - i}) OVER o" for i, k in enumerate(WEIGHTS)) + ") / 256 AS smoothed FROM series WINDOW o AS (PARTITION BY series_id ORDER BY t)), sm AS MATERIALIZED (SELECT series_id, t - 4 AS t, smoothed AS v FROM w WHERE smoothed IS NOT NULL)"
SMOOTH = SMOOTH.replace("lag(value, -", "lead(value, ")
ACF = SMOOTH + ", c AS MATERIALIZED (SELECT series_id, t, v - avg(v) OVER (PARTITION BY series_id) AS x, count(*) OVER (PARTITION BY series_id) AS n FROM sm), raw AS MATERIALIZED (SELECT a.series_id, b.t - a.t AS lag, sum(a.x * b.x) AS s FROM c a JOIN c b ON a.series_id = b.series_id AND b.t >= a.t AND b.t - a.t < (a.n + 1) // 2 GROUP BY ALL), acf AS MATERIALIZED (SELECT series_id, lag AS t, CASE WHEN max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY series_id) > 0 THEN s / max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY series_id) ELSE 0 END AS value FROM raw)"
MINIMA = ACF + ", m AS (SELECT *, lag(value) OVER o AS b, lead(value) OVER o AS a FROM acf WINDOW o AS (PARTITION BY series_id ORDER BY t)), mm AS (SELECT series_id, t, value FROM m WHERE value <= b AND a >= value)"
LOWEST = MINIMA + ", k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY value, t) AS k FROM mm WHERE value < 0), low AS (SELECT s.series_id, coalesce(k.t, -1) AS lag, coalesce(k.value, 0.0) AS acf_min FROM (SELECT DISTINCT series_id FROM series) s LEFT JOIN k ON k.series_id = s.series_id AND k.k = 1)"


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


@query("binomial_smooth", f"{SMOOTH} SELECT series_id, (t + 4)::INT AS t, round(v, 6) AS smoothed FROM sm")
def binomial_smooth(spark, d):
    return T.binomial_smooth(V.series(spark, d)).withColumn("smoothed", r6("smoothed"))


@query("autocorrelation", f"{ACF} SELECT series_id, t::INT AS lag, round(value, 6) AS acf FROM acf")
def autocorrelation(spark, d):
    return T.acf_rows(V.series(spark, d)).select("series_id", F.col("t").alias("lag"), r6("value").alias("acf"))


@query("local_minima", f"{MINIMA} SELECT series_id, t::INT AS lag, round(value, 6) AS acf FROM mm")
def local_minima(spark, d):
    return T.local_minima(T.acf_rows(V.series(spark, d))).select("series_id", F.col("t").alias("lag"), r6("value").alias("acf"))


@query("lowest_minimum", f"{LOWEST} SELECT series_id, lag::INT AS lag, round(acf_min, 6) AS acf_min FROM low")
def lowest_minimum(spark, d):
    return T.lowest_minimum(T.acf_rows(V.series(spark, d))).select("series_id", "lag", r6("acf_min").alias("acf_min"))


@query("oscillation_summary", f"{LOWEST} SELECT series_id, lag::INT AS lag, round(acf_min, 6) AS acf_min, round(CASE WHEN lag > 0 THEN 1 / (2 * lag * 20.0) ELSE 0 END, 6) AS frequency FROM low")
def oscillation_summary(spark, d):
    return T.oscillation_summary(V.series(spark, d), 20.0).select("series_id", "lag", r6("acf_min").alias("acf_min"), r6("frequency").alias("frequency"))


@query("osc_frequencies", f"{LOWEST} SELECT series_id, round(60 / (2 * lag * 20.0), 6) AS frequency_per_min, round(acf_min, 6) AS acf_min, n AS n_events FROM low JOIN (SELECT event_type AS series_id, count(*) AS n FROM events GROUP BY 1) USING (series_id) WHERE acf_min < -0.15")
def osc_frequencies(spark, d):
    found = T.oscillation_summary(V.series(spark, d), 20.0).where("acf_min < -0.15")
    samples = V.table(spark, d, "events").groupBy(F.col("event_type").alias("series_id")).agg(F.count("*").alias("n_events"))
    return found.join(samples, "series_id").select("series_id", r6(F.col("frequency") * 60).alias("frequency_per_min"), r6("acf_min").alias("acf_min"), "n_events")


DFT = SMOOTH + ", c AS MATERIALIZED (SELECT series_id, t, v - avg(v) OVER (PARTITION BY series_id) AS x, count(*) OVER (PARTITION BY series_id) AS n FROM sm), f AS (SELECT series_id, k, any_value(n) AS n, pow(sum(x * cos(2 * pi() * k * t / n)), 2) + pow(sum(x * sin(2 * pi() * k * t / n)), 2) AS p FROM c JOIN (SELECT unnest(range(500)) AS k) q ON k <= n // 2 GROUP BY series_id, k), g AS (SELECT series_id, k, p / sum(p) OVER (PARTITION BY series_id) AS power FROM f)"


@query("power_spectrum", f"{DFT} SELECT k::INT AS k, round(avg(power), 6) AS power FROM g WHERE k < 20 GROUP BY k")
def power_spectrum(spark, d):
    return T.power_spectrum(V.series(spark, d), 20).groupBy("k").agg(r6(F.avg("power")).alias("power"))


@query("dominant_species", f"{S}, m AS (SELECT series_id, t, CASE WHEN max(value) OVER (PARTITION BY series_id) > 0 THEN value / max(value) OVER (PARTITION BY series_id) ELSE 0 END AS share FROM series), k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY share DESC, series_id) AS k FROM m) SELECT t::INT AS t, series_id AS dominant, round(share, 6) AS share FROM k WHERE k = 1")
def dominant_species(spark, d):
    return T.dominant(V.series(spark, d)).select("t", "dominant", r6("share").alias("share"))


@query("phase_portrait")
def phase_portrait(spark, d):
    return T.phase_portrait(V.table(spark, d, "embeddings"), "vec_id", "embedding", 2)


@query("align_mutants", f"{S}, s AS (SELECT * FROM series WHERE series_id <> 'error' AND t >= 100 AND t < 400) SELECT a.series_id, g.t::INT AS t, coalesce(s.value, 0.0) AS value FROM (SELECT DISTINCT series_id FROM series) a CROSS JOIN (SELECT unnest(range(400)) AS t) g LEFT JOIN s ON s.series_id = a.series_id AND s.t = g.t")
def align_mutants(spark, d):
    s = V.series(spark, d)
    return T.align(s.where("series_id <> 'error' and t >= 100 and t < 400").select("series_id", "t", "value"), s, 400).select("series_id", "t", "value")


@query("matched_traces", V.ctes("samples", "series") + ", k AS (SELECT state FROM samples GROUP BY state ORDER BY count(*) DESC, state LIMIT 2), g AS (SELECT param_idx, count(DISTINCT state) AS n_states FROM samples WHERE acf_min < -0.01 AND state IN (SELECT state FROM k) GROUP BY param_idx), p AS (SELECT min(param_idx) AS param_idx FROM g WHERE n_states = 2), e AS (SELECT series_id, row_number() OVER (ORDER BY series_id) - 1 AS i FROM (SELECT DISTINCT series_id FROM series)) SELECT p.param_idx, series_id, t::INT AS t, value FROM p JOIN e ON p.param_idx % 5 = e.i JOIN series USING (series_id)")
def matched_traces(spark, d):
    from pyspark.sql import Window

    s, series = V.samples(spark, d), V.series(spark, d)
    states = s.groupBy("state").count().orderBy(F.desc("count"), "state").limit(2).select("state")
    first = O.common_successes(s, states, F.col("acf_min") < -0.01).agg(F.min("param_idx").alias("param_idx"))
    names = series.select("series_id").distinct().withColumn("i", F.row_number().over(Window.orderBy("series_id")) - 1)  # one row a series name
    return first.join(names, F.col("param_idx") % 5 == F.col("i")).join(series, "series_id").select("param_idx", "series_id", "t", "value")
