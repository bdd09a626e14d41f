"""URL filters: host and path rules, and a character language-model ratio, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from circuitlens.llm.common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Longest context of the models; characters that count as one alphabet for the last resort.
ORDER, ALPHABET = 4, 256
#: Every fifth labelled URL calibrates the threshold, the others train the models.
FOLDS = 5


def _parts(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _rules(rules: tuple, host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule (host and path together) and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _model_text(host: Column, path: Column) -> Column:
    """What the models read of a URL: host and path, A-Z lower-cased, with one sign for all characters beyond U+FFFF."""
    return F.translate(F.regexp_replace(F.concat(host, path), r"[\x{10000}-\x{10FFFF}]", "\ufffd"), UPPER, LOWER)


def _grams(text: Column, order: int) -> Column:
    """Each character of a text and its end, with the ``order`` characters before it; in time linear in the text."""
    padded = F.concat(F.lit("\x02" * order), text, F.lit("\x03"))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order + 1}}}))"), 1)


def _counts(labelled: DataFrame, order: int) -> DataFrame:
    """Counts of the grams of all orders in rejected and accepted texts: (gram, n0, n1).

    Lower orders are sums of the highest, so texts are cut up once.
    """
    grams = labelled.select("accepted", F.explode(_grams(F.col("text"), order)).alias("gram"))
    top = grams.groupBy("gram").agg(F.count_if(~F.col("accepted")).alias("n0"), F.count_if("accepted").alias("n1"))
    shorter = top.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda k: F.substring("gram", k, F.lit(order + 1)))).alias("gram"), "n0", "n1")
    return shorter.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _totals(counts: DataFrame) -> DataFrame:
    """What follows each context, by label: characters (c0, c1) and kinds of characters (t0, t1)."""
    contexts = counts.select(F.expr("substring(gram, 1, length(gram) - 1)").alias("context"), "n0", "n1")
    return contexts.groupBy("context").agg(
        F.sum("n0").alias("c0"), F.sum("n1").alias("c1"), F.count_if(F.col("n0") > 0).alias("t0"), F.count_if(F.col("n1") > 0).alias("t1")
    )


def _ratios(grams: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(gram, ratio): log of P(accepted) over P(rejected) of the last character after its context.

    Witten-Bell smoothing, of variable order: P_k = (n + t * P_(k-1)) / (c + t),
    an unseen context keeps the shorter one's probability, and the last resort
    is even over the alphabet.
    """
    counts = checkpointed(counts)
    totals = checkpointed(_totals(counts))  # both joins then shuffle both sides, and the empty context can be split
    steps = grams.select("gram", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k"))
    steps = steps.select("gram", "k", F.expr(f"substring(gram, {order} - k + 1, k + 1)").alias("part"), F.expr(f"substring(gram, {order} - k + 1, k)").alias("context"))
    seen = counts.select(F.col("gram").alias("part"), "n0", "n1")
    joined = steps.join(totals, "context", "left").join(seen, "part", "left")
    level = F.struct("k", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("n0", "n1", "c0", "c1", "t0", "t1")])
    levels = joined.groupBy("gram").agg(F.sort_array(F.collect_list(level)).alias("levels"))

    def smoothed(label: int) -> Column:
        n, c, t = f"n{label}", f"c{label}", f"t{label}"
        return F.aggregate("levels", F.lit(1.0 / ALPHABET), lambda p, v: F.when(v[c] > 0, (v[n] + v[t] * p) / (v[c] + v[t])).otherwise(p))

    return levels.select("gram", (F.log(smoothed(1)) - F.log(smoothed(0))).alias("ratio"))


def judge_urls(pages: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url", order: int = ORDER) -> DataFrame:
    """The verdict on every URL: the longest fitting rule's, else the language models'.

    A rule fits its host and all its subdomains if the path starts with the
    rule's. The URLs that rules allow and block train two character models
    (every fifth by checksum is held back); the score of a URL is the mean log
    ratio of its characters, and the threshold is the score that best separates
    the held-back URLs (mean of both classes' accuracy, the lowest such score
    on a grid of 0.01; 0 if a class is missing). Models see the host and path.

    Returns ``id_col``, host, path, rule (null if none fits), verdict (allow or
    block) and score (the model's, null where a rule decides). A null url or
    one without ``://`` has empty host and path; its score counts only the end
    of the text. Null ids and repeated rows stay; other columns are not read.

    Grams, not URLs, meet in the joins: counts are summed before each shuffle.
    The tables that grams are joined with are checkpoints, so both sides of
    these joins are plain shuffles and a gram that every URL holds is split.
    The models tell no characters beyond U+FFFF apart.
    """
    host, path = _parts(F.col("__url"))
    parsed = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")).select("__id", host.alias("host"), path.alias("path"))
    rule, ruled = _rules(rules, F.col("host"), F.col("path"))
    parsed = parsed.select("__id", "host", "path", rule.alias("rule"), ruled.alias("ruled"), _model_text(F.col("host"), F.col("path")).alias("text"))

    texts = parsed.groupBy("text").agg(F.max("ruled").alias("ruled"), F.count("*").alias("rows"))
    texts = checkpointed(texts.withColumn("fold", (F.conv(F.substring(F.md5("text"), 1, 4), 16, 10).cast("int") % FOLDS)).withColumn("row", F.monotonically_increasing_id()))
    training = texts.where("ruled is not null and fold <> 0").select("text", (F.col("ruled") == "allow").alias("accepted"))
    counts = _counts(training, order)
    scored = texts.where("ruled is null or fold = 0").select("row", "ruled", F.explode(_grams(F.col("text"), order)).alias("gram"))
    ratios = checkpointed(_ratios(scored.select("gram").distinct(), counts, order))  # so that the next join shuffles both sides
    means = scored.join(ratios, "gram").groupBy("row", "ruled").agg((F.sum(F.round("ratio", 6).cast("decimal(18,6)")).cast("double") / F.count("*")).alias("score"))
    means = checkpointed(means.withColumn("score", F.round("score", 6)))

    grid = means.where("ruled is not null").groupBy(F.ceil(F.col("score") * 100).cast("long").alias("bin")).agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    threshold = F.lit(_threshold(grid))
    models = means.where("ruled is null").join(texts, "row").select("text", "score")
    out = parsed.join(models, "text", "left")
    verdict = F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return out.select(F.col("__id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("ruled").isNull(), F.col("score")).alias("score"))


def _threshold(grid: DataFrame) -> float:
    """The lowest grid score with the best mean accuracy: allow from it, block below it.

    The grid has a row for each hundredth of a mean log ratio, which lies
    within a few units of 0 whatever the number of URLs, so it is small.
    """
    rows = sorted((r["bin"], r["good"], r["bad"]) for r in grid.collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0.0
    best, at, above, below = -1.0, 0.0, good, 0
    for k, g, b in rows:  # allow scores of at least k - 1 hundredths, all of whose bins come from here on
        accuracy = above / good + below / bad
        if accuracy > best + 1e-12:
            best, at = accuracy, (k - 1) / 100
        above, below = above - g, below + b
    return at


def oracle(rules: tuple = RULES, order: int = ORDER) -> str:
    """The same verdicts in DuckDB SQL, over the table ``pages``."""
    rule = verdict = "NULL"
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    odds = [f"1.0 / {ALPHABET}::DOUBLE"] * 2
    for k in range(order + 1):
        for i in (0, 1):
            odds[i] = f"(CASE WHEN c{i}_{k} > 0 THEN (n{i}_{k} + t{i}_{k} * {odds[i]}) / (c{i}_{k} + t{i}_{k})::DOUBLE ELSE {odds[i]} END)"
    levels = ", ".join(f"max(CASE WHEN k = {k} THEN coalesce({c}, 0) END) AS {c}_{k}" for k in range(order + 1) for c in ("n0", "n1", "c0", "c1", "t0", "t1"))
    grams = f"unnest(list_transform(range(1, length(text) + 2), lambda i: substr(repeat(chr(2), {order}) || text || chr(3), i, {order + 1}))) AS gram"
    return rf"""
WITH u AS (
    SELECT page_id, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS rest FROM pages
), h AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u
), p AS (
    SELECT page_id, host, path, translate(regexp_replace(host || path, '[\x{{10000}}-\x{{10FFFF}}]', chr(65533), 'g'), '{UPPER}', '{LOWER}') AS text, {rule} AS rule, {verdict} AS ruled FROM h
), x AS (
    SELECT text, max(ruled) AS ruled, ('0x' || substr(md5(text), 1, 4))::INT % {FOLDS} AS fold FROM p GROUP BY text
), top AS (
    SELECT gram, count(*) FILTER (ruled = 'block') AS n0, count(*) FILTER (ruled = 'allow') AS n1
    FROM (SELECT ruled, {grams} FROM x WHERE ruled IS NOT NULL AND fold <> 0) GROUP BY gram
), n AS (
    SELECT part, sum(n0) AS n0, sum(n1) AS n1 FROM (SELECT n0, n1, unnest(list_transform(range(1, {order + 2}), lambda k: substr(gram, k))) AS part FROM top) GROUP BY part
), c AS (
    SELECT substr(part, 1, length(part) - 1) AS context, sum(n0) AS c0, sum(n1) AS c1, count(*) FILTER (n0 > 0) AS t0, count(*) FILTER (n1 > 0) AS t1 FROM n GROUP BY 1
), s AS (
    SELECT text, ruled, {grams} FROM x WHERE ruled IS NULL OR fold = 0
), d AS (
    SELECT DISTINCT gram FROM s
), l AS (
    SELECT d.gram, k, n0, n1, c0, c1, t0, t1 FROM d CROSS JOIN (SELECT unnest(range({order + 1})) AS k) q
    LEFT JOIN n ON n.part = substr(d.gram, {order} - k + 1, k + 1) LEFT JOIN c ON c.context = substr(d.gram, {order} - k + 1, k)
), r AS (
    SELECT gram, round(ln({odds[1]}) - ln({odds[0]}), 6)::DECIMAL(18, 6) AS ratio FROM (SELECT gram, {levels} FROM l GROUP BY gram)
), m AS (
    SELECT text, ruled, round(sum(ratio)::DOUBLE / count(*), 6) AS score FROM s JOIN r USING (gram) GROUP BY text, ruled
), b AS (
    SELECT ceil(score * 100)::BIGINT AS bin, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM m WHERE ruled IS NOT NULL GROUP BY 1
), a AS (
    SELECT bin, sum(good) OVER () AS goods, sum(bad) OVER () AS bads, sum(good) OVER (ORDER BY bin DESC) AS above, coalesce(sum(bad) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b
), o AS (
    SELECT coalesce(max(t), 0) AS threshold FROM (SELECT (bin - 1) / 100.0 AS t FROM a WHERE goods > 0 AND bads > 0 ORDER BY round(above / goods + below / bads, 12) DESC, bin LIMIT 1)
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN p.ruled IS NULL THEN score END AS score
FROM p LEFT JOIN (SELECT text, score FROM m WHERE ruled IS NULL) m USING (text) CROSS JOIN o
"""
