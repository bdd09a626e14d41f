"""License scans by sentence rules, in DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from circuitlens.llm.license_data import OTHERS, all_notices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends of sentences: where every line ends one, and where lines are wrapped and paragraphs end one.
SENTENCE_END = r"[.!?]+[ \t\r\n]+|\n"
WRAPPED_END = r"[.!?]+[ \t\r\n]+|:[ \t\r]*\n|\n[ \t\r]*\n"
#: A run of marks is tried once, from its start, so runs of any length cost linear time.
RUN, RUN_ONCE = "[.!?]+", "(?<![.!?])[.!?]++"
#: The marks of comments and lists at the start of a line.
MARGIN = r"\n[ \t]*[#*/;%>-]+[ \t]*"
#: Clauses that name an organisation, as they are known.
ORGANISATION = (r"^neither the name of [a-z0-9 ]+? nor the names of", "neither the name of the copyright holder nor the names of")
#: A word of which each known sentence holds one, so texts without any need no lexing.
ANCHORS = ("licen", "permission", "permitted", "copyright", "redistribut", "warrant", "reserved", "unencumbered", "anyone", "misrepresented", "liable", "perl", "creative commons")


def _plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def _tables() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Known sentences as the splitter yields them, by identifier, and the rules: a licence and its sentences in order."""
    known: dict[str, str] = {}
    rules = []
    for licence, name, notice in all_notices():
        name = re.sub("[^a-z0-9]+", "_", name.lower())
        pieces = [p for p in map(_plain, re.split(WRAPPED_END, notice)) if len(p) >= 8]
        ids = tuple(known.setdefault(p, name if len(pieces) == 1 else f"{name}_{k + 1}") for k, p in enumerate(pieces))
        if (licence, ids) not in rules:
            rules.append((licence, ids))
    for name, sentence in OTHERS.items():
        known.setdefault(_plain(sentence), name)
    return {name: sentence for sentence, name in known.items()}, rules


SENTENCES, RULES = _tables()


def _wider() -> list[list[int]]:
    """For each rule the rules of other licences that ask for its sentences and more, in the same order."""

    def within(few: tuple[str, ...], many: tuple[str, ...]) -> bool:
        rest = iter(many)
        return all(x in rest for x in few)

    return [[j for j, (other, many) in enumerate(RULES) if other != licence and len(many) > len(ids) and within(ids, many)] for licence, ids in RULES]


def _identified(text: Column, end: str) -> Column:
    """Identifiers of the known sentences of a lower-cased text, in order."""
    known = F.create_map(*[F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)])
    lengths = {len(s) for s in SENTENCES.values()}
    short, long = min(lengths), max(lengths)
    pieces = F.filter(F.split(text, end.replace(RUN, RUN_ONCE)), lambda s: F.length(s) >= short)
    plain = F.transform(pieces, lambda s: F.regexp_replace(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")), *ORGANISATION))
    names = F.transform(F.filter(plain, lambda s: F.length(s).between(short, long)), lambda s: known[s])
    return F.filter(names, lambda n: n.isNotNull())


def _met(ids: Column, present: Column) -> Column:
    """For each rule whether its sentences come in order: from one to the next place of its next identifier.

    A rule is followed only if all of its identifiers are ``present``; each step looks at the rest of the sequence once.
    """
    rules = F.array(*[F.array(*map(F.lit, names)) for _, names in RULES])

    def follow(at: Column, name: Column) -> Column:
        return at + F.nullif(F.array_position(F.slice(ids, at.cast("int") + 1, F.size(ids)), name), F.lit(0))

    return F.transform(rules, lambda rule: F.when(F.size(F.array_except(rule, present)) == 0, F.aggregate(rule, F.lit(0).cast("bigint"), follow).isNotNull()).otherwise(False))


def _rule(names: tuple[str, ...]) -> str:
    """A rule as a pattern on comma-joined identifiers, for SQL."""
    return "," + "(?:[a-z0-9_]+,)*".join(f"{n}," for n in names)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences that every whole text names, one row per input row.

    The text is cut into sentences twice: at sentence ends and line ends, and
    with wrapped lines joined. Sentences are normalised and mapped to the
    identifiers of known licence sentences; the sequence of identifiers is
    matched against the ordered rules, whose sentences must come in order. A
    rule that a wider one of another licence covers doesn't count beside it,
    and rights reserved count where no licence is named.

    Returns ``id_col``, n_sentences (known ones, lines as they stand),
    sentence_ids (in order, comma-joined), licenses (in order of the rules,
    comma-joined, each once; empty if none) and primary_license (the first;
    null if none). Null and empty texts have none. Null ids and repeated rows
    stay; other columns are not read. No shuffle and no Python. Time is linear
    in a text, for each rule whose sentences it holds; an organisation's name may be of any length, but holds no full stop.
    """
    low = F.translate(F.col("__text"), UPPER, LOWER)
    likely = F.col("__text").rlike("(?i)" + "|".join(ANCHORS))
    picked = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    none = F.array().cast("array<string>")
    lines = F.when(likely, _identified(low, SENTENCE_END)).otherwise(none)
    joined = F.regexp_replace(F.concat(F.lit("\n"), low), MARGIN, "\n")
    wrapped = F.when(likely, _identified(joined, WRAPPED_END)).otherwise(none)
    found = picked.select("__id", lines.alias("lines"), wrapped.alias("wrapped"))
    found = found.select("*", F.array_distinct("lines").alias("in_lines"), F.array_distinct("wrapped").alias("in_wrapped"))
    any_known = (F.size("lines") > 0) | (F.size("wrapped") > 0)
    both = F.zip_with(_met(F.col("lines"), F.col("in_lines")), _met(F.col("wrapped"), F.col("in_wrapped")), lambda a, b: a | b)
    found = found.select("__id", "lines", F.when(any_known, both).alias("met"))
    named = []
    for k, ((licence, _), wider) in enumerate(zip(RULES, _wider())):
        ok = F.col("met")[k]
        for j in wider:
            ok = ok & ~F.col("met")[j]
        named.append(F.when(ok, F.lit(licence)))
    listed = F.array_distinct(F.array_compact(F.array(*named)))
    found = found.select("__id", "lines", F.when(F.col("met").isNull(), F.array().cast("array<string>")).otherwise(listed).alias("listed"))
    licenses = F.when(F.size("listed") > 1, F.array_remove("listed", "proprietary")).otherwise(F.col("listed"))
    return found.select(
        F.col("__id").alias(id_col), F.size("lines").cast("long").alias("n_sentences"),
        F.array_join("lines", ",").alias("sentence_ids"), F.array_join(licenses, ",").alias("licenses"), F.get(licenses, F.lit(0)).alias("primary_license"),
    )


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def oracle() -> str:
    known = "MAP {" + ", ".join(f"{_sql(s)}: {_sql(n)}" for n, s in SENTENCES.items()) + "}"

    def names(text: str, end: str) -> str:
        plain = f"list_transform(string_split_regex({text}, {_sql(end)}), lambda s: regexp_replace(trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')), {_sql(ORGANISATION[0])}, {_sql(ORGANISATION[1])}))"
        return f"',' || coalesce(array_to_string(list_filter(list_transform({plain}, lambda s: {known}[s]), lambda n: n IS NOT NULL), ','), '') || ','"

    met = ", ".join(f"regexp_matches(l, {_sql(_rule(n))}) OR regexp_matches(w, {_sql(_rule(n))})" for _, n in RULES)
    named = ", ".join("CASE WHEN " + " AND ".join([f"m[{k + 1}]", *[f"NOT m[{j + 1}]" for j in wider]]) + f" THEN {_sql(licence)} END" for k, ((licence, _), wider) in enumerate(zip(RULES, _wider())))
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
i AS (SELECT doc_id, {names("t", SENTENCE_END)} AS l, {names(f"regexp_replace(chr(10) || t, {_sql(MARGIN)}, chr(10), 'g')", WRAPPED_END)} AS w FROM d),
r AS (SELECT doc_id, l, [{met}] AS m FROM i),
n AS (SELECT doc_id, l, [{named}] AS m FROM r),
u AS (SELECT doc_id, l, list_filter(m, lambda x, i: x IS NOT NULL AND list_position(m, x) = i) AS m FROM n),
f AS (SELECT doc_id, l, CASE WHEN len(m) > 1 THEN list_filter(m, lambda x: x <> 'proprietary') ELSE m END AS m FROM u)
SELECT doc_id, CASE WHEN length(l) > 2 THEN len(string_split(l, ',')) - 2 ELSE 0 END::BIGINT AS n_sentences,
    CASE WHEN length(l) > 2 THEN substr(l, 2, length(l) - 2) ELSE '' END AS sentence_ids,
    coalesce(array_to_string(m, ','), '') AS licenses, m[1] AS primary_license
FROM f
"""
