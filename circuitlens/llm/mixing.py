"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from circuitlens.llm.common import Rounds, checkpointed
from circuitlens.llm.token_counts import count_tokens

#: Raking ends when every marginal is this close to its target, in proportion; with a warning after so many rounds,
#: or when in so many rounds the distance has not fallen by this share, as when the targets can't be met together.
TOLERANCE, MAX_ROUNDS, STALL_ROUNDS, STALL = 1e-9, 2000, 50, 0.01
#: Share of all tokens to keep, and the targets: a power of the observed shares, or weights by value.
KEEP = 0.5
TARGETS: Mapping[str, float | Mapping[str, float]] = {"source": 0.5, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "topic": 0.7}
SEED = "mix-1"
BROADCAST_ROWS = 100_000
#: Cells (counted first) that are raked by numpy on the driver; more are raked by Spark, with the same result.
DRIVER_CELLS = 50_000
DIMS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level BPE tokenizer in JSON and the pattern by which it splits."""

    path: str
    pattern: str


def topic_of(text: Column) -> Column:
    """A topic by the form of the text: table, symbols, capitals or prose; a topic column of the corpus can stand in."""
    return F.when(text.contains(" | "), "table").when(text.rlike("[#*$%&]{3}"), "symbols").when(text == F.upper(text), "capitals").otherwise("prose")


def _target(dim: str, targets: Mapping) -> Column:
    """The unscaled target of a value with the observed share ``share``."""
    want = targets[dim]
    if not isinstance(want, Mapping):
        return F.pow("share", F.lit(float(want)))
    target = F.col("share")  # values that aren't named keep their share
    for value, weight in want.items():
        target = F.when(F.col(dim) == value, F.lit(float(weight))).otherwise(target)
    return target


def calibrate(cells: DataFrame, targets: Mapping = TARGETS, keep: float = KEEP, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """Cells (source, lang, topic, tokens) with the probability that a document of the cell is drawn.

    Raking: each step scales the weights of one dimension to its target
    marginal, round by round, until every marginal is within ``tolerance`` of
    its target. Calibration: probability min(1, scale * w / tokens) with the
    scale for which the expected tokens are ``keep`` of all; cells that are
    used up count whole and the others share the rest by their weights.

    Adds w (the weights sum to all tokens), probability (six decimals),
    marginal_error (the greatest distance of a raked marginal from its target,
    in proportion to it) and draw_error (the greatest distance between a
    marginal's share of the expected draw and its target share, which cells
    that are used up leave). Targets that can't be met together leave a
    marginal_error above the tolerance and give a warning that names the
    dimension; raking then ends once the error no longer falls. Named values that
    no cell has are left out of the targets.

    All work is on cells, of which there are as many as combinations of
    values: at most ``driver_cells`` are collected, more stay in Spark.
    """
    cells = checkpointed(cells.select(*DIMS, "tokens"))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    for dim in DIMS:
        shares = cells.groupBy(dim).agg(F.sum("tokens").alias("n")).withColumn("share", F.col("n") / F.lit(float(total or 1)))
        raw = checkpointed(shares.select(dim, _target(dim, targets).alias("raw")))
        scale = raw.agg(F.sum("raw")).first()[0] or 1.0
        cells = cells.join(raw, dim).withColumn(f"want_{dim}", F.col("raw") / F.lit(scale) * F.lit(float(total))).drop("raw")
    cells = checkpointed(cells)
    out = _here(cells, keep, tolerance, max_rounds) if cells.count() <= driver_cells else _spread(cells, keep, tolerance, max_rounds)
    return out.select(*DIMS, "tokens", "w", F.round("probability", 6).alias("probability"), F.round("marginal_error", 9).alias("marginal_error"), F.round("draw_error", 6).alias("draw_error"))


def _warn(errors: list[dict[str, float]]) -> None:
    dim, error = max(errors[-1].items(), key=lambda e: e[1])
    warnings.warn(f"the targets can't be met together: after {len(errors)} rounds a marginal of {dim} is off by {error:.3g} of its target", stacklevel=3)


def _settled(errors: list[dict[str, float]], tolerance: float) -> bool:
    """Whether raking ends, by the distances of the marginals after each round."""
    worst = [max(e.values()) for e in errors]
    return worst[-1] <= tolerance or len(worst) > STALL_ROUNDS and worst[-1] > (1 - STALL) * worst[-1 - STALL_ROUNDS]


def _here(cells: DataFrame, keep: float, tolerance: float, max_rounds: int) -> DataFrame:
    rows = cells.select(*DIMS, "tokens", *[f"want_{d}" for d in DIMS]).collect()
    tokens = np.array([r["tokens"] for r in rows], float)
    codes = [np.unique([r[d] for r in rows] or [""], return_inverse=True)[1][: len(rows)] for d in DIMS]
    wants = [np.array([r[f"want_{d}"] for r in rows], float) for d in DIMS]
    w, errors = tokens.copy(), []
    for _ in range(max_rounds if rows else 0):
        for code, want in zip(codes, wants):
            w *= want / np.bincount(code, w)[code]
        errors.append({d: float(np.abs(np.bincount(c, w)[c] / want - 1).max()) for d, c, want in zip(DIMS, codes, wants)})
        if _settled(errors, tolerance):
            break
    error = max(errors[-1].values()) if errors else 0.0
    if error > tolerance:
        _warn(errors)
    drawn = tokens
    if keep < 1 and rows:  # cells are used up in the order of tokens over weight
        order = np.argsort(tokens / w, kind="stable")
        full = np.concatenate(([0.0], np.cumsum(tokens[order])[:-1]))
        rest = w[order][::-1].cumsum()[::-1]
        scale = (keep * tokens.sum() - full) / rest
        first = int(np.argmax(scale <= (tokens / w)[order]))  # the cells before it are used up, it and those after it are not
        drawn = np.minimum(tokens, scale[first] * w)
    off = max((float(np.abs(np.bincount(c, drawn)[c] / drawn.sum() - want / tokens.sum()).max()) for c, want in zip(codes, wants)), default=0.0) if rows else 0.0
    found = [(*(r[d] for d in DIMS), r["tokens"], float(a), float(b / t), error, off) for r, a, b, t in zip(rows, w, drawn, tokens)]
    return cells.sparkSession.createDataFrame(found, ", ".join(f"{d} string" for d in DIMS) + ", tokens bigint, w double, probability double, marginal_error double, draw_error double")


def _gaps(cells: DataFrame, column: Column, want: dict[str, Column], gap) -> dict[str, float]:
    """For each dimension the greatest ``gap`` between a marginal of ``column`` and its target."""
    parts = {d: cells.groupBy(d).agg(F.sum(column).alias("have"), F.first(want[d]).alias("want")).agg(F.max(gap(F.col("have"), F.col("want")))).first()[0] for d in DIMS}
    return {d: float(p or 0.0) for d, p in parts.items()}


def _spread(cells: DataFrame, keep: float, tolerance: float, max_rounds: int) -> DataFrame:
    """The same in Spark; a round's sums are combined before the shuffle, and the round ends in a written table."""
    want = {d: F.col(f"want_{d}") for d in DIMS}
    hand_on = Rounds(cells.sparkSession)
    cells, errors = hand_on(cells.withColumn("w", F.col("tokens").cast("double"))), []
    for _ in range(max_rounds):
        for dim in DIMS:
            sums = cells.groupBy(dim).agg(F.sum("w").alias("have"))
            cells = cells.join(sums, dim).withColumn("w", F.col("w") * (want[dim] / F.col("have"))).drop("have")
        cells = hand_on(cells)
        errors.append(_gaps(cells, F.col("w"), want, lambda have, wanted: F.abs(have / wanted - 1)))
        if _settled(errors, tolerance):
            break
    error = max(errors[-1].values()) if errors else 0.0
    if error > tolerance:
        _warn(errors)
    cells, scale = hand_on.close(cells), None
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    while True:  # each round uses up another cell, or is the last
        full = F.lit(False) if scale is None else F.col("tokens") <= F.lit(scale) * F.col("w")
        sums = cells.agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("w"))).alias("rest")).first()
        if not sums["rest"]:
            break
        before, scale = scale, (keep * total - float(sums["full"] or 0)) / sums["rest"]
        if before is not None and scale <= before * (1 + 1e-15):
            break
    drawn = F.col("tokens").cast("double") if keep >= 1 or scale is None else F.least(F.col("tokens").cast("double"), F.lit(scale) * F.col("w"))
    expected = float(cells.agg(F.sum(drawn)).first()[0] or 1)
    off = max(_gaps(cells, drawn, want, lambda have, wanted: F.abs(have / F.lit(expected) - wanted / F.lit(total or 1.0))).values())
    return cells.withColumns({"probability": drawn / F.col("tokens"), "marginal_error": F.lit(error), "draw_error": F.lit(off)})


def mix(docs: DataFrame, tokenizer: Tokenizer, topic: Column | None = None, targets: Mapping = TARGETS, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **limits: float) -> DataFrame:
    """Every document with its place in the mixture: (id, source, lang, topic, tokens, probability, marginal_error, draw_error, kept).

    Token weights of the cells (source, language, topic) are raked to the
    target marginals, cells get calibrated probabilities (see ``calibrate``),
    and a document is kept if a hash of its id, even on 0 to 1, lies below its
    cell's. So repeated rows are kept or left out together, and the expected
    tokens hold for every cell. Tokens are those of ``tokenizer``, whole texts.
    Null sources, languages and topics are values of their own, "(null)"; null
    and empty texts count one token; a null id is hashed as "(null)". An empty
    table gives no rows. Other columns are not read.
    """
    marked = checkpointed(_counted(docs, tokenizer, topic, id_col, text_col, source_col, lang_col))
    drawn = _probabilities(marked, targets, keep, limits)
    joined = marked.join(drawn, list(DIMS))
    return joined.select(F.col("id").alias(id_col), *DIMS, "tokens", "probability", "marginal_error", "draw_error", _drawn(F.col("id"), F.col("probability")).alias("kept"))


def sample(docs: DataFrame, tokenizer: Tokenizer, topic: Column | None = None, targets: Mapping = TARGETS, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **limits: float) -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps, with all their columns, whatever their names."""
    drawn = _probabilities(_counted(docs, tokenizer, topic, id_col, text_col, source_col, lang_col), targets, keep, limits)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), *_dims(topic, text_col, source_col, lang_col))
    return rows.join(drawn, list(DIMS)).where(_drawn(F.col("id"), F.col("probability"))).select("row.*")


def _dims(topic: Column | None, text_col: str, source_col: str, lang_col: str) -> list[Column]:
    named = (F.col(source_col), F.col(lang_col), topic_of(F.col(text_col)) if topic is None else topic)
    return [F.coalesce(c.cast("string"), F.lit("(null)")).alias(d) for c, d in zip(named, DIMS)]


def _counted(docs: DataFrame, tokenizer: Tokenizer, topic: Column | None, id_col: str, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """(id, source, lang, topic, tokens) of every row."""
    key = F.struct(F.col(id_col).alias("id"), *_dims(topic, text_col, source_col, lang_col))
    counts = count_tokens(docs.select(key.alias("key"), F.col(text_col).alias("text")), tokenizer.path, tokenizer.pattern, "key", "text")
    return counts.select("key.*", F.greatest(F.lit(1), F.col("n_tokens")).cast("bigint").alias("tokens"))


def _probabilities(marked: DataFrame, targets: Mapping, keep: float, limits: Mapping) -> DataFrame:
    cells = marked.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"))
    drawn = checkpointed(calibrate(cells, targets, keep, **limits).select(*DIMS, "probability", "marginal_error", "draw_error"))
    return F.broadcast(drawn) if drawn.count() <= BROADCAST_ROWS else drawn


def _drawn(key: Column, probability: Column) -> Column:
    text = F.concat(F.lit(f"{SEED}|"), F.coalesce(key.cast("string"), F.lit("(null)")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0) < probability
