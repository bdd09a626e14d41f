"""Quality classifier: a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from circuitlens.llm.common import text_blocks

#: Bounds of the labelled sample that the model is fitted on: whole documents, and the lines of all of them together.
TRAIN_DOCS, TRAIN_LINES = 4000, 150_000
#: Lines of a chain while the field is fitted; scoring takes whole texts.
CHAIN = 128
CUTOFF = 0.3
FOLDS = 5

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "symbol": b"#*$%&<>@^~_=+\\{}[]", "pipe": b"|", "shout": b"!", "end": b".?", "pause": b",;:"}
_CLASS = np.zeros(256, np.uint8)
for _n, _chars in enumerate(_KINDS.values(), 1):
    _CLASS[list(_chars)] = _n
_CLASS[0xC0:] = len(_KINDS) + 1  # the first byte of a character beyond ASCII
_CLASS[ord("\n")] = 15


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its bytes, lines of each text); neighbours' features are those of the same text."""
    lines_of = np.array([t.count("\n") + 1 for t in texts], np.int64)
    buf = np.frombuffer("\n".join(texts).encode() + b"\n", np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size, n = ends - starts, len(ends)
    line = np.repeat(np.arange(n), size + 1)
    kinds = _CLASS[buf]
    counts = np.bincount(line * 16 + kinds, minlength=16 * n).reshape(n, 16).astype(np.float64)
    upper, lower, digit, space, symbol, pipe, shout, end, pause, wide = (counts[:, k] for k in range(1, 11))

    gap = (kinds == 4) | (kinds == 15)
    first = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    words = np.bincount(line[first], minlength=n).astype(np.float64)
    adjacent, kinds_of_word = np.zeros(n), np.zeros(n)
    if len(first):
        word = np.cumsum(np.bincount(first, minlength=len(buf))) - 1
        place = np.arange(len(buf)) - first[np.maximum(word, 0)]
        powers = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
        mixed = np.where(gap, np.uint64(0), (buf.astype(np.uint64) + np.uint64(1)) * powers[place % 64] * (place // 64 + 1).astype(np.uint64))
        digest = np.add.reduceat(mixed, first)
        at = line[first]
        np.add.at(adjacent, at[1:], (digest[1:] == digest[:-1]) & (at[1:] == at[:-1]))
        order = np.lexsort((digest, at))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (digest[order][1:] != digest[order][:-1]) | (at[order][1:] != at[order][:-1])
        kinds_of_word = np.bincount(at[order][fresh], minlength=n).astype(np.float64)

    some, many = np.maximum(words, 1), np.maximum(size, 1)
    letters = np.maximum(upper + lower, 1)
    last = buf[np.maximum(ends - 1, 0)]
    closed = (np.isin(last, list(b'.?!:"')) & (size > 0)).astype(np.float64)
    near = np.stack([upper / letters, symbol / some, pipe / some, shout / some, adjacent / some, 1 - kinds_of_word / some, closed, np.log1p(words)], axis=1)
    own = np.stack([digit / many, end / some, pause / some, (size - space) / some / 10, wide / many, (words == 0).astype(float), (words == 1).astype(float), (lower == 0) & (upper > 1), adjacent > 1, (symbol > words / 2) & (words > 0), (pipe > words / 4) & (words > 0), (shout > words / 2) & (words > 0), 2 * kinds_of_word < words, np.sqrt(size) / 50], axis=1).astype(np.float64)
    begin = np.concatenate(([0], np.cumsum(lines_of)[:-1]))
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:], after[:-1] = near[:-1], near[1:]
    before[begin], after[begin + lines_of - 1] = 0, 0
    edge = np.zeros((n, 2))
    edge[begin, 0], edge[begin + lines_of - 1, 1] = 1, 1
    return np.concatenate([near, own, before, after, edge], axis=1), size.astype(np.float64), lines_of


@dataclass(frozen=True)
class Model:
    """Weights of the field and of the map from a document's mean marginal to its score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the bias
    moves: np.ndarray  # log potentials of (line, next line), 0 bad, 1 good
    slope: float
    offset: float

    def odds(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def marginals(odds: np.ndarray, lines_of: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once: P(good) of each line, and the expected moves between lines."""
    step = np.exp(moves)
    good = _sigmoid(odds)
    emit = np.stack([1 - good, good], axis=1)
    begin = np.concatenate(([0], np.cumsum(lines_of)[:-1]))
    order = np.argsort(-lines_of, kind="stable")
    begin, sizes = begin[order], lines_of[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # texts with so many lines at least
    forward, backward, expected = np.empty_like(emit), np.ones_like(emit), np.zeros((2, 2))
    for t in range(longest):
        at = begin[: active[t]] + t
        value = emit[at] if not t else emit[at] * (forward[at - 1] @ step)
        forward[at] = value / value.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        ahead = emit[at + 1] * backward[at + 1]
        pair = forward[at][:, :, None] * step[None] * ahead[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        value = ahead @ step.T
        backward[at] = value / value.sum(axis=1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1), expected


def _document_logits(model: Model, features: np.ndarray, size: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    """Log odds of each text's mean marginal, weighted by the length of lines."""
    p, _ = marginals(model.odds(features), lines_of, model.moves)
    begin = np.concatenate(([0], np.cumsum(lines_of)[:-1]))
    total = np.add.reduceat(size, begin)
    weight = np.where(np.repeat(total > 0, lines_of), size, 1.0)
    mean = np.add.reduceat(p * weight, begin) / np.add.reduceat(weight, begin)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def score(model: Model, texts: list[str]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    return _sigmoid(model.slope * _document_logits(model, *line_features(texts)) + model.offset)


def _adam(gradient, parameters: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    m = v = np.zeros_like(parameters)
    for k in range(1, rounds + 1):
        g = gradient(parameters)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        parameters = parameters + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return parameters


def chains(lines_of: np.ndarray, longest: int = CHAIN) -> np.ndarray:
    """Lengths of the chains that texts of so many lines are learnt in: whole, or in runs of ``longest`` lines."""
    runs = -(-lines_of // longest)
    sizes = np.full(int(runs.sum()), longest, np.int64)
    sizes[np.cumsum(runs) - 1] = lines_of - (runs - 1) * longest
    return sizes


def fit(features: np.ndarray, size: np.ndarray, lines_of: np.ndarray, quality: np.ndarray) -> Model:
    """Fit the field on documents' labels.

    Lines have no labels of their own. All lines of good documents are good; a
    first model tells which lines of bad documents are bad (those it finds
    worse than even, and the worst one), and the field is fitted on these. All
    lines count; a text of more than ``CHAIN`` lines is learnt in runs of so
    many, which lose the moves between runs and nothing else.
    """
    if not len(quality) or quality.min() == quality.max():
        width = features.shape[1]
        rate = (quality.sum() + 1) / (len(quality) + 2)
        return Model(np.zeros(width), np.ones(width), np.zeros(width + 1), np.zeros((2, 2)), 0.0, float(np.log(rate / (1 - rate))))
    doc = np.repeat(np.arange(len(lines_of)), lines_of)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = np.concatenate([(features - mean) / scale, np.ones((len(features), 1))], axis=1)
    y = quality[doc].astype(np.float64)
    share = np.where(y > 0, 0.5 / y.mean(), 0.5 / max(1 - y.mean(), 1e-9))
    n = len(y)

    first = _adam(lambda w: x.T @ (share * (y - _sigmoid(x @ w))) / n - 0.001 * w, np.zeros(x.shape[1]), 200, 0.05)
    p = _sigmoid(x @ first)
    begin = np.concatenate(([0], np.cumsum(lines_of)[:-1]))
    worst = np.minimum.reduceat(p, begin)[doc]
    label = np.where(y > 0, 1, np.where((p < 0.5) | (p <= worst), 0, 1)).astype(np.int64)

    parts = chains(lines_of)
    part = np.repeat(np.arange(len(parts)), parts)
    inside = np.flatnonzero(part[1:] == part[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inside], label[inside + 1]), 1)

    def gradient(w: np.ndarray) -> np.ndarray:
        q, expected = marginals(x @ w[:-4], parts, w[-4:].reshape(2, 2))
        return np.concatenate([x.T @ (label - q), (seen - expected).ravel()]) / n - 0.001 * w

    w = _adam(gradient, np.concatenate([first, np.zeros(4)]), 150, 0.05)
    plain = Model(mean, scale, w[:-4], w[-4:].reshape(2, 2), 1.0, 0.0)
    logits = _document_logits(plain, features, size, lines_of)
    a = np.stack([logits, np.ones_like(logits)], axis=1)
    target = np.where(quality > 0, 1 - 1e-3, 1e-3)
    b = _adam(lambda b: a.T @ (target - _sigmoid(a @ b)) / len(a) - 1e-4 * b, np.array([1.0, 0.0]), 400, 0.05)
    return Model(mean, scale, w[:-4], w[-4:].reshape(2, 2), float(max(b[0], 1e-3)), float(b[1]))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = TRAIN_DOCS, max_lines: int = TRAIN_LINES) -> Model:
    """A model fitted on at most ``max_docs`` labelled documents that are not held out.

    The documents are those whose ids hash lowest. Each is used whole: they
    are taken in that order while their lines fit into ``max_lines``, and one
    that doesn't fit any more is passed over. These bounds hold for what
    reaches the driver, as repeated rows are merged before. Rows with a null
    id or label don't count; a document with several labels takes the lowest,
    and several texts of one id are documents of their own.
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    one = usable.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__quality"))
    ids = one.orderBy(F.xxhash64("__id"), "__id").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    texts = texts.join(F.broadcast(ids), "__id").withColumn("__digest", F.md5("__text"))  # max_docs ids at most
    lines = F.length("__text") - F.length(F.replace("__text", F.lit("\n"), F.lit(""))) + 1
    listed = texts.select("__id", "__digest", lines.alias("__lines")).distinct().orderBy(F.xxhash64("__id"), "__id", "__digest").limit(max_docs)
    chosen, used = [], 0
    for row in listed.collect():  # max_docs rows of three values
        if used + row["__lines"] <= max_lines:
            chosen.append(row)
            used += row["__lines"]
    wanted = docs.sparkSession.createDataFrame(chosen, listed.schema).drop("__lines")
    picked = texts.join(F.broadcast(wanted), ["__id", "__digest"]).dropDuplicates(["__id", "__digest"]).select("__quality", "__text", F.concat_ws("|", F.col("__id").cast("string"), "__digest").alias("__key"))

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            rows = []
            for quality, text, key in zip(*(c.to_pylist() for c in block.columns)):
                features, size, _ = line_features([text])
                rows.append((key, quality, features.astype("<f4").tobytes(), size.astype("<f4").tobytes()))
            yield pa.RecordBatch.from_pydict(dict(zip(("key", "quality", "features", "size"), map(list, zip(*rows)))), schema=pa.schema([("key", pa.string()), ("quality", pa.int32()), ("features", pa.binary()), ("size", pa.binary())]))

    rows = sorted(picked.mapInArrow(featured, "key string, quality int, features binary, size binary").collect())
    sizes = [np.frombuffer(r[3], "<f4").astype(np.float64) for r in rows]
    width = line_features([""])[0].shape[1]
    features = np.concatenate([np.frombuffer(r[2], "<f4").reshape(-1, width) for r in rows]).astype(np.float64) if rows else np.zeros((0, width))
    return fit(features, np.concatenate(sizes) if rows else np.zeros(0), np.array([len(s) for s in sizes], np.int64), np.array([r[1] for r in rows], np.int64))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The quality of every whole text: (id, held_out, score, predicted), one row per input row.

    The field labels every line good or bad; the marginals of a text's lines,
    weighted by their lengths, give its score (0 to 1, calibrated). Null and
    empty texts are scored as one empty line. Only the text is an input of the
    score. Null ids (not held out) and repeated rows stay; other columns are
    not read; there is no shuffle.
    """

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 2_000_000):
            texts = [t or "" for t in block.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(score(model, texts), pa.float64())], names=["__id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    out = picked.mapInArrow(scored, f"__id {kind}, score double").withColumnRenamed("__id", id_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
