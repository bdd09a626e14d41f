"""Document quality rules and cross-document line frequency."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from circuitlens.llm.common import checkpointed, text_blocks

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SPACES = " \t\n\r\x0b\x0c"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0000000000"
_PLAIN = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Frequent lines (host, hash, first holder) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a window of three that the text holds twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    _, at, counts = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[at] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(again) + k] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """The five base figures of a text, and of each distinct normalised line its hash and words."""
    text = text or ""
    data = text.encode()
    words = data.split()
    seen, duplicates, lines = set(), 0, Counter()
    for line, plain in zip(data.split(b"\n"), data.translate(_PLAIN).split(b"\n")):
        if parts := plain.split():
            duplicates += line in seen
            seen.add(line)
            lines[xxhash.xxh64_intdigest(b" ".join(parts), 42)] += len(parts)
    hashes = [h - (1 << 64) if h >> 63 else h for h in lines]
    letters = len(text) - sum(map(text.count, SPACES))
    return len(words), letters, sum(map(text.count, SYMBOLS)), duplicates, repeat_words(words), hashes, list(lines.values())


def line_key(line: Column) -> Column:
    """The hash of a normalised line (A-Z lower-cased, digits as 0, one space between words), as ``measure`` has it."""
    return F.xxhash64(F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), r"[ \t\n\r\x0b\f]+", " ")))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = 20,
    max_share: float = 0.01,
    max_docs: int = 200,
    min_left: float = 0.3,
) -> DataFrame:
    """Base rules and the verdict of cross-document line frequency, one row per input row.

    Base: ``base_failed`` for fewer than 50 words or more than half of the
    words in repeated windows of three. Line frequency: normalised lines are
    hashed and the distinct documents of each host that hold them counted,
    exact copies as one. A line is above the limits if more than ``min_docs``
    documents hold it, and these are more than ``max_share`` of the host's or
    more than ``max_docs`` (so that the limit stays fixed on a large host); it
    is removed from all of them but the one with the smallest id. A document
    left with less than ``min_left`` of its words is depleted.

    Returns ``id_col``, the five figures, base_failed, n_removed_words, kept
    (neither base_failed nor depleted), removed (hashes of its removed lines,
    see ``line_key``), digest (of the text) and host. Null texts count as empty and
    fail the base rules; null hosts are one host; null ids stay and never hold
    a line first; repeated rows are copies. Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            columns = list(zip(*map(measure, block.column(1).to_pylist())))
            found = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.list_(pa.int64())) for c in columns[5:]]
            yield pa.RecordBatch.from_arrays([block.column(0), *found], names=["__key", *METRICS, "hashes", "words"])

    key = F.struct(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("\0")).alias("host"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))
    picked = docs.select(key.alias("__key"), F.col(text_col).alias("__text"))
    figures = ", ".join(f"{m} bigint" for m in METRICS)
    rows = picked.mapInArrow(measured, f"__key struct<id:{id_type},host:string,digest:string>, {figures}, hashes array<bigint>, words array<bigint>")
    rows = checkpointed(rows.select("__key.*", *METRICS, "hashes", "words", F.monotonically_increasing_id().alias("row")))

    texts = rows.groupBy("host", "digest").agg(F.min("id").alias("first"), F.any_value("hashes").alias("hashes"))
    hosts = texts.groupBy("host").agg(F.count("*").alias("docs"))
    held = texts.select("host", "first", F.explode("hashes").alias("hash"))
    counts = held.groupBy("host", "hash").agg(F.count("*").alias("n"), F.min("first").alias("first")).where(F.col("n") > min_docs)
    frequent = checkpointed(counts.join(hosts, "host").where((F.col("n") > max_share * F.col("docs")) | (F.col("n") > max_docs)).select("host", "hash", "first"))
    lines = rows.select("row", "id", "host", F.explode(F.arrays_zip("hashes", "words")).alias("line"))
    lines = lines.select("row", "id", "host", F.col("line.hashes").alias("hash"), F.col("line.words").alias("words"))
    hit = lines.join(F.broadcast(frequent) if frequent.count() <= BROADCAST_ROWS else frequent, ["host", "hash"])
    hit = hit.where(~F.coalesce(F.col("id") == F.col("first"), F.lit(False)))
    lost = hit.groupBy("row").agg(F.sum("words").alias("n_removed_words"), F.sort_array(F.collect_list("hash")).alias("removed"))
    judged = rows.drop("hashes", "words").join(lost, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("bigint")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("n_removed_words")) < min_left * F.col("n_words")
    return judged.select(
        F.col("id").alias(id_col), *METRICS, failed.alias("base_failed"), "n_removed_words", (~failed & ~depleted).alias("kept"),
        F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"), "digest", "host",
    )


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT row_id, doc_id, host, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, string_split(t, chr(10)) AS raw FROM d
), n AS (
    SELECT row_id, doc_id, host, t, words, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(raw, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM w
), g AS (
    SELECT row_id, i, unnest(tri) AS tri, unnest(range(len(tri))) AS pos
    FROM (SELECT row_id, 0 AS i, list_transform(range(1, greatest(len(words) - 1, 1)), lambda k: list_slice(words, k, k + 2)) AS tri FROM n)
), again AS (
    SELECT row_id, pos FROM (SELECT row_id, pos, count(*) OVER (PARTITION BY row_id, tri) AS c FROM g) WHERE c > 1
), covered AS (
    SELECT row_id, count(DISTINCT pos + k) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row_id
), l AS (
    SELECT row_id, doc_id, host, t, trim(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
    FROM (SELECT row_id, doc_id, host, t, unnest(lines) AS u FROM n)
), hosts AS (
    SELECT host, count(DISTINCT t) AS docs FROM n GROUP BY host
), counts AS (
    SELECT host, line, count(DISTINCT t) AS c, min(doc_id) AS first FROM l GROUP BY host, line
), lost AS (
    SELECT l.row_id, sum(len(string_split(l.line, ' '))) AS gone
    FROM l JOIN counts c ON l.host = c.host AND l.line = c.line JOIN hosts h ON h.host = l.host
    WHERE c.c > 20 AND (c.c > 0.01 * h.docs OR c.c > 200) AND (l.doc_id IS NULL OR l.doc_id <> c.first) GROUP BY l.row_id
), j AS (
    SELECT n.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS n_removed_words
    FROM n LEFT JOIN covered USING (row_id) LEFT JOIN lost USING (row_id)
)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ((n_words - n_removed_words) < 0.3 * n_words)) AS kept
FROM j
"""


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits: float) -> DataFrame:
    """The documents that the rules keep, all columns whatever their names, without the lines above the limits.

    A verdict belongs to an id, host and text, so repeated rows share it; null
    ids and hosts meet their own verdicts; null texts fail the base rules.
    """
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("\0"))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), host.alias("host"))
    judged = quality_rules(own.select("id", "text", "host"), "id", "text", "host", **limits).where("kept")
    key = lambda text: F.md5(F.to_json(F.struct("id", "host", text.alias("digest")))).alias("key")
    judged = judged.select(key(F.col("digest")), "removed").dropDuplicates(["key"])
    joined = own.withColumn("key", key(F.md5(F.coalesce(F.col("text"), F.lit(""))))).join(judged, "key")
    lines = F.filter(F.split("text", "\n"), lambda line: ~F.array_contains(F.col("removed"), line_key(line)))
    cleaned = F.when(F.size("removed") > 0, F.array_join(lines, "\n")).otherwise(F.col("text"))
    return joined.select(*[cleaned.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
