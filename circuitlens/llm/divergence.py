"""Divergence of sources: how the term shares of each source differ from those of the others of its language.

Terms travel as 64-bit digests with their counts; texts don't, but for one table
that has the smallest and the largest term of every digest. Where the two differ, a digest
stands for several terms, and its rows are keyed by their terms as well. The
texts are joined back to the rows that are put out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from circuitlens.llm.common import text_blocks
from circuitlens.sources import shared

#: Ranks of terms; documents that hold a kept term; units of a whole share.
TOP_TERMS, MIN_DOCS, UNITS = 200, 3, 1_000_000_000
#: Bytes of text that a task counts at once; cells of its tables of terms by sources and of sources by sources; rows that may be broadcast.
BLOCK_BYTES, TERM_CELLS, SUM_CELLS, BROADCAST_ROWS = 8_000_000, 1_000_000, 4_000_000, 100_000
#: Letters in small form, all of the bytes from 128 on as they are, any other byte a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _words(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of the texts, numbered by a dictionary, and the text of each."""
    ends = np.cumsum([0, *map(len, texts)], dtype=np.int32)
    plain = b"".join(texts).translate(LETTERS)
    lists = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(plain)))
    words, parents = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.not_equal(words, "")
    return words.filter(full).dictionary_encode(), parents[full.to_numpy(zero_copy_only=False)]


def _pieces(text: bytes, limit: int) -> Iterator[bytes]:
    """A text in pieces of about ``limit`` bytes; no term is cut."""
    at, text = 0, text.translate(LETTERS) if len(text) > limit else text
    while len(text) - at > limit:
        end = text.find(b" ", at + limit)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def _blocks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[list[bytes], list, list, int]]:
    """Texts with their languages and sources, about ``limit`` bytes at once, and the number of the piece where a text is longer, else -1."""
    for block in text_blocks(batches, limit, column=0):
        texts = [v.as_buffer().to_pybytes() for v in block.column(0).cast(pa.large_binary())]
        languages, sources = block.column(1).to_pylist(), block.column(2).to_pylist()
        if len(texts) > 1 or len(texts[0]) <= limit:
            yield texts, languages, sources, -1
        else:
            for k, piece in enumerate(_pieces(texts[0], limit)):
                yield [piece], languages, sources, k


def _digests(terms: pa.Array, bits: int) -> np.ndarray:
    found = np.fromiter((xxhash.xxh64_intdigest(t.as_buffer()) for t in terms), np.uint64, len(terms))
    return (found & np.uint64((1 << bits) - 1)).view(np.int64)


def _dictionary(limit: int, bits: int):
    def dictionary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, _, _, _ in _blocks(batches, limit):
            terms = _words(texts)[0].dictionary
            yield pa.RecordBatch.from_arrays([pa.array(_digests(terms, bits)), terms], names=["digest", "term"])

    return dictionary


def _counts(limit: int, bits: int, terms_too: bool):
    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for texts, languages, sources, piece in _blocks(batches, limit):
            words, parents = _words(texts)
            terms, codes = words.dictionary, words.indices.to_numpy()
            groups: dict[tuple[str, str], int] = {}
            of = np.array([groups.setdefault(g, len(groups)) for g in zip(languages, sources)])
            width = max(1, len(terms))
            in_text, n = np.unique(parents.astype(np.int64) * width + codes, return_counts=True)
            keys, at = np.unique(of[in_text // width] * width + in_text % width, return_inverse=True)
            total, docs = np.bincount(at, n, len(keys)).astype(np.int64), np.bincount(at, minlength=len(keys)).astype(np.int64)
            group, code = keys // width, keys % width
            if piece >= 0:  # a term that an earlier piece of the text holds is not in another document
                seen = seen if piece else set()
                held = terms.take(pa.array(code)).to_pylist()
                docs[[k for k, t in enumerate(held) if t in seen]] = 0
                seen.update(held)
            arrays = [pa.array([name[i] for name in groups], pa.string()).take(pa.array(group)) for i in (0, 1)]
            arrays += [pa.array(_digests(terms, bits)[code]), pa.array(total), pa.array(docs)]
            if terms_too:
                arrays.append(terms.take(pa.array(code)))
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "digest", "n", "docs", "term"][: len(arrays)])

    return counts


def _share(count: Column, total: Column) -> Column:
    """1 + floor(UNITS * count / total) for count <= total, three digits at a time, so that no product leaves 64 bits."""
    out, rest = F.lit(1).cast("bigint"), count
    for unit in (1_000_000, 1_000, 1):
        rest = rest * 1000
        out, rest = out + F.call_function("div", rest, total) * unit, rest % total
    return out


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    out, rest = np.ones_like(count), count
    for unit in (1_000_000, 1_000, 1):
        digit, rest = np.divmod(rest * 1000, total)
        out = out + digit * unit
    return out


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the distances of all pairs of sources over the terms of a task."""
    sums: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, table in sums.items():
            i, j = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(table[i, j])], names=["lang", "i", "j", "value"])
        sums.clear()

    for batch in batches:
        languages = batch.column("lang").dictionary_encode()
        for k, lang in enumerate(languages.dictionary.to_pylist()):
            rows = batch.take(pa.array(np.flatnonzero(languages.indices.to_numpy() == k)))
            sizes, kept = np.array(rows.column("sizes")[0].as_py(), np.int64), rows.column("kept")[0].as_py()
            step = max(1, TERM_CELLS // len(sizes))
            if sum(t.size for t in sums.values()) + (lang not in sums) * len(sizes) ** 2 > SUM_CELLS:
                yield from out()
            table = sums.setdefault(lang, np.zeros((len(sizes), len(sizes)), np.int64))
            for at in range(0, rows.num_rows, step):
                some = rows.slice(at, step)
                lists = some.column("counts")
                row, cell = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
                count = np.zeros((some.num_rows, len(sizes)), np.int64)
                count[row, cell.field("at").to_numpy()] = cell.field("n").to_numpy()
                p = _shares(count + 1, sizes[None, :] + kept)
                for i in range(len(sizes)):
                    apart = p[:, i : i + 1] - p
                    table[i] += (apart * apart // p).sum(axis=0)
    yield from out()


def divergence(docs: DataFrame, top: int = TOP_TERMS, min_docs: int = MIN_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", bits: int = 64, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Distances between the sources of a language, and the terms that set each source apart.

    Returns (lang, source, part, item, value, rank). A term is a run of letters
    and of characters beyond ASCII, with A-Z in small form; a language keeps
    those in at least ``min_docs`` of its documents (a row is a document,
    repeated rows count as often as they come). The share of a term is p = 1 +
    floor(10^9 * (count + 1) / (N + V)), V being the kept terms and N
    their occurrences in the group. Part ``pair``: each other source of the
    language, by floor((p - q)^2 / q) summed over the kept terms. Part ``term``:
    the ``top`` terms that the source has with a greater share than the
    language, by floor((p - q)^2 / q) against the language's share. Ranks go by value, largest first,
    then by the item's bytes. All arithmetic is on integers.

    Null texts, languages and sources are ''. A group without terms has pairs;
    they are 0 in a language that keeps no term. A language of one source has
    no pairs. An empty table gives an empty one; other columns are not
    read.

    Counts are summed in each task before the shuffle, so a frequent term or a
    hot source is a few rows. A text of any length is read in pieces. A kept term is
    one row with its count for each source that has it: at most as many as a language has sources,
    whose square is the size of the result. Pairs are summed in the tasks, and
    never made as rows per term. ``bits`` narrows the digests, for tests.
    """
    spark = docs.sparkSession
    folder = shared.scratch(spark, "divergence")

    def table(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))]
    docs = docs.select(*text)

    groups = table(docs.select("lang", "source").distinct().withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "groups")
    known = table(docs.mapInArrow(_dictionary(block_bytes, bits), "digest bigint, term string").groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "terms")
    shared_by = known.where("low <> high").select("digest", F.lit(True).alias("clash"))
    clashes = shared_by.limit(1).count() > 0
    schema = "lang string, source string, digest bigint, n bigint, docs bigint" + ", term string" * clashes
    rows = docs.mapInArrow(_counts(block_bytes, bits, clashes), schema)
    if clashes:
        rows = rows.join(small(shared_by), "digest", "left").withColumn("extra", F.when(F.col("clash"), F.col("term")))
    else:
        rows = rows.withColumn("extra", F.lit(None).cast("string"))
    counts = rows.groupBy("lang", "source", "digest", "extra").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    placed = counts.join(small(groups), ["lang", "source"])
    terms = placed.groupBy("lang", "digest", "extra").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"), F.collect_list(F.struct("at", "n")).alias("counts"))
    terms = table(terms.where(F.col("docs") >= min_docs).drop("docs"), "kept")

    by_group = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.at").alias("at")).agg(F.sum("c.n").alias("size"))
    sized = table(groups.join(by_group, ["lang", "at"], "left").withColumn("size", F.coalesce("size", F.lit(0).cast("bigint"))), "sizes")
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_size"))
    languages = sized.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "size"))), lambda x: x["size"]).alias("sizes")).join(kept, "lang")
    languages = table(languages, "languages")

    sums = terms.select("lang", "counts").join(small(languages), "lang").select("lang", "sizes", "kept", "counts")
    sums = sums.mapInArrow(_pairs, "lang string, i int, j int, value bigint").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    left, right = groups.select("lang", "source", F.col("at").alias("i")), groups.select("lang", F.col("source").alias("item"), F.col("at").alias("j"))
    pairs = left.join(right, "lang").where("i <> j").join(sums, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))

    own = terms.select("lang", "digest", "extra", "all", F.explode("counts").alias("c")).select("lang", "digest", "extra", "all", "c.at", "c.n")
    own = own.join(small(sized.join(kept, "lang")), ["lang", "at"])
    own = own.withColumn("p", _share(F.col("n") + 1, F.col("size") + F.col("kept"))).withColumn("q", _share(F.col("all") + 1, F.col("lang_size") + F.col("kept")))
    own = own.where("p > q").select("lang", "source", "digest", "extra", F.expr("(p - q) * (p - q) div q").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = own.groupBy("lang", "source", "value").agg(F.count("*").alias("held")).withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= top)
    above = F.sum("held").over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("held")
    least = values.withColumn("above", above).where(F.col("above") < top).groupBy("lang", "source").agg(F.min("value").alias("least"))
    best = own.join(small(least), ["lang", "source"]).where(F.col("value") >= F.col("least")).join(known.where("low = high").select("digest", "low"), "digest", "left")
    best = best.select("lang", "source", F.lit("term").alias("part"), F.coalesce("extra", "low").alias("item"), "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    first = best.withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).union(first)


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT doc, lang, source, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM d
), k AS (
    SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
), g AS (
    SELECT DISTINCT lang, source FROM d
), c AS (
    SELECT g.lang, g.source, k.term, any_value(k.total) AS total, count(w.doc) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term GROUP BY ALL
), s AS (
    SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source))::HUGEINT AS p,
        1 + 1000000000::HUGEINT * (total + 1) // (sum(total) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source))::HUGEINT AS q FROM c
), f AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((
        SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM s x JOIN s y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term WHERE x.lang = a.lang AND x.source = a.source), 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM s WHERE n > 0 AND p > q
), r AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM f
)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
