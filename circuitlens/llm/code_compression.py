"""Vectors as short codes: each part of a vector becomes the number of its nearest codebook entry.

Codebooks are trained by Lloyd rounds with a dual tree. Vectors are packed in blocks, and
each block has one tree for each part: its order of the vectors, halved again and again at the median of the
widest dimension. The entries have a tree as well. Both trees are walked down together, a level at
a time: the boxes of two nodes bound the distances between them, and entries that can't be the nearest of
any vector of a node are dropped. A node that is left with one entry is assigned as a whole, by its count and sum.
What is undecided in the leaves is compared by integers.

All coordinates, bounds and sums are integers, so pruning is exact and ties stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from circuitlens.sources import shared

#: Parts of a vector, entries of a codebook, rounds; integer steps of a unit.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block, vectors of a leaf (at most); labels that may be broadcast.
BLOCK, LEAF, BROADCAST_ROWS = 4096, 32, 100_000


def _bounds(count: int) -> list[np.ndarray]:
    """The bounds of the nodes of a tree for each level, from the root to the leaves; a node is halved in its order."""
    levels = [np.array([0, count])]
    while np.diff(levels[-1]).max() > LEAF:
        starts, sizes = levels[-1][:-1], np.diff(levels[-1])
        levels.append(np.append(np.stack([starts, starts + sizes // 2], axis=1).ravel(), count))
    return levels


def _tree(points: np.ndarray) -> np.ndarray:
    """The order of the points in their tree: those of a node are sorted along its widest dimension."""
    order = np.arange(len(points))
    for bounds in _bounds(len(points))[:-1]:
        held, starts = points[order], bounds[:-1]
        wide = (np.maximum.reduceat(held, starts) - np.minimum.reduceat(held, starts)).argmax(axis=1)
        node = np.repeat(np.arange(len(starts)), np.diff(bounds))
        order = order[np.lexsort((held[np.arange(len(held)), wide[node]], node))]
    return order


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each size, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Entries:
    """The distinct entries of one codebook as a tree of boxes; of equal entries the first stands for all."""

    def __init__(self, entries: np.ndarray) -> None:
        _, first = np.unique(entries, axis=0, return_index=True)
        index = np.sort(first)
        order, self.levels = np.arange(len(index)), [np.array([0, len(index)])]
        while np.diff(self.levels[-1]).max() > 1:
            starts, ends, cuts = self.levels[-1][:-1], self.levels[-1][1:], []
            for a, b in zip(starts.tolist(), ends.tolist()):
                some = entries[index[order[a:b]]]
                order[a:b] = order[a:b][np.argsort(some[:, np.ptp(some, axis=0).argmax()], kind="stable")]
                cuts += [a, (a + b) // 2] if b - a > 1 else [a]
            self.levels.append(np.array([*cuts, len(index)]))
        self.index = index[order]
        self.points = entries[self.index]
        self.boxes = [(np.minimum.reduceat(self.points, x[:-1]), np.maximum.reduceat(self.points, x[:-1])) for x in self.levels]


def assign(points: np.ndarray, bounds: list[np.ndarray], entries: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For points in the order of their tree: their entries, and the number, entry by entry, of those assigned by whole nodes and of all, and their sums.

    Returns (codes, whole, counts, sums), the last three by entry.
    """
    codes, d = np.full(len(points), -1, np.int64), points.shape[1]
    size = int(entries.index.max()) + 1
    whole, counts, sums = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros((size, d), np.int64)
    totals = np.concatenate([np.zeros((1, d), np.int64), np.cumsum(points, axis=0)])
    node, box = np.array([0]), np.array([0])  # pairs of a node of points and a node of entries that are still open, by node
    depth = max(len(bounds), len(entries.levels))
    for level in range(depth):
        at = bounds[min(level, len(bounds) - 1)]
        low, high = np.minimum.reduceat(points, at[:-1])[node], np.maximum.reduceat(points, at[:-1])[node]
        cells = entries.levels[min(level, len(entries.levels) - 1)]
        lower, upper = (x[box] for x in entries.boxes[min(level, len(entries.levels) - 1)])
        gap = np.maximum(0, np.maximum(lower - high, low - upper))
        reach = np.maximum(upper - low, high - lower)
        least, most = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        good = least <= np.repeat(np.minimum.reduceat(most, starts), np.diff(np.append(starts, len(node))))
        node, box = node[good], box[good]
        alone = np.bincount(node, minlength=len(at) - 1)[node] == 1
        single = alone & (np.diff(cells)[box] == 1)
        for n, e in zip(node[single].tolist(), entries.index[cells[box[single]]].tolist()):
            a, b = at[n], at[n + 1]
            codes[a:b] = e
            whole[e] += b - a
            counts[e] += b - a
            sums[e] += totals[b] - totals[a]
        node, box = node[~single], box[~single]
        if not len(node):
            return codes, whole, counts, sums
        if level + 1 < len(bounds):
            node = np.repeat(node * 2, 2) + np.tile([0, 1], len(node))
            box = np.repeat(box, 2)
        if level + 1 < len(entries.levels):
            finer = entries.levels[level + 1]
            first, last = np.searchsorted(finer, cells[box]), np.searchsorted(finer, cells[box + 1])
            box, node = np.repeat(first, last - first) + _ranges(last - first), np.repeat(node, last - first)
        order = np.argsort(node, kind="stable")
        node, box = node[order], box[order]
    at = bounds[-1]
    index = entries.index[box]
    order = np.lexsort((index, node))  # lower entries first
    node, index, position = node[order], index[order], box[order]
    starts = np.flatnonzero(np.diff(node, prepend=-1))
    tried, sizes = np.diff(np.append(starts, len(node))), np.diff(at)[node[starts]]
    point = np.repeat(at[node[starts]], sizes) + _ranges(sizes)
    per_point = np.repeat(tried, sizes)
    pair = np.repeat(np.repeat(starts, sizes), per_point) + _ranges(per_point)
    apart = points[np.repeat(point, per_point)] - entries.points[position[pair]]
    far, first = (apart * apart).sum(axis=1), np.cumsum(per_point) - per_point
    nearest = np.flatnonzero(far == np.repeat(np.minimum.reduceat(far, first), per_point))
    codes[point] = index[pair[nearest[np.searchsorted(nearest, first)]]]
    np.add.at(counts, codes[point], 1)
    np.add.at(sums, codes[point], points[point])
    return codes, whole, counts, sums


def _pack(width: int, parts: int):
    d = width // parts

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                points = np.floor(some.column("vec").flatten().to_numpy().reshape(-1, width) * SCALE).astype(np.int64)
                orders = np.stack([_tree(points[:, k * d : (k + 1) * d]) for k in range(parts)]).astype(np.uint16)
                one = pa.array([0, some.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(one, pa.array(some.column(name).to_pylist(), kind)) for name, kind in (("id", pa.int64()), ("label", pa.string()))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([points.astype(np.int32).tobytes()]), pa.array([orders.tobytes()])], names=["ids", "labels", "points", "orders"])

    return pack


def _unpacked(batch: pa.RecordBatch, k: int, width: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(batch.column("points")[k].as_py(), np.int32).reshape(-1, width).astype(np.int64)
    return points, np.frombuffer(batch.column("orders")[k].as_py(), np.uint16).reshape(parts, -1)


def _totals(books: np.ndarray, width: int):
    """Of each part and entry: the parts assigned to it, how many of them by whole nodes, and their sums by position; one row for all blocks of a task."""
    parts, entries, d = books.shape

    def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Entries(book) for book in books]
        found = np.zeros((parts, entries, d + 2), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                points, orders = _unpacked(batch, k, width, parts)
                bounds = _bounds(len(points))
                for part, tree in enumerate(trees):
                    _, whole, counts, sums = assign(points[orders[part].astype(np.int64), part * d : (part + 1) * d], bounds, tree)
                    found[part, : len(counts)] += np.concatenate([counts[:, None], whole[:, None], sums], axis=1)
        part, entry, position = (x.ravel().astype(np.int32) for x in np.indices(found.shape))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(position), pa.array(found.ravel())], names=["part", "entry", "position", "n"])

    return totals


def _coded(books: np.ndarray, width: int):
    parts, _, d = books.shape

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Entries(book) for book in books]
        for batch in batches:
            for k in range(batch.num_rows):
                points, orders = _unpacked(batch, k, width, parts)
                codes, error, bounds = np.empty((len(points), parts), np.uint8), np.zeros(len(points), np.int64), _bounds(len(points))
                for part, tree in enumerate(trees):
                    order = orders[part].astype(np.int64)
                    mine = points[:, part * d : (part + 1) * d]
                    codes[order, part] = assign(mine[order], bounds, tree)[0]
                    apart = mine - books[part][codes[:, part]]
                    error += (apart * apart).sum(axis=1)
                text = [row.tobytes().hex() for row in codes]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("labels")[k].values, pa.array(text, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return coded


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Codes of vectors: (id, code, error, label_error, codebooks_sha256), one row for each vector that is kept.

    A component x counts as floor(256 * x). Vectors are cut into ``parts``
    equal parts; each position's codebook starts as that part of the
    ``entries`` (256 at most) smallest ids and is moved ``rounds`` times to the
    floored means of the parts nearest to its entries (squared distance, ties
    to the lower entry); an unused entry stays. ``code`` has two hexadecimal
    digits a part, ``error`` is the squared distance, and ``label_error`` its sum
    over equal labels, nulls together (null beyond 64 bits).

    Dropped are rows whose vector is null, empty, or holds a null or
    non-finite component, or one so large that its error would not fit 64 bits (741,455
    and more for 64 dimensions). So are those of another length than the first kept
    vector's; if that is no multiple of ``parts``, an error says so. Repeated rows are vectors of their own, and of equal ids the
    lesser vector comes first; null ids come last. Fewer vectors than
    entries make as many entries. An empty table gives an empty one. Other columns are not read.

    The vectors are packed once, in blocks of at most 4096 with their trees; each round sends
    one sum for each entry from a task. Codebooks, of ``entries`` vectors' size, are all that comes to the driver.
    """
    spark = vectors.sparkSession
    v = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("label"))
    finite = F.coalesce(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    fits = F.forall(v, lambda e: F.abs(F.floor(e * F.lit(float(SCALE))).cast("double")) <= F.floor(F.sqrt(F.lit(2.0**61) / F.size(v))))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0)).where(finite).where(fits)
    seeds = rows.select("id", "vec", F.size("vec").alias("width")).orderBy(F.asc_nulls_last("id"), "vec")
    first = seeds.limit(1).collect()
    schema = "id bigint, label string, code string, error bigint"
    if not first:
        return spark.createDataFrame([], schema).withColumns({"label_error": F.lit(None).cast("bigint"), "codebooks_sha256": F.lit("")}).select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")
    width = first[0].width
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    alike = F.size("vec") == width
    start = np.floor(np.array([r.vec for r in seeds.where(alike).limit(entries).collect()]) * SCALE).astype(np.int64)
    books = start.reshape(len(start), parts, width // parts).transpose(1, 0, 2)

    folder = shared.scratch(spark, "codes")
    packed = rows.where(alike).mapInArrow(_pack(width, parts), "ids array<bigint>, labels array<string>, points binary, orders binary")
    packed.write.parquet(f"{folder}/blocks")
    blocks = spark.read.schema(packed.schema).parquet(f"{folder}/blocks")
    for _ in range(rounds):
        totals = blocks.mapInArrow(_totals(books, width), "part int, entry int, position int, n bigint").groupBy("part", "entry", "position").agg(F.sum("n").alias("n"))
        found = np.zeros((*books.shape[:2], books.shape[2] + 2), np.int64)
        for part, entry, position, n in totals.collect():
            found[part, entry, position] = n
        counts, sums = found[:, :, :1], found[:, :, 2:]
        books = np.where(counts > 0, sums // np.maximum(counts, 1), books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = blocks.mapInArrow(_coded(books, width), schema)
    coded.write.parquet(f"{folder}/coded")
    shared.delete(spark, f"{folder}/blocks")
    coded = spark.read.schema(coded.schema).parquet(f"{folder}/coded")
    labels = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    labels = F.broadcast(labels) if labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else labels
    out = coded.alias("a").join(labels.alias("b"), F.col("a.label").eqNullSafe(F.col("b.label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _rounds(rounds: int) -> str:
    """SQL of one assignment and update after the other."""
    out = []
    for k in range(rounds + 1):
        near = f"SELECT row, part, min(struct_pack(dist := dist, entry := entry)) AS best FROM (SELECT row, p.part, entry, list_sum(list_transform(list_zip(p.ints, b.ints), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM p JOIN b{k} b ON b.part = p.part) GROUP BY row, part"
        out.append(f"a{k} AS MATERIALIZED ({near})")
        if k < rounds:
            means = f"SELECT part, best.entry AS entry, pos, floor(sum(ints[pos])::DOUBLE / count(*))::BIGINT AS mean FROM (SELECT part, best, ints, unnest([1, 2, 3, 4]) AS pos FROM a{k} JOIN p USING (row, part)) GROUP BY ALL"
            out.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.ints, b.ints) AS ints FROM b{k} b LEFT JOIN (SELECT part, entry, list(mean ORDER BY pos) AS ints FROM ({means}) GROUP BY part, entry) m USING (part, entry))")
    return ", ".join(out)


ORACLE = f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS ints FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
    SELECT row, part, ints[part * 4 + 1 : part * 4 + 4] AS ints FROM v, (SELECT unnest(range(16)) AS part)
), b0 AS MATERIALIZED (
    SELECT part, row - 1 AS entry, ints FROM p WHERE row <= 64
), {_rounds(ROUNDS)}, c AS (
    SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.dist)::BIGINT AS error FROM a{ROUNDS} GROUP BY row
), h AS (
    SELECT sha256(string_agg(array_to_string(ints, ','), ',' ORDER BY part, entry)) AS digest FROM b{ROUNDS}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM v JOIN c USING (row), h
"""
