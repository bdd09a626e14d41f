"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors are scaled to length one and rotated by a fixed random Hadamard
rotation, which spreads every difference evenly, then split into blocks of a
few dimensions. A cosine of t leaves a squared distance of 2 - 2t; of m equal
blocks at least one has no more than its m-th part of it. The vectors of a group
are dealt into tiles, and each pair of tiles is range-joined block by block under
that budget: windows along the block's first coordinate, then the distance in
the block. The candidates of all blocks are verified exactly, in double precision;
a pair is taken up in the first block in which it is a candidate.

Tiles are not cut along coordinates: the range of a block (0.13 for a cosine of
0.93 and 8 of 64 dimensions) is as wide as its coordinates spread (0.125), so a
vector would be replicated to about all cells of every block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from circuitlens.llm.common import checkpointed, sorted_groups
from circuitlens.llm.components import components

#: Dimensions of a block; vectors of a tile; pairs that are verified at once.
BLOCK_DIMS, TILE, PAIRS = 8, 4096, 65_536
SEED = 20_240_501
#: Room for the rounding of rotated coordinates to 32 bits.
SLACK = 1e-5
BROADCAST_ROWS = 100_000


def rotate(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, padded to a power of two and rotated; each row's result depends on that row alone."""
    width = 1 << max(0, int(vectors.shape[1] - 1).bit_length())
    x = np.zeros((len(vectors), width))
    x[:, : vectors.shape[1]] = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    signs = np.random.RandomState(SEED).choice([-1.0, 1.0], (2, width))
    for sign in signs:
        x = x * sign
        step = 1
        while step < width:
            y = x.reshape(len(x), -1, 2, step)
            x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), width)
            step *= 2
        x = x / np.sqrt(width)
    return x.astype(np.float32).astype(np.float64)


def _blocks(width: int) -> list[slice]:
    return [slice(a, min(a + BLOCK_DIMS, width)) for a in range(0, width, BLOCK_DIMS)]


def _budget(block: slice, width: int, threshold: float) -> float:
    return ((2 - 2 * threshold) * (1 + SLACK) + SLACK) * (block.stop - block.start) / width


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for d in range(a.shape[-1]):  # one dimension after the other: the same sum for a pair wherever it is taken
        total += (a[..., d] - b[..., d]) ** 2
    return total


def _union(roots: dict[int, int], x: int) -> int:
    while (up := roots.get(x, x)) != x:
        roots[x] = roots.get(up, up)
        x = up
    return x


def _compare(threshold: float, width: str):
    keys = ["group", "dim", "i", "j"]

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, keys):
            vec, copies = table.column("vec").to_numpy(), table.column("copies").to_numpy()
            i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
            mine = table.column("mine").to_numpy()
            left, right = (np.flatnonzero(mine == t) for t in (i, j))
            if not len(left) or not len(right) or len(vec) < 2:
                continue
            raw = np.stack([np.frombuffer(v.as_buffer(), width) for v in table.column("packed").combine_chunks()]).astype(np.float64)
            norms = np.sqrt((raw * raw).sum(axis=1))
            x = rotate(raw)
            blocks = _blocks(x.shape[1])
            counts, roots, links = np.zeros(len(vec), np.int64), {}, []
            for k, block in enumerate(blocks):
                part, budget = np.ascontiguousarray(x[:, block]), _budget(block, x.shape[1], threshold)
                first, squares, reach = part[:, 0], (part * part).sum(axis=1), np.sqrt(budget) + 1e-9
                some_left, some_right = left[np.argsort(first[left], kind="stable")], right[np.argsort(first[right], kind="stable")]
                for start in range(0, len(left), 256):
                    some = some_left[start : start + 256]
                    low, high = np.searchsorted(first[some_right], [first[some[0]] - reach, first[some[-1]] + reach])
                    if i == j:
                        low = start  # a pair within a tile is met once, from its first vector in this order
                    window = some_right[low:high]
                    roughly = squares[some][:, None] + squares[window][None, :] - 2 * (part[some] @ part[window].T)
                    pairs = np.argwhere(roughly <= budget + 1e-9)
                    if i == j:
                        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
                    for at in range(0, len(pairs), PAIRS):
                        a, b = some[pairs[at : at + PAIRS, 0]], window[pairs[at : at + PAIRS, 1]]
                        near = _far(part[a], part[b]) <= budget
                        a, b = a[near], b[near]
                        for earlier in blocks[:k]:
                            fresh = _far(x[a][:, earlier], x[b][:, earlier]) > _budget(earlier, x.shape[1], threshold)
                            a, b = a[fresh], b[fresh]
                        linked = (raw[a] * raw[b]).sum(axis=1) / (norms[a] * norms[b]) >= threshold
                        a, b = a[linked], b[linked]
                        np.add.at(counts, a, copies[b])
                        np.add.at(counts, b, copies[a])
                        for p, q in zip(a.tolist(), b.tolist()):
                            m, n = _union(roots, p), _union(roots, q)
                            if m != n:
                                roots[max(m, n)] = min(m, n)
                                links.append((p, q))
            some = np.flatnonzero(counts)
            if len(some):
                pairs = np.array(links, np.int64).reshape(-1, 2)
                a = np.concatenate([vec[some], vec[pairs[:, 0]]])
                b = pa.array([None] * len(some) + vec[pairs[:, 1]].tolist(), pa.int64())
                n = np.concatenate([counts[some], np.zeros(len(pairs), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n)], names=["a", "b", "n"])

    return compare


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label", tile: int = TILE) -> DataFrame:
    """Direct links and groups of near-equal vectors: (id, n_links, component_id, kept), one row per input row.

    Vectors are compared if their groups and lengths are equal, and linked if
    their cosine in double precision is at least ``threshold``. Copies are
    compared once and counted; links of a dense cluster are counted where they
    are found, and only a spanning forest of them is handed on.

    A null group links with nothing, nor does a vector that is null, empty,
    zero, or holds a null or non-finite component. Repeated rows are copies of
    each other. ``component_id`` is the smallest id that can be reached, the
    row's own where it links with nothing; kept is id = component_id. Rows
    with a null id take part as copies of others, else they link with nothing.
    Other columns are not read.

    The vectors of a group and length are dealt into tiles of about ``tile``, and
    each pair of tiles is compared in a group of its own, to which a vector goes
    once for all blocks; so the memory of a task is bounded. A group within one
    tile is sent once. The pairs to look at grow with the square of a group's
    distinct vectors: no exact method prunes what is spread evenly.
    """
    width = "<f4" if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else "<f8"  # as exact as the column
    v = F.col("vec")
    usable = F.col("label").isNotNull() & v.isNotNull() & F.coalesce(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False)) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(group_col).cast("string").alias("label"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    distinct = rows.where("usable").groupBy("label", "vec").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    distinct = checkpointed(distinct)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.asarray(one.values, width).tobytes() for one in batch.column("vec")]
            dims = [len(p) // int(width[2:]) for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(dims, pa.int32()), batch.column("first"), batch.column("copies"), pa.array(packed, pa.binary())], names=["group", "dim", "vec", "copies", "packed"])

    packed = distinct.where("first is not null").mapInArrow(pack, "group string, dim int, vec bigint, copies bigint, packed binary")
    packed = checkpointed(packed)
    keys = ["group", "dim"]
    large = packed.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > tile)
    large = checkpointed(large.select(*keys, F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    dealt = packed.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, keys, "left")
    tiles = F.coalesce("tiles", F.lit(1))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("vec"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    tiled = dealt.select(*keys, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "vec", "copies", "packed")
    grouped = tiled.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")
    found = checkpointed(grouped.mapInArrow(_compare(threshold, width), "a bigint, b bigint, n bigint"))

    groups = components(found.where("b is not null"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    linked = counts.join(groups, "node", "left")
    known = distinct.join(linked, distinct["first"] == linked["node"], "left").select("label", "vec", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component"))
    known = checkpointed(known)  # so that the next join shuffles both sides and can split a vector of many copies
    good = rows.where("usable").join(known, ["label", "vec"]).select("id", "n_links", F.coalesce("component", "id").alias("component_id"))
    lone = rows.where("not usable").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return good.union(lone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
    SELECT DISTINCT a AS node, a AS reached FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a
), c AS (
    SELECT node, min(reached) AS component FROM r GROUP BY node
), n AS (
    SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""
