"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code. A 64-bit fingerprint is cut into
two halves of 32 bits; of two fingerprints with 3 or fewer differing bits, one
half differs in at most one. The anchors of a half are the words of a perfect
Hamming code on 31 bits next to one free bit: every half lies within the
covering radius of 1 of its home anchor. A fingerprint is replicated to every
anchor within covering radius plus threshold (1 + 1, at most 17 anchors), so
it meets each neighbour at that neighbour's home anchor. Fingerprints are
compared per anchor, over all 64 bits.

Near copies in the sense of a similarity of 0.8 of five-word shingles are
further apart, 10 bits of 64, than a covering code can carry. For these
(``near_copies``) a text gets many fingerprints, so that some half of them
lies at the same anchor with threshold 0, where a fingerprint is replicated to
the anchors within the covering radius alone; what meets there is compared
over 256 bits of five-word shingles. These bits only name candidates: links
hold where the five-word shingles of the two texts themselves are as similar.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate
from math import acos, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from circuitlens.llm.common import checkpointed, text_blocks
from circuitlens.llm.components import components

#: Shingle length and hash seed that the fingerprints need, and the threshold the code is built for.
SHINGLE_WORDS, SEED, THRESHOLD = 3, 42, 3
#: Fingerprints at one anchor that are compared in one tile; larger anchors are dealt out in pairs of tiles.
TILE = 2048
#: Near copies: fingerprints over three-word shingles that are searched, over five-word shingles that are compared,
#: and the similarity (Jaccard, of five-word shingles) from which two texts are near copies.
SEARCH_PRINTS, CHECK_PRINTS, CHECK_WORDS, SIMILARITY = 16, 4, 5, 0.8
#: Candidates: standard errors of the estimate below which pairs of a group are linked first, then next, then last.
ROOM = (-1.0, 0.5, 2.0)
#: Texts that are compared with one text in one task; more are dealt out.
STAR = 256
#: Large anchors (two numbers each) or candidates (a digest and two numbers) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bits, 64 a row, of the table that tells texts which may be candidates from others before they are shuffled (16 MB at most).
SLOTS = 1 << 26

_LANES = np.uint64(0x0101010101010101)


def _shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included; of the whole text if it has fewer words."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    starts = [0, *accumulate(len(t) + 1 for t in tokens)]
    whole, digest = memoryview(line), xxhash.xxh64_intdigest
    pieces = zip(starts, starts[words:]) if len(tokens) > words else [(0, len(line) + 1)]
    return np.array([digest(whole[a : b - 1], seed) for a, b in pieces], np.uint64)


def _majorities(hashes: np.ndarray, kinds: int = 1) -> np.ndarray:
    """For each of so many kinds of hashes (``_mixed``), the bits that are set in over half of them."""
    n, counts = len(hashes), np.zeros((kinds, 8, 8), np.int64)
    for at in range(0, n, 255 * 64):
        some = hashes[at : at + 255 * 64]
        runs = -(-len(some) // 255)  # a byte counts up to 255
        width = -(-len(some) // runs)
        padded = np.zeros((kinds, runs * width), np.uint64)
        for k in range(kinds):
            padded[k, : len(some)] = _mixed(some, k) if k else some
        padded = padded.reshape(kinds, runs, width)
        for bit in range(8):
            lanes = ((padded >> np.uint64(bit)) & _LANES).sum(axis=2, dtype=np.uint64)
            counts[:, :, bit] += lanes.astype("<u8").view(np.uint8).reshape(kinds, runs, 8).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=2, bitorder="little").reshape(kinds, 8).view("<u8")[:, 0]


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of one text: a bit is 1 if it is set in over half the hashes of its word shingles."""
    return int(_majorities(_shingle_hashes(text, words, seed))[0])


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same shingles, the k-th of them."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def many_prints(text: str | None, search: int = SEARCH_PRINTS, check: int = CHECK_PRINTS) -> bytes:
    """The fingerprints of one text: ``search`` of three-word shingles, then ``check`` of five-word shingles, 8 bytes each."""
    near, far = _shingle_hashes(text, SHINGLE_WORDS, SEED), _shingle_hashes(text, CHECK_WORDS, SEED)
    return _majorities(near, search).tobytes() + _majorities(far, check).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, bits BIGINT): the 64-bit fingerprint of every whole text, signed; no words give 0."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            bits = np.array([fingerprint(t) for t in block.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(bits)], names=["__id", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return picked.mapInArrow(hashed, f"__id {kind}, bits bigint").withColumnRenamed("__id", id_col)


def _syndromes(half: np.ndarray) -> np.ndarray:
    """Exclusive or of the positions 1 to 31 of the bits that are set: 0 for a code word, else the bit to flip."""
    found = np.zeros(len(half), np.uint64)
    for bit in range(31):
        found ^= np.where((half >> np.uint64(bit)) & np.uint64(1), np.uint64(bit + 1), np.uint64(0))
    return found


def _flips(half: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """``half`` with the bit at each position (1 to 31; 0 for none) turned over."""
    return half ^ np.where(positions > 0, np.uint64(1) << (np.maximum(positions, np.uint64(1)) - np.uint64(1)), np.uint64(0))


def anchors(half: np.ndarray, threshold: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The anchors within covering radius (1) plus ``threshold`` (0 or 1) of each 32-bit half: (index of the half, anchor).

    The home anchor comes first.
    """
    rows, syndromes = np.arange(len(half)), _syndromes(half)
    home = _flips(half, syndromes)
    off = syndromes > 0  # a code word's other code words are three bits away
    if threshold == 0:
        return np.concatenate([rows, rows[~off]]), np.concatenate([home, home[~off] ^ np.uint64(1 << 31)])
    who, where = [rows, rows], [home, home ^ np.uint64(1 << 31)]
    for first in range(1, 32):
        second = syndromes ^ np.uint64(first)  # turning both over gives a code word
        two = off & (second > np.uint64(first))
        who.append(rows[two])
        where.append(_flips(_flips(half[two], np.full(int(two.sum()), first, np.uint64)), second[two]))
    return np.concatenate(who), np.concatenate(where)


def _replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            bits = batch.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False)
            for part in (0, 1):
                half = (bits.view(np.uint64) >> np.uint64(32 * part)) & np.uint64(0xFFFFFFFF)
                who, where = anchors(half)
                keys = (where | np.uint64(part << 32)).astype(np.int64)
                raw = pa.Array.from_buffers(pa.binary(8), len(who), [None, pa.py_buffer(np.ascontiguousarray(bits[who]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(bits[who]), raw, pa.array(np.arange(len(who)) < len(bits))], names=["anchor", "node", "bits", "home"])


def _union(roots: dict[int, int], x: int) -> int:
    while (up := roots.get(x, x)) != x:
        roots[x] = roots.get(up, up)
        x = up
    return x


def _forest(bits: np.ndarray, groups: np.ndarray, home: np.ndarray, thresholds: Sequence[int]) -> list[tuple[int, int]]:
    """Links that span the same components as all links inside each group, whose rows stand together.

    ``bits`` has a row of one or more 64-bit numbers for each; of a pair, one
    must be at home. Links within a smaller threshold are taken before those
    within the next.
    """
    found, roots = [], {}
    for threshold in thresholds:
        _grow(found, roots, bits, groups, home, threshold)
    return found


def _grow(found: list[tuple[int, int]], roots: dict[int, int], bits: np.ndarray, groups: np.ndarray, home: np.ndarray, threshold: int) -> None:
    ends = np.searchsorted(groups, groups, side="right") if len(groups) else groups
    label = np.fromiter((_union(roots, i) for i in range(len(bits))), np.int64, len(bits)) if roots else np.arange(len(bits))
    live, gap = np.arange(len(bits)), 0
    while True:
        gap += 1
        live = live[live + gap < ends[live]]
        if not len(live):
            return
        near = live[home[live] | home[live + gap]]
        near = near[label[near] != label[near + gap]]
        near = near[np.bitwise_count(bits[near] ^ bits[near + gap]).sum(axis=1, dtype=np.int64) <= threshold]
        for i in near.tolist():
            a, b = _union(roots, i), _union(roots, i + gap)
            if a != b:
                roots[max(a, b)] = min(a, b)
                found.append((i, i + gap))
        if len(near) > 64:
            label = np.fromiter((_union(roots, i) for i in range(len(bits))), np.int64, len(bits))


def _compare(width: int, thresholds: Sequence[int]):
    """Links of rows (anchor, i, j, node, bits, home) that come sorted by (anchor, i, j), those at home first.

    ``bits`` holds ``width`` 64-bit numbers. A group may go on in the next
    batch; one with no row at home links nothing and is not held.
    """

    def links(table: pa.Table, groups: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        node = table.column("node").to_numpy()
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), "<u8").reshape(-1, width)
        pairs = np.array(_forest(bits, groups, home, thresholds), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["a", "b"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        last, useful = None, False  # key of the group at the end of what was seen, and whether it has a row at home
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("anchor", "i", "j")], axis=1)
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            sizes = np.diff(np.append(starts, len(keys)))
            home = batch.column("home").to_numpy(zero_copy_only=False)
            good = home[starts].copy()  # rows at home come first in their group
            if last is not None and (keys[0] == last).all():
                good[0] = useful
            elif held is not None:
                yield links(held, np.zeros(held.num_rows, np.int64), held.column("home").to_numpy())
                held = None
            alone = (sizes == 1) & (np.arange(len(sizes)) < len(sizes) - 1)
            if held is not None:
                alone[0] = False
            rows = pa.Table.from_batches([batch.filter(pa.array(np.repeat(good & ~alone, sizes)))])
            left = np.repeat(np.arange(len(sizes))[good & ~alone], sizes[good & ~alone])
            if held is not None:
                left = np.concatenate([np.zeros(held.num_rows, np.int64), left])
                rows = pa.concat_tables([held, rows])
                held = None
            last, useful = keys[-1], bool(good[-1])
            ended = int(np.searchsorted(left, len(sizes) - 1))
            if ended:
                some = rows.slice(0, ended).combine_chunks()
                yield links(some, left[:ended], some.column("home").to_numpy())
            if ended < rows.num_rows:
                held = rows.slice(ended).combine_chunks()
        if held is not None:
            yield links(held, np.zeros(held.num_rows, np.int64), held.column("home").to_numpy())

    return compare


def _tiled_links(spread: DataFrame, width: int, thresholds: Sequence[int], tile: int) -> DataFrame:
    """Links (a, b) of nodes whose rows (anchor, node, bits, home) meet at an anchor and differ in no more bits than the last of ``thresholds``.

    They span the components of all links: within a group at an anchor they
    are a spanning forest, so a cluster of k nodes gives k links, not k * k. An
    anchor with more than ``tile`` rows is dealt out by hash into tiles and
    every pair of tiles is compared in a group of its own, so no group holds
    more than about two tiles and nothing is left out. A large anchor with no
    row at home is dropped before the shuffle, as nothing is compared there.
    """
    sized = spread.groupBy("anchor").agg(F.count("*").alias("n"), F.max("home").alias("used")).where(F.col("n") > tile)
    large = checkpointed(sized.select("anchor", F.when(F.col("used"), F.ceil(F.col("n") / tile)).otherwise(0).cast("int").alias("tiles")))
    dealt = spread.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "anchor", "left")
    tiles = F.coalesce("tiles", F.lit(1))
    dealt = dealt.where(tiles > 0).withColumn("mine", F.pmod(F.xxhash64("node"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    tiled = dealt.select("anchor", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "bits", "home")
    grouped = tiled.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", F.desc("home"))
    return grouped.mapInArrow(_compare(width, thresholds), "a bigint, b bigint")


def near_links(bits: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``bits`` that differ in 3 or fewer bits; they span the components of all links."""
    spread = bits.select("bits").mapInArrow(_replicate, "anchor bigint, node bigint, bits binary, home boolean")
    return _tiled_links(spread, 1, (THRESHOLD,), tile)


def _named(first: DataFrame, links: DataFrame, node: str, value: str) -> DataFrame:
    """(``node``, smallest): the smallest ``value`` that each node of ``first`` reaches over the links, its own included."""
    linked = components(links)
    groups = first.join(linked, first[node] == linked["node"], "left").select(first[node].alias("__n"), first[value].alias("__v"), F.coalesce("component", first[node]).alias("component"))
    smallest = groups.groupBy("component").agg(F.min("__v").alias("smallest"))
    return groups.join(smallest, "component").select(F.col("__n").alias(node), "smallest")


def _salted(left: DataFrame, right: DataFrame, key: str, salt: Column) -> DataFrame:
    """Inner join on ``key``, which may be that of a third of all rows on the left: its rows are salted, the right row is replicated."""
    salts = 16
    left = left.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__salt"]).drop("__salt")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The group of near-duplicates of every document: (``id_col``, fingerprint, component_id).

    fingerprint: 16 hexadecimal digits. component_id: smallest id among the
    documents that can be reached over links of 3 or fewer differing bits,
    itself included. Copies share a fingerprint and are compared once. Null,
    empty and white-space texts have fingerprint zero and link like any other;
    repeated rows keep their rows; a row with a null id gets the smallest id of
    its group, null if there is none. Other columns are not read.
    """
    marked = checkpointed(fingerprints(docs, id_col, text_col).select(F.col(id_col).alias("__id"), "bits"))
    first = checkpointed(marked.groupBy("bits").agg(F.min("__id").alias("first")))
    named = _named(first, near_links(first), "bits", "first")
    hexed = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return _salted(marked, named, "bits", F.col("__id")).select(F.col("__id").alias(id_col), hexed.alias("fingerprint"), F.col("smallest").alias("component_id"))


def _spread_prints(search: int):
    """Rows (anchor, node, bits, home) at the anchors within the covering radius of both halves of the first ``search`` fingerprints."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                node, prints = batch.column(0).slice(at, 2_000), batch.column(1).slice(at, 2_000).to_pylist()
                words = np.frombuffer(b"".join(prints), "<u8").reshape(len(prints), -1)
                check = pa.array([p[8 * search :] for p in prints], pa.binary())
                halves = np.ascontiguousarray(words[:, :search]).view("<u4").astype(np.uint64)
                who, where = [], []
                for k in range(2 * search):
                    rows, homes = anchors(halves[:, k], 0)
                    who.append(rows)
                    where.append(homes | np.uint64(k << 32))
                who = pa.array(np.concatenate(who))
                keys = np.concatenate(where).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), node.take(who), check.take(who), pa.array(np.ones(len(keys), bool))], names=["anchor", "node", "bits", "home"])

    return spread


def shingle_set(text: str | None, words: int = CHECK_WORDS) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order."""
    return np.unique(_shingle_hashes(text, words, SEED))


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two such sets is ``similarity`` or more; two empty sets are equal."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _verify(similarity: float):
    """Links of rows (hub, tile, lead, node, text), sorted so that a hub's own text leads the texts that it is compared with."""

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            for block in text_blocks([batch], column=4):
                found = []
                for at, lead, node, text in zip(block.column(0).to_pylist(), block.column(2).to_pylist(), block.column(3).to_pylist(), block.column(4)):
                    if lead:
                        hub, own = at, shingle_set(text.as_py())
                    elif at == hub and alike(own, shingle_set(text.as_py()), similarity):
                        found.append((at, node))
                pairs = np.array(found, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return verify


def _verified(leads: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ``members`` (hub, node, text) that are similar to their hub, whose text is in ``leads`` (hub, text).

    Texts are read one after the other, so a task holds two at a time; a hub
    of more than ``STAR`` texts is dealt out, with a copy of its own text each.
    """
    sized = members.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > STAR)
    large = checkpointed(sized.select("hub", F.ceil(F.col("n") / STAR).cast("int").alias("tiles")))
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    tiles = F.coalesce("tiles", F.lit(1))
    first = leads.join(large, "hub", "left").select("hub", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"), F.lit(True).alias("lead"), F.col("hub").alias("node"), "text")
    rest = members.join(large, "hub", "left").select("hub", F.pmod(F.xxhash64("node"), tiles).cast("int").alias("tile"), F.lit(False).alias("lead"), "node", "text")
    grouped = first.unionByName(rest).repartition("hub", "tile").sortWithinPartitions("hub", "tile", F.desc("lead"))
    return grouped.mapInArrow(_verify(similarity), "a bigint, b bigint")


def _maybe_wanted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose digest may be one of ``wanted``: all that are, and few others while these are fewer than ``SLOTS``.

    The digests set bits of a table whose size is fixed, which may therefore be broadcast however many they are.
    """
    slot = F.pmod(F.xxhash64("digest"), F.lit(SLOTS))
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    bits = wanted.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    marked = texts.withColumn("slot", slot).withColumn("word", F.floor(F.col("slot") / 64))
    return marked.join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit) != 0).drop("slot", "word", "bits")


def _true_links(candidates: DataFrame, texts: DataFrame, first: DataFrame, similarity: float) -> DataFrame:
    """Those links between nodes whose texts are as similar as asked, from the forest of ``candidates``.

    Every text of a candidate group is compared with the group's smallest node
    first; then candidates are compared whose ends these links leave apart.
    """
    groups = components(candidates)
    wanted = checkpointed(groups.join(first.select("node", "digest"), "node"))
    met = texts.join(F.broadcast(wanted), "digest") if wanted.count() <= BROADCAST_ROWS else _salted(_maybe_wanted(texts, wanted), wanted, "digest", F.col("salt"))
    named = met.groupBy("node").agg(F.first("component").alias("hub"), F.first("text").alias("text"))
    named = checkpointed(named)
    star = checkpointed(_verified(named.where("node = hub").select("hub", "text"), named.where("node <> hub"), similarity))
    near = star.select(F.col("b").alias("node"), F.col("a").alias("label"))

    def labelled(links: DataFrame, end: str) -> DataFrame:
        label = near.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        return links.join(label, end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))

    apart = labelled(labelled(candidates, "a"), "b").where("label_a <> label_b and a <> label_b and b <> label_a")
    apart = checkpointed(apart.select(F.col("a").alias("hub"), F.col("b").alias("node")).distinct())
    members = apart.join(named.select("node", "text"), "node").select("hub", "node", "text")
    leads = apart.select("hub").distinct().join(named.select(F.col("node").alias("hub"), "text"), "hub")
    return star.unionByName(_verified(leads, members, similarity))


def near_copies(docs: DataFrame, text_col: str = "text", key_col: str = "key", similarity: float = SIMILARITY, search: int = SEARCH_PRINTS, check: int = CHECK_PRINTS, tile: int = TILE) -> DataFrame:
    """The group of near copies of every text: (``key_col``, smallest), smallest the least key that it reaches, its own included.

    Two texts are near copies if the sets of their five-word shingles have a
    Jaccard similarity of ``similarity`` or more (``alike``). Pairs are looked
    at where some half of ``search`` fingerprints of three-word shingles meets
    at an anchor (see the module) and the share of differing bits of ``check``
    fingerprints of five-word shingles (cosine 2s / (1 + s)) leaves the
    similarity possible, with ``ROOM``; of those, a forest of the likeliest in
    each group is compared, and every text with one text of its group. So no
    link is false, while the search is not complete: its recall is a matter
    of similarity, and the README has figures. Texts with equal fingerprints
    are compared once. Null, empty and white-space texts are copies of each
    other. Keys may repeat.
    """
    kind = docs.schema[key_col].dataType.simpleString()
    share = acos(2 * similarity / (1 + similarity)) / pi
    limits = [int(64 * check * share + room * (64 * check * share * (1 - share)) ** 0.5) for room in ROOM]

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            prints = pa.array([many_prints(t, search, check) for t in block.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([block.column(0), prints, block.column(2)], names=["__key", "prints", "digest"])

    digest = F.unhex(F.md5(F.coalesce(text_col, F.lit("")))).alias("digest")
    marked = checkpointed(docs.select(F.col(key_col).alias("__key"), F.col(text_col).alias("__text"), digest).mapInArrow(hashed, f"__key {kind}, prints binary, digest binary"))
    first = marked.groupBy("prints").agg(F.min("__key").alias("first"), F.min("digest").alias("digest")).withColumn("node", F.monotonically_increasing_id())
    first = checkpointed(first)
    spread = first.select("node", "prints").mapInArrow(_spread_prints(search), "anchor bigint, node bigint, bits binary, home boolean")
    candidates = checkpointed(_tiled_links(spread, check, limits, tile).distinct())
    texts = docs.select(digest, F.col(text_col).alias("text"), F.struct(key_col).alias("salt"))
    named = _named(first, _true_links(candidates, texts, first, similarity), "node", "first").join(first.select("node", "prints"), "node").select("prints", "smallest")
    return _salted(marked, named, "prints", F.col("__key")).select(F.col("__key").alias(key_col), "smallest")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: float) -> DataFrame:
    """One document of each group of ``near_copies``, that with the smallest id, with all its columns, whatever their names.

    Of rows of a group that share the smallest id, that with the least digest
    of text and then of the other columns stays, once; so repeated rows are one
    document. Null ids come after all others. Rows of one id in different
    groups are documents of their own.
    """
    others = F.struct(*[c for c in docs.columns if c not in (id_col, text_col)] or [F.lit(0).alias("none")])
    key = F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), F.md5(F.coalesce(F.concat(F.lit("t"), text_col), F.lit(""))).alias("digest"), F.xxhash64(F.to_json(others)).alias("rest"))
    rows = docs.select(key.alias("key"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    kept = near_copies(rows.select("key", "text"), **settings).select("smallest").distinct()
    name = lambda k: F.md5(F.to_json(k)).alias("name")
    return rows.select(name(F.col("key")), "row").dropDuplicates(["name"]).join(kept.select(name(F.col("smallest"))), "name", "left_semi").select("row.*")
