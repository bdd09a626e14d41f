"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Pre-tokens repeat, so none is merged twice: every block of documents (some tens
of MB of text) numbers its distinct words and keeps its pre-tokens as a
sequence of these numbers, which are their positions exploded and packed. The
distinct words of a block are shuffled, by word, to where each distinct word of
the corpus is encoded once; their ids go back to the block, where the number
sequence puts them in order again. A word that makes up a third of all text
still comes once from each block.

Words travel packed by bucket, not as rows to be joined: a block has as many
distinct words as a tenth of its pre-tokens, and rows for these took 2.1 times
the input on disk where packed ones take 1.4 (README). Buckets are joined by
the block and number that their words come with.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from circuitlens.llm.common import text_blocks
from circuitlens.llm.pretokens import splitter

#: Bytes of text whose distinct words are numbered together.
BLOCK_BYTES = 24_000_000
#: Bytes of text whose number sequence makes up one row.
PART_BYTES = 1_000_000
#: Bytes of all text for each task that assembles.
TASK_BYTES = 32_000_000
#: Distinct words of the corpus for each bucket, and the least number of buckets for each shuffle partition.
BUCKET_WORDS, BUCKETS = 100_000, 4


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a ``.tiktoken`` file: token bytes and their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one compressed value; 32-bit numbers are stored by byte plane."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
    sizes = np.array([len(parts), *map(len, parts)], "<u8").tobytes()
    body = b"".join(parts)
    return sizes + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(value: memoryview) -> list[memoryview]:
    n = int(np.frombuffer(value[:8], "<u8")[0])
    sizes = np.frombuffer(value[8 : 8 * n + 8], "<u8")
    body = memoryview(pa.decompress(value[8 * n + 8 :], decompressed_size=int(sizes.sum()), codec="zstd"))
    ends = np.cumsum(sizes)
    return [body[int(e - s) : int(e)] for s, e in zip(sizes, ends)]


def _numbers(part: memoryview) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths[:-1]))) if len(lengths) else np.zeros(0, np.int64)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at ``starts`` and are ``lengths`` long, one run after the other."""
    return np.repeat(starts - _starts(lengths), lengths) + np.arange(int(lengths.sum()))


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _distinct_words(docs: DataFrame, text_col: str) -> int:
    """About how many distinct words all texts have, cut at blanks; it only sizes buckets."""
    words = docs.select(F.explode(F.split(F.col(text_col), " ")).alias("word"))
    return words.agg(F.approx_count_distinct("word")).first()[0] or 0


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: (``id_col``, ids ARRAY<INT>), one row per input row.

    Each match of ``pattern`` is merged by ``ranks`` on its own, without
    special tokens. Null and empty texts give an empty array; null or repeated
    ids stay as they are; other columns are not read.

    Rows are put in order within their partition first, so that a task which
    is run again after the loss of an executor forms the same blocks, in
    whatever order its rows come the second time. Should a partition itself
    come to hold other rows (an input that is drawn anew on a retry), the
    block's name, a digest of its place, keys and content, differs and the job
    stops with an error instead of mixing the two.

    Texts are assembled in as many tasks as they need by their bytes, words are
    encoded in as many buckets as there are distinct words for; these grow far
    slower than the bytes, so that a block still sends many words at once to
    each bucket when the corpus is large.
    """
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    tasks = max(least, -(-size // TASK_BYTES))
    buckets = max(BUCKETS * least, -(-_distinct_words(docs, text_col) // BUCKET_WORDS))
    shared = spark.sparkContext.broadcast(ranks)
    id_type = docs.schema[id_col].dataType.simpleString()
    row_type = f"bucket int, block string, part int, keys array<{id_type}>, payload binary"

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        words, parts, held, key_type, flushed = _Numbers(), [], 0, None, 0

        def flush() -> pa.RecordBatch:
            # frequent words get small numbers, which pack best
            order = np.argsort(-np.bincount(np.concatenate([p[2] for p in parts]), minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            packed = [(keys, _pack(lengths, rank[flat])) for keys, lengths, flat in parts]
            # blocks of equal texts stay apart by their place, which a retry keeps
            digest = xxhash.xxh3_128(f"{TaskContext.get().partitionId()} {flushed}".encode())
            for keys, payload in packed:
                digest.update(repr(keys).encode())
                digest.update(payload)
            seen = list(words)
            encoded = [seen[i].encode() for i in order.tolist()]
            lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
            place = np.fromiter((zlib.crc32(w) % buckets for w in encoded), np.int64, len(encoded))
            order = np.argsort(place, kind="stable")
            cuts = np.flatnonzero(np.diff(place[order], prepend=-1))
            found = []
            for mine in np.split(order, cuts[1:]) if len(order) else []:
                payload = _pack(np.diff(mine, prepend=0), lengths[mine], b"".join([encoded[i] for i in mine]))
                digest.update(payload)
                found.append((int(place[mine[0]]), -1, [], payload))
            name = digest.hexdigest()
            found += [(zlib.crc32(f"{name}{k}".encode()) % buckets, k, keys, payload) for k, (keys, payload) in enumerate(packed)]
            bucket, part, keys, payload = map(list, zip(*found))
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), pa.array([name] * len(found)), pa.array(part, pa.int32()), pa.array(keys, pa.list_(key_type)), pa.array(payload, pa.binary())],
                names=["bucket", "block", "part", "keys", "payload"],
            )

        for some in text_blocks(batches, PART_BYTES):
            keys, texts = some.columns
            key_type = keys.type
            numbered = [list(map(words.__getitem__, split(t))) if t else [] for t in texts.to_pylist()]
            lengths = np.fromiter(map(len, numbered), np.int64, len(numbered))
            flat = np.fromiter((n for doc in numbered for n in doc), np.uint32, int(lengths.sum()))
            parts.append((keys.to_pylist(), lengths, flat))
            held += texts.nbytes
            if held >= BLOCK_BYTES:
                yield flush()
                words, parts, held, flushed = _Numbers(), [], 0, flushed + 1
        if parts:
            yield flush()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = tiktoken.Encoding("piece", pat_str=r"(?s).+", mergeable_ranks=shared.value, special_tokens={}).encode_ordinary
        known: dict[bytes, list[int]] = {}
        bucket = None
        for batch in batches:
            payloads = []
            for mine, part, payload in zip(batch.column("bucket").to_pylist(), batch.column("part").to_pylist(), batch.column("payload")):
                if part >= 0:
                    payloads.append(payload.as_py())
                    continue
                if mine != bucket:  # the pieces of a bucket stand together, and no word is in two
                    bucket, known = mine, {}
                numbers, lengths, blob = _unpack(memoryview(payload.as_buffer()))
                ids, at, blob = [], 0, bytes(blob)
                for n in _numbers(lengths).tolist():
                    word = blob[at : at + n]
                    at += n
                    if (got := known.get(word)) is None:
                        got = known[word] = whole(word.decode())
                    ids.append(got)
                counts = np.fromiter(map(len, ids), np.int64, len(ids))
                payloads.append(_pack(_numbers(numbers), counts, np.fromiter((i for w in ids for i in w), np.uint32, int(counts.sum()))))
            yield batch.set_column(batch.schema.get_field_index("payload"), "payload", pa.array(payloads, pa.binary()))

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pieces, starts, counts, ids = None, [], None, None, None
        for batch in batches:
            for name, part, keys, payload in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), batch.column("keys"), batch.column("payload")):
                if name != block:
                    block, pieces, ids = name, [], None
                arrays = [_numbers(x).astype(np.int64) for x in _unpack(memoryview(payload.as_buffer()))]
                if part < 0:
                    pieces.append(arrays)
                    continue
                if ids is None:  # the words of a block come before its texts
                    numbers = np.concatenate([np.cumsum(p[0]) for p in pieces] or [np.zeros(0, np.int64)])
                    order = np.argsort(numbers)
                    if not np.array_equal(numbers[order], np.arange(len(numbers))):
                        raise RuntimeError("a block lacks words: a retry read other rows; checkpoint the input first")
                    found = np.concatenate([p[1] for p in pieces] or [np.zeros(0, np.int64)])
                    ids = np.concatenate([p[2] for p in pieces] or [np.zeros(0, np.int64)]).astype(np.int32)
                    starts, counts = _starts(found)[order], found[order]
                    pieces = []
                lengths, flat = arrays
                if len(flat) and int(flat.max()) >= len(counts):
                    raise RuntimeError("a block lacks words: a retry read other rows; checkpoint the input first")
                per_word = counts[flat]
                ends = np.concatenate(([0], np.cumsum(per_word)))[np.concatenate(([0], np.cumsum(lengths)))]
                values = ids[_spread(starts[flat], per_word)]
                yield pa.RecordBatch.from_arrays([keys.values, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))], names=["__id", "ids"])

    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).sortWithinPartitions(F.xxhash64("__text"), F.xxhash64("__id"), "__text", "__id")
    numbered = picked.mapInArrow(number, row_type).repartition(min(tasks, buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(merge, row_type)
    blocks = numbered.drop("bucket").repartition(tasks, "block").sortWithinPartitions("block", "part")
    return blocks.mapInArrow(assemble, f"__id {id_type}, ids array<int>").withColumnRenamed("__id", id_col)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded", keep: bool = False) -> DataFrame:
    """Replace the ids of every row by the bytes that they stand for, or add these with ``keep``.

    The table of token bytes is as large as the vocabulary and no larger, so
    it travels with the plan as one array, in which each id finds its bytes
    (as Latin-1 characters) in a built-in expression; nothing is shuffled and
    no Python runs. All other columns stay, whatever their names. Null ids give
    null, an empty array gives no bytes, and an id that is not in the table
    (or is null) raises an error.
    """
    size = max(ranks.values(), default=-1) + 1
    tokens = [""] * size
    for token, rank in ranks.items():
        tokens[rank] = token.decode("latin-1")
    table = F.split(F.lit("\u0100".join(tokens)), "\u0100")
    rows = encoded.select(F.struct(*encoded.columns).alias("row"), F.transform(ids_col, lambda i: F.nullif(F.get(table, i), F.lit(""))).alias("found"))
    ids = F.col("row").getField(ids_col)
    unknown = F.size(F.array_compact("found")) < F.size(ids)
    found = F.when(unknown, F.raise_error(F.lit("an id is not in the table of tokens"))).otherwise(F.encode(F.array_join("found", ""), "ISO-8859-1"))
    others = [F.col("row").getField(c).alias(c) for c in encoded.columns if c != ids_col]
    return rows.select(*others, *[ids.alias(ids_col)] * keep, found.alias(out_col))
