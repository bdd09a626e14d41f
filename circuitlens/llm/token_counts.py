"""Token counts by the whole-token shortcut."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from circuitlens.llm.common import text_blocks
from circuitlens.llm.pretokens import splitter

#: Costs of other pre-tokens that a task remembers before it starts anew.
REMEMBERED = 500_000


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that the tokenizer encodes, alone, as one token.

    Proven by encoding each entry of the vocabulary once with the library; a
    pre-token equal to one of them therefore always counts one. The set is no
    larger than the vocabulary, whatever the corpus. Entries are encoded one by one: the
    threads of a batch keep their memory, more of it each time.
    """
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = (library.decode([i], skip_special_tokens=False) for i in range(library.get_vocab_size()))
    return frozenset(t for t in texts if t and len(library.encode(t, add_special_tokens=False).ids) == 1)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, then the others in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def merge_ranks(spec: dict) -> dict[bytes, int]:
    """Ranks by which ``tiktoken`` merges a pre-token just as the merge list of ``spec`` does.

    One joins listed pairs, the other any two parts whose bytes make up a
    token. These agree on tokens that their own bytes, merged by listed pairs,
    come to: until the rank of such a token is reached, what lies inside its
    bytes develops as it does alone, or some merge has crossed its edge and it
    can't come about. Tokens that don't come about by listed pairs alone never
    do, and are left out.
    """
    known = byte_of()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    rank = {pair: k for k, pair in enumerate(pairs)}

    def whole(token: str) -> bool:
        parts = list(token)
        while len(parts) > 1:
            k, at = min((rank.get(p, len(rank)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if k == len(rank):
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True

    ranks = {bytes([b]): b for b in range(256)}
    for k, (a, b) in enumerate(pairs):
        if a + b in spec["model"]["vocab"] and whole(a + b):
            ranks.setdefault(bytes(known[c] for c in a + b), 256 + k)
    return ranks


def _checked(path: str) -> dict:
    """The tokenizer in JSON; an error for what counting pre-tokens on their own doesn't cover."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") is not None or model.get("type", "BPE") != "BPE":
        raise ValueError("a byte-level BPE tokenizer without a normalizer or prefix space is needed")
    if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        raise ValueError("dropout, ignored merges, prefixes and suffixes of words aren't covered")
    if any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take part of their surroundings aren't covered")
    return spec


def count_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Tokens of every whole text, as the ``tokenizers`` library gives them.

    ``path`` names a byte-level BPE tokenizer in JSON whose pre-tokenizer
    splits by ``pattern``. Each text is split into its added special tokens
    (one each, the library's default) and pre-tokens; whole tokens count one,
    and only the other pre-tokens are merged, each once while it is
    remembered. Truncation and padding that the file asks for are not applied;
    a tokenizer that this can't count is an error.

    Returns one row per input row: id (of any type), n_bytes (UTF-8), n_tokens,
    over_limit (more than ``limit`` tokens). A null or empty text has no bytes
    and no tokens; null ids and repeated rows stay as they are; other columns
    are not read. There is no shuffle and a task holds one batch of texts.
    """
    spec = _checked(path)
    specials = [t["content"] for t in spec.get("added_tokens", [])]
    shared = docs.sparkSession.sparkContext.broadcast((merge_ranks(spec), whole_tokens(path)))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, whole = shared.value
        split = splitter(pattern)
        merged = tiktoken.Encoding("piece", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        cut = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None

        class Cost(dict):
            def __missing__(self, piece: str) -> int:
                if len(self) > REMEMBERED:
                    self.clear()
                    self.update(dict.fromkeys(whole, 1))
                n = self[piece] = len(merged(piece))
                return n

        cost = Cost(dict.fromkeys(whole, 1))

        def tokens(text: str) -> int:
            if cut is None:
                return sum(map(cost.__getitem__, split(text)))
            parts = cut.split(text)
            return len(parts) - 1 + sum(sum(map(cost.__getitem__, split(p))) for p in parts)

        for block in text_blocks(batches):
            ids, texts = block.columns
            counts = [tokens(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64())], names=["__id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    sized = picked.select(F.struct("__id", F.octet_length("__text").cast("long").alias("n_bytes")).alias("__key"), "__text")
    counted = sized.mapInArrow(count, f"__id struct<__id:{kind},n_bytes:bigint>, n_tokens bigint")
    return counted.select(F.col("__id.__id").alias(id_col), F.col("__id.n_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
