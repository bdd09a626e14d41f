"""Secret scans: base patterns and assignment-aware lexing."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from circuitlens.llm.common import text_blocks
from circuitlens.llm.lexing import Value, pairs

#: The base patterns and their least lengths. Runs are written so that a run that is too short fails whole.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Parts of sensitive names; a text without any needs no lexing.
_STEMS = ("pass", "pwd", "secret", "token", "cred", "auth", "bearer", "key", "connection")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

#: How sensitive the parts of a target name are; a name takes its best part or pair of parts.
NAME_SCORES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "apikey": 1.0, "privatekey": 1.0, "accesskey": 1.0,
}
PAIR_SCORES = {("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 1.0, ("secret", "key"): 1.0, ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("connection", "string"): 0.8}
HARMLESS = {"none", "null", "true", "false", "example", "changeme", "placeholder", "redacted", "undefined", "string", "password", "secret", "token", "required", "optional"}
THRESHOLD = 0.5


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PART.findall(name)]
    parts = [p if p in NAME_SCORES else p.removesuffix("s") for p in parts]
    best = max((NAME_SCORES.get(p, 0.0) for p in [*parts, "".join(parts)]), default=0.0)
    return max([best, *(PAIR_SCORES.get(p, 0.0) for p in zip(parts, parts[1:]))])


def literal_score(value: str, quoted: bool) -> float:
    """0 to 1: how much a literal looks like a secret and not like a word or a reference."""
    if len(value) < 8 or value.lower() in HARMLESS or value.startswith(("$", "<", "{", "%(")) or len(set(value)) < 5:
        return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if " " in value or not quoted and kinds < 2:
        return 0.0 if kinds < 3 else 0.5
    return min(1.0, entropy / 4) * (0.4 + 0.2 * kinds if quoted else 0.2 + 0.2 * kinds)


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, at once or through constants.

    Constants are followed by their whole name or its last part, in any order
    and in cycles; what comments define isn't. What is assigned inside the
    brackets of a value belongs to it as well. Each name and each inner value is followed once for
    each score that it is reached with, of which there are a few, so the work
    stays linear. Parts of an added literal are scored together.
    """
    found = pairs(text)
    constants: dict[str, list[Value]] = {}
    for pair in found:
        if not pair.commented and not pair.value.passed:
            constants.setdefault(pair.name, []).append(pair.value)
            if (last := pair.name.rpartition(".")[2]) != pair.name:
                constants.setdefault(last, []).append(pair.value)
    spans, reached, entered = set(), {}, {}
    scored = [(name_score(pair.name), pair.value) for pair in found]
    for score, value in sorted((x for x in scored if x[0] > 0), key=lambda x: -x[0]):
        todo = [(value, value.passed)]
        while todo:
            value, passed = todo.pop()
            known = False
            for group in value.inner:
                if entered.get(id(group), 0.0) < score:
                    entered[id(group)] = score
                    todo += [(v, passed or v.passed) for v in group]
            for name in value.references:
                name = name if name in constants else name.rpartition(".")[2]
                if name in constants:
                    known = True
                    if reached.get(name, 0.0) < score:
                        reached[name] = score
                        todo += [(v, v.passed) for v in constants[name]]
            if not value.literals or known and not value.quoted:
                continue
            whole = "".join(text[a:b] for a, b in value.literals)
            if passed and (re.fullmatch(r"[A-Za-z_.\-/ :]+", whole) or " " in whole):
                continue  # the name of something, or words to show
            if score * literal_score(whole, value.quoted) >= THRESHOLD:
                spans.update((a, b) for a, b in value.literals if b > a)
    return sorted(spans)


def scan(text: str | None) -> tuple[list[tuple[int, str, int, int]], list[tuple[int, str, int, int]]]:
    """(base spans, spans that the method adds): start, kind, end, and where the value to hide begins."""
    if not text:
        return [], []
    base, signed = [], "=" in text or ":" in text
    if signed:
        low = text.lower()
        if any(k in low for k in _KEYWORDS):
            base += [(m.start(), "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        base += [(m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    base += [(m.start(), "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    base.sort(key=lambda s: (s[0], ("assign", "access", "hex").index(s[1])))
    if not (signed or "</" in text) or not any(k in text.lower() for k in _STEMS):
        return base, []
    added = [(a, "literal", b, a) for a, b in literals(text) if not any(s[0] <= a and b <= s[2] for s in base)]
    return base, added


def _joined(spans: list[tuple[int, str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end, _ in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text, one row per input row.

    Base kinds: assign, access and hex patterns. Method: source and
    configuration syntax is read as name-literal pairs (see ``lexing``),
    constants are followed through names, and a literal of whatever length counts
    (kind ``literal``) if the sensitivity of its target name times the score of
    the literal is high enough and no base span covers it.

    Returns ``id_col``, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end
    in code points, end exclusive, by start). Null and empty texts have none.
    Null ids and repeated rows stay; other columns are not read; no shuffle.
    """

    def scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            rows = []
            for text in block.column(1).to_pylist():
                base, added = scan(text)
                kinds = Counter(s[1] for s in base)
                rows.append((kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + added, key=lambda s: s[0]))))
            columns = list(zip(*rows))
            found = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(c, pa.string()) for c in columns[3:]]
            yield pa.RecordBatch.from_arrays([block.column(0), *found], names=["__id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return picked.mapInArrow(scanned, f"__id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string").withColumnRenamed("__id", id_col)


def hide(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with the value of every secret replaced by ``mark``."""
    base, added = scan(text)
    if not base and not added:
        return text
    parts, at = [], 0
    for start, end in sorted((s[3], s[2]) for s in base + added):
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs`` with the secrets of ``text_col`` hidden; null texts stay null."""
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*others) if others else F.struct(F.lit(0).alias("__none"))
    kind = docs.select(row).schema[0].dataType.simpleString()

    def hidden(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            texts = pa.array([hide(t, mark) for t in block.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([block.column(0), texts], names=["__row", "__text"])

    done = docs.select(row.alias("__row"), F.col(text_col).alias("__text")).mapInArrow(hidden, f"__row {kind}, __text string")
    return done.select(*[F.col("__text").alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in docs.columns])
