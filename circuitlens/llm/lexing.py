"""Name-literal pairs of source and configuration text, read token by token.

Understood are assignments (``=``, ``:=``, ``=>``), dictionary and JSON entries,
YAML with its blocks, INI and shell lines, XML elements and attributes;
comments, escapes, triple and back quotes, typed declarations, subscripted
targets, adjacent and added literals, and literals in a call or list. The work
is linear in the text, of whatever length names and literals are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\f\v]++)|(?P<newline>\n)
    |(?P<name>[A-Za-z_$][A-Za-z0-9_$]*+(?:(?:\.|-)[A-Za-z_$][A-Za-z0-9_$]*+)*+)
    |(?P<sign>==++|[!<>]=|:=|=>|=|:(?!:))|(?P<other>[^\w"'`\s=:!<>#/;-]++|.)""",
    re.X | re.S,
)
_STRING = {'"': re.compile(r'"(?:[^"\\\n]++|\\[^\n])*+"'), "'": re.compile(r"'(?:[^'\\\n]++|\\[^\n])*+'"), "`": re.compile("`[^`]*+`")}
_PREFIX = re.compile(r"[rRbBuUfF]{1,2}\Z")
_BARE = re.compile(r"[A-Za-z0-9_+/.=@$!%^&*~?:-]++")
_REFERENCE = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*+(?:\.[A-Za-z_$][A-Za-z0-9_$]*+)*+\Z")
_BLOCK = re.compile(r"[ \t]*+[|>][+-]?[0-9]?[ \t\r]*+\n")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>\s*+([^<>\s][^<>]*+)</\1\s*+>")
_ENTRY = re.compile(r"""\b(?:key|name)\s*+=\s*+["']([^"'\n<>]++)["']\s++value\s*+=\s*+["']([^"'\n<>]++)["']""")
_KEY = re.compile(r"[A-Za-z_$][\w$.-]*+\Z")


@dataclass
class Value:
    """What stands to the right of a name: literals (start, end) and the names that it refers to."""

    literals: list[tuple[int, int]] = field(default_factory=list)
    references: list[str] = field(default_factory=list)
    quoted: bool = True
    passed: bool = False  # handed to a call or list, not assigned itself
    inner: list[list[Value]] = field(default_factory=list)  # what is assigned to names inside it


@dataclass
class Pair:
    name: str
    value: Value
    commented: bool


def _tokens(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, in a comment) of every token but blanks."""
    found, at, until, size = [], 0, 0, len(text)
    missing: set[str] = set()
    unclosed = dict.fromkeys(_STRING, 0)  # up to where no string of a kind is closed

    def close(mark: str, start: int) -> int:
        if mark in missing:
            return -1
        end = text.find(mark, start)
        if end < 0:
            missing.add(mark)
        return end

    match = _TOKEN.match
    while at < size:
        mark = text[at]
        if mark in "\"'" and text.startswith(mark * 3, at) and (end := close(mark * 3, at + 3)) >= 0:
            found.append(("string", at, end + 3, at < until))
            at = end + 3
            continue
        if mark in _STRING:
            word = at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_")  # an apostrophe, unless the word is a prefix
            opens = mark != "'" or not word or bool(_PREFIX.match(text, found[-1][1], found[-1][2]))
            closed = _STRING[mark].match(text, at) if opens and at >= unclosed[mark] else None
            if closed is None and opens and at >= unclosed[mark]:
                end = text.find("\n", at) if mark != "`" else -1
                unclosed[mark] = end if end >= 0 else size
            end = closed.end() if closed else at + 1
            found.append(("string" if closed else "other", at, end, at < until))
            at = end
            continue
        if at >= until and mark in "#/;-<":
            line = text.rfind("\n", max(0, at - 40), at) + 1 if mark in ";-" and (at == 0 or text[at - 1] in " \t\n") else -1
            first = 0 <= line and at - line < 39 and not text[line:at].strip()
            if mark == "#" and (at == 0 or text[at - 1].isspace()) or mark == ";" and first or text.startswith("-- ", at) and first or text.startswith("//", at) and (at == 0 or text[at - 1] != ":"):
                until = (text.find("\n", at) + 1 or size + 1) - 1
            elif text.startswith("/*", at) and (end := close("*/", at + 2)) >= 0:
                until = end
            elif text.startswith("<!--", at) and (end := close("-->", at + 4)) >= 0:
                until = end
        m = match(text, at)
        kind = m.lastgroup
        if kind != "space":
            found.append((kind, at, m.end(), at < until))
        at = m.end()
    return found


def _inside(text: str, start: int, end: int) -> tuple[int, int]:
    """The content of a string token, without prefix and quotes."""
    while text[start] not in "\"'`":
        start += 1
    width = 3 if end - start >= 6 and text[start : start + 3] in ('"""', "'''") else 1
    return start + width, end - width


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.pairs = text, _tokens(text), []
        self.found: dict[int, tuple[list[Value], int]] = {}  # of each sign: its values, and the token at which they end

    def target(self, k: int) -> str | None:
        """The name to the left of the sign at ``k``."""
        k -= 1
        if k >= 0 and self.text[self.tokens[k][1] : self.tokens[k][2]] == "?":
            k -= 1
        if k >= 0 and self.tokens[k][0] == "other" and self.text[self.tokens[k][1] : self.tokens[k][2]].endswith("]"):
            k -= 1
        if k < 0:
            return None
        kind, a, b, _ = self.tokens[k]
        if kind == "name":
            return self.text[a:b]
        if kind == "string":
            a, b = _inside(self.text, a, b)
            return self.text[a:b] if _KEY.match(self.text, a, b) else None
        return None

    def typed(self, k: int) -> int:
        """The sign that assigns, after a type where one follows the colon at ``k``."""
        for j in range(k + 1, min(k + 12, len(self.tokens))):
            kind, a, b, _ = self.tokens[j]
            if kind == "sign":
                return j if self.text[a:b] == "=" and j > k + 1 else k
            if kind not in ("name", "other") or kind == "other" and not set(self.text[a:b]) <= set("[],|.&*"):
                return k
        return k

    def block(self, k: int) -> Value | None:
        """The lines below a YAML key that are indented more than it."""
        text, (_, a, b, _) = self.text, self.tokens[k]
        if not (m := _BLOCK.match(text, b)):
            return None
        line = text.rfind("\n", 0, a) + 1
        indent = len(text[line:a]) - len(text[line:a].lstrip(" \t-"))
        start = end = None
        at = m.end()
        while at < len(text):
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            row = text[at:stop]
            if row.strip():
                if len(row) - len(row.lstrip()) <= indent:
                    break
                start = at + len(row) - len(row.lstrip()) if start is None else start
                end = at + len(row.rstrip())
            at = stop + 1
        return Value([(start, end)]) if start is not None else None

    def after(self, j: int, end: int) -> int:
        """The first token from ``j`` on that starts at ``end`` or later."""
        while j < len(self.tokens) and self.tokens[j][1] < end:
            j += 1
        return j

    def values(self, k: int) -> tuple[list[Value], int]:
        """The value after the sign at ``k``, and those handed to calls and lists in it; and the token at which they end.

        Pairs inside brackets are passed over: they lie to the right of ``k``,
        and their values are known by now.
        """
        text, tokens = self.text, self.tokens
        if text[tokens[k][1]] == ":" and (found := self.block(k)):
            return [found], k + 1
        j, main, extra = k + 1, Value(), []
        while j < len(tokens) and tokens[j][0] == "newline" and text[tokens[k][1] : tokens[k][2]] != ":" and j == k + 1:
            j += 1
        if j >= len(tokens) or tokens[j][0] == "newline":
            return [], j
        kind, a, b, _ = tokens[j]
        if kind not in ("string",) and text[a] not in "([{\"'`" and (m := _BARE.match(text, a)):
            after = text[m.end() : m.end() + 1]
            rest = text[m.end() : m.end() + 40].lstrip(" \t")
            if _REFERENCE.match(m[0]) and after not in ("(", "[", '"', "'") and not rest.startswith("+"):
                return [Value(literals=[m.span()], references=[m[0]], quoted=False)], self.after(j, m.end())
            if not _REFERENCE.match(m[0]):
                return [Value(literals=[m.span()], quoted=False)], self.after(j, m.end())
        depth, joined, current = 0, True, main
        while j < len(tokens):
            kind, a, b, _ = tokens[j]
            if kind == "string":
                if current is main and not joined and main.literals and depth == 0 and tokens[j - 1][0] != "string":
                    break
                current.literals.append(_inside(text, a, b))
                joined = False
            elif kind == "name":
                called = j + 1 < len(tokens) and text[tokens[j + 1][1]] in "(["
                if not called:
                    if current is main and not joined:
                        break
                    current.references.append(text[a:b])
                joined = False
            elif kind == "newline":
                ahead = tokens[j + 1] if j + 1 < len(tokens) else None
                if depth <= 0 and not joined and not (ahead and text[ahead[1]] == "+"):
                    break
            elif kind == "other":
                stop = False
                for c in text[a:b]:
                    if c in "([":
                        depth += 1
                        if j > k + 1 and tokens[j - 1][0] == "name" or c == "[":
                            current = Value(passed=True)
                            extra.append(current)
                    elif c in ")]":
                        depth -= 1
                        current, joined = main, False
                        stop = depth < 0
                    elif c == "," and depth > 0:
                        current = Value(passed=True)
                        extra.append(current)
                        joined = True
                    elif c in "+\\":
                        joined = True
                    elif c not in ".&*|?":
                        stop = depth <= 0
                    if stop:
                        break
                if stop:
                    break
            elif depth <= 0:  # a sign
                break
            elif j in self.found:
                inner, end = self.found[j]
                if inner:
                    current.inner.append(inner)
                if end > j:
                    j, joined = end, False
                    continue
            j += 1
        return [v for v in (main, *extra) if v.literals or v.references or v.inner], j

    def parse(self) -> list[Pair]:
        text, named, done = self.text, [], set()
        for k, (kind, a, b, commented) in enumerate(self.tokens):
            if kind != "sign" or k in done or text[a:b] not in ("=", ":", ":=", "=>"):
                continue
            if (name := self.target(k)) is None:
                continue
            sign = self.typed(k) if text[a:b] == ":" else k
            done.add(sign)
            named.append((name, sign, commented))
        for _, sign, _ in reversed(named):
            self.found[sign] = self.values(sign)
        self.pairs = [Pair(name, value, commented) for name, sign, commented in named for value in self.found[sign][0]]
        for pattern in (_ELEMENT, _ENTRY):
            for m in pattern.finditer(text):
                end = m.start(2) + len(m[2].rstrip())
                self.pairs.append(Pair(m[1], Value([(m.start(2), end)]), False))
        return self.pairs


def pairs(text: str) -> list[Pair]:
    """Every name and what is assigned to it, in the order of the text."""
    return _Parser(text).parse()
