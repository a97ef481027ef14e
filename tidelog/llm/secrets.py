"""Secrets in texts: fixed patterns, and literals assigned to sensitive names.

The texts are prose with islands of source and configuration, so heads (a name,
quoted or not, and ``=``, ``:``, ``:=`` or ``=>``) are looked for anywhere, and
from a head on a hand-written lexer reads the value: literals in single, double,
back or triple quotes, with prefixes, over several lines where the syntax allows
it; sums of literals and names by ``+``, ``.``, ``..``, ``&``, ``||`` or mere
neighbourhood, with comments and line ends between them; lists; block scalars;
bare values, with line ends after a backslash.  Type annotations are skipped,
and names like ``value`` inherit from the section or mapping that they stand in.
Constants are propagated along assignments, so that in ``a = "..."; password =
a`` the literal of ``a`` counts as the password's.  Each literal is scored by the
most sensitive name that it reaches and by its own look.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidelog.llm.common import keyed_texts

BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 32 or more is the same as a maximal run that proves to be that long.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: What a text with any span has; RE2 looks for these in one pass.  The last branch holds for whatever value the lexer takes.
HINT = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|[A-Za-z0-9_$.\-\"'][\x20\t]*(?::=|=>|[:=])[\x20\t]*[^\s,;)}\]]"

#: Names and literals of any length.  No repeat can give back what the next part would take, so all are possessive and a
#: text is read in linear time.
_NAME = r"[A-Za-z_$][A-Za-z0-9_$.\-]*+"
_STRING = re.compile(r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`", re.S)
_SIGN = r"[\x20\t]*+(?::=|=>|=(?!=)|:(?!:))"
_HEAD = re.compile(rf"(?<![A-Za-z0-9_$.\-])(?P<q>[\"']?)(?P<name>{_NAME})(?P=q){_SIGN}")
_NEXT_HEAD = re.compile(_SIGN)
_ANNOTATION = re.compile(r"[\x20\t]*+[A-Za-z_][A-Za-z0-9_.]*+(?:\[[A-Za-z0-9_., |]*+\])?[\x20\t]++=[\x20\t]++")
_PREFIX = re.compile(r"(?:[rRbBfFuU]{1,2}|[@$L])?(?=[\"'])")
_BARE = re.compile(r"[^\s\"'`,;)}\]]++")
_WHOLE_NAME = re.compile(_NAME)
_GAP = re.compile(r"(?:[\x20\t]++|\\\n|/\*(?:[^*]|\*(?!/))*+\*/)*+")
_BREAK = re.compile(r"(?:\s++|//[^\n]*+|\#[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)*+")
_PLUS = re.compile(r"\+|\|\||&(?!&)|\.\.?(?=\s*+[\"'`])")
_BLOCK = re.compile(r"[\x20\t]*+[|>][+\-0-9]*+[\x20\t]*+\n")
_SECTION = re.compile(r"(?m)^[\x20\t]*+\[([^\]\n\"']++)\][\x20\t]*+$")
#: Names that say nothing by themselves and take over what their mapping or section is called.
GENERIC = {"value", "val", "data", "content", "default", "plain", "raw", "text", "string", "current"}

#: How sensitive the parts of a name are.
WEIGHTS = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 2, "credentials": 2, "auth": 1, "bearer": 2, "private": 1, "access": 1, "api": 1, "key": 1, "signing": 1, "encryption": 1, "salt": 1, "jwt": 2, "dsn": 1}
THRESHOLD = 4.0
_DUMMY = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|changeme|change[_-]?me|example.*|your[_-].*|placeholder|dummy|test|none|null|true|false|undefined|todo|redacted|password|secret|token|string)$")


#: Parts that stand with the words above in names written together.
AFFIXES = {"db", "my", "app", "user", "root", "admin", "client", "server", "aws", "smtp", "ftp", "ssh", "web", "mysql", "pg", "redis", "login", "master", "refresh", "session", "csrf", "id", "the", "new", "old", "prod", "dev", "shared", "service", "webhook", "hash", "value"}
_LONG = ("password", "passwd", "passphrase", "secret", "credential", "credentials", "apikey")


@lru_cache(1 << 14)
def _spelled(part: str) -> tuple[str, ...]:
    """The words of a part of a name in small letters: those of WEIGHTS and AFFIXES that it is written together from, or a
    long one that it ends in, or itself."""
    if part in WEIGHTS:
        return (part,)
    if part[-1:] == "s" and part[:-1] in WEIGHTS:
        return (part[:-1],)
    ways: list[tuple[str, ...] | None] = [()] + [None] * len(part)
    for end in range(1, len(part) + 1):
        for start in range(max(0, end - 12), end):
            if ways[start] is not None and (part[start:end] in WEIGHTS or part[start:end] in AFFIXES) and ways[end] is None:
                ways[end] = (*ways[start], part[start:end])
    if ways[-1]:
        return ways[-1]
    return next(((w,) for w in _LONG if part.endswith(w)), (part,))


@lru_cache(1 << 14)
def name_weight(name: str) -> int:
    """The weights of the words of a name in snake, kebab, dotted or camel case, or written together."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)
    words = {w for p in parts for w in _spelled(p.lower())}
    return sum(WEIGHTS.get(w, 0) for w in words) + (2 if "key" in words and words & {"api", "private", "access"} else 0)


def literal_score(literal: str) -> float:
    """Length, mixture of signs and entropy make a literal look secret; spaces and well-known stand-ins don't."""
    if len(literal) < 6 or _DUMMY.match(literal):
        return -10.0
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in Counter(literal).values())
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    return min(2.0, entropy / 2) + 0.5 * (kinds - 1) + 0.5 * (len(literal) >= 16) - 2.0 * bool(re.search(r"\s", literal))


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank of the kind, kind, end) of the fixed patterns."""
    found = [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


Term = tuple[str, str, int, int]


class Lexer:
    """Reads name-literal pairs from one text.  A term is (literal or name, its text, start, end)."""

    def __init__(self, text: str):
        self.text = text
        self._unclosed: set[str] = set()
        self._lines: tuple[list[int], list[int], list[int]] | None = None

    def pairs(self) -> list[tuple[str, list[Term]]]:
        """(name, terms) for each assignment, in order."""
        out, at, text = [], 0, self.text
        sections = [(m.start(), m[1]) for m in _SECTION.finditer(text)] if "[" in text else []
        outer: list[tuple[int, str]] = []  # mappings that the line stands in: (indentation, name)
        section = 0
        while m := _HEAD.search(text, at):
            name, begin, at = m["name"], m.start(), m.end()
            while section < len(sections) and sections[section][0] < begin:
                section += 1
            if name.lower() in GENERIC or text[at : at + 1] in ("\n", "\r", ""):
                line = text.rfind("\n", 0, begin) + 1
                indent = begin - line
                while outer and outer[-1][0] >= indent:
                    outer.pop()
                if text[at : at + 1] in ("\n", "\r", ""):
                    outer.append((indent, name))
                    continue
                if name.lower() in GENERIC:
                    name = outer[-1][1] if outer else sections[section - 1][1] if section else name
            if text[at - 1] == ":" and (typed := _ANNOTATION.match(text, at)):
                at = typed.end()
            found, at = self._value(at, begin)
            out += [(name, terms) for terms in found if terms]
        return out

    def _value(self, at: int, head: int) -> tuple[list[list[Term]], int]:
        """The values (each a list of terms) that begin at a place, and where to go on."""
        text = self.text
        if block := _BLOCK.match(text, at):
            term = self._block(head, block.end())
            return ([[term]] if term else []), block.end()  # what is in the block may hold pairs of its own
        at = _GAP.match(text, at).end()
        sign = text[at : at + 1]
        if sign and sign in "([{" and (text[at + 1 : at + 2].isspace() or text[at + 1 : at + 2] in ("", '"', "'", "`", "(", "[", "{", ")", "]", "}")):
            return ([], at + 1) if sign == "{" else self._items(at + 1, sign)
        if one := self._string(at):
            return self._sum(one[0], one[1], False)
        if not (bare := _BARE.match(text, at)):
            return [], at
        value, end = bare[0], bare.end()
        if _WHOLE_NAME.fullmatch(value):
            if _NEXT_HEAD.match(text, end):  # a = b = ...
                return [[("name", value, at, end)]], at
            return self._sum(("name", value, at, end), end, False)
        if value[-1] == "(":  # a call; its arguments may hold pairs
            return [], end
        if value[-1] == "\\" and text[end : end + 1] == "\n":
            terms, stop = [("literal", value[:-1], at, end - 1)], end
            while text[stop - 1] == "\\" and text[stop : stop + 1] == "\n" and (more := _BARE.match(text, _GAP.match(text, stop + 1).end())):
                stop = more.end()
                cut = stop - (text[stop - 1] == "\\" and text[stop : stop + 1] == "\n")
                terms.append(("literal", text[more.start() : cut], more.start(), cut))
            return [terms], stop
        return [[("literal", value, at, end)]], at + 1 if sign in "([{" and text[end : end + 1] in ('"', "'", "`") else end

    def _string(self, at: int) -> tuple[Term, int] | None:
        """The quoted literal that begins at a place, and the place behind it."""
        text = self.text
        if prefix := _PREFIX.match(text, at):
            at = prefix.end()
        quote = text[at : at + 1]
        if quote not in ('"', "'", "`"):
            return None
        if quote != "`":
            for mark, known in ((quote * 3, text.startswith(quote * 3, at)), (quote, text.startswith("-----BEGIN", at + 1))):
                if known and mark not in self._unclosed:
                    end = text.find(mark, at + len(mark))
                    if end >= 0:
                        return ("literal", text[at + len(mark) : end], at + len(mark), end), end + len(mark)
                    self._unclosed.add(mark)
        m = _STRING.match(text, at)
        return (("literal", m[0][1:-1], at + 1, m.end() - 1), m.end()) if m else None

    def _sum(self, first: Term, at: int, inside: bool) -> tuple[list[list[Term]], int]:
        """A sum from its first term on; ``inside`` brackets its terms may stand on several lines."""
        text, terms = self.text, [first]
        between = _BREAK if inside else _GAP
        while True:
            to = between.match(text, at).end()
            if plus := _PLUS.match(text, to):
                to = _BREAK.match(text, plus.end()).end()
            elif terms[-1][0] == "name" or text[to : to + 1] == ":":
                break
            if more := self._string(to):
                if not plus and _NEXT_HEAD.match(text, more[1]):  # the quoted name of the next pair
                    break
                terms.append(more[0])
                at = more[1]
            elif plus and (name := _WHOLE_NAME.match(text, to)):
                terms.append(("name", name[0], to, name.end()))
                at = name.end()
            else:
                break
        return [terms], at

    def _items(self, at: int, sign: str) -> tuple[list[list[Term]], int]:
        """The literals of a list, each a value of its own; literals with nothing between them are one."""
        out = []
        while True:
            to = _BREAK.match(self.text, at).end()
            if self.text[to : to + 1] == "," and out:
                at = to + 1
            elif one := self._string(to):
                more, at = self._sum(one[0], one[1], True)
                out += more
            else:
                return out, at

    def _block(self, head: int, at: int) -> Term | None:
        """The block scalar whose lines begin at a place: all lines indented deeper than the line of its head."""
        text = self.text
        if self._lines is None:
            starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
            indents = []
            for i, a in enumerate(starts):
                line = text[a : starts[i + 1] - 1 if i + 1 < len(starts) else len(text)]
                indents.append(len(line) - len(line.lstrip(" \t")) if line.strip() else 1 << 30)
            until, open_ = [len(starts)] * len(starts), []
            for i, indent in enumerate(indents):  # the next line that isn't indented deeper
                while open_ and indent <= indents[open_[-1]]:
                    until[open_.pop()] = i
                open_.append(i)
            self._lines = starts, indents, until
        starts, indents, until = self._lines
        line = bisect.bisect_right(starts, head) - 1
        end = until[line]
        stop = starts[end] if end < len(starts) else len(text)
        body = text[at:stop]
        start, stop = at + len(body) - len(body.lstrip()), at + len(body.rstrip())
        return ("literal", text[start:stop], start, stop) if start < stop else None


def pairs(text: str) -> list[tuple[str, list[Term]]]:
    """(name, terms) for each assignment; a term is (literal or name, its text, start, end)."""
    return Lexer(text).pairs()


def assigned(text: str) -> list[tuple[int, int, str, int]]:
    """Literals that reach a sensitive name, as (start, 3, "literal", end)."""
    known = pairs(text)
    names = {name for name, _ in known}
    # a bare word that nothing is assigned to is an unquoted literal if it mixes letters and digits
    known = [(name, [("literal", *t[1:]) if t[0] == "name" and t[1] not in names and re.search("[0-9]", t[1]) else t for t in terms]) for name, terms in known]
    flows: dict[str, set[str]] = {}
    for name, terms in known:
        for kind, value, _, _ in terms:
            if kind == "name":
                flows.setdefault(value, set()).add(name)
    weight: dict[str, int] = {}

    def reach(name: str) -> int:
        """The greatest weight of any name that the value of ``name`` flows to."""
        if name not in weight:
            seen, todo, best = {name}, [name], 0
            while todo:
                one = todo.pop()
                best = max(best, name_weight(one))
                fresh = flows.get(one, set()) - seen
                seen |= fresh
                todo += fresh
            weight[name] = best
        return weight[name]

    found = set()
    for name, terms in known:
        if not (score := reach(name)):
            continue
        whole = "".join(value for kind, value, _, _ in terms if kind == "literal")
        for kind, value, start, end in terms:
            if kind == "literal" and value and score + literal_score(whole if len(terms) > 1 else value) >= THRESHOLD:
                found.add((start, 3, "literal", end))
    return sorted(found)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        n = batch.num_rows
        counts, digests, spans = [[0] * n for _ in BASE], [nothing] * n, [""] * n
        hint = pc.match_substring_regex(batch.column(1), HINT).fill_null(False).to_pylist()
        for i, text in enumerate(batch.column(1)):
            if not hint[i]:
                continue
            text = text.as_py()
            base = base_spans(text)
            for _, k, _, _ in base:
                counts[k][i] += 1
            said = lambda rows: ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in rows)
            digests[i] = hashlib.sha256(said(base).encode()).hexdigest()
            spans[i] = said(sorted(base + assigned(text)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(spans)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for each row of ``docs``.

    Spans are kind:start:end in code points, by start and then kind (assign,
    access, hex, literal).  A null or empty text has none.  A very long text is
    read whole, in linear time.  Repeated rows, and rows that share or lack an id,
    are scanned alike, each on its own.  Further columns are left out.  An empty
    table gives an empty result.
    """
    return keyed_texts(docs, id_col, text_col).mapInArrow(_scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
