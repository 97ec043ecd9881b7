"""Secrets in text: base patterns and an assignment-aware lexer.

Three base patterns give spans of kind ``assign``, ``access`` and ``hex``. Beside them a small lexer
reads source and configuration syntax: it splits a text into names, literals, operators and line ends,
pairs names with the literals assigned to them (``name = "x"``, ``name: x``, ``"name": "x"``,
``name := x``, ``<name>x</name>``, ``private static final String name = "x"``, ``name: str = "x"``, also
with the literal on the next line), follows constants to a fixed point (``c = b`` where ``b = a + "y"``
and ``a`` has a literal, in any order), and scores each value by how sensitive its target name is and how
random it looks. The literals of a value that reaches ``MIN_SCORE`` give spans of kind ``literal``, unless
a base span covers them.

Every text is read whole and on its own; memory is that of one text. The lexer only looks at lines that
hold a sensitive name and, step by step, at those that assign a name used in a line it looks at, so prose
costs one pattern search. Each line is lexed once and each constant settled once.

Defined cases: null and empty texts have no spans; spans are in code points, end exclusive; columns
``doc_id`` and ``text`` are read, others are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The three base patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is the same as a run, dropped when shorter
MIN_VALUE, MIN_ACCESS = 6, 20

#: Parts of target names and how sensitive they are.
SENSITIVE = {
    "password": 1.0,
    "passwd": 1.0,
    "passphrase": 1.0,
    "pwd": 0.9,
    "secret": 1.0,
    "token": 0.9,
    "apikey": 1.0,
    "accesskey": 1.0,
    "privatekey": 1.0,
    "credential": 0.9,
    "credentials": 0.9,
    "auth": 0.6,
    "bearer": 0.7,
    "signature": 0.4,
    "key": 0.5,
}
MIN_SCORE = 1.2
_SENSITIVE = re.compile("(?ai)passw|passphrase|pwd|secret|token|key|credential|auth|bearer|signature")
_LEX = re.compile(
    r"""(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<name>[A-Za-z_][A-Za-z0-9_.-]*)"""
    r"""|(?P<word>[A-Za-z0-9/_.~-][A-Za-z0-9+/_.=~-]*)"""
    r"""|(?P<op>:=|=>|==+|[:=+<>])"""
    r"""|(?P<end>[\n;,{}()])"""
)
_DEFINES = re.compile(r"""(?a)(?<![\w.])([A-Za-z_]\w*)[^\S\n]*(?::[^=;:\n"']{0,80})?:?=(?![=>])""")
_OPEN_END = re.compile(r"(?:[=:+]\s*\(?|\\)\s*\Z")
_PLUS_NEXT = re.compile(r"[^\S\n]*\+[^\S\n]*[\"'A-Za-z_]")
_QUOTE_NEXT = re.compile(r"[^\S\n]*[\"']")
TAIL = 40  # of a line, looked at for an operator at its end
ASSIGNS = ("=", ":", ":=", "=>", ">")
TYPE_TOKENS = 8
#: Constants whose joined value is longer are left without a value, so that sums of sums stay small.
MAX_SUM = 4096
_SIMPLE_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

Span = tuple[int, int, str]
Token = tuple[str, str, int, int]  # kind, text, start, end
Value = tuple[str, tuple[tuple[int, int], ...]]  # and the spans of the literals it is made of


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def name_weight(name: str) -> float:
    """How sensitive a target name is: its most sensitive part or pair of parts."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    whole = [*parts, *(a + b for a, b in zip(parts, parts[1:]))]
    return max((SENSITIVE.get(p, 0.0) for p in whole), default=0.0)


def randomness(value: str) -> float:
    """0 to 1: entropy of the characters, kinds of characters and length together."""
    if len(value) < MIN_VALUE or " " in value:
        return 0.0
    share = [value.count(c) / len(value) for c in set(value)]
    entropy = -sum(p * math.log2(p) for p in share) / math.log2(max(len(value), 2))
    kinds = sum(any(test(c) for c in value) for test in (str.islower, str.isupper, str.isdigit)) + (not value.isalnum())
    return min(1.0, 0.5 * entropy + 0.125 * kinds + min(len(value), 32) / 128)


def _lines(text: str):
    """(start, line) of the lines that may hold an assignment worth reading."""
    at = 0
    for line in text.split("\n"):
        if ("=" in line or ":" in line or "<" in line) and _SENSITIVE.search(line):
            yield at, line
        at += len(line) + 1


def _statement(text: str, at: int) -> str:
    """The line at ``at`` and those that continue it: after an operator or a backslash, before a plus, or quoted text in an open bracket."""
    start, is_open = at, False
    while True:
        end = text.find("\n", start)
        if end < 0:
            return text[at:]
        opened, closed = text.rfind("(", start, end), text.rfind(")", start, end)
        is_open = opened > closed if max(opened, closed) >= 0 else is_open
        more = _OPEN_END.search(text, max(at, end - TAIL), end) or _PLUS_NEXT.match(text, end + 1)
        if not (more or (is_open and _QUOTE_NEXT.match(text, end + 1))):
            return text[at:end]
        start = end + 1


def _assigned(tokens: list[Token]):
    """(target name, is it an annotation's type, terms) of the assignments in a statement; a term is a token that may hold a value."""
    for k in range(len(tokens) - 2):
        kind, name, _, _ = tokens[k]
        if kind == "text":
            name = name[1:-1]
        if kind not in ("name", "text") or not name or tokens[k + 1][1] not in ASSIGNS:
            continue
        terms = _terms(tokens, k + 2, kind == "name" and tokens[k + 1][1] in ("=", ":="))
        if terms:
            yield name, k > 1 and tokens[k - 1][1] == ":", terms
        if tokens[k + 1][1] == ":" and kind == "name":  # name: type = value
            j = k + 2
            while j < min(len(tokens), k + 2 + TYPE_TOKENS) and (tokens[j][0] in ("name", "word") or tokens[j][1] in ("<", ">")):
                j += 1
            if k + 2 < j < len(tokens) and tokens[j][1] == "=":
                terms = _terms(tokens, j + 1, True)
                if terms:
                    yield name, False, terms


def _terms(tokens: list[Token], k: int, sums: bool) -> list[Token]:
    """The literals and names joined from token ``k`` on; behind a line end or a bracket only a quoted literal or a sum starts."""
    first = k
    while k < len(tokens) and tokens[k][1] in ("\n", "("):
        k += 1
    if k >= len(tokens) or tokens[k][0] not in ("text", "name", "word"):
        return []
    if k > first and tokens[k][0] != "text" and not (sums and k + 1 < len(tokens) and tokens[k + 1][1] == "+"):
        return []
    terms, split = [tokens[k]], k > first
    while True:
        j, plus = k + 1, False
        while j < len(tokens) and (tokens[j][1] == "+" or (tokens[j][1] == "\n" and (plus or split or _more(tokens, j)))):
            plus = plus or tokens[j][1] == "+"
            j += 1
        if j >= len(tokens) or tokens[j][0] not in ("text", "name") or not (plus or (tokens[j][0] == tokens[k][0] == "text" and split)):
            return terms
        terms.append(tokens[j])
        k = j


def _more(tokens: list[Token], j: int) -> bool:
    """Whether a plus comes next after line ends."""
    while j < len(tokens) and tokens[j][1] == "\n":
        j += 1
    return j < len(tokens) and tokens[j][1] == "+"


def _value(terms: list[Token], known: dict[str, Value], defined) -> tuple[Value | None, str]:
    """The value of a sum and its spans, or the first constant in it that has none yet."""
    value, spans, last = "", [], None
    for kind, token, a, z in terms:
        if kind == "name" and token in defined:
            if token not in known:
                return None, token
            part, more = known[token]
            if len(value) + len(part) > MAX_SUM:
                return None, ""
            value, last = value + part, None
            spans += [s for s in more if s not in spans]
        elif kind == "text" or len(terms) == 1:
            a, z, token = (a + 1, z - 1, token[1:-1]) if kind == "text" else (a, z, token)
            value += token
            if last is not None:
                spans[last] = (spans[last][0], z)
            elif token:
                last = len(spans)
                spans.append((a, z))
        else:
            last = None
    return (value, tuple(spans)), ""


def name_literal_pairs(text: str) -> list[tuple[str, Value]]:
    """(target name, its value and the spans of the literals it is made of), constants followed to a fixed point.

    A name stands for its latest assignment before, else for its first one behind. Constants that only refer to each
    other have no value.
    """
    statements = [list(_assigned(tokens)) for _, tokens in sorted(_chosen(text).items())]
    assigned = [a for statement in statements for a in statement]
    defined = {name for name, is_type, _ in assigned if not is_type and _SIMPLE_NAME.match(name)}
    known: dict[str, Value] = {}
    waiting: dict[str, list[int]] = {}
    pairs = []

    def settle(i: int, in_order: bool) -> bool:
        """Whether a name got its first value."""
        name, is_type, terms = assigned[i]
        value, missing = _value(terms, known, defined)
        if value is None:
            if missing:
                waiting.setdefault(missing, []).append(i)
            return False
        if not value[0]:
            return False
        pairs.append((name, value))
        new = name not in known and name in defined and not is_type
        if new or (in_order and name in defined and not is_type):
            known[name] = value
        return new

    for i in range(len(assigned)):
        settle(i, True)
    ready = [name for name in waiting if name in known]
    while ready:
        for i in waiting.pop(ready.pop(), ()):
            if settle(i, False):
                ready.append(assigned[i][0])
            if assigned[i][0] in waiting and assigned[i][0] in known:
                ready.append(assigned[i][0])
    return pairs


def _chosen(text: str) -> dict[int, list[Token]]:
    """Tokens by start of the statements that matter: those with a sensitive name, and those that assign a name used in one that matters."""
    chosen: dict[int, list[Token]] = {}
    seen: set[str] = set()
    places: dict[str, list[int]] | None = None
    todo = [at for at, _ in _lines(text)]
    while todo:
        used = set()
        for at in todo:
            if at in chosen:
                continue
            tokens = [(m.lastgroup, m.group(), at + m.start(), at + m.end()) for m in _LEX.finditer(_statement(text, at))]
            chosen[at] = tokens
            used.update(t for _, _, terms in _assigned(tokens) for kind, t, _, _ in terms if kind == "name" and _SIMPLE_NAME.match(t))
        used -= seen
        seen |= used
        if used and places is None:
            places = {}
            for m in _DEFINES.finditer(text):
                places.setdefault(m[1], []).append(text.rfind("\n", 0, m.start()) + 1)
        todo = [at for name in used for at in places.get(name, ())]
    return chosen


def literal_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans of sensitive literals that no base span covers."""
    covered = sorted((a, z) for a, z, _ in base)
    starts, reach = [a for a, _ in covered], list(itertools.accumulate((z for _, z in covered), max))
    found = set()
    for name, (value, spans) in name_literal_pairs(text):
        if 0 < name_weight(name) and name_weight(name) + randomness(value) >= MIN_SCORE:
            for a, z in spans:
                before = bisect.bisect_right(starts, a)
                if not before or reach[before - 1] < z:
                    found.add((a, z, "literal"))
    return sorted(found)


def joined(spans: list[Span]) -> str:
    """kind:start:end by start, then by kind as listed."""
    return ",".join(f"{k}:{a}:{z}" for a, z, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, spans that the lexer adds)"""
    if not text:
        return [], []
    base = base_spans(text)
    return base, literal_spans(text, base)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: counts of base spans, their SHA-256 and all spans."""

    def work(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, more = scan(text)
                n = [sum(k == kind for _, _, kind in base) for k in KINDS[:3]]
                rows.append((i, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(work, SCHEMA)
