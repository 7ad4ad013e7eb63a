"""Secret scan (operator 9): fixed patterns plus assignment-aware lexing.

Base spans come from three patterns.  The lexer reads source and configuration syntax into name-literal pairs, follows
names that stand for literals (``k = "..."`` then ``password = k``), joins literals that are added up, takes literals in
triple quotes and YAML blocks line by line, and scores each literal by how sensitive its target's name is and by how random
the literal looks.  A name that is set anew stands for its new value from there on, and one that is set in an indented
block stands for it only as long as lines are indented as far.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import as_bytes, chunks

KINDS = ("assign", "access", "hex", "named")
_FLAGS = re.ASCII
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", _FLAGS)
HEX = re.compile(r"[0-9a-f]+", _FLAGS)
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

# a name begins where no other one goes on and is never given back in part: long runs of letters take one step a character
_NAME = r"""(?P<q>["']?)(?<![A-Za-z0-9_.\-])(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?P=q)"""
_LITERAL = r"""(?P<lit>"{3}(?:[^"\\]|\\.|"(?!""))*"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|`[^`\n]*`|[|>][+-]?(?=[ \t]*\n)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[^\s,;#"'(){}\[\]<>]+)"""
_PAIR = re.compile(_NAME + r"[ \t]*(?P<op>:=|=>|=(?!=)|:(?!//))[ \t]*" + _LITERAL, _FLAGS)
_LINE = re.compile(r"\n(?P<indent>[ \t]*)(?P<body>[^\n]*)")
_PLUS = re.compile(r"""[ \t]*[+.][ \t]*("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[A-Za-z_][A-Za-z0-9_]*)""", _FLAGS)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: How sensitive a word in a name is.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "auth": 0.6, "key": 0.5, "signature": 0.5, "cookie": 0.5, "salt": 0.5, "dsn": 0.5}
#: Pairs of words that say more than each alone.
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("encryption", "key"): 1.0, ("signing", "key"): 1.0, ("client", "id"): 0.5, ("connection", "string"): 0.6}
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|none|null|true|false|undefined|change_?me|example.*|your[_-].*|placeholder.*|\$\{.*\}|\$[A-Z_]+|%\(.*\).*|<.*>)$")
THRESHOLD = 0.5
#: A literal of one kind of characters counts for more if its name is so sensitive, and it so long and so random.
STRONG, LONG, RANDOM = 0.9, 14, 3.0


def name_score(name: str) -> float:
    words = [w.lower() for w in _PART.findall(name)]
    return max([SENSITIVE.get(w, 0.0) for w in words] + [SENSITIVE_PAIRS.get(p, 0.0) for p in zip(words, words[1:], strict=False)] + [0.0])


def literal_score(text: str, counts: Counter | None = None, strong: bool = False) -> float:
    """0 to 1: bits of Shannon entropy a character, weighed by length and by how many kinds of characters there are.

    Of a long value, text may be its ends only, and counts are of all its characters.
    """
    counts = Counter(text) if counts is None else counts
    size = sum(counts.values())
    if size < 8 or _PLACEHOLDER.match(text) or any(c.isspace() for c in counts):
        return 0.0
    bits = -sum(n / size * math.log2(n / size) for n in counts.values() if n / size)
    kinds = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    one = 0.7 if strong and size >= LONG and bits >= RANDOM else 0.4
    return min(1.0, bits / 3.5) * min(size, 12) / 12 * (one if kinds == 1 else 1.0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def _unquoted(start: int, end: int, text: str) -> tuple[int, int]:
    quote = 3 if end - start >= 6 and text.startswith(('"""', "'''"), start) else 1
    return start + quote, end - quote


def _lines(start: int, end: int, text: str) -> list[tuple[int, int]]:
    """Spans of the lines of a literal without the spaces around them; a literal of one line is a span as it is."""
    if "\n" not in text[start:end]:
        return [(start, end)]
    out = []
    for line in text[start:end].split("\n"):
        if bare := line.strip():
            out.append((start + line.index(bare), start + line.index(bare) + len(bare)))
        start += len(line) + 1
    return out


def _indent(text: str, at: int) -> tuple[int, int]:
    """Where the line of a place begins, and how far it is indented."""
    begin = text.rfind("\n", 0, at) + 1
    return begin, len(text[begin:at]) - len(text[begin:at].lstrip(" \t"))


def _block(text: str, at: int, indent: int) -> tuple[list[tuple[int, int]], int]:
    """Lines that follow a place and are indented further, or empty; and where they end."""
    spans = []
    at = text.find("\n", at)
    while at >= 0 and (m := _LINE.match(text, at)) and (not m["body"].strip() or len(m["indent"]) > indent):
        if m["body"].strip():
            spans.append((m.start("body"), m.start("body") + len(m["body"].rstrip())))
        at = m.end() if m.end() < len(text) else -1
    return spans, at if at >= 0 else len(text)


class _Value:
    """What a literal or sum stands for: its parts are spans and other values, which are shared and never copied."""

    def __init__(self, text: str, parts: list[tuple[int, int] | _Value]):
        self.parts = parts
        self.seen = False
        if len(parts) == 1 and isinstance(parts[0], _Value):
            self.counts, self.head, self.tail = parts[0].counts, parts[0].head, parts[0].tail
            return
        self.counts: Counter = Counter()
        self.head = self.tail = ""
        for p in parts:
            own = p if isinstance(p, _Value) else None
            if own:
                for c, n in own.counts.items():
                    self.counts[c] += n
            else:
                self.counts.update(text[p[0] : p[1]])
            if len(self.head) < 64:
                self.head = (self.head + (own.head if own else text[p[0] : min(p[1], p[0] + 64)]))[:64]
            self.tail = (own.tail if own else text[max(p[0], p[1] - 1) : p[1]]) or self.tail

    def score(self, strong: bool) -> float:
        return literal_score(self.head if sum(self.counts.values()) <= 64 else self.head + self.tail, self.counts, strong)

    def spans(self) -> Iterator[tuple[int, int]]:
        """All spans, but for those of values that were asked before."""
        todo: list[tuple[int, int] | _Value] = [self]
        while todo:
            p = todo.pop()
            if not isinstance(p, _Value):
                yield p
            elif not p.seen:
                p.seen = True
                todo += p.parts


class _Scopes:
    """What names stand for: each block, known by its indentation, sees its own names and those of blocks around it."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, dict[str, _Value]]] = [(0, {})]

    def at(self, indent: int) -> None:
        while len(self.stack) > 1 and self.stack[-1][0] > indent:
            self.stack.pop()
        if self.stack[-1][0] < indent:
            self.stack.append((indent, {}))

    def get(self, name: str) -> _Value | None:
        return next((names[name] for _, names in reversed(self.stack) if name in names), None)

    def set(self, name: str, value: _Value) -> None:
        self.stack[-1][1][name] = value


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of literals whose targets' names and own looks score THRESHOLD or more together."""
    known = _Scopes()
    out: dict[tuple[int, int], None] = {}
    line, indent, past = -1, 0, 0
    for m in _PAIR.finditer(text):
        name, at = m["name"], m.start("lit")
        if m.start() < past:  # within a block of text
            continue
        if text.find("\n", max(line, 0), m.start()) >= 0 or line < 0:
            line, indent = _indent(text, m.start())
            known.at(indent)
        line = m.start()
        pieces: list[tuple[int, int] | _Value] = []

        def add(start: int, end: int, pieces=pieces) -> bool:
            """Whether it is a literal or stands for one."""
            raw = text[start:end]
            if raw[0] in "\"'`":
                pieces.extend(_lines(*_unquoted(start, end, text), text))
            elif raw[0] in "|>":
                return False
            elif (value := known.get(raw)) is not None:
                pieces.append(value)
            else:
                return False
            return True

        if add(at, m.end("lit")):
            end = m.end("lit")
            while (more := _PLUS.match(text, end)) and add(more.start(1), more.end(1)):
                end = more.end()
        elif text[at] in "|>":
            pieces, past = _block(text, m.end("lit"), indent)
        else:
            pieces.append((at, m.end("lit")))
        value = _Value(text, pieces)
        known.set(name, value)
        sensitive = name_score(name)
        if sensitive and sensitive * value.score(sensitive >= STRONG) >= THRESHOLD:
            out |= dict.fromkeys(value.spans())
    return sorted((a, 3, b) for a, b in out if a < b)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all: lexed ones that lie within a base span are not repeated."""
    base = base_spans(text)
    if "=" not in text and ":" not in text:
        return base, base
    more, far, k = [], -1, 0
    for s in lexed_spans(text):
        while k < len(base) and base[k][0] <= s[0]:
            far, k = max(far, base[k][2]), k + 1
        if s[2] > far:
            more.append(s)
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*b"0123456789abcdef"]] = True


def suspects(texts: list[bytes]) -> list[bool]:
    """Which texts may have a span; the others have none, as no pattern can begin in them."""
    out = []
    for a, b in chunks(texts):
        data = np.frombuffer(b"\n".join([b"", *texts[a:b], b""]), np.uint8)
        hexes = _HEX_BYTE[data]
        edges = np.flatnonzero(hexes[1:] != hexes[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        begins = np.cumsum([1] + [len(t) + 1 for t in texts[a:b]])
        has = np.zeros(b - a, bool)
        has[np.searchsorted(begins, starts[ends - starts >= 24], "right") - 1] = True
        for t, hex_run in zip(texts[a:b], has.tolist(), strict=True):
            out.append(hex_run or b"AKIA" in t or b"=" in t or b":" in t and any(k in t.lower() for k in (*_KEYWORDS, b"key", b"pwd", b"auth", b"pass", b"cred", b"salt", b"dsn", b"sign", b"cookie", b"client", b"connection")))
    return out


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_NONE = hashlib.sha256(b"").hexdigest()


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        rows = []
        for t, suspect in zip(texts, suspects(texts), strict=True):
            if not suspect:
                rows.append((0, 0, 0, _NONE, ""))
                continue
            base, every = all_spans(t.decode("utf-8", "surrogatepass"))
            n = Counter(k for _, k, _ in base)
            rows.append((n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[x.split()[0] for x in _OUT.split(", ")])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): counts and digest of the base spans, and all spans as text.

    Offsets are code points, ends exclusive.  A null text is empty; null and repeated ids stay; other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, _OUT)


def redacted(text: str, mark: str) -> str:
    """The text with every secret replaced; of an assignment only the value is."""
    _, every = all_spans(text)
    spans = []
    for a, k, b in every:
        spans.append((ASSIGN.match(text, a).start(2), b) if k == 0 else (a, b))
    out, at = [], 0
    for a, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def _redact(batches: Iterable[pa.RecordBatch], mark: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        texts = as_bytes(column)
        flags = suspects(texts)
        if any(flags):
            new = [None if not ok else redacted(t.decode("utf-8", "surrogatepass"), mark) if f else t.decode("utf-8", "surrogatepass") for t, f, ok in zip(texts, flags, column.is_valid().to_pylist(), strict=True)]
            names = batch.schema.names
            batch = batch.set_column(names.index("text"), "text", pa.array(new, column.type))
            if "n_chars" in names:
                old = batch.column("n_chars")
                sizes = [len(x) if f and x is not None else n for x, f, n in zip(new, flags, old.to_pylist(), strict=True)]
                batch = batch.set_column(names.index("n_chars"), "n_chars", pa.array(sizes, old.type))
        yield batch


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mark; n_chars, where there is one, follows.  All rows and columns stay."""
    return docs.mapInArrow(partial(_redact, mark=mark), docs.schema)
