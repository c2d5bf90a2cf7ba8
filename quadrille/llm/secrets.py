"""Secret scan: base patterns plus assignment-aware lexing.

One pass reads a text as source or configuration: it steps over comments and
string literals and stops at signs. A sign's name is the identifier, quoted key
or subscript before it; its literals are the strings, words, lists and joined
parts after it. Other pairs come from calls that set something
(``setToken("...")``, ``put("token", "...")``), XML elements and name / value
attributes, and YAML blocks. A name on the right stands for the constant that
was assigned to it, until the indentation falls below that of its assignment.

Names and literals form a graph in which each assignment points to its parts.
Weights of sensitive names run down it once, so chains of constants cost no more
than their length, and a literal is one span however many names it reaches. It
counts if the heaviest name and its own entropy are large enough together.

Defined cases: a null text is empty and has no spans; names, blanks and literals
may have any length, and work is linear in the text's; an unclosed quote is a
plain character, and so are others of its kind up to the line's end; repeated
rows give repeated results; other columns of the input play no part.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import map_texts

# The base patterns and the least length of what they must catch.
KINDS = ("assign", "access", "hex", "named")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

# Words that make a name sensitive, and literals that are no secret.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 2, "secret": 3, "token": 2, "apikey": 3, "key": 1, "credential": 3, "credentials": 3, "auth": 1, "private": 2, "access": 1, "signing": 1, "encryption": 1, "bearer": 2, "salt": 1}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|your[_-].*|change[_-]?me|example|placeholder|none|null|true|false|todo|test|dummy|redacted|masked)$")

# First words of calls that set what they are given, and attributes that name what ``value`` holds.
SETTERS = frozenset({"set", "with", "put", "add", "use", "store", "save", "update"})
NAMING = frozenset({"name", "key", "id", "property"})

#: Where something begins: a quote, comment, sign, call, tag or a tag's end.
EVENT = re.compile(r'"""|\'\'\'|["\'`#]|//|/\*|<!--|<(?=[A-Za-z])|:=|=>|==|=~?|:(?![:/=])|[(>]|(?m:^[ \t]*(?:;|--))')
STRING = {
    '"': re.compile(r'"(?:[^"\\\n]|\\[^\n])*+"'),
    "'": re.compile(r"'(?:[^'\\\n]|\\[^\n])*+'"),
    "`": re.compile(r"`[^`\n]*+`"),
}
#: An identifier, read backwards from a sign.
NAME_BACK = re.compile(r"(?a)\n?[ \t]*+([\w.-]*[A-Za-z_])(?![\w.$-])")
WORD = re.compile(r"(?a)[A-Za-z0-9_$+/][\w$+/.~-]*+={0,2}")
VALUE = re.compile(r"""[ \t]*+(?:\\?\n[ \t]*+(?=["'`(\[]))?""")
PREFIX = re.compile(r"""(?i)[rbfu]{1,2}(?=["'])""")
JOINED = re.compile(r"[ \t]*+(?:\+|\.\.|\|\||&)[ \t]*+")
BETWEEN = re.compile(r"[\s,+]*+")
BLOCK = re.compile(r"[ \t]*+[|>][+-]?[0-9]?[+-]?[ \t]*+\n")
INDENT = re.compile(r"(?m)^([ \t]*+)(?=[^\s])")
TAG_NAME = re.compile(r"(?a)[\w:.-]++")
IDENTIFIER = re.compile(r"(?a)[A-Za-z_][\w.-]*+")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> int:
    """Sum of the weights of the sensitive words in a name, as camelCase or snake_case, plurals too."""
    words = [w.lower() for w in PARTS.findall(name)]
    joined = {"".join(words[i : i + 2]) for i in range(len(words) - 1)}
    return sum(SENSITIVE.get(w, SENSITIVE.get(w.removesuffix("s"), 0)) for w in {*words, *joined})


def literal_score(text: str) -> float:
    """Bits of entropy of all characters of the best part between white space together; 0 for short or placeholder texts."""
    if PLACEHOLDER.match(text):
        return 0.0
    best = 0.0
    for part in text.split():
        n = len(part)
        if n >= 6 and not PLACEHOLDER.match(part):
            best = max(best, -sum(c * math.log2(c / n) for c in Counter(part).values()))
    return best


class Pairs:
    """The graph of names and literals of one text."""

    def __init__(self):
        self.spans: list[tuple[int, int] | None] = []  # of literals; None for an assignment
        self.parts: list[list[int]] = []  # of assignments
        self.names: list[str] = []
        self.literals: dict[tuple[int, int], int] = {}

    def literal(self, start: int, end: int) -> int:
        at = self.literals.get((start, end))
        if at is None:
            at = self.literals[start, end] = self._add((start, end), [], "")
        return at

    def assign(self, name: str, parts: list[int]) -> int:
        return self._add(None, list(dict.fromkeys(parts)), name)

    def _add(self, span, parts, name) -> int:
        self.spans.append(span)
        self.parts.append(parts)
        self.names.append(name)
        return len(self.spans) - 1

    def weighted(self) -> list[tuple[int, int, int]]:
        """(start, end, weight) of each literal by the heaviest name that it reaches; parts always come before what they are part of."""
        weight = [0] * len(self.spans)
        found = []
        scored: dict[str, int] = {}
        for i in range(len(self.spans) - 1, -1, -1):
            if self.spans[i] is None:
                name = self.names[i]
                if name not in scored:
                    scored[name] = name_score(name)
                own = weight[i] = max(weight[i], scored[name])
                for part in self.parts[i]:
                    weight[part] = max(weight[part], own)
            elif weight[i]:
                found.append((*self.spans[i], weight[i]))
        return found


class Lexer:
    """Reads a text once, from sign to sign."""

    def __init__(self, text: str):
        self.text, self.back = text, text[::-1]
        self.pairs = Pairs()
        self.constants: dict[str, tuple[int, int]] = {}  # name: (indentation, assignment)
        self.open: list[tuple[int, str]] = []  # constants by rising indentation
        self.indented = 0  # up to where indentation was read
        self.depth = 0  # and what it was there
        self.plain: dict[str, int] = {}  # a quote is plain before this place
        self.closed: dict[str, int] = {}  # no such end from this place on
        self.string: tuple[int, int] | None = None  # the last string literal, quotes included
        self.body: tuple[int, int] = (0, 0)  # and what is in it
        self.pending: str | None = None  # what a tag's value will be the value of

    def after(self, mark: str, at: int) -> int:
        """The place behind the next ``mark``, or -1; a mark that is missing is sought only once."""
        if at >= self.closed.get(mark, len(self.text) + 1):
            return -1
        found = self.text.find(mark, at)
        if found < 0:
            self.closed[mark] = at
            return -1
        return found + len(mark)

    def quoted(self, at: int) -> tuple[int, int, int] | None:
        """(start, end, place behind) of the string literal that begins here."""
        text, quote = self.text, self.text[at]
        if text.startswith(quote * 3, at) and quote != "`" and (end := self.after(quote * 3, at + 3)) > 0:
            return at + 3, end - 3, end
        if at < self.plain.get(quote, 0) or (quote == "'" and at and (text[at - 1].isalnum() or text[at - 1] == "_")):
            return None
        m = STRING[quote].match(text, at)
        if not m:
            line = text.find("\n", at)
            self.plain[quote] = len(text) if line < 0 else line
            return None
        if quote == "'" and text[m.end() : m.end() + 1].isalnum():
            return None
        return at + 1, m.end() - 1, m.end()

    def scope(self, at: int) -> int:
        """The indentation of the line at a place; constants of deeper blocks that ended before it are forgotten."""
        for m in INDENT.finditer(self.text, self.indented, at):
            self.depth = len(m[1])
            while self.open and self.open[-1][0] > self.depth:
                depth, name = self.open.pop()
                if self.constants.get(name, (-1, 0))[0] == depth:
                    del self.constants[name]
        self.indented = at
        return self.depth

    def name_before(self, at: int) -> str | None:
        """The name that ends before a sign."""
        text = self.text
        end = at
        while end and text[end - 1] in " \t":
            end -= 1
        if self.string and end:
            if self.string[1] == end or (text[end - 1] == "]" and text[self.string[1] : end].strip() == "]"):
                key = text[self.body[0] : self.body[1]]
                return key if IDENTIFIER.fullmatch(key) else None
        m = NAME_BACK.match(self.back, len(text) - at)
        return m[1][::-1] if m else None

    def term(self, at: int, listed: bool, lone: bool) -> tuple[int, int] | None:
        """(part, place behind) of a string, constant or word; a ``lone`` word must end its line or item."""
        text = self.text
        if m := PREFIX.match(text, at):
            at = m.end()
        if text[at : at + 1] in ("'", '"', "`") and (found := self.quoted(at)):
            return self.pairs.literal(found[0], found[1]), found[2]
        if m := WORD.match(text, at):
            if m[0] in self.constants:
                return self.constants[m[0]][1], m.end()
            if listed and text[m.end() : m.end() + 1] not in ("", ",", "]", ")", " ", "\n", "\r", "\t"):
                return None
            if not lone or text[m.end() : m.end() + 1] in ("", "\n", "\r", ",", ";"):
                return self.pairs.literal(m.start(), m.end()), m.end()
        return None

    def value(self, at: int, colon: bool) -> list[int]:
        """The parts of what is assigned: terms that are joined, or a list of them."""
        at = VALUE.match(self.text, at).end()
        found: list[int] = []
        if self.text[at : at + 1] in ("[", "("):
            at = BETWEEN.match(self.text, at + 1).end()
            while got := self.term(at, True, False):
                found.append(got[0])
                at = BETWEEN.match(self.text, got[1]).end()
            return found
        while got := self.term(at, False, colon):
            found.append(got[0])
            if not (m := JOINED.match(self.text, got[1])):
                break
            at = m.end()
        return found

    def block(self, at: int, depth: int) -> tuple[int, int, int]:
        """(start, end, place behind) of the lines that are indented deeper."""
        start = end = -1
        while at < len(self.text):
            line = self.text.find("\n", at)
            stop = len(self.text) if line < 0 else line
            if body := self.text[at:stop].strip():
                first = self.text.index(body[0], at)
                if first - at <= depth:
                    break
                start, end = first if start < 0 else start, first + len(body)
            at = stop + 1
        return start, end, min(at, len(self.text))

    def assign(self, name: str, parts: list[int], depth: int) -> None:
        if parts:
            self.constants[name] = (depth, self.pairs.assign(name, parts))
            self.open.append((depth, name))

    def call(self, at: int) -> None:
        """A call's literals reach its name if it sets something; a first string that is a name gets the second."""
        if self.text[at + 1 : at + 2] in ("", ")", " ") or not (m := NAME_BACK.match(self.back, len(self.text) - at)):
            return
        name = m[1][::-1].rsplit(".", 1)[-1]
        if (first := PARTS.search(name)) and first[0].lower() in SETTERS:
            parts = self.value(at, False)
            spans = [self.pairs.spans[p] for p in parts]
            if len(parts) > 1 and spans[0] and IDENTIFIER.fullmatch(key := self.text[slice(*spans[0])]):
                self.pairs.assign(key, parts[1:])
            elif parts:
                self.pairs.assign(name, parts)

    def element(self, at: int) -> None:
        """The text of an element whose end tag follows reaches its name."""
        m = TAG_NAME.match(self.text, at + 1)
        close = self.after(">", m.end())
        if close < 0 or self.text[close - 2] == "/" or not name_score(m[0]):
            return
        end = self.after("<", close)
        if end > 0 and self.text.startswith(f"/{m[0]}", end) and (body := self.text[close : end - 1].strip()):
            start = self.text.index(body, close, end)
            self.pairs.assign(m[0], [self.pairs.literal(start, start + len(body))])

    def read(self) -> Pairs:
        text, at = self.text, 0
        while m := EVENT.search(text, at):
            at, kind = m.end(), m[0].strip()
            here = m.end() - len(kind)
            if kind[0] in "\"'`":
                if found := self.quoted(here):
                    self.string, self.body, at = (here, found[2]), (found[0], found[1]), found[2]
            elif kind in ("#", "//", ";", "--"):
                before = text[here - 1 : here]
                if not before or before.isspace() or kind == "//" and before in ";,{}()":
                    line = text.find("\n", at)
                    at = len(text) if line < 0 else line
            elif kind in ("/*", "<!--"):
                if (end := self.after("*/" if kind == "/*" else "-->", at)) > 0:
                    at = end
            elif kind == "<":
                self.pending = None
                self.element(here)
            elif kind == ">":
                self.pending = None
            elif kind == "(":
                self.call(here)
            elif kind not in ("==", "=~") and (name := self.name_before(here)):
                depth = self.scope(here)
                if kind == ":" and (m := BLOCK.match(text, at)):
                    start, end, at = self.block(m.end(), depth)
                    if start >= 0:
                        self.assign(name, [self.pairs.literal(start, end)], depth)
                    continue
                parts = self.value(at, kind == ":")
                if kind == "=" and parts and (span := self.pairs.spans[parts[0]]):
                    if name.lower() in NAMING:
                        self.pending = text[span[0] : span[1]]
                    elif name.lower() == "value" and self.pending:
                        self.pairs.assign(self.pending, parts)
                self.assign(name, parts, depth)
        return self.pairs


def lexed_pairs(text: str) -> list[tuple[str, int, int, str]]:
    """(name, start, end, literal): every literal that reaches a name, constants followed. For short texts: names share literals."""
    pairs = Lexer(text).read()
    found = []
    for i, name in enumerate(pairs.names):
        if pairs.spans[i] is None:
            seen, todo = set(), [i]
            while todo:
                for part in pairs.parts[todo.pop()]:
                    if part not in seen:
                        seen.add(part)
                        todo.append(part)
            found += [(name, *pairs.spans[p], text[slice(*pairs.spans[p])]) for p in sorted(seen) if pairs.spans[p]]
    return found


def scan(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, kind's number, end) in code points, end exclusive, sorted."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    if not ("=" in text or ":" in text or "(" in text or "</" in text):
        return base
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))
    added = []
    for start, end, weight in Lexer(text).read().weighted():
        covered = (i := bisect_right(starts, start)) and reach[i - 1] >= end
        if weight >= 2 and not covered and literal_score(text[start:end]) * weight >= 36:
            added.append((start, 3, end))
    return sorted([*base, *added])


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans``, an array of (kind, start, end)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(x or "")] for x in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

        return each

    return map_texts(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), make, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact_secrets(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mask`` and its length set anew; nulls stay.

    All other columns are kept as they are, whatever their names. Spans that
    overlap are masked as one.
    """
    at = docs.columns.index(text)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for x in batch.column(at).to_pylist():
                if x and (spans := scan(x)):
                    parts, last = [], 0
                    for s, _, e in spans:
                        if s >= last:
                            parts += [x[last:s], mask]
                        last = max(last, e)
                    x = "".join([*parts, x[last:]])
                out.append(x)
            columns = batch.columns
            columns[at] = pa.array(out, batch.schema.field(at).type)
            return pa.RecordBatch.from_arrays(columns, batch.schema.names)

        return each

    out = map_texts(docs, make, docs.schema, text)
    if n_chars and n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(text).isNull(), F.col(n_chars)).otherwise(F.char_length(text).cast(docs.schema[n_chars].dataType)))
    return out


def digest(spans: str, base: bool) -> F.Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    chosen = F.filter(spans, lambda x: x["kind"] != "named") if base else F.col(spans)
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Per document: counts of the base spans, their digest, and all spans."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(digest("spans", True), 256).alias("base_sha256"), digest("spans", False).alias("spans"))
