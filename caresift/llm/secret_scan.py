"""Secret scans by assignment-aware lexing, beside three plain patterns.

Source and configuration text is read as name-literal pairs.  The left side is a name, dotted or dashed, bare or a quoted
key, with subscripts (``config["passphrase"]``), a type after it (``token: str``, ``password string``) or before it
(``String password``), or an XML element.  The value is a literal in single, double, triple or back quotes with a prefix or
without, over lines where its quotes allow that, on the next line, a block of indented lines (``key: |``), or a bare word.
Sums of literals and names, and chains (``a = b = "x"``), are followed.  A value may stand in brackets: a sum in round ones,
elements of a list, keys of an object, which add to the names around them (``{"pwd": {"value": "x"}}``).  The default of a
lookup (``os.environ.get("DB_PASSWORD", "x")``) counts for the name looked up too, and what a setter is given
(``conn.setPassword("x")``) for the name that it sets.

A literal is scored by its own looks and by the names it reaches: the name it is assigned to and, through ``other = name``
and ``other = name + "literal"``, names that its constant is handed on to, to a fixed point.

Refused by rule: references, that is bare words with a bracket after them, dotted ones and snake case ones of words and
short numbers, and bare words that are sensitive names themselves (``token = get_token()``, ``secret = settings.KEY``,
``credential=default_credential``); unpacking (``a, b = "x", "y"``), literals that are only passed by place
(``login("x")``), comparisons, lists that begin with a name, and keys nested by indentation alone.
Comments are read like code, as a secret in a comment is as open as one beside it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caresift.llm._support import documents

#: The base kinds, in their order, with the group that has to be so long at least.
BASE = (
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
KINDS = ("assign", "access", "hex", "literal")
#: Quoted literals: triple ones over lines, back quotes over lines, others within one.  Nothing is given back (possessive),
#: so that a search stays linear.
_TRIPLE = r'''"{3}((?:[^"\\]|\\.|"(?!""))*+)"{3}|'{3}((?:[^'\\]|\\.|'(?!''))*+)'{3}'''
_PLAIN = r'''"([^"\\\n]*+(?:\\.[^"\\\n]*+)*+)"|'([^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'|`([^`\\]*+(?:\\.[^`\\]*+)*+)`'''
_QUOTED = rf"(?:[rRbBfFuUlL]{{1,2}}+(?=[\"\'`]))?+(?:{_TRIPLE}|{_PLAIN})"
_SPACE = r"[\x20\t]*+"
#: One pair.  Groups: name, subscripts, second word, bracket before a quote; then the value's groups as VALUES says.
PAIR = re.compile(
    rf"""(?s)(?<![\w.$\-])([A-Za-z_$][A-Za-z0-9_.$\-]*+)((?:\[{_SPACE}["']?[A-Za-z0-9_.$\-]++["']?{_SPACE}\])*+)["'`]?+"""
    rf"""(?:{_SPACE}:{_SPACE}[A-Za-z_][A-Za-z0-9_.\[\],|\x20]*+(?==(?!=))|[\x20\t]++([A-Za-z_$][A-Za-z0-9_.$*]*+)(?={_SPACE}:?=(?![=>])))?+"""
    rf"""{_SPACE}(?::=|=>|\?=|\+=|=(?!=)|:(?![:/=])){_SPACE}(?:([(\[{{])\s*+(?=[rRbBfFuU]{{0,2}}["'`])|\\?\r?\n\s*+(?=[rRbBfFuU]{{0,2}}["'`]))?+"""
    rf"""(?:{_QUOTED}|[|>][+-]?{_SPACE}\r?\n((?:[\x20\t]++[^\n]*+(?:\n|\Z))++)|([^\s"'`,;(){{}}\[\]<>]++))"""
)
BRACKET = 4
VALUES = range(5, 12)  #: two triple quotes, three plain ones, a block, a bare word
BLOCK, BARE = 10, 11
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:\-]*+)(?:\s[^<>]*+)?>\s*+([^<>]*+)</")
#: What follows a value in a sum of names and literals, or in a chain of assignments.
MORE = re.compile(rf"""(?s)\s*+(?:\+|\\|\.(?=\s))?+\s*+{_QUOTED}|\s*+\+\s*+([A-Za-z_][A-Za-z0-9_.]*+)""")
#: The next element of a list; what makes a quoted word in an object a key; a lookup's name and default; a setter's name and value.
LISTED = re.compile(rf"(?s)\s*+,\s*+{_QUOTED}")
KEYED = re.compile(r"\s*+(?::(?!:)|=>)")
LOOKUP = re.compile(rf"(?s)\(\s*+(?:{_QUOTED}|[A-Za-z_][A-Za-z0-9_.]*+)\s*+,\s*+{_QUOTED}")
CALL = re.compile(rf"(?s)\((?:[^()\"'`\n]|{_QUOTED})*+\)")
SETTER = re.compile(rf"(?s)(?<![A-Za-z0-9])set_?([A-Za-z][A-Za-z0-9_]*+)\(\s*+{_QUOTED}\s*+\)")
BRACES = re.compile(r"[{}]")
#: So many of the objects around a key add their names to it.
INNERMOST = 8
WORD = re.compile(r"[A-Za-z]*\d{0,2}")
CHAIN = re.compile(r"[\x20\t]*+=(?!=)")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+")
PART = re.compile(r"\S+")
INNER = re.compile(r"\S\s+\S")
#: Parts of names and what each says of a literal assigned to it.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authorization": 0.7, "bearer": 0.8, "auth": 0.6, "signature": 0.5, "key": 0.4,
}
HARMLESS = re.compile(r"(?i)^(?:true|false|null|none|nil|undefined|example|changeme|test|dummy|placeholder|todo|x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(?\w+\)?s?)$")
#: What is left of the score of a literal with an inner blank (a passphrase, or prose).
BLANK = 0.75


@dataclass(frozen=True)
class ScanConfig:
    threshold: float = 1.0  #: least score of a literal
    shortest: int = 6  #: least number of characters of a literal


def name_score(name: str) -> float:
    """Of the most telling part of a dotted, dashed, snake or camel case name; joined neighbours count as parts too."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0.0) for p in (*parts, *joined)), default=0.0)


def literal_score(text: str) -> float:
    """0 to 1: bits a character and length, less with an inner blank; 0 for one that stands for no value."""
    if HARMLESS.match(text):
        return 0.0
    n = len(text)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    return min(1.0, bits / 4) * min(1.0, n / 16) ** 0.5 * (BLANK if INNER.search(text) else 1.0)


def is_reference(word: str) -> bool:
    """Whether a bare word names something: dotted or snake case parts of letters and short numbers, or a sensitive name."""
    parts = re.split(r"[._]", word)
    return NAME.fullmatch(word) is not None and all(WORD.fullmatch(p) for p in parts) and (len(parts) > 1 or name_score(word) > 0)


def _quoted(m: re.Match, groups: range) -> tuple[int, int] | None:
    """The span of the one of a quote's five groups that matched."""
    return next((m.span(g) for g in groups if m[g] is not None), None)


def pairs(text: str) -> Iterator[tuple[list[str], list[tuple[int, int]], list[str]]]:
    """Of each assignment: its names in lower case, the spans of its literals, and the names whose values it takes."""
    at, last, around, named = 0, 0, [], []  # around: for each open object whether it has a name; named: those names
    while (m := PAIR.search(text, at)) is not None:
        for brace in BRACES.finditer(text, last, m.start()):
            if brace[0] == "{":
                around.append(False)
            elif around and around.pop():
                named.pop()
        own = m[1] + "." + re.sub(r"[^A-Za-z0-9_.$\-]+", ".", m[2]).strip(".") if m[2] else m[1]
        names = [".".join([*named[-INNERMOST:], own]).lower()]
        names += [own.lower()] if own.lower() != names[0] else []
        names += [m[3].lower()] if m[3] else []
        group = next(g for g in VALUES if m[g] is not None)
        spans, taken, last, at = [m.span(group)], [], m.end(), m.end()
        if m[BRACKET] == "{" and KEYED.match(text, at):
            around.append(True)
            named.append(own)
            last = at = m.end(BRACKET)  # the next pair begins with the key
            continue
        if group == BLOCK:
            a, b = spans[0]
            body = text[a:b]
            spans = [(a + len(body) - len(body.lstrip()), a + len(body.rstrip()))]
        elif group == BARE:
            taken = [m[BARE].lower()] if NAME.fullmatch(m[BARE]) else []
            called = text[at : at + 1]
            spans = [] if called in ("(", "[") or is_reference(m[BARE]) else spans
            if called == "(" and (found := LOOKUP.match(text, at)) is not None:
                spans, asked = [_quoted(found, range(6, 11))], _quoted(found, range(1, 6))
                names += [text[slice(*asked)].lower()] if asked else []
                last = at = found.end()
            elif called == "(" and (whole := CALL.match(text, at)) is not None and (more := MORE.match(text, whole.end())) is not None and more[6] is None:
                spans = [_quoted(more, range(1, 6))]
        if taken and not m[BRACKET] and CHAIN.match(text, at):
            yield names, [], taken  # the next pair begins with the name that this one takes
            last = at = m.start(BARE)
            continue
        while True:
            if (more := MORE.match(text, at)) is not None:
                if more[6] is not None:
                    taken.append(more[6].lower())
                else:
                    spans.append(_quoted(more, range(1, 6)))
            elif m[BRACKET] and (more := LISTED.match(text, at)) is not None:
                spans.append(_quoted(more, range(1, 6)))
            else:
                break
            last = at = more.end()
        yield names, spans, taken
    for m in SETTER.finditer(text):
        yield [m[1].lower()], [_quoted(m, range(2, 7))], []
    for m in ELEMENT.finditer(text):
        end = m.start(2) + len(m[2].rstrip())
        if end > m.start(2):
            yield [m[1].lower()], [(m.start(2), end)], []


def literal_spans(text: str, config: ScanConfig = ScanConfig()) -> list[tuple[int, int]]:
    """Spans of literals whose score of name and looks reaches the threshold, by start.

    A literal with inner blanks counts whole only for a name of score 1; else each of its parts between blanks counts for
    itself (a PEM body, the token after ``Bearer``).
    """
    if "=" not in text and ":" not in text and "</" not in text and "set" not in text:
        return []
    reach: dict[str, list[tuple[int, int]]] = {}  # a name's literals, by assignment
    taken: dict[str, list[str]] = {}  # a name and those whose value it takes
    for names, spans, others in pairs(text):
        for name in names:
            reach.setdefault(name, []).extend(spans)
            taken.setdefault(name, []).extend(others)
    own = {name: name_score(name) for name in reach}
    scores: dict[str, float] = {}
    for name in sorted(own, key=own.get, reverse=True):  # constants: the highest name that they are handed on to, each name once
        front = [name]
        while front:
            n = front.pop()
            if n not in scores:
                scores[n] = own[name]
                front += taken.get(n, ())

    def told(a: int, b: int, score: float) -> bool:
        if b - a < config.shortest or (NAME.fullmatch(text, a, b) and text[a:b].lower() in reach):
            return False
        looks = literal_score(text[a:b])
        return looks > 0 and score + looks >= config.threshold + 0.4

    found = set()
    for name, spans in reach.items():
        for a, b in spans if scores[name] > 0 else ():
            blank = INNER.search(text, a, b) is not None
            if (not blank or scores[name] >= 1) and told(a, b, scores[name]):
                found.add((a, b))
            elif blank and not HARMLESS.match(text[a:b]):
                found.update(m.span() for m in PART.finditer(text, a, b) if told(*m.span(), scores[name]))
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's place in KINDS), by start and kind."""
    out = []
    for kind, (_, pattern, group, least) in enumerate(BASE):
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[0], s[2]))


def _inside(a: int, b: int, base: list[tuple[int, int, int]]) -> bool:
    return any(x <= a and b <= y for x, y, _ in base)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", config: ScanConfig = ScanConfig()) -> DataFrame:
    """key and ``found array<struct<kind string, start long, end long>>`` by start, then kind; code points, end exclusive.

    Kinds: assign, access, hex (the base patterns) and literal (spans of the lexer that aren't inside a base span).
    A null text is empty; every row gives one row; texts are read whole.
    """

    def one(said: str | None) -> list[dict]:
        said = said or ""
        base = base_spans(said)
        more = [(a, b, 3) for a, b in literal_spans(said, config) if not _inside(a, b, base)]
        return [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in sorted([*base, *more], key=lambda s: (s[0], s[2]))]

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(x.as_py()) for x in batch.column(1)], kind)], ["key", "found"])

    made = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return made.mapInArrow(run, f"key {made.schema['key'].dataType.simpleString()}, found array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("key", key)


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]", config: ScanConfig = ScanConfig()) -> DataFrame:
    """``df`` with every found span of ``text`` replaced by ``mark`` (overlapping spans by one); a null text stays null."""

    def one(said: str | None) -> str | None:
        if not said:
            return said
        out, done = [], 0
        spans = sorted([(a, b) for a, b, _ in base_spans(said)] + literal_spans(said, config))
        for a, b in spans:
            if a >= done:
                out += [said[done:a], mark]
            done = max(done, b)
        return "".join([*out, said[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            i = batch.schema.get_field_index(text)
            yield batch.set_column(i, batch.schema.field(i), pa.array([one(x.as_py()) for x in batch.column(i)], batch.schema.field(i).type))

    return df.mapInArrow(run, df.schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = scan(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] != "literal")
    return out.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))
