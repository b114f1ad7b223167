"""Operator 5: secret scans by assignment-aware lexing.

Base kinds, matched leftmost and without overlaps, each over the whole text:

* ``assign``: a sensitive name, an optional quote, ``:`` or ``=``, and a value of 6 or more characters;
* ``access``: ``AKIA`` and capitals or digits, 20 characters or more;
* ``hex``: a run of 24 or more lower-case hexadecimal digits.

The method adds kind ``literal``. Lines with ``=`` or ``:`` are lexed into names, quoted strings, bare values and
operators (source code, JSON, YAML, properties, shell exports, URL credentials). Each ``name = expression`` becomes a
pair of a name and a literal; an expression may join strings and names with ``+``, and names stand for the literals they
were given earlier in the text, so a constant that reaches a sensitive name through others is found where it is written.
A pair scores name sensitivity (password, secret, token, api key, private key ... ; lower for ``..._file``, ``..._url``
and the like) times how much its value looks like a secret (length, character classes, entropy; zero for placeholders);
from ``THRESHOLD`` on the literal's parts are spans. A literal may have any length and is scored over the whole of it; an
element set by its quoted key (``config["db_password"] = ...``) has the key as its name. Joined values hold counts and
spans, not text, so a value that grows by itself (``x = x + x``) takes no more room than its parts.

Defined results: null and empty texts have no spans; repeated rows give repeated results; an empty table an empty one.
The lexer visits each character a bounded number of times; a worker holds one batch of texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm.common import documents, python_texts

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.5
#: Characters kept of each end of a joined value (more than the longest placeholder), and where its counts stop growing.
EDGE, MOST = 16, 1 << 60
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Lexemes of one statement; the alternatives start with different characters and never run back, so lexing is linear.
_LEXEME = re.compile(r"""
    (?P<quote>["'`])
  | (?P<name>[A-Za-z_][\w]*(?:[.\-]\w+)*)
  | (?P<op>:=|=>|==|!=|<=|>=|[=:+])
  | (?P<end>[;,(){}\[\]\n])
  | (?P<bare>[^\s"'`=:+;,(){}\[\]]+)
""", re.X)
_INDEXED = re.compile(r"[\x20\t]*(?::=|=>|=(?!=))")
#: From behind an opening quote to the closing one. A quote closes a string if an even number of backslashes stands before
#: it, wherever the string began; so where none follows in a line, no later quote of its kind opens a string there either.
_STRING = {'"': re.compile(r'[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'), "'": re.compile(r"[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"),
           "`": re.compile(r"[^`\n]*+`")}
_VALUE = re.compile(r"[^\s\"'`;,(){}\[\]]+")
_URL = re.compile(r"://([^\s:/@]+):([^\s:/@]+)@")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PLACEHOLDER = re.compile(r"(?i)change_?me|example|placeholder|dummy|your[_-]|\$\{|\{\{|%\(")
_NOTHING = re.compile(r"(?i)(none|null|true|false|todo|undefined)$")

#: Sensitivity of the words of a name, and of two neighbouring words (fixed parameters of the score).
_WORD = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 0.9,
         "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.8, "authorization": 0.8, "pass": 0.7}
_PAIR = {("api", "key"): 0.9, ("access", "key"): 0.9, ("private", "key"): 1.0, ("encryption", "key"): 0.9,
         ("signing", "key"): 0.9, ("secret", "key"): 1.0, ("client", "secret"): 1.0, ("session", "key"): 0.8}
_HARMLESS = {"id", "name", "file", "path", "url", "uri", "hint", "length", "count", "type", "field", "policy", "expires",
             "expiry", "label", "format", "enabled", "endpoint"}


def sensitivity(name: str) -> float:
    """How sensitive a target name is, 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(name)]
    best = max([0.0, *(_WORD.get(w, 0.0) for w in words), *(_PAIR.get(p, 0.0) for p in zip(words, words[1:]))])
    return best * (0.3 if words and words[-1] in _HARMLESS else 1.0)


class Value(NamedTuple):
    """What the score needs of a literal, or of literals joined with ``+``, however long; and where its parts stand.

    ``parts`` is a span, or a pair of the parts of two joined values: shared, never copied."""
    n: int
    counts: dict[str, int]
    head: str
    tail: str
    placeholder: bool
    parts: tuple


def literal(text: str, start: int, end: int) -> Value:
    value = text[start:end]
    return Value(len(value), Counter(value), value[:EDGE], value[-EDGE:], bool(_PLACEHOLDER.search(value)), (start, end))


def joined_values(a: Value, b: Value) -> Value:
    if not a.n or not b.n:
        return a if a.n else b
    counts = dict(a.counts)
    for c, k in b.counts.items():
        counts[c] = min(MOST, counts.get(c, 0) + k)
    return Value(min(MOST, a.n + b.n), counts, (a.head + b.head)[:EDGE], (a.tail + b.tail)[-EDGE:],
                 a.placeholder or b.placeholder or bool(_PLACEHOLDER.search(a.tail + b.head)), (a.parts, b.parts))


def secrecy(value: Value) -> float:
    """How much a literal looks like a secret, 0 to 1."""
    n, chars = value.n, value.counts
    if (n < 6 or value.placeholder or chars.keys() <= {"x", "X"} or chars.keys() == {"*"} or value.head[0] + value.tail[-1] == "<>"
            or n < EDGE and _NOTHING.match(value.head)):
        return 0.0
    classes = sum((any(c.islower() for c in chars), any(c.isupper() for c in chars), any(c.isdigit() for c in chars),
                   any(not c.isalnum() and not c.isspace() for c in chars)))
    total = sum(chars.values())
    entropy = -sum(k / total * math.log2(k / total) for k in chars.values())
    score = min(1.0, n / 12) * min(1.0, entropy / 3.0) * (0.5, 0.5, 0.85, 1.0, 1.0)[classes]
    return score * (0.3 if " " in chars else 1.0)


def pairs(text: str) -> Iterator[tuple[str, Value]]:
    """(name, value) of the assignments of a text, in order."""
    if "=" not in text and ":" not in text:
        return
    known, at = {}, 0
    while at < len(text):
        start, stop = at, text.find("\n", at)
        end = len(text) if stop < 0 else stop
        at = end + 1
        if text.find("=", start, end) < 0 and text.find(":", start, end) < 0:
            continue
        line = start
        while end < len(text) and text[line:end].rstrip().endswith(("+", "\\")):  # goes on in the next line
            line, stop = end + 1, text.find("\n", end + 1)
            end = len(text) if stop < 0 else stop
        at = end + 1
        yield from _statement(text, start, end, known)
        for u in _URL.finditer(text, start, end):
            yield f"{u.group(1)}.password", literal(text, *u.span(2))


def _statement(text: str, start: int, end: int, known: dict[str, Value]) -> list[tuple[str, Value]]:
    """Lexes one line and returns its pairs; ``known``: name -> value given so far."""
    target, quoted, given, joined, value, used, found = None, False, False, False, None, False, []

    def close() -> None:
        nonlocal target, quoted, given, joined, value, used
        if target and given and used:
            if value.n:
                known[target] = value
                found.append((target, value))
            else:
                known.pop(target, None)
        target, quoted, given, joined, value, used = None, False, False, False, None, False

    at, open_until = start, {}  # quote -> end of the line in which nothing closes it any more
    while m := _LEXEME.search(text, at, end):
        at, kind, lexeme = m.end(), m.lastgroup, m.group()
        if kind == "quote":
            closed = _STRING[lexeme].match(text, at, end) if at > open_until.get(lexeme, -1) else None
            if closed is None:
                if at > open_until.get(lexeme, -1):
                    stop = text.find("\n", at, end)
                    open_until[lexeme] = end if stop < 0 else stop
                continue
            at, kind = closed.end(), "string"
            lexeme = text[m.start():at]
        if kind == "end":
            if lexeme == "]" and target and quoted and not given and _INDEXED.match(text, at, end):
                continue  # config["name"] = ...
            if lexeme != "\n" or not joined:
                close()
        elif kind == "op":
            if lexeme in (":=", "=>", "=", ":"):
                if target and (not given or not used):
                    given = True
                elif target:
                    # a bare value that holds the operator (base64 padding), or a type before "="
                    last = target
                    close()
                    target = last if lexeme == "=" else None
                    given = target is not None
            elif lexeme == "+":
                joined = True
            else:
                close()
        elif not given:
            target, quoted = (lexeme[1:-1], True) if kind == "string" else (lexeme, False)
        elif used and not joined and kind != "string":
            nxt = lexeme  # the value has ended: this may be the next target (attributes, several pairs a line)
            close()
            target = nxt
        else:
            if kind == "string":
                part = literal(text, m.start() + 1, at - 1)
            elif lexeme in known:
                part = known[lexeme]
            else:
                whole = _VALUE.match(text, m.start(), end)
                part, at = literal(text, *whole.span()), max(at, whole.end())
            value = joined_values(value, part) if value else part
            used, joined = True, False
    close()
    return found


def scan(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of all spans of a text, sorted."""
    spans = {(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text)} if "AKIA" in text else set()
    spans |= {(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)}
    if "=" in text or ":" in text:
        spans |= {(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6}
        seen, kept = set(), []  # joined parts are walked once; kept, so that no id is used again
        for name, value in pairs(text):
            s = sensitivity(name)
            if s and s * secrecy(value) >= THRESHOLD:
                todo = [value.parts]
                while todo:
                    a, b = part = todo.pop()
                    if isinstance(a, int):
                        spans.add((a, 3, b, a))
                    elif id(part) not in seen:
                        seen.add(id(part))
                        kept.append(part)
                        todo += part
    return sorted(spans)


def redact(text: str, spans: list[tuple[int, int, int, int]], mark: str = "[secret]") -> str:
    """The text with every secret replaced by ``mark``; spans that touch or overlap become one."""
    out, at = [], 0
    for a, b in sorted((s[3], s[2]) for s in spans):
        if a > at or not out:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def found_in(text: Column) -> Column:
    """Struct of n_assign, n_access, n_hex, base_sha256 and spans of a text column."""
    fields = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()),
              ("spans", pa.string())]

    @F.arrow_udf("struct<n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string>")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in python_texts(texts):
            spans = scan(t)
            base = [s for s in spans if s[1] < 3]
            n = Counter(s[1] for s in base)
            rows.append({"n_assign": n[0], "n_access": n[1], "n_hex": n[2],
                         "base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(), "spans": _joined(spans)})
        return pa.array(rows, pa.struct(fields))

    return run(text)


def secret_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the counts of the base kinds, the digest of the base spans, and all spans."""
    return docs.select("doc_id", found_in(F.col(text)).alias("s")).select("doc_id", "s.*")


def without_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced (a null text stays null) and n_chars, where there is one, anew."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None else redact(t, s) if (s := scan(t)) else t for t in texts.to_pylist()], pa.string())

    clean = docs.withColumn(text, run(F.col(text)))
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.coalesce(F.length(text).cast(kind), F.col("n_chars")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))
