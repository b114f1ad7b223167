"""Operator 10: byte-pair encoding by backtracking over longest matches, and decoding through an offset table.

Encoding. An Aho-Corasick automaton of all tokens gives the longest token that starts at a position. A token is kept
when it is *compatible* with the token before it: the two, merged alone, would stay two tokens. Otherwise the next
shorter token is tried, and when none is left the previous token is undone and its end is marked as a dead end. Each
position is a dead end at most once, so the work is linear, and the result is the one the merge list gives.

Compatibility of a pair is read from the merge trees: let x be a symbol on the right edge of the left token and y one
on the left edge of the right token. If (x, y) merges before x or y is merged into its own parent (for y also at the
same rank, as equal merges run from the left), the pair cannot stand. Results are kept in a table of pairs.

Whole texts are cut at white space where the tokenizer's split pattern must cut as well, and the ids of such units are
kept in a bounded table per worker, so frequent words are encoded once.

Decoding. All token bytes stand in one buffer; a table of offsets says where each id starts. The ids of a text become
one gather from the buffer.

Defined results: null and empty texts have no ids and decode to the empty text. The file's special token in a text
becomes its one id. Repeated rows are encoded each on its own. The tables are bounded; a worker holds one batch of
texts, and one text must fit in a worker's memory.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from envspark.llm.common import documents, python_texts

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Entries of a worker's unit table before it starts anew; longer units are not kept.
TABLE_UNITS, UNIT_CHARS = 300_000, 48

#: The split pattern of byte-level BPE for the characters of PLAIN, whose classes no Unicode version changes.
_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ɏ]*")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Table(dict):
    """unit -> packed ids, filled on demand; starts anew when full."""

    def __init__(self, fill):
        self.fill = fill

    def __missing__(self, unit):
        value = self.fill(unit)
        if len(unit) <= UNIT_CHARS:
            if len(self) >= TABLE_UNITS:
                self.clear()
            self[unit] = value
        return value


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = raw(token)
        id_of = {self.bytes_of[i]: i for i in vocab.values()}
        self.rank, self.parts = {}, [None] * size  # merge -> rank; token -> (rank, left, right)
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            left, right = vocab[a], vocab[b]
            self.rank[left, right] = r
            made = vocab[a + b]
            self.parts[made] = self.parts[made] or (r, left, right)
        self.length = [len(b) for b in self.bytes_of]
        self.longest = max(self.length)
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        self.search = ahocorasick.Automaton()
        for b, i in id_of.items():
            self.search.add_word(b.decode("latin-1"), i)
            self.shorter[i] = next((id_of[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in id_of), -1)
        self.search.make_automaton()
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.buffer = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.pairs: dict[tuple[int, int], bool] = {}
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.pieces = _Table(lambda piece: np.array(self.merge(piece.encode()), "<u4").tobytes())
        self.bare = _Table(self._unit)
        self.spaced = _Table(lambda unit: self._unit(" " + unit))
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    # ---- pairs and merges ------------------------------------------------------------------------------------------

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 4 * TABLE_UNITS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        x, x_until = left, float("inf")
        while True:
            y, y_until = right, float("inf")
            while True:
                r = self.rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    return False
                if self.parts[y] is None:
                    break
                y_until, y = self.parts[y][0], self.parts[y][1]
            if self.parts[x] is None:
                return True
            x_until, x = self.parts[x][0], self.parts[x][2]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece of the split."""
        text, end = piece.decode("latin-1"), len(piece)
        search, longest, length, shorter = self.search, self.longest, self.length, self.shorter
        tokens: list[int] = []
        dead: set[int] = set()
        at, token = 0, -1
        fresh = True
        while at < end:
            if fresh:
                token = next(search.iter_long(text[at:at + longest]))[1]
            while token >= 0 and (at + length[token] in dead or tokens and not self.compatible(tokens[-1], token)):
                token = shorter[token]
            fresh = token >= 0
            if fresh:
                tokens.append(token)
                at += length[token]
            else:
                dead.add(at)
                last = tokens.pop()
                at -= length[last]
                token = shorter[last]
        return tokens

    # ---- texts -----------------------------------------------------------------------------------------------------

    def _unit(self, unit: str) -> bytes:
        if not unit:
            return b""
        if PLAIN.fullmatch(unit):
            return b"".join([self.pieces[p] for p in _SPLIT.findall(unit)])
        return b"".join([self.pieces[unit[a:b]] for _, (a, b) in self.byte_level.pre_tokenize_str(unit)])

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.cut and any(s in text for s in self.special):
            parts = self.cut.split(text)
            return b"".join([self.special[p].to_bytes(4, "little") if k % 2 else self._packed(p) for k, p in enumerate(parts)])
        return self._packed(text)

    def _packed(self, text: str) -> bytes:
        if not text:
            return b""
        if text.replace("\n", " ").split(" ") != text.split():  # white space other than single blanks and line ends
            return self._unit(text)
        out, bare, spaced, line_end = [], self.bare, self.spaced, self.bare["\n"]
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(bare[first])
            out += [spaced[u] for u in rest]
            out.append(line_end)
        out.pop()
        return b"".join(out)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' text: one gather through the offset table."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.buffer[np.arange(total) + np.repeat(self.offsets[ids] - ends + n, n)].tobytes()

    def text(self, ids: np.ndarray) -> str:
        return self.decoded(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str = TOKENIZER) -> Codec:
    """One codec per worker and file."""
    return Codec(path)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str = TOKENIZER) -> DataFrame:
    """``df`` with ``ids``: the ids of ``text``, packed as little-endian unsigned 32-bit integers (binary)."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([c.packed(t) for t in python_texts(texts)], pa.binary())

    return df.withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str = TOKENIZER) -> DataFrame:
    """``df`` with ``text``: the text of the packed ids of column ``ids`` (null: empty)."""

    @F.arrow_udf("string")
    def run(packed: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([c.text(np.frombuffer(b or b"", "<u4")) for b in packed.to_pylist()], pa.string())

    return df.withColumn(text, run(F.col(ids)))


def digests(df: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """doc_id and the digests of a text's ids and of their decoded text, both made in one visit of the text."""

    @F.arrow_udf("struct<n_tokens bigint, ids_sha256 string, decoded_sha256 string>")
    def run(texts: pa.Array) -> pa.Array:
        c = codec(path)
        rows = []
        for t in python_texts(texts):
            packed = c.packed(t)
            ids = np.frombuffer(packed, "<u4")
            back = c.text(ids).encode()
            rows.append({"n_tokens": len(ids), "ids_sha256": hashlib.sha256(packed).hexdigest(),
                         "decoded_sha256": hashlib.sha256(back).hexdigest()})
        return pa.array(rows, pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    return df.select("doc_id", run(F.col(text)).alias("d")).select("doc_id", "d.*")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
