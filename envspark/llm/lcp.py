"""Operator 8: document fingerprints by locally consistent parsing.

A text is parsed bottom-up into a hierarchy of phrases. On each level runs of one symbol become one symbol, then
deterministic coin tossing shortens the symbols to a few bits (a symbol's label is the place and value of the lowest bit
in which it differs from its left neighbour; three rounds leave labels below 8), and a phrase starts at each local
maximum of the labels. A phrase's name is a hash of its symbols in order, and the names are the symbols of the next
level. Labels depend on a few neighbours only, so equal substrings have equal phrases but for their edges, wherever
they stand.

The signatures of a text are the names of its phrases on levels 3 and up (about 25 characters and more) and the name of
the whole. Its fingerprint has 64 bins of 4 hexadecimal digits: of the signatures that fall into a bin the least is
kept; an empty bin is ``....``. The likeness of two fingerprints is the share of equal bins among those that are not
empty in both, an estimate of the signatures' Jaccard similarity.

``edited_likeness`` compares each document with an edited copy and with the next document. The next document (descending
doc_id) is found without a global sort: documents go, once, to parts that are ranges of doc_id, and the first row of
each part is also sent to the part before it. Memory: one chunk of texts, and about 100 bytes a character of the longest.

Defined results: a null text is empty; empty texts have the fingerprint of empty bins, likeness 1 to each other and 0 to
any other text. Rows are ordered by doc_id descending, nulls last, ties by length and text, so repeated rows follow each
other. A table's only row is its own next document. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm.common import documents, python_texts

BINS, FIRST_LEVEL, ROUNDS = 64, 3, 3
#: Characters parsed at once: so many that the arrays of a level stay in a core's cache.
CHUNK = 1 << 18
EMPTY = "...." * BINS
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _tossed() -> np.ndarray:
    """The label of a symbol below 128 by its left neighbour and itself: place and value of the lowest bit that differs."""
    left, own = np.arange(128)[:, None], np.arange(128)[None, :]
    differ = left ^ own
    low = differ & -differ
    return (2 * np.log2(np.maximum(low, 1)).astype(np.uint8) + ((own & low) != 0)).astype(np.uint8).ravel()


_TOSSED = _tossed()


def _labels(sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Deterministic coin tossing; ``first``: symbols without a left neighbour. After the first round labels are below 128, so
    the others look a pair of neighbours up."""
    at = np.flatnonzero(first)
    differ = np.empty_like(sym)
    np.bitwise_xor(sym[1:], sym[:-1], out=differ[1:])
    differ[at] = 1
    low = differ & (~differ + U(1))
    lab = (np.bitwise_count(low - U(1)) << 1) + ((sym & low) != 0)
    for _ in range(ROUNDS - 1):
        pair = np.zeros(len(lab), np.uint16)
        np.left_shift(lab[:-1], 7, out=pair[1:], dtype=np.uint16, casting="unsafe")
        pair += lab
        tossed = _TOSSED[pair]
        tossed[at] = lab[at] & 1
        lab = tossed
    return lab.astype(np.int8)


def parse(sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names and documents of the phrases of ``sym``, symbols of several documents one after the other."""
    n = len(sym)
    new_doc = np.empty(n, bool)
    new_doc[0] = True
    np.not_equal(doc[1:], doc[:-1], out=new_doc[1:])
    head = new_doc.copy()
    head[1:] |= sym[1:] != sym[:-1]
    at = np.flatnonzero(head)
    runs = np.diff(np.append(at, n)).astype(U)
    sym, doc, new_doc = sym[at], doc[at], new_doc[at]
    long = runs > 1
    sym[long] = _mix(sym[long] + runs[long] * U(0x9E3779B97F4A7C15))
    lab = _labels(sym, new_doc)
    left = np.concatenate([[np.int8(-1)], lab[:-1]])
    right = np.concatenate([lab[1:], [np.int8(-1)]])
    left[new_doc] = 127  # a document's start is a phrase's start anyway
    right[np.append(new_doc[1:], True)] = 127  # no phrase starts at a document's last symbol
    start = new_doc | ((lab > left) & (lab >= right))
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, len(sym)))
    place = (np.arange(len(sym)) - np.repeat(at, size)).astype(U)
    name = np.add.reduceat(_mix(sym + (place + U(1)) * U(0xD1342543DE82EF95)), at)
    return _mix(name + size.astype(U) * U(0x2545F4914F6CDD1D)), doc[at]


def _sketch(texts: list[str]) -> list[str]:
    sizes = [len(t) for t in texts]
    if not sum(sizes):
        return [EMPTY] * len(texts)
    sym = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
    doc = np.repeat(np.arange(len(texts)), sizes)
    level, names, owners = 0, [], []
    while True:
        counts = np.bincount(doc, minlength=len(texts))
        keep = counts[doc] == 1  # parsed to one symbol: the name of the whole
        if level >= FIRST_LEVEL:
            keep[:] = True
        if keep.any():
            names.append(_mix(sym[keep]))
            owners.append(doc[keep])
        more = counts[doc] > 1
        sym, doc = sym[more], doc[more]
        if not len(sym):
            break
        sym, doc = parse(sym, doc)
        level += 1
    name, owner = np.concatenate(names), np.concatenate(owners)
    key = owner * BINS + (name >> U(58)).astype(np.int64)
    order = np.lexsort((name, key))
    key, name = key[order], name[order]
    least = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    out = [["...."] * BINS for _ in texts]
    for k, v in zip(key[least].tolist(), (name[least] & U(0xFFFF)).tolist()):
        out[k // BINS][k % BINS] = f"{v:04x}"
    return ["".join(bins) for bins in out]


def fingerprints_of(texts: list[str]) -> list[str]:
    """The fingerprints of texts, parsed some at a time."""
    out, part, size = [], [], 0
    for t in texts:
        if part and size + len(t) > CHUNK:
            out += _sketch(part)
            part, size = [], 0
        part.append(t)
        size += len(t)
    return out + (_sketch(part) if part else [])


def likeness(a: str, b: str) -> float:
    """The likeness of two fingerprints, 0 to 1."""
    x = np.frombuffer(a.encode(), "S4")
    y = np.frombuffer(b.encode(), "S4")
    used = (x != b"....") | (y != b"....")
    return float((x == y)[used].mean()) if used.any() else 1.0


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprints_of(python_texts(texts)), pa.string())

    return run(text)


def _range_of(doc_id: Column, bounds: list[int], lo: int = 0) -> Column:
    """How many of the descending ``bounds`` are above doc_id, as a balanced tree of comparisons."""
    if not bounds:
        return F.lit(lo)
    mid = len(bounds) // 2
    return F.when(doc_id < F.lit(bounds[mid]), _range_of(doc_id, bounds[mid + 1:], lo + mid + 1)).otherwise(
        _range_of(doc_id, bounds[:mid], lo))


def in_next_order(docs: DataFrame, text: str = "text") -> DataFrame:
    """(part, extra, doc_id, text): rows sorted by doc_id, descending, within ranges of doc_id; every range ends with a
    copy (extra = 1) of the first row of the next one, the last range with a copy of the first row of all."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    cuts = 4 * tasks  # several ranges a task even out their sizes
    found = rows.select("doc_id").approxQuantile("doc_id", [k / cuts for k in range(1, cuts)], 0.25 / cuts)
    bounds = sorted({int(x) for x in found}, reverse=True)
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(_range_of(F.col("doc_id"), bounds))
    heads = {r.part: r.head for r in rows.groupBy(part.alias("part")).agg(F.max("doc_id").alias("head")).collect()}
    present = sorted(heads)
    before = dict(zip(present, present[-1:] + present[:-1]))
    every = range(len(bounds) + 1)
    head = F.element_at(F.array(*[F.lit(heads.get(p)).cast("bigint") for p in every]), F.col("own") + 1)
    target = F.element_at(F.array(*[F.lit(before.get(p, p)) for p in every]), F.col("own") + 1)
    one = lambda p, extra: F.struct(p.alias("part"), F.lit(extra).alias("extra"))
    own = rows.withColumn("own", part)
    places = F.when(head.eqNullSafe(F.col("doc_id")), F.array(one(F.col("own"), 0), one(target, 1))).otherwise(
        F.array(one(F.col("own"), 0)))
    spread = own.select(F.explode(places).alias("at"), "doc_id", "text").select("at.part", "at.extra", "doc_id", "text")
    return spread.repartition(tasks, "part").sortWithinPartitions(
        "part", "extra", F.col("doc_id").desc_nulls_last(), F.length("text"), F.xxhash64("text"))


LIKENESS = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple] = []  # (doc_id, text, fingerprint or None) of one part, in order
    part, closed, size = None, False, 0

    def flush() -> Iterator[pa.RecordBatch]:
        """Rows for all waiting documents but the last, which waits on as the next one's predecessor."""
        nonlocal waiting, size
        edited = [a[1][:len(a[1]) - len(a[1]) // 3] + b[1][:len(a[1]) // 3] for a, b in zip(waiting, waiting[1:])]
        new = [k for k, w in enumerate(waiting) if w[2] is None]
        made = fingerprints_of([waiting[k][1] for k in new] + edited)
        own = [w[2] for w in waiting]
        for k, f in zip(new, made):
            own[k] = f
        after = made[len(new):]
        if edited:
            yield pa.RecordBatch.from_arrays([
                pa.array([w[0] for w in waiting[:-1]], pa.int64()),
                pa.array([len(w[1]) for w in waiting[:-1]], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
                pa.array(own[:-1]), pa.array(after),
                pa.array([likeness(a, b) for a, b in zip(own, after)]),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:])]),
            ], names=[c.split()[0] for c in LIKENESS.split(", ")])
        waiting = [(*waiting[-1][:2], own[-1])]
        size = 0

    for batch in batches:
        for p, extra, doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
            if p != part:
                if waiting:
                    yield from flush()
                waiting, part, closed, size = [], p, False, 0
            if closed:
                continue  # further copies of the next part's first row
            closed = extra == 1
            waiting.append((doc_id, text, None))
            size += len(text)
            if size > CHUNK and len(waiting) > 1:
                yield from flush()
    if waiting:
        yield from flush()


def edited_likeness(docs: DataFrame, text: str = "text") -> DataFrame:
    """LIKENESS of every document: its own fingerprint, that of its edited copy, and both likenesses."""
    return in_next_order(docs, text).mapInArrow(_compare, LIKENESS)


def op8_lcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(documents(spark, sf_dir))
