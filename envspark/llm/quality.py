"""Operator 9: quality classifier from weak labels.

Eight heuristic labellers vote good, bad or nothing on a text (symbols, capitals, digits, function words, word length,
distinct words, punctuation, length and line repetition). Their votes overlap and none is trusted: expectation-maximisation
over the counts of all vote patterns of all documents estimates the share of good documents and each labeller's accuracy
on good and on bad ones (Dawid-Skene), which gives every pattern a posterior. The posteriors are the labels of a hashed
linear scorer: shares of character-shape trigrams, hashed into ``DIMS`` places, fitted by ridge least squares. Its score
decides: a document below ``CUT`` is rejected.

The pattern counts cover all documents (at most 3^8 patterns reach the driver). The scorer is fitted on the ``FIT_DOCS``
documents with the smallest hash of their id at most (the documented bound of the fit), which are written once to the shared
folder (one row an id); each of FIT_TASKS tasks sends one DIMS x DIMS matrix to the driver, one after another. No given label
is read.

Defined results: null and empty texts, and texts under three characters, have no trigrams; they get the score of the
intercept and their votes' posterior, and are rejected. Repeated rows count each; ties in the hash order by doc_id. An
empty table gives an empty result. If EM sees one pattern only, its posterior is the majority's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm.common import documents, python_texts, write_shared

FIT_DOCS, DIMS, CUT, RIDGE = 20_000, 512, 0.5, 1.0
#: Words in a window of the distinct-words labeller; tasks that sum the sample's matrices.
WINDOW, FIT_TASKS = 1000, 16
GOOD, BAD, NONE = "1", "0", "-"

# Function words of four languages.
FUNCTION = set("the of and to in a is that for it with as was on be by at this from or are an der die das und ist in den von zu "
               "mit sich des auf für nicht ein eine dem im le la les de des et un une du que qui dans pour est sur par en au "
               "el los las y del se por con para una su al es lo como más".split())


def _shapes() -> np.ndarray:
    """byte -> shape: lower letters and bytes beyond ASCII, capitals, digits, blanks, line ends, each mark its own."""
    shape = np.full(256, 63, np.uint8)
    marks = 6
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or c.islower():
            shape[b] = 1
        elif c.isupper():
            shape[b] = 2
        elif c.isdigit():
            shape[b] = 3
        elif c in " \t":
            shape[b] = 4
        elif c in "\n\r":
            shape[b] = 5
        elif 0x21 <= b < 0x7F:
            shape[b], marks = marks, marks + 1
    return shape


SHAPE = _shapes()
_PLAIN_MARKS = np.array([SHAPE[ord(c)] for c in ".,;:!?'\"()-"])


def _vote(x: float, good: bool, bad: bool) -> str:
    return BAD if bad else GOOD if good else NONE


def votes(text: str) -> str:
    """The labellers' votes on a text, one character each."""
    shapes = np.bincount(SHAPE[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=64)
    n = max(1, int(shapes.sum()))
    letters = max(1, int(shapes[1] + shapes[2]))
    marks = int(shapes[6:].sum())
    symbols = (marks - int(shapes[_PLAIN_MARKS].sum())) / n
    plain = marks / n
    words = text.lower().split()
    k = len(words)
    function = sum(map(FUNCTION.__contains__, words)) / max(1, k)
    mean = sum(map(len, words)) / max(1, k)
    # distinct words in windows of equal size that cover the text, so the measure does not fall with the length
    windows = -(-k // WINDOW) or 1
    cuts = [k * j // windows for j in range(windows + 1)]
    distinct = sum(len(set(words[a:b])) for a, b in zip(cuts, cuts[1:])) / max(1, k)
    lines = [x for x in text.split("\n") if x]
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    capitals, digits = shapes[2] / letters, shapes[3] / n
    return "".join((
        _vote(symbols, symbols < 0.01, symbols > 0.04),
        _vote(capitals, capitals < 0.1, capitals > 0.35),
        _vote(digits, digits < 0.05, digits > 0.3),
        NONE if k < 8 else _vote(function, function > 0.15, function < 0.04),
        _vote(mean, 3 <= mean <= 9, not 2 <= mean <= 14),
        NONE if k < 60 else _vote(distinct, distinct > 0.35, distinct < 0.12),
        _vote(plain, 0.005 < plain < 0.06, plain > 0.1),
        _vote(k, k >= 5 and repeated < 0.2, k < 2 or repeated > 0.6),
    ))


def expectation_maximisation(counts: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """The posterior of "good" of every vote pattern, from the counts of the patterns."""
    patterns = sorted(counts)
    if not patterns:
        return {}
    n = np.array([counts[p] for p in patterns], float)
    hot = np.array([[[v == x for x in (BAD, GOOD, NONE)] for v in p] for p in patterns], float)  # pattern, labeller, vote
    balance = hot[:, :, 1].sum(1) - 2 * hot[:, :, 0].sum(1)  # a bad vote says more than a good one: most texts are good
    good = 1 / (1 + np.exp(-balance))
    for _ in range(rounds):
        by = []
        for p in (good, 1 - good):
            weight = (p * n)[:, None, None]
            seen = (hot * weight).sum(0) + 0.5
            by.append((np.log(seen / seen.sum(1, keepdims=True)), (p * n).sum() + 1))
        logs = [(hot * log).sum((1, 2)) + np.log(total) for log, total in by]
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(patterns, good.tolist()))


def trigrams(text: str) -> np.ndarray:
    """Hashed shares of character-shape trigrams, as a vector of length 1 (0 without any)."""
    s = SHAPE[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].astype(np.uint32)
    if len(s) < 3:
        return np.zeros(DIMS)
    code = (s[:-2] << 12) | (s[1:-1] << 6) | s[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - DIMS.bit_length() + 1)
    x = np.sqrt(np.bincount(code, minlength=DIMS))
    return x / np.sqrt((x * x).sum())


@dataclass
class Scorer:
    """The posteriors of vote patterns and the linear model."""

    posteriors: dict[str, float]
    weights: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        x = trigrams(text)
        margin = float(x @ self.weights) + self.intercept if x.any() else min(self.intercept, -1.0)
        return 1 / (1 + float(np.exp(-np.clip(4 * margin, -30, 30))))


def pattern_counts(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """How many documents have each vote pattern."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([votes(t) for t in python_texts(texts)], pa.string())

    return {r.v: r.n for r in docs.groupBy(run(F.col(text)).alias("v")).agg(F.count("*").alias("n")).collect()}


def fit(docs: DataFrame, posteriors: dict[str, float], text: str = "text", limit: int = FIT_DOCS) -> Scorer:
    """The linear scorer of the posterior labels."""
    some = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, target, seen = np.zeros((DIMS + 1, DIMS + 1)), np.zeros(DIMS + 1), 0
        for batch in batches:
            texts = python_texts(batch.column(0))
            for k in range(0, len(texts), 2000):
                part = texts[k:k + 2000]
                x = np.array([np.append(trigrams(t), 1.0) for t in part])
                y = np.array([2 * posteriors[votes(t)] - 1 for t in part])
                gram, target, seen = gram + x.T @ x, target + x.T @ y, seen + len(part)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([target.tobytes()], pa.binary())],
                                             names=["gram", "target"])

    gram, target = RIDGE * np.eye(DIMS + 1), np.zeros(DIMS + 1)
    gram[DIMS, DIMS] = 1e-9
    sample = write_shared(rows, "quality-sample")  # one parallel scan of all documents; the sample is a few file splits
    for r in sample.coalesce(FIT_TASKS).mapInArrow(sums, "gram binary, target binary").toLocalIterator():  # one matrix at a time
        gram += np.frombuffer(r.gram).reshape(DIMS + 1, DIMS + 1)
        target += np.frombuffer(r.target)
    beta = np.linalg.solve(gram, target)
    return Scorer(posteriors, beta[:-1], float(beta[-1]))


def learn(docs: DataFrame, text: str = "text", limit: int = FIT_DOCS) -> Scorer:
    return fit(docs, expectation_maximisation(pattern_counts(docs, text)), text, limit)


def judged(text: Column, scorer: Scorer) -> Column:
    """Struct of votes, posterior and score of a text column."""

    @F.arrow_udf("struct<votes string, posterior double, score double>")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in python_texts(texts):
            v = votes(t)
            rows.append({"votes": v, "posterior": scorer.posteriors.get(v, 0.5), "score": scorer.score(t)})
        return pa.array(rows, pa.struct([("votes", pa.string()), ("posterior", pa.float64()), ("score", pa.float64())]))

    return run(text)


def classified(docs: DataFrame, text: str = "text", limit: int = FIT_DOCS) -> DataFrame:
    """doc_id, votes, posterior, score and quality (1: kept) of every document."""
    rows = docs.select("doc_id", judged(F.col(text), learn(docs, text, limit)).alias("j")).select("doc_id", "j.*")
    return rows.withColumn("quality", (F.col("score") >= CUT).cast("int"))


def good_only(docs: DataFrame, text: str = "text", limit: int = FIT_DOCS) -> DataFrame:
    """The documents that the classifier keeps."""
    own = docs.withColumn("__judged", judged(F.col(text), learn(docs, text, limit)))
    return own.where(F.col("__judged.score") >= CUT).drop("__judged")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(documents(spark, sf_dir))
