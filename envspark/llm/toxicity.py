"""Operator 3: toxicity by a weighted finite-state grammar over clauses.

Six small transducers read the words of a text. The lexical one maps words and word beginnings to symbols: insult (with
a weight), threat, future, target, negation, reported speech, contrast, clause end. Five more follow the context, each with
two states: target, negation, reported speech and future, which every clause end resets, and abuse, which an accepted or
waiting insult sets for the rest of the text. ``compose`` multiplies them into one transition table whose states are the
contexts. What matches is a pattern, never a word:

* *targeted*: an insult in a clause with a target, before or after it; *negated* and *reported*: one in such a clause;
* *threat*: a threat with a target or in the future; *threat_off*: a negated or reported one;
* *piled*: an insult after another insult. The first one waits without any weight and counts when the second comes.

An insult that is alone in its text, without target, negation or reported speech in its clause, emits nothing, and so does a
threat word without target or future. A text's features are the weights that its patterns emitted in each class; a logistic
model turns them into the score. (Piling up is a pattern because the given toxic documents hold insults without targets.)

The insult weights and the logistic model are learned from ``labels.toxic``, only from rows whose crc32(doc_id as text)
mod 4 is not 2, and from the ``TRAIN_DOCS`` labelled documents with the smallest hash of their id at most (the documented
bound of the fit; of rows with one id the one of the least hash). Equal texts with equal labels train once. Words and their beginnings of 4 and 5
letters become insults where their share of toxic witnesses is too high for chance (log likelihood ratio against the
logarithm of the number of candidates); near copies of a label, which share their least or greatest hash of a long word,
are one witness of a word. Fixed seed words serve where the labelled rows say nothing. labels, lang, source and doc_id are never
inputs of a score.

Defined results: null and empty texts score as a text without any pattern; predicted is 1 from 0.3 on; a null doc_id is not
held out and not learned from; a doc_id with several labels is toxic if one says so; without usable labels the fixed
seeds and prior coefficients score. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm.common import documents, labels, python_texts, write_shared

TRAIN_DOCS, CUT, HELD_OUT, FOLDS = 20_000, 0.3, 2, 4
STEMS = (4, 5)
#: About exp(CHANCE) candidates may get into the lexicon by chance.
CHANCE = 0.0
#: Entries of a worker's word table before it starts anew.
TABLE_WORDS = 100_000

# Seed words of the lexical transducer.
INSULT = set("idiot moron stupid scum trash loser worthless pathetic disgusting imbecile dimwit bastard dumb jerk "
             "idioten dummkopf abschaum arschloch crétin imbécile connard salaud estúpido imbécil basura".split())
THREAT = set("kill hurt destroy beat shoot stab burn punch strangle töten umbringen schlagen tuer frapper matar golpear".split())
FUTURE = set("will gonna shall going should must werde werden wirst vais va allons voy vas vamos".split())
TARGET = set("you your yours yourself ya he she they them du dich dir ihr euch tu te toi vous tú ti usted ustedes vosotros".split())
NEGATION = set("not no never isn't aren't don't wasn't nicht kein keine nie ne pas jamais non nunca jamás".split())
REPORTED = set("said says wrote claimed claims called quoted according sagte sagt schrieb laut disait écrit selon dijo dice "
               "escribió según".split())
CONTRAST = set("but however aber sondern mais pero sino".split())

O, END, I, K, FUT, T, N, R, C = range(9)
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;:\n]")
SEED_WEIGHT = 3.0

#: Feature classes, the prior coefficients that the fit is drawn to, and the prior intercept.
CLASSES = ("piled", "targeted", "negated", "reported", "threat", "threat_off")
PRIOR = np.array([1.5, 1.8, 0.6, 0.8, 1.5, 0.3])
PRIOR_INTERCEPT = -4.0


def machine(lasting: bool = False, **moves: int):
    """A two-state machine: symbol -> state; other symbols keep the state. A clause end resets it unless it is lasting."""
    return ({} if lasting else {END: 0}) | {globals()[name]: state for name, state in moves.items()}


MACHINES = (machine(T=1), machine(N=1, C=0), machine(R=1, C=0), machine(FUT=1), machine(lasting=True, I=1))


def compose(machines=MACHINES) -> list[list[int]]:
    """The product's transition table: [state][symbol] -> state; bit k of a state is machine k's state."""
    states = range(1 << len(machines))
    step = lambda s, x: sum((m.get(x, s >> k & 1)) << k for k, m in enumerate(machines))
    return [[step(s, x) for x in range(C + 1)] for s in states]


#: What an insult does that no pattern has taken yet, and a threat word that makes none.
WAIT, NOTHING = -2, -1


def emitted(state: int, symbol: int) -> int:
    """The class of an insult or threat read in a context."""
    target, negated, reported, future, abuse = (state >> k & 1 for k in range(5))
    if symbol == I:
        return 2 if negated else 3 if reported else 1 if target else 0 if abuse else WAIT
    return NOTHING if not (target or future) else 5 if negated or reported else 4


TABLE = compose()
EMIT = [[emitted(s, x) if x in (I, K) else NOTHING for x in range(C + 1)] for s in range(len(TABLE))]


@dataclass
class Grammar:
    """The lexical weights (words and stems) and the logistic model."""

    weights: dict[str, float] = field(default_factory=lambda: {w: SEED_WEIGHT for w in INSULT})
    stems: dict[str, float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=lambda: PRIOR.tolist())
    intercept: float = PRIOR_INTERCEPT

    def __post_init__(self):
        self._words: dict[str, tuple[int, float]] = {}

    def __getstate__(self):
        return (self.weights, self.stems, self.coefficients, self.intercept)

    def __setstate__(self, state):
        self.weights, self.stems, self.coefficients, self.intercept = state
        self._words = {}

    def symbol(self, word: str) -> tuple[int, float]:
        """The lexical transducer: symbol and weight of a word."""
        w = self.weights.get(word)
        if w is None:
            w = max([self.stems[word[:k]] for k in STEMS if word[:k] in self.stems], default=0.0)
        if w > 0:
            return I, w
        for symbol, words in ((K, THREAT), (FUT, FUTURE), (T, TARGET), (N, NEGATION), (R, REPORTED), (C, CONTRAST)):
            if word in words:
                return symbol, 1.0
        return (END, 0.0) if word in ".!?;:\n" else (O, 0.0)

    def features(self, text: str) -> list[float]:
        """Emitted weight by class, and the number of clauses that emitted."""
        table = self._words
        if len(table) > TABLE_WORDS:
            table.clear()
        total = [0.0] * len(CLASSES)
        # first: an insult that waits for a target in its clause or for a second insult; piled: the clause's piled weight
        state, first, clause, piled = 0, 0.0, False, 0.0
        for word in _TOKEN.findall(text.lower()):
            known = table.get(word)
            if known is None:
                known = table[word] = self.symbol(word)
            symbol, weight = known
            if not symbol:
                continue
            c = EMIT[state][symbol]
            if c == WAIT:
                first, clause = weight, True
            elif c >= 0:
                total[c] += weight
                if symbol == I and first:  # the second insult of the text
                    total[0] += first
                    piled += first if clause else 0.0
                    first, clause = 0.0, False
                piled += weight if c == 0 else 0.0
            if symbol == T:  # a target that comes later takes what its clause has piled up, or the insult that waits
                total[0] -= piled
                total[1] += piled + (first if clause else 0.0)
                piled = 0.0
                if clause:
                    first, clause = 0.0, False
            elif symbol == END:
                clause, piled = False, 0.0
            state = TABLE[state][symbol]
        return total

    def score(self, text: str) -> float:
        z = self.intercept + sum(c * math.log1p(max(0.0, x)) for c, x in zip(self.coefficients, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, marks: DataFrame, text: str, limit: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``limit`` labelled documents that are not held out, read from all documents once."""
    usable = marks.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    # one row an id, so the limit holds however often an id is repeated, and one an equal text; the same rows in every run
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    one_each = rows.groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text", "toxic")
    return write_shared(one_each, "toxicity-training")


def witnesses(rows: DataFrame) -> DataFrame:
    """(text, toxic): one text for those of a label that share their least or their greatest hash of a long word, the same one
    in every run. Only the words of the lexicon are counted over these; the model is fitted on all rows."""
    long = F.transform(F.regexp_extract_all("text", F.lit(r"\p{L}{9,}"), F.lit(0)), lambda w: F.xxhash64(w))
    keyed = rows.select("text", "toxic", F.coalesce(F.array_min(long), F.xxhash64("text")).alias("lo"),
                        F.coalesce(F.array_max(long), F.xxhash64("text")).alias("hi"))
    first = lambda df, key, *rest: df.groupBy(key, "toxic").agg(
        F.min_by(F.struct("text", *rest), F.struct(F.xxhash64("text"), "text")).alias("r")).select("toxic", "r.*")
    return first(first(keyed, "lo", "hi"), "hi").select("text", "toxic")


def learn_words(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and of stems (log odds) that are toxic beyond chance."""
    rows = write_shared(witnesses(rows), "toxicity-witnesses")
    counts = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, toxic = counts.n or 0, counts.t or 0
    if not toxic or toxic == n:
        return {}, {}
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    stems = [F.transform(F.filter(words, lambda w: F.length(w) >= k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))
             for k in STEMS]
    tokens = F.array_distinct(F.concat(words, *stems))
    seen = (rows.select("toxic", F.explode(tokens).alias("token")).groupBy("token")
            .agg(F.sum("toxic").alias("a"), F.count("*").alias("k")).where("k >= 3"))
    seen = write_shared(seen, "toxicity-words")  # read three times below
    candidates = max(2, seen.count())
    base = toxic / n
    share = F.col("a") / F.col("k")
    ratio = F.col("a") * F.log(share / base) + F.when(share < 1, (F.col("k") - F.col("a")) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("k") - F.col("a") + 0.5) / (n - toxic + 1))
    found = seen.where((F.col("a") > 0) & (share >= 0.8) & (ratio > math.log(candidates) - CHANCE)).select("token", odds.alias("w"))
    chosen = {r.token: float(r.w) for r in found.collect()}
    seeds = {r.token: r.a / r.k for r in seen.where(F.col("token").isin(sorted(INSULT))).collect()}
    words = {w: SEED_WEIGHT for w in INSULT if seeds.get(w, 1.0) >= 0.5}
    return words | {t: w for t, w in chosen.items() if t[-1] != "*"}, {t[:-1]: w for t, w in chosen.items() if t[-1] == "*"}


def fit_logistic(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> tuple[list[float], float]:
    """Logistic regression by Newton steps, its coefficients drawn to the prior ones."""
    a = np.column_stack([np.log1p(np.maximum(x, 0)), np.ones(len(x))])
    prior = np.append(PRIOR, PRIOR_INTERCEPT)
    pull = np.diag(np.append(np.full(len(PRIOR), strength), strength / 10))
    beta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + pull, a.T @ (y - p) - pull @ (beta - prior))
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1].tolist(), float(beta[-1])


def learn(docs: DataFrame, marks: DataFrame, text: str = "text", limit: int = TRAIN_DOCS) -> Grammar:
    """The grammar with weights and model learned from labelled, not held-out documents."""
    rows = training_rows(docs, marks, text, limit)
    words, stems = learn_words(rows)
    if not words:
        return Grammar()
    grammar = Grammar(words, stems)

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([grammar.features(t) for t in python_texts(texts)], pa.list_(pa.float64()))

    found = rows.select(run("text").alias("x"), "toxic").collect()  # TRAIN_DOCS rows of six numbers
    x, y = np.array([r.x for r in found]), np.array([r.toxic for r in found], float)
    return Grammar(words, stems, *fit_logistic(x, y))


def score(text: Column, grammar: Grammar) -> Column:
    """The score of a text column, 0 to 1."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([grammar.score(t) for t in python_texts(texts)], pa.float64())

    return run(text)


def scored(docs: DataFrame, marks: DataFrame, text: str = "text", limit: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                       score(F.col(text), learn(docs, marks, text, limit)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def without_toxic(docs: DataFrame, marks: DataFrame, text: str = "text", limit: int = TRAIN_DOCS) -> DataFrame:
    """The documents with a score below the cut."""
    own = docs.withColumn("__toxicity", score(F.col(text), learn(docs, marks, text, limit)))
    return own.where(F.col("__toxicity") < CUT).drop("__toxicity")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), labels(spark, sf_dir))
