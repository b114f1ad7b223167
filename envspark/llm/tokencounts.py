"""Operator 13: token counts of whole texts from counts of distinct pre-tokens.

A piece model may join two neighbouring characters only if some piece of its vocabulary holds them side by side. Where no
piece does, the merges of the two sides never meet, and the tokens of the text are those of the sides. The places taken
here: before a run of blanks (no piece goes on with a blank after another character) and around characters that stand in
no piece of two or more characters (digits, line ends, tabs in common models). The stretches between are the pre-tokens.

1. Pre-tokens and how often they occur are counted in every task with a table of bounded size and summed by a shuffle.
2. Each distinct pre-token goes through the library once. Its number of pieces stands in a dictionary in the shared folder.
3. Each document's pre-token frequencies are joined to the dictionary, and frequency times pieces is summed by document.

The join has two ways. The FREQUENT most frequent pre-tokens of at most FREQUENT_CHARS characters are broadcast (the bound
of the broadcast: 100,000 short texts, a few MB, whatever the input); all others go through a shuffle. A pre-token that
is not among the first K occurs at most 1 / K of all times, so no hot key reaches that shuffle; longer ones, which may be
frequent, are counted in the document's own visit when they occur in it, as they would be too long to ship.

Defined results: a null text is empty and has no tokens. Empty and white texts follow the library, as do special strings
inside texts. doc_id is carried through and may be null or repeated: each row is counted on its own, under a row number
that its partition gives it. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm.common import documents, python_texts, write_shared

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIMIT = 4096
#: The broadcast part of the dictionary: so many pre-tokens of so many characters at most.
FREQUENT, FREQUENT_CHARS = 100_000, 48
#: Pre-tokens that a task counts before it passes them on and starts anew.
TABLE = 200_000
BLANK = "▁"
#: Texts that a normaliser other than the identity changes.
_PROBES = ["é", "Ａ", "ﬁ", "a  b", " a", "a ", "\t", "　", "A​b"]


class Pieces:
    """Pre-tokens of texts, and the number of pieces of one, under one model."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(self.model.vocab_size()) if not self.model.is_byte(i) and not self.model.is_control(i)]
        long = [p for p in (self.model.id_to_piece(i) for i in ids if not self.model.is_unknown(i)) if len(p) > 1]
        joined = set("".join(long))
        alone = [c for c in map(chr, range(128)) if c not in joined and c != " "]
        crossing = [p for p in long if BLANK in p.lstrip(BLANK)]
        changed = [p for p in _PROBES if self.model.normalize(p).removeprefix(BLANK) != p.replace(" ", BLANK)
                   and self.model.normalize(p) != BLANK + p.replace(" ", BLANK)]
        if crossing or changed or not alone:
            raise ValueError(f"{path}: pieces across blanks, a normaliser or no separate characters; texts cannot be cut")
        self.prefix = " " if self.model.normalize("a") == BLANK + "a" else ""
        self.alone = alone[0]
        self.base = len(self.model.encode(self.alone))
        chars = "".join(map(re.escape, alone))
        self.cut = re.compile(f" *[^{chars} ]+| +|[{chars}]")

    def units(self, text: str) -> list[str]:
        """The pre-tokens of a text, in order; joined, they are the text with the model's prefix."""
        return self.cut.findall(self.prefix + text.replace(BLANK, " ")) if text else []

    def count(self, units: list[str]) -> list[int]:
        """The number of pieces of each pre-token: behind a separate character, so the model adds no prefix to it."""
        return [len(ids) - self.base for ids in self.model.encode([self.alone + u for u in units], num_threads=1)]


@functools.lru_cache(maxsize=2)
def pieces(path: str = MODEL) -> Pieces:
    """One per worker and file."""
    return Pieces(path)


def dictionary(docs: DataFrame, text: str = "text", path: str = MODEL) -> DataFrame:
    """(unit, uses, n_pieces) of every distinct pre-token of at most FREQUENT_CHARS characters."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, table = pieces(path), Counter()

        def passed_on() -> pa.RecordBatch:
            units = [u for u in table if len(u) <= FREQUENT_CHARS]
            return pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array([table[u] for u in units], pa.int64())],
                                              names=["unit", "uses"])

        for batch in batches:
            for t in python_texts(batch.column(0)):
                table.update(p.units(t))
                if len(table) > TABLE:
                    yield passed_on()
                    table.clear()
        yield passed_on()

    @F.arrow_udf("bigint")
    def n_pieces(units: pa.Array) -> pa.Array:
        return pa.array(pieces(path).count(units.to_pylist()), pa.int64())

    uses = docs.select(text).mapInArrow(counted, "unit string, uses bigint").groupBy("unit").agg(F.sum("uses").alias("uses"))
    return uses.withColumn("n_pieces", n_pieces("unit"))


def token_counts(docs: DataFrame, text: str = "text", path: str = MODEL, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs``."""
    spark = docs.sparkSession
    known = write_shared(dictionary(docs, text, path), "token-units")
    most = known.orderBy(F.col("uses").desc(), "unit").limit(frequent).select("unit", "n_pieces").toArrow()
    table = spark.sparkContext.broadcast(dict(zip(most["unit"].to_pylist(), most["n_pieces"].to_pylist())))
    rest_type = pa.list_(pa.struct([("unit", pa.string()), ("times", pa.int64())]))

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, get, part, n = pieces(path), table.value.get, TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = python_texts(batch.column(1))
            sums, rests, numbers = [], [], []
            for t in texts:
                total, rest, long = 0, [], []
                for unit, times in Counter(p.units(t)).items():
                    size = get(unit)
                    if size is not None:
                        total += times * size
                    elif len(unit) <= FREQUENT_CHARS:
                        rest.append({"unit": unit, "times": times})
                    else:
                        long.append((unit, times))
                for (_, times), size in zip(long, p.count([u for u, _ in long])):
                    total += times * size
                sums.append(total)
                rests.append(rest)
                numbers.append((part << 40) + n)
                n += 1
            yield pa.RecordBatch.from_arrays([
                pa.array(numbers, pa.int64()), batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(sums, pa.int64()), pa.array(rests, rest_type)], names=["row", "doc_id", "n_bytes", "n_tokens", "rest"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        visited, "row bigint, doc_id bigint, n_bytes bigint, n_tokens bigint, rest array<struct<unit string, times bigint>>")
    if known.limit(frequent + 1).count() <= frequent:  # the broadcast is the whole dictionary
        return rows.select("doc_id", "n_bytes", "n_tokens")
    # one line for the document itself (its unit is its row number behind a NUL, so such lines spread), one for each other pre-token
    own = F.struct(F.concat(F.lit("\0"), F.col("row").cast("string")).alias("unit"), F.lit(0).cast("bigint").alias("times"))
    lines = rows.select("row", "doc_id", "n_bytes", "n_tokens", F.explode(F.concat(F.array(own), "rest")).alias("u")).select(
        "row", "u.unit", "u.times", *[F.when(F.col("u.times") == 0, F.col(c)).alias(c) for c in ("doc_id", "n_bytes", "n_tokens")])
    joined = lines.join(known.select("unit", "n_pieces"), "unit", "left")
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
        F.sum(F.coalesce("n_tokens", F.lit(0)) + F.col("times") * F.coalesce("n_pieces", F.lit(0))).alias("n_tokens")).drop("row")


def op13_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
