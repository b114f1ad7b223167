"""Operator 11: ranked lexical search over bags of item words, each distinct bag scored once.

1. *Restrict.* Items are dealt into blocks of a bounded number of terms. A block's vocabulary goes to the tasks, and each
   document becomes a bag: the tf vector of its terms in that vocabulary, packed, with n (all its terms) and a hash. The
   bags stand once in the shared folder.
2. *Statistics.* N, L and every df come from all bags, added up in the tasks first.
3. *Classes.* The score of a document depends on its tf vector and on m alone. Bags are grouped by hash, m and the vector
   itself, so a hash only deals them out and equal bytes decide. A group of copies, however large, is added up where it
   lies before anything moves.
4. *Score.* Each class is scored once against the block's items, term by term through the items that hold the term, in
   64-bit integers. A task keeps, for each item, the best K classes by score and smallest doc_id, so what moves is bounded.
5. *Expand.* At most K classes an item can hold its best K documents: each class before another one has a member that comes
   before all members of the other. Members of those classes are listed by ascending doc_id, K a class, and ranked.

Bounds: a block has at most BLOCK_TERMS item terms and BLOCK_ITEMS items (one item with more terms is a block of its own);
its vocabulary and its winning classes (BLOCK_ITEMS x K keys) are what is broadcast. More items mean more blocks, one
pass over the documents each.

Defined results: null texts and texts without terms are no documents of the statistics and are never found; items without
terms have no rows. Every row is a document and every row of items an item: repeated rows are ranked each. Equal scores
go by ascending doc_id, null ids last; rows of one doc_id in any order (they differ in nothing that is returned). Empty
tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from envspark.llm.common import documents, write_shared
from envspark.session import read_table

K = 50
BLOCK_TERMS, BLOCK_ITEMS = 200_000, 2_000
#: Cells of the score table (classes x items) that a task fills at once.
CELLS = 1 << 20
SCALE, SATURATION, BASE, LENGTH_WEIGHT = 1_000_000_000, 1000, 50, 50

#: A-Z become lower case, all ASCII characters but letters and digits become blanks; bytes of other characters stay.
_FOLD = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def bags(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text") -> DataFrame:
    """(doc_id, n, hash, bag) of each row that has terms; bag: (term, tf) pairs of 32-bit integers by term."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for batch in batches:
            out = []
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = terms(t)
                if not words:
                    continue
                tf = sorted((k, f) for w, f in Counter(words).items() if (k := number(w)) is not None)
                bag = np.array(tf, "<u4").tobytes()
                out.append((doc_id, len(words), hashlib.md5(bag).digest(), bag))
            ids, n, hashes, packed = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()),
                                              pa.array(packed, pa.binary())], names=["doc_id", "n", "hash", "bag"])

    return docs.select(F.col("doc_id").cast("bigint"), text).mapInArrow(run, "doc_id bigint, n bigint, hash binary, bag binary")


def _unpacked(bag: bytes) -> np.ndarray:
    return np.frombuffer(bag, "<u4").reshape(-1, 2)


def document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    """How many bags hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for bag in batch.column(0).to_pylist():
                df[_unpacked(bag)[:, 0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])

    total = np.zeros(size, np.int64)
    rows = found.select("bag").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    total[rows["term"].to_numpy()] = rows["df"].to_numpy()
    return total


def length_part(n: Column, docs: int, length: int) -> Column:
    """m of a document with n terms; the product is exact beyond 64 bits."""
    wide = F.lit(LENGTH_WEIGHT).cast("decimal(2,0)") * n.cast("decimal(18,0)") * F.lit(docs).cast("decimal(12,0)")
    rest = wide % F.lit(max(length, 1)).cast("decimal(20,0)")
    return F.lit(100 - BASE).cast("bigint") + ((wide - rest) / F.lit(max(length, 1)).cast("decimal(20,0)")).cast("bigint")


def classes_of(found: DataFrame) -> DataFrame:
    """One row per (hash, m, bag) among bags that are not empty: its smallest doc_id."""
    return found.filter(F.octet_length("bag") > 0).groupBy("hash", "m", "bag").agg(F.min("doc_id").alias("first"))


def best_classes(classes: DataFrame, weights: np.ndarray, held: list[tuple[int, int]], n_items: int, k: int) -> DataFrame:
    """(item, score, first, hash, m): of every task, the best k classes of each item. ``held``: (term, item) pairs."""
    pairs = np.array(sorted(held), np.int64).reshape(-1, 2)
    starts = np.searchsorted(pairs[:, 0], np.arange(len(weights) + 1))
    sent = classes.sparkSession.sparkContext.broadcast((weights, starts, pairs[:, 1].astype(np.int32)))
    last = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, start, item_of = sent.value
        rows = max(1, CELLS // n_items)
        floor = np.ones(n_items, np.int64)  # a class below this score cannot be among an item's best
        kept = [np.empty(0, np.int64) for _ in range(4)]  # item, score, first, place in keys
        keys: list[tuple[bytes, int]] = []

        def reduced() -> None:
            nonlocal kept, keys
            item, score, first, place = kept
            order = np.lexsort((first, -score, item))
            item = item[order]
            rank = np.arange(len(item)) - np.searchsorted(item, item)
            order = order[rank < k]
            full = np.flatnonzero(rank == k - 1)
            floor[item[full]] = score[np.lexsort((first, -score, kept[0]))[full]]
            place, new = np.unique(place[order], return_inverse=True)
            keys = [keys[i] for i in place.tolist()]
            kept = [kept[0][order], score[order], first[order], new]

        for batch in batches:
            for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
                packed, m = part.column("bag").to_pylist(), part.column("m").to_numpy(zero_copy_only=False)
                sizes = np.array([len(b) // 8 for b in packed])
                entries = _unpacked(b"".join(packed)).astype(np.int64)
                term, tf = entries[:, 0], entries[:, 1]
                row = np.repeat(np.arange(len(packed)), sizes)
                gain = weight[term] * ((SCALE * tf) // (SATURATION * tf + 20 * m[row]))
                wide = start[term + 1] - start[term]
                ends = np.cumsum(wide)
                at = np.arange(ends[-1]) + np.repeat(start[term] - ends + wide, wide)
                score = np.zeros(len(packed) * n_items, np.int64)
                np.add.at(score, np.repeat(row, wide) * n_items + item_of[at], np.repeat(gain, wide))
                score = score.reshape(len(packed), n_items)
                hit, item = np.nonzero(score >= floor)
                first = part.column("first").fill_null(last).to_numpy(zero_copy_only=False)
                used, new = np.unique(hit, return_inverse=True)
                hashes = part.column("hash")
                base = len(keys)
                keys += [(hashes[i].as_py(), int(m[i])) for i in used.tolist()]
                kept = [np.concatenate(x) for x in zip(kept, (item, score[hit, item], first[hit], base + new))]
                if len(kept[0]) > 4 * k * n_items:
                    reduced()
        if len(kept[0]):
            reduced()
            item, score, first, place = kept
            yield pa.RecordBatch.from_arrays([
                pa.array(item.astype(np.int32)), pa.array(score), pa.array(first, mask=first == last),
                pa.array([keys[i][0] for i in place.tolist()], pa.binary()),
                pa.array([keys[i][1] for i in place.tolist()], pa.int64())], names=["item", "score", "first", "hash", "m"])

    return classes.select("hash", "m", "bag", "first").mapInArrow(
        run, "item int, score bigint, first bigint, hash binary, m bigint")


def blocks_of(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, set[bytes]]]]:
    """The items with their distinct terms, some at a time; the driver holds one block."""
    block, size = [], 0
    for r in items.select(F.col(item_id).cast("bigint"), text).toLocalIterator():
        own = set(terms(r[1]))
        if not own:
            continue
        if block and (size + len(own) > BLOCK_TERMS or len(block) >= BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append((r[0], own))
        size += len(own)
    if block:
        yield block


def _searched(docs: DataFrame, block: list[tuple[int | None, set[bytes]]], text: str, k: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(own for _, own in block))))}
    found = write_shared(bags(docs, vocabulary, text), "lexical-bags")
    total = found.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    df = document_frequencies(found, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * f + 1))) for f in df.tolist()], np.int64)
    held = [(vocabulary[t], i) for i, (_, own) in enumerate(block) for t in own]
    found = found.withColumn("m", length_part(F.col("n"), total.docs, total.length or 0))
    order = [F.col("score").desc(), F.col("first").asc_nulls_last()]
    best = best_classes(classes_of(found), weights, held, len(block), k)
    best = write_shared(best.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(
        F.col("place") <= k), "lexical-classes")
    wanted = F.broadcast(best.select("hash", "m").distinct())  # at most k classes an item of the block
    members = found.select("doc_id", "hash", "m").join(wanted, ["hash", "m"])
    by_id = Window.partitionBy("hash", "m").orderBy(F.col("doc_id").asc_nulls_last())
    members = members.withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= k)
    ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ids = docs.sparkSession.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id bigint")
    hits = best.join(members, ["hash", "m"]).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return hits.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
           k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    out = docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in blocks_of(items, item_id, item_text):
        out = out.unionByName(_searched(docs, block, text, k))
    return out


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH fold AS (SELECT doc_id, row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, d, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM fold),
tf AS (SELECT d, term, count(*) AS tf FROM words GROUP BY d, term),
lengths AS (SELECT d, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY d),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM lengths),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
long AS (SELECT d, doc_id, 100 - 50 + ((50 * n * docs) // len) AS m FROM lengths, total),
item AS (SELECT row_number() OVER () AS i, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
asked AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM item),
scores AS (SELECT i, item_id, doc_id, d, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN long USING (d) GROUP BY i, item_id, doc_id, d),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
