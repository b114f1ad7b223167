"""Operator 6: exact top-k inner products over an impact-ordered, score-at-a-time index.

Components become integers floor(256 x). Rows are packed into blocks of ``BLOCK`` vectors and the queries into blocks of
``QUERIES``; every block of queries meets every block of rows once (a stated query set against all rows, in blocks).

In a block, a posting is a row's component as its deviation from the dimension's median, and its impact the deviation's
size, quantised into ``LEVELS`` levels of the dimension's largest. A segment holds the postings of one level. The queries
of a block read the segments together, by descending impact, and add each posting times the query's component to their
accumulators. What a query has not read changes a score by at most the sum, over the dimensions, of its component's size
times the largest impact below the level, so every score lies within that of its accumulator. A query stops reading only
when this proves all but a small set of rows to be below the k-th best (ties stay in the set); the set's scores are then
computed exactly from the vectors, so the result is that of brute force. Without proof all segments are read.

Defined results: vectors that are null or hold a null or non-finite component, and rows with a null vec_id, take no part.
Identical rows (id and vector) count once; a vec_id with different vectors is a query and a candidate with each; a
candidate never has its query's vec_id. Only vectors of equal length meet. Queries without candidates have no rows. Scores
must fit in 64 bits; where sums could pass 2^53 they are taken in Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from envspark.llm.common import write_shared
from envspark.session import read_table

K, EVERY, SCALE = 5, 50, 256
BLOCK, QUERIES, LEVELS, SALTS = 8192, 256, 8, 16
#: A query stops when the set to rescore is proven to be at most 1 / RESCORE of the block.
RESCORE = 16


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): distinct rows that take part, with integer components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    ok = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, bad))
    return ok.select(F.col(vec_id).cast("bigint").alias("vec_id"), whole.alias("v")).distinct()


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(block, dims, ids, matrix): vectors of one length, ``size`` at most, as packed 64-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        number = TaskContext.get().partitionId() << 32

        def packed(dims: int, rows: list) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids = np.array([r[0] for r in rows], np.int64)
            matrix = np.array([r[1] for r in rows], np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([dims], pa.int32()), pa.array([ids.tobytes()], pa.binary()),
                 pa.array([matrix.tobytes()], pa.binary())], names=["block", "dims", "ids", "matrix"])

        for batch in batches:
            for vec_id, v in zip(*[c.to_pylist() for c in batch.columns]):
                rows = waiting.setdefault(len(v), [])
                rows.append((vec_id, v))
                if len(rows) == size:
                    yield packed(len(v), waiting.pop(len(v)))
        for dims, rows in waiting.items():
            yield packed(dims, rows)

    return vectors.mapInArrow(run, "block bigint, dims int, ids binary, matrix binary")


class Index:
    """The impact-ordered segments of one block."""

    def __init__(self, matrix: np.ndarray, ids: np.ndarray):
        self.matrix, self.ids = matrix, ids
        n, dims = matrix.shape
        centre = np.sort(matrix, axis=0)[n // 2]
        deviation = matrix - centre
        size = np.abs(deviation)
        self.peak = size.max(0)
        self.largest = np.abs(matrix).max(0)
        level = np.array([[int(x) * LEVELS // (int(p) + 1) for x, p in zip(r, self.peak)] for r in size]) if self._wide() else (
            size * LEVELS // (self.peak + 1))
        self.segments = []  # postings of a level (0 elsewhere), and the largest impact of each dimension below it
        for at in range(LEVELS - 1, -1, -1):
            here = level == at
            if here.any():
                self.segments.append((np.where(here, deviation, 0).astype(float), np.where(level < at, size, 0).max(0)))

    def _wide(self) -> bool:
        return bool(len(self.peak)) and int(self.peak.max()) >= 1 << 58

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(query's place, its k best (score, vec_id) of the block without the query's own vec_id)."""
        reach = [sum(abs(int(x)) * (int(p) + int(m)) for x, p, m in zip(q, self.peak, self.largest)) for q in queries]
        fits = np.array([r < 1 << 53 for r in reach])
        for j in np.flatnonzero(~fits).tolist():
            rows = np.flatnonzero(self.ids != own[j])
            scores = self.matrix[rows].astype(object) @ queries[j].astype(object) if len(rows) else []
            yield j, sorted(((int(s), int(i)) for s, i in zip(scores, self.ids[rows])), key=lambda x: (-x[0], x[1]))[:k]
        reading = np.flatnonzero(fits)
        known = np.zeros((len(queries), len(self.ids)))  # exact: sums stay below 2^53
        segments = self.segments or [(np.zeros(self.matrix.shape), np.zeros(self.matrix.shape[1], np.int64))]
        for place, (postings, below) in enumerate(segments):
            if not len(reading):
                return
            known[reading] += queries[reading].astype(float) @ postings.T
            unread = np.abs(queries[reading]) @ below
            last, left = place == len(segments) - 1, []
            # a row at the mean cannot be ruled out yet: no need to look at each row
            early = 2 * unread >= known[reading].max(1) - known[reading].mean(1)
            for j, rest, wait in zip(reading.tolist(), unread.tolist(), early.tolist()):
                if wait and not last:
                    left.append(j)
                    continue
                others = self.ids != own[j]
                value = known[j][others]
                if len(value) <= k:
                    possible = np.flatnonzero(others)
                else:
                    bar = np.partition(value, len(value) - k)[len(value) - k] - rest
                    possible = np.flatnonzero(others & (known[j] + rest >= bar))
                if len(possible) * RESCORE > len(self.ids) and not last:
                    left.append(j)
                    continue
                scores, ids = self.matrix[possible] @ queries[j], self.ids[possible]
                best = np.lexsort((ids, -scores))[:k]
                yield j, list(zip(scores[best].tolist(), ids[best].tolist()))
            reading = np.array(left, np.int64)


def _search(k: int):
    schema = pa.schema([("asked", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            ids, matrices = batch.column("ids"), batch.column("matrix")
            for row, (asked, width) in enumerate(zip(batch.column("asked").to_pylist(), batch.column("dims").to_pylist())):
                own = np.frombuffer(ids[row].as_buffer(), np.int64)  # where they lie in the batch, not copied
                vectors = np.frombuffer(matrices[row].as_buffer(), np.int64).reshape(len(own), width)
                if asked is None:  # a block; the query blocks that ask it follow
                    index = Index(vectors, own)
                    continue
                found = [(asked * QUERIES + j, int(own[j]), vec_id, score) for j, best in index.top(vectors, own, k)
                         for score, vec_id in best]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows for every query. Both: (vec_id, v) of ``integer_vectors``."""
    spark = rows.sparkSession
    stored = write_shared(blocks(rows, block), "topk-blocks")
    asked = write_shared(blocks(queries, QUERIES), "topk-queries")
    # all vectors may have one length, so the numbers of the blocks are dealt out by salts as well
    names = stored.select("block", "dims", (F.hash("block") % SALTS + SALTS).alias("salt"))
    salts = F.explode(F.sequence(F.lit(1), F.lit(2 * SALTS - 1))).alias("salt")
    sent = asked.select(F.col("block").alias("asked"), "dims", "ids", "matrix", salts)
    met = names.join(sent, ["dims", "salt"]).select("block", "asked", "dims", "ids", "matrix")
    # a block goes once to the task of its number, ahead of the query blocks that ask it
    met = stored.select("block", F.lit(None).cast("bigint").alias("asked"), "dims", "ids", "matrix").unionByName(met)
    met = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions(
        "block", F.col("asked").asc_nulls_first())
    best = met.mapInArrow(_search(k), "asked bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("asked").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = write_shared(integer_vectors(read_table(spark, sf_dir, "embeddings")), "topk-vectors")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


ORACLE_SQL = f"""
WITH v AS (
  SELECT DISTINCT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id,
         coalesce(list_inner_product(q.v, c.v), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {K}
"""
