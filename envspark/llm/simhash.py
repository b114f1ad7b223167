"""Operator 7: SimHash near-duplicates through deletion-variant signatures.

Fingerprint: over all shingles (repeats included) of a text's words, a bit is 1 if more than half of the 64-bit hashes
have it. Two fingerprints link at ``max_bits`` = 2 or fewer differing bits. A fingerprint is cut into two segments of 32
bits, so that one of them differs by at most one bit. Each segment is indexed under its 32 one-wildcard variants (one
bit taken out): fingerprints that share a variant are candidates and are verified on all 64 bits.

Equal fingerprints are one node from the start, so thousands of exact copies cost one signature. A variant that more than
``bucket`` fingerprints share is not paired: its members go to an exact way whose work grows with their number alone.
Each member x is put under x itself and its 64 one-bit neighbours; the members that meet under one point z all lie within
one bit of z, hence within two bits of each other, and x and y at two bits meet under the point between them. So the
members of a point are linked to the smallest of them, no pairs are needed, and a point has 65 members at most.

Groups are the connected components over the links, found by alternating large-star and small-star steps on the table of
links, each step written to the shared folder (nothing is kept on the driver).

Defined results: null, empty and blank texts have fingerprint zero and link like any other. A component's id is the
smallest doc_id in it; a null doc_id counts only where there is no other. Repeated rows are separate rows of one
component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm.common import documents, python_texts, write_shared

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: Most fingerprints of one variant that are compared with each other; larger ones go the exact way by points.
BUCKET = 32
HALF = 32


def fingerprint_of(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text."""
    words = text.encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # bounded memory for long texts
        upto = ends[min(shingle, len(words)) - 1:][k:k + (1 << 16)] - 1
        spans = zip(starts[k:k + len(upto)].tolist(), upto.tolist())
        h = np.array([digest(line[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed 64-bit integer (the same bits)."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t, shingle) for t in python_texts(texts)], np.uint64).view(np.int64))

    return run(text)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def variants(nodes: DataFrame) -> DataFrame:
    """(key, segment, fp): the 2 x 32 one-wildcard variants of each distinct fingerprint.

    The key holds a segment without one bit (31 bits), the bit's place and the segment's number.
    """
    low = (1 << HALF) - 1
    one = (nodes.select("fp", F.posexplode(F.array(F.col("fp").bitwiseAND(F.lit(low)), F.shiftrightunsigned("fp", HALF))))
           .withColumnRenamed("pos", "side").withColumnRenamed("col", "part"))
    spread = one.select("fp", "side", "part", F.explode(F.sequence(F.lit(0), F.lit(HALF - 1))).alias("bit"))
    below = F.expr("part & (shiftleft(1L, bit) - 1)")
    above = F.expr("shiftleft(shiftright(part, bit + 1), bit)")
    return spread.select((above.bitwiseOR(below) + F.expr("shiftleft(bit + 32L * side, 31)")).alias("key"), "fp")


def _buckets(bucket: int, max_bits: int):
    """Over rows sorted by key: verified pairs (a < b) of small buckets; (fp, null) for each member of a large one."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        hot = None  # the key of a large bucket that the last batch ended in

        def close(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(keys):
                return
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[first, len(keys)])
            of = np.repeat(size, size)
            of = np.where(keys == hot, bucket + 1, of) if hot is not None else of
            small = (of > 1) & (of <= bucket)
            a, b = [], []
            for step in range(1, int(of[small].max()) if small.any() else 0):
                near = small[step:] & (keys[step:] == keys[:-step])
                x, y = fps[:-step][near], fps[step:][near]
                close_by = np.bitwise_count((x ^ y).view(np.uint64)) <= max_bits
                a.append(np.minimum(x, y)[close_by])
                b.append(np.maximum(x, y)[close_by])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)
            large = fps[of > bucket]
            if len(large):
                yield pa.RecordBatch.from_arrays([pa.array(large), pa.nulls(len(large), pa.int64())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy()])
            last = int(np.searchsorted(keys, keys[-1]))
            yield from close(keys[:last], fps[:last])
            if last:
                hot = None
            keys, fps = keys[last:], fps[last:]
            if len(keys) > bucket:  # already a large bucket: its members go on, none is held
                hot = int(keys[0])
                yield from close(keys, fps)
                keys, fps = keys[:0], fps[:0]
        yield from close(keys, fps)

    return run


def links(nodes: DataFrame, bucket: int = BUCKET, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: links whose connected components are those of all pairs within ``max_bits`` bits.

    ``nodes``: distinct fingerprints, column fp.
    """
    if max_bits > 2:
        raise ValueError("two segments with one wildcard reach two differing bits")
    found = write_shared(
        variants(nodes).repartition("key").sortWithinPartitions("key")
        .mapInArrow(_buckets(bucket, max_bits), "a bigint, b bigint"), "simhash-buckets")
    pairs = found.where("b is not null")
    members = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)])
    points = members.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    if max_bits < 2:
        return pairs.distinct()
    centre = points.groupBy("z").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))  # 65 at most
    stars = centre.where("size(all) > 1").select("a", F.explode("all").alias("b")).where("a < b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b), by alternating star steps.

    Large star: each node links its larger neighbours to the smallest node around it. Small star: each node links its
    smaller neighbours to the smallest of them. Both work on minima and one join, so no neighbourhood is gathered.
    """
    edges = write_shared(edges.select("a", "b").where("a <> b"), "links")
    before = None
    while True:
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(
            edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
        large = both.where("m > n").join(least, "n").select(F.col("least").alias("a"), F.col("m").alias("b"))
        large = large.where("a < b").distinct()
        large = write_shared(large, "links")
        down = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("least"))
        joined = large.select(F.col("b").alias("n"), F.col("a").alias("m")).join(down, "n")
        small = joined.select(F.col("least").alias("a"), F.col("m").alias("b")).where("a < b").unionByName(
            down.select(F.col("least").alias("a"), F.col("n").alias("b")))
        edges = write_shared(small.distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")),
                              F.sum(F.hash("a", "b").cast("bigint"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def grouped(fingerprints: DataFrame, bucket: int = BUCKET, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of ``fingerprints`` (doc_id, fp)."""
    nodes = write_shared(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), bucket, max_bits))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = write_shared(named, "simhash-roots")
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return named.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    own = write_shared(docs.select("doc_id", fingerprint(F.col(text), shingle).alias("fp")), "simhash-fingerprints")
    return own.join(grouped(own, bucket, max_bits), "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"),
                                                                 "component_id")


def keep_one(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET,
             max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: of the rows of its smallest doc_id (none before null) the one of the least
    fingerprint and, among rows that share it, of the least hash of the whole row, so every run keeps the same.

    The rows are written once with their fingerprint and a row number, so each text is hashed once."""
    mine = docs.withColumn("__own", fingerprint(F.col(text), shingle)).withColumn("__row", F.monotonically_increasing_id())
    mine = write_shared(mine, "simhash-documents")
    own = mine.select("doc_id", F.col("__own").alias("fp"), F.xxhash64(*docs.columns).alias("content"), F.col("__row").alias("row"))
    members = own.join(grouped(own.select("doc_id", "fp"), bucket, max_bits).select("fp", "root"), "fp")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "content", "row")
    kept = members.groupBy("root").agg(F.min(best).alias("k")).select(F.col("k.row").alias("__row"))
    return mine.join(kept, "__row", "left_semi").select(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
