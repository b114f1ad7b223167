"""Operator 12: the prefix trie of conversations, by one ROLLUP over positional turn columns.

1. *Numbering.* Turns are dealt out by ranges of (conversation, turn), so a conversation of any length is spread over
   tasks, and numbered where they lie; what the earlier tasks hold of a task's first conversation is one small row a task.
2. *Blocks.* A sequence of turn ids, closed by an end mark, is cut into blocks of WIDTH positional columns. A block carries
   the node that its predecessor ended in: the exclusive-or of a 128-bit hash of (position, turn id) over all earlier
   positions. Exclusive-or needs no order, so all blocks of a conversation are keyed at once, however many they are, with
   the same small row a task.
3. *Rollup.* One ``GROUP BY block, prior node, ROLLUP (t1, ..., tn)`` makes all prefixes of all blocks together;
   ``grouping_id`` tells the depth. Its groups are added up where they lie first, so a first turn that a third of all
   conversations share is a few rows a task.
4. *Measures.* A conversation is the smallest member of its nodes from some depth on, down to its end. Let X be the bytes of
   its turns before that depth (all its bytes, if it is never the smallest). The bytes that members share below a node
   of text start B are the sum of X - B over all its members but the smallest, so a second rollup that sums X and the
   conversations that end in a leaf gives the subtree sums without walking the tree.
5. Children are counted by the parent's key; the parent's smallest member comes by a join on (parent key, salt), where each
   parent has one line for each salt among its children. Ids of the conversations that end in a node are joined in chunks
   of bounded ranges of ids, and the chunks are hashed in order, one at a time.

Defined results: null role and text are empty. Turns order by turn, nulls first, then by the id of (role, text); equal rows
each count as a turn. Rows without conv_id belong to no conversation and make none. An empty table has no nodes, not even a root.
Other columns are not read. Turn ids are 128-bit digests of role and text; equal digests count as equal turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm.common import write_shared
from envspark.session import read_table

#: Turns in a block.
WIDTH = 8
#: The rebuilt form of the query: conversations in groups of SHARED take up to MODULUS - 1 first turns from the group's first.
SHARED, MODULUS = 5, 9
#: Lines of one conversation that meet one line of it in a join; salts of a node's children; ids in a chunk as a power of two.
CHUNK, SALTS, ID_BITS = 4096, 64, 12
END = b"end"
ID = "struct<id: binary, size: bigint>"


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _before(summary: DataFrame, plus: Callable, values: str) -> DataFrame:
    """(task, conv_id, what earlier tasks hold of it) where a task's first conversation began in an earlier one.

    ``summary``: one row a task, with ``first`` (its smallest conv_id) and ``last`` (conv_id and totals of its last one)."""
    rows, held, found = sorted(summary.collect(), key=lambda r: r.task), None, []
    for r in rows:
        conv_id, totals = r.last[0], tuple(r.last)[-(values.count(",") + 1):]
        if held and held[0] == r.first:
            found.append((r.task, *held))
            if conv_id == r.first:
                totals = tuple(plus(held[1:], totals))
        held = (conv_id, *totals)
    return summary.sparkSession.createDataFrame(found, f"task int, conv_id bigint, {values}")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, t): the turns of each conversation in order, t the id and UTF-8 length of a turn."""
    spark = turns.sparkSession
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    size = F.octet_length(text).cast("bigint")
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("id"), size.alias("size"))
    rows = write_shared(rows, "trie-turns").withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("id"), F.col("row")]  # row: equal turns may part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy()
            if not len(conv):
                continue
            at = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            nth = np.arange(1, len(conv) + 1) - np.repeat(at, np.diff(np.append(at, len(conv))))
            if conv[0] == last:
                nth[:at[1] if len(at) > 1 else None] += n
            last, n = conv[-1], int(nth[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), task, np.int32)), batch.column("conv_id"), pa.array(nth),
                                              batch.column("id"), batch.column("size")], names=["task", "conv_id", "nth", "id", "size"])

    dealt = rows.repartitionByRange(_tasks(spark), *order).sortWithinPartitions(*order)
    dealt = write_shared(dealt.mapInArrow(run, "task int, conv_id bigint, nth bigint, id binary, size bigint"), "trie-numbered")
    summary = dealt.groupBy("task").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "nth")).alias("last"))
    before = _before(summary, lambda a, b: [a[0] + b[0]], "earlier bigint")
    pos = F.col("nth") + F.coalesce("earlier", F.lit(0))
    return dealt.join(F.broadcast(before), ["task", "conv_id"], "left").select(  # one row a task at most
        "conv_id", pos.alias("pos"), F.struct("id", "size").alias("t"))


def _closed(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    end = F.struct(F.lit(END).alias("id"), F.lit(0).cast("bigint").alias("size"))
    return sequences.unionByName(lengths.select("conv_id", (F.col("length") + 1).alias("pos"), end.alias("t")))


def as_they_are(rows: DataFrame) -> DataFrame:
    """The numbered turns of each conversation, closed by an end mark."""
    return _closed(rows, rows.groupBy("conv_id").agg(F.max("pos").alias("length")))


def rebuilt(rows: DataFrame) -> DataFrame:
    """Every conversation c as the first h turns of c - c % SHARED, then its own turns after its first h; closed by an end mark."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MODULUS
    base = F.col("conv_id") - F.col("conv_id") % SHARED
    heads = rows.filter((F.col("conv_id") % SHARED == 0) & (F.col("pos") < MODULUS)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("head"))
    plan = rows.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumns({"h": h, "base": base}).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<pos: bigint, t: struct<id: binary, size: bigint>>>")), 1, F.col("h").cast("int"))
    plan = write_shared(plan.select("conv_id", "own", "h", head.alias("head")).withColumn("k", F.size("head").cast("bigint")), "trie-plan")
    first = plan.select("conv_id", F.explode("head").alias("e")).select("conv_id", "e.pos", "e.t")
    lines = plan.select("conv_id", "k", F.explode(F.sequence(F.lit(0), (F.col("own") / CHUNK).cast("bigint"))).alias("chunk"))
    rest = rows.filter(F.col("pos") > h).withColumn("chunk", (F.col("pos") / CHUNK).cast("bigint")).join(lines, ["conv_id", "chunk"])
    rest = rest.select("conv_id", (F.col("pos") - h + F.col("k")).alias("pos"), "t")
    length = F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return _closed(first.unionByName(rest), plan.select("conv_id", length.alias("length")))


def _marks(pos: Column, turn_id: Column) -> tuple[Column, Column]:
    """The hash of a turn id at a position, 2 x 64 bits."""
    return F.xxhash64(pos, turn_id, F.lit(1)), F.xxhash64(F.lit(2), turn_id, pos)


def blocks(sequences: DataFrame) -> DataFrame:
    """(conv_id, block, a, b, start, t1, ...): the positional columns, the prior node's key and the bytes up to it."""
    spark = sequences.sparkSession
    block = ((F.col("pos") - 1) / WIDTH).cast("bigint")
    a, b = _marks(F.col("pos"), F.col("t.id"))
    rows = sequences.select("conv_id", block.alias("block"), "pos", "t", a.alias("a"), b.alias("b"))
    kind = pa.struct([("id", pa.binary()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, state = TaskContext.get().partitionId(), (None, 0, 0, 0)

        def made(rows: pa.Table) -> pa.RecordBatch:
            """Whole blocks, one row each; ``state``: what stands before them in the first row's conversation."""
            nonlocal state
            conv, of = rows["conv_id"].to_numpy(), rows["block"].to_numpy()
            t = rows["t"].combine_chunks()
            size = t.field("size").to_numpy(zero_copy_only=False)
            n = len(conv)
            new = np.append(True, conv[1:] != conv[:-1])
            origin = np.flatnonzero(new)[np.cumsum(new) - 1]
            same = conv == state[0] if state[0] is not None else np.zeros(n, bool)
            sums = []
            for values, run_of, back, kept in ((rows["a"].to_numpy(), np.bitwise_xor, np.bitwise_xor, state[1]),
                                               (rows["b"].to_numpy(), np.bitwise_xor, np.bitwise_xor, state[2]),
                                               (size, np.add, np.subtract, state[3])):
                total = np.append(np.int64(0), run_of.accumulate(values))
                before = back(total[:-1], total[origin])
                after = back(total[1:], total[origin])
                sums.append([run_of(x, np.where(same, np.int64(kept), np.int64(0))) for x in (before, after)])
            at = np.flatnonzero(new | np.append(True, of[1:] != of[:-1]))
            ends = np.append(at[1:], n)
            state = (conv[-1], *(int(s[1][-1]) for s in sums))
            place = [np.where(at + j < ends, at + j, 0) for j in range(WIDTH)]
            turns = [t.take(pa.array(p, mask=at + j >= ends)) for j, p in enumerate(place)]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), task, np.int32)), pa.array(conv[at]), pa.array(of[at]), *(pa.array(s[0][at]) for s in sums),
                 *(pa.array(s[1][ends - 1]) for s in sums), *turns], names=names)

        names = ["task", "conv_id", "block", "a", "b", "start", "a_after", "b_after", "bytes", *(f"t{j + 1}" for j in range(WIDTH))]
        open_rows = None  # the last block of what has come so far
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if open_rows is None else pa.concat_tables([open_rows, rows])
            conv, of = rows["conv_id"].to_numpy(), rows["block"].to_numpy()
            change = np.flatnonzero((conv[1:] != conv[:-1]) | (of[1:] != of[:-1]))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield made(rows.slice(0, cut))
            open_rows = rows.slice(cut).combine_chunks()
        if open_rows is not None:
            yield made(open_rows)

    order = ["conv_id", "block"]  # a block stays whole
    dealt = rows.repartitionByRange(_tasks(spark), *order).sortWithinPartitions(*order, "pos")
    columns = ", ".join(f"t{j + 1} {ID}" for j in range(WIDTH))
    dealt = write_shared(dealt.mapInArrow(run, "task int, conv_id bigint, block bigint, a bigint, b bigint, start bigint, a_after bigint, "
                                               f"b_after bigint, bytes bigint, {columns}"), "trie-blocks")
    summary = dealt.groupBy("task").agg(F.min("conv_id").alias("first"),
                                        F.max(F.struct("conv_id", "block", "a_after", "b_after", "bytes")).alias("last"))
    before = _before(summary, lambda x, y: [x[0] ^ y[0], x[1] ^ y[1], x[2] + y[2]], "oa bigint, ob bigint, earlier bigint")
    joined = dealt.join(F.broadcast(before), ["task", "conv_id"], "left").fillna(0, ["oa", "ob", "earlier"])  # one row a task at most
    return joined.select("conv_id", "block", F.col("a").bitwiseXOR(F.col("oa")).alias("a"), F.col("b").bitwiseXOR(F.col("ob")).alias("b"),
                         (F.col("start") + F.col("earlier")).alias("start"), (F.col("bytes") + F.col("earlier")).alias("bytes"),
                         *(f"t{j + 1}" for j in range(WIDTH)))


def _keys(which: int) -> Column:
    """The keys of the nodes at positions 0 to WIDTH of a block, 0 the prior node."""
    out, pos = [F.col("ab"[which])], F.col("block") * WIDTH
    for j in range(1, WIDTH + 1):
        out.append(out[-1].bitwiseXOR(_marks(pos + j, F.col(f"t{j}.id"))[which]))
    return F.array(*out)


def rolled_up(parts: DataFrame, **measures: str) -> DataFrame:
    """The nodes: depth, keys (a, b) and the parent's (pa, pb), size of the last text, start (bytes before it), measures."""
    turns = ", ".join(f"t{j + 1}" for j in range(WIDTH))
    aggregates = ", ".join(f"{how} AS {name}" for name, how in measures.items())
    groups = parts.sparkSession.sql(
        f"SELECT block, a, b, start, {turns}, {WIDTH} - bit_count(grouping_id()) AS level, {aggregates} "
        f"FROM {{parts}} GROUP BY block, a, b, start, ROLLUP ({turns})", parts=parts)
    level = F.col("level").cast("int")
    last = F.element_at(F.array(*(f"t{j + 1}" for j in range(WIDTH))), F.greatest(level, F.lit(1)))
    bytes_before = F.aggregate(F.slice(F.array(*(F.coalesce(f"t{j + 1}.size", F.lit(0)) for j in range(WIDTH))), F.lit(1),
                                       F.greatest(level - 1, F.lit(0))), F.lit(0).cast("bigint"), lambda x, y: x + y)
    root = (level == 0) & (F.col("block") == 0)
    nodes = groups.withColumns({"last": last, "ka": _keys(0), "kb": _keys(1)}).filter(
        root | ((level > 0) & F.col("last").isNotNull() & (F.col("last.id") != F.lit(END))))
    parent = F.greatest(level, F.lit(1))
    return nodes.select(
        (F.col("block") * WIDTH + level).alias("depth"), F.element_at("ka", level + 1).alias("a"), F.element_at("kb", level + 1).alias("b"),
        F.when(~root, F.element_at("ka", parent)).alias("pa"), F.when(~root, F.element_at("kb", parent)).alias("pb"),
        F.when(root, 0).otherwise(F.col("last.size")).cast("bigint").alias("size"), (F.col("start") + bytes_before).alias("start"), *measures)


def ends(parts: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): the digest of the ids of the conversations that end in a node, ascending."""
    at = F.array_position(F.array(*(F.coalesce(f"t{j + 1}.id", F.lit(b"")) for j in range(WIDTH))), F.lit(END)).cast("int")
    rows = parts.withColumn("at", at).filter("at > 0").select(
        F.element_at(_keys(0), F.col("at")).alias("a"), F.element_at(_keys(1), F.col("at")).alias("b"), "conv_id")
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    chunks = rows.groupBy("a", "b", F.shiftright("conv_id", ID_BITS).alias("range")).agg(F.array_join(ids, ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
                if key == (a, b):
                    digest.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = (a, b), hashlib.sha256(ids.encode())
            yield _rows(out)
        yield _rows([(*key, digest.hexdigest())] if key else [])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        a, b, digests = zip(*out) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digests, pa.string())],
                                          names=["a", "b", "ends_sha256"])

    # a line of this shuffle holds all ids of a range, so even a node in which a third of all conversations end is few lines
    return chunks.repartition("a", "b").sortWithinPartitions("a", "b", "range").mapInArrow(run, "a bigint, b bigint, ends_sha256 string")


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of closed sequences."""
    parts = blocks(sequences)
    nodes = write_shared(rolled_up(parts, conv_id="min(conv_id)"), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    owners = nodes.join(children, ["a", "b"], "left").groupBy("conv_id").agg(
        F.min_by("start", "depth").alias("x"), F.max(F.col("n_children").isNull().cast("bigint")).alias("leaf"))
    whole = parts.groupBy("conv_id").agg(F.max("bytes").alias("whole"), F.max("block").alias("blocks"))
    values = whole.join(owners, "conv_id", "left").select(
        "conv_id", F.coalesce("x", "whole").alias("x"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
        F.explode(F.sequence(F.lit(0), (F.col("blocks") / CHUNK).cast("bigint"))).alias("chunk"))
    measured = parts.withColumn("chunk", (F.col("block") / CHUNK).cast("bigint")).join(values, ["conv_id", "chunk"]).drop("chunk")
    nodes = rolled_up(measured, conv_id="min(conv_id)", n_convs="count(*)", total="sum(x)", own="min_by(x, conv_id)", n_leaves="sum(leaf)")
    nodes = write_shared(nodes, "trie-measured").withColumn("salt", F.col("conv_id") % SALTS)
    lines = nodes.filter("depth > 0").select("pa", "pb", "salt").distinct()
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(lines.join(parents, ["pa", "pb"]), ["pa", "pb", "salt"], "left").join(children, ["a", "b"], "left").join(
        ends(parts), ["a", "b"], "left")
    saved = F.col("total") - F.col("own") - (F.col("n_convs") - 1) * F.col("start")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                        "n_leaves", saved.alias("saved_tokens"),
                        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(numbered(read_table(spark, sf_dir, "conversations"))))


#: crc32 by its bit rule: each byte is folded in and eight times halved, with the reversed polynomial 0xEDB88320 where the low bit was set.
ORACLE_SQL = r"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
plan AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
      lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
mixed AS (SELECT p.conv_id, 0 AS part, t.pos, t.role, t.text FROM plan p JOIN turns t ON t.conv_id = p.base AND t.pos <= p.h
  UNION ALL SELECT p.conv_id, 1, t.pos, t.role, t.text FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND t.pos > p.h),
seq AS (SELECT p.conv_id, list({'r': role, 't': text} ORDER BY part, pos) FILTER (pos IS NOT NULL) AS s FROM plan p LEFT JOIN mixed USING (conv_id) GROUP BY p.conv_id),
member AS (SELECT conv_id, d, coalesce(len(s), 0) AS n, CASE WHEN d = 0 THEN [] ELSE s[1:d] END AS prefix FROM seq, unnest(range(coalesce(len(s), 0) + 1)) AS u(d)),
node AS (SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ended FROM member GROUP BY prefix, d),
kids AS (SELECT p.prefix, count(c.prefix) AS n_children FROM node p LEFT JOIN node c ON c.depth = p.depth + 1 AND c.prefix[1:p.depth] = p.prefix GROUP BY p.prefix),
full_node AS (SELECT node.*, n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(prefix[depth].t) END AS saved FROM node JOIN kids USING (prefix)),
below AS (SELECT u.prefix, sum((v.n_children = 0)::INT)::BIGINT AS n_leaves, sum(v.saved)::BIGINT AS saved_tokens
  FROM full_node u JOIN full_node v ON v.depth >= u.depth AND v.prefix[1:u.depth] = u.prefix GROUP BY u.prefix)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, sha256(n.ended) AS ends_sha256
FROM full_node n JOIN below USING (prefix) LEFT JOIN node p ON p.depth = n.depth - 1 AND n.prefix[1:p.depth] = p.prefix
"""
