"""Structured Streaming forms of the repeated sync (T-S1..T-S4).

* ``stream_upsert``   T-S1: file stream -> per micro-batch last-wins dedup + keyed upsert into a Parquet table
                      (idempotent by key, so a replayed batch changes nothing).
* ``stream_window``   T-S2: tumbling / sliding means with a watermark; NTZ timestamps become instants read
                      as UTC on entry (a watermark needs them) and UTC wall-clock NTZ on exit, so windows
                      align to UTC hours whatever the session time zone.
* ``stream_window_append`` T-S2 with bounded state: windows are emitted once, when the watermark passes their end, and rows
                      that come too late for their window go to a table of their own.
* ``stream_dedup``    T-S3: ``dropDuplicatesWithinWatermark`` (first row wins, unlike L1's last wins).
* ``stream_latest``   T-S4: latest value per (station, variable) kept by merging each batch into a table.

State and outputs live under the shared checkpoint folder (``spark.checkpoint.dir``); streaming checkpoints
make every query restartable after executor or driver loss.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.functions.timefmt import instant_as_utc_ntz, ntz_as_utc_instant
from envspark.session import checkpoint_dir
from envspark.sources import versions as V


def _work_dir(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:8]}")


def file_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int = 1) -> DataFrame:
    """A parquet file stream over one table of a folder (other tables are filtered out by name)."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir))


def stream_upsert(batches: DataFrame, target_dir: str, work: str) -> str:
    """T-S1: every micro-batch is deduplicated (last load order wins) and upserted into the target table.

    Each batch is one ``load_measurements`` job: only the (variable, month) partitions the batch touches are read,
    and only those it changes are rewritten, from a staged copy. Replaying a batch after
    a failure is a no-op: every key classifies as 'skip'.
    """
    from envspark.plans.load_job import load_measurements

    def merge(batch: DataFrame, epoch: int) -> None:
        load_measurements(batch.sparkSession, batch, target_dir)

    q = (batches.writeStream.foreachBatch(merge).option("checkpointLocation", os.path.join(work, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return target_dir


def read_table_dir(spark: SparkSession, target_dir: str) -> DataFrame:
    from envspark.plans.load_job import TABLE_COLUMNS

    return V.read(spark, target_dir).select(*TABLE_COLUMNS)


def stream_window(stream: DataFrame, window: str, slide: str | None, group: list[str], watermark: str,
                  work: str, ts: str = "observed_at", value: str = "value") -> str:
    """T-S2: windowed mean / count per group with a watermark for late data.

    Output mode ``complete`` through ``foreachBatch`` (the result table is rewritten per batch), so the final
    table equals the batch aggregate; in ``append`` mode the last open windows would wait for the watermark.
    """
    ev = stream.withColumn("_ts", ntz_as_utc_instant(ts)).withWatermark("_ts", watermark)
    win = F.window("_ts", window, slide) if slide else F.window("_ts", window)
    agg = ev.groupBy(win.alias("w"), *group).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    out_dir = os.path.join(work, "out")

    def write(batch: DataFrame, epoch: int) -> None:
        (batch.select(instant_as_utc_ntz(F.col("w.start")).alias("window_start"),
                      instant_as_utc_ntz(F.col("w.end")).alias("window_end"), *group, "n",
                      (F.col("s") / F.col("n")).alias("mean_value"))
         .write.mode("overwrite").parquet(out_dir))

    q = (agg.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", os.path.join(work, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return out_dir


def stream_window_append(stream: DataFrame, window: str, slide: str | None, group: list[str], delay: str, work: str,
                         ts: str = "observed_at", value: str = "value") -> str:
    """T-S2 in append form: (window, group) counts and sums over batches, each emitted once.

    As in Spark's own append mode, a batch is judged by the watermark of the batches before it (the newest event time less
    ``delay``): rows of windows that ended by then are too late. Those are kept, in ``work/late``; the others are added to
    the open windows, and windows that the new watermark has passed are closed. State and result are one versioned table,
    ``work/windows``: its partition ('open', batch) is replaced by every batch, a ('closed', batch) one is added, and
    one manifest publishes both with the new watermark, so a batch that is run again after a failure counts once. The
    state holds the open windows only, however long the stream runs.
    """
    spark = stream.sparkSession
    table, late_table = os.path.join(work, "windows"), os.path.join(work, "late")
    # windows and marks are made of the NTZ value itself: no zone enters, and nothing is converted a row
    event_time = F.col(ts).cast("timestamp_ntz")
    win = F.window("_ts", window, slide) if slide else F.window("_ts", window)

    def merge(batch: DataFrame, epoch: int) -> None:
        found = V.manifest(spark, table) or {"version": 0, "partitions": []}
        if any(int(p["values"][1]) >= epoch for p in found["partitions"]):
            return  # this batch is in the table
        held = [p for p in found["partitions"] if p["values"][0] == "open"]
        before = V.read(spark, table, keep=lambda values: values[0] == "open") if held else None
        mark = before.agg(F.max("watermark")).first()[0] if held else None
        batch = batch.persist()
        try:
            rows = batch.withColumn("_ts", event_time)
            newest = rows.agg((F.max("_ts") - F.expr(f"INTERVAL {delay}")).alias("m")).first()[0]
            rows = rows.withColumn("w", win).withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")})
            too_late = F.lit(False) if mark is None else F.col("window_end") <= F.lit(str(mark)).cast("timestamp_ntz")
            late = rows.where(too_late).drop("w", "_ts").withColumn("epoch", F.lit(epoch).cast("bigint"))
            V.commit(late, late_table, ["epoch"])
            keys = ["window_start", "window_end", *group]
            sums = rows.where(~too_late).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
            if held:
                sums = sums.unionByName(before.where("window_start IS NOT NULL").select(*keys, "n", "s")).groupBy(*keys).agg(
                    F.sum("n").alias("n"), F.sum("s").alias("s"))
            marks = [m for m in (mark, newest) if m is not None]
            new = F.lit(str(max(marks)) if marks else None).cast("timestamp_ntz")
            closed = F.coalesce(F.col("window_end") <= new, F.lit(False))
            out = sums.select(F.when(closed, F.lit("closed")).otherwise(F.lit("open")).alias("kind"), F.lit(epoch).cast("bigint").alias("epoch"),
                              new.alias("watermark"), *keys, "n", "s")
            only_mark = spark.range(1).select(*[{"kind": F.lit("open"), "epoch": F.lit(epoch).cast("bigint"), "watermark": new}
                                                .get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in out.schema])
            schema, fresh = V.write_data(out.unionByName(only_mark), table, ["kind", "epoch"])
            kept = [p for p in found["partitions"] if p["values"][0] == "closed"]
            V.publish(spark, table, ["kind", "epoch"], schema, kept + fresh, found["version"])
        finally:
            batch.unpersist()

    q = (stream.writeStream.foreachBatch(merge).option("checkpointLocation", os.path.join(work, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return work


def read_windows(spark: SparkSession, work: str, value: str = "mean_value") -> DataFrame:
    """The windows of ``stream_window_append``: closed ones are final, open ones hold what has come so far."""
    rows = V.read(spark, os.path.join(work, "windows")).where("window_start IS NOT NULL")
    keys = [c for c in rows.columns if c not in ("kind", "epoch", "watermark", "n", "s")]
    return rows.select(*keys, "n", (F.col("s") / F.col("n")).alias(value), (F.col("kind") == "closed").alias("closed"))


def read_late(spark: SparkSession, work: str) -> DataFrame:
    """The rows of ``stream_window_append`` that came too late, with their window and batch."""
    return V.read(spark, os.path.join(work, "late"))


def stream_dedup(stream: DataFrame, key: list[str], watermark: str, work: str, ts: str = "observed_at") -> str:
    """T-S3: drop repeated keys within the watermark delay (first arrival wins); appended to Parquet."""
    ev = stream.withColumn("_ts", ntz_as_utc_instant(ts)).withWatermark("_ts", watermark)
    out_dir = os.path.join(work, "out")
    q = (ev.dropDuplicatesWithinWatermark(key).drop("_ts").writeStream.format("parquet")
         .option("path", out_dir).option("checkpointLocation", os.path.join(work, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out_dir


def stream_latest(stream: DataFrame, target_dir: str, work: str) -> str:
    """T-S4: latest (value, unit, observed_at) per (station_id, variable_id) = Q8 over (state U batch).

    The state is a versioned table: each batch is merged with the last version and published as the next one, and all but
    the last two versions are removed, so the state's size is that of its keys however many batches there were. A replayed
    batch is merged again, which changes nothing.
    """
    cols = ["station_id", "variable_id", "observed_at", "measurement_id", "value", "unit"]

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*cols)
        if V.exists(spark, target_dir):
            rows = rows.unionByName(V.read(spark, target_dir).select(*cols))
        latest = rows.groupBy("station_id", "variable_id").agg(
            F.max_by(F.struct(*cols[2:]), F.struct("observed_at", "measurement_id")).alias("l")).select(
            "station_id", "variable_id", "l.*")
        V.commit(latest, target_dir, [], replace_all=True)
        V.vacuum(spark, target_dir)

    q = (stream.writeStream.foreachBatch(merge).option("checkpointLocation", os.path.join(work, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return target_dir


def read_latest_state(spark: SparkSession, target_dir: str) -> DataFrame:
    return V.read(spark, target_dir)
