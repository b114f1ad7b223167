"""Content fingerprints, skip of already-loaded content, landing names and the file ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(content: Column) -> Column:
    """sha256 hex of the bytes (or text) of a file."""
    return F.sha2(content, 256)


def skip_loaded(files: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Files whose checksum matches a completed ledger entry with row_count > 0 are skipped (unless
    forced) and contribute that entry's row count to ``skipped``; everything else is processed.

    The ledger is reduced to one row per checksum before the join, so duplicates in it cannot multiply rows.
    """
    done = (ledger.where((F.col("status") == "completed") & (F.col("row_count") > 0))
            .groupBy("checksum_sha256").agg(F.max("row_count").alias("skipped_rows")))
    j = files.join(done, "checksum_sha256", "left")
    skip = F.col("skipped_rows").isNotNull() & F.lit(not force)
    return j.select(*files.columns, F.when(skip, F.lit("skip")).otherwise(F.lit("process")).alias("action"),
                    F.when(skip, F.col("skipped_rows")).otherwise(F.lit(0)).cast("long").alias("skipped_rows"))


def landing_name(checksum: Column, name: Column) -> Column:
    """S8: '{sha[:12]}-{safe name}' with path separators replaced by '_'."""
    return F.concat(F.substring(checksum, 1, 12), F.lit("-"), F.regexp_replace(name, r"[/\\]", "_"))


# File ledger states in the order a file passes them.
FILE_STATES = ("downloaded", "processing", "completed")


def file_events(files: DataFrame, ts: str = "downloaded_at") -> DataFrame:
    """Append-only ledger events of each file: downloaded, processing, then its final status
    (completed or failed), one minute apart — the ledger is never updated in place."""
    steps = F.array(
        F.struct(F.lit(FILE_STATES[0]).alias("status"), F.col(ts).alias("ts")),
        F.struct(F.lit(FILE_STATES[1]).alias("status"), (F.col(ts) + F.expr("INTERVAL 1 MINUTE")).alias("ts")),
        F.struct(F.col("status").alias("status"), (F.col(ts) + F.expr("INTERVAL 2 MINUTES")).alias("ts")))
    return files.select("source_file_id", F.explode(steps).alias("e")).select(
        "source_file_id", F.col("e.status").alias("status"), F.col("e.ts").alias("ts"))


def file_state(events: DataFrame) -> DataFrame:
    """Current state per file = status of its latest event (grouped max_by, partial aggregation)."""
    return events.groupBy("source_file_id").agg(
        F.max_by("status", F.struct("ts", "status")).alias("status"), F.max("ts").alias("updated_at"),
        F.count("*").alias("n_events"))
