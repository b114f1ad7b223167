"""E2 as one job: staging batch -> last-wins dedup -> keyed upsert into a versioned table -> counters.

The target table (``sources.versions``) is partitioned by ``variable_code`` and ``observed_month`` (the first day of the month)
and stores ``observed_date``, a DATE that time filters can prune row groups by, and the record hash. A load reads only the
(variable, month) partitions that the batch touches and publishes only those in which a row is new or changed; the others
keep their folders. Partitions are written through a rebalance, so a large one is spread over several tasks and small ones
share one.

The deduplicated batch is written once to the shared checkpoint folder and removed at the end, the classified result once into
the table's folder, where nobody sees it before the last step: one manifest. A failure at any step leaves the table as it
was, and a repeated load classifies every key as 'skip'. Rows without a timestamp cannot be keyed; they are rejected and
counted in ``rejected``.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.functions.text import record_hash
from envspark.operators import load as L
from envspark.session import checkpoint_dir, remove_path
from envspark.sources import versions as V

TABLE_COLUMNS = ["station_code", "variable_code", "observed_at", "value", "unit", "source_file_id"]
PARTITIONS = ["variable_code", "observed_month"]


def _month(ts: str = "observed_at"):
    return F.trunc(F.to_date(ts), "month")


def _touched(rows: DataFrame) -> list[tuple]:
    """The (variable, month) partitions of ``rows``: as many as partition folders, not rows."""
    return [tuple(r) for r in rows.select(*PARTITIONS).distinct().collect()]


def _staged(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_measurements(spark: SparkSession, table_dir: str, start: dt.date | None = None, end: dt.date | None = None,
                      variables: list[str] | None = None) -> DataFrame:
    """The rows of the table from the day ``start`` to the day ``end`` (both included) of some variables: months and variables
    leave out whole folders, the DATE column row groups."""
    def keep(values: list) -> bool:
        variable, month = values
        return ((variables is None or variable in variables)
                and (start is None or month is not None and month >= start.replace(day=1).isoformat())
                and (end is None or month is not None and month <= end.isoformat()))

    out = V.read(spark, table_dir, keep=keep)
    if start is not None:
        out = out.where(F.col("observed_date") >= F.lit(start))
    return out if end is None else out.where(F.col("observed_date") <= F.lit(end))


def load_measurements(spark: SparkSession, batch: DataFrame, table_dir: str,
                      order: str = "load_order") -> dict[str, int]:
    """Upsert ``batch`` (staging rows with a load order) into ``table_dir``; returns the L7 counters."""
    run = os.path.join(checkpoint_dir(spark), f"load-{uuid.uuid4().hex}")
    written, wanted = [], set()
    try:
        rejected = batch.where(F.col("observed_at").isNull()).count()
        keyed = batch.where(F.col("observed_at").isNotNull())
        fresh = L.dedup_last_wins(keyed.select(*TABLE_COLUMNS, order), order, count="n_rows").drop(order)
        fresh = _staged(fresh.withColumn("observed_month", _month()), f"{run}-batch")
        skipped = fresh.agg(F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0))).first()[0]
        rows = fresh.select(*TABLE_COLUMNS)
        found = V.manifest(spark, table_dir) or {"version": 0, "partitions": []}
        touched = {_as_text(t) for t in _touched(fresh)}
        target = V.read(spark, table_dir, rows.schema, keep=lambda values: tuple(values) in touched)
        merged = L.upsert_result(L.upsert_actions(target, rows).withColumn("observed_month", _month()),
                                 [*L.KEY, "observed_month", "action"])
        merged = (merged.withColumns({"record_hash": record_hash("station_code", "variable_code", "observed_at"),
                                      "observed_date": F.to_date("observed_at")})
                  .hint("rebalance", *[F.col(c) for c in PARTITIONS]).sortWithinPartitions("station_code", "observed_at"))
        schema, written = V.write_data(merged, table_dir, PARTITIONS)
        merged = V.read_parts(spark, table_dir, schema, written)
        changed = {_as_text(t) for t in _touched(merged.where(F.col("action").isin("insert", "update")))}
        new = [p for p in written if tuple(p["values"]) in changed]
        if new or not found["version"]:
            kept = [p for p in found["partitions"] if tuple(p["values"]) not in changed]
            columns = merged.drop("action").schema
            V.publish(spark, table_dir, PARTITIONS, columns, kept + new, found["version"])
            wanted = {p["folder"] for p in new}
        counters = L.load_counters(merged, skipped)
        return counters | ({"rejected": rejected} if rejected else {})
    finally:
        remove_path(spark, f"{run}-batch")
        for p in written:
            if p["folder"] not in wanted:
                remove_path(spark, f"{table_dir}/{p['folder']}")


def _as_text(values: tuple) -> tuple:
    return tuple(None if v is None else str(v) for v in values)
