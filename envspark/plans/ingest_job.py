"""S2-S8, S1, N*, L1-L9 as one job: a folder of delimited files and zip archives -> measurement table, dimensions, ledgers.

A store is a folder with ``measurements`` (see ``load_job``), its ``hourly`` partials, ``stations``, ``variables``, and three append-only ledgers:
``source_files`` (one row per file and run, with the rows staged from it and its rejects by reason), ``file_events`` (what
each loaded file passed: downloaded, processing, completed or failed) and ``etl_runs`` (one row when a run starts, one when
it ends; the state of a run is its latest row). Files whose checksum the ledger holds as completed with rows are skipped
unless forced; copies of a file within a run are loaded once. Files of other formats, broken archives and archives with
members that cannot be read are recorded as failed and stop nothing; files without a byte are not listed. Of an archive the
delimited members are read. The load order is (file, member, row), so the last row of the last file wins a key.

File, member and layout names reach the driver (one row each, as they make the tasks); rows do not. Checksums and members are
read in blocks, so files, archives and members may have any size where the executors can open them (``sources.blocks``); in
stores that only Spark reads a file stands in one row and may have 2 GB.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.operators import load as L
from envspark.operators import partials as P
from envspark.plans.load_job import load_measurements, read_measurements
from envspark.schema import VARIABLES
from envspark.session import checkpoint_dir, path_exists, remove_path
from envspark.sources import blocks as B
from envspark.sources import files as S
from envspark.sources import ledger as G
from envspark.sources import versions as V

FILE_LEDGER = ("source_file_id int, etl_run_id string, original_name string, landing_name string, checksum_sha256 string, "
               "status string, row_count bigint, skipped_rows bigint, error_message string, processed_at timestamp_ntz, "
               "rejected_timestamp bigint, rejected_value bigint, rejected_variable bigint")
FILE_EVENTS = "source_file_id int, status string, ts timestamp_ntz"
DIMENSIONS = ("stations", "variables")
REJECTS = ("timestamp", "value", "variable")
RUN_LEDGER = ("id string, trigger_type string, status string, at timestamp_ntz, files_found bigint, files_loaded bigint, "
              "records_inserted bigint, records_updated bigint, records_skipped bigint, error_message string")
STATIONS = "station_id int, code string, name string, latitude double, longitude double, region string"
READABLE = (".csv", ".txt")
ARCHIVES = (".zip",)


def store_table(spark: SparkSession, store: str, name: str, schema) -> DataFrame:
    """A table of the store (a versioned dimension or an append-only ledger); empty where it was never written."""
    path = os.path.join(store, name)
    if name in DIMENSIONS:
        return V.read(spark, path, schema)
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _log_run(spark, store, run_id, trigger, status, found=0, loaded=0, counters=None, error=None) -> None:
    c = counters or {}
    row = (run_id, trigger, status, _now(), found, loaded, c.get("inserted", 0), c.get("updated", 0), c.get("skipped", 0), error)
    spark.createDataFrame([row], RUN_LEDGER).coalesce(1).write.mode("append").parquet(os.path.join(store, "etl_runs"))


def _planned(spark: SparkSession, root: str, ledger: DataFrame, force: bool) -> list:
    """One row per file of the folder: URI, checksum and what to do with it, in load order."""
    found = S.located(spark, root)
    files = [(r["file"], r["length"]) for r in found.select("file", "length").collect()]
    if not files:
        return []
    if B.opens(files[0][0]):
        sums = B.file_digests(spark, sorted(files)).select("file", "checksum_sha256")
    else:
        whole = spark.read.format("binaryFile").load([S.readable_path(uri) for uri, _ in files])
        sums = whole.select(F.col("_metadata.file_path").alias("file"), G.fingerprint(F.col("content")).alias("checksum_sha256"))
    found = G.skip_loaded(found.join(sums, "file"), ledger, force)
    found = found.withColumn("landing_name", G.landing_name(F.col("checksum_sha256"), F.col("name")))
    return sorted(found.collect(), key=lambda r: r["file"])


def _staged(spark: SparkSession, plan: list, ids: dict[str, int], stage: str, dayfirst: bool, wide_axis: str):
    """(staging rows and rejects of the files in ``ids``, error of each archive that cannot be read)."""
    chosen = [f for f in plan if f["file"] in ids]
    texts = [f["path"] for f in chosen if f["suffix"] in READABLE]
    archives = [(f["file"], f["length"]) for f in chosen if f["suffix"] in ARCHIVES]
    parts, errors = [], {}
    if texts:
        parts.append(S.read_delimited(spark, texts, dayfirst, wide_axis, keep_file=True, rejects=True))
    if archives:
        readable = F.lower(F.regexp_extract("member", r"(\.[^./]+)$", 1)).isin(*READABLE)
        chunks = S.expand_located(spark, archives).where(readable | F.col("error").isNotNull())
        # archives are expanded once; their chunks are dealt out anew, as the parsing takes longer and a member may be most of them
        chunks.repartition("archive", "number", "first_line").write.parquet(f"{stage}-members")
        chunks = spark.read.schema(chunks.schema).parquet(f"{stage}-members")
        for r in chunks.where(F.col("error").isNotNull()).select("archive", "member", "error").collect():
            errors.setdefault(r["archive"], f"{r['member'] or 'archive'}: {r['error']}")
        good = chunks.where(~F.col("archive").isin(*errors)) if errors else chunks
        parts.append(S.parse_members(spark, good, dayfirst, wide_axis, keep_file=True, rejects=True))
    known = spark.createDataFrame(list(ids.items()), "file string, source_file_id int")  # one row a file
    order = F.struct("source_path", "source_row_number", "value", "unit").alias("load_order")
    rows = reduce(DataFrame.unionByName, parts).withColumn("file", F.substring_index("source_path", "\n", 1)).join(F.broadcast(known), "file")
    rows = rows.select("file", "source_file_id", "station_code", "variable_code", "observed_at", "value", "unit", order, "reject")
    rows.write.parquet(f"{stage}-rows")
    return spark.read.schema(rows.schema).parquet(f"{stage}-rows"), errors


def _dimensions(spark: SparkSession, rows: DataFrame, store: str) -> None:
    """New stations and variables, missing default units, reference coordinates; each a new version."""
    columns = [c.split()[0] for c in STATIONS.split(", ")]
    stations = store_table(spark, store, "stations", STATIONS)
    new = L.new_dimension_members(rows.select(F.col("station_code").alias("code")), stations)
    every = stations.unionByName(new, allowMissingColumns=True)
    enriched = L.enrich_stations(every).withColumnRenamed("region", "found_region").join(
        every.select("station_id", "region"), "station_id")
    enriched = enriched.withColumn("region", F.coalesce("found_region", "region")).select(*columns)
    V.commit(enriched.coalesce(1), os.path.join(store, "stations"), [], replace_all=True)
    variables = store_table(spark, store, "variables", VARIABLES)
    units = rows.select("variable_code", "unit", "load_order")
    named = L.backfill_default_unit(variables, units).unionByName(L.new_variables(units, variables))
    V.commit(named.select(*VARIABLES.names).coalesce(1), os.path.join(store, "variables"), [], replace_all=True)


def ingest(spark: SparkSession, root: str, store: str, force: bool = False, trigger: str = "manual",
           dayfirst: bool = False, wide_axis: str = "station") -> dict:
    """Loads the files under ``root`` into ``store``; returns the run's id, status, file counts and L7 counters.

    A failure is recorded in the run ledger with its text and raised; the file ledger gets no row then, so the next run
    loads the same files again, which the keyed load makes harmless.
    """
    run_id = uuid.uuid4().hex
    stage = os.path.join(checkpoint_dir(spark), f"ingest-{run_id}")
    _log_run(spark, store, run_id, trigger, "running")
    try:
        ledger = store_table(spark, store, "source_files", FILE_LEDGER)
        plan = _planned(spark, root, ledger, force)
        next_id = (ledger.agg(F.max("source_file_id")).first()[0] or 0) + 1
        ids, first_of = {}, {}
        for f in plan:  # one row per file
            readable = f["suffix"] in READABLE + ARCHIVES
            if readable and f["action"] == "process" and f["length"] and (force or f["checksum_sha256"] not in first_of):
                ids[f["file"]] = next_id + len(ids)
                first_of.setdefault(f["checksum_sha256"], f["file"])
        counters, counts, errors, events = {"inserted": 0, "updated": 0, "skipped": 0, "row_count": 0}, {}, {}, []
        if ids:
            events += [(i, status, _now()) for status in ("downloaded", "processing") for i in ids.values()]
            rows, errors = _staged(spark, plan, ids, stage, dayfirst, wide_axis)
            counts = {(r["file"], r["reject"]): r["n"] for r in rows.groupBy("file", "reject").agg(F.count("*").alias("n")).collect()}
            rows = rows.where(F.col("reject").isNull()).drop("reject")
        if any(reject is None for _, reject in counts):
            counters = load_measurements(spark, rows, os.path.join(store, "measurements"))
            P.refresh(spark, os.path.join(store, "measurements"), os.path.join(store, "hourly"))
            _dimensions(spark, rows, store)
        records = []
        for f in plan:
            n = counts.get((f["file"], None), 0)
            if f["file"] in errors:
                skipped, status, error = 0, "failed", errors[f["file"]]
            elif f["file"] in ids or f["action"] == "skip":
                skipped, status, error = f["skipped_rows"], "completed", None
            elif f["suffix"] not in READABLE + ARCHIVES:
                skipped, status, error = 0, "failed", f"no reader for files of type '{f['suffix']}'"
            else:  # an empty file, or a copy of one loaded in this run
                skipped, status, error = counts.get((first_of.get(f["checksum_sha256"]), None), 0), "completed", None
            counters["skipped"] += skipped
            if f["file"] in ids:
                events.append((ids[f["file"]], status, _now()))
            records.append((ids.get(f["file"]), run_id, f["name"], f["landing_name"], f["checksum_sha256"], status, n, skipped,
                            error, _now(), *(counts.get((f["file"], r), 0) for r in REJECTS)))
        for name, made, schema in (("source_files", records, FILE_LEDGER), ("file_events", events, FILE_EVENTS)):
            if made:
                spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(os.path.join(store, name))
        _log_run(spark, store, run_id, trigger, "completed", len(plan), len(ids), counters)
        return {"id": run_id, "status": "completed", "files_found": len(plan), "files_loaded": len(ids), **counters}
    except Exception as error:
        _log_run(spark, store, run_id, trigger, "failed", error=str(error)[:2000])
        raise
    finally:
        remove_path(spark, f"{stage}-rows")
        remove_path(spark, f"{stage}-members")


def measurements(spark: SparkSession, store: str) -> DataFrame:
    """The measurement table of a store."""
    return read_measurements(spark, os.path.join(store, "measurements"))


def run_states(spark: SparkSession, store: str) -> DataFrame:
    """The latest ledger row of every run."""
    runs = store_table(spark, store, "etl_runs", RUN_LEDGER)
    last = runs.groupBy("id").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "id"]),
                                           F.struct("at", F.col("status") != "running")).alias("r"))
    return last.select("id", "r.*")
