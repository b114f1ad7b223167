"""Keyed load of measurements (L1-L9): last-wins dedup, upsert classification, dimensions, deletes, ledger.

Everything is a pure DataFrame transform; ``envspark.plans.load_job`` and ``envspark.sources.files.write_measurements`` do
the writing, from staged copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envspark import vocab
from envspark.functions.text import category, clean_unit, normalize_text, record_hash

KEY = ["station_code", "variable_code", "observed_at"]


def dedup_last_wins(batch: DataFrame, order: str = "load_order", key: list[str] | None = None,
                    count: str | None = None) -> DataFrame:
    """L1: one row per key, the one loaded last. A grouped ``max_by`` (partial aggregation before the
    shuffle), so a key repeated a million times is reduced map-side, never gathered in one task.
    ``count`` names a column for the number of rows of the key."""
    key = key or KEY
    rest = [c for c in batch.columns if c not in key]
    counted = [F.count("*").alias(count)] if count else []
    return (batch.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"), *counted)
            .select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest], *([count] if count else [])))


def dedup_skipped(batch: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows replaced by a later row of the same key (each counts as skipped)."""
    key = key or KEY
    kept = batch.select(F.struct(*key).alias("key"))  # a struct counts keys that hold a null as well
    return kept.agg((F.count("*") - F.count_distinct("key")).alias("skipped"))


def _value_changed(new, old):
    # abs(new - old) > 1e-9 as in plain float arithmetic: NaN differences compare false (Spark orders NaN
    # above every number, so guard it explicitly), equal values (including inf = inf) are unchanged.
    diff = F.abs(new - old)
    return (~new.eqNullSafe(old)) & (~F.isnan(diff)) & (diff > F.lit(1e-9))


def upsert_actions(target: DataFrame, batch: DataFrame, key: list[str] | None = None) -> DataFrame:
    """L2: full outer join on the key; action = insert | update | skip (batch rows) or keep (target only).

    Update when the value moved by more than 1e-9 or the unit differs (null counts as '').
    """
    key = key or KEY
    t = target.select(*key, F.col("value").alias("old_value"), F.col("unit").alias("old_unit"),
                      F.col("source_file_id").alias("old_source_file_id"), F.lit(True).alias("_in_t"))
    b = batch.select(*key, "value", "unit", "source_file_id", F.lit(True).alias("_in_b"))
    j = t.join(b, key, "full_outer")
    changed = _value_changed(F.col("value"), F.col("old_value")) | (
        F.coalesce(F.col("unit"), F.lit("")) != F.coalesce(F.col("old_unit"), F.lit("")))
    action = (F.when(F.col("_in_b").isNull(), F.lit("keep"))
              .when(F.col("_in_t").isNull(), F.lit("insert"))
              .when(changed, F.lit("update")).otherwise(F.lit("skip")))
    return j.withColumn("action", action).drop("_in_t", "_in_b")


def prune_target(target: DataFrame, touched: list[tuple], variable: str = "variable_code",
                 month: str = "observed_month") -> DataFrame:
    """L3: the target's (variable, month) partitions in ``touched``, as a literal filter on the partition columns.

    Only these partitions are listed and read; keys outside them cannot be met by the batch.
    """
    months: dict = {}
    for code, start in touched:
        months.setdefault(code, []).append(start)
    wanted = F.lit(False)
    for code, starts in months.items():
        known = [x for x in starts if x is not None]
        hit = F.col(month).isin(known) if known else F.lit(False)
        hit = hit | F.col(month).isNull() if len(known) < len(starts) else hit
        wanted = wanted | ((F.col(variable).isNull() if code is None else F.col(variable) == code) & hit)
    return target.where(wanted)


def upsert_result(actions: DataFrame, key: list[str] | None = None) -> DataFrame:
    """L2 merged table: batch values for insert / update, target values for skip / keep; hash refreshed."""
    key = key or KEY
    from_batch = F.col("action").isin("insert", "update")
    return actions.select(
        *key,
        F.when(from_batch, F.col("value")).otherwise(F.col("old_value")).alias("value"),
        F.when(from_batch, F.col("unit")).otherwise(F.col("old_unit")).alias("unit"),
        F.when(from_batch, F.col("source_file_id")).otherwise(F.col("old_source_file_id")).alias("source_file_id"),
        record_hash("station_code", "variable_code", "observed_at").alias("record_hash"),
    )


def upsert_counts(actions: DataFrame) -> DataFrame:
    """Inserted / updated / skipped (/ kept) counts in one aggregation."""
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def load_counters(actions: DataFrame, dedup_skips: int = 0) -> dict[str, int]:
    """L7 totals for the run ledger: one small collect of at most four rows."""
    got = {r["action"]: r["n"] for r in upsert_counts(actions).collect()}
    inserted, updated = got.get("insert", 0), got.get("update", 0)
    return {"inserted": inserted, "updated": updated, "skipped": got.get("skip", 0) + dedup_skips,
            "row_count": inserted + updated}


def new_dimension_members(codes: DataFrame, dim: DataFrame, code_col: str = "code",
                          id_col: str = "station_id") -> DataFrame:
    """L4: codes not yet in the dimension get ids max_id + 1, 2, ... in code order; name = code.

    The anti-join keeps only new codes (a handful per batch); numbering runs over that small set.
    """
    distinct = codes.select(F.col(code_col).alias("code")).distinct()
    new = distinct.join(dim.select(F.col(code_col).alias("code")), "code", "left_anti")
    base = dim.select(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    return new.select((base + F.row_number().over(Window.orderBy("code"))).cast("int").alias(id_col), "code",
                      F.col("code").alias("name"))


def new_variables(codes_units: DataFrame, variables: DataFrame, order: str = "load_order") -> DataFrame:
    """L4 for variables: display_name = code, category from N17, default_unit = first non-empty unit."""
    first_unit = (codes_units.where(clean_unit("unit").isNotNull())
                  .groupBy("variable_code").agg(F.min_by(clean_unit("unit"), F.col(order)).alias("first_unit")))
    new = (codes_units.select("variable_code").distinct()
           .join(variables.select(F.col("code").alias("variable_code")), "variable_code", "left_anti"))
    base = variables.select(F.coalesce(F.max("variable_id"), F.lit(0))).scalar()
    return (new.join(first_unit, "variable_code", "left")
            .select((base + F.row_number().over(Window.orderBy("variable_code"))).cast("int").alias("variable_id"),
                    F.col("variable_code").alias("code"), F.col("variable_code").alias("display_name"),
                    category("variable_code").alias("category"), F.col("first_unit").alias("default_unit")))


def backfill_default_unit(variables: DataFrame, codes_units: DataFrame, order: str = "load_order") -> DataFrame:
    """L4: an existing variable without default unit takes the first non-empty unit seen in the batch."""
    first_unit = (codes_units.where(clean_unit("unit").isNotNull())
                  .groupBy(F.col("variable_code").alias("code"))
                  .agg(F.min_by(clean_unit("unit"), F.col(order)).alias("first_unit")))
    return (variables.join(first_unit, "code", "left")
            .withColumn("default_unit", F.coalesce("default_unit", "first_unit")).drop("first_unit"))


def delete_by_variable(facts: DataFrame, codes: list[str], variable: str = "variable_code"):
    """(remaining facts, deleted count per code). Codes are normalised like any variable code."""
    from envspark.functions.text import normalize_code_py

    norm = sorted({normalize_code_py(c) for c in codes})
    hit = F.col(variable).isin(norm)
    return facts.where(~hit), facts.where(hit).groupBy(variable).agg(F.count("*").alias("n_deleted"))


def replace_by_variable(target: DataFrame, batch: DataFrame, codes: list[str],
                        variable: str = "variable_code") -> DataFrame:
    """The listed variables are replaced wholesale by the batch; other variables are untouched.

    On partitioned storage this is a dynamic partition overwrite of those ``variable_code`` partitions
    (``envspark.sources.files.write_measurements``), staged first, so a failure loses nothing.
    """
    from envspark.functions.text import normalize_code_py

    norm = sorted({normalize_code_py(c) for c in codes})
    kept = target.where(~F.col(variable).isin(norm))
    fresh = batch.where(F.col(variable).isin(norm)).select(*target.columns)
    return kept.unionByName(fresh)


# ---------------------------------------------------------------------------------------------------------
# L9 reference stations
# ---------------------------------------------------------------------------------------------------------

def _token(col) -> F.Column:
    return F.replace(normalize_text(F.coalesce(col, F.lit(""))), F.lit("_"), F.lit(""))


def resolve_station_references(stations: DataFrame) -> DataFrame:
    """First reference station (in reference order) sharing a token with the station's code or name.

    Tokens of each station (two) are matched by an equi-join against the fixed alias table (broadcast, its
    size is the literal vocabulary), then the smallest reference position wins.
    """
    spark = stations.sparkSession
    tokens = stations.select("station_id", "code", F.explode(F.array(_token(F.col("code")), _token(F.col("name"))))
                             .alias("token")).where(F.col("token") != "")
    aliases = F.broadcast(vocab.station_alias_df(spark))
    refs = F.broadcast(vocab.station_reference_df(spark))
    best = tokens.join(aliases, "token").groupBy("station_id", "code").agg(F.min("ref_order").alias("ref_order"))
    return best.join(refs, "ref_order")


def enrich_stations(stations: DataFrame) -> DataFrame:
    """Set coordinates from the reference when missing or off by > 1e-9; replace an empty / unknown /
    code-like name by the reference name; flag changed rows."""
    ref = resolve_station_references(stations).drop("code")
    j = stations.join(ref, "station_id", "left")
    has = F.col("ref_order").isNotNull()

    def moved(cur, new):
        return cur.isNull() | (F.abs(cur - new) > F.lit(1e-9))

    lat_c = has & moved(F.col("latitude"), F.col("ref_latitude"))
    lon_c = has & moved(F.col("longitude"), F.col("ref_longitude"))
    name_tok = _token(F.trim(F.coalesce(F.col("name"), F.lit(""))))
    name_c = has & ((F.trim(F.coalesce(F.col("name"), F.lit(""))) == "") | (name_tok == "unknownstation")
                    | (name_tok == _token(F.col("code"))))
    return j.select(
        "station_id", "code",
        F.when(name_c, F.col("ref_name")).otherwise(F.col("name")).alias("name"),
        F.when(lat_c, F.col("ref_latitude")).otherwise(F.col("latitude")).alias("latitude"),
        F.when(lon_c, F.col("ref_longitude")).otherwise(F.col("longitude")).alias("longitude"),
        F.col("ref_region").alias("region"),
        (lat_c | lon_c | name_c).alias("changed"),
    )


# ---------------------------------------------------------------------------------------------------------
# L8 run ledger (append-only events; the current state is the latest event per run)
# ---------------------------------------------------------------------------------------------------------

def run_state(events: DataFrame) -> DataFrame:
    """Latest status per run from an append-only ledger of (run_id, ts, status, records)."""
    return events.groupBy("run_id").agg(
        F.max_by("status", F.struct("ts", "status")).alias("status"),
        F.max("ts").alias("updated_at"),
        F.min("ts").alias("started_at"),
        F.count("*").alias("n_events"),
        F.sum("records").alias("records"),
    )
