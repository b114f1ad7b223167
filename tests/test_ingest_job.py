"""The ingest job: files -> table, dimensions and ledgers; skipping, copies, forced runs, failures."""

import os
import tempfile

import pytest

from envspark.plans import ingest_job as J

HEAD = "estacion;fecha_hora;contaminante;valor;unidad\n"


def _folder(files):
    root = tempfile.mkdtemp(prefix="envspark-ingest-", dir="/tmp")
    for name, text in files.items():
        with open(os.path.join(root, name), "w", encoding="utf-8") as f:
            f.write(text)
    return root, tempfile.mkdtemp(prefix="envspark-store-", dir="/tmp")


def test_ingest_loads_once_and_keeps_both_ledgers(spark):
    a = HEAD + "S1;2024-01-01 00:00:00;NO2;1.5;ug/m3\nS1;2024-01-01 00:00:00;NO2;2.5;ug/m3\nS2;2024-01-01 01:00:00;CO;3;mg/m3\n"
    b = HEAD + "S1;2024-01-01 00:00:00;NO2;9;ug/m3\n"
    root, store = _folder({"a.csv": a, "a_copy.csv": a, "b.csv": b, "c.pdf": "x", "head.csv": HEAD, "zero.csv": ""})
    first = J.ingest(spark, root, store)
    assert (first["files_found"], first["files_loaded"]) == (5, 3)  # a file without a byte is not listed
    assert (first["inserted"], first["updated"], first["skipped"]) == (2, 0, 2 + 3)  # two replaced rows, a copy of three
    table = J.measurements(spark, store)
    got = {(r.station_code, r.variable_code): r.value for r in table.collect()}
    assert got == {("S1", "NO2"): 9.0, ("S2", "CO"): 3.0}  # the last row of the last file wins
    ledger = {r.original_name: (r.status, r.row_count, r.error_message is None)
              for r in J.store_table(spark, store, "source_files", J.FILE_LEDGER).collect()}
    assert ledger == {"a.csv": ("completed", 3, True), "a_copy.csv": ("completed", 0, True), "b.csv": ("completed", 1, True),
                      "c.pdf": ("failed", 0, False), "head.csv": ("completed", 0, True)}
    stations = J.store_table(spark, store, "stations", J.STATIONS).collect()
    assert sorted((r.station_id, r.code) for r in stations) == [(1, "S1"), (2, "S2")]
    variables = J.store_table(spark, store, "variables", J.VARIABLES).collect()
    assert sorted((r.code, r.default_unit) for r in variables) == [("CO", "mg/m3"), ("NO2", "ug/m3")]

    again = J.ingest(spark, root, store)
    assert (again["files_loaded"], again["inserted"], again["updated"], again["skipped"]) == (1, 0, 0, 3 + 3 + 1)  # head.csv
    forced = J.ingest(spark, root, store, force=True)
    assert (forced["files_loaded"], forced["inserted"], forced["updated"]) == (4, 0, 0)
    assert {r.status for r in J.run_states(spark, store).collect()} == {"completed"}
    assert len(J.store_table(spark, store, "stations", J.STATIONS).collect()) == 2


def test_ingest_failure_is_recorded(spark, monkeypatch):
    root, store = _folder({"a.csv": HEAD + "S1;2024-01-01 00:00:00;NO2;1.5;ug/m3\n"})

    def fails(*args, **kwargs):
        raise RuntimeError("disk gone")

    monkeypatch.setattr(J, "load_measurements", fails)
    with pytest.raises(RuntimeError):
        J.ingest(spark, root, store)
    run = J.run_states(spark, store).collect()
    assert [(r.status, "disk gone" in r.error_message) for r in run] == [("failed", True)]
    monkeypatch.undo()
    assert J.ingest(spark, root, store)["inserted"] == 1  # the file was not marked as loaded
