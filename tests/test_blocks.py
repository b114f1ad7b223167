"""Block-wise reading: digests, archives in chunks, awkward names and headers, reject counts, archives in the ingest job."""

import hashlib
import io
import os
import tempfile
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from envspark.plans import ingest_job as J
from envspark.sources import blocks as B
from envspark.sources import files as S

HEAD = "estacion;fecha_hora;contaminante;valor;unidad\n"


def folder(files):
    root = tempfile.mkdtemp(prefix="blocks-", dir="/tmp")
    for name, data in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())
    return root


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.mark.parametrize("size", [1, 2, 7, 1 << 20])
@pytest.mark.parametrize("text", [b"", b"a", b"\n", b"a\nbb\n\nccc\n", b"a\nbb\n\nccc", b"\n\n\n", b"x" * 50 + b"\ny"])
def test_line_chunks_hold_every_line_once(size, text):
    lines = {}
    for first, piece in B.line_chunks(io.BytesIO(text), size):
        lines |= {first + k: line for k, line in enumerate(piece.split(b"\n"))}
    want = text.split(b"\n")[:-1] if text.endswith(b"\n") else text.split(b"\n") if text else []
    assert [lines[k] for k in sorted(lines)] == want and sorted(lines) == list(range(len(want)))


def test_digests_of_many_and_large_files(spark, monkeypatch):
    monkeypatch.setattr(B, "TASK_BYTES", 1000)
    files = {f"f {k}%20.bin": os.urandom(k * 37) for k in range(1, 40)} | {"big.bin": os.urandom(9 << 20)}
    root = folder(files)
    located = [(r.file, r.length) for r in S.located(spark, root).collect()]
    df = B.file_digests(spark, located)
    assert df.rdd.getNumPartitions() > 5
    got = {r.file.rsplit("/", 1)[1]: r.checksum_sha256 for r in df.collect()}
    assert sorted(got.values()) == sorted(hashlib.sha256(d).hexdigest() for d in files.values())


@pytest.mark.parametrize("chunk", [16, 100, 1 << 20])
def test_a_member_larger_than_a_chunk_loses_no_line(spark, chunk):
    rows = [f"S{k % 3};2024-01-{k % 28 + 1:02d} {k % 24:02d}:00:00;NO2;{k};ug/m3" for k in range(300)]
    root = folder({"big.zip": zipped({"deep/a.csv": "\n \n" + HEAD + "\n".join(rows) + "\n", "crlf.csv": "﻿" + HEAD.replace("\n", "\r\n")
                                      + "\r\n".join(rows[:50]), "latin.csv": HEAD.encode() + "GUAMANÍ;2024-01-01 00:00:00;CO;1;u\n".encode("latin-1")})})
    chunks = S.expand_zip(spark, root, chunk)
    if chunk < 1000:
        assert chunks.count() > 20
    got = S.parse_members(spark, chunks)
    by = {r.source_workbook: r.n for r in got.groupBy("source_workbook").agg(F.count("*").alias("n")).collect()}
    assert by == {"a.csv": 300, "crlf.csv": 50, "latin.csv": 1}
    numbers = sorted(r.source_row_number for r in got.where("source_workbook = 'a.csv'").collect())
    assert numbers == list(range(2, 302))
    assert got.where("source_workbook = 'latin.csv'").first().station_code == "GUAMANÍ"


def test_archives_in_the_ingest_job(spark):
    a = HEAD + "S1;2024-01-01 00:00:00;NO2;1;ug/m3\nS2;2024-01-01 00:00:00;CO;2;mg/m3\nS2;never;CO;2;mg/m3\nS2;2024-01-02;;2;u\nS2;2024-01-02;CO;x;u\n"
    b = HEAD + "S1;2024-01-01 00:00:00;NO2;7;ug/m3\n"
    broken = bytearray(zipped({"c.csv": HEAD + "S9;2024-01-01 00:00:00;NO2;7;ug/m3\n" * 50}))
    broken[60:80] = bytes(20)
    root = folder({"1 first.csv": a, "2[x].zip": zipped({"m/b.csv": b, "readme.pdf": "x"}), "3.zip": b"PK no archive", "4.zip": bytes(broken),
                   "5.zip": zipped({"only.pdf": "x"})})
    store = tempfile.mkdtemp(prefix="blocks-store-", dir="/tmp")
    run = J.ingest(spark, root, store)
    assert (run["files_found"], run["files_loaded"], run["inserted"]) == (5, 5, 2)
    table = J.measurements(spark, store)
    assert {(r.station_code, r.variable_code): r.value for r in table.collect()} == {("S1", "NO2"): 7.0, ("S2", "CO"): 2.0}
    ledger = {r.original_name: r for r in J.store_table(spark, store, "source_files", J.FILE_LEDGER).collect()}
    assert {k: (r.status, r.row_count) for k, r in ledger.items()} == {
        "1 first.csv": ("completed", 2), "2[x].zip": ("completed", 1), "3.zip": ("failed", 0), "4.zip": ("failed", 0), "5.zip": ("completed", 0)}
    first = ledger["1 first.csv"]
    assert (first.rejected_timestamp, first.rejected_value, first.rejected_variable) == (1, 1, 1)
    assert first.landing_name == hashlib.sha256(a.encode()).hexdigest()[:12] + "-1 first.csv"
    events = J.store_table(spark, store, "file_events", J.FILE_EVENTS).collect()
    states = {r.source_file_id: r.status for r in sorted(events, key=lambda r: r.ts)}
    assert len(events) == 15 and states == {r.source_file_id: r.status for r in ledger.values()}
    again = J.ingest(spark, root, store)
    assert again["inserted"] == again["updated"] == 0


def test_awkward_names_and_headers(spark):
    wide = "fecha;PM2.5;`odd`;_own;;a b\n2024-01-01 00:00;1;2;3;4;5\n2024-01-01 01:00;x;;3;4;5\n"
    blank_first = ";BELISARIO;CENTRO\n2024-01-01 00:00;1;2\n2024-01-01 01:00;3;4\n"
    root = folder({"NO2 2024.csv": wide, "O3 [a]{b}*.csv": blank_first, "CO 100%25.csv": wide})
    paths = [r.path for r in S.located(spark, root).collect()]
    got = S.read_delimited(spark, paths, rejects=True)
    rows = got.collect()
    staged = [r for r in rows if r.reject is None]
    o3 = sorted((r.station_code, r.observed_at, r.value) for r in staged if r.source_workbook == "O3 [a]{b}*.csv")
    assert o3 == [("BELISARIO", datetime(2024, 1, 1, 0), 1.0), ("BELISARIO", datetime(2024, 1, 1, 1), 3.0),
                  ("CENTRO", datetime(2024, 1, 1, 0), 2.0), ("CENTRO", datetime(2024, 1, 1, 1), 4.0)]
    for name in ("NO2 2024.csv", "CO 100%25.csv"):
        own = [r for r in staged if r.source_workbook == name]
        assert len(own) == 5 + 3 and sorted(r.value for r in own if r.observed_at.hour == 0) == [1.0, 2.0, 3.0, 4.0, 5.0]
        assert {r.station_code for r in own} >= {"PM25", "`ODD`", "_OWN", "UNNAMED_4"}
        assert [(r.reject, r.source_row_number) for r in rows if r.source_workbook == name and r.reject] == [("value", 3)]
