"""File fixtures of FIXTURES.md §2, written into a fresh scratch folder by the tests."""

from __future__ import annotations

import io
import os
import zipfile

LONG_CSV = (
    "estacion,fecha_hora,contaminante,valor,unidad\n"
    "Belisario,2024-01-15 08:00,PM2.5,35.2,µg/m3\n"
    "Belisario,2024-01-15 09:00,PM2.5,30.0,\n"
    "Belisario,2024-01-15 08:00,PM2.5,36.0,µg/m3\n"
    "Carapungo,2024-01-15 08:00,NO2,\"1,5\",\n"
    ",2024-01-15 10:00,O3,12.5,\n"
    "Carapungo,2024-01-15 11:00,,14.0,\n"
)
WIDE_CSV = (
    "Unnamed: 0,BELISARIO,Carapungo,EL CAMAL\n"
    "Fecha/Unidad,ug/m3,ug/m3,ug/m3\n"
    "2024-01-15 08:00,35.2,,12\n"
    "2024-01-15 09:00,33.0,20.5,\n"
)
SPLIT_CSV = (
    "fecha,hora,estacion,variable,valor\n"
    "2024-01-15,08:00,BEL,PM10,10\n"
    "2024-01-15,09:00,BEL,PM10,11\n"
    "2024-01-15,10:00,BEL,PM10,12\n"
    "2024-01-15,11:00,BEL,PM10,13\n"
)
STATION_FIRST_NUMERIC = (
    "id,registro,variable,valor\n"
    "101,2024-01-15 08:00,PM10,1\n"
    "102,2024-01-15 09:00,PM10,2\n"
    "103,not a date,PM10,3\n"
    "104,2024-01-15 11:00,PM10,4\n"
)
VALUE_NO_VARIABLE = "fecha,valor\n2024-01-15,1\n2024-01-16,2\n"
WIDE_BY_VARIABLE = (
    "date,pm25,pm10,stationId,temp\n"
    "2024-01-01 00:00,12.5,20.1,ST01,15.2\n"
    "2024-01-01 01:00,NaN,19.8,ST01,15.0\n"
    "2024-01-01 02:00,13.1,21.0,ST01,14.8\n"
    "Invalid Date,12.9,20.5,ST01,14.6\n"
    "2024-01-01 04:00,12.2,text,ST01,14.4\n"
    "2024-01-01 05:00,11.8,19.5,ST01,14.1\n"
    "2024-01-01 06:00,11.5,19.0,ST01,13.9\n"
    "2024-01-01 07:00,11.0,18.7,ST01,13.7\n"
)
SEMICOLON_LATIN1 = "estacion;fecha_hora;variable;valor\nGuamaní;2024-01-15 08:00;SO2;4,0\nGuamaní;2024-01-15 09:00;SO2;4\n"
OFFSETS = (
    "station,timestamp,variable,value\n"
    "A,2024-01-15T08:00:00Z,CO,1\n"
    "A,2024-01-15T08:00:00-05:00,CO,2\n"
    "A,2024-01-15 09:00,CO,3\n"
    "A,15/01/2024,CO,4\n"
    "A,03/02/2024,CO,5\n"
)


def write_all(root: str) -> dict[str, str]:
    os.makedirs(root, exist_ok=True)
    files = {
        "long.csv": LONG_CSV.encode("utf-8"),
        "PM2.5.csv": WIDE_CSV.encode("utf-8"),
        "fecha_hora_split.csv": SPLIT_CSV.encode("utf-8"),
        "value_no_variable.csv": VALUE_NO_VARIABLE.encode("utf-8"),
        "station_first_numeric.csv": STATION_FIRST_NUMERIC.encode("utf-8"),
        "wide_by_variable.csv": WIDE_BY_VARIABLE.encode("utf-8"),
        "semicolon_latin1.txt": SEMICOLON_LATIN1.encode("latin-1"),
        "bom.csv": b"\xef\xbb\xbf" + SPLIT_CSV.encode("utf-8"),
        "offsets.csv": OFFSETS.encode("utf-8"),
        "allnull.csv": b",,,\n,,,\n",
        "empty.csv": b"a,b,c\n",
        "notes.pdf": b"%PDF-1.4 not a data file",
        "x.bin": b"\x00\x01\x02",
    }
    paths = {}
    for name, data in files.items():
        p = os.path.join(root, name)
        with open(p, "wb") as fh:
            fh.write(data)
        paths[name] = p
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("long.csv", LONG_CSV)
        zf.writestr("a/b.csv", SPLIT_CSV)
    zdir = os.path.join(root, "zips")
    os.makedirs(zdir, exist_ok=True)
    p = os.path.join(zdir, "bundle.zip")
    with open(p, "wb") as fh:
        fh.write(buf.getvalue())
    paths["bundle.zip"] = p
    return paths
