"""L2 against a plain-Python model of the original loop, on random batches with NaN / inf / near-equal
values and null / empty units (trap T4: Spark orders NaN above every number)."""

import math
from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from envspark.operators import load as L

VALUES = st.sampled_from([0.0, 1.0, 1.0 + 1e-10, 1.0 + 1e-8, -2.5, math.inf, -math.inf, math.nan, 1e300])
UNITS = st.sampled_from([None, "", "ug/m3", "mg/m3"])
KEYS = st.tuples(st.sampled_from(["A", "B"]), st.sampled_from(["PM25", "CO"]), st.integers(0, 2))


def model(target, batch):
    old = {k: (v, u) for k, v, u in target}
    out = {}
    for k, v, u in batch:
        if k not in old:
            out[k] = "insert"
            continue
        ov, ou = old[k]
        moved = abs(ov - v) > 1e-9  # False for NaN differences, as in Python
        out[k] = "update" if moved or (ou or "") != (u or "") else "skip"
    for k in old:
        out.setdefault(k, "keep")
    return out


def frame(spark, rows):
    data = [(k[0], k[1], datetime(2024, 1, 1, k[2]), v, u, 1) for k, v, u in rows]
    return spark.createDataFrame(data, "station_code string, variable_code string, observed_at timestamp_ntz, "
                                       "value double, unit string, source_file_id int")


def unique(rows):
    seen = {}
    for k, v, u in rows:
        seen[k] = (k, v, u)
    return list(seen.values())


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(KEYS, VALUES, UNITS), max_size=8), st.lists(st.tuples(KEYS, VALUES, UNITS), max_size=8))
def test_upsert_matches_model(spark, target, batch):
    target, batch = unique(target), unique(batch)
    got = {(r.station_code, r.variable_code, r.observed_at.hour): r.action
           for r in L.upsert_actions(frame(spark, target), frame(spark, batch)).collect()}
    assert got == model(target, batch)
