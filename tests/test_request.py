"""One analysis request plans every chart output; all of them run and agree with each other."""

from datetime import date

from pyspark.sql import functions as F

from conftest import SMALL
from envspark import binding as B
from envspark.operators.queries import Filters
from envspark.plans.contract import run_contract
from envspark.plans.request import AnalysisRequest, run_analysis


def test_every_output_runs(spark):
    dims = (B.measurements(spark, SMALL), B.stations(spark, SMALL), B.variables(spark, SMALL),
            B.source_files(spark, SMALL))
    req = AnalysisRequest(filters=Filters(date_from=date(2024, 1, 20), date_to=date(2024, 1, 5)), preset=None,
                          zoom=(0, 50), granularity="day", category="pollutant")
    out = run_analysis(*dims, req)
    counts = {k: v.count() for k, v in out.items()}
    assert all(n > 0 for n in counts.values()), counts
    n_rows = counts["rows"]
    assert out["histogram"].agg(F.sum("count")).first()[0] == n_rows
    assert out["summary"].first().samples == n_rows
    assert counts["series_keys"] == 4


def test_contract_types(spark):
    from datetime import datetime

    m = B.measurements(spark, SMALL)
    args = dict(metric="pm25", station_codes=None, date_from=datetime(2024, 1, 1), date_to=datetime(2024, 2, 1))
    ts = run_contract(m, aggregation="daily", **args)
    assert ts.agg(F.sum("n")).first()[0] == m.where("variable_code = 'PM25'").count()
    assert run_contract(m, aggregation="daily", result_type="distribution", **args).count() == 16
    assert run_contract(m, aggregation="daily", result_type="trend", **args).count() == 1
    assert run_contract(m, aggregation="hourly", result_type="correlation_matrix", **args).count() == 28
