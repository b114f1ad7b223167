"""Invariants of SURVEY §5: idempotent load, dedup independent of partitioning, counts add up, bounds."""

from pyspark.sql import functions as F

from conftest import SMALL
from envspark import binding as B
from envspark.operators import load as L
from envspark.operators import timeseries as A
from envspark.operators.queries import zoomed_days


def test_loading_twice_changes_nothing(spark):
    h = L.dedup_last_wins(B.hourly(spark, SMALL)).drop("load_order")
    acts = L.upsert_actions(h, h)
    assert {r.action for r in acts.select("action").distinct().collect()} == {"skip"}


def test_counts_add_up(spark):
    h = B.hourly(spark, SMALL)
    dedup = L.dedup_last_wins(h)
    skipped = L.dedup_skipped(h).first().skipped
    assert dedup.count() + skipped == h.count()
    target = dedup.where(F.col("load_order") % 2 == 0).drop("load_order")
    counts = L.load_counters(L.upsert_actions(target, dedup.drop("load_order")))
    assert counts["inserted"] + counts["updated"] + counts["skipped"] == dedup.count()


def test_dedup_independent_of_partitioning(spark):
    h = B.hourly(spark, SMALL)
    a = sorted(L.dedup_last_wins(h.repartition(1)).collect())
    b = sorted(L.dedup_last_wins(h.repartition(7, "value")).collect())
    assert a == b


def test_histogram_counts_sum_to_rows(spark):
    m = B.measurements(spark, SMALL)
    hist = A.histogram(m)
    assert hist.count() == 16
    assert hist.agg(F.sum("count")).first()[0] == m.count()


def test_autocorrelation_bounded(spark):
    pts = A.resample(B.measurements_li(spark, SMALL), "day", None, with_overall=False)
    acf = A.autocorrelation(pts.select("bucket", "series", "value"))
    vals = [r.acf for r in acf.collect()]
    assert vals and all(-1.0 - 1e-9 <= v <= 1.0 + 1e-9 for v in vals)


def test_unpivot_of_pivot_is_identity(spark):
    from envspark.operators.normalize import unpivot_wide

    m = B.measurements(spark, SMALL)
    codes = [f"ST{i:02d}" for i in range(25)]
    wide = A.series_pivot(m, "day", "station_code", codes).drop("overall")
    long = unpivot_wide(wide, ["bucket"], codes, "series", "value")
    direct = A.resample(m, "day", "station_code", with_overall=False).select("bucket", "series", "value")
    r = lambda df: sorted((x.bucket, x.series, round(x.value, 9)) for x in df.collect())
    assert r(long) == r(direct)


def test_replace_touches_only_its_variables(spark):
    h = L.dedup_last_wins(B.hourly(spark, SMALL)).drop("load_order")
    batch = h.withColumn("value", F.col("value") + 100)
    out = L.replace_by_variable(h, batch, ["PM25"])
    old = h.select(*L.KEY, F.col("value").alias("old_value"))
    changed = (out.join(old, L.KEY).where(F.col("value") != F.col("old_value")).select("variable_code")
               .distinct().collect())
    assert [r[0] for r in changed] == ["PM25"]
    assert out.count() == h.count()


def test_iqr_short_series_unchanged(spark):
    pts = spark.createDataFrame([("a", "s", 1.0), ("b", "s", 2.0)], "bucket string, series string, value double")
    out = A.iqr_anomalies(pts).collect()
    assert all(r.is_anomaly is None and r.lower is None for r in out)


def test_zoomed_days():
    from datetime import date

    assert zoomed_days(date(2024, 1, 1), date(2024, 1, 31), 50, 100) == (date(2024, 1, 16), date(2024, 1, 31))
    assert zoomed_days(date(2024, 1, 31), date(2024, 1, 1), 0, 50) == (date(2024, 1, 31), date(2024, 1, 1))


def test_link_variable_selection():
    from envspark.sources.links import select_variables

    assert select_variables(["pm2.5", "PM25", "xx", "co"]) == (["PM25", "CO"], 2)
    assert select_variables(None)[1] == 4


def test_link_catalogue_greedy_url_and_variable(spark):
    """A URL taken for one variable blocks a later anchor of another variable; that variable is then filled
    by the next anchor with a free URL (the sequential rule of the original)."""
    from envspark.sources.links import link_catalogue

    html = ('<html><a href="http://x.org/u1">Material (PM2.5)</a> <a href="http://x.org/u1">Gas (NO2)</a> '
            '<a href="http://x.org/u2">Gas (no-2)</a> <a href="mailto:a@b">(co)</a> '
            '<a href="/u3#frag">Ozono</a> <a href="http://y.org/u4">(CO)</a></html>')
    pages = spark.createDataFrame([(1, "http://x.org/dir/page.html", html)], "page_id long, url string, html string")
    got = [(r.pos, r.url, r.variable_code) for r in
           link_catalogue(pages, "http://x.org", ["PM25", "NO2", "O3", "CO"]).orderBy("pos").collect()]
    assert got == [(0, "http://x.org/u1", "PM25"), (2, "http://x.org/u2", "NO2"), (4, "http://x.org/u3", "O3")]
