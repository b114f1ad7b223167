import pytest

from envspark.plans.sqlguard import SqlRejected, preview, serialized, validate_select


@pytest.mark.parametrize("sql", [
    "", "   ", "update t set a = 1", "select 1; select 2", "select * from t -- x", "select /* c */ 1",
    "select * from t where name = 'drop'", "SELECT reflect('java.lang.System', 'exit', '0')", "selectx from t",
])
def test_rejected(sql):
    with pytest.raises(SqlRejected):
        validate_select(sql)


@pytest.mark.parametrize("sql", [
    "select * from parquet.`/root/testdata/sf0.001/nation.parquet`", "select * from `parquet`.`/root/testdata/sf0.001/nation.parquet`",
    "select * from text.`/etc/hosts`", "select * from (select * from `csv` . `/etc/hosts`)", "select * from no_such_view",
    "select (select count(*) from json.`/etc/hosts`)", "select `reflect`('java.lang.Math', 'abs', -1)", "select 1 as truncated",
    "select 1) as a, (select 2",
])
def test_previews_read_views_only(spark, sql):
    with pytest.raises(SqlRejected):
        preview(spark, sql)
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_trailing_semicolon_dropped():
    assert validate_select("  SELECT 1 ; ") == "SELECT 1"


def test_preview_truncates_and_keeps_columns(spark):
    spark.range(10).createOrReplaceTempView("ten")
    got = preview(spark, "select id, id as _rn from ten order by id", 4).collect()
    assert [(r.id, r._rn) for r in got] == [(i, i) for i in range(4)] and all(r.truncated for r in got)
    assert not preview(spark, "select id from ten", 500).first().truncated
    assert preview(spark, "select id as truncated from ten", 3, flag="more").first().more


@pytest.mark.parametrize("limit", [0, 501, -1])
def test_preview_limit_out_of_range(spark, limit):
    with pytest.raises(ValueError):
        preview(spark, "select 1", limit)


def test_serialized_columns(spark):
    row = spark.sql("""select timestamp_ntz '2024-01-02 03:04:00' as a, timestamp_ntz '2024-01-02 03:04:05.5' as b,
                       date '2024-01-02' as c, cast(1.5 as decimal(4,2)) as d, unhex('FF61') as e, 7 as f""")
    assert tuple(serialized(row).first()) == ("2024-01-02T03:04:00", "2024-01-02T03:04:05.500000", "2024-01-02", 1.5, "�a", 7)
