import datetime as dt

from panelkit.operators import aggregate as A


def test_one_scan_counts_every_column(spark):
    rows = [(1, "a", 0.0, None, b"\xff", dt.date(2024, 1, 1)), (2, "a", -0.0, None, b"\xfe", None), (2, "", float("nan"), None, b"\xff", dt.date(2024, 1, 1)),
            (None, None, float("nan"), None, None, dt.date(2024, 1, 2))]
    df = spark.createDataFrame(rows, "k long, `a.b` string, x double, nothing string, raw binary, day date")
    got = {r.variable: r.n_distinct for r in A.column_profile(df).collect()}
    assert got == {"k": 2, "a.b": 2, "x": 2, "nothing": 0, "raw": 2, "day": 2}
    assert {r.variable: r.n_distinct for r in A.column_profile(df.limit(0)).collect()} == dict.fromkeys(got, 0)


def test_plan_reads_the_table_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert A.column_profile(df)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
