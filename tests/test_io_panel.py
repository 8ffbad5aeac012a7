"""Raw delimited fixtures (temp dir) -> typed panel; by-name binding,
empty files, bad numbers, NaN, negative/zero kWh, bad timestamps, missing
survey rows, NA flags, station without sunshine, zero living area."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from panelkit.operators import panel_build as PB
from panelkit.sources import io


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture(scope="module")
def raw_dir():
    d = tempfile.mkdtemp(prefix="panelkit-fixture-")
    m = f"{d}/smart_meter_data/daily"
    _write(f"{m}/h1.csv", "Household_ID;Timestamp;kWh_received_Total;kWh_received_HeatPump;kWh_received_Other;kWh_returned_Total\n"
           "1;2022-01-01T00:00:00;10.5;;;\n1;2022-01-02T00:00:00;abc;;;\n1;2022-01-03T00:00:00;NaN;;;\n"
           "1;2022-01-04T00:00:00;-1;;;\n1;2022-01-05T00:00:00;0;;;\n1;garbage;3;;;\n1;2022-01-08T00:00:00;7.25;2;5.25;0\n")
    # reordered header: must bind by name
    _write(f"{m}/h2.csv", "kWh_returned_Total;Timestamp;Household_ID;kWh_received_Total;kWh_received_Other;kWh_received_HeatPump\n"
           "1.5;2022-01-01;2;20;;\n;2022-01-02;2;21;;\n")
    _write(f"{m}/h3.csv", "")  # empty file
    _write(f"{m}/h4.csv", "Household_ID;Timestamp;kWh_received_Total;kWh_received_HeatPump;kWh_received_Other;kWh_returned_Total\n"
           "4;2022-01-01;5;;;\n")
    _write(f"{d}/meta_data/meta_data.csv", "Household_ID;Weather_ID;Group\n1;W1;treatment\n2;W2;control\n4;W1;control\n")
    _write(f"{d}/meta_data/households.csv",
           "Household_ID;Survey_Building_Type;Survey_HeatPump_Installation_Type;Survey_Building_LivingArea;"
           "Survey_Building_Residents;Survey_HeatDistribution_System_FloorHeating;Survey_HeatDistribution_System_Radiator;"
           "Survey_Installation_HasDryer;Survey_Installation_HasFreezer;Survey_Installation_HasElectricVehicle\n"
           "1;House;air;150;3;TRUE;FALSE;;True;\n2;Flat;ground;0;2;FALSE;TRUE;T;F;FALSE\n")
    w = f"{d}/weather_data/daily"
    _write(f"{w}/W1.csv", "Weather_ID;Timestamp;Temperature_max_daily;Temperature_min_daily;Temperature_avg_daily;"
           "HeatingDegree_SIA_daily;CoolingDegree_US_daily;Humidity_avg_daily;Precipitation_total_daily;Sunshine_duration_daily\n"
           "W1;2022-01-01;5;-1;2;18;0;80;1.2;3\nW1;2022-01-05;6;0;3;17;0;75;0;2\nW1;2022-01-08;4;-2;1;19;0;85;0;1\n")
    _write(f"{w}/W2.csv", "Weather_ID;Timestamp;Temperature_max_daily;Temperature_min_daily;Temperature_avg_daily;"
           "HeatingDegree_SIA_daily;CoolingDegree_US_daily;Humidity_avg_daily;Precipitation_total_daily\n"
           "W2;2022-01-01;7;1;4;16;0;70;0\nW2;2022-01-02;8;2;5;15;0;72;0.5\n")
    return d


def test_read_by_name_and_skip_empty(spark, raw_dir):
    raw = io.read_delimited_dir(spark, f"{raw_dir}/smart_meter_data/daily", PB.METER_COLUMNS,
                                key_columns=["Household_ID", "Timestamp"])
    rows = {(r["Household_ID"], r["Timestamp"]): r for r in raw.collect()}
    assert len(rows) == 10
    r = rows[("2", "2022-01-01")]
    assert r["kWh_received_Total"] == "20" and r["kWh_returned_Total"] == "1.5"


def test_annual_dataset_from_raw_files(spark, raw_dir, tmp_path):
    head = "Household_ID;Timestamp;kWh_received_Total;kWh_received_HeatPump;kWh_received_Other;kWh_returned_Total\n"

    def months(h, year, n, kwh, returned=""):
        return "".join(f"{h};{year}-{k:02d}-01T00:00:00;{kwh};;;{returned}\n" for k in range(1, n + 1))

    m = str(tmp_path / "monthly")
    _write(f"{m}/1.csv", head + months(1, 2021, 12, 100, 2) + months(1, 2022, 10, 120) + months(1, 2023, 9, 999))   # 9 months: not a year
    _write(f"{m}/2.csv", head + months(2, 2022, 12, 50) + months(2, 2023, 12, "bad"))                                # a year without a total
    _write(f"{m}/4.csv", head + months(4, 2022, 11, 10))                                                             # no survey row: dropped at the end
    meter = io.read_delimited_dir(spark, m, PB.METER_COLUMNS, key_columns=["Household_ID", "Timestamp"])
    meta = io.read_delimited_dir(spark, f"{raw_dir}/meta_data/meta_data.csv", PB.META_COLUMNS, glob="*")
    hh = io.read_delimited_dir(spark, f"{raw_dir}/meta_data/households.csv", PB.HOUSEHOLD_COLUMNS, glob="*")
    wx = io.read_delimited_dir(spark, f"{raw_dir}/weather_data/daily", PB.WEATHER_COLUMNS, key_columns=["Weather_ID", "Timestamp"])
    out = PB.build_annual_dataset(meter, meta, hh, wx)
    assert out.columns == PB.ANNUAL_COLUMNS and len(out.columns) == 22
    rows = {r["Household_ID"]: r for r in out.collect()}
    assert set(rows) == {"1", "2"}
    one, two = rows["1"], rows["2"]
    assert one["annual_kWh_total"] == pytest.approx((1200 + 1440) / 2) and one["annual_kWh_returned"] == pytest.approx(12)
    assert two["annual_kWh_total"] == pytest.approx(600) and two["annual_kWh_returned"] == 0 and two["kWh_per_m2"] is None
    # the median is taken over 1, 2 and 4, before 4 is dropped
    assert one["high_consumption"] == 1 and two["high_consumption"] == 0
    assert one["has_dryer"] == 0 and one["has_freezer"] == 1 and one["temp_avg"] == pytest.approx(2.0)
    assert one["heating_degree_days"] == pytest.approx(54) and one["precipitation_total"] == pytest.approx(1.2)


def test_paths_with_spaces_are_read_and_bad_headers_stop(spark, tmp_path):
    d = str(tmp_path / "raw files [a]")
    _write(f"{d}/h 1.csv", "k;v\n1;a\n")
    _write(f"{d}/h2.csv", "v;k\nb;2\n")
    rows = io.read_delimited_dir(spark, f"{tmp_path}/raw files*", ["k", "v"], key_columns=["k"]).collect()
    assert sorted(map(tuple, rows)) == [("1", "a"), ("2", "b")]
    _write(f"{d}/h3.csv", "K,v\n3,c\n")
    with pytest.raises(ValueError, match="h3.csv"):
        io.read_delimited_dir(spark, f"{tmp_path}/raw files*", ["k", "v"], key_columns=["k"])


def test_typed_readings_filters(spark, raw_dir):
    raw = io.read_delimited_dir(spark, f"{raw_dir}/smart_meter_data/daily", PB.METER_COLUMNS,
                                key_columns=["Household_ID", "Timestamp"])
    t = PB.typed_readings(raw).toPandas()
    # dropped: bad number, NaN, negative, bad timestamp; zero kept
    assert sorted(zip(t.Household_ID, t.date.astype(str))) == [
        ("1", "2022-01-01"), ("1", "2022-01-05"), ("1", "2022-01-08"), ("2", "2022-01-01"),
        ("2", "2022-01-02"), ("4", "2022-01-01")]


def test_build_daily_panel(spark, raw_dir):
    raw = io.read_delimited_dir(spark, f"{raw_dir}/smart_meter_data/daily", PB.METER_COLUMNS,
                                key_columns=["Household_ID", "Timestamp"])
    meta = io.read_delimited_dir(spark, f"{raw_dir}/meta_data/meta_data.csv", PB.META_COLUMNS, glob="*")
    hh = io.read_delimited_dir(spark, f"{raw_dir}/meta_data/households.csv", PB.HOUSEHOLD_COLUMNS, glob="*")
    wx = io.read_delimited_dir(spark, f"{raw_dir}/weather_data/daily", PB.WEATHER_COLUMNS,
                               key_columns=["Weather_ID", "Timestamp"])
    p = PB.build_daily_panel(raw, meta, hh, wx)
    assert p.columns == PB.PANEL_COLUMNS and len(p.columns) == 31
    pdf = p.toPandas().sort_values(["Household_ID", "date"])
    # household 4 has no survey row -> core vars missing -> dropped; 1-01-05 has weather
    assert list(zip(pdf.Household_ID, pdf.date.astype(str))) == [
        ("1", "2022-01-01"), ("1", "2022-01-05"), ("1", "2022-01-08"), ("2", "2022-01-01"), ("2", "2022-01-02")]
    h1 = pdf[pdf.Household_ID == "1"].iloc[0]
    assert h1.kWh_per_m2 == pytest.approx(10.5 / 150) and h1.weekday == 6 and h1.is_weekend == 1
    assert h1.has_dryer == 0 and h1.has_freezer == 1 and h1.has_electric_vehicle == 0  # NA flags -> 0
    h2 = pdf[pdf.Household_ID == "2"].iloc[0]
    assert h2.kWh_per_m2 != h2.kWh_per_m2  # zero living area -> NULL ratio
    assert h2.sunshine_hours != h2.sunshine_hours and h2.temp_range == 6  # station without sunshine


def test_checkpoint_csv_and_metrics_roundtrip(spark, tmp_path):
    df = spark.range(10).select(F.col("id"), (F.col("id") % 3).alias("year"))
    back = io.checkpoint_table(df, "t", partition_by=["year"])
    assert sorted(r["id"] for r in back.collect()) == list(range(10))
    io.export_csv(df, str(tmp_path / "csv"), single_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 10
    m = io.metrics_frame(spark, {"share_zero": 0.2024, "n": 3300}, run="r1")
    io.write_metrics(m, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2


def test_read_dimension_checks_header(spark, raw_dir):
    schema = "Household_ID string, Weather_ID string, Group string"
    ok = io.read_dimension(spark, f"{raw_dir}/meta_data/meta_data.csv", schema)
    assert sorted(r["Household_ID"] for r in ok.collect()) == ["1", "2", "4"]
    swapped = "Weather_ID string, Household_ID string, Group string"
    with pytest.raises(Exception):
        io.read_dimension(spark, f"{raw_dir}/meta_data/meta_data.csv", swapped).collect()
