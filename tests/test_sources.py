"""File shapes as published: blanks in headers, unpadded times, clock-change days, duplicates, gaps."""

import warnings
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridseries.operators import repair, weather
from gridseries.sources import loader, sinks


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def uk_day(day, periods):
    return "".join(f"{day},{p},{100 + p},{50 + p}\n" for p in range(1, periods + 1))


HEADER = "SETTLEMENT_DATE,SETTLEMENT_PERIOD,ND,ENGLAND_WALES_DEMAND\n"


def test_uk_days_of_46_48_and_50_periods(spark, tmp_path):
    text = HEADER + uk_day("30-MAR-2008", 46) + uk_day("31-Mar-2008", 48) + uk_day("26-OCT-2008", 50)
    raw = loader.read_ng_demand(spark, write(tmp_path, "uk.csv", text))
    assert raw.dtypes[1:] == [("SETTLEMENT_PERIOD", "int"), ("ND", "double"), ("ENGLAND_WALES_DEMAND", "double")]
    fixed = repair.fix_daylight(raw)
    assert {r["SETTLEMENT_DATE"]: r["count"] for r in fixed.groupBy("SETTLEMENT_DATE").count().collect()} == {
        "30-MAR-2008": 48, "31-Mar-2008": 48, "26-OCT-2008": 48
    }
    dated = loader.parse_settlement_period(fixed)
    last = dated.filter(F.to_date("Period") == "2008-03-30").orderBy(F.desc("Period")).limit(3).collect()
    assert [(r["Period"], r["ND"]) for r in last] == [
        (datetime(2008, 3, 30, 23, 30), 146.0),
        (datetime(2008, 3, 30, 23, 0), 146.0),
        (datetime(2008, 3, 30, 22, 30), 146.0),
    ]


def test_ny_duplicates_and_nulls(spark, tmp_path):
    text = (
        "Time Stamp,Name,Integrated Load\n11/02/2008 01:00:00,NYC,0\n11/02/2008 01:00:00,NYC,500\n"
        "11/02/2008 02:00:00,NYC,\n1/3/2008 4:05,NYC,7\n"
    )
    raw = loader.read_ny_load(spark, write(tmp_path, "ny.csv", text))
    dated = loader.parse_time_stamp(raw).withColumn("series_id", F.lit("NYC"))
    named = repair.fill_null_zero(dated.withColumnRenamed("Integrated Load", "TS"))
    out = {r["Period"]: r["TS"] for r in repair.merge_duplicates(named).collect()}
    assert out == {
        datetime(2008, 11, 2, 1): 500.0,
        datetime(2008, 11, 2, 2): 0.0,
        datetime(2008, 1, 3, 4, 5): 7.0,
    }


def test_last_duplicate_by_file_and_row(spark, tmp_path):
    for name, value in (("a.csv", 1), ("b.csv", 2)):
        write(tmp_path, name, f"Time Stamp,Integrated Load\n2008-01-01 00:00,{value}\n2008-01-01 00:00,{value * 10}\n")
    raw = loader.read_ny_load(spark, str(tmp_path), lineage=True)
    dated = loader.parse_time_stamp(raw).withColumn("series_id", F.lit("x"))
    last = repair.keep_last_duplicate(dated.withColumnRenamed("Integrated Load", "TS"), "ingest_ord")
    assert last.first()["TS"] == 20.0


def test_unknown_time_stamp_is_an_error(spark, tmp_path):
    raw = loader.read_ny_load(spark, write(tmp_path, "x.csv", "Time Stamp,Integrated Load\nyesterday,1\n"))
    with pytest.raises(Exception, match="unknown time stamp"):
        loader.parse_time_stamp(raw).collect()


def test_paths(spark, tmp_path):
    good = write(tmp_path, "ny.csv", "Time Stamp,Integrated Load\n1/1/2008,1\n")
    (tmp_path / "empty").mkdir()
    with pytest.raises(loader.FileLoadError):
        loader.read_ny_load(spark, str(tmp_path / "missing"))
    with pytest.raises(loader.FileLoadError):
        loader.read_ny_load(spark, str(tmp_path / "empty"))
    with pytest.raises(loader.FileLoadError):
        loader.read_ng_demand(spark, good)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        out = loader.read_present(spark, [good, str(tmp_path / "missing")], loader.NY_COLUMNS)
    skipped = [w for w in seen if w.category is UserWarning]  # Spark's own sockets warn as well
    assert out.count() == 1 and len(skipped) == 1
    with pytest.raises(loader.FileLoadError):
        loader.combine(None, out, "other")


def test_malformed_rows_fail_or_drop(spark, tmp_path):
    path = write(tmp_path, "ny.csv", "Time Stamp,Integrated Load\n1/1/2008,1\n2/1/2008,x\n3/1/2008,\n")
    with pytest.raises(Exception):
        loader.read_ny_load(spark, path).collect()
    assert loader.read_ny_load(spark, path, malformed="DROPMALFORMED").count() == 2


def test_station_list(spark, tmp_path):
    path = write(tmp_path, "stations.txt", "USAF  WBAN  LATITUDE LONGITUDE\n 030910 99999   57.2  -2.2\n037720 1 51.4789  -0.449 \n\n")
    out = loader.read_stations(spark, path).orderBy("USAF").collect()
    assert [tuple(r) for r in out] == [("030910", 57.2, -2.2), ("037720", 51.4789, -0.449)]


def test_weather_files(spark, tmp_path):
    one = write(tmp_path, "a.csv", "USAF,Date,HrMn,Q,Air_Temp,RHx \n030910,20080101,5,1,2.5,80\n030910,20080101,55,1,,81\n")
    two = write(tmp_path, "b.csv", "USAF,Date,HrMn,Q,Air_Temp,RHx \n030910,20080101,1230,1,3.5,82\n")
    obs = loader.read_weather(spark, [one, two], ["Air_Temp", "RHx "])
    assert obs.dtypes == [("USAF", "string"), ("Date", "string"), ("HrMn", "string"), ("Air_Temp", "float"), ("RHx", "int")]
    out = weather.parse_date_hrmn(obs).orderBy("Period").collect()
    assert [(r["Period"].hour, r["Period"].minute, r["Air_Temp"], r["RHx"]) for r in out] == [
        (0, 5, 2.5, 80), (0, 55, None, 81), (12, 30, 3.5, 82)
    ]


def test_zone_files(spark, tmp_path):
    rows = spark.createDataFrame(
        [("1/1/2008", "A", 1.0), ("1/1/2008", "B", 2.0), ("2/1/2008", "A", 3.0)],
        "`Time Stamp` string, Name string, `Integrated Load` double",
    )
    folder = str(tmp_path / "zones")
    sinks.write_by_zone(rows, folder)
    zone = loader.read_ny_load(spark, f"{folder}/Name=A").orderBy("Time Stamp").collect()
    assert [tuple(r) for r in zone] == [("1/1/2008", 1.0), ("2/1/2008", 3.0)]
    both = loader.read_ny_load(spark, folder, zones=True).orderBy("Name", "Time Stamp").collect()
    assert [tuple(r) for r in both] == [("A", "1/1/2008", 1.0), ("A", "2/1/2008", 3.0), ("B", "1/1/2008", 2.0)]
    assert loader.read_ny_load(spark, f"{folder}/Name=A", zones=True).count() == 2
    with pytest.raises(Exception):
        sinks.write_by_zone(rows, folder)


def test_zone_names_stay_text(spark, tmp_path):
    rows = spark.createDataFrame(
        [("1/1/2008", "007", 1.0), ("1/1/2008", "N.Y.C. / 1", 2.0), ("1/1/2008", None, 3.0)],
        "`Time Stamp` string, Name string, `Integrated Load` double",
    )
    sinks.write_by_zone(rows, str(tmp_path / "zones"))
    read = loader.read_ny_load(spark, str(tmp_path / "zones"), zones=True)
    assert {(r["Name"], r["Integrated Load"]) for r in read.collect()} == {("007", 1.0), ("N.Y.C. / 1", 2.0), (None, 3.0)}


def test_zone_folders_with_other_headers(spark, tmp_path):
    for zone, text in (("A", "Time Stamp,Integrated Load\n1/1/2008,1\n"), ("B", "Integrated Load,PTID,Time Stamp\n2,9,1/1/2008\n")):
        (tmp_path / f"Name={zone}").mkdir()
        write(tmp_path / f"Name={zone}", "x.csv", text)
    read = loader.read_ny_load(spark, str(tmp_path), zones=True)
    assert {tuple(r) for r in read.collect()} == {("A", "1/1/2008", 1.0), ("B", "1/1/2008", 2.0)}
    with pytest.raises(loader.FileLoadError, match="Zone"):
        loader.read_csv(spark, str(tmp_path), {"Zone": "string"})


def test_headers_are_read_from_the_beginnings_of_files(spark, tmp_path):
    line = "1/1/2008," + "1" * 80 + "\n"
    write(tmp_path, "a.csv", "Time Stamp,Integrated Load\n" + line * 200_000)
    write(tmp_path, "b.csv", "Time Stamp,Integrated Load\n1/1/2008,2\n")
    write(tmp_path, "c.csv", "")
    lines = loader._first_lines(spark, [str(tmp_path)])
    assert lines.rdd.getNumPartitions() == 2  # a task for each file that is not empty
    assert {r["header"] for r in lines.collect()} == {"Time Stamp,Integrated Load"} and lines.count() == 2
    assert len(loader._kinds(spark, [str(tmp_path)])) == 1
    assert loader.read_ny_load(spark, str(tmp_path)).count() == 200_001


def test_extremes_signed(spark):
    values = [float(v) for v in range(-100, 101)] + [-400.0]
    df = spark.createDataFrame([(v,) for v in values], "Air_Temp double")
    plain = weather.null_out_extremes(df, ["Air_Temp"]).filter("Air_Temp is null").count()
    signed = weather.null_out_extremes(df, ["Air_Temp"], signed=True).filter("Air_Temp is null").count()
    assert plain > 10 and signed == 1
