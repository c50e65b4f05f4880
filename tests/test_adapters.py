"""Readers over written files, cleaning with its counters, events."""

import json
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from gridloom.operators import cleaning
from gridloom.sources import adapters


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)


def stamps(rows, column="timestamp_utc"):
    return [r[column].strftime("%m-%d %H:%M") for r in rows]


def test_commented_exports(spark, tmp_path):
    head = "# This file was exported\n# Turbine: North 1\n# Time zone: UTC\n"
    write(
        tmp_path / "Turbine_Data_North_1.csv",
        head + '# Date and time,"Wind speed (m/s)","Power, mean (kW)",Other\n2020-01-01 00:00:00,5.0,1000,x\n2020-01-01 00:00:00,,,y\n'
        "2020-01-01 00:10:00,bad,2000,x\n2020-01-01 00:20:00,,,z\n",
    )
    write(tmp_path / "Turbine_Data_other.csv", "# no name here\nDate and time;Wind speed (m/s)\n2020-01-01 00:00:00;7\n")
    write(
        tmp_path / "Status_North_1.csv",
        head + "Timestamp start,Timestamp end,Status,Code,Message,IEC category\n2020-01-01 01:00:00,2020-01-01 02:00:00,Stop,77,Yaw  Error,Forced outage\n-,,Stop,1,none,\n",
    )
    export = adapters.CommentedExport("s", "site", {"wind": "Wind speed (m/s)", "power_pu": "Power, mean (kW)"}, rated_kw=2000.0)
    rows = export.readings(spark, str(tmp_path)).orderBy("turbine_id", "timestamp_utc").collect()
    assert [(r["turbine_id"], r["wind"], r["power_pu"]) for r in rows] == [("North 1", 5.0, 0.5), ("North 1", None, 1.0), ("Turbine_Data_other", 7.0, None)]
    cleaning.validate_readings(export.readings(spark, str(tmp_path)), ["wind", "power_pu"])
    (event,) = export.events(spark, str(tmp_path)).collect()
    assert (event["turbine_id"], event["code"], event["category"], event["is_fault"]) == ("North 1", "77", "Stop", None)
    raw = json.loads(event["raw"])
    assert list(raw) == sorted(raw) and raw["Message"] == "Yaw  Error"
    write(tmp_path / "Turbine_Data_bad.csv", head + "Date and time,Wind speed (m/s)\n2020-01-01 00:00:00,1\n2020-01-01 00:00:00,2\n")
    with pytest.raises(ValueError, match="disagree"):
        export.readings(spark, str(tmp_path))


def test_farm_datasets(spark, tmp_path):
    farms = {"a": {"directory": "Farm A", "channels": {"rotor": "sensor_1"}, "scale": {"rotor": 9.5}}, "b": {"directory": "Farm B", "channels": {"wind": "sensor_9"}}}
    write(tmp_path / "Farm A/datasets/3.csv", "time_stamp;asset_id;id;sensor_1\n2022-01-01 00:00:00;7.0;1;2\n2022-01-01 00:10:00;7.0;2;\n")
    write(tmp_path / "Farm B/datasets/4.csv", "time_stamp;asset_id;sensor_9\n2022-01-01 00:00:00;1;3\n")
    write(tmp_path / "Farm A/event_info.csv", "asset;event_id;event_label;event_start;event_end;event_description\n7;3;anomaly;2022-01-01 00:00:00;2022-01-02 00:00:00;\n")
    write(tmp_path / "Farm B/event_info.csv", "asset_id;event_id;event_label;event_start;event_end;event_description\n1;4; normal ;2022-01-01 00:00:00;;said\n")
    farm = adapters.FarmDatasets("f", "x", farms)
    rows = {r["turbine_id"]: (r["rotor"], r["wind"]) for r in farm.readings(spark, str(tmp_path)).collect()}
    assert rows == {"a:7:3": (19.0, None), "b:1:4": (None, 3.0)}
    events = {r["turbine_id"]: (r["code"], r["message"]) for r in farm.events(spark, str(tmp_path)).collect()}
    assert events == {"a:7:3": ("anomaly", None), "b:1:4": ("normal", "said")}
    write(tmp_path / "Farm B/datasets/5.csv", "time_stamp;asset_id;sensor_9\n2022-01-01 00:00:00;1;3\n2022-01-01 00:10:00;2;3\n")
    with pytest.raises(ValueError, match="machines"):
        farm.readings(spark, str(tmp_path))


def test_monthly_tables(spark, tmp_path):
    write(tmp_path / "stations.csv", "Turbine Name,Station ID\nT01,11\nT02,12\n")
    write(tmp_path / "tblWind_2020_01.csv", "TimeStamp,StationId,wind\n2020-01-31 23:50:00,11,5\n2020-02-01 00:00:00,11,6\n2020-01-31 23:50:00,91,9\n")
    write(tmp_path / "tblWind_2020_02.csv", "TimeStamp,StationId,wind\n2020-02-01 00:00:00,11,6\n2020-02-01 00:10:00,12,7\n")
    write(tmp_path / "tblGrid_2020_01.csv", "TimeStamp,StationId,power\n2020-01-31 23:50:00,11,\n2020-02-01 00:00:00,11,1000\n")
    write(tmp_path / "tblGrid_2020_02.csv", "TimeStamp,StationId,power\n2020-02-01 00:00:00,11,1000\n2020-02-01 00:20:00,12,2000\n")
    write(tmp_path / "tblAlarmLog_2020_01.csv", "TimeOn,TimeOff,StationNr,Alarmcode\n2020-01-05 10:00:00,,11,3130.0\n2020-01-05 10:00:00,,91,1\n")
    write(tmp_path / "tblFlag_2020_01.csv", "TimeStamp,StationId,a\n2020-01-01 00:10:00,11,5\n2020-01-01 00:10:00,11,5\n")
    write(tmp_path / "tblFlag_2021_01.csv", "TimeStamp,StationId,a\n2021-01-01 00:10:00,11,5\n2021-01-01 00:10:00,11,6\n")
    write(tmp_path / "tblDailySummary_2020_01.csv", "TimeStamp,StationId,h\n2020-01-01 00:00:00,11,3\n2020-01-01 00:00:00,11,4\n")
    tables = adapters.MonthlyTables("m", "site", {"wind": "tblWind.wind", "power_pu": "tblGrid.power"}, rated_kw=2000.0)
    rows = tables.readings(spark, str(tmp_path)).orderBy("timestamp_utc", "turbine_id").collect()
    assert [(r["turbine_id"], r["wind"], r["power_pu"]) for r in rows] == [("T01", 5.0, None), ("T01", 6.0, 0.5), ("T02", 7.0, None), ("T02", None, 1.0)]
    assert stamps(rows) == ["01-31 23:40", "01-31 23:50", "02-01 00:00", "02-01 00:10"]
    (alarm,) = tables.events(spark, str(tmp_path)).collect()
    assert (alarm["turbine_id"], alarm["code"], alarm["end_utc"]) == ("T01", "3130", None)
    assert tables.stop_classes(spark, str(tmp_path), [2020], "tblFlag", ["a"]).collect()[0]["a"] == 5.0
    with pytest.raises(ValueError, match="two sets"):
        tables.stop_classes(spark, str(tmp_path), [2021], "tblFlag", ["a"])
    assert [r["h"] for r in tables.daily_summary(spark, str(tmp_path), [2020], ["h"]).collect()] == [3.0]
    counts = adapters.ingest(tables.readings(spark, str(tmp_path)), ["wind", "power_pu"], f"{tmp_path}/out").collect()
    assert {(r["turbine_id"], r["rows_in"], r["rows_out"]) for r in counts} == {("T01", 2, 2), ("T02", 2, 2)}


def test_downtime_series(spark, tmp_path):
    write(tmp_path / "d.csv", "TimeStamp_StartFormat,TurbineName,ShutdownDuration\n2020-01-01 00:00:00+00:00,T1,600\n2021-01-01 00:00:00+00:00,T1,30\nno,T1,1\n")
    assert [r["downtime_s"] for r in adapters.downtime(spark, str(tmp_path), [2020]).collect()] == [600.0]
    assert adapters.downtime(spark, str(tmp_path)).count() == 2


def test_local_times_that_a_clock_skips_or_repeats(spark):
    zone = ZoneInfo("Europe/London")
    base = [datetime(2021, 3, 28, 0, 30) + timedelta(minutes=30 * k) for k in range(6)] + [datetime(2021, 10, 31, 0, 30) + timedelta(minutes=30 * k) for k in range(6)]
    rows = [(str(t),) for t in base] + [("2021-07-01T10:00:00+02:00",), ("nothing",), (None,)]
    got = [r["u"] for r in spark.createDataFrame(rows, "t string").select(cleaning.local_to_utc(F.col("t"), "Europe/London").alias("u")).collect()]
    want = []
    for t in base:
        folds = {t.replace(tzinfo=zone, fold=f).astimezone(ZoneInfo("UTC")).replace(tzinfo=None) for f in (0, 1)}
        want.append(folds.pop() if len(folds) == 1 else None)
    assert got == [*want, datetime(2021, 7, 1, 8, 0), None, None] and want.count(None) == 4


def test_cleaning_chain_counts_what_it_does(spark):
    t = lambda k: str(datetime(2020, 1, 1) + timedelta(minutes=10 * k))
    rows = [("a", 2020, t(0), 5.0, 1.0), ("a", 2020, t(0), 7.0, None), ("a", 2020, t(1), 999.0, 2.0), ("a", 2020, t(3), 50.0, -3.0), ("a", 2020, "?", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "turbine string, year int, t string, x double, y double")
    rules = cleaning.CleanRules({"x": [999.0]}, {"x": (0.0, 40.0)}, {"y": 0.0}, drop_empty=True)
    out, counts = cleaning.clean(df, ["turbine", "year"], "t", ["x", "y"], rules)
    assert [(r["x"], r["y"]) for r in out.orderBy("step").collect()] == [(6.0, 1.0), (None, 2.0), (None, 0.0)]
    row = counts.first().asDict()
    assert row == {"rows_in": 5, "unparseable": 1, "repeated": 1, "inserted": 1, "rows_out": 3, "sentinel_x": 1, "sentinel_y": 0, "bounds_x": 1, "bounds_y": 0, "floor_x": 0, "floor_y": 1}


def test_events_are_normalised_and_categorised(spark):
    rows = [("s", "p", "t1", "2020-01-01 00:00:00", " F1 ", "  Wind  < START wind ", '{"Status":"Stop","IEC category":"Forced outage"}'), ("s", "p", "t1", None, "x", None, None), ("s", "p", "t2", "2020-01-02", None, "other", "{}")]
    df = spark.createDataFrame(rows, "source string, site string, turbine_id string, start_utc string, code string, message string, raw string")
    events = cleaning.normalize_events(df, codes=["f1"])
    cleaning.validate_events(events)
    got = events.orderBy("start_utc").collect()
    assert [(r["code"], r["message"], r["is_fault"]) for r in got] == [("F1", "wind < start wind", True), (None, "other", None)]
    named = cleaning.categorize_status(events, {"weather": ["Wind < start  wind"]}, ["weather"])
    assert [(r["category"], r["is_fault"], r["provider_status"]) for r in named.orderBy("start_utc").collect()] == [("weather", True, "Stop"), (cleaning.UNMAPPED, None, None)]
    assert cleaning.status_summary(named).first().asDict() == {"rows": 2, "unmapped_rows": 1, "stop_rows": 1, "unmapped_stop_rows": 0, "forced_rows": 1, "unmapped_forced_rows": 0, "messages": 2, "unmapped_messages": 1}
    with pytest.raises(ValueError, match="no column raw"):
        cleaning.validate_events(events.drop("raw"))
    grid = spark.createDataFrame([("t1", 600)], "turbine string, step long")
    starts = spark.createDataFrame([("t1", 1199), ("t1", 1200), ("t2", 600)], "turbine string, start long")
    assert [r["in_grid"] for r in cleaning.in_grid(starts, grid, "start").orderBy("turbine", "start").collect()] == [True, False, False]


def test_labels_known_behind_a_watermark(spark, tmp_path):
    from gridloom.streaming import stream

    t = lambda h: datetime(2020, 1, 1) + timedelta(hours=h)
    spark.createDataFrame([("a", t(h)) for h in range(0, 48)], "turbine string, step timestamp").coalesce(1).write.parquet(f"{tmp_path}/steps")
    spark.createDataFrame([("a", t(5)), ("a", t(40)), ("b", t(5))], "turbine string, start timestamp").coalesce(1).write.parquet(f"{tmp_path}/starts")
    read = lambda n, s: spark.readStream.schema(s).parquet(f"{tmp_path}/{n}")
    out = stream.known_labels(read("steps", "turbine string, step timestamp"), read("starts", "turbine string, start timestamp"), "3 hours")
    got = {(r["step"] - t(0)).total_seconds() / 3600: r["label"] for r in stream.run_once(out, "known").collect()}
    assert {h for h, y in got.items() if y} == {2, 3, 4, 37, 38, 39} and all(not got[h] for h in range(5, 30)) and 46 not in got


def test_hours_since_the_last_event_go_on_from_batch_to_batch(spark, tmp_path):
    from gridloom.streaming import stream

    t = lambda h: datetime(2020, 1, 1) + timedelta(hours=h)
    for k, hours in enumerate(([0, 1, 2, 3], [4, 5, 30])):
        spark.createDataFrame([("a", t(h), h in (1, 5)) for h in hours] + [("b", t(hours[0]), False)], "k string, t timestamp, e boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
    rows = spark.readStream.schema("k string, t timestamp, e boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/rows")
    got = {(r["k"], (r["t"] - t(0)).total_seconds() / 3600): r["hours"] for r in stream.run_once(stream.hours_since_last(rows, ["k"], "t", "e", 24.0), "since").collect()}
    assert got == {("a", 0): None, ("a", 1): 0.0, ("a", 2): 1.0, ("a", 3): 2.0, ("a", 4): 3.0, ("a", 5): 0.0, ("a", 30): 24.0, ("b", 0): None, ("b", 4): None}


def test_stages_are_chosen_and_recorded(spark, tmp_path):
    from gridloom.plans import stages

    chain = [stages.Stage("even", lambda df: df.where("id % 2 = 0"), {"total": F.sum("id")}), stages.Stage("few", lambda df: df.where("id < 10"))]
    out, record = stages.run(spark, spark.range(100), chain, f"file://{tmp_path}")
    assert out.count() == 5 and record == [{"stage": "even", "rows_in": 100, "rows_out": 50, "total": 2450}, {"stage": "few", "rows_in": 50, "rows_out": 5}]
    assert [s.name for s in stages.build(chain, "few")] == ["few"] and len(stages.build(chain)) == 2
    with pytest.raises(ValueError, match="no stage"):
        stages.build(chain, "none")
    assert stages.config_hash({"b": 1, "a": [2]}) == stages.config_hash({"a": [2], "b": 1}) and len(stages.config_hash({})) == 8


def test_ragged_rows_are_kept_and_counted(spark, tmp_path):
    write(tmp_path / "x" / "a.csv", "k,v,w\n1,2,3\n4,5\n6,7,8,9\n\n10,11,12\n")
    write(tmp_path / "x" / "b.csv", "k,v,w\n1,2,3\n")
    path = f"file://{tmp_path}/x"
    table = adapters.read_tables(spark, path)
    rows = sorted(((r["k"], r["v"], r["w"]) for r in table.collect()), key=lambda r: int(r[0]))
    assert rows == [("1", "2", "3"), ("1", "2", "3"), ("4", "5", None), ("6", "7", "8"), ("10", "11", "12")]
    assert table.count() == 5 and table.select("w").count() == 5 and adapters.read_tables(spark, path, ["v"]).select("v").count() == 5
    counts = {r["file"][-5:]: (r["rows"], r["ragged"], r["empty"]) for r in adapters.ragged_rows(spark, path).collect()}
    assert counts == {"a.csv": (4, 2, 0), "b.csv": (1, 0, 0)}
    (tmp_path / "none").mkdir()
    assert adapters.ragged_rows(spark, f"file://{tmp_path}/none").count() == 0


def test_files_are_read_once(spark, tmp_path):
    for k in range(3):
        write(tmp_path / f"F/datasets/{k}.csv", "time_stamp,asset_id,v\n" + "".join(f"2022-01-01 00:{m:02d}:00,{k},{m}.5\n" for m in range(20)))
    rows = adapters.FarmDatasets("f", "x", {"a": {"directory": "F", "channels": {"v": "v"}}}).readings(spark, f"file://{tmp_path}")
    for path in (tmp_path / "F/datasets").iterdir():
        path.unlink()
    assert rows.count() == 60 and rows.selectExpr("sum(v)").first()[0] == 3 * 200.0


def test_heads_of_files_with_and_without_comments(spark, tmp_path):
    write(tmp_path / "a.csv", "# one\n# two\nx,y,z\n1,2,3\n# late\n")
    write(tmp_path / "b.csv", "x,y,z\n4,5,6\n")
    write(tmp_path / "c.csv", "# only\n")
    write(tmp_path / "d.csv", "# 1\n# 2\n# 3\n# 4\n# 5\nx,y,z\n")
    heads = {r["file"][-5:]: (r["comments"], r["header"]) for r in adapters.file_heads(spark, f"file://{tmp_path}", "*.csv", 5).collect()}
    assert heads == {"a.csv": (["# one", "# two", "# late"], "x,y,z"), "b.csv": ([], "x,y,z"), "c.csv": (["# only"], None), "d.csv": (["# 1", "# 2", "# 3", "# 4", "# 5"], None)}


def test_lines_are_written_as_a_file_a_name(spark, tmp_path):
    from gridloom.sources import sinks

    rows = [(f"{k % 7}.csv", f"{k // 7:03d},é{k}") for k in range(3000)]
    assert sinks.write_lines(spark.createDataFrame(rows, "name string, line string").repartition(5), f"file://{tmp_path}/out", "a,b\n") == 7
    want = {f"{n}.csv": "a,b\n" + "".join(f"{line}\n" for name, line in rows if name == f"{n}.csv") for n in range(7)}
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == want
    assert sinks.write_lines(spark.createDataFrame([], "name string, line string"), f"file://{tmp_path}/none") == 0
