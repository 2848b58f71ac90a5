import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideglass.sources import formats
from tideglass.sources.store import Store
from tideglass.streaming import live

SF = "/root/testdata/sf0.001"


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.as_of() is None and s.read().count() == 0
    frame = spark.createDataFrame([("a", "2020-01-01", 1.0), ("a", "2020-02-01", 2.0), ("b", "2020-01-01", None)], "series_id string, date string, value double")
    s.write("2020-03-01", frame)
    s.write("2020-03-01.1", frame.withColumn("is_proxy", F.lit(True)))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        s.write("2020-03-01", frame)
    assert [r.value for r in s.series("2020-03-01", "a").orderBy("date").collect()] == [1.0, 2.0]
    with pytest.raises(KeyError):
        s.series("2020-03-01", "c")
    assert s.index().where("vintage = '2020-03-01.1' AND series_id = 'a'").first().n_obs == 2
    for seq, (v, at) in enumerate([("2020-03-01", "2020-03-02"), ("2020-03-01.1", "2020-03-02"), ("2020-03-01", "2020-04-01")]):
        s.set_current(v, seq, at)
    assert (s.as_of("2020-03-15"), s.as_of("2020-03-01"), s.as_of()) == ("2020-03-01.1", None, "2020-03-01")


def test_json_observations(spark):
    raw = spark.createDataFrame([('{"observations": [{"date": "2020-01-02", "value": "1.5"}, {"date": "2020-01-03", "value": "."}]}',)], "value string")
    assert [tuple(r) for r in formats.json_observations(raw).orderBy("date").collect()] == [(dt.date(2020, 1, 2), 1.5), (dt.date(2020, 1, 3), None)]


def test_factor_table(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text("Some words, and numbers 123\n\n,Mkt-RF,RF\n199001,  1.50, 0.10\n199002, -2.00, 0.20\n\n Annual\n,Mkt-RF,RF\n1990, 9.0, 1.0\n199003, 5.0, 5.0\n")
    got = [(r.date, {k: round(v, 6) for k, v in r.factors.items()}) for r in formats.factor_table(spark, str(p)).orderBy("date").collect()]
    assert got == [(dt.date(1990, 1, 1), {"Mkt-RF": 0.015, "RF": 0.001}), (dt.date(1990, 2, 1), {"Mkt-RF": -0.02, "RF": 0.002})]


def test_dates_and_names(spark):
    df = spark.createDataFrame([("2020-Q3", 1990.1, "pm-returns_2026Q2.csv"), ("2020Q1", 1990.01, "bad.csv"), ("x", 1990.12, "a_b_c.xlsx")], "q string, d double, f string")
    got = [tuple(r) for r in df.select(formats.quarter_start(F.col("q")), formats.decimal_month(F.col("d")), *formats.intake_name(F.col("f"))).collect()]
    day = dt.date
    assert got == [(day(2020, 7, 1), day(1990, 10, 1), "pm-returns", "2026Q2"), (day(2020, 1, 1), day(1990, 1, 1), "", ""), (None, day(1990, 12, 1), "a_b", "c")]


def test_wide_quarters(spark):
    df = spark.createDataFrame([("US:United States", "G:gap", "1.0", ""), ("FR:France", "G:gap", "2.0", "3.0")], "`CTY:Country` string, `TYP:Type` string, `2000-Q1` string, `2000-Q2` string")
    got = formats.wide_quarters(df, {"CTY": "US", "TYP": "G"}).collect()
    assert [(r.date, r.value) for r in got] == [(dt.date(2000, 1, 1), 1.0)]


def test_daily_to_monthly(spark):
    df = spark.createDataFrame([("vix", "2020-01-02", 1.0), ("vix", "2020-01-03", 3.0), ("vix", "2020-01-06", None), ("r", "2020-01-02", 1.0), ("r", "2020-01-03", 2.0)], "series_id string, date string, value double")
    got = formats.daily_to_monthly(df.withColumn("date", F.to_date("date")), F.lower("series_id").rlike("vix|vxo"))
    assert {r.series_id: r.value for r in got.collect()} == {"vix": 3.0, "r": 1.5}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    formats.json_lines(df, str(tmp_path / "j"), ["k"])
    assert [r.k for r in spark.read.schema("k int, v string").json(str(tmp_path / "j")).orderBy("k").collect()] == [1, 2]
    formats.csv_with_notice(df, str(tmp_path / "c"), "attributed")
    got = spark.read.csv(str(tmp_path / "c"), header=True, comment="#")
    assert got.columns == ["k", "v"] and got.count() == 2
    assert all(f.read_text().startswith("# attributed\nk,v\n") for f in (tmp_path / "c").glob("part-*"))


def test_directories_and_stata(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a b.csv").write_text("date,value\n2020-01-01,1.5\n2020-02-01,.\n")
    (tmp_path / "d" / "c.csv").write_text("date,value\nbad,2\n")
    got = [tuple(r) for r in formats.csv_directory(spark, str(tmp_path / "d")).orderBy("series_id", "date").collect()]
    assert got == [("a b", dt.date(2020, 1, 1), 1.5), ("a b", dt.date(2020, 2, 1), None), ("c", None, 2.0)]
    frame = pd.DataFrame({"iso": ["USA", "USA", "FRA"], "year": [1900, 1901, 1900], "gdp": [1.0, None, 3.0]})
    frame.to_stata(tmp_path / "j.dta", write_index=False)
    assert [tuple(r) for r in formats.stata_panel(spark, str(tmp_path / "j.dta"), "USA", "gdp").collect()] == [(dt.date(1900, 1, 1), 1.0)]
    with pytest.raises(Exception, match="no columns"):
        formats.stata_panel(spark, str(tmp_path / "j.dta"), "USA", "debt").collect()


def test_intake_is_logged(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    good = spark.createDataFrame([("0.1",), (None,)], "ret string")
    assert s.take_in("a.csv", good, [("ret", -0.9, 3.0)], "2020-01-01")
    assert not s.take_in("b.csv", good.union(spark.createDataFrame([("n/a",), ("9",)], "ret string")), [("ret", -0.9, 3.0)], "2020-01-02")
    log = spark.read.parquet(str(tmp_path / "intake")).orderBy("file").collect()
    assert [(r.file, r.accepted, r.faults, len(r.wrong)) for r in log] == [("a.csv", True, 0, 0), ("b.csv", False, 2, 2)]


def _run(spark, out, name, mode="append"):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90), "the stream didn't end"
    finally:
        q.stop()
    return spark.table(name)


def _stream(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{SF}/events.parquet*")


def test_windows_and_sessions_equal_batch(spark):
    batch = live.timed(spark.read.parquet(f"{SF}/events.parquet"))
    got = _run(spark, live.tumbling(live.timed(_stream(spark)), "1 day", "event_type", "value"), "tumbled", "complete")
    want = live.tumbling(batch, "1 day", "event_type", "value")
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    got = _run(spark, live.sessions(live.timed(_stream(spark)), "30 minutes", "user_id"), "sessioned", "complete")
    assert got.agg(F.sum("n")).first()[0] == batch.count()
    assert live.deduplicated(batch.union(batch), "event_id").count() == batch.count()


def test_stateful_crossings(spark):
    got = _run(spark, live.crossings(live.timed(_stream(spark)), 50.0, "user_id", "value", tie="event_id"), "crossed")
    w = "lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)"
    want = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "value", f"{w} AS p").where("p IS NOT NULL AND (p < 50) <> (value < 50)")
    assert got.count() == want.count()


def test_crossings_ties_and_nulls(spark, tmp_path):
    rows = [(1, 1, 60.0), (1, 0, 40.0), (2, 2, None), (3, 3, 40.0), (None, 4, 90.0)]
    df = spark.createDataFrame([("k", e, None if d is None else f"2024-01-0{d} 00:00:00", v) for d, e, v in rows], "k string, e long, t string, v double")
    df.select("k", "e", F.col("t").cast("timestamp_ntz").alias("ts"), "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, e long, ts timestamp_ntz, v double").parquet(str(tmp_path / "in"))
    got = _run(spark, live.crossings(live.timed(stream), 50.0, "k", "v", tie="e"), "tied").orderBy("ts").collect()
    assert [(r.ts.day, r.crossing) for r in got] == [(1, "up"), (3, "down")]
